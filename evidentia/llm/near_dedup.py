"""Near-duplicate documents by improved consistent weighted sampling.

Shingles are five words; a shingle weighs its count in the text times its inverse document frequency, from 1 (in every
document) to 2 (in one). Document frequencies are counted over all documents in hashed counters of a fixed number, so
the table that is broadcast has a fixed size; what a counter holds of other shingles on average is taken off, so rare
shingles stay rare however many there are. A sample of each text's weighted shingles agrees between two texts with the probability of their weighted
Jaccard similarity; samples are banded, texts that share a band are candidates, and the similarity of candidates is
computed from the whole texts.

Equal word sequences are one node. In each bucket first the smallest node is compared with the others, then one that
differs from band to band, which is linear in the bucket. What the links found so far leave apart is compared pair by
pair in blocks of bounded size: only members outside a bucket's largest component meet all others, pairs whose samples
agree too rarely (see ``LEAST_AGREEMENT``) are left out, and a block sends on no more links than it needs to connect.
"""

from __future__ import annotations

import zlib
from collections import OrderedDict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .blocks import SIDE, grouped
from .common import lean, only, only_kept, shuffle_partitions, written
from .components import components
from .words import mix, ngram_hashes, word_hashes

SHINGLE, THRESHOLD = 5, 0.8
#: 48 samples: a pair at the threshold shares a band with probability 0.998, at 0.9 it practically always does.
BANDS, BAND_ROWS, SEED = 12, 4, 23
#: Of 48 samples, a pair at the threshold agrees in so few with probability 0.00003.
LEAST_AGREEMENT = 26
#: Counters of document frequencies, and how far they move a weight: from 1 (in every document) to 1 + ``IDF_GAIN``.
#: A large group of near copies makes its own shingles frequent; weights that went on from there would take the similarity
#: of its members below the threshold.
COUNTERS, IDF_GAIN = 1 << 20, 1.0
_COUNTER_BLOCK = 1 << 16
_CHUNK = 1024


def shingles(text: str | None, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, str]:
    """Different shingle hashes, ascending, their counts, and a digest of the word sequence. A text of fewer words has
    one shingle, all of them; one without words none."""
    words = word_hashes(text)
    hashes, counts = np.unique(ngram_hashes(words, min(n, len(words))) if len(words) else words, return_counts=True)
    return hashes, counts, xxhash.xxh3_128_hexdigest(words.tobytes())


def counter(hashes: np.ndarray, counters: int) -> np.ndarray:
    return (mix(hashes) % np.uint64(counters)).astype(np.int64)


def inverse_frequencies(frequencies: np.ndarray, docs: int, gain: float = IDF_GAIN) -> np.ndarray:
    """Weights by counter. A counter's own shingle is taken to have what it holds beyond the mean of the others."""
    beside = (frequencies.sum() - frequencies) / max(1, len(frequencies) - 1)
    own = np.clip(np.round(frequencies - beside), 1, max(docs, 1))
    rare = np.log((1.0 + docs) / (1.0 + own)) / np.log(1.0 + max(docs, 1))
    return (1.0 + gain * rare).astype(np.float32)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of (ascending hashes, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = float(np.minimum(a[1][i], b[1][j]).sum())
    every = float(a[1].sum() + b[1].sum()) - both
    return both / every if every else 0.0


@cache
def _gamma() -> np.ndarray:
    """Quantiles of the gamma distribution with shape 2 in the middles of 2**16 equal parts."""
    want = (np.arange(1 << 16) + 0.5) / (1 << 16)
    low, high = np.zeros(1 << 16), np.full(1 << 16, 40.0)
    for _ in range(60):
        middle = (low + high) / 2
        below = 1 - (1 + middle) * np.exp(-middle) < want
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    return high


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _gamma(), 1 / _gamma(), np.log(_gamma())


def samples(hashes: np.ndarray, weights: np.ndarray, n: int, seed: int = SEED) -> np.ndarray:
    """``n`` consistent weighted samples as 32-bit numbers: for each the shingle of least ln a and its quantised weight.

    With r, c ~ Gamma(2, 1) and b ~ U(0, 1) of shingle and sample: t = floor(ln w / r + b), ln a = ln c - r (t - b + 1).
    """
    r_of, inverse_of, log_of = _tables()
    seeds = mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    least, pick, level = np.full(n, np.inf), np.zeros(n, np.uint64), np.zeros(n)
    column, log_weights = np.arange(n), np.log(weights)
    for at in range(0, len(hashes), _CHUNK):
        own = hashes[at : at + _CHUNK]
        x = mix(own[:, None] ^ seeds)
        i = (x & np.uint64(0xFFFF)).view(np.int64)
        j = ((x >> np.uint64(16)) & np.uint64(0xFFFF)).view(np.int64)
        b = (x >> np.uint64(32)).astype(np.float64)
        b *= 2.0**-32
        t = inverse_of.take(i)
        t *= log_weights[at : at + _CHUNK, None]
        t += b
        np.floor(t, out=t)
        np.subtract(t, b, out=b)
        b += 1
        b *= r_of.take(i)
        a = log_of.take(j)
        a -= b
        k = a.argmin(axis=0)
        value = a[k, column]
        better = value < least
        least[better], pick[better], level[better] = value[better], own[k[better]], t[k[better], column[better]]
    return (mix(pick ^ mix(level.astype(np.int64).view(np.uint64))) >> np.uint64(32)).astype(np.uint32)


def band_keys(sampled: np.ndarray, bands: int, rows: int) -> np.ndarray:
    odd = np.array([pow(0xD6E8FEB86659FD93, i + 1, 1 << 64) for i in range(rows)], np.uint64)
    return mix((sampled.astype(np.uint64).reshape(bands, rows) * odd).sum(axis=1, dtype=np.uint64)).view(np.int64)


def document_frequencies(docs: DataFrame, counters: int = COUNTERS) -> tuple[np.ndarray, int]:
    """Hashed counters over all documents, and how many documents have words. Tasks send dense blocks of counters, which
    are summed in groups of 64 until one of each is left: the driver gets ``counters`` numbers."""
    spark, blocks = docs.sparkSession, -(-counters // _COUNTER_BLOCK)
    schema = "block int, part long, docs long, data binary"
    out = pa.schema([("block", pa.int32()), ("part", pa.int64()), ("docs", pa.int64()), ("data", pa.binary())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(blocks * _COUNTER_BLOCK, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                hashes, _, _ = shingles(text)
                n += len(hashes) > 0
                np.add.at(total, counter(hashes, counters), 1)
        part = TaskContext.get().partitionId()
        data = [zlib.compress(x.tobytes(), 1) for x in np.split(total, blocks)]
        yield pa.RecordBatch.from_arrays([pa.array(range(blocks), pa.int32()), pa.array([part] * blocks, pa.int64()), pa.array([n] * blocks, pa.int64()), pa.array(data, pa.binary())], schema=out)

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(_COUNTER_BLOCK, np.int64)
        for data in pdf["data"]:
            total += np.frombuffer(zlib.decompress(data), np.int64)
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "part": pdf["part"].iloc[:1] // 64, "docs": pdf["docs"].sum(), "data": [zlib.compress(total.tobytes(), 1)]})

    parts = written(docs.select("text").mapInArrow(lean(count), schema), "frequencies")
    while True:
        most = parts.agg(F.max("part").alias("m")).first().m
        if not most:
            break
        parts = written(parts.groupBy("block", F.floor(F.col("part") / 64).alias("_group")).applyInPandas(add, schema), "frequencies")
    found = np.zeros(blocks * _COUNTER_BLOCK, np.int64)
    n = 0
    for row in parts.toLocalIterator():
        found[row.block * _COUNTER_BLOCK : (row.block + 1) * _COUNTER_BLOCK] = np.frombuffer(zlib.decompress(row.data), np.int64)
        n = row.docs
    return found[:counters], n


class Weigher:
    """Weighted shingles of texts; the last few texts are remembered, as one text often meets many in a row."""

    def __init__(self, idf: np.ndarray, remember: int = 8):
        self.idf, self.last, self.most = idf, OrderedDict(), remember

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray, str]:
        if text in self.last:
            self.last.move_to_end(text)
            return self.last[text]
        hashes, counts, digest = shingles(text)
        found = hashes, counts * self.idf[counter(hashes, len(self.idf))].astype(float), digest
        self.last[text] = found
        if len(self.last) > self.most:
            self.last.popitem(last=False)
        return found


def signatures(docs: DataFrame, idf, bands: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    """doc_id, node (digest of the words), has_words, bands (keys) and sampled (32-bit samples). ``idf``: a broadcast."""
    out = pa.schema([("doc_id", pa.int64()), ("node", pa.string()), ("has_words", pa.bool_()), ("bands", pa.list_(pa.int64())), ("sampled", pa.binary())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh = Weigher(idf.value, 1)
        for batch in batches:
            node, words, keys, sampled = [], [], [], []
            for text in batch.column(1).to_pylist():
                hashes, weights, digest = weigh(text)
                drawn = samples(hashes, weights, bands * rows)
                node.append(digest)
                words.append(len(hashes) > 0)
                keys.append(band_keys(drawn, bands, rows))
                sampled.append(drawn.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip((node, words, keys, sampled), list(out)[1:], strict=True))], schema=out)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(task), "doc_id long, node string, has_words boolean, bands array<long>, sampled binary")


def verified(pairs: DataFrame, texts: DataFrame, idf, threshold: float) -> DataFrame:
    """The pairs (a, b) of nodes whose texts are as similar as ``threshold``."""
    a = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    out = pa.schema([("a", pa.string()), ("b", pa.string())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh = Weigher(idf.value)
        for batch in batches:
            found = []
            for left, right, text_a, text_b in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                x, y = weigh(text_a), weigh(text_b)
                # an id that several texts share fetches texts of other nodes, too
                if x[2] == left and y[2] == right and similarity(x, y) >= threshold:
                    found.append((left, right))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*found, strict=True)], schema=out)

    return pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(lean(task), "a string, b string").distinct()


def mixed_members(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members (band, key, node) of buckets that hold several components so far, with ``comp`` and ``most``, the component
    that has most of the bucket."""
    held = members.select("band", "key", "node").join(roots, "node", "left").select("band", "key", "node", F.coalesce("root", "node").alias("comp"))
    counts = held.groupBy("band", "key", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("band", "key").agg(F.max_by("comp", F.struct("n", "comp")).alias("most"), F.count(F.lit(1)).alias("comps"))
    return held.join(written(counts.where("comps > 1").drop("comps"), "mixed-buckets"), ["band", "key"])


def by_band_leader(mixed: DataFrame) -> DataFrame:
    """Pairs (a, b) of the members of a bucket with a leader that differs from band to band, if in another component."""
    order = F.xxhash64("band", "node")
    leaders = mixed.groupBy("band", "key").agg(F.min_by(F.struct("node", "comp"), F.struct(order, "node")).alias("leader"))
    pairs = mixed.join(leaders, ["band", "key"]).where(F.col("comp") != F.col("leader.comp"))
    return pairs.select(F.least("node", "leader.node").alias("a"), F.greatest("node", "leader.node").alias("b")).distinct()


def links_apart(mixed: DataFrame, nodes: DataFrame, texts: DataFrame, idf, threshold: float, bands: int, rows: int, least: int, side: int = SIDE) -> DataFrame:
    """Links (a, b) between bucket members of different components: whatever connects them, not each one.

    Members outside the bucket's largest component meet all members, in blocks of about ``side`` each. In a block, pairs
    whose samples agree ``least`` times or more are compared by their texts at the first band that they share, likeliest
    first; a pair that is connected by then needs no comparison.
    """
    few = mixed.where("comp <> most")
    sizes = mixed.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("comp") != F.col("most")).alias("m")).select("band", "key", F.ceil(F.col("n") / side).cast("int").alias("parts"), F.ceil(F.col("m") / side).cast("int").alias("groups"))
    part = lambda n: F.pmod(F.xxhash64("node", F.lit(5)), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    residents = mixed.join(sizes, ["band", "key"]).select("band", "key", part("parts").alias("part"), each("groups").alias("group"), F.lit(True).alias("resident"), "node", "comp")
    visitors = few.join(sizes, ["band", "key"]).select("band", "key", each("parts").alias("part"), part("groups").alias("group"), F.lit(False).alias("resident"), "node", "comp")
    block = ["band", "key", "part", "group"]
    known = nodes.select("node", "bands", "sampled").join(texts, "node")
    met = residents.unionByName(visitors).join(known, "node").select(*block, "resident", "node", "comp", "bands", "sampled", "text")
    met = met.repartition(shuffle_partitions(mixed.sparkSession), *block).sortWithinPartitions(*block)
    out = pa.schema([("a", pa.string()), ("b", pa.string())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (band, *_), held in grouped(batches, len(block)):
            found = list(_connect(band, held, Weigher(idf.value, len(held)), threshold, bands * rows, least))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*found, strict=True)], schema=out)

    return met.mapInArrow(lean(compare), "a string, b string").distinct()


def _connect(band: int, held: list[tuple], weigh: Weigher, threshold: float, width: int, least: int) -> Iterator[tuple[str, str]]:
    """Links of a block of (resident, node, comp, bands, samples, text)."""
    sides = [[r for r in held if r[0]], [r for r in held if not r[0]]]
    if not all(sides):
        return
    keys = [np.array([r[3] for r in x]) for x in sides]
    drawn = [np.frombuffer(b"".join(r[4] for r in x), np.uint32).reshape(len(x), width) for x in sides]
    comp = [np.array([r[2] for r in x]) for x in sides]
    agree = np.zeros((len(sides[0]), len(sides[1])), np.int16)
    for i in range(width):
        agree += drawn[0][:, i][:, None] == drawn[1][:, i]
    fit = (agree >= least) & (comp[0][:, None] != comp[1])
    for i in range(band):
        fit &= keys[0][:, i][:, None] != keys[1][:, i]
    root: dict[str, str] = {}

    def find(x: str) -> str:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    x, y = np.nonzero(fit)
    for k in np.argsort(-agree[x, y], kind="stable").tolist():
        a, b = sides[0][x[k]], sides[1][y[k]]
        one, other = find(a[2]), find(b[2])
        if one != other:
            left, right = weigh(a[5]), weigh(b[5])
            if left[2] == a[1] and right[2] == b[1] and similarity(left, right) >= threshold:
                root[one] = other
                yield a[1], b[1]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = BAND_ROWS, least: int = LEAST_AGREEMENT, counters: int = COUNTERS, gain: float = IDF_GAIN, side: int = SIDE) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (smallest doc_id of the documents linked with it, directly or not),
    class_size, kept (one document of each class, that with the smallest id), words_digest (of its word sequence).

    Null texts and texts without words link with nothing. Texts of the same words are in one class. Of rows that repeat
    the staying id one stays; a null id is a class's id only if all are null. An empty table gives no rows. Other
    columns are not read.
    """
    table = only(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text")
    context = table.sparkSession.sparkContext
    idf = context.broadcast(inverse_frequencies(*document_frequencies(table, counters), gain))
    signed = written(signatures(table, idf, bands, rows), "signatures")
    nodes = written(signed.where("has_words").groupBy("node").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"), F.first("sampled").alias("sampled")), "nodes")

    placed = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    # a table, so that adaptive execution can split the join where a bucket is very large
    buckets = written(placed.groupBy("band", "key").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    members = written(placed.join(buckets, ["band", "key"]).select("band", "key", "node", "leader"), "members")
    wanted = members.select("node").distinct().join(nodes.select("node", "first_doc"), "node")
    texts = written(table.join(wanted, F.col("doc_id").eqNullSafe(F.col("first_doc"))).select("node", "text"), "texts")
    stars = written(members.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), "stars")
    links = written(verified(stars, texts, idf, threshold), "links")

    # what one leader left apart meets others, then everything that is still apart
    mixed = mixed_members(members, components(links))
    more = by_band_leader(mixed).join(stars, ["a", "b"], "left_anti")
    links = links.unionByName(written(verified(more, texts, idf, threshold), "links"))
    mixed = written(mixed_members(members, components(links)), "mixed")
    links = links.unionByName(written(links_apart(mixed, nodes, texts, idf, threshold, bands, rows, least, side), "links"))

    roots = components(links)
    in_class = nodes.select("node", "first_doc", "copies").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = in_class.groupBy("root").agg(F.min("first_doc").alias("class_id"), F.sum("copies").alias("class_size"))
    per_node = in_class.select("node", "root").join(classes, "root").select("node", "class_id", "class_size")
    of_words = signed.where("has_words").select("doc_id", "node").join(per_node, "node").select("doc_id", "class_id", "class_size", "node")
    twin = F.row_number().over(Window.partitionBy("doc_id", "class_id").orderBy("node"))
    kept = of_words.select("doc_id", "class_id", "class_size", (F.col("doc_id").eqNullSafe(F.col("class_id")) & (twin == 1)).alias("kept"), F.col("node").alias("words_digest"))
    alone = signed.where("not has_words").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"), F.col("node").alias("words_digest"))
    return kept.unionByName(alone)


@F.pandas_udf(StringType())
def _digest(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: xxhash.xxh3_128_hexdigest(word_hashes(x).tobytes()))


def class_representatives(docs: DataFrame) -> DataFrame:
    """One document of each class, with all its columns."""
    kept = near_duplicates(docs).where("kept").withColumnRenamed("words_digest", "_words")
    return only_kept(docs.withColumn("_words", _digest("text")), kept, "_words")
