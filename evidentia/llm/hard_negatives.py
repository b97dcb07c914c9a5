"""Hard negatives by zone maps over Hilbert-ordered blocks.

Vectors become whole numbers, are sorted along a Hilbert curve through all their dimensions and written to Parquet as
blocks of neighbours, each with its least and greatest value of every dimension. By interval arithmetic these bound an
anchor's inner product with anything in the block from both sides, so an anchor reads only blocks that can hold a score
inside one of its windows. A first pass reads the most promising block of each slot only; what it finds narrows the
windows for the second, which reads every block that may still matter. Anchors lie in chunks along the same curve and
go to each slot once; a slot holds a bounded number of blocks.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, only, shared_dir, shuffle_partitions, written

#: Rows of a block, blocks of a slot on average, anchors of a chunk, bits of each dimension along the curve.
BLOCK, SLOT, CHUNK, BITS = 512, 128, 64, 4
#: Row groups of the block table in bytes.
GROUP_BYTES = 4 << 20
FAR = float("inf")

_PACKED = [("chunk", pa.int64()), ("dims", pa.int32()), ("n", pa.int32()), ("rows", pa.binary()), ("ids", pa.binary()), ("labels", pa.list_(pa.string())), ("wide", pa.bool_()), ("vectors", pa.binary()), ("low", pa.binary()), ("high", pa.binary())]
_PACKED_DDL = "chunk long, dims int, n int, rows binary, ids binary, labels array<string>, wide boolean, vectors binary, low binary, high binary"


def hilbert_keys(cells: np.ndarray, bits: int) -> list[bytes]:
    """Places of grid cells (rows, dimensions; whole numbers below 2^bits) on the Hilbert curve, as bytes that sort so."""
    rows, dims = cells.shape
    x = cells.T.astype(np.int64)
    bit = 1 << bits - 1
    while bit > 1:  # undo, from the coarsest level on, the turns and reflections of each sub-cube
        below = bit - 1
        for i in range(dims):
            set_ = (x[i] & bit) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & below)
            x[0] ^= np.where(set_, below, swap)
            x[i] ^= swap
        bit >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros(rows, np.int64)
    bit = 1 << bits - 1
    while dims and bit > 1:
        flip ^= np.where((x[-1] & bit) != 0, bit - 1, 0)
        bit >>= 1
    x ^= flip
    levels = [(x >> b & 1).T for b in range(bits - 1, -1, -1)]
    return [r.tobytes() for r in np.packbits(np.concatenate(levels, axis=1).astype(np.uint8), axis=1)] if dims else [b""] * rows


def _exact(largest_a: int, largest_b: int, dims: int):
    """A type in which inner products of such numbers are exact."""
    bound = max(1, largest_a) * max(1, largest_b) * max(1, dims)
    return np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 62 else object


def _fitting(scores: np.ndarray) -> np.ndarray:
    return np.clip(scores, -(1 << 63), (1 << 63) - 1) if scores.dtype == object else scores


class Part:
    """A block of candidates, or a chunk of anchors."""

    def __init__(self, row: dict):
        n, dims = row["n"], row["dims"]
        self.chunk, self.n, self.dims, self.labels = row["chunk"], n, dims, np.array(row["labels"], object)
        self.rows, self.ids = np.frombuffer(row["rows"], np.int64), np.frombuffer(row["ids"], np.int64)
        self.vectors = np.frombuffer(row["vectors"], np.int64 if row["wide"] else np.int32).reshape(n, dims)
        self.low, self.high = np.frombuffer(row["low"], np.int64), np.frombuffer(row["high"], np.int64)
        self.largest = max([abs(int(v)) for v in (*self.low, *self.high)], default=0)
        self.names = set(row["labels"])


def bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest inner product that an anchor (row) can have with a vector of each interval (row)."""
    up, down = np.where(anchors > 0, anchors, 0), np.where(anchors < 0, anchors, 0)
    return up @ low.T + down @ high.T, up @ high.T + down @ low.T


def search(chunk: Part, blocks: list[Part], windows: dict[int, dict[int, tuple[int, int]]], k: int, same: bool, first_only: bool) -> tuple[list[tuple], int]:
    """For each anchor and window (row -> window -> (from, to)) its best k rows of the blocks within the window, of its own
    label or of others, best first: (anchor row, window, score, id, row); and how often a block was read by an anchor."""
    blocks = [b for b in blocks if b.dims == chunk.dims]
    if not blocks:
        return [], 0
    kind = _exact(chunk.largest, max(b.largest for b in blocks), chunk.dims)
    own = chunk.vectors.astype(kind)
    least, most = map(_fitting, bounds(own, np.array([b.low for b in blocks]).astype(kind), np.array([b.high for b in blocks]).astype(kind)))
    wanted = [(i, w, *windows[int(row)][w]) for i, row in enumerate(chunk.rows) for w in windows.get(int(row), ())]
    fit = np.array([[label in b.names if same else b.names != {label} for b in blocks] for label in chunk.labels], bool).reshape(chunk.n, len(blocks))
    best: dict[tuple[int, int], list[tuple]] = defaultdict(list)
    floor = {(i, w): low for i, w, low, _ in wanted}
    seeds = {}
    if first_only:
        for i, w, low, high in wanted:
            places = np.nonzero(fit[i] & (most[i] >= low) & (least[i] <= high))[0]
            if len(places):
                seeds[i, w] = places[np.argmax(np.minimum(most[i][places], high))]
    reads = 0
    for j in np.argsort(-most.max(axis=0).astype(np.float64), kind="stable").tolist():
        block = blocks[j]
        asked = [(i, w, floor[i, w], high) for i, w, low, high in wanted if fit[i, j] and most[i, j] >= floor[i, w] and least[i, j] <= high and (not first_only or seeds.get((i, w)) == j)]
        if not asked:
            continue
        used = sorted({i for i, *_ in asked})
        reads += len(used)
        scores = _fitting(own[used] @ block.vectors.astype(kind).T)
        at = {i: n for n, i in enumerate(used)}
        for i, w, low, high in asked:
            s = scores[at[i]]
            mask = (s >= low) & (s <= high) & ((block.labels == chunk.labels[i]) == same)
            if same:
                mask &= block.rows != chunk.rows[i]
            found = np.nonzero(mask)[0]
            if len(found) > k:  # ties at the k-th score stay until they are ordered by id
                values = s[found]
                found = found[values >= np.sort(values)[-k]]
            if len(found):
                new = [(-int(s[n]), int(block.ids[n]), int(block.rows[n])) for n in found]
                kept = best[i, w] = sorted(best[i, w] + new)[:k]
                if len(kept) == k:
                    floor[i, w] = max(floor[i, w], -kept[-1][0])
    return [(int(chunk.rows[i]), w, -score, id_, row) for (i, w), kept in best.items() for score, id_, row in kept], reads


def _packed(rows: DataFrame, size: int, partitions: int) -> DataFrame:
    """Rows along the curve in parts of ``size``; a part's vectors have one length."""
    out = pa.schema(_PACKED)

    def part(number: int, rows: list[tuple]) -> pa.RecordBatch:
        row, ids, labels, vectors = zip(*rows, strict=True)
        x = np.array(vectors, np.int64).reshape(len(rows), len(vectors[0]))
        wide = bool(x.size) and bool((x.max() >= 1 << 31) or (x.min() < -(1 << 31)))
        values = [[number], [x.shape[1]], [len(rows)], [np.array(row, np.int64).tobytes()], [np.array(ids, np.int64).tobytes()], [list(labels)], [wide], [x.astype(np.int64 if wide else np.int32).tobytes()], [x.min(axis=0).tobytes()], [x.max(axis=0).tobytes()]]
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, out, strict=True)], schema=out)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 33, []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and (len(held) == size or len(held[0][3]) != len(row[3])):
                    yield part(number, held)
                    number, held = number + 1, []
                held.append(row)
        if held:
            yield part(number, held)

    order = ["dims", "key", "row"]
    return rows.repartitionByRange(max(1, partitions), *order).sortWithinPartitions(*order).select("row", "vec_id", "label", "x").mapInArrow(lean(task), _PACKED_DDL)


def _pass(chunks: DataFrame, asked: DataFrame | None, blocks: DataFrame, slots: int, k: int, same: bool, first_only: bool, share: tuple[int, int]) -> DataFrame:
    """chunk, anchor (row), window, score, id, row: the best k of each anchor and window. ``asked`` has chunk, anchor, window,
    centre and least. With ``same`` each anchor has one window, from ``least`` on if it is there; otherwise each row of
    ``asked`` is a window about ``centre``."""
    ask = "array<struct<anchor:long,window:int,centre:long,least:long>>"
    if asked is None:
        sent = chunks.withColumn("asked", F.lit(None).cast(ask))
    else:
        sent = chunks.join(asked.groupBy("chunk").agg(F.collect_list(F.struct("anchor", "window", "centre", "least")).alias("asked")), "chunk", "left" if same else "inner")
    sent = sent.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))).withColumn("kind", F.lit(1))
    held = blocks.withColumn("asked", F.lit(None).cast(ask)).withColumn("slot", F.pmod(F.xxhash64("chunk"), F.lit(slots)).cast("int")).withColumn("kind", F.lit(0))
    both = held.unionByName(sent).repartition(max(1, min(slots, shuffle_partitions(chunks.sparkSession))), "slot").sortWithinPartitions("slot", "kind", "chunk")
    out = pa.schema([("chunk", pa.int64()), ("anchor", pa.int64()), ("window", pa.int32()), ("score", pa.int64()), ("id", pa.int64()), ("row", pa.int64())])

    def limits(chunk: Part, asked: list[dict] | None) -> dict[int, dict[int, tuple]]:
        found: dict[int, dict[int, tuple]] = defaultdict(dict)
        if same:
            found |= {int(row): {0: (-FAR, FAR)} for row in chunk.rows}
        for a in asked or ():
            low, high = (-FAR, FAR) if same else (-(-share[0] * a["centre"] // 100), share[1] * a["centre"] // 100)
            if a["least"] is not None:
                low = max(low, a["least"])
            if low <= high:
                found[a["anchor"]][a["window"]] = (low, high)
        return found

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, held = None, []
        for batch in batches:
            for n in range(batch.num_rows):
                row = batch.slice(n, 1).to_pylist()[0]
                if row["slot"] != slot:
                    slot, held = row["slot"], []
                part = Part(row)
                if row["kind"] == 0:
                    held.append(part)
                    continue
                found, _ = search(part, held, limits(part, row["asked"]), k, same, first_only)
                if found:
                    anchor, window, score, ids, rows = zip(*found, strict=True)
                    columns = [[part.chunk] * len(found), anchor, window, score, ids, rows]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    found = both.mapInArrow(lean(task), "chunk long, anchor long, window int, score long, id long, row long")
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", every: int = 100, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100), scale: int = 256, block: int = BLOCK, chunk: int = CHUNK, slot: int = SLOT) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A component x counts as floor(scale * x), and a score is the inner product of such vectors. Anchors are the rows whose
    id is divisible by ``every``. An anchor's positives are the ``positives`` other rows of its label with the highest
    scores; for each, its negatives are the ``negatives`` rows of other labels with the highest scores from share[0] to
    share[1] percent of the positive's, which no score is if the positive's is negative. Ties go by the smaller id.

    Rows with a null id, label or vector, or a null or non-finite component take no part; vectors of different lengths never
    meet. A row that repeats an id or another row is a row of its own, as an anchor too; a table without anchors,
    positives or negatives gives no rows. Scores beyond 64 bits count as the nearest that fits. Other columns are not read.
    """
    rows = only(vectors, vec_id=id_col, vector=vector_col, label=label_col).select(F.col("vec_id").cast("long"), F.col("vector").cast("array<double>"), F.col("label").cast("string"))
    spark = rows.sparkSession
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.forall("vector", number), F.lit(False)))
    whole = usable.select("vec_id", "label", F.transform("vector", lambda x: F.floor(F.lit(float(scale)) * x)).alias("x"), F.size("vector").alias("dims"))
    largest = whole.agg(F.max(F.greatest(F.abs(F.array_max("x").cast("double")), F.abs(F.array_min("x").cast("double"))))).first()[0] or 1.0
    out = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("x", pa.list_(pa.int64())), ("dims", pa.int32()), ("key", pa.binary())])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(2).to_pylist()
            keys: list = [None] * len(x)
            by_length = defaultdict(list)
            for n, v in enumerate(x):
                by_length[len(v)].append(n)
            for dims, places in by_length.items():
                at = np.array([x[n] for n in places], np.float64).reshape(len(places), dims)
                cells = np.minimum((at + largest) / (2 * largest) * (1 << BITS), (1 << BITS) - 1).astype(np.int64)
                for n, key in zip(places, hilbert_keys(cells, BITS), strict=True):
                    keys[n] = key
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], schema=out)

    placed = whole.mapInArrow(lean(keyed), "vec_id long, label string, x array<long>, dims int, key binary")
    table = written(placed.withColumn("row", F.monotonically_increasing_id()), "vectors")
    parts = shuffle_partitions(spark)
    path = shared_dir(spark, "blocks")
    _packed(table, block, parts).write.option("parquet.block.size", GROUP_BYTES).parquet(path)
    blocks = spark.read.schema(_PACKED_DDL).parquet(path)
    anchored = table.where(F.col("vec_id") % every == 0)
    n_blocks, n_anchors = blocks.count(), anchored.count()
    chunks = written(_packed(anchored, chunk, min(parts, -(-n_anchors // chunk))), "anchors")
    slots = max(1, min(n_blocks, max(parts, -(-n_blocks // slot))))

    def best(windows: DataFrame | None, k: int, same: bool, name: str) -> DataFrame:
        first = _pass(chunks, windows, blocks, slots, k, same, True, share)
        least = first.groupBy("chunk", "anchor", "window").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("least"))
        narrowed = least.withColumn("centre", F.lit(None).cast("long")) if windows is None else windows.drop("least").join(least, ["chunk", "anchor", "window"], "left")
        return written(_pass(chunks, narrowed, blocks, slots, k, same, False, share), name)

    near = best(None, positives, True, "positives")
    windows = near.select("chunk", "anchor", F.col("rank").alias("window"), F.col("score").alias("centre"), F.lit(None).cast("long").alias("least"))
    far = best(windows, negatives, False, "negatives").select("anchor", "window", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    pairs = near.select("anchor", F.col("rank").alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    names = anchored.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return pairs.join(far, ["anchor", "window"]).join(names, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


#: DuckDB SQL for ``op11_hard_negatives``: every anchor against every row.
ORACLE_SQL = """
with v as (
    select row_number() over () as row, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding::double[], lambda x: floor(256 * x)) as x
    from embeddings where vec_id is not null and label is not null and embedding is not null
    and coalesce(list_bool_and(list_transform(embedding::double[], lambda x: x is not null and isfinite(x))), true)
),
scored as (
    select a.row as a, a.vec_id as anchor_id, b.row as b, b.vec_id as id, a.label = b.label as same, list_dot_product(a.x, b.x)::bigint as score
    from v a join v b on len(a.x) = len(b.x) and a.row <> b.row where a.vec_id % 100 = 0
),
positives as (
    select a, anchor_id, id as positive_id, score as positive_score, row_number() over (partition by a order by score desc, id, b) as p from scored where same qualify p <= 5
),
negatives as (
    select p.*, s.id as negative_id, s.score as negative_score, row_number() over (partition by p.a, p.p order by s.score desc, s.id, s.b) as rank
    from positives p join scored s on s.a = p.a and not s.same and 80 * positive_score <= 100 * s.score and 100 * s.score <= 100 * positive_score qualify rank <= 5
)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from negatives
"""
