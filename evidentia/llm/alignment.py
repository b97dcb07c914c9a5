"""Which tokens of one tokenizer cover which tokens of another, and how often each two of them meet in the corpus.

Two dictionaries lead from the byte at which a token ends to its place in the row of tokens. The ends that both have, in
order, cut both rows of ids into groups; within a group the links are the tokens whose bytes overlap.

The text is aligned in units that neither tokenizer joins to what is around them: one or more pre-tokens of the first,
cut where no piece of the second has the two characters at the cut next to each other. A worker remembers short units.
A document's links are written as pairs of ids with how often each occurs. Counting pairs over documents and looking the
counts up again are joins; the frequent pairs, of which no more than ``FREQUENT`` are broadcast, never leave the document's
task, so only pairs that few documents have are shuffled.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import accumulate, chain, count

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, only, remembered, written
from .tokens import PreTokens, byte_letters

#: Pairs that are broadcast, at most.
FREQUENT = 1 << 18
#: Units that a worker remembers, in all; units of more characters are not remembered.
UNITS, UNIT_CHARS = 480_000, 48


class _Plain(PreTokens):
    """Special strings in a text are text."""

    def special(self, text: str) -> bool:
        return False


def groups(a_ends: list[int], b_ends: list[int]) -> list[tuple[int, int, int, int]]:
    """Slices (a from, a to, b from, b to) between the ends that both rows of tokens have."""
    in_a, in_b = dict(zip(a_ends, count(1))), dict(zip(b_ends, count(1)))  # noqa: B905
    cuts, i, j = [], 0, 0
    for end in sorted(in_a.keys() & in_b.keys()):
        to_i, to_j = in_a[end], in_b[end]
        cuts.append((i, to_i, j, to_j))
        i, j = to_i, to_j
    return cuts


def links(a_ends: list[int], b_ends: list[int], cut: tuple[int, int, int, int]) -> Iterator[tuple[int, int]]:
    """Places (in a, in b) of the tokens of a group whose bytes overlap."""
    i, to_i, j, to_j = cut
    while i < to_i and j < to_j:
        yield i, j
        if a_ends[i] < b_ends[j]:
            i += 1
        else:
            j += 1


class Unit:
    """A unit's numbers of tokens and groups, its groups as text, and its links as one number each."""

    __slots__ = ("n_a", "n_b", "n_groups", "text", "pairs")

    def __init__(self, n_a: int, n_b: int, shown: list[str], pairs: list[int]):
        self.n_a, self.n_b, self.n_groups = n_a, n_b, len(shown)
        self.text, self.pairs = ";".join(shown), pairs


class Aligner:
    """Units of texts under a byte-level ``tokenizers`` file (a) and a ``sentencepiece`` model (b). A unit is a pre-token, or a
    tuple of several."""

    #: What the model joins to nothing, so that a unit can be encoded after it as it is within a text.
    APART = "\n"

    def __init__(self, a_path: str, b_path: str, cache: int = UNITS):
        import sentencepiece

        self.a, self.b = _Plain(a_path, "byte"), sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = {ord(c): b for b, c in byte_letters().items()}
        self.a_bytes = {i: t.translate(letters).encode("latin-1") for t, i in self.a.library.get_vocab(with_added_tokens=False).items() if all(ord(c) in letters for c in t)}
        self.span = self.b.vocab_size()
        self.b_bytes = [self._piece(i) for i in range(self.span)]
        pieces = [self.b.id_to_piece(i).replace("▁", " ") for i in range(self.span) if not self.b.is_byte(i)]
        self.near = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        self.before = self.b.encode(self.APART)
        self.by_units = not any(self.APART in p for p in pieces) and b"".join(self.b_bytes[i] for i in self.before) == b" " + self.APART.encode()
        self.a_size, self.b_size = {i: len(x) for i, x in self.a_bytes.items()}, list(map(len, self.b_bytes))
        self.a_shown, self.b_shown = {i: str(i) for i in self.a_bytes}, [str(i) for i in range(self.span)]
        self.half, self.old, self.new = max(1, cache // 2), {}, {}

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        if self.b.is_byte(i):
            return bytes([int(piece[1:-1], 16)])
        return b"" if self.b.is_control(i) else piece.replace("▁", " ").encode()

    def cut(self, text: str) -> list[str | tuple[str, ...]]:
        """Units of a blank and the text."""
        units, now, last = [], [], ""
        for words in self.a.cut(" " + text):
            for word in words:
                if now and self.by_units and last + word[0] not in self.near:
                    units.append(now[0] if len(now) == 1 else tuple(now))
                    now = [word]
                else:
                    now.append(word)
                last = word[-1]
        return [*units, now[0] if len(now) == 1 else tuple(now)]

    def units(self, keys: Iterable[str | tuple[str, ...]]) -> dict[str | tuple[str, ...], Unit | None]:
        """What is known of the units; None where either row of tokens does not give the bytes back."""
        found, missing = {}, []
        for key in keys:
            unit = self.new.get(key, self)
            if unit is self:
                unit = self.old.get(key, self)
                if unit is self:
                    missing.append(key)
                    continue
                self._keep(key, unit)
            found[key] = unit
        if not missing:
            return found
        texts = ["".join(key) for key in missing]
        rows = self.b.encode([self.APART + t for t in texts] if self.by_units else [t[1:] for t in texts], num_threads=1)
        a = [[t.id for t in self.a._word(key)] if isinstance(key, str) else [t.id for word in key for t in self.a._word(word)] for key in missing]
        b = [row[len(self.before) :] for row in rows] if self.by_units else rows
        made = self._made(texts, a, b) or [(self._made([t], [i], [j]) or [None])[0] for t, i, j in zip(texts, a, b, strict=True)]
        for key, text, unit in zip(missing, texts, made, strict=True):
            found[key] = unit
            if len(text) <= UNIT_CHARS:
                self._keep(key, unit)
        return found

    def _made(self, texts: list[str], a_rows: list[list[int]], b_rows: list[list[int]]) -> list[Unit] | None:
        """Units of a row of texts, which are aligned as one; None if the tokens of any do not give its bytes back."""
        a, b = list(chain.from_iterable(a_rows)), list(chain.from_iterable(b_rows))
        whole = [t.encode() for t in texts]
        if not b"".join([self.a_bytes[i] for i in a]) == b"".join(whole) == b"".join([self.b_bytes[i] for i in b]):
            return None
        a_ends, b_ends = list(accumulate([self.a_size[i] for i in a])), list(accumulate([self.b_size[i] for i in b]))
        ends = list(accumulate(map(len, whole)))
        cuts, a_shown, b_shown, span = groups(a_ends, b_ends), [self.a_shown[i] for i in a], [self.b_shown[i] for i in b], self.span
        units, shown, pairs, unit, from_a, from_b = [], [], [], 0, 0, 0
        for cut in cuts:
            i, to_i, j, to_j = cut
            if to_i - i == 1:
                shown.append(f"{a_shown[i]}|{b_shown[j]}" if to_j - j == 1 else f"{a_shown[i]}|{','.join(b_shown[j:to_j])}")
                pairs += [a[i] * span + x for x in b[j:to_j]]
            elif to_j - j == 1:
                shown.append(f"{','.join(a_shown[i:to_i])}|{b_shown[j]}")
                pairs += [x * span + b[j] for x in a[i:to_i]]
            else:
                shown.append(f"{','.join(a_shown[i:to_i])}|{','.join(b_shown[j:to_j])}")
                pairs += [a[x] * span + b[y] for x, y in links(a_ends, b_ends, cut)]
            if a_ends[to_i - 1] >= ends[unit]:
                if a_ends[to_i - 1] != ends[unit]:
                    return None
                units.append(Unit(to_i - from_a, to_j - from_b, shown, pairs))
                shown, pairs, unit, from_a, from_b = [], [], unit + 1, to_i, to_j
        return units

    def _keep(self, key, unit: Unit | None) -> None:
        if len(self.new) >= self.half:
            self.old, self.new = self.new, {}
        self.new[key] = unit

    def align(self, text: str | None) -> tuple[list, Counter, dict] | None:
        """The units in order, how often each occurs, and what each is; None for a text that has no tokens."""
        if not text:
            return None
        units = self.cut(text)
        times = Counter(units)
        known = self.units(times)
        return None if any(u is None for u in known.values()) else (units, times, known)


def aligned(docs: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: doc_id; n_a, n_b, n_groups, n_links; groups, as "a1,a2|b1;a3|b2,b3" of ids in order;
    pairs (a's id times the number of b's pieces, plus b's id) that are linked, and times: how often each is.

    ``a`` reads a blank and the text, ``b`` puts that blank there itself. Null and empty texts, and those whose bytes either
    tokenizer does not give back (for instance with U+2581), have no tokens: zeros, '' and empty arrays. Special strings in a
    text are text. Repeated rows and null ids give a row each, an empty table none. Other columns are not read.
    """
    rows = only(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text")
    out = pa.schema([*[(c, pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")], ("groups", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])

    def row(found) -> tuple:
        if not found:
            return 0, 0, 0, 0, "", [], []
        units, times, known = found
        n_a = n_b = n_groups = 0
        pairs: defaultdict[int, int] = defaultdict(int)
        for key, n in times.items():
            unit = known[key]
            n_a += n * unit.n_a
            n_b += n * unit.n_b
            n_groups += n * unit.n_groups
            for pair in unit.pairs:
                pairs[pair] += n
        return n_a, n_b, n_groups, sum(pairs.values()), ";".join([known[u].text for u in units]), list(pairs), list(pairs.values())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = remembered(("alignment", a, b), lambda: Aligner(a, b))
        for batch in batches:
            columns = zip(*[row(aligner.align(text)) for text in batch.column(1).to_pylist()], strict=True) if batch.num_rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, f.type) for c, f in zip(columns, list(out)[1:], strict=True)]], schema=out)

    return rows.mapInArrow(lean(task, keep=True), "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<long>")


def frequent_pairs(counts: DataFrame, most: int = FREQUENT) -> DataFrame:
    """The pairs in most documents: as many classes of counts (eighths of a power of two) as hold ``most`` pairs or fewer."""
    classed = counts.withColumn("class", F.floor(8 * F.log2("n_docs")))
    room, least = most, 1 << 30
    for r in sorted(classed.groupBy("class").count().collect(), key=lambda r: -r["class"]):
        room -= r["count"]
        if room < 0:
            break
        least = int(r["class"])
    return classed.where(F.col("class") >= least).drop("class")


def align(docs: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, frequent: int = FREQUENT) -> DataFrame:
    """The rows of ``aligned`` without pairs and times, but with what all documents say of them: n_best, the links whose pair
    is in as many documents as any pair of its id of ``a``, and count_sum, the documents of the links' pairs summed over
    links. Equal texts count each. With ``digest``, groups_sha256 stands in place of groups, which then are written nowhere
    ('' for a text without tokens)."""
    found = aligned(docs, a, b, id_col, text_col)
    if digest:
        found = found.withColumn("groups", F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")).withColumnRenamed("groups", "groups_sha256")
    kept = written(found.withColumn("row", F.monotonically_increasing_id()), "alignments")
    counts = written(kept.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n_docs")), "pair-counts")
    by_a = counts.withColumn("a", F.expr(f"pair div {Aligner(a, b, 1).span}"))
    # as many rows as the vocabulary of ``a`` has
    best = by_a.groupBy("a").agg(F.max("n_docs").alias("best"))
    of_pair = by_a.join(F.broadcast(best), "a").select("pair", "n_docs", (F.col("n_docs") == F.col("best")).alias("is_best"))
    sums = [F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n_docs") * F.col("times")).alias("count_sum")]
    linked = kept.select("row", F.inline(F.arrays_zip("pairs", "times"))).withColumnRenamed("pairs", "pair")
    near = F.broadcast(frequent_pairs(of_pair, frequent))
    common = linked.join(near, "pair").groupBy("row").agg(*sums)
    rare = linked.join(near.select("pair"), "pair", "left_anti").join(of_pair, "pair").groupBy("row").agg(*sums)
    total = common.unionByName(rare).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    both = kept.drop("pairs", "times").join(total, "row", "left").drop("row")
    return both.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_best", "count_sum")})
