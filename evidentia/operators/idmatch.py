"""Similarity join of short strings under an equal key: all pairs whose ratio reaches a threshold, and no cross product.

The longer string of a pair is cut into segments. With e insertions and deletions between the two in all, and segments that
tolerate one error or none, at least one segment has no more errors than it tolerates as soon as the tolerances plus the
number of segments exceed e. So the other string has that segment whole (kind 1 if a character stands within it, else
kind 0), or has it but for one character (kind 0). Both sides name these pieces, and strings that share one are compared, so
every pair that the threshold admits is found, whatever its edits; places that lie too far apart for e errors drop out at once.

Strings are shuffled once, to the block of their day; pieces are made and met there and go nowhere. A day with more than
``CHUNK`` rows on a side is several blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import _lcs

#: Rows of a side of a block.
CHUNK = 1 << 15
#: Pieces, and pairs, that a task holds at a time.
PIECES, PAIRS = 1 << 22, 1 << 19
#: What bounds the characters that two strings share: so many sorts of characters, each counted up to so many.
SORTS, MOST = 16, 8


def segments(m: int, length: int, odd: int) -> list[tuple[int, int, int, int, int]]:
    """(kind, place, characters from there, second place, characters from there) of the pieces of a segmented string: each segment
    without one of its characters, and whole; the last one may tolerate nothing. Places count from 0."""
    out = []
    for at in range(0, m * length, length):
        if odd and at == (m - 1) * length:
            out.append((0, at, length - 1, at, 0))
        else:
            out += [(0, at, i, at + i + 1, length - 1 - i) for i in range(length)] + [(1, at, length, at, 0)]
    return out


def stretches(size: int, length: int) -> list[tuple[int, int, int, int, int]]:
    """The same for the other string: all stretches, and longer ones without one of their inner characters."""
    whole = [(0, x, length - 1, x, 0) for x in range(size - length + 2)]
    return whole + [(1, x, i, x + i + 1, length - i) for x in range(size - length) for i in range(1, length)]


def least_common(both: int, threshold: int) -> int:
    """The shortest common subsequence with which strings of so many characters together can reach the threshold."""
    return math.ceil((2 * threshold - 1) * both / 400)


def cuts(longer: int, shorter: int, threshold: int) -> tuple[int, int, int, int] | None:
    """(errors, segments, length of one, whether the last tolerates nothing) for two lengths; None if they cannot be alike."""
    common = least_common(longer + shorter, threshold)
    if common > shorter:
        return None
    errors = longer + shorter - 2 * common
    segments, odd = errors // 2 + 1, (errors + 1) % 2
    return errors, segments, max(1, (longer + odd) // segments), odd


def _places(pieces: list[tuple], n: int) -> np.ndarray:
    return np.repeat(np.array([p[1] for p in pieces], np.int32), n)


def _buckets(codes: np.ndarray, pieces: list[tuple], bits: int) -> np.ndarray:
    """A hash of each piece of each string, piece by piece: equal pieces of a kind have equal hashes."""
    out = np.empty((len(pieces), len(codes)), np.int32)
    factor, columns = np.uint64(0x9E3779B97F4A7C15), codes.T.astype(np.uint64) + np.uint64(1)
    for at, (kind, place, n1, second, n2) in enumerate(pieces):
        h = np.full(len(codes), kind + 1, np.uint64)
        for i in (*range(place, place + n1), *range(second, second + n2)):
            if i < len(columns):
                h = (h + columns[i]) * factor
        out[at] = ((h ^ (h >> np.uint64(29))) * factor) >> np.uint64(64 - bits)
    return out.ravel()


def _sorts(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each string has each sort of character, as so many bits of two words; and what goes beyond ``MOST``."""
    counts = np.stack([(codes % SORTS == s).sum(axis=1) for s in range(SORTS)], axis=1)
    bits = ((1 << np.minimum(counts, MOST)) - 1).astype(np.uint64) << (np.arange(SORTS, dtype=np.uint64) % 8 * MOST)
    return np.bitwise_or.reduce(bits.reshape(-1, 2, 8), axis=2), np.maximum(counts - MOST, 0).sum(axis=1)


def _common(short: np.ndarray, long: np.ndarray, letters: int) -> np.ndarray:
    """Longest common subsequences of rows of codes, bit-parallel (see ``similarity._lcs``)."""
    n, size = short.shape
    if size > 64:
        text = lambda row: "".join(map(chr, row))
        return np.array([_lcs(text(a), text(b)) for a, b in zip(short.tolist(), long.tolist(), strict=True)], int)
    out = np.empty(n, int)
    step = max(1, PIECES // letters)
    for start in range(0, n, step):
        a, b = short[start : start + step], long[start : start + step]
        each = np.arange(len(a))
        where = np.zeros((len(a), letters), np.uint64)
        for i in range(size):
            where[each, a[:, i]] |= np.uint64(1 << i)
        full = np.uint64((1 << size) - 1)
        row = np.full(len(a), full)
        for i in range(long.shape[1]):
            hit = row & where[each, b[:, i]]
            row = (row + hit | row - hit) & full
        out[start : start + step] = size - np.bitwise_count(row)
    return out


def _met(cut: np.ndarray, segments: list[tuple], other: np.ndarray, stretches: list[tuple], near: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of rows of ``cut`` and ``other`` that share a piece at places near enough, and enough characters; a pair may come again."""
    bits = max(10, (4 * len(cut) * len(segments)).bit_length())
    bucket = _buckets(cut, segments, bits)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=1 << bits)
    starts = np.cumsum(sizes) - sizes
    row, place = (order % len(cut)).astype(np.int32), _places(segments, len(cut))[order]
    (cut_bits, cut_over), (other_bits, _) = _sorts(cut), _sorts(other)
    apart = cut.shape[1] - other.shape[1]
    step = max(1, PIECES // len(stretches))
    for start in range(0, len(other), step):
        some = other[start : start + step]
        asked = _buckets(some, stretches, bits)
        n, first, at, own = sizes[asked], starts[asked], _places(stretches, len(some)), np.tile(np.arange(start, start + len(some), dtype=np.int32), len(stretches))
        ends = np.cumsum(n)
        for low in range(0, int(ends[-1]), PAIRS):
            # the pairs numbered from low on, whatever pieces they belong to
            number = np.arange(low, min(low + PAIRS, int(ends[-1])))
            a, b = np.searchsorted(ends, [number[0], number[-1]], side="right")
            times = np.minimum(ends[a : b + 1], number[-1] + 1) - np.maximum(ends[a : b + 1] - n[a : b + 1], low)
            piece = np.repeat(np.arange(a, b + 1), times)
            found = first[piece] + number - (ends - n)[piece]
            shift = place[found] - at[piece]
            keep = np.abs(shift) + np.abs(apart - shift) <= near
            i, j = row[found[keep]], own[piece[keep]]
            both = cut_bits[i] & other_bits[j]
            enough = np.bitwise_count(both[:, 0]) + np.bitwise_count(both[:, 1]) + cut_over[i] >= least
            yield i[enough], j[enough]


def pairs_alike(left: list[str], right: list[str], threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of the pairs whose ratio reaches the threshold; a pair may come again. Empty strings match nothing."""
    if not left or not right:
        return
    letters = np.unique(np.frombuffer("".join({*"".join(left), *"".join(right)}).encode("utf-32-le", "surrogatepass"), np.uint32))

    def by_length(ids: list[str]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        sizes = np.array([len(x) for x in ids], int)
        found = {}
        for size in sorted({*sizes.tolist()} - {0}):
            rows = np.flatnonzero(sizes == size)
            text = "".join(ids[r] for r in rows).encode("utf-32-le", "surrogatepass")
            found[size] = rows, np.searchsorted(letters, np.frombuffer(text, np.uint32)).reshape(-1, size).astype(np.int32)
        return found

    lefts, rights = by_length(left), by_length(right)
    for a, (l_rows, l_codes) in lefts.items():
        for b, (r_rows, r_codes) in rights.items():
            if not (shape := cuts(max(a, b), min(a, b), threshold)):
                continue
            errors, m, length, odd = shape
            swap = a > b  # the left one is the longer one
            longer, other = (l_codes, r_codes) if swap else (r_codes, l_codes)
            own, read = segments(m, length, odd), stretches(other.shape[1], length)
            step = max(1, PIECES // len(own))
            for start in range(0, len(longer) if read else 0, step):
                cut = longer[start : start + step]
                for i, j in _met(cut, own, other, read, errors + 2, least_common(a + b, threshold)):
                    i, j = np.divmod(np.unique(i.astype(np.int64) * len(other) + j), len(other))
                    reached = np.rint(200.0 * _common(other[j], cut[i], len(letters)) / (a + b)) >= threshold
                    l, r = (start + i[reached], j[reached]) if swap else (j[reached], start + i[reached])
                    yield l_rows[l], r_rows[r]


def alike_ids(left: DataFrame, right: DataFrame, threshold: int, first: list[str] | None = None, chunk: int = CHUNK) -> DataFrame:
    """l, r: the numbers of all pairs of rows of one ``day`` whose ids are alike by ``threshold`` percent (``similarity.ratio``).
    Both sides have n (a number of its own for each row), day and id; their days are counted first, so they should be tables.
    Null or empty ids match nothing. Equal ids of a block are compared once.

    With ``first``, columns of the right side: l and all that the right side has but day and id, of the row that comes first by
    these columns (nulls first) among those alike in a block; a day of several blocks gives a row for each.
    """
    usable = [df.where("day is not null and id is not null and id <> ''") for df in (left, right)]
    counts = [df.groupBy("day").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > chunk).select(F.col("day").alias("_day"), F.ceil(F.col("n") / chunk).cast("int").alias(name)) for df, name in zip(usable, ("_l", "_r"), strict=True)]
    # at most one for each chunk of rows
    busy = F.broadcast(counts[0].join(counts[1], "_day", "full").na.fill(1))
    own = lambda by, n: F.pmod(F.xxhash64(*by), F.coalesce(n, F.lit(1))).cast("int")
    all_ = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))
    ls, rs = (df.join(busy, F.col("day") == F.col("_day"), "left") for df in usable)
    ls = ls.select("n", "day", "id", own(["n"], F.col("_l")).alias("q"), all_(F.col("_r")).alias("i"))
    rs = rs.select(*right.columns, own(first or ["n"], F.col("_r")).alias("i"), all_(F.col("_l")).alias("q"))
    types = dict(left.dtypes)["n"], dict(right.dtypes)
    carried = [c for c in right.columns if c not in ("day", "id")] if first else []
    schema = f"l {types[0]}, " + (", ".join(f"`{c}` {types[1][c]}" for c in carried) or f"r {types[1].get('n')}")

    def different(ids: pa.ChunkedArray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The different strings, the number of each row's, and the first row of each."""
        coded = ids.combine_chunks().dictionary_encode()
        number = coded.indices.to_numpy()
        return coded.dictionary.to_pylist(), number, np.unique(number, return_index=True)[1]

    def block(l: pa.Table, r: pa.Table) -> pa.Table:
        if first and r.num_rows:
            r = r.take(pc.sort_indices(r, [(c, "ascending") for c in first], null_placement="at_start"))
        (l_ids, l_number, _), (r_ids, r_number, r_first) = different(l["id"]), different(r["id"])
        if first:
            # different ids are numbered in their order of appearance, so the least number is the first row's
            best = np.full(len(l_ids), len(r_ids))
            for i, j in pairs_alike(l_ids, r_ids, threshold):
                np.minimum.at(best, i, j)
            rows = np.flatnonzero(best[l_number] < len(r_ids))
            chosen = r_first[best[l_number[rows]]]
            return pa.table([l["n"].take(pa.array(rows)), *[r[c].take(pa.array(chosen)) for c in carried]], names=["l", *carried])
        met = [i * len(r_ids) + j for i, j in pairs_alike(l_ids, r_ids, threshold)]
        i, j = np.divmod(np.unique(np.concatenate([np.zeros(0, np.int64), *met])), max(1, len(r_ids)))
        l_rows, r_rows = (np.split(np.argsort(x, kind="stable"), np.cumsum(np.bincount(x, minlength=n))[:-1]) if n else [] for x, n in ((l_number, len(l_ids)), (r_number, len(r_ids))))
        rows = [np.zeros((0, 2), int), *[np.stack(np.meshgrid(l_rows[a], r_rows[b]), axis=-1).reshape(-1, 2) for a, b in zip(i, j, strict=True)]]
        pairs = np.concatenate(rows)
        return pa.table([l["n"].take(pa.array(pairs[:, 0])), r["n"].take(pa.array(pairs[:, 1]))], names=["l", "r"])

    return ls.groupBy("day", "q", "i").cogroup(rs.groupBy("day", "q", "i")).applyInArrow(block, schema)
