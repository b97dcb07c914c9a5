"""String similarity. Ratios count insertions and deletions: 2 * longest common subsequence / both lengths."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType


def _chars(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.split(text, "")).otherwise(F.array().cast("array<string>"))


def common_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence, one row of the table at a time."""
    zeros = F.array_repeat(F.lit(0), F.length(b) + 1)

    def row(above: Column, ca: Column) -> Column:
        def cell(left: Column, j: Column) -> Column:
            best = F.when(F.get(_chars(b), j) == ca, F.get(above, j) + 1).otherwise(F.greatest(F.get(above, j + 1), F.get(left, j)))
            return F.concat(left, F.array(best))

        places = F.when(F.length(b) > 0, F.sequence(F.lit(0), F.length(b) - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(places, F.array(F.lit(0)), cell)

    return F.element_at(F.aggregate(_chars(a), zeros, row), -1)


def ratio(a: Column, b: Column) -> Column:
    """0-100, whole."""
    both = F.length(a) + F.length(b)
    return F.when(both == 0, F.lit(0)).otherwise(F.bround(F.lit(200.0) * common_length(a, b) / both)).cast("int")


def alike(a: Column, b: Column, threshold: int) -> Column:
    """Whether ``ratio`` reaches a threshold. Characters in the same places are a common subsequence: where they are enough
    (equal or nearly equal strings), the table is not computed."""
    at_least = F.bround(F.lit(200.0) * positional_ratio(a, b) * F.length(b) / (F.length(a) + F.length(b)))
    return F.when(at_least >= threshold, True).otherwise(ratio(a, b) >= threshold)


def positional_ratio(a: Column, b: Column) -> Column:
    """The share of ``b``'s characters that ``a`` has in the same place."""
    same = F.zip_with(_chars(a), _chars(b), lambda x, y: F.coalesce((x == y).cast("int"), F.lit(0)))
    return F.try_divide(F.aggregate(same, F.lit(0), lambda s, x: s + x).cast("double"), F.length(b))


def _lcs(a: str, b: str) -> int:
    """Bit-parallel: bit i of ``row`` is 0 where the table steps up at a[i]."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def words_alike(texts: Column, words: list[str], threshold: float) -> Column:
    """For each string of an array the numbers of the words that stand in it or are alike to a stretch of it by
    ``threshold`` (``partial_ratio``), in order. Workers remember so many different strings."""

    @F.pandas_udf(ArrayType(ArrayType(IntegerType())))
    def numbers(texts: pd.Series) -> pd.Series:
        @lru_cache(1 << 16)
        def of(text: str) -> list[int]:
            return [n for n, word in enumerate(words) if word in text or partial_ratio_of(text, word, threshold) >= threshold]

        return pd.Series([None if row is None else [of(x) for x in row] for row in texts], dtype=object)

    return numbers(texts)


def partial_ratio_of(a: str, b: str, cutoff: float = 0.0) -> float:
    """The best ratio (0-100) of the shorter string with any stretch of the longer one that is as long, or cut by an end.
    Below ``cutoff`` it is 0 where the characters in common show that without a comparison."""
    if len(a) == len(b) and a != b:  # either may be the one that is cut
        return max(_best_stretch(a, b, cutoff), _best_stretch(b, a, cutoff))
    return _best_stretch(a, b, cutoff) if len(a) <= len(b) else _best_stretch(b, a, cutoff)


def _best_stretch(short: str, long: str, cutoff: float) -> float:
    if not short:
        return 0.0
    if short in long:
        return 100.0
    common = sum(min(short.count(c), long.count(c)) for c in set(short))
    if 200.0 * common / (len(short) + common) < cutoff:
        return 0.0
    n, best = len(short), 0.0
    for start in range(1 - n, len(long)):
        part = long[max(0, start) : start + n]
        # no more than 2 * min / both can be reached
        if 200.0 * len(part) / (n + len(part)) > best:
            best = max(best, 200.0 * _lcs(short, part) / (n + len(part)))
    return best


def partial_ratio(a: Column, b: Column, cutoff: float = 0.0) -> Column:
    """0-100 for pairs of strings, null for null. Each pair of a batch is computed once."""

    @F.pandas_udf(DoubleType())
    def best(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict[tuple, float | None] = {}
        out = []
        for pair in zip(a, b, strict=True):
            if pair not in known:
                known[pair] = partial_ratio_of(*pair, cutoff) if None not in pair else None
            out.append(known[pair])
        return pd.Series(out, dtype=float)

    return best(a, b)
