"""Many keywords in one pass over each text, by an automaton that a worker builds once."""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

HITS = "array<struct<word:int,place:int,n:int>>"


@lru_cache(8)
def automaton(words: tuple[str, ...]) -> ahocorasick.Automaton:
    """Of the different words that are not empty; each leads to its first number and its length."""
    made = ahocorasick.Automaton()
    for number, word in enumerate(words):
        if word and word not in made:
            made.add_word(word, (number, len(word)))
    made.make_automaton()
    return made


def found_words(text: str, words: tuple[str, ...]) -> list[tuple[int, int, int]]:
    """(number of the word, where it stands first, how often) in the order of the words; overlapping occurrences count."""
    if not any(words):
        return []
    first: dict[int, list[int]] = {}
    for end, (number, size) in automaton(words).iter(text):
        seen = first.setdefault(number, [end - size + 1, 0])
        seen[1] += 1
    return [(number, *first[number]) for number in sorted(first)]


def keyword_hits(text: Column, words: list[str]) -> Column:
    """The words that stand in a text, as (number, first place from 0 in characters, occurrences); a word that is given twice
    counts under its first number, an empty one never. Null for null."""
    given = tuple(words)

    @F.pandas_udf(HITS)
    def scan(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else [{"word": w, "place": p, "n": n} for w, p, n in found_words(t, given)] for t in texts], dtype=object)

    return scan(text)


def first_word(text: Column, words: list[str]) -> Column:
    """The number of the first word of the list that stands in a text; null if none does."""
    return F.try_element_at(keyword_hits(text, words), F.lit(1))["word"]
