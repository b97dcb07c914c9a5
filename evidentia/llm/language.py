"""Language identification by rank-order profiles.

A profile ranks the most frequent n-grams (one to three letters, words padded with blanks) of a language; a document's
own ranks are compared with each profile, and the sum of how far n-grams are out of place, at most the profile's length
each, is the distance. Profiles come from a bounded number of labelled documents for each language; each document is
then read once, as a whole, on the map side.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, lean, only

#: N-grams of a profile, and labelled documents that each language's profile is learned from at most.
PROFILE = 400
TRAIN_DOCS = 200
#: Characters counted at a time: a very long text needs no more memory than this many.
STEP = 1 << 20
UNDETERMINED = "und"
_BITS = 20


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(1 << _BITS)), bool, 1 << _BITS)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the n-grams of a text, codes ascending; empty if it has no letters.

    A code is n and the letters' code points, the first one highest; anything but letters is a blank. A blank stands at
    the ends of an n-gram only, so none crosses words.
    """
    text = f" {text.lower()} "
    if len(text) <= STEP:
        return np.unique(_codes(text, 0), return_counts=True)
    found: Counter = Counter()
    for at in range(0, len(text), STEP):  # a step begins two characters early: n-grams that end there were counted
        skip = min(at, 2)
        found.update(dict(zip(*(x.tolist() for x in np.unique(_codes(text[at - skip : at + STEP], skip), return_counts=True)), strict=True)))
    codes = np.array(sorted(found), np.int64)
    return codes, np.array([found[c] for c in codes.tolist()], np.int64)


def _codes(text: str, skip: int) -> np.ndarray:
    """The codes of the n-grams that end at position ``skip`` or later."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    points = np.where(_letters()[np.minimum(points, (1 << _BITS) - 1)], points, 0)
    one, two, three = points[skip:], max(skip, 1), max(skip, 2)
    a, b = points[two - 1 : -1], points[two:]
    c, d, e = points[three - 2 : -2], points[three - 1 : -1], points[three:]
    return np.concatenate(
        [
            ((1 << 60) | one)[one != 0],
            ((2 << 60) | (a << _BITS) | b)[(a | b) != 0],
            ((3 << 60) | (c << 2 * _BITS) | (d << _BITS) | e)[d != 0],
        ]
    )


def ranked(codes: np.ndarray, counts: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The codes of the most frequent n-grams, most frequent first; of equal counts the smaller code."""
    return codes[np.argsort(-counts, kind="stable")[:most]]


class Profiles:
    """Distances of ranked n-grams to profiles {language: codes by rank}."""

    def __init__(self, profiles: dict[str, np.ndarray], most: int = PROFILE):
        self.names, self.most = sorted(profiles), most
        self.codes = np.unique(np.concatenate([np.empty(0, np.int64), *profiles.values()]))
        self.ranks = np.full((len(self.codes) + 1, len(self.names)), -1, np.int64)
        for i, name in enumerate(self.names):
            self.ranks[np.searchsorted(self.codes, profiles[name]), i] = np.arange(len(profiles[name]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language, of equally near ones the first by name, and 1 - distance / greatest distance."""
        codes, counts = grams(text or "")
        if not len(codes) or not self.names:
            return UNDETERMINED, 0.0
        own = ranked(codes, counts, self.most)
        at = np.searchsorted(self.codes, own)
        at[self.codes[np.minimum(at, len(self.codes) - 1)] != own] = len(self.codes)
        ranks = self.ranks[at]
        apart = np.where(ranks < 0, self.most, np.minimum(np.abs(ranks - np.arange(len(own))[:, None]), self.most)).sum(axis=0)
        best = int(np.argmin(apart))
        return self.names[best], 1.0 - float(apart[best]) / (self.most * len(own))


def held_out(doc_id):
    """Documents that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, train_docs: int = TRAIN_DOCS, most: int = PROFILE) -> dict[str, np.ndarray]:
    """Profiles from documents (doc_id, text, lang) that are not held out, ``train_docs`` of each language at most, those
    with the smallest hashes of doc_id. The driver gets ``most`` n-grams of each language."""
    labelled = docs.where(F.col("lang").isNotNull() & ~held_out("doc_id"))
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id")
    chosen = labelled.where("text is not null").select("doc_id", "lang").withColumn("n", F.row_number().over(by_hash)).where(F.col("n") <= train_docs).select("doc_id", "lang").distinct()
    # a bounded number of ids for each language
    texts = labelled.join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                codes, counts = grams(text or "")
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes, pa.int64()), pa.array(counts, pa.int64())], names=["lang", "code", "n"])

    summed = texts.mapInArrow(lean(count), "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    top = summed.withColumn("rank", rank).where(F.col("rank") <= most)
    found: dict[str, list] = {}
    for r in sorted(top.collect(), key=lambda r: (r["lang"], r["rank"])):
        found.setdefault(r["lang"], []).append(r["code"])
    return {lang: np.array(codes, np.int64) for lang, codes in found.items()}


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], most: int = PROFILE) -> DataFrame:
    """``docs`` (with a column text) and ``_nearest``, a struct of lang_pred and score.

    Null texts, texts without letters, and any text if no profile was learned, get ``und`` and 0. Repeated rows and null
    ids get a row each. An empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(profiles)

    @F.pandas_udf("lang_pred string, score double")
    def nearest(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = Profiles(sent.value, most)
        for batch in texts:
            yield pd.DataFrame([known.predict(text) for text in batch], columns=["lang_pred", "score"])
        give_back()

    return docs.withColumn("_nearest", nearest("text"))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS, most: int = PROFILE) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score. See ``predict`` for odd rows; a null doc_id is
    not held out. Other columns are not read."""
    rows = only(docs, doc_id=id_col, text=text_col, lang=lang_col)
    predicted = predict(rows.select("doc_id", "text"), learn(rows, train_docs, most), most)
    return predicted.select("doc_id", held_out("doc_id").alias("held_out"), "_nearest.lang_pred", "_nearest.score")


#: A document less like its nearest profile than this is in no known language.
MIN_SCORE = 0.2


def accepted(docs: DataFrame, min_score: float = MIN_SCORE, **options) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, lang and any others, all kept) in a recognised language: not ``und``, and of
    more than ``min_score``."""
    predicted = predict(docs, learn(only(docs, doc_id="doc_id", text="text", lang="lang"), **options), options.get("most", PROFILE))
    return predicted.where((F.col("_nearest.lang_pred") != UNDETERMINED) & (F.col("_nearest.score") > min_score)).drop("_nearest")
