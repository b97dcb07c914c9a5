"""Inverted lists with product quantisation: vectors as one byte for each part, and exact scores for what stays open.

An item belongs to its nearest coarse cell, and what the cell's centre leaves of it is cut into parts; a code names the
nearest of 256 centres for each part. A query's products with all centres are a small table, so an item's score is
estimated by adding up a few entries. The estimate is off by no more than the length of what the code leaves of the item:
items whose estimate with that error could still be among the best are scored exactly from their vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .search import CHUNK, DIGITS, _dealt, few, slabs, with_cells

#: Parts of a vector, bits of a part's code, rows that centres are fitted on at most, rounds of fitting.
PARTS, BITS, FIT_ROWS, ROUNDS = 8, 8, 20_000, 8
#: Errors count as their whole length, or as so many standard deviations of a product with a vector of any direction.
SLACK: float | None = None


def _centres(v: np.ndarray, k: int, seed: int, rounds: int = ROUNDS) -> np.ndarray:
    """k-means; a centre that nothing is near to stays where it was."""
    centres = v[np.random.default_rng(seed).choice(len(v), min(k, len(v)), replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(v, centres)
        count = np.bincount(own, minlength=len(centres))
        total = np.stack([np.bincount(own, weights=column, minlength=len(centres)) for column in v.T], axis=1)
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    return centres


def _nearest(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * v @ centres.T).argmin(axis=1)


class Quantiser:
    """Coarse centres, and for each part of a vector up to 2^bits centres of what the coarse ones leave."""

    def __init__(self, coarse: np.ndarray, books: list[np.ndarray]):
        self.coarse, self.books = coarse, books
        self.ends = np.cumsum([0, *[b.shape[1] for b in books]])

    def encode(self, v: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (rows, parts) and the length of what they leave."""
        rest = v - self.coarse[cell]
        parts = [rest[:, a:b] for a, b in zip(self.ends, self.ends[1:], strict=False)]
        codes = np.stack([_nearest(x, book) for x, book in zip(parts, self.books, strict=True)], axis=1)
        left = sum(((x - book[c]) ** 2).sum(axis=1) for x, book, c in zip(parts, self.books, codes.T, strict=True))
        return codes.astype(np.uint8), np.sqrt(left)

    def tables(self, q: np.ndarray) -> list[np.ndarray]:
        """For each part the products of queries (rows) with its centres."""
        return [q[:, a:b] @ book.T for a, b, book in zip(self.ends, self.ends[1:], self.books, strict=False)]

    def estimate(self, q: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Products of queries (rows) with coded items of a cell (columns)."""
        return (q @ self.coarse[cell])[:, None] + sum(t[:, c] for t, c in zip(self.tables(q), codes.T, strict=True))


def build(items: DataFrame, parts: int = PARTS, bits: int = BITS, fit_rows: int = FIT_ROWS, seed: int = 3) -> tuple[DataFrame, Quantiser]:
    """The index of all items (filename, clip): filename, cell, code, error (rounded up to a float); and the quantiser.

    As many cells as the root of the number of items. Centres are fitted on ``fit_rows`` items that a hash picks at most;
    every item is coded. Items with a null vector are left out; all vectors have one length.
    """
    spark = items.sparkSession
    usable = items.where("clip is not null and filename is not null").select("filename", "clip")
    n = usable.count()
    placed, coarse = with_cells(usable, seed=seed, fit_rows=fit_rows)
    dims = coarse.shape[1]
    ends = [dims * p // parts for p in range(parts + 1)]
    shared = spark.sparkContext.broadcast(coarse)  # cells times dimensions, the root of the number of items

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                rest = np.stack(batch["clip"]).astype(float) - shared.value[batch["cell"].to_numpy()]
                for p in range(parts):
                    yield pd.DataFrame({"part": p, "h": batch["h"], "x": list(rest[:, ends[p] : ends[p + 1]])})

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(pdf.sort_values("h")["x"]).astype(float)
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "book": [_centres(v, 1 << bits, seed).tolist()]})

    picked = placed.withColumn("h", F.xxhash64("filename", F.lit(seed + 1)))
    picked = picked.where(F.pmod("h", F.lit(max(1, -(-n // fit_rows)))) == 0)
    books = picked.select("cell", "clip", "h").mapInPandas(cut, "part int, h long, x array<double>").groupBy("part").applyInPandas(fitted, "part int, book array<array<double>>")
    quantiser = Quantiser(coarse, [np.array(r.book) for r in sorted(books.collect(), key=lambda r: r.part)])
    coder = spark.sparkContext.broadcast(quantiser)
    name = dict(items.dtypes)["filename"]

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                cell = batch["cell"].to_numpy()
                codes, error = coder.value.encode(np.stack(batch["clip"]).astype(float), cell)
                yield pd.DataFrame({"filename": batch["filename"], "cell": cell, "code": [c.tobytes() for c in codes], "error": np.nextafter(error.astype(np.float32), np.float32(np.inf))})

    return placed.select("filename", "cell", "clip").mapInPandas(code, f"filename {name}, cell int, code binary, error float"), quantiser


def search(queries: DataFrame, items: DataFrame, index: DataFrame, quantiser: Quantiser, k: int, probes: int = 10, slack: float | None = SLACK, chunk: int = CHUNK) -> DataFrame:
    """query_id, filename, rank_no, score: the ``k`` best items (filename, clip) for each query (query_id, clip).

    The ``probes`` nearest cells give each query ``4 * k`` estimates, whose exact scores set what has to be reached. Then every
    cell is asked whose centre and radius, and every item whose estimate and error, can reach it. That gives what ``search.nearest``
    gives over all items. With a ``slack`` the errors of items count less, fewer pairs stay open, and an item may be lost.
    Open pairs are scored where they are found, in blocks of several cells with their vectors, and the ``k`` best of a block are
    all that is sent on, so what is written grows with blocks and never with pairs. ``index`` and ``items`` should be tables.
    """
    shared = queries.sparkSession.sparkContext.broadcast(quantiser)
    asked = queries.select("query_id", "clip").dropna()
    id_type, name = dict(queries.dtypes)["query_id"], dict(index.dtypes)["filename"]
    dims = quantiser.coarse.shape[1]
    share = 1.0 if slack is None else min(1.0, slack / math.sqrt(dims))

    def reach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            codes = np.stack([np.frombuffer(c, np.uint8) for c in batch["code"]]) if len(batch) else np.zeros((0, len(quantiser.books)), np.uint8)
            rest = sum(np.square(book[c]).sum(axis=1) for book, c in zip(shared.value.books, codes.T, strict=True))
            yield pd.DataFrame({"cell": batch["cell"], "radius": np.sqrt(rest) + batch["error"].to_numpy(float)}).groupby("cell", as_index=False).max()

    radii = np.full(len(quantiser.coarse), -np.inf)
    for r in index.select("cell", "code", "error").mapInPandas(reach, "cell int, radius double").groupBy("cell").agg(F.max("radius").alias("radius")).collect():
        radii[r.cell] = r.radius

    groups = max(1, -(-index.count() // chunk))

    def opened(v: np.ndarray, least: np.ndarray, cells: np.ndarray | slice) -> np.ndarray:
        """Which cells (columns) can hold an item as good as asked for, by their centres and radii."""
        most = v @ shared.value.coarse[cells].T + np.linalg.norm(v, axis=1)[:, None] * radii[cells]
        return most + 10.0**-DIGITS >= least[:, None]

    def sent(every: bool):
        def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in few(batches, max(groups, len(radii)) if every else len(radii)):
                v, centres = np.stack(batch["clip"]).astype(float), shared.value.coarse
                if every:
                    open_ = opened(v, batch["least"].fillna(-np.inf).to_numpy(float), slice(None))
                    rows, to = np.nonzero(np.stack([open_[:, g::groups].any(axis=1) for g in range(groups)], axis=1))
                else:
                    near = np.argsort((centres**2).sum(axis=1) - 2 * v @ centres.T, axis=1, kind="stable")[:, :probes]
                    rows, to = np.repeat(np.arange(len(v)), near.shape[1]), near.ravel()
                yield pd.DataFrame({"query_id": batch["query_id"].to_numpy()[rows], "grp": to.astype(np.int32), "clip": batch["clip"].to_numpy()[rows], "least": batch["least"].to_numpy()[rows]})

        return task

    def coded(right: pd.DataFrame) -> np.ndarray:
        return np.stack([np.frombuffer(c, np.uint8) for c in right["code"]])

    def guessed_best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """The best estimates of a cell."""
        found = [pd.DataFrame({"query_id": [], "filename": [], "estimate": []})]
        if len(left) and len(right):
            right = right.sort_values("filename")
            codes = coded(right)
            for at in slabs(len(left), len(right)):
                some = left.iloc[at]
                guess = shared.value.estimate(np.stack(some["clip"]).astype(float), int(some["grp"].iloc[0]), codes)
                top = np.argsort(-guess, axis=1, kind="stable")[:, : 4 * k]
                rows, cols = np.repeat(np.arange(len(some)), top.shape[1]), top.ravel()
                found.append(pd.DataFrame({"query_id": some["query_id"].to_numpy()[rows], "filename": right["filename"].to_numpy()[cols], "estimate": guess[rows, cols]}))
        return pd.concat(found[1:] or found)

    def open_best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """The best exact scores among the pairs that cells and codes leave open."""
        found = [pd.DataFrame({"query_id": [], "filename": [], "score": []})]
        if len(left) and len(right):
            right = right.sort_values("filename").reset_index(drop=True)
            codes, cell, error = coded(right), right["cell"].to_numpy(), right["error"].to_numpy(float)
            vectors, names = np.stack(right["clip"]).astype(float), right["filename"].to_numpy()
            for at in slabs(len(left), len(right)):
                some = left.iloc[at]
                q, least = np.stack(some["clip"]).astype(float), some["least"].fillna(-np.inf).to_numpy(float)
                lengths, score = np.linalg.norm(q, axis=1)[:, None], np.full((len(some), len(right)), -np.inf)
                for c in np.unique(cell):
                    cols, rows = np.flatnonzero(cell == c), np.flatnonzero(opened(q, least, np.array([c]))[:, 0])
                    if len(rows):
                        most = shared.value.estimate(q[rows], int(c), codes[cols]) + share * lengths[rows] * error[cols]
                        left_open = most + 10.0**-DIGITS >= least[rows, None]
                        cols, left_open = cols[left_open.any(axis=0)], left_open[:, left_open.any(axis=0)]
                        score[np.ix_(rows, cols)] = np.where(left_open, np.round(q[rows] @ vectors[cols].T, DIGITS), -np.inf)
                top = np.argsort(-score, axis=1, kind="stable")[:, :k]
                rows, cols = np.repeat(np.arange(len(some)), top.shape[1]), top.ravel()
                kept = np.isfinite(score[rows, cols])
                rows, cols = rows[kept], cols[kept]
                found.append(pd.DataFrame({"query_id": some["query_id"].to_numpy()[rows], "filename": names[cols], "score": score[rows, cols]}))
        return pd.concat(found[1:] or found)

    def met(of: DataFrame, held: DataFrame, every: bool) -> DataFrame:
        to_groups = of.mapInPandas(sent(every), f"query_id {id_type}, grp int, clip array<float>, least double")
        q, i = _dealt(to_groups, held, chunk)
        number = "score" if every else "estimate"
        return q.groupBy("grp", "q", "i").cogroup(i.groupBy("grp", "q", "i")).applyInPandas(open_best if every else guessed_best, f"query_id {id_type}, filename {name}, {number} double")

    def scored(pairs: DataFrame) -> DataFrame:
        """Exact scores, rounded as ``search.nearest`` rounds them."""

        @F.pandas_udf("double")
        def product(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series(np.round(np.einsum("ij,ij->i", np.stack(a).astype(float), np.stack(b).astype(float)), DIGITS) if len(a) else [], dtype=float)

        both = pairs.join(asked.withColumnRenamed("clip", "_q"), "query_id").join(items.select("filename", F.col("clip").alias("_i")), "filename")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "filename"))
        return both.select("query_id", "filename", product("_q", "_i").alias("score")).withColumn("rank_no", rank).where(F.col("rank_no") <= k)

    guessed = met(asked.withColumn("least", F.lit(None).cast("double")), index.withColumn("grp", F.col("cell")), False)
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("estimate"), "filename"))
    first = scored(guessed.withColumn("_n", order).where(F.col("_n") <= 4 * k).select("query_id", "filename"))
    least = first.where(F.col("rank_no") == k).select("query_id", F.col("score").alias("least"))
    held = index.join(items.select("filename", "clip"), "filename").withColumn("grp", F.col("cell") % groups)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "filename"))
    best = met(asked.join(least, "query_id", "left"), held, True).withColumn("rank_no", rank).where(F.col("rank_no") <= k)
    return best.select("query_id", "filename", "rank_no", "score")
