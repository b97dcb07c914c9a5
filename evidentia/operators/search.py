"""Similarity search: top-k in blocks, two-stage ranking, routing, fallback, zero-shot labels and coarse cells.

Queries and items can both be large, so neither is broadcast or collected: both sides are dealt into chunks of bounded
size (of a category, where the search stays within one), every chunk of queries meets every chunk of items in a task,
which multiplies two small matrices and sends on the k best of each query. A window keeps the best of all chunks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot, percent
from ..sources.files import settled

#: Rows of a side of a block.
CHUNK = 4096
#: Numbers of a matrix that a task holds at a time: a block is multiplied in slabs of so many products.
SLAB = 1 << 20
#: Similarities are rounded to this many digits before they are ranked, so that ties do not hang on summation order.
DIGITS = 6
RECALL = 4
UNKNOWN = "unknown"
THRESHOLD = 0.018
MAX_TEMPLATES = 10_000


def _chunked(df: DataFrame, group: str, key: str, name: str, chunk: int) -> DataFrame:
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).select(F.col(group).alias("_g"), F.ceil(F.col("_n") / chunk).cast("int").alias(f"{name}_chunks"))
    joined = df.join(sizes, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")
    return joined.withColumn(name, F.pmod(F.xxhash64(key), f"{name}_chunks").cast("int"))


def _dealt(queries: DataFrame, items: DataFrame, chunk: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``q`` and ``i``, the numbers of the chunks that meet: of all rows, which are counted once, or within
    each ``grp`` where there is one."""
    if "grp" not in queries.columns:
        n_q, n_i = (max(1, -(-df.count() // chunk)) for df in (queries.select("query_id"), items.select("filename")))
        everyone = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        own = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
        return queries.withColumn("q", own("query_id", n_q)).withColumn("i", everyone(n_i)), items.withColumn("i", own("filename", n_i)).withColumn("q", everyone(n_q))
    q, i = _chunked(queries, "grp", "query_id", "q", chunk), _chunked(items, "grp", "filename", "i", chunk)
    i_chunks = i.groupBy("grp").agg(F.max("i_chunks").alias("_ic")).withColumnRenamed("grp", "_g")
    q_chunks = q.groupBy("grp").agg(F.max("q_chunks").alias("_qc")).withColumnRenamed("grp", "_g")
    q = q.join(i_chunks, F.col("grp").eqNullSafe(F.col("_g"))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("_ic") - 1))).drop("_g", "_ic", "q_chunks")
    return q, i.join(q_chunks, F.col("grp").eqNullSafe(F.col("_g"))).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("_qc") - 1))).drop("_g", "_qc", "i_chunks")


def slabs(rows: int, columns: int) -> list[slice]:
    """The rows of a matrix in pieces of at most ``SLAB`` numbers, one row at least."""
    step = max(1, SLAB // max(1, columns))
    return [slice(a, a + step) for a in range(0, rows, step)]


def nearest(queries: DataFrame, items: DataFrame, k: int, weights: dict[str, float], chunk: int = CHUNK) -> DataFrame:
    """The ``k`` best items for each query, of the same ``grp`` where both sides have that column.

    ``queries``: query_id and the vectors that ``weights`` names; ``items``: filename and the same vectors. Gives query_id,
    filename, score (the weighted sum of dot products), one column ``<vector>_sim`` for each, and rank_no; ties go to the
    smaller filename. Vectors that are null or of another length match nothing.
    """
    names = list(weights)
    sims = [f"{n}_sim" for n in names]
    grp = ["grp"] if "grp" in queries.columns and "grp" in items.columns else []
    q, i = _dealt(queries.select("query_id", *grp, *names).dropna(subset=["query_id", *names]), items.select("filename", *grp, *names).dropna(subset=["filename", *names]), chunk)
    block_of = [*grp, "q", "i"]
    id_type, file_type = dict(queries.dtypes)["query_id"], dict(items.dtypes)["filename"]

    def block(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        lengths = [list(zip(*[x[n].map(len) for n in names], strict=True)) for x in (left, right)]
        found = [pd.DataFrame({"query_id": [], "filename": [], "score": [], **{s: [] for s in sims}})]
        for size in set(lengths[0]) & set(lengths[1]):
            alike, items_ = [x[[y == size for y in own]] for x, own in zip((left, right), lengths, strict=True)]
            items_ = items_.sort_values("filename").reset_index(drop=True)
            vectors = [np.stack(items_[n]).astype(float).T for n in names]
            found += [best(alike.iloc[rows], items_, vectors) for rows in slabs(len(alike), len(items_))]
        return pd.concat(found[1:] or found)

    def best(left: pd.DataFrame, right: pd.DataFrame, vectors: list[np.ndarray]) -> pd.DataFrame:
        each = [np.round(np.stack(left[n]).astype(float) @ v, DIGITS) for n, v in zip(names, vectors, strict=True)]
        score = np.round(sum(w * s for w, s in zip(weights.values(), each, strict=True)), DIGITS)
        top = np.argsort(-score, axis=1, kind="stable")[:, :k]
        rows = np.repeat(np.arange(len(left)), top.shape[1])
        cols = top.ravel()
        return pd.DataFrame({"query_id": left["query_id"].to_numpy()[rows], "filename": right["filename"].to_numpy()[cols], "score": score[rows, cols], **{s: e[rows, cols] for s, e in zip(sims, each, strict=True)}})

    schema = f"query_id {id_type}, filename {file_type}, score double, " + ", ".join(f"{s} double" for s in sims)
    found = q.groupBy(*block_of).cogroup(i.groupBy(*block_of)).applyInPandas(block, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "filename"))
    return found.withColumn("rank_no", rank).where(F.col("rank_no") <= k)


def reranked(recalled: DataFrame, items: DataFrame, k: int, clip: float = 0.5, visual: float = 0.5) -> DataFrame:
    """Recall (query_id, filename, clip_sim, visual_sim) -> the ``k`` best by the weighted sum, one of each source.

    A hit is named after its source file where it has one.
    """
    known = items.select("filename", "source_file", "category")
    fused = recalled.select("query_id", "filename", "clip_sim", "visual_sim").join(known, "filename").withColumn("score", F.round(clip * F.col("clip_sim") + visual * F.col("visual_sim"), DIGITS)).withColumn("name", F.coalesce("source_file", "filename"))
    best = F.row_number().over(Window.partitionBy("query_id", "name").orderBy(F.desc("score"), "filename"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "name"))
    one = fused.withColumn("_n", best).where("_n = 1").withColumn("rank_no", rank).where(F.col("rank_no") <= k)
    return one.select("query_id", "rank_no", F.col("name").alias("filename"), "score", "clip_sim", "visual_sim", "category", percent(F.col("score")).alias("match_confidence"))


def hybrid(queries: DataFrame, items: DataFrame, k: int, clip: float = 0.5, visual: float = 0.5) -> DataFrame:
    """Within the query's category: ``RECALL * k`` by the first vector, then ``reranked``. The second vector's
    similarity is computed for recalled items only."""
    recalled = nearest(queries.withColumn("grp", F.col("category")), items.withColumn("grp", F.col("category")), RECALL * k, {"clip": 1.0})
    pairs = recalled.select("query_id", "filename", "clip_sim").join(queries.select("query_id", F.col("visual").alias("_q")), "query_id").join(items.select("filename", "visual"), "filename")
    return reranked(pairs.withColumn("visual_sim", F.round(dot(F.col("_q"), F.col("visual")), DIGITS)), items, k, clip, visual)


def from_index(queries: DataFrame, index: DataFrame, k: int, clip: float = 0.5, visual: float = 0.5) -> DataFrame:
    """``hybrid`` over a saved index that is partitioned by category: its folders are chosen while the query runs, by the
    categories that the queries ask for, and no other is read. Queries without a category find nothing."""
    asked = settled(queries, "asked").where("category is not null")
    wanted = asked.groupBy("category").agg(F.count(F.lit(1)).alias("_n")).where("_n > 0").select("category")
    return hybrid(asked, index.join(wanted, "category", "left_semi"), k, clip, visual)


def everywhere(queries: DataFrame, items: DataFrame, k: int, reason: str | None = None) -> DataFrame:
    """The ``k`` best of all categories by the first vector, then one of each source: possibly fewer than ``k``."""
    found = nearest(queries.drop("grp"), items.drop("grp"), k, {"clip": 1.0})
    named = found.join(items.select("filename", "source_file", "category"), "filename").withColumn("name", F.coalesce("source_file", "filename"))
    best = F.row_number().over(Window.partitionBy("query_id", "name").orderBy("rank_no"))
    one = named.withColumn("_n", best).where("_n = 1").withColumn("rank_no", F.row_number().over(Window.partitionBy("query_id").orderBy("rank_no")))
    return one.select("query_id", "rank_no", F.col("name").alias("filename"), "score", "clip_sim", F.lit(None).cast("double").alias("visual_sim"), "category", percent(F.col("score")).alias("match_confidence"), F.lit(reason).cast("string").alias("reason"))


def routed(queries: DataFrame, items: DataFrame, k: int, clip: float = 0.5, visual: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Hits and statuses of queries (query_id, clip, visual, user_category, predicted, confidence).

    The user's category wins over the predicted one; if it is not in stock there are no hits. A predicted category in
    stock is searched; one that is absent, or an unknown one without items of its own, is searched everywhere.
    """
    stock = items.select(F.col("category").alias("_stock")).distinct()
    user = F.nullif(F.lower(F.trim("user_category")), F.lit(""))
    named = queries.withColumn("by_user", user.isNotNull()).withColumn("category", F.coalesce(user, "predicted")).join(stock, F.col("category") == F.col("_stock"), "left")
    there = F.col("_stock").isNotNull()
    way = F.when(there, "category").when(F.col("by_user"), "none").otherwise("everywhere")
    # a row for each query, read by both branches and the status
    sent = settled(named.withColumn("way", way), "queries")
    status = F.when(F.col("way") == "none", "no_matches").when(~F.col("by_user") & (F.col("predicted") == UNKNOWN), "needs_confirmation").otherwise("success")
    near = hybrid(sent.where("way = 'category'"), items, k, clip, visual).withColumn("reason", F.lit(None).cast("string"))
    far = everywhere(sent.where("way = 'everywhere'"), items, k, "smart_fallback_clip")
    return near.unionByName(far), sent.select("query_id", status.alias("status"), F.col("category").alias("category_used"), "confidence", "way")


def zero_shot(queries: DataFrame, templates: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """query_id, label, confidence: softmax over all templates' dot products, the best template's label; below the
    threshold the label is ``unknown``. ``templates`` (label, template, embedding) is a vocabulary, written by hand and
    so bounded (``MAX_TEMPLATES``; more is an error); it goes along as one literal block."""
    words = templates.select("label", "template", "embedding").dropna().orderBy("template").take(MAX_TEMPLATES + 1)
    if len(words) > MAX_TEMPLATES:
        raise ValueError(f"a vocabulary of more than {MAX_TEMPLATES} templates")
    labels = np.array([w.label for w in words])
    table = np.array([w.embedding for w in words], float)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[batch["clip"].map(lambda v: v is not None and len(v) == table.shape[1])]
            if len(batch):
                sims = np.round(np.stack(batch["clip"]).astype(float) @ table.T, DIGITS)
                best = sims.argmax(axis=1)
                share = 1 / np.exp(sims - sims.max(axis=1, keepdims=True)).sum(axis=1)
                yield pd.DataFrame({"query_id": batch["query_id"], "label": np.where(share < threshold, UNKNOWN, labels[best]), "confidence": share})

    return queries.select("query_id", "clip").mapInPandas(task, f"query_id {dict(queries.dtypes)['query_id']}, label string, confidence double")


def rank_fusion(rankings: list[DataFrame], k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of rankings (query_id, filename, rank_no): query_id, filename, score."""
    every = rankings[0].select("query_id", "filename", "rank_no")
    for r in rankings[1:]:
        every = every.unionByName(r.select("query_id", "filename", "rank_no"))
    return every.groupBy("query_id", "filename").agg(F.round(F.sum(1.0 / (k + F.col("rank_no"))), 8).alias("score"))


def few(batches: Iterator[pd.DataFrame], each: int, most: int = 1 << 16) -> Iterator[pd.DataFrame]:
    """Batches cut so that no piece makes more than ``most`` rows, where a row may make ``each``."""
    step = max(1, most // max(1, each))
    for batch in batches:
        for start in range(0, len(batch), step):
            yield batch.iloc[start : start + step]


def with_cells(items: DataFrame, most: int | None = None, seed: int = 3, fit_rows: int = 100_000) -> tuple[DataFrame, np.ndarray]:
    """Items with the coarse cell that each vector is nearest to, and the cells' centres: k-means fitted on at most
    ``fit_rows`` items, all items assigned. There are as many cells as the root of the number of items, or ``most``."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    usable = items.where("clip is not null")
    n = usable.count()
    fit = usable if n <= fit_rows else usable.orderBy(F.xxhash64("filename", F.lit(seed))).limit(fit_rows)
    model = KMeans(k=max(2, min(most or math.isqrt(n), n // 39)), seed=seed, featuresCol="_v").fit(fit.select(array_to_vector(F.col("clip").cast("array<double>")).alias("_v")))
    placed = model.transform(usable.withColumn("_v", array_to_vector(F.col("clip").cast("array<double>")))).withColumnRenamed("prediction", "cell").drop("_v")
    return placed, np.array(model.clusterCenters())


def probed(queries: DataFrame, placed: DataFrame, centres: np.ndarray, k: int, probes: int = 10) -> DataFrame:
    """The ``k`` best items, as ``nearest`` over all of them finds: first those in the ``probes`` cells whose centres are
    nearest to the query, then those in every further cell that can still hold an item as good as the last of these.

    An item's product with the query is at most that of its cell's centre and the query's norm times the cell's radius.
    """
    id_type = dict(queries.dtypes)["query_id"]

    def reach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            far = np.linalg.norm(np.stack(batch["clip"]).astype(float) - centres[batch["cell"].to_numpy()], axis=1)
            yield pd.DataFrame({"cell": batch["cell"], "radius": far}).groupby("cell", as_index=False).max()

    def order(v: np.ndarray) -> np.ndarray:
        return np.argsort((centres**2).sum(axis=1) - 2 * v @ centres.T, axis=1, kind="stable")

    def asking(batch: pd.DataFrame, rows: np.ndarray, cells: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"query_id": batch["query_id"].to_numpy()[rows], "grp": cells.astype(np.int32), "clip": batch["clip"].to_numpy()[rows]})

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in few(batches, len(centres)):
            near = order(np.stack(batch["clip"]).astype(float))[:, :probes]
            yield asking(batch, np.repeat(np.arange(len(batch)), near.shape[1]), near.ravel())

    def further(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in few(batches, len(centres)):
            v = np.stack(batch["clip"]).astype(float)
            most = v @ centres.T + np.linalg.norm(v, axis=1)[:, None] * radii
            open_ = most + 10.0**-DIGITS >= batch["least"].fillna(-np.inf).to_numpy(float)[:, None]
            np.put_along_axis(open_, order(v)[:, :probes], False, axis=1)
            yield asking(batch, *np.nonzero(open_))

    radii = np.full(len(centres), -np.inf)
    for r in placed.select("cell", "clip").mapInPandas(reach, "cell int, radius double").groupBy("cell").agg(F.max("radius").alias("radius")).collect():
        radii[r.cell] = r.radius
    schema, asked, items = f"query_id {id_type}, grp int, clip array<float>", queries.select("query_id", "clip").dropna(), placed.withColumn("grp", F.col("cell"))
    first = nearest(asked.mapInPandas(cells, schema), items, k, {"clip": 1.0})
    last = first.where(F.col("rank_no") == k).select("query_id", F.col("score").alias("least"))
    more = nearest(asked.join(last, "query_id", "left").mapInPandas(further, schema), items, k, {"clip": 1.0})
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "filename"))
    return first.unionByName(more).withColumn("rank_no", rank).where(F.col("rank_no") <= k)


def good_matches(descriptors: DataFrame, against: DataFrame, share: float = 0.7, chunk: int = 4 * CHUNK, k: int | None = None) -> DataFrame:
    """Lowe's ratio test: for descriptors (query_id, descriptor, clip) and images (image, descriptor, clip) how many of a
    query's descriptors have a nearest neighbour in the image closer than ``share`` of the second nearest. With ``k`` only the
    images with most good matches of each query, ties to the smaller image.

    Both sides come in blocks of about ``chunk`` descriptors, whole queries and images together unless one alone has more, and
    every block meets every other in a task, which counts slab by slab and with ``k`` sends on the best images of its whole
    queries only. The two best of a descriptor are brought together first where an image is in several parts. An image of one
    descriptor has no good match. Vectors are of unit length.
    """

    def parted(df: DataFrame, key: str, mine: str) -> tuple[DataFrame, int]:
        of = df.where("clip is not null")
        sizes = of.groupBy(F.col(key).alias("_key")).agg(F.ceil(F.count(F.lit(1)) / chunk).alias(f"{key}_parts"))
        blocks = max(1, -(-of.count() // chunk))
        part = F.pmod(F.xxhash64("descriptor" if "descriptor" in df.columns else "clip"), F.col(f"{key}_parts"))
        return of.join(sizes, F.col(key).eqNullSafe(F.col("_key"))).drop("_key").withColumn(mine, F.pmod(F.xxhash64(key, part), F.lit(blocks)).cast("int")), blocks

    types = dict(descriptors.dtypes), dict(against.dtypes)
    (asked, n_q), (images, n_i) = parted(descriptors, "query_id", "q"), parted(against, "image", "i")
    everyone = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked, images = asked.withColumn("i", everyone(n_i)), images.select("image", "clip", "image_parts", "i").withColumn("q", everyone(n_q))
    names = ["query_id", "image", "descriptor", "good", "best"]

    def numbered(keys: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        """The number of each row's key among the different keys in order, null first; and these."""
        codes, different = pd.factorize(keys, sort=True)
        if (codes < 0).any():
            return codes + 1, np.array([None, *different], dtype=object)
        return codes, np.asarray(different)

    def block(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({n: [] for n in names}, dtype=object)]
        for several in (False, True):
            held = right[(right["image_parts"] > 1) == several]
            if not len(left) or not len(held):
                continue
            image, image_keys = numbered(held["image"])
            order = np.argsort(image, kind="stable")
            vectors, sizes = np.stack(held["clip"].to_numpy()[order]).astype(float), np.bincount(image)
            starts = np.cumsum(sizes) - sizes
            # the first descriptor of each image, then the second of those that have one and so on, large images first
            larger = np.argsort(-sizes, kind="stable")
            slots = [starts[larger[: np.count_nonzero(sizes > n)]] + n for n in range(sizes.max())]
            columns, back = vectors[np.concatenate(slots)].T, np.argsort(larger)
            rough, longest = np.ascontiguousarray(columns, np.float32), float(np.sqrt(np.square(vectors).sum(axis=1).max()))
            query, query_keys = numbered(left["query_id"])
            counts = np.zeros((0, 0) if several else (len(query_keys), len(sizes)), np.int32)
            for rows in slabs(len(left), len(held)):
                asked_ = np.stack(left["clip"].iloc[rows])
                if several:
                    first, second = (np.round(x, DIGITS)[:, back] for x in _two_best(asked_.astype(float) @ columns, slots))
                    n, m = first.shape
                    pairs = np.stack([first, second], axis=2).reshape(-1, 2)
                    found.append(pd.DataFrame({"query_id": left["query_id"].iloc[rows].repeat(m), "image": np.tile(image_keys, n), "descriptor": left["descriptor"].iloc[rows].repeat(m), "good": None, "best": [p[np.isfinite(p)] for p in pairs]}))
                else:
                    np.add.at(counts, query[rows], _good(asked_, rough, slots, vectors, longest, starts[larger], sizes[larger], share)[:, back])
            if not several:
                whole = np.zeros(len(query_keys), bool)
                whole[query] = left["query_id_parts"].to_numpy() == 1
                for at in slabs(len(query_keys), len(sizes)):
                    top = np.argsort(-counts[at], axis=1, kind="stable")
                    keep = np.ones(top.shape, bool)
                    if k is not None:
                        keep[whole[at], k:] = False
                    row, place = np.nonzero(keep)
                    col = top[row, place]
                    found.append(pd.DataFrame({"query_id": query_keys[at][row], "image": image_keys[col], "descriptor": None, "good": counts[at][row, col], "best": None}))
        return pd.concat(found[1:] or found)

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good = []
            for b in batch["best"]:
                two = -np.sort(-np.asarray(b, float))[:2]
                good.append(int(len(two) == 2 and _closer(two[0], two[1], share)))
            yield pd.DataFrame({"query_id": batch["query_id"], "image": batch["image"], "good": good})

    ids = f"query_id {types[0]['query_id']}, image {types[1]['image']}"
    counted = asked.groupBy("q", "i").cogroup(images.groupBy("q", "i")).applyInPandas(block, f"{ids}, descriptor {types[0]['descriptor']}, good long, best array<double>")
    # read twice, counted once
    counted = settled(counted, "counted")
    several = counted.where("best is not null").groupBy("query_id", "image", "descriptor").agg(F.flatten(F.collect_list("best")).alias("best")).select("query_id", "image", "best")
    every = counted.where("best is null").select("query_id", "image", "good").unionByName(several.mapInPandas(settle, f"{ids}, good long"))
    summed = every.groupBy("query_id", "image").agg(F.sum("good").alias("good"))
    if k is None:
        return summed
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("good"), "image"))
    return summed.withColumn("rank_no", rank).where(F.col("rank_no") <= k)


def _two_best(sims: np.ndarray, slots: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The two greatest of each image, for each row; minus infinity for the second of a single one. Columns come slot by slot,
    and the images of a slot are the first ones of the slot before."""
    at = len(slots[0])
    first = sims[:, :at].copy()
    second = np.full_like(first, -np.inf)
    for n in map(len, slots[1:]):
        x, a, b = sims[:, at : at + n], first[:, :n], second[:, :n]
        np.maximum(b, np.minimum(a, x), out=b)
        np.maximum(a, x, out=a)
        at += n
    return first, second


def _good(asked: np.ndarray, rough: np.ndarray, slots: list[np.ndarray], vectors: np.ndarray, longest: float, starts: np.ndarray, sizes: np.ndarray, share: float) -> np.ndarray:
    """``_closer`` for each row and image. Products in single precision decide where their error leaves no doubt, the others
    are reckoned again in double precision."""
    first, second = _two_best(asked.astype(np.float32) @ rough, slots)
    product = longest * np.sqrt(np.square(asked, dtype=float).sum(axis=1).max())
    error = np.float32((vectors.shape[1] + 4) * 2.0**-23 * product + 2 * 10.0**-DIGITS)
    near, next_ = 1 - first, np.float32(share**2) * (1 - second)
    several = np.isfinite(second)
    good = several & (near + 2 * error < next_)
    for row, image in zip(*np.nonzero(several & ~good & (near - 2 * error < next_)), strict=True):
        own = vectors[starts[image] : starts[image] + sizes[image]]
        two = np.sort(np.round(own @ asked[row].astype(float), DIGITS))[-2:]
        good[row, image] = _closer(two[1], two[0], share)
    return good


def _closer(first: np.ndarray, second: np.ndarray, share: float) -> np.ndarray:
    """Whether the first of two best similarities is closer than ``share`` of the second's distance; not without a second."""
    near, next_ = (np.sqrt(np.maximum(0, 2 - 2 * x)) for x in (first, second))
    return np.isfinite(second) & (near < share * next_)


def category_cells(items: DataFrame, most: int = 100, flat_below: int = 100, fit_rows: int = 10_000, rounds: int = 10, seed: int = 3) -> DataFrame:
    """category, centres: the coarse cells of each category, as many as half its items, ``most`` at most. A category
    of fewer than ``flat_below`` items has one cell. Centres are fitted on at most ``fit_rows`` items of the category that a
    hash picks."""
    usable = items.where("clip is not null").select("category", "filename", "clip")
    pick = F.row_number().over(Window.partitionBy("category").orderBy(F.xxhash64("filename", F.lit(seed)), "filename"))
    sizes = usable.groupBy(F.col("category").alias("_c")).agg(F.count(F.lit(1)).alias("n"))
    fit = usable.withColumn("_n", pick).where(F.col("_n") <= fit_rows).join(sizes, F.col("category").eqNullSafe(F.col("_c"))).drop("_c", "_n")

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("filename")
        pdf = pdf[pdf["clip"].map(len) == pdf["clip"].map(len).mode().iloc[0]]
        v, n = np.stack(pdf["clip"]).astype(float), int(pdf["n"].iloc[0])
        cells = 1 if n < flat_below else max(1, min(most, n // 2, len(v)))
        centres = v[np.random.default_rng(seed).choice(len(v), cells, replace=False)]
        for _ in range(rounds if cells > 1 else 1):
            own = _nearest_cell(v, centres)
            for c in np.unique(own):
                centres[c] = v[own == c].mean(axis=0)
        return pd.DataFrame({"category": pdf["category"].iloc[:1], "centres": [centres.tolist()]})

    kind = dict(items.dtypes)["category"]
    return fit.groupBy("category").applyInPandas(fitted, f"category {kind}, centres array<array<double>>")


def _nearest_cell(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * v @ centres.T).argmin(axis=1)


def probed_by_category(queries: DataFrame, items: DataFrame, cells: DataFrame, k: int, probes: int = 10) -> DataFrame:
    """The ``k`` best items of a query's category, as an exact search finds: those of the ``probes`` cells nearest to the
    query, then those of every further cell that can still hold an item as good as the last of these (see ``probed``)."""

    def with_centres(df: DataFrame) -> DataFrame:
        named = cells.select(F.col("category").alias("_c"), "centres")
        return df.join(named, F.col("category").eqNullSafe(F.col("_c"))).where(F.size("clip") == F.size(F.col("centres")[0])).drop("_c")

    file_type, id_type, kind = dict(items.dtypes)["filename"], dict(queries.dtypes)["query_id"], dict(items.dtypes)["category"]

    def by_category(batches: Iterator[pd.DataFrame]):
        # rows carry their category's centres, 100 at most unless the caller allows more
        for batch in few(batches, 100):
            for _, part in batch.groupby(batch["category"].fillna("\0"), sort=False):
                yield part, np.stack([np.asarray(c, float) for c in part["centres"].iloc[0]]), np.stack(part["clip"]).astype(float)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, centres, v in by_category(batches):
            own = _nearest_cell(v, centres)
            yield pd.DataFrame({"filename": part["filename"], "category": part["category"], "cell": own.astype(np.int32), "clip": part["clip"], "far": np.linalg.norm(v - centres[own], axis=1)})

    placed = with_centres(items.where("clip is not null").select("filename", "category", "clip")).mapInPandas(place, f"filename {file_type}, category {kind}, cell int, clip array<float>, far double")
    group = lambda cell: F.concat_ws("#", F.coalesce("category", F.lit("")), F.col(cell).cast("string"))
    held = placed.select("filename", "clip", group("cell").alias("grp"))
    radii = placed.groupBy("category", "cell").agg(F.max("far").alias("far")).groupBy("category").agg(F.map_from_entries(F.collect_list(F.struct("cell", "far"))).alias("radii"))
    asked = with_centres(queries.select("query_id", "category", "clip").dropna(subset=["query_id", "clip"]))

    def order(centres: np.ndarray, v: np.ndarray) -> np.ndarray:
        return np.argsort((centres**2).sum(axis=1) - 2 * v @ centres.T, axis=1, kind="stable")

    def asking(part: pd.DataFrame, rows: np.ndarray, cell: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"query_id": part["query_id"].to_numpy()[rows], "category": part["category"].to_numpy()[rows], "cell": cell.astype(np.int32), "clip": part["clip"].to_numpy()[rows]})

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, centres, v in by_category(batches):
            cell = order(centres, v)[:, :probes]
            yield asking(part, np.repeat(np.arange(len(part)), cell.shape[1]), cell.ravel())

    def further(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, centres, v in by_category(batches):
            radius = np.full(len(centres), -np.inf)
            for cell, far in part["radii"].iloc[0].items():
                radius[cell] = far
            open_ = v @ centres.T + np.linalg.norm(v, axis=1)[:, None] * radius + 10.0**-DIGITS >= part["least"].fillna(-np.inf).to_numpy(float)[:, None]
            np.put_along_axis(open_, order(centres, v)[:, :probes], False, axis=1)
            yield asking(part, *np.nonzero(open_))

    schema = f"query_id {id_type}, category {kind}, cell int, clip array<float>"
    sent = lambda df: df.select("query_id", "clip", group("cell").alias("grp"))
    first = nearest(sent(asked.mapInPandas(near, schema)), held, k, {"clip": 1.0})
    last = first.where(F.col("rank_no") == k).select("query_id", F.col("score").alias("least"))
    known = asked.join(radii.withColumnRenamed("category", "_c"), F.col("category").eqNullSafe(F.col("_c"))).drop("_c").join(last, "query_id", "left")
    more = nearest(sent(known.mapInPandas(further, schema)), held, k, {"clip": 1.0})
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "filename"))
    return first.unionByName(more).withColumn("rank_no", rank).where(F.col("rank_no") <= k)
