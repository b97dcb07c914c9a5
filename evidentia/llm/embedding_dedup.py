"""Near-duplicate embeddings by cross-polytope hashing.

A vector is turned by three rounds of random signs and a fast Hadamard transform; its hash is the nearest of the
positive and negative axes. A table's code joins the hashes of ``FUNCTIONS`` rotations; besides its own bucket a vector
visits the buckets of the next nearest axes. Residents and visitors of a bucket meet in blocks of bounded size, where
cosines are computed in double precision. Equal vectors are one node with a count. A block sends on, for each vector,
how many links it found first there (a pair counts at the first table and bucket that it shares) and one link to the
smallest node it is connected with in the block: rows grow with the vectors in buckets, not with pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import SIDE, grouped, in_blocks
from .common import lean, only, shuffle_partitions, written
from .components import components

THRESHOLD = 0.98
TABLES, FUNCTIONS, PROBES, SEED = 4, 3, 4, 17


def hadamard(x: np.ndarray) -> np.ndarray:
    """Rows times the Hadamard matrix of their length (a power of two), unscaled."""
    x, step = x.copy(), 1
    while step < x.shape[1]:
        pairs = x.reshape(len(x), -1, 2, step)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), -1)
        step *= 2
    return x


def codes(vectors: np.ndarray, tables: int = TABLES, functions: int = FUNCTIONS, probes: int = PROBES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Own codes (rows, tables) and codes to visit (rows, tables, probes), nearest first."""
    rows, dims = vectors.shape
    width = max(2, 1 << (dims - 1).bit_length())
    unit = np.zeros((rows, width))
    unit[:, :dims] = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    rng, near = np.random.default_rng(seed), min(3, 2 * width)
    own, visit = np.empty((rows, tables), np.int64), np.empty((rows, tables, probes), np.int64)
    places = np.array(sorted(product(range(near), repeat=functions), key=lambda c: (sum(c), c)))
    for t in range(tables):
        axis, loss = [], []
        for _ in range(functions):
            turned = unit
            for _ in range(3):
                turned = hadamard(turned * rng.choice([-1.0, 1.0], width)) / np.sqrt(width)
            signed = np.concatenate([turned, -turned], axis=1)
            order = np.argsort(-signed, axis=1, kind="stable")[:, :near]
            value = np.take_along_axis(signed, order, 1)
            axis.append(order)
            loss.append((value[:, :1] - value) ** 2)
        code, cost = np.zeros((rows, len(places)), np.int64), np.zeros((rows, len(places)))
        for f in range(functions):
            code = code * 2 * width + axis[f][:, places[:, f]]
            cost += loss[f][:, places[:, f]]
        best = np.argsort(cost[:, 1:], axis=1, kind="stable")[:, :probes] + 1
        own[:, t], visit[:, t] = code[:, 0], np.take_along_axis(code, best, 1)
    return own, visit


def _first(t: int, code: int, own_a, own_b, visit_a, visit_b) -> np.ndarray:
    """Whether pairs of rows meet first at this table and bucket."""
    a_goes, b_goes = (visit_a == own_b[:, :, None]).any(2), (visit_b == own_a[:, :, None]).any(2)
    same = own_a == own_b
    meet = same | a_goes | b_goes
    earlier = meet[:, :t].any(1)
    bucket = np.where(same[:, t], own_a[:, t], np.where(a_goes[:, t] & b_goes[:, t], np.minimum(own_a[:, t], own_b[:, t]), np.where(a_goes[:, t], own_b[:, t], own_a[:, t])))
    return meet[:, t] & ~earlier & (bucket == code)


def _block(t: int, code: int, low: int, high: int, rows: list[tuple], dims: int, tables: int, probes: int, threshold: float) -> Iterator[tuple]:
    """(node, links first found here, smallest connected node) of a block's nodes that have links."""
    node, copies, part, resident = (np.array(c) for c in list(zip(*rows, strict=True))[:4])
    vectors = np.frombuffer(b"".join(r[4] for r in rows)).reshape(-1, dims)
    both = np.frombuffer(b"".join(r[5] for r in rows), np.int64).reshape(len(rows), tables, 1 + probes)
    own, visit = both[:, :, 0], both[:, :, 1:]
    cosine = vectors @ vectors.T
    pair = (cosine >= threshold) & (resident[:, None] | resident[None, :]) & (node[:, None] < node[None, :])
    if low != high:
        pair &= part[:, None] != part[None, :]
    a, b = np.nonzero(pair)
    if not len(a):
        return
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        i, j = find(i), find(j)
        if i != j:
            root[max(i, j, key=lambda x: node[x])] = min(i, j, key=lambda x: node[x])
    links = np.zeros(len(rows), np.int64)
    for at in range(0, len(a), 20_000):
        i, j = a[at : at + 20_000], b[at : at + 20_000]
        new = _first(t, code, own[i], own[j], visit[i], visit[j])
        np.add.at(links, i[new], copies[j[new]])
        np.add.at(links, j[new], copies[i[new]])
    for i in np.unique(np.concatenate([a, b])).tolist():
        yield int(node[i]), int(links[i]), int(node[find(i)])


def near_embeddings(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, tables: int = TABLES, functions: int = FUNCTIONS, probes: int = PROBES, side: int = SIDE, seed: int = SEED) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Vectors link only at equal, non-null labels and equal lengths. Null or empty vectors, zero vectors, those with null
    or non-finite components, and rows with a null id link with nothing: 0 links, their own component, kept. Rows that
    repeat an id are vectors each, with links of their own; a component's id is the smallest id among its rows. An empty
    table gives no rows. Other columns are not read.
    """
    rows = only(vectors, vec_id=id_col, vector=vector_col, label=label_col).select(F.col("vec_id").cast("long"), F.col("vector").cast("array<double>"), F.col("label").cast("string"))
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.forall("vector", number) & F.exists("vector", lambda x: x != 0), F.lit(False))
    good = rows.where(usable)
    # numbered as they are written: a node is a vector under a label, whatever ids its rows have
    distinct = good.groupBy("label", "vector").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    nodes = written(distinct.withColumn("node", F.monotonically_increasing_id()), "vectors")

    keys_out = pa.schema([("label", pa.string()), ("dims", pa.int32()), ("t", pa.int32()), ("code", pa.int64()), ("node", pa.int64()), ("resident", pa.bool_())])
    data_out = pa.schema([("node", pa.int64()), ("copies", pa.int64()), ("unit", pa.binary()), ("both", pa.binary())])

    def hashed(batches, give):
        for batch in batches:
            by_length: dict[int, list] = {}
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                by_length.setdefault(len(row[1]), []).append(row)
            for dims, part in by_length.items():
                x = np.array([r[1] for r in part])
                x /= np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                yield from give(dims, part, x, *codes(x, tables, functions, probes, seed))

    def keys(dims, part, x, own, visit):
        n, each = len(part), tables * (1 + probes)
        code = np.concatenate([own[:, :, None], visit], axis=2).reshape(-1)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array([r[0] for r in part], object), each), pa.string()), pa.array(np.full(n * each, dims, np.int32)), pa.array(np.tile(np.repeat(np.arange(tables, dtype=np.int32), 1 + probes), n)), pa.array(code), pa.array(np.repeat(np.array([r[2] for r in part], np.int64), each)), pa.array(np.tile(np.arange(1 + probes) == 0, n * tables))], schema=keys_out)

    def data(dims, part, x, own, visit):
        both = np.concatenate([own[:, :, None], visit], axis=2)
        yield pa.RecordBatch.from_arrays([pa.array([r[2] for r in part], pa.int64()), pa.array([r[3] for r in part], pa.int64()), pa.array([v.tobytes() for v in x], pa.binary()), pa.array([c.tobytes() for c in both], pa.binary())], schema=data_out)

    bucket = ["label", "dims", "t", "code"]
    hashable = nodes.select("label", "vector", "node", "copies")
    placed = hashable.mapInArrow(lean(lambda b: hashed(b, keys)), "label string, dims int, t int, code long, node long, resident boolean")
    blocks = in_blocks(placed, bucket, "node", side, F.bool_or("resident"))
    full = hashable.mapInArrow(lean(lambda b: hashed(b, data)), "node long, copies long, unit binary, both binary")
    block = [*bucket, "low", "high"]
    met = blocks.join(full, "node").select(*block, "node", "copies", "part", "resident", "unit", "both").repartition(shuffle_partitions(rows.sparkSession), *block).sortWithinPartitions(*block)
    out = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("near", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, dims, t, code, low, high), members in grouped(batches, len(block)):
            if found := list(_block(t, code, low, high, members, dims, tables, probes, threshold)):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], schema=out)

    found = written(met.mapInArrow(lean(compare), "node long, links long, near long"), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.where("near <> node").select(F.col("node").alias("a"), F.col("near").alias("b")))
    in_root = nodes.select("node", "first_id").join(roots, "node").groupBy("root").agg(F.min("first_id").alias("least_id"))
    named = roots.join(written(in_root, "components"), "root").select("node", "least_id")
    per_node = nodes.join(links, "node", "left").join(named, "node", "left").select("label", "vector", F.coalesce("least_id", "first_id").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    linked = good.join(per_node, ["label", "vector"]).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    return linked.unionByName(alone)


#: DuckDB SQL for ``op9_embedding_dedup``: every pair of a label.
ORACLE_SQL = f"""
with recursive v as (
    select vec_id, label, embedding::double[] as x, sqrt(list_dot_product(embedding::double[], embedding::double[])) as size from embeddings where label is not null and embedding is not null
),
pairs as (
    select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
    where a.size > 0 and b.size > 0 and isfinite(a.size) and isfinite(b.size) and list_dot_product(a.x, b.x) / (a.size * b.size) >= {THRESHOLD}
),
reach as (select vec_id as a, vec_id as b from embeddings union select reach.a, pairs.b from reach join pairs on reach.b = pairs.a)
select e.vec_id, (select count(*) from pairs where a = e.vec_id) as n_links, m.c as component_id, e.vec_id = m.c as kept
from embeddings e join (select a, min(b) as c from reach group by a) m on m.a = e.vec_id
"""
