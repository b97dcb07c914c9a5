"""Product quantisation: codes, error bounds, and searches against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.operators import pq, search


def _items(n, dims=24, seed=0, spread=0.25):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(8, dims))[rng.integers(8, size=n)] + spread * rng.normal(size=(n, dims))
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


@pytest.fixture(scope="module")
def built(spark):
    v = _items(1200)
    rows = [(f"f{i:05d}", [float(x) for x in v[i]]) for i in range(len(v))]
    items = spark.createDataFrame([*rows, ("none", None)], "filename string, clip array<float>").cache()
    index, quantiser = pq.build(items, parts=6)
    return v, items, index.cache(), quantiser


def test_every_item_is_coded_within_its_error(built):
    v, _, index, quantiser = built
    got = index.collect()
    assert len(got) == len(v) and len(quantiser.coarse) == 30
    for r in got:
        made = quantiser.coarse[r.cell] + np.concatenate([book[c] for book, c in zip(quantiser.books, r.code, strict=True)])
        assert np.linalg.norm(v[int(r.filename[1:])].astype(float) - made) <= r.error
        assert len(r.code) == 6
    one = quantiser.estimate(v[:3].astype(float), got[0].cell, np.array([list(got[0].code)], np.uint8))
    made = quantiser.coarse[got[0].cell] + np.concatenate([book[c] for book, c in zip(quantiser.books, got[0].code, strict=True)])
    assert np.allclose(one[:, 0], v[:3].astype(float) @ made)


def test_search_is_that_of_all_pairs_and_slack_loses_little(spark, built):
    v, items, index, quantiser = built
    queries = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(0, 1200, 20)], "query_id long, clip array<float>")
    want = {(r.query_id, r.filename, r.rank_no, r.score) for r in search.nearest(queries, items, 5, {"clip": 1.0}).collect()}
    for chunk in (4096, 17):
        got = {(r.query_id, r.filename, r.rank_no, r.score) for r in pq.search(queries, items, index, quantiser, 5, probes=2, chunk=chunk).collect()}
        assert got == want and len(got) == 300
    near = {(r.query_id, r.filename) for r in pq.search(queries, items, index, quantiser, 5, slack=3.0).collect()}
    assert len(near & {w[:2] for w in want}) / len(want) >= 0.95


def test_more_wanted_than_there_is(spark):
    v = _items(90, dims=7)
    items = spark.createDataFrame([(f"f{i}", [float(x) for x in v[i]]) for i in range(90)] + [("f0b", [float(x) for x in v[0]])], "filename string, clip array<float>")
    index, quantiser = pq.build(items, parts=3)
    queries = spark.createDataFrame([(1, [float(x) for x in v[0]]), (2, None)], "query_id long, clip array<float>")
    got = [r.filename for r in pq.search(queries, items, index, quantiser, 200).orderBy("rank_no").collect()]
    assert len(got) == 91 and got[:2] == ["f0", "f0b"]


def test_no_cross_product_in_a_global_search(spark, built):
    _, items, _, _ = built
    queries = items.limit(5).selectExpr("filename as query_id", "clip")
    plan = search.nearest(queries, items, 5, {"clip": 1.0})._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_a_saved_index_is_read_where_it_is_asked_for(spark, tmp_path):
    """Folders of other categories may even be broken: they are not opened."""
    import glob

    from evidentia.sources.files import load_index, save_index

    v = _items(200)
    rows = [(f"f{i}", f"s{i // 2}", f"cat{i % 5}", [float(x) for x in v[i]], [float(x) for x in v[i][::-1]]) for i in range(200)]
    path = str(tmp_path / "index")
    items = spark.createDataFrame(rows, "filename string, source_file string, category string, clip array<float>, visual array<float>")
    save_index(items, path)
    index = load_index(spark, path)
    queries = spark.createDataFrame([(i, rows[i][3], rows[i][4], c) for i, c in ((1, "cat1"), (6, "cat1"), (3, "cat3"), (4, None), (5, "cat99"))], "query_id long, clip array<float>, visual array<float>, category string")
    want = sorted(map(tuple, search.hybrid(queries.where("category is not null"), items, 4).collect()))
    for other in ("cat0", "cat2", "cat4"):
        for f in glob.glob(f"{path}/category={other}/*.parquet"):
            with open(f, "wb") as out:
                out.write(b"broken")
    found = search.from_index(queries, index, 4)
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == want and len(want) == 12


def test_open_pairs_are_scored_where_they_are_found(spark):
    """What the bounds leave open is nearly all of a table without structure: it is never sent on as pairs."""
    rows = [(f"f{i:03d}", v.tolist()) for i, v in enumerate(np.random.default_rng(9).normal(size=(200, 16)))]
    items = spark.createDataFrame(rows, "filename string, clip array<double>").cache()
    queries = items.limit(10).select(F.col("filename").alias("query_id"), "clip")
    index, quantiser = pq.build(items)
    found = pq.search(queries, items, index.cache(), quantiser, 5, chunk=32)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString().split("FlatMapCoGroupsInPandas")[0]
    assert found.count() == 50
