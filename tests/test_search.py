import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from evidentia.operators import catalog, evaluate, search

RNG = np.random.default_rng(9)


def _vectors(n, dims=8):
    v = RNG.normal(size=(n, dims)).astype(np.float32)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def items(spark):
    clip, visual = _vectors(300), _vectors(300)
    rows = [(f"f{i:03d}", f"s{i // 3}", f"cat{i % 4}", clip[i].tolist(), visual[i].tolist()) for i in range(300)]
    return spark.createDataFrame(rows, "filename string, source_file string, category string, clip array<float>, visual array<float>").cache(), clip, visual


def _queries(spark, clip, visual, n=30):
    return spark.createDataFrame([(i, clip[i].tolist(), visual[i].tolist(), f"cat{i % 4}") for i in range(n)], "query_id long, clip array<float>, visual array<float>, category string")


@pytest.mark.parametrize("chunk", [7, 4096])
def test_blocks_find_what_brute_force_finds(spark, items, chunk):
    table, clip, visual = items
    q = _queries(spark, clip, visual)
    for grp in ("*", None):
        named = [x.withColumn("grp", F.lit("*") if grp else F.col("category")) for x in (q, table)]
        got = search.nearest(*named, 5, {"clip": 0.4, "visual": 0.6}, chunk).orderBy("query_id", "rank_no").collect()
        for i in range(30):
            score = np.round(0.4 * np.round(clip.astype(float) @ clip[i].astype(float), 6) + 0.6 * np.round(visual.astype(float) @ visual[i].astype(float), 6), 6)
            order = [j for j in sorted(range(300), key=lambda j: (-score[j], f"f{j:03d}")) if grp or j % 4 == i % 4][:5]
            assert [(r.filename, r.score) for r in got if r.query_id == i] == [(f"f{j:03d}", pytest.approx(score[j])) for j in order]


def test_own_vector_is_first_and_sources_appear_once(spark, items):
    table, clip, visual = items
    hits = search.hybrid(_queries(spark, clip, visual), table, 4)
    rows = hits.collect()
    assert all(r.filename == f"s{r.query_id // 3}" for r in rows if r.rank_no == 1)
    assert len({(r.query_id, r.filename) for r in rows}) == len(rows) and all(r.match_confidence == int(r.score * 100) for r in rows)
    more = table.unionByName(table.limit(50).withColumn("category", F.lit("elsewhere")).withColumn("filename", F.concat(F.lit("x"), "filename")))
    assert sorted(map(tuple, search.hybrid(_queries(spark, clip, visual), more.repartition(5), 4).collect())) == sorted(map(tuple, rows))


def test_routes(spark, items):
    table, clip, visual = items
    cases = [(" CAT1 ", "cat0", "category", "success"), ("kimono", "cat0", "none", "no_matches"), (None, "cat2", "category", "success"), (None, "unknown", "everywhere", "needs_confirmation"), ("  ", "cat99", "everywhere", "success")]
    q = spark.createDataFrame([(i, clip[i].tolist(), visual[i].tolist(), u, p, 0.5) for i, (u, p, *_) in enumerate(cases)], "query_id long, clip array<float>, visual array<float>, user_category string, predicted string, confidence double")
    hits, status = search.routed(q, table, 3)
    assert [(r.way, r.status) for r in status.orderBy("query_id").collect()] == [c[2:] for c in cases]
    found = hits.collect()
    assert {r.query_id for r in found} == {0, 2, 3, 4} and {r.category for r in found if r.query_id == 0} == {"cat1"}
    assert {r.reason for r in found if r.query_id in (3, 4)} == {"smart_fallback_clip"} and all(r.visual_sim is None for r in found if r.query_id in (3, 4))
    # a bucket of unknown items is an ordinary category
    stocked = table.withColumn("category", F.when(F.col("filename") < "f050", "unknown").otherwise(F.col("category")))
    assert search.routed(q, stocked, 3)[1].where("query_id = 3").first().way == "category"


def test_zero_shot_fusion_cells_and_ratio(spark, items):
    table, clip, visual = items
    words = spark.createDataFrame([(f"l{i // 2}", f"t{i}", clip[i].tolist()) for i in range(6)], "label string, template string, embedding array<float>")
    q = _queries(spark, clip, visual)
    for r in search.zero_shot(q, words, 0.25).collect():
        e = np.exp(clip[:6].astype(float) @ clip[r.query_id].astype(float))
        assert r.confidence == pytest.approx(e.max() / e.sum(), abs=1e-5)
        assert r.label == (f"l{e.argmax() // 2}" if r.confidence >= 0.25 else "unknown")
    ranks = [spark.createDataFrame(x, "query_id long, filename string, rank_no int") for x in ([(1, "a", 1), (1, "b", 2)], [(1, "b", 1)])]
    assert {r.filename: r.score for r in search.rank_fusion(ranks).collect()} == {"a": pytest.approx(1 / 61), "b": pytest.approx(1 / 62 + 1 / 61)}
    placed, centres = search.with_cells(table)
    exact = search.nearest(q.withColumn("grp", F.lit("*")), table.withColumn("grp", F.lit("*")), 5, {"clip": 1.0})
    near = search.probed(q, placed, centres, 5, probes=max(1, len(centres) - 1))
    same = near.join(exact, ["query_id", "filename"]).count()
    assert placed.count() == 300 and same >= 0.9 * 150
    asked = q.select((F.col("query_id") % 3).alias("query_id"), F.col("query_id").alias("descriptor"), "clip")
    held = table.select(F.substring("category", 4, 1).cast("long").alias("image"), "clip")
    got = {(r.query_id, r.image): r.good for r in search.good_matches(asked, held, 0.7, 4).collect()}
    for query in range(3):
        for image in range(4):
            near = [np.sort(np.linalg.norm(clip[image::4].astype(float) - clip[d].astype(float), axis=1))[:2] for d in range(query, 30, 3)]
            assert got[query, image] == sum(a < 0.7 * b for a, b in near)


@pytest.mark.parametrize("most", [4, 40])
def test_cells_as_registered_lose_nothing(spark, most):
    clip = _vectors(2000, 32)
    table = spark.createDataFrame([(f"f{i:04d}", v.tolist()) for i, v in enumerate(clip)], "filename string, clip array<float>").cache()
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(clip[:60])], "query_id long, clip array<float>")
    got = search.probed(q, *search.with_cells(table, most), 5).select("query_id", "rank_no", "filename", "score")
    want = search.nearest(*(x.withColumn("grp", F.lit("*")) for x in (q, table)), 5, {"clip": 1.0}).select("query_id", "rank_no", "filename", "score")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_metrics_and_variants(spark):
    runs = spark.createDataFrame([(1, "a", "a", 10.0), (4, "a", "b", 20.0), (None, "b", None, 30.0), (11, None, "b", 40.0)], "rank_no int, true_label string, pred_label string, latency_ms double")
    assert tuple(evaluate.hit_rates(runs).first()) == (4, 0.25, 0.5, 0.5, 0.5, 25.0)
    assert evaluate.hit_rates(runs.where("latency_ms < 0")).first().label_accuracy is None
    pairs = [("a", "a"), ("a", "a"), ("a", "b"), ("b", "b"), ("c", "a"), (None, "a")]
    got = {r.label: tuple(r)[1:] for r in evaluate.classification_report(spark.createDataFrame(pairs, "t string, p string"), "t", "p").collect()}
    assert got["a"] == (0.666667, 0.666667, 0.666667, 3) and got["b"] == (0.5, 1.0, 0.666667, 1) and got["c"] == (0.0, 0.0, 0.0, 1)
    assert got["accuracy"] == (0.6, 0.6, 0.6, 5) and got["macro avg"] == (0.388889, 0.555556, 0.444444, 5) and got["weighted avg"] == (0.5, 0.6, 0.533333, 5)
    texts = spark.createDataFrame([(1, 0, "abc", True), (1, 1, "abd", True), (1, 2, "a", True), (2, 0, "x" * 100, True)], "case_id long, variant_no int, text string, blurry boolean")
    assert sorted((r.case_id, r.variant_no, r.rejected) for r in evaluate.best_variant(texts).collect()) == [(1, 0, True), (2, 0, False)]


def test_catalog(spark):
    items = spark.createDataFrame([("12.jpg",), ("13.png",), ("x.jpg",)], "filename string")
    meta = spark.createDataFrame([(12, "red"), (None, "blue")], "id long, colour string")
    assert {r.filename: r.colour for r in catalog.with_metadata(items, meta, ["colour"]).collect()} == {"12.jpg": "red", "13.png": "unknown", "x.jpg": "unknown"}
    a, b = (catalog.sample(spark.range(1000).repartition(n), "id", 20).collect() for n in (3, 8))
    assert a == b and len(a) == 20


def test_matrices_are_cut_into_slabs():
    assert [len(range(5000)[s]) for s in search.slabs(5000, 4096)] == [256] * 19 + [136]
    assert [len(range(3)[s]) for s in search.slabs(3, 10**9)] == [1, 1, 1]
    batch = pd.DataFrame({"a": range(10_000)})
    pieces = list(search.few(iter([batch, batch[:0]]), 1000))
    assert max(map(len, pieces)) == 65 and pd.concat(pieces)["a"].tolist() == batch["a"].tolist()


@pytest.mark.parametrize("chunk", [4, 1000])
def test_best_images_are_those_of_all_counts(spark, chunk):
    """Whole queries and those in several parts, images of one part and of several; ties go to the smaller image."""
    rng = np.random.default_rng(5)
    clip = rng.normal(size=(60, 6))
    clip[30:] = clip[:30] + rng.normal(size=(30, 6)) * 0.05
    rows = [(i * i % 7, i, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(clip)]
    asked = spark.createDataFrame(rows[:30], "query_id long, descriptor long, clip array<double>")
    held = spark.createDataFrame(rows[30:] + [(90 + i, i, rows[i][2]) for i in range(3)], "image long, descriptor long, clip array<double>")
    every = [tuple(r) for r in search.good_matches(asked, held, 0.7, chunk).collect()]
    got = sorted((r.query_id, r.rank_no, r.image, r.good) for r in search.good_matches(asked, held, 0.7, chunk, k=3).collect())
    want = [(q, n + 1, image, good) for q in sorted({e[0] for e in every}) for n, (good, image) in enumerate(sorted((-e[2], e[1]) for e in every if e[0] == q)[:3])]
    assert got == [(q, n, image, -good) for q, n, image, good in want] and any(g for *_, g in got)
