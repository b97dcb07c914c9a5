from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from evidentia.llm.mixing import mix, shard_quotas, source_targets


def _targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Hand the excess on until no target is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    words, full = sum(sizes.values()) * share, set()
    while True:
        free = [s for s in names if s not in full]
        rest = words - sum(most * sizes[s] for s in full)
        target = {s: most * sizes[s] if s in full else rest * weight[s] / sum(weight[x] for x in free) for s in names}
        over = {s for s in free if target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


def _docs(spark, rows):
    return spark.createDataFrame([(*r, 5, 6) for r in rows], "doc_id long, text string, source string, size int, block int")


def test_targets_and_taken_words(spark):
    rows = [(i, "w " * (1 + i % 37), ["a", "a", "a", "b", "c", "é", None][i % 7]) for i in range(1500)]
    rows += [(5000, None, "a"), (5001, "", "only empty"), (5002, " \t\n", None), (5003, "x" * 100_000, "b"), (5004, "y " * 30_000, "c"), (None, "one two", "a"), (5005, "same row", "b"), (5005, "same row", "b")]
    got = mix(_docs(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r[2]] += len((r[1] or "").split())
    want, source_of = _targets(sizes), {r[0]: r[2] for r in rows}
    for r in got:
        source = source_of[r.doc_id]
        assert r.source_size == sizes[source] and r.target == pytest.approx(want[source])
        assert 0 <= r.taken <= 2 * r.size and r.taken == sum(c.words for c in r.copies)
        taken[source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    again = mix(_docs(spark, rows).repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mix(_docs(spark, rows).where("doc_id = -1")).count() == 0
    assert mix(_docs(spark, [(1, None, None), (2, "", "a")])).where("taken <> 0 or target <> 0").count() == 0


def test_shards_get_exact_quotas_and_balanced_shares(spark):
    draws = spark.createDataFrame([(0, 400), (1, 0), (2, 37), (3, 163)], "no int, n_draws long")
    got = shard_quotas(draws, 8, 3).groupBy("shard").pivot("no", [0, 1, 2, 3]).agg(F.sum("n")).fillna(0).orderBy("shard").collect()
    assert [sum(r[str(i)] for r in got) for i in range(4)] == [400, 0, 37, 163]
    assert {sum(r[1:]) for r in got} == {75}


def test_draws_have_the_hypergeometric_mean_and_spread(spark):
    draws = spark.createDataFrame([(0, 30), (1, 70)], "no int, n_draws long")
    left = [shard_quotas(draws, 2, seed).where("shard = 0 and no = 0").first().n for seed in range(60)]
    mean = sum(left) / 60
    spread = sum((x - mean) ** 2 for x in left) / 59
    assert abs(mean - 15) < 1.2 and 2.2 < spread < 10  # 50 of 100 draws: mean 15, variance 5.3


def test_targets_alone(spark):
    sizes = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate((10, 1000, 3, 500, 80, 7, 2000))], "source string, size long")
    want = _targets({r.source: r.size for r in sizes.collect()})
    assert {r.source: r.target for r in source_targets(sizes).collect()} == pytest.approx(want)
