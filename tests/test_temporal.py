"""Joins by time against all pairs."""

import random
from datetime import datetime, timedelta

import pytest

from evidentia.operators.temporal import as_of, interval_join

START = datetime(2025, 3, 1, 23, 50)


def _rows(rng, n, keys):
    return [(i, rng.choice(keys), START + timedelta(seconds=rng.randrange(4000)) if rng.random() < 0.95 else None) for i in range(n)]


@pytest.mark.parametrize("on", [[], ["k"]])
def test_all_pairs_within_an_interval(spark, on):
    rng = random.Random(1)
    left, right = _rows(rng, 120, ["a", "b", None]), _rows(rng, 150, ["a", "b", None])
    l, r = spark.createDataFrame(left, "i long, k string, t timestamp"), spark.createDataFrame(right, "j long, k string, u timestamp")
    if not on:
        r = r.withColumnRenamed("k", "k2")
    for before, after in ((0, 0), (60, 0), (30, 300), (-10, 100)):
        got = sorted((x.i, x.j) for x in interval_join(l, r, "t", "u", timedelta(seconds=before), timedelta(seconds=after), on).collect())
        want = sorted((i, j) for i, a, t in left for j, b, u in right if t and u and (not on or (a is not None and a == b)) and -before <= (u - t).total_seconds() <= after)
        assert got == want
    assert interval_join(l.limit(0), r, "t", "u", timedelta(1), timedelta(1), on).count() == 0


@pytest.mark.parametrize("on", [[], ["k"]])
def test_the_latest_before_each(spark, on):
    rng = random.Random(2)
    left, right = _rows(rng, 150, ["a", "b", "c", None]), _rows(rng, 200, ["a", "b", None])
    left += [left[0], left[1]]
    right += [(1000 + n, k, u) for n, (_, k, u) in enumerate(right[:30])]  # the same times again
    l, r = spark.createDataFrame(left, "i long, k string, t timestamp").repartition(3), spark.createDataFrame(right, "i long, k string, u timestamp").repartition(3)
    for within, ahead in ((50, 0), (600, 0), (100, 30), (100_000, 5)):
        got = sorted((x.i, str(x.k), str(x.t), x.found and x.found.i) for x in as_of(l, r, "t", "u", timedelta(seconds=within), timedelta(seconds=ahead), on, ties="i").collect())
        want = []
        for i, a, t in left:
            near = [(u, j) for j, b, u in right if t and u and (not on or (a is not None and a == b)) and -within < (u - t).total_seconds() <= ahead]
            want.append((i, str(a), str(t), max(near)[1] if near else None))
        assert got == sorted(want, key=lambda w: (w[0], w[1], w[2])) or sorted(map(str, got)) == sorted(map(str, want))
    assert as_of(l, r.limit(0), "t", "u", timedelta(1), on=on).where("found is not null").count() == 0


def test_no_cross_product(spark):
    rows = spark.createDataFrame([(1, START)], "i long, t timestamp")
    for df in (interval_join(rows, rows.toDF("j", "u"), "t", "u", timedelta(1), timedelta(1)), as_of(rows, rows, "t", "t", timedelta(1))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan
