"""The similarity join of ids against all pairs, with mixed edits up to the threshold."""

import random

import pytest

from evidentia.functions.similarity import _lcs
from evidentia.operators import idmatch
from evidentia.operators.idmatch import alike_ids, cuts, least_common


def _edited(rng, text, deletions, insertions, letters):
    s = list(text)
    for _ in range(min(deletions, len(s))):
        del s[rng.randrange(len(s))]
    for _ in range(insertions):
        s.insert(rng.randrange(len(s) + 1), rng.choice(letters))
    return "".join(s)


def _ratio(a, b):
    return round(200.0 * _lcs(a, b) / (len(a) + len(b)))


@pytest.mark.parametrize("threshold,letters,lengths", [(80, "0123456789abcdef", (20, 24)), (80, "ab", (1, 12)), (60, "abcd", (3, 10)), (95, "0123456789", (10, 40)), (100, "ab", (1, 6))])
def test_all_pairs(spark, threshold, letters, lengths):
    rng = random.Random(threshold + len(letters))
    left = [(n, f"d{rng.randrange(3)}", "".join(rng.choices(letters, k=rng.randint(*lengths)))) for n in range(150)]
    right = []
    for n in range(300):
        _, day, text = rng.choice(left)
        most = int(len(text) * (1 - threshold / 100) * 1.3) + 1
        right.append((n, day, _edited(rng, text, rng.randint(0, most), rng.randint(0, most), letters + "xyz")))
    left += [(1000, "d0", ""), (1001, None, "aaa"), (1002, "d1", None)]
    schema = "n long, day string, id string"
    got = sorted(map(tuple, alike_ids(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), threshold).collect()))
    want = sorted((l, r) for l, a, x in left for r, b, y in right if a is not None and a == b and x and y and _ratio(x, y) >= threshold)
    assert got == want and len(want) > 40


def test_many_mixed_edits_between_two_ids(spark):
    """Pairs at the threshold that differ by lost and added characters all over."""
    rng = random.Random(1)
    schema, left, right = "n long, day string, id string", [], []
    while len(left) < 400:
        a = "".join(rng.choices("0123456789abcdef", k=24))
        b = _edited(rng, a, rng.randint(2, 4), rng.randint(2, 4), "xyz0123")
        if _ratio(a, b) >= 80:
            left.append((len(left), "d", a))
            right.append((len(right), "d", b))
    left += [(400, "d", "0123456789abcdef02468ace")]
    right += [(400, "d", "0235689bczdefz024z68azce"), (401, "d", "02356z789zabczdef02468ace")]
    got = set(map(tuple, alike_ids(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), 80).collect()))
    assert {(n, n) for n in range(400)} | {(400, 400), (400, 401)} <= got


def test_segments_leave_no_pair_out():
    for threshold in (60, 80, 95):
        for a in range(1, 40):
            for b in range(1, a + 1):
                common = least_common(a + b, threshold)
                assert 200 * common >= (threshold - 0.5) * (a + b) > 200 * (common - 1)
                found = cuts(a, b, threshold)
                if found:
                    errors, m, size, odd = found
                    assert 2 * m - odd == errors + 1
                    assert size == 1 or m * size - odd <= a


def test_few_candidates_on_a_busy_day(spark):
    """Different ids of one day meet in a hundredth of the pairs at most."""
    rng = random.Random(2)
    ids = lambda n: spark.createDataFrame([(i, "d", "".join(rng.choices("0123456789abcdef", k=24))) for i in range(n)], "n long, day string, id string")
    left, right = ids(1500), ids(1500)
    pairs = alike_ids(left, right, 80)
    assert pairs.count() == 0
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_ids_are_shuffled_once_and_their_pieces_never(spark):
    rng = random.Random(3)
    ids = lambda n: spark.createDataFrame([(i, f"d{i % 3}", "".join(rng.choices("0123456789abcdef", k=24))) for i in range(n)], "n long, day string, id string")
    left, right, context = ids(300), ids(200), spark.sparkContext
    context.setJobGroup("shuffled", "")
    alike_ids(left, right, 80).collect()
    context._jsc.sc().listenerBus().waitUntilEmpty()
    tracker, store = context.statusTracker(), context._jsc.sc().statusStore()
    stages = {s for j in tracker.getJobIdsForGroup("shuffled") for s in tracker.getJobInfo(j).stageIds}
    context.setLocalProperty("spark.jobGroup.id", None)
    # and the days' counts of each task
    assert 500 <= sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages) < 600


@pytest.mark.parametrize("letters", ["ab", "0123456789abcdef", "äöü漢字😀abcdefghijklmnop"])
def test_a_busy_day_is_several_blocks_and_small_pieces(spark, monkeypatch, letters):
    """Whatever a task holds at a time, and however long ids are: the pairs of all pairs, and the first of each."""
    rng = random.Random(4)
    left = [(n, "d", "".join(rng.choices(letters, k=rng.choice([5, 12, 70])))) for n in range(90)]
    right = [(n, "d", _edited(rng, x, rng.randrange(3), rng.randrange(3), letters), f"p{n % 7}", rng.choice([None, 5])) for n, (_, _, x) in enumerate(rng.choices(left, k=160))]
    left += [(200 + n, "d", left[n][2]) for n in range(9)]
    want = sorted((l, r[0]) for l, _, x in left for r in right if _ratio(x, r[2]) >= 80)
    ls, rs = spark.createDataFrame(left, "n long, day string, id string"), spark.createDataFrame(right, "n long, day string, id string, place string, paid long")
    for chunk in (1 << 15, 30):
        assert sorted(map(tuple, alike_ids(ls, rs, 80, chunk=chunk).collect())) == want
        best = {}
        for r in alike_ids(ls, rs, 80, ["place", "n"], chunk).collect():
            best[r.l] = min(best.get(r.l, ("z",)), (r.place, r.n, r.paid))
        assert best == {l: min((right[r][3], r, right[r][4]) for k, r in want if k == l) for l, _ in want}
    monkeypatch.setattr(idmatch, "PIECES", 500)
    monkeypatch.setattr(idmatch, "PAIRS", 37)
    found = {(left[i][0], right[j][0]) for l, r in idmatch.pairs_alike([x[2] for x in left], [x[2] for x in right], 80) for i, j in zip(l, r, strict=True)}
    assert sorted(found) == want
