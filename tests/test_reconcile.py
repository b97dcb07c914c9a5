import datetime
import random

import pytest
from pyspark.sql import functions as F

from evidentia.functions.similarity import alike, common_length, partial_ratio, partial_ratio_of, positional_ratio, ratio
from evidentia.operators import reconcile

NOON = datetime.datetime(2025, 1, 5, 12, 0)
TID = "0123456789abcdef01234567"
CASE = "case_id long, ocr_score int, amount long, transaction_id string, timestamp timestamp, receiver string, chat_amount long, chat_time timestamp, fraud boolean, mail struct<transaction_id:string,amount:long,timestamp:timestamp>"


def _case(**changes):
    base = {"case_id": 1, "ocr_score": 100, "amount": 500, "transaction_id": TID, "timestamp": NOON, "receiver": "the shop", "chat_amount": 500, "chat_time": NOON - datetime.timedelta(minutes=30), "fraud": False, "mail": (TID, 500, NOON)}
    return tuple((base | changes).values())


def minutes(n):
    return NOON + datetime.timedelta(minutes=n)


@pytest.mark.parametrize("changes,want", [
    ({}, (100.0, "APPROVED")),
    ({"mail": (TID, 510, NOON)}, (100.0, "APPROVED")),
    ({"mail": (TID, 900, NOON)}, (80.0, "MANUAL REVIEW")),
    ({"mail": None}, (65.0, "MANUAL REVIEW")),
    ({"mail": None, "chat_time": None}, (55.0, "MANUAL REVIEW")),
    ({"mail": None, "chat_time": minutes(120)}, (0.0, "REJECTED")),
    ({"mail": (TID, 500, minutes(10))}, (100.0, "APPROVED")),
    ({"fraud": True}, (0.0, "Fraud detected")),
    ({"ocr_score": 49}, (None, "REJECTED")),
    ({"chat_amount": 0}, (None, "REJECTED")),
    ({"timestamp": None}, (None, "REJECTED")),
    # one part after another, from a case that is not clamped: 25 + 40 + 25 + 15 + 10 + 15 + 5 = 135 with OCR 50, less 55
    ({"ocr_score": 50, "mail": None}, (40.0, "REJECTED")),
    ({"ocr_score": 50, "mail": None, "receiver": None}, (25.0, "REJECTED")),
    ({"ocr_score": 50, "mail": None, "receiver": "zzzzz"}, (10.0, "REJECTED")),
    ({"ocr_score": 50, "mail": None, "chat_time": minutes(15)}, (40.0, "REJECTED")),
    ({"ocr_score": 50, "mail": None, "chat_time": minutes(16)}, (0.0, "REJECTED")),
    ({"ocr_score": 50, "mail": (TID[:12] + "x" * 12, 470, minutes(40)), "receiver": None}, (0.0, "REJECTED")),
])
def test_scores(spark, changes, want):
    r = reconcile.decide(spark.createDataFrame([_case(**changes)], CASE), "The Shop").first()
    assert (r.confidence, r.status) == want


def test_time_bands_and_views(spark):
    def time_points(n):
        low = {"ocr_score": 50, "receiver": None, "chat_amount": 900, "chat_time": None, "mail": (TID, 500, minutes(n))}
        return reconcile.decide(spark.createDataFrame([_case(**low)], CASE), "The Shop").first().confidence - (25 - 40 + 25 + 5)

    assert [time_points(n) for n in (0, 5, 6, 15, 16, 29, 40, -5, -16)] == [15, 15, 7.5, 7.5, -8, -14.5, -15, 15, -8]
    row = spark.range(1).select(*[reconcile.shown_as(F.lit(s)) for s in ("APPROVED", "MANUAL REVIEW", "REJECTED")], *[reconcile.shown_confidence(F.lit(s)) for s in ("verified", "partial", "failed")]).first()
    assert tuple(row) == ("success", "partial", "failed", 95, 70, 30)


def _lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_similarity(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choices("abcd", k=n))
    pairs = [(word(rng.randrange(9)), word(rng.randrange(9))) for _ in range(150)] + [("", ""), ("abc", "abc"), (None, "a")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select("a", "b", common_length(F.col("a"), F.col("b")).alias("l"), ratio(F.col("a"), F.col("b")).alias("r"), alike(F.col("a"), F.col("b"), 60).alias("k"), partial_ratio(F.col("a"), F.col("b")).alias("p"), positional_ratio(F.col("a"), F.col("b")).alias("s")).collect()
    for r in got[:-1]:
        n = _lcs(r.a, r.b)
        both = len(r.a) + len(r.b)
        assert r.l == n and r.r == (round(200 * n / both) if both else 0) and r.k == (r.r >= 60)
        assert r.s == (sum(x == y for x, y in zip(r.a, r.b, strict=False)) / len(r.b) if r.b else None)
        short, long = sorted((r.a, r.b), key=len)
        ways = [(short, long), (long, short)] if len(short) == len(long) else [(short, long)]  # of equal lengths either may be cut
        scores = [200 * _lcs(x, w) / (len(x) + len(w)) for x, y in ways for i in range(1 - len(x), len(y)) if x for w in [y[max(0, i) : i + len(x)]]]
        assert r.p == pytest.approx(max(scores, default=0))
        assert partial_ratio_of(r.a, r.b, 70) in (pytest.approx(r.p), 0.0) and (partial_ratio_of(r.a, r.b, 70) >= 70) == (r.p >= 70)
    assert got[-1].p is None


def test_mails_are_those_of_all_pairs(spark):
    rng = random.Random(5)
    ids = ["".join(rng.choices("0123456789abcdef", k=24)) for _ in range(40)]
    receipts, mails = [], []
    for n, tid in enumerate(ids):
        receipts.append((n, tid[: rng.choice([20, 24, 24])], minutes(rng.randrange(2000))))
        for m in range(rng.randrange(4)):
            wrong = list(tid)
            for _ in range(rng.randrange(7)):
                i = rng.randrange(len(wrong))
                if rng.random() < 0.5:
                    wrong[i] = "x"
                elif len(wrong) > 20:
                    del wrong[i]
                else:
                    wrong.insert(i, "y")
            mails.append((f"m{n}-{m}", rng.choice(["bank", "bank", "other"]), receipts[-1][2] + datetime.timedelta(minutes=rng.randrange(60)), "".join(wrong).upper(), rng.choice([5, 5, None])))
    left = spark.createDataFrame(receipts, "case_id long, transaction_id string, timestamp timestamp")
    right = spark.createDataFrame([(*m, None) for m in mails], "id string, sender string, received timestamp, transaction_id string, amount long, timestamp timestamp")
    got = {r.case_id: r.mail and r.mail.transaction_id for r in reconcile.match_mails(left, right, "bank").collect()}
    for n, tid, at in receipts:
        near = [m for m in mails if m[1] == "bank" and m[4] and m[2].date() == at.date() and round(200 * _lcs(tid, m[3].lower()) / (len(tid) + len(m[3]))) >= 80]
        assert got[n] == (max(near, key=lambda m: m[2])[3] if near else None)
    assert len(got) == 40 and sum(v is not None for v in got.values()) > 10


def test_receipts_that_share_a_case_are_matched_each_for_itself(spark):
    other = "fedcba9876543210fedcba98"
    left = spark.createDataFrame([(1, TID, NOON), (1, other, NOON), (2, None, NOON), (3, TID, None), (4, TID, NOON)], "case_id long, transaction_id string, timestamp timestamp")
    mails = [("m1", "bank", minutes(1), TID, 5, NOON), ("m2", "bank", minutes(2), other.upper(), 6, None), ("m3", "bank", minutes(1), TID, 7, NOON), ("m4", "bank", None, TID, 8, NOON)]
    right = spark.createDataFrame(mails, "id string, sender string, received timestamp, transaction_id string, amount long, timestamp timestamp")
    got = sorted((r.case_id, str(r.transaction_id), r.mail and r.mail.amount) for r in reconcile.match_mails(left, right, "bank").collect())
    assert got == [(1, TID, 5), (1, other, 6), (2, "None", None), (3, TID, None), (4, TID, 5)]
