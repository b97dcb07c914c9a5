"""Receipts, chats and bank e-mails held against each other: matching, scoring and the decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import partial_ratio, positional_ratio
from ..sources.files import settled
from .idmatch import alike_ids

# Points and limits of the score.
AMOUNT_POINTS, ID_POINTS, TIME_POINTS, ORDER_POINTS, RECEIVER_POINTS, BASE_POINTS = 40.0, 25.0, 15.0, 10.0, 15.0, 5.0
NO_MAIL_PENALTY, LATE_CHAT_PENALTY, PARTIAL_MAIL_PENALTY = 55.0, 55.0, 20.0
MAIL_KEYS = ("amount", "transaction_id", "timestamp")
APPROVE_FROM, REVIEW_FROM, OCR_GATE, ID_THRESHOLD = 90, 50, 50, 80


def match_mails(receipts: DataFrame, mails: DataFrame, sender: str, threshold: int = ID_THRESHOLD) -> DataFrame:
    """Adds ``mail`` (transaction_id, amount, timestamp) to each receipt (case_id, transaction_id, timestamp): of the
    sender's e-mails of the same day whose id is alike by ``threshold``, the latest, then that with the smallest id.

    Receipts and e-mails are written and read again, so what they are made of is evaluated once. Equal ids of a day are compared
    once in a block, however many receipts or e-mails have them; receipts that repeat a case_id are matched each for itself.
    Receipts without id or time, and e-mails without id, amount or time, match nothing.
    """
    ours = settled(receipts.withColumn("_n", F.monotonically_increasing_id()), "receipts")
    usable = mails.where((F.col("sender") == sender) & F.col("transaction_id").isNotNull() & F.col("amount").isNotNull() & F.col("received").isNotNull())
    before = -F.unix_micros(F.col("received").cast("timestamp"))
    theirs = settled(usable.select(F.to_date("received").alias("day"), before.alias("before"), F.col("id").alias("mail_id"), F.struct("transaction_id", "amount", "timestamp").alias("mail")), "mails")
    left = ours.select(F.col("_n").alias("n"), F.to_date("timestamp").alias("day"), F.lower("transaction_id").alias("id"))
    found = alike_ids(left, theirs.withColumn("id", F.lower("mail.transaction_id")), threshold, ["before", "mail_id"])
    best = found.groupBy(F.col("l").alias("_n")).agg(F.min_by("mail", F.struct("before", "mail_id")).alias("mail"))
    return ours.join(best, "_n", "left").drop("_n")


def _minutes(later: Column, earlier: Column) -> Column:
    return (F.unix_timestamp(later) - F.unix_timestamp(earlier)) / 60.0


def confidence(merchant: str, partial: bool = True, keys: Column | None = None) -> Column:
    """0-100 from columns fraud, ocr_score, amount, transaction_id, timestamp, receiver, mail, chat_amount, chat_time.
    ``keys``: the names of the fields that the mail's source had at all, where sources differ in that; a null field is
    none that is missing."""
    mail, own = F.col("mail"), F.col("timestamp")
    zero = F.lit(0.0)
    paid = F.coalesce(mail["amount"], F.when(F.col("amount") != 0, F.col("amount")))
    gap = F.abs(F.col("chat_amount") - paid)
    amount = F.when(paid.isNull(), zero).when(gap == 0, AMOUNT_POINTS).otherwise(-F.least(F.lit(AMOUNT_POINTS), gap.cast("double")))
    places = positional_ratio(F.col("transaction_id"), mail["transaction_id"])
    tid = F.when(places.isNull(), zero).when(places > 0.95, ID_POINTS).otherwise(-(1 - places) * ID_POINTS)
    apart = F.abs(_minutes(own, mail["timestamp"]))
    time = F.when(apart.isNull(), zero).when(apart <= 5, TIME_POINTS).when(apart <= 15, TIME_POINTS / 2).otherwise(-F.least(F.lit(TIME_POINTS), apart / 2))
    after = _minutes(F.coalesce(mail["timestamp"], own), F.col("chat_time"))
    order = F.when(after.isNull(), zero).when(after >= -15, ORDER_POINTS).otherwise(-LATE_CHAT_PENALTY)
    name = F.lower("receiver")
    likeness = F.round(partial_ratio(name, F.lit(merchant.lower()))) if partial else F.when(name.contains(merchant.lower()), 100.0).otherwise(0.0)
    receiver = F.when(F.coalesce(F.col("receiver"), F.lit("")) == "", zero).when(likeness > 93, RECEIVER_POINTS).when(likeness > 88, RECEIVER_POINTS / 2).otherwise(-(100 - likeness) / 100 * RECEIVER_POINTS)
    lacks = F.lit(False) if keys is None else F.size(F.array_except(F.array(*map(F.lit, MAIL_KEYS)), keys)) > 0
    score = 0.5 * F.col("ocr_score") + amount + tid + time + order + receiver + F.when(mail.isNull(), -NO_MAIL_PENALTY).when(lacks, -PARTIAL_MAIL_PENALTY).otherwise(0.0) + BASE_POINTS
    return F.when(F.col("fraud"), zero).otherwise(F.greatest(zero, F.least(F.lit(100.0), score)))


def verdict(score: Column) -> Column:
    return F.when(F.col("fraud"), "Fraud detected").when(score >= APPROVE_FROM, "APPROVED").when(score >= REVIEW_FROM, "MANUAL REVIEW").otherwise("REJECTED")


def decide(cases: DataFrame, merchant: str) -> DataFrame:
    """Adds confidence, status and reject_reason: every case gets one row. A case that is not fit to be scored has a
    reason (unreadable, no_chat_amount, no_timestamp), a null confidence and the status REJECTED."""
    reason = F.when(F.col("ocr_score") < OCR_GATE, "unreadable").when(F.coalesce(F.col("chat_amount"), F.lit(0)) == 0, "no_chat_amount").when(F.col("timestamp").isNull(), "no_timestamp")
    scored = cases.withColumn("reject_reason", reason).withColumn("confidence", F.when(F.col("reject_reason").isNull(), confidence(merchant)))
    return scored.withColumn("status", F.when(F.col("reject_reason").isNotNull(), "REJECTED").otherwise(verdict(F.col("confidence"))))


def shown_as(status: Column) -> Column:
    """How a front end names a decision."""
    return F.when(status == "APPROVED", "success").when(status == "MANUAL REVIEW", "partial").otherwise("failed")


def shown_confidence(status: Column) -> Column:
    """The confidence that a front end shows for a receipt's verification status."""
    return F.when(status == "verified", 95).when(status == "partial", 70).otherwise(30)
