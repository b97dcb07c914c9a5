"""Batches in which single rows may be broken: they get the status ``error`` and stand apart, the others go on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .extraction import parse_receipts

STATUSES = ("verified", "partial", "failed", "error")


def decoded_payloads(batch: DataFrame, payload: str = "payload", text: str = "text") -> DataFrame:
    """Adds ``text``, the UTF-8 text of a base64 payload, and ``error``: why there is none (null where there is one)."""
    raw = F.try_to_binary(F.col(f"`{payload}`"), F.lit("base64"))
    checked = batch.withColumn("_raw", raw).withColumn(text, F.try_validate_utf8(F.col("_raw").cast("string")))
    why = F.when(F.col(f"`{payload}`").isNull(), "no payload").when(F.col("_raw").isNull(), "not base64").when(F.length("_raw") == 0, "empty payload").when(F.col(text).isNull(), "not UTF-8")
    return checked.withColumn("error", why).withColumn(text, F.when(why.isNull(), F.col(text))).drop("_raw")


def verified_batch(batch: DataFrame, payload: str = "payload") -> DataFrame:
    """Receipts as base64 payloads -> transaction_id, amount, date, verification_status, error besides their other columns.

    A payload that cannot be read has the status ``error`` and no fields; it never fails the batch. Rows are independent of
    each other: repeated ones give the same twice, an empty batch gives none.
    """
    parsed = parse_receipts(decoded_payloads(batch, payload, "_text"), "_text")
    broken = F.col("error").isNotNull()
    return parsed.withColumn("verification_status", F.when(broken, "error").otherwise(F.col("verification_status"))).drop("_text", payload, "extraction_method")


def save_batch(results: DataFrame, path: str, status: str = "verification_status") -> dict[str, int]:
    """Writes the rows under ``path``, broken ones into the folder ``quarantined=true`` and the others beside it, and gives the
    totals, which are counted as the rows are written: total_processed and one number for each status."""
    seen = Observation("batch")
    counts = [F.count_if(F.col(status) == s).alias(s) for s in STATUSES]
    results.withColumn("quarantined", F.coalesce(F.col(status) == "error", F.lit(False))).observe(seen, F.count(F.lit(1)).alias("total_processed"), *counts).write.partitionBy("quarantined").parquet(path)
    return {k: int(v or 0) for k, v in seen.get.items()}


def read_batch(spark: SparkSession, path: str) -> DataFrame:
    """What ``save_batch`` wrote, with ``quarantined``: a filter on it reads only one of the two folders."""
    return spark.read.parquet(path).withColumn("quarantined", F.col("quarantined").cast("boolean"))
