"""Retrieval and classification metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hit_rates(runs: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """runs (rank_no from 1, null: missed; true_label; pred_label; latency_ms) -> one row of rates over all runs.

    Label accuracy counts runs with both labels; no such run, or no run at all, gives null.
    """
    both = F.col("true_label").isNotNull() & F.col("pred_label").isNotNull()
    hits = [F.round(F.avg(F.when(F.col("rank_no") <= k, 1.0).otherwise(0.0)), 6).alias(f"top{k}") for k in ks]
    right = F.try_divide(F.count_if(both & (F.col("true_label") == F.col("pred_label"))), F.count_if(both))
    return runs.agg(F.count(F.lit(1)).alias("n"), *hits, F.round(right, 6).alias("label_accuracy"), F.round(F.avg("latency_ms"), 6).alias("mean_latency_ms"))


def classification_report(labelled: DataFrame, true: str, predicted: str) -> DataFrame:
    """label, precision, recall, f1, support for each class, and rows ``accuracy``, ``macro avg``, ``weighted avg``.

    A share without cases is 0. Rows where either label is null are left out. One pass of counts by class pair, so the
    shuffle holds classes, not rows.
    """
    pairs = labelled.where(F.col(true).isNotNull() & F.col(predicted).isNotNull()).groupBy(F.col(true).alias("t"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = pairs.select(F.inline(F.array(F.struct(F.col("t").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("said")), F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("said")))), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("hit"))
    by = sides.groupBy("label").agg(F.sum("support").alias("support"), F.sum("said").alias("said"), (F.sum("hit") / 2).alias("hit"))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    rated = by.withColumn("precision", share(F.col("hit"), F.col("said"))).withColumn("recall", share(F.col("hit"), F.col("support")))
    rated = rated.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    columns = ("precision", "recall", "f1")
    total = F.sum("support")
    accuracy = share(F.sum("hit"), total)
    whole = rated.agg(
        F.struct(*[accuracy.alias(c) for c in columns]).alias("accuracy"),
        F.struct(*[F.avg(c).alias(c) for c in columns]).alias("macro avg"),
        F.struct(*[share(F.sum(F.col(c) * F.col("support")), total).alias(c) for c in columns]).alias("weighted avg"),
        total.alias("support"),
    )
    extra = [whole.select(F.lit(name).alias("label"), *[F.col(f"`{name}`.{c}").alias(c) for c in columns], "support") for name in ("accuracy", "macro avg", "weighted avg")]
    out = rated.select(F.col("label").cast("string"), *columns, "support")
    for e in extra:
        out = out.unionByName(e)
    return out.select("label", *[F.round(c, 6).alias(c) for c in columns], "support")


def best_variant(variants: DataFrame, least: int = 100) -> DataFrame:
    """case_id, variant_no, text of the longest text of each case, the first of equally long ones; ``rejected`` where it is
    shorter than ``least`` and the image is blurry."""
    rank = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc(F.length("text")), "variant_no"))
    best = variants.withColumn("_n", rank).where("_n = 1")
    return best.select("case_id", "variant_no", "text", ((F.length("text") < least) & F.col("blurry")).alias("rejected"))
