"""Joins by time: all pairs within an interval, and the latest row at or before each. Rows meet in bins of time as wide as the
interval, so no day, and no key with a third of the rows, is one task."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _micros(span: timedelta) -> int:
    return span // timedelta(microseconds=1)


def _at(time: str) -> Column:
    return F.unix_micros(F.col(f"`{time}`").cast("timestamp"))


def _bin(at: Column, width: int) -> Column:
    return F.floor(at / width).cast("long")


def interval_join(left: DataFrame, right: DataFrame, time: str, right_time: str, before: timedelta, after: timedelta, on: list[str] | None = None) -> DataFrame:
    """All pairs of rows that agree in ``on`` and of which the right one's time is at most ``before`` earlier and at most ``after``
    later than the left one's: all columns of the left, and those of the right that are not in ``on``.

    Null times and keys match nothing. Equal rows pair each; the other columns of both sides have to differ in name.
    """
    on = on or []
    low, high = _micros(before), _micros(after)
    width = max(1, low + high)
    l_at, r_at = _at(time), _at(right_time)
    ours = left.where(F.col(f"`{time}`").isNotNull()).withColumn("_l_at", l_at).withColumn("_bin", F.explode(F.sequence(_bin(F.col("_l_at") - low, width), _bin(F.col("_l_at") + high, width))))
    theirs = right.where(F.col(f"`{right_time}`").isNotNull()).withColumn("_r_at", r_at).withColumn("_bin", _bin(F.col("_r_at"), width))
    pairs = ours.join(theirs, [*on, "_bin"]).where((F.col("_r_at") >= F.col("_l_at") - low) & (F.col("_r_at") <= F.col("_l_at") + high))
    return pairs.select(*[F.col(f"`{c}`") for c in left.columns], *[F.col(f"`{c}`") for c in right.columns if c not in on])


def as_of(left: DataFrame, right: DataFrame, time: str, right_time: str, within: timedelta, ahead: timedelta = timedelta(0), on: list[str] | None = None, ties: str | None = None, name: str = "found") -> DataFrame:
    """Each row of ``left`` with the latest row of ``right`` as the struct ``name``: among those that agree in ``on``, at most
    ``ahead`` later and less than ``within`` earlier than its own time; of several at one time that with the greatest ``ties``.

    Both sides are one sorted stream in each bin of time, a right row stands in its own and the next, and the last right row
    before a left one is its match: rows grow with both inputs, not with pairs. A left row with a null time or key, or
    without a match, has a null struct; equal left rows stay as many as they are.
    """
    on = on or []
    width, later = max(1, _micros(within) + _micros(ahead)), _micros(ahead)
    whole = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    keys = [F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(on)]
    known = lambda t: F.expr(" and ".join(f"`{c}` is not null" for c in [t, *on]))
    found_type = right.select(F.struct(*[F.col(f"`{c}`") for c in right.columns]).alias("r")).schema["r"].dataType
    least = F.col(f"`{ties}`") if ties else F.lit(0)
    r = right.where(known(right_time)).select(*keys, _at(right_time).alias("_t"), F.lit(0).alias("_side"), least.alias("_tie"), F.struct(*[F.col(f"`{c}`") for c in right.columns]).alias("_r"))
    r = r.withColumn("_bin", F.explode(F.array(_bin(F.col("_t"), width), _bin(F.col("_t"), width) + 1))).withColumn("_l", F.lit(None).cast(left.select(whole.alias("l")).schema["l"].dataType))
    l = left.where(known(time)).select(*keys, (_at(time) + later).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(r.schema["_tie"].dataType).alias("_tie"), F.lit(None).cast(found_type).alias("_r"), whole.alias("_l"))
    both = r.unionByName(l.withColumn("_bin", _bin(F.col("_t"), width)))
    order = Window.partitionBy(*[f"_k{i}" for i in range(len(on))], "_bin").orderBy("_t", "_side", F.col("_tie").asc_nulls_first())
    last = F.last(F.when(F.col("_side") == 0, F.struct(F.col("_t").alias("at"), F.col("_r").alias("r"))), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    matched = both.withColumn("_last", last).where("_side = 1").select("_l.*", F.when(F.col("_last.at") > F.col("_t") - width, F.col("_last.r")).alias(name))
    return matched.unionByName(left.where(~known(time)).withColumn(name, F.lit(None).cast(found_type)))
