"""Comparing the members of buckets in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Members of one side of a block.
SIDE = 256


def in_blocks(members: DataFrame, bucket: list[str], member: str, side: int = SIDE, useful: Column | None = None) -> DataFrame:
    """``members`` with ``part``, ``low`` and ``high``: a bucket's members lie in parts of about ``side``, and each
    appears in the blocks (low, high) of its part with every part. Buckets with one member go, and those of which the
    aggregate ``useful`` is false."""
    sizes = members.groupBy(*bucket).agg(F.count(F.lit(1)).alias("_n"), (F.lit(True) if useful is None else useful).alias("_useful")).where("_n > 1 and _useful").drop("_useful").withColumn("_parts", F.ceil(F.col("_n") / side).cast("int"))
    held = members.join(sizes.drop("_n"), bucket).withColumn("part", F.pmod(F.xxhash64(member, F.lit(5)), "_parts").cast("int"))
    return held.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).withColumn("low", F.least("part", "_with")).withColumn("high", F.greatest("part", "_with")).drop("_with", "_parts")


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows that agree in the first ``keys`` columns, however batches cut them: (key, rows without the key)."""
    now, rows = None, []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if row[:keys] != now:
                if rows:
                    yield now, rows
                now, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield now, rows
