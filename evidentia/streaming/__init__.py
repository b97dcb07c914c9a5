"""The batch operators over streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import digital_fields, mail_fields
from ..operators.extraction import parse_receipts


def verify_stream(texts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Receipts as they arrive (case_id, text), parsed and appended to a Parquet table. Parsing keeps no state."""
    return parse_receipts(texts).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def paired_stream(receipts: DataFrame, mails: DataFrame, delay: str = "1 day") -> DataFrame:
    """Receipts (case_id, text, arrived) and mails (id, body, received) that carry one id within ``delay``: a
    stream-stream left outer join, whose watermarks bound the state."""
    ours = receipts.withWatermark("arrived", delay).select("case_id", "arrived", digital_fields(receipts["text"])["transaction_id"].alias("own_id"))
    theirs = mails.withWatermark("received", delay).select("id", "received", mail_fields(mails["body"])["transaction_id"].alias("mail_tid"))
    near = (ours.own_id == theirs.mail_tid) & (theirs.received >= ours.arrived - _days(delay)) & (theirs.received <= ours.arrived + _days(delay))
    return ours.join(theirs, near, "left_outer")


def _days(delay: str):
    from pyspark.sql import functions as F

    return F.expr(f"interval {delay}")


def for_each_batch(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Any batch operator over micro-batches; a batch that runs again after a failure overwrites its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def first_seen(stream: DataFrame, keys: list[str], time: str, limit: str) -> DataFrame:
    """Rows whose keys have not been seen within ``limit`` of event time: the first of each stays, and its key is forgotten when
    the watermark has passed it by, which bounds the state. A restart from the checkpoint goes on with the same state."""
    return stream.withWatermark(time, limit).dropDuplicatesWithinWatermark(keys)
