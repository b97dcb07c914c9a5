"""What the operators of this subpackage share: table access, shared folders and batch limits."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Arrow batches stay this small however long the texts of a partition are.
BATCH_BYTES = 8 << 20
BATCH_ROWS = 2000


def session(spark: SparkSession) -> SparkSession:
    """Bounds Arrow batches by bytes and rows, and names a checkpoint folder where none is set (tests only)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return session(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name under the folder that driver and executors share."""
    session(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` as a Parquet table in the shared folder: its lineage ends there."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under the operator's own names: other columns of the input cannot clash."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def only_kept(docs: DataFrame, kept: DataFrame, mark: str) -> DataFrame:
    """The rows of ``docs`` whose (doc_id, ``mark``) is in ``kept``, null ids included; of rows that agree in both one
    stays. ``docs`` has ``mark`` as a further column, which goes. Texts are shuffled once: the join and the choice among
    equal rows go by one column."""
    name = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col(mark))
    wanted = kept.select(name.alias("_name")).distinct()
    found = docs.withColumn("_name", name).join(wanted, "_name")
    order = Window.partitionBy("_name").orderBy("_name")
    return found.withColumn("_n", F.row_number().over(order)).where("_n = 1").select(*[F.col(f"`{c}`") for c in docs.columns if c != mark])


def give_back() -> None:
    """Returns freed memory to the system: workers are used again for many tasks, and an executor's memory is shared by
    them and the JVM."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


_remembered: dict = {}


def remembered(key, make: Callable):
    """One thing that a worker keeps from task to task."""
    if key not in _remembered:
        forget()
        _remembered[key] = make()
    return _remembered[key]


def forget() -> None:
    _remembered.clear()


def lean(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keep: bool = False):
    """A task of ``mapInArrow`` that gives freed memory back when it ends; what a task of another kind has left in the
    worker goes first, unless ``keep``."""

    @wraps(task)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keep:
            forget()
        yield from task(batches)
        give_back()

    return run
