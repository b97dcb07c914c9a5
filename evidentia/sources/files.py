"""Readers and writers: image folders, texts, tables, annotation files and the saved index."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StructType

from ..operators.catalog import box_lines

#: File endings of inventory images.
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png")
IMAGE_SUFFIXES_BMP = (*IMAGE_SUFFIXES, ".bmp")
#: Row groups of images: rows and (packed) bytes of one, and after how many rows bytes are counted first.
IMAGE_GROUPS = {"parquet.block.row.count.limit": "64", "parquet.block.size": str(1 << 22), "parquet.block.size.row.check.min": "1"}


def has_suffix(path: Column, suffixes: tuple[str, ...] = IMAGE_SUFFIXES) -> Column:
    return F.lower(path).rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$")


def images(spark: SparkSession, path: str) -> DataFrame:
    """path, height, width, channels, data (BGR rows); files that are no images go."""
    return spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(path).select(F.col("image.origin").alias("path"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))


def files(spark: SparkSession, path: str, suffixes: tuple[str, ...] = IMAGE_SUFFIXES, glob: str | None = None) -> DataFrame:
    """path, content of files by suffix, whatever its case, or by a glob of names."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    found = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    return found.where(has_suffix(F.col("path"), suffixes)).select("path", "content") if not glob else found.select("path", "content")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """path, text: a row for each file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def metadata_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with header; lines that don't fit the schema go."""
    return spark.read.schema(schema).csv(path, header=True, mode="DROPMALFORMED")


def _stem() -> Column:
    return F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]*)", 1)


def boxes(spark: SparkSession, path: str, doc: str | None = None) -> DataFrame:
    """Annotated boxes, one file for each document: doc is the file's name without ending, or its folder's value of the
    partition column ``doc``; lines are numbered."""
    raw = spark.read.text(path, wholetext=True).select((F.col(doc) if doc else _stem()).alias("doc"), F.posexplode(F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")).alias("line_no", "value"))
    return box_lines(raw)


def entities(spark: SparkSession, path: str, doc: str | None = None) -> DataFrame:
    """Entities of documents: doc (see ``boxes``), place (order in the file), name, value."""
    raw = spark.read.text(path, wholetext=True).select((F.col(doc) if doc else _stem()).alias("doc"), F.from_json("value", "map<string,string>").alias("m"))
    return raw.select("doc", F.posexplode(F.map_entries("m")).alias("place", "e")).select("doc", "place", F.col("e.key").alias("name"), F.col("e.value").alias("value"))


def mailbox(mails: DataFrame, sender: str, day: str) -> DataFrame:
    """The sender's mails of one day: both predicates reach the scan."""
    start = F.to_timestamp(F.lit(day))
    return mails.where((F.col("sender") == sender) & (F.col("received") >= start) & (F.col("received") < start + F.expr("interval 1 day")))


def save_index(items: DataFrame, path: str) -> None:
    """An inventory by category: a search in one category reads only its folder."""
    items.write.mode("overwrite").partitionBy("category").parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def load_or_build(spark: SparkSession, path: str, build) -> DataFrame:
    """The saved index if there is one with rows, else ``build()``, saved."""
    from pyspark.errors import AnalysisException

    try:
        found = load_index(spark, path)
        if found.take(1):
            return found
    except AnalysisException:
        pass
    save_index(build(), path)
    return load_index(spark, path)


def save_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def _finite(value: Column, kind: DataType) -> Column:
    if isinstance(kind, DoubleType | FloatType):
        return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: _finite(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.transform_values(value, lambda _, x: _finite(x, kind.valueType))
    if isinstance(kind, StructType):
        return F.when(value.isNotNull(), F.struct(*[_finite(value[f.name], f.dataType).alias(f.name) for f in kind]))
    return value


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under ``spark.checkpoint.dir``, which driver and executors share; on one machine alone a
    temporary folder does where that is not set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.gettempdir() + "/checkpoints"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: what reads them again does not make them again."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, key: str) -> DataFrame:
    """The rows by ``key`` in a set number of partitions. A repartition by columns alone is coalesced by bytes, so that one
    task is left to write all of many small files."""
    session = df.sparkSession
    return df.repartition(max(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism), F.col(f"`{key}`"))


def save_files(contents: DataFrame, path: str, key: str = "name", content: str = "content") -> None:
    """A file for each row, in a folder ``key=value`` of its own, with the binary content and a line feed after it, which no
    reader of images minds. Spark's own writer commits them, on whatever file system ``path`` names: a task that fails or
    runs twice leaves nothing behind. Null contents give no file; rows that share a key share a file."""
    held = contents.where(F.col(f"`{content}`").isNotNull()).select(F.col(f"`{key}`"), F.col(f"`{content}`").cast("binary").cast("string").alias("value"))
    dealt(held, key).write.partitionBy(key).text(path)


def as_json(df: DataFrame, name: str = "response") -> DataFrame:
    """One JSON document for each row; not-a-number and infinite values become null, however deep they lie."""
    clean = [_finite(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema]
    return df.select(F.to_json(F.struct(*clean), {"ignoreNullFields": "false"}).alias(name))


def save_processed(images: DataFrame, path: str) -> None:
    """Transformed images under names of an id and the time of processing. A reader takes up to 4,096 rows of a row group at a
    time, and a writer holds one, so row groups are small: memory does not grow with the images of a file."""
    images.withColumn("name", F.concat(F.substr(F.sha2(F.col("path"), 256), F.lit(1), F.lit(8)), F.lit("_"), F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss"), F.lit(".jpg"))).write.mode("append").options(**IMAGE_GROUPS).parquet(path)
