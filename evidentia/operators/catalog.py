"""Catalogue metadata: filters, joins on file stems, samples, weak labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The product classes that are searched, and the numbers of the classes of weak labels.
MASTER_CATEGORY = "Apparel"
SUBCATEGORIES = ("Topwear", "Bottomwear", "Saree", "Dress", "Loungewear", "Nightwear", "Apparel Set", "Mufflers", "Gloves")
CLASSES = {"company": 0, "date": 1, "total": 2, "address": 3}


def with_metadata(items: DataFrame, metadata: DataFrame, columns: list[str]) -> DataFrame:
    """Items with the columns of the metadata row whose ``id`` is the number that the file's name begins with;
    ``unknown`` where there is none."""
    number = F.expr("try_cast(regexp_extract(filename, '^(\\\\d+)\\\\.', 1) as bigint)")
    joined = items.withColumn("_id", number).join(metadata.dropna(subset=["id"]).select(F.col("id").alias("_meta"), *columns), F.col("_id") == F.col("_meta"), "left")
    return joined.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("unknown")) for c in columns}).drop("_id", "_meta")


def apparel(metadata: DataFrame, master: str = "masterCategory", sub: str = "subCategory") -> DataFrame:
    """Metadata rows of the product classes that are searched."""
    return metadata.where((F.col(master) == MASTER_CATEGORY) & F.col(sub).isin(*SUBCATEGORIES))


def sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """``n`` rows in the order of a hash of their key: the same ones every time, whatever the partitions."""
    return df.orderBy(F.md5(F.col(key).cast("string")), key).limit(n)


def weak_labels(boxes: DataFrame, entities: DataFrame) -> DataFrame:
    """Boxes (doc, line_no, word, x1, y1, x2, y2) with the class of the first entity (doc, place, name, value) whose value
    contains the word; words without one go. Entities are few for each document; the join is on the document."""
    classes = F.create_map(*[F.lit(x) for kv in CLASSES.items() for x in kv])
    hit = boxes.join(entities.select("doc", "place", "name", "value"), "doc").where(F.col("value").contains(F.col("word")))
    first = F.row_number().over(Window.partitionBy("doc", "line_no").orderBy("place"))
    return hit.withColumn("_n", first).where("_n = 1").select("doc", "line_no", "word", "x1", "y1", "x2", "y2", F.element_at(classes, F.col("name")).alias("class_id"))


def box_lines(raw: DataFrame) -> DataFrame:
    """Comma-separated box lines (doc, line_no, value): corners one and three, and the last field as the word."""
    parts = F.split(F.trim("value"), ",")
    at = lambda i: F.try_element_at(parts, F.lit(i + 1)).cast("int")
    return raw.select("doc", "line_no", at(0).alias("x1"), at(1).alias("y1"), at(4).alias("x2"), at(5).alias("y2"), F.try_element_at(parts, F.lit(-1)).alias("word"))
