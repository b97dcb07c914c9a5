import json
import struct
import zlib
from collections import Counter

import pandas as pd
from pyspark.sql import functions as F

from evidentia import streaming
from evidentia.operators import models
from evidentia.operators.catalog import weak_labels
from evidentia.session import session
from evidentia.sources import files


def _png(path, height=2, width=3):
    raw = b"".join(b"\0" + bytes([10, 20, 30] * width) for _ in range(height))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_readers(spark, tmp_path):
    pictures = tmp_path / "in"
    pictures.mkdir()
    _png(pictures / "1.PNG")
    (pictures / "2.jpg").write_bytes(b"no image")
    (pictures / "3.bmp").write_bytes(b"x")
    (pictures / "4.txt").write_text("hello")
    image = files.images(spark, f"{pictures}/1.PNG").first()
    assert (image.height, image.width, image.channels, bytes(image.data)[:3]) == (2, 3, 3, bytes([30, 20, 10]))
    assert files.images(spark, str(pictures)).count() == 1
    assert files.files(spark, str(pictures)).count() == 2 and files.files(spark, str(pictures), files.IMAGE_SUFFIXES_BMP).count() == 3
    assert files.files(spark, str(pictures), glob="*.jpg").count() == 1
    assert files.text_files(spark, f"{pictures}/4.txt").first().text == "hello"
    (tmp_path / "m.csv").write_text("id,colour\n1,red\nx,blue\n3,green\n")
    assert files.metadata_csv(spark, str(tmp_path / "m.csv"), "id int, colour string").select("id").dropna().count() == 2
    (tmp_path / "box").mkdir()
    (tmp_path / "ent").mkdir()
    (tmp_path / "box/d1.txt").write_text("1,2,3,4,5,6,7,8,ACME\n9,9,9,9,9,9,9,9,none\r\n")
    (tmp_path / "ent/d1.txt").write_text(json.dumps({"company": "ACME LTD", "date": "x"}, indent=1))
    labelled = weak_labels(files.boxes(spark, str(tmp_path / "box")), files.entities(spark, str(tmp_path / "ent"))).collect()
    assert [tuple(r) for r in labelled] == [("d1", 0, "ACME", 1, 2, 5, 6, 0)]
    mails = spark.sql("select 'a' sender, timestamp '2025-01-05 23:59:59' received union all select 'a', timestamp '2025-01-06 00:00:00' union all select 'b', timestamp '2025-01-05 01:00:00'")
    assert files.mailbox(mails, "a", "2025-01-05").count() == 1


def test_writers(spark, tmp_path):
    items = spark.createDataFrame([("a", "x", 1.5), ("b", "y", float("nan"))], "filename string, category string, score double")
    made = []
    for _ in range(2):
        assert files.load_or_build(spark, str(tmp_path / "index"), lambda: made.append(1) or items).count() == 2
    assert made == [1]
    plan = files.load_index(spark, str(tmp_path / "index")).where("category = 'x'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(category" in plan
    files.save_csv(items, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2
    assert {r.response for r in files.as_json(items).collect()} == {'{"filename":"a","category":"x","score":1.5}', '{"filename":"b","category":"y","score":null}'}
    files.save_processed(items.select(F.col("filename").alias("path")), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where("name rlike '^[0-9a-f]{8}_[0-9]{8}_[0-9]{6}[.]jpg$'").count() == 2
    assert session().conf.get("spark.sql.session.timeZone") == "UTC"


def test_models(spark):
    def load():
        return lambda texts: texts.map(lambda t: None if t is None else '{"amount": "7"}' if "é" not in t else "blocked")

    models.register_llm("fake", load)
    models.register_ocr("upper", lambda: lambda b: b.map(lambda x: bytes(x).decode().upper()))
    models.register_embedder("size", lambda: lambda t: t.map(lambda x: [float(len(x))]))
    df = spark.createDataFrame([("total 7",), ("café 7",)], "text string")
    got = {r.text: (r.answer.amount, r.answer_source) for r in models.extract_with_model(df, "fake").collect()}
    assert got == {"total 7": ("7", "llm"), "café 7": ("7", "llm_retry")}
    assert df.select(models.apply("ocr", "upper", F.col("text").cast("binary")).alias("r")).first().r == "TOTAL 7"
    assert df.select(models.apply("embed", "size", F.col("text")).alias("r")).first().r == [7.0]
    assert isinstance(pd.Series([1]), pd.Series)


def test_streams(spark, tmp_path):
    spark.createDataFrame([(1, "Invoice No: TD123456\nDate: 15/01/2024\nTotal: 9.99"), (2, "nothing")], "case_id long, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("case_id long, text string").parquet(str(tmp_path / "in"))
    streaming.verify_stream(stream, str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination(60)
    assert {r.case_id: r.verification_status for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1: "verified", 2: "failed"}
    streaming.for_each_batch(stream, lambda b: b.withColumn("n", F.length("text")), str(tmp_path / "each"), str(tmp_path / "c2")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "each")).count() == 2
    tid = "0123456789abcdef01234567"
    spark.createDataFrame([(1, f"TransactionID {tid}", "2025-01-01 10:00:00"), (2, "none", "2025-01-01 11:00:00"), (3, "none", "2025-01-09 11:00:00")], "case_id long, text string, arrived string").withColumn("arrived", F.to_timestamp("arrived")).write.parquet(str(tmp_path / "r"))
    spark.createDataFrame([("m1", f"Transaction ID {tid} Rs 5", "2025-01-01 12:00:00"), ("m2", "x", "2025-01-09 12:00:00")], "id string, body string, received string").withColumn("received", F.to_timestamp("received")).write.parquet(str(tmp_path / "m"))
    ours = spark.readStream.schema("case_id long, text string, arrived timestamp").parquet(str(tmp_path / "r"))
    theirs = spark.readStream.schema("id string, body string, received timestamp").parquet(str(tmp_path / "m"))
    q = streaming.paired_stream(ours, theirs).writeStream.format("memory").queryName("paired").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert {(r.case_id, r.id) for r in spark.table("paired").collect()} >= {(1, "m1")}


def test_many_files_are_written_by_several_tasks(spark, tmp_path):
    """Small contents: a shuffle that is coalesced by bytes would leave all files to one task."""
    rows = spark.range(60).select(F.col("id").alias("name"), F.lit(b"x").alias("content"))
    files.save_files(rows, str(tmp_path / "each"))
    tasks = Counter(p.name.split("-")[1] for p in (tmp_path / "each").rglob("part-*"))
    assert sum(tasks.values()) == 60 and len(tasks) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_processed_images_lie_in_small_row_groups(spark, tmp_path):
    """Whether they pack well or not: what reads a row group holds up to 4,096 rows of it."""
    import glob

    import pyarrow.parquet as pq

    images = spark.range(0, 300, 1, 1).select(F.col("id").cast("string").alias("path"), F.when(F.col("id") < 150, F.repeat(F.lit("w"), 160_000)).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(3000)), lambda x: F.md5(F.concat(x.cast("string"), F.col("id").cast("string")))), "")).cast("binary").alias("data"))
    files.save_processed(images, str(tmp_path / "out"))
    (part,) = glob.glob(str(tmp_path / "out" / "*.parquet"))
    found = pq.ParquetFile(part).metadata
    sizes = [(found.row_group(n).num_rows, found.row_group(n).total_byte_size) for n in range(found.num_row_groups)]
    assert sum(n for n, _ in sizes) == 300 and max(n for n, _ in sizes) <= 64 and max(b for _, b in sizes) < 12_000_000
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum(F.length("data"))).first()[0] == 150 * 160_000 + 150 * 96_000
