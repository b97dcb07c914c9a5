"""Sources, sinks, plugged-in models and image operators, each written to the shared folder where it reads files."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import decimals
from ..functions.vectors import unit
from ..operators import batch, catalog, extraction, imaging, models, reconcile, search
from ..sources import derived, files
from . import evidence, retrieval

#: The day of the mailbox scan, and the mailbox's own sender.
MAIL_DAY = "1995-03-15"


def _png(bgr: np.ndarray) -> bytes:
    height, width, _ = bgr.shape
    rows = b"".join(b"\0" + row.tobytes() for row in bgr[:, :, ::-1])
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def _painted_files(spark: SparkSession, d: str) -> str:
    """A folder with a PNG file for each vector; every fiftieth is no image."""
    path = files.shared_folder(spark, "images")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [b"no image" if r.vec_id % 50 == 0 else _png(imaging.decode(r.data, r.height, r.width, r.channels)) for r in batch.itertuples(index=False)]
            yield pd.DataFrame({"vec_id": batch["vec_id"], "content": made})

    files.save_files(retrieval._images(spark, d).mapInPandas(encode, "vec_id long, content binary"), path, "vec_id")
    return path


def _samples(data: Column, step: int, first: int, width: int, channels: int, channel: int = 0) -> Column:
    """The values of an image's 64 tiles, ``step`` pixels apart, as a text."""
    place = lambda n: ((first + step * F.floor(n / 8)) * width + first + step * (n % 8)) * channels + channel + 1
    value = lambda n: F.conv(F.hex(F.substring(data, place(n).cast("int"), F.lit(1))), 16, 10)
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), value), ",")


def image_files(spark: SparkSession, d: str) -> DataFrame:
    """Image files read and decoded; files that are no images go."""
    found = files.images(spark, _painted_files(spark, d))
    own = F.regexp_extract("path", r"vec_id=(\d+)/", 1).cast("long").alias("vec_id")
    tiles = [_samples(F.col("data"), 3, 1, 24, 3, c).alias(name) for c, name in enumerate(("blue", "green", "red"))]
    return found.select(own, "height", "width", "channels", F.length("data").alias("n_bytes"), *tiles)


def file_scan(spark: SparkSession, d: str) -> DataFrame:
    """One file for each category and ending; how many files and categories each way of scanning finds."""
    path = files.shared_folder(spark, "scan")
    rows = derived.inventory(spark, d).select("category", "filename").repartition("category")
    for ending in ("jpg", "PNG", "bmp", "txt"):
        rows.write.mode("append").partitionBy("category").option("extension", ending).csv(path)
    ways = {"suffix": files.files(spark, path), "suffix_bmp": files.files(spark, path, files.IMAGE_SUFFIXES_BMP), "glob": files.files(spark, path, glob="*.jpg")}
    found = [df.select(F.lit(way).alias("way"), "path") for way, df in ways.items()]
    every = found[0].unionByName(found[1]).unionByName(found[2])
    return every.groupBy("way").agg(F.count(F.lit(1)).alias("n_files"), F.count_distinct(F.regexp_extract("path", "category=([^/]*)/", 1)).alias("n_categories"))


def text_scan(spark: SparkSession, d: str) -> DataFrame:
    """A text file for each supplier, read as one string."""
    path = files.shared_folder(spark, "texts")
    text = F.concat_ws("\n", "s_name", F.lit("said é"), F.col("s_suppkey").cast("string"))
    files.dealt(derived.table(spark, d, "supplier").select("s_suppkey", text.alias("value")), "s_suppkey").write.partitionBy("s_suppkey").text(path)
    found = files.text_files(spark, path)
    return found.select(F.regexp_extract("path", r"s_suppkey=(\d+)/", 1).cast("long").alias("s_suppkey"), F.rtrim(F.regexp_replace("text", "\n", "|")).alias("text"))


def mailbox_day(spark: SparkSession, d: str) -> DataFrame:
    """One sender's mails of one day."""
    return files.mailbox(derived.mails(spark, d), derived.SENDER, MAIL_DAY).select("id", "sender", "received", "amount")


def metadata_scan(spark: SparkSession, d: str) -> DataFrame:
    """A CSV file with header; every seventh line has no number where one belongs and goes."""
    path = files.shared_folder(spark, "metadata")
    size = F.when(F.col("p_partkey") % 7 == 0, "large").otherwise(F.col("p_size").cast("string"))
    files.save_csv(derived.table(spark, d, "part").select("p_partkey", "p_name", size.alias("p_size")), path)
    return files.metadata_csv(spark, path, "p_partkey long, p_name string, p_size int")


def annotation_scan(spark: SparkSession, d: str) -> DataFrame:
    """A file of boxes and one of entities for each supplier, read and labelled."""
    rows = files.dealt(derived.table(spark, d, "supplier").select(F.col("s_suppkey").alias("doc"), F.col("s_name").alias("name"), F.col("s_suppkey").cast("string").alias("key")), "doc")
    boxes, entities = files.shared_folder(spark, "boxes"), files.shared_folder(spark, "entities")
    line = lambda x, word: F.concat(F.lit(f"{x},2,9,9,7,8,9,9,"), word)
    rows.select("doc", F.concat_ws("\n", line(1, F.col("name")), F.lit(" "), line(3, F.col("key")), line(5, F.lit("none")))).write.partitionBy("doc").text(boxes)
    rows.select("doc", F.to_json(F.struct(F.col("name").alias("company"), F.concat(F.lit("<"), "key", F.lit(">")).alias("total")))).write.partitionBy("doc").text(entities)
    return catalog.weak_labels(files.boxes(spark, boxes, "doc"), files.entities(spark, entities, "doc")).withColumn("doc", F.col("doc").cast("long"))


def detection_csv(spark: SparkSession, d: str) -> DataFrame:
    """K4: weak labels written as CSV and read again."""
    path = files.shared_folder(spark, "detections")
    found = retrieval.weak_labels(spark, d)
    files.save_csv(found, path)
    return files.metadata_csv(spark, path, ", ".join(f"{c} {t}" for c, t in found.dtypes))


def processed_images(spark: SparkSession, d: str) -> DataFrame:
    """K2: preprocessed images saved under names of an id and the time, and read again."""
    path = files.shared_folder(spark, "processed")
    made = imaging.transformed(retrieval._images(spark, d).withColumn("method", F.lit("visual_search")), "vec_id")
    files.save_processed(made.withColumn("path", F.col("vec_id").cast("string")), path)
    named = F.col("name").rlike(r"^[0-9a-f]{8}_\d{8}_\d{6}\.jpg$") & F.col("name").startswith(F.substring(F.sha2("path", 256), 1, 8))
    return spark.read.parquet(path).select("vec_id", named.alias("named"), "height", "width", F.length("data").alias("n_bytes"), _samples(F.col("data"), 50, 25, 400, 1).alias("tiles"))


def json_response(spark: SparkSession, d: str) -> DataFrame:
    """K5, K6: a response for each order; numbers that JSON has no form for are null at any depth."""
    k = F.col("o_orderkey")
    odd = F.when(k % 3 == 0, F.lit(float("nan"))).when(k % 3 == 1, F.lit(float("inf"))).otherwise(F.lit(0.5))
    hit = F.struct(F.col("o_orderstatus").alias("name"), odd.alias("score"), F.lit(None).cast("string").alias("note"))
    rows = derived.table(spark, d, "orders").select(k.alias("case_id"), odd.alias("confidence"), F.array(hit, hit).alias("hits"))
    return files.as_json(rows)


def image_variants(spark: SparkSession, d: str) -> DataFrame:
    """Five readings of each image."""
    tiles = F.when(F.col("variant_no") == 0, _samples(F.col("data"), 3, 1, 24, 1))
    return imaging.with_variants(retrieval._images(spark, d), "vec_id").select("vec_id", "variant_no", "height", "width", F.length("data").alias("n_bytes"), tiles.alias("tiles"))


def color_histograms(spark: SparkSession, d: str) -> DataFrame:
    """The histogram of each image. A channel is a mirrored copy of the others, so its counts are theirs."""
    found = imaging.with_histogram(retrieval._images(spark, d), "vec_id")
    squares = F.aggregate("histogram", F.lit(0.0), lambda a, x: a + x * x)
    return found.select("vec_id", F.size("histogram").alias("bins"), F.round(squares, 6).alias("squares"))


def perturbed_queries(spark: SparkSession, d: str) -> DataFrame:
    """Each image as a user might take it, between 70 and 90 % of it, the same one again at a rerun."""
    images = retrieval._images(spark, d)
    made, again = imaging.with_perturbation(images, "vec_id"), imaging.with_perturbation(images.repartition(3), "vec_id")
    same = made.join(again.select("vec_id", F.md5("data").alias("digest")), "vec_id")
    fits = lambda side: F.col(side).between(16, 21)  # noqa: E731  24 times 0.7 to 0.9, cut
    return same.select("vec_id", (fits("height") & fits("width")).alias("fits"), (F.length("data") == F.col("height") * F.col("width") * 3).alias("whole"), (F.md5("data") == F.col("digest")).alias("repeats"))


def _echo(batch: pd.Series) -> pd.Series:
    return batch.map(lambda b: None if b is None else b.decode().upper())


def _two_numbers(batch: pd.Series) -> pd.Series:
    return batch.map(lambda t: None if t is None else [float(len(t)), float(t.count("1"))])


def _answers(batch: pd.Series) -> pd.Series:
    """A language model that refuses texts with a section sign, breaks off at two commas and knows no answer to "never"."""

    def answer(text: str | None) -> str | None:
        if text is None or "never" in text:
            return None
        if "§" in text:
            return "cannot say"
        return '{"transaction_id": "' + text.split()[-1] + '", "amount": "1.00"' + ("" if ",," in text else "}")

    return batch.map(answer)


def model_ocr(spark: SparkSession, d: str) -> DataFrame:
    """M1, M2: an OCR engine over image bytes; null stays null."""
    models.register_ocr("echo", lambda: _echo)
    content = F.when(F.col("s_suppkey") % 5 != 0, F.col("s_name").cast("binary"))
    return derived.table(spark, d, "supplier").select("s_suppkey", models.apply("ocr", "echo", content).alias("text"))


def model_embedding(spark: SparkSession, d: str) -> DataFrame:
    """M4, M5: an embedder, its vectors brought to length 1."""
    models.register_embedder("two", lambda: _two_numbers)
    made = derived.table(spark, d, "part").withColumn("v", models.apply("embed", "two", F.col("p_name")).cast("array<double>"))
    vector = unit(F.col("v"))
    return made.select("p_partkey", F.round(vector[0], 6).alias("a"), F.round(vector[1], 6).alias("b"))


def model_extraction(spark: SparkSession, d: str) -> DataFrame:
    """Fields by a language model, asked again with the sanitised text where its answer could not be read."""
    models.register_llm("stub", lambda: _answers)
    k = F.col("o_orderkey")
    text = F.concat(F.when(k % 4 == 1, "§ ").when(k % 4 == 2, ",, ").when(k % 4 == 3, "never ").otherwise(""), F.lit("paid T"), k.cast("string"))
    found = models.extract_with_model(derived.table(spark, d, "orders").select(k.alias("case_id"), F.when(k % 40 != 0, text).alias("text")), "stub")
    return found.select("case_id", F.col("answer.transaction_id").alias("transaction_id"), F.col("answer.amount").alias("amount"), "answer_source")


def apparel_filter(spark: SparkSession, d: str) -> DataFrame:
    """The product classes that are searched."""
    classes = ["Topwear", "Shoes", "Bottomwear", "Saree", "Bags", "Dress", "Loungewear", "Nightwear", "Apparel Set", "Mufflers", "Gloves", "topwear"]
    k = F.col("p_partkey")
    rows = derived.table(spark, d, "part").select("p_partkey", F.when(k % 5 == 0, "Footwear").when(k % 31 != 0, "Apparel").alias("masterCategory"), F.get(F.array(*map(F.lit, classes)), (k % len(classes)).cast("int")).alias("subCategory"))
    return catalog.apparel(rows)


def metrics_rounded(spark: SparkSession, d: str) -> DataFrame:
    """Metrics with two decimals."""
    m = derived.metrics(spark, d)
    return m.select("order_id", "line_no", *[decimals(F.col(c) / 7).alias(c) for c in ("noise", "contrast", "brightness", "blur")])


def first_total_token(spark: SparkSession, d: str) -> DataFrame:
    """The first token of the first line like a keyword."""
    rows = derived.receipts(spark, d).select("case_id", F.split("text", "\r?\n").alias("segments"))
    return extraction.first_token(rows, "case_id", "segments", ["total"], 90)


def shown_confidence(spark: SparkSession, d: str) -> DataFrame:
    """What a front end shows for a receipt's status."""
    found = extraction.parse_receipts(derived.receipts(spark, d))
    return found.select("case_id", "verification_status", reconcile.shown_confidence(F.col("verification_status")).alias("shown"))


def partial_mail_score(spark: SparkSession, d: str) -> DataFrame:
    """V8: the score without a mail, with one, and with one whose source lacks a field."""
    k = F.col("o_orderkey")
    at, paid = F.col("o_orderdate").cast("timestamp"), F.floor("o_totalprice").cast("bigint")
    mail = F.struct(F.lit("T1").alias("transaction_id"), paid.alias("amount"), at.alias("timestamp"))
    rows = derived.table(spark, d, "orders").select(
        k.alias("case_id"), F.lit(False).alias("fraud"), F.lit(60).alias("ocr_score"), paid.alias("amount"), F.lit("T1").alias("transaction_id"), at.alias("timestamp"), F.lit(None).cast("string").alias("receiver"),
        F.when(k % 3 != 0, mail).alias("mail"), paid.alias("chat_amount"), F.lit(None).cast("timestamp").alias("chat_time"), F.when(k % 3 == 1, F.array(F.lit("amount"), F.lit("timestamp"))).otherwise(F.array(*map(F.lit, reconcile.MAIL_KEYS))).alias("keys"),
    )
    return rows.select("case_id", reconcile.confidence(derived.MERCHANT, keys=F.col("keys")).alias("confidence"))


def ivf_by_category(spark: SparkSession, d: str) -> DataFrame:
    """Cells for each category, and a flat search in small ones."""
    items = derived.inventory(spark, d)
    found = search.probed_by_category(derived.queries(spark, d), items, search.category_cells(items), 3)
    return found.select("query_id", "filename", "rank_no", "score")


def _batch(spark: SparkSession, d: str) -> DataFrame:
    """Receipts as payloads; some are missing, no base64, empty or no UTF-8."""
    k = F.col("case_id")
    sent = F.base64(F.encode("text", "UTF-8"))
    broken = F.when(k % 11 == 0, F.lit(None)).when(k % 11 == 1, F.concat(F.lit("%"), sent)).when(k % 11 == 2, F.lit("")).when(k % 11 == 3, F.base64(F.unhex(F.lit("54ff fe".replace(" ", ""))))).otherwise(sent)
    return batch.verified_batch(derived.receipts(spark, d).select("case_id", broken.alias("payload")))


def verify_batch(spark: SparkSession, d: str) -> DataFrame:
    """A batch with broken payloads, written with the broken rows apart, and read again."""
    path = files.shared_folder(spark, "batch")
    batch.save_batch(_batch(spark, d), path)
    return batch.read_batch(spark, path).select("case_id", "transaction_id", "amount", "date", "verification_status", "error", "quarantined")


def batch_totals(spark: SparkSession, d: str) -> DataFrame:
    """The totals that were counted as the batch was written."""
    totals = batch.save_batch(_batch(spark, d), files.shared_folder(spark, "batch"))
    return spark.createDataFrame([tuple(totals.values())], ", ".join(f"{k} long" for k in totals))


BATCH_SQL = f"""with {evidence.FIELDS}, b as (
    select *, case case_id % 11 when 0 then 'no payload' when 1 then 'not base64' when 2 then 'empty payload' when 3 then 'not UTF-8' end as error from f
)"""
TILES_SQL = """with e as (select vec_id, list_transform(range(64), lambda n: trunc(least(255, greatest(0, (embedding[n + 1]::double + 0.4) * 320)))::int) as t from embeddings),
c as (select vec_id, t as b, list_transform(range(64), lambda n: t[(7 - n // 8) * 8 + n % 8 + 1]) as g, list_transform(range(64), lambda n: t[(n // 8) * 8 + 8 - n % 8]) as r from e),
y as (select *, array_to_string(list_transform(range(1, 65), lambda n: floor(0.114::double * b[n] + 0.587::double * g[n] + 0.299::double * r[n] + 0.5::double)::int), ',') as grey from c)"""
FILES_SQL = "with c as (select count(distinct label) as n from embeddings) select way, n * f as n_files, n as n_categories from c, (values ('suffix', 2), ('suffix_bmp', 3), ('glob', 1)) w(way, f)"
MAILS_SQL = f"""
with c as (
    select o_orderkey, lpad(o_orderkey::varchar, 7, '0') as key, floor(o_totalprice)::bigint as rupees, (o_orderkey // 10) % 10 as e,
        date_trunc('day', o_orderdate) + to_minutes((o_orderkey % 1300)::int + 3) as received from orders
)
select 'm' || key as id, '{derived.SENDER}' as sender, received, rupees + case when e = 1 then 10 else 0 end as amount from c where e not in (0, 7) and received::date = date '{MAIL_DAY}'"""
LABELS_SQL = """
with b as (select s_suppkey, s_name, unnest([0, 1, 2]) as i from supplier)
select s_suppkey as doc, i::int as line_no, case i when 0 then s_name else s_suppkey::varchar end as word, (2 * i + 1)::int as x1, 2::int as y1, 7::int as x2, 8::int as y2,
    case when i = 0 or contains(s_name, s_suppkey::varchar) then 0 else 2 end::int as class_id from b where i < 2"""
JSON_SQL = """
with o as (select o_orderkey as k, o_orderstatus as s, case when o_orderkey % 3 = 2 then '0.5' else 'null' end as x from orders),
h as (select k, x, '{"name":"' || s || '","score":' || x || ',"note":null}' as hit from o)
select '{"case_id":' || k || ',"confidence":' || x || ',"hits":[' || hit || ',' || hit || ']}' as response from h"""
SIZES_SQL = TILES_SQL + ", v as (select vec_id, grey, unnest(range(5)) as variant_no from y), s as (select *, case when variant_no = 4 then 36 else 24 end::int as side from v) select vec_id, variant_no::int as variant_no, side as height, side as width, side * side as n_bytes, case when variant_no = 0 then grey end as tiles from s"
EMBED_SQL = "with v as (select p_partkey, length(p_name)::double as x, (length(p_name) - length(replace(p_name, '1', '')))::double as y from part) select p_partkey, round(x / sqrt(x * x + y * y), 6) as a, round(y / sqrt(x * x + y * y), 6) as b from v"
ANSWERS_SQL = "with o as (select o_orderkey as k, o_orderkey % 4 as m, o_orderkey % 40 = 0 as none from orders) select k as case_id, case when m <> 3 and not none then 'T' || k end as transaction_id, case when m <> 3 and not none then '1.00' end as amount, case when none or m = 3 then null when m = 1 then 'llm_retry' else 'llm' end as answer_source from o"
APPAREL_SQL = "with p as (select p_partkey, case when p_partkey % 5 = 0 then 'Footwear' when p_partkey % 31 <> 0 then 'Apparel' end as m, ['Topwear', 'Shoes', 'Bottomwear', 'Saree', 'Bags', 'Dress', 'Loungewear', 'Nightwear', 'Apparel Set', 'Mufflers', 'Gloves', 'topwear'][p_partkey % 12 + 1] as s from part) select p_partkey, m as \"masterCategory\", s as \"subCategory\" from p where p_partkey % 5 <> 0 and p_partkey % 31 <> 0 and p_partkey % 12 not in (1, 4, 11)"
ROUND_SQL = "select l_orderkey as order_id, l_linenumber as line_no, " + ", ".join(f"round(((l_orderkey * {a} + l_linenumber * {b}) % 101)::double / 7, 2) as {c}" for c, a, b in (("noise", 7, 13), ("contrast", 11, 29), ("brightness", 3, 17), ("blur", 19, 5))) + " from lineitem"
QUERIES = {
    "image_files": (image_files, TILES_SQL + " select vec_id, 24::int as height, 24::int as width, 3::int as channels, 1728::int as n_bytes, array_to_string(b, ',') as blue, array_to_string(g, ',') as green, array_to_string(r, ',') as red from y where vec_id % 50 <> 0"),
    "verify_batch": (verify_batch, BATCH_SQL + " select case_id, case when error is null then transaction_id end as transaction_id, case when error is null then amount end as amount, case when error is null then date end as date, case when error is null then verification_status else 'error' end as verification_status, error, error is not null as quarantined from b"),
    "batch_totals": (batch_totals, BATCH_SQL + " select count(*) as total_processed, " + ", ".join(f"count(*) filter (error is null and verification_status = '{s}') as {s}" for s in batch.STATUSES[:3]) + ", count(error) as error from b"),
    "file_scan": (file_scan, FILES_SQL),
    "text_scan": (text_scan, "select s_suppkey, s_name || '|said é|' || s_suppkey || '|' as text from supplier"),
    "mailbox_day": (mailbox_day, MAILS_SQL),
    "metadata_scan": (metadata_scan, "select p_partkey, p_name, p_size::int as p_size from part where p_partkey % 7 <> 0"),
    "annotation_scan": (annotation_scan, LABELS_SQL),
    "detection_csv": (detection_csv, retrieval.QUERIES["weak_labels"][1]),
    "processed_images": (processed_images, TILES_SQL + " select vec_id, true as named, 400::int as height, 400::int as width, 160000::int as n_bytes, grey as tiles from y"),
    "json_response": (json_response, JSON_SQL),
    "image_variants": (image_variants, SIZES_SQL),
    "color_histograms": (color_histograms, "select vec_id, 96::int as bins, 1.0::double as squares from embeddings"),
    "perturbed_queries": (perturbed_queries, "select vec_id, true as fits, true as whole, true as repeats from embeddings"),
    "model_ocr": (model_ocr, "select s_suppkey, case when s_suppkey % 5 <> 0 then upper(s_name) end as text from supplier"),
    "model_embedding": (model_embedding, EMBED_SQL),
    "model_extraction": (model_extraction, ANSWERS_SQL),
    "apparel_filter": (apparel_filter, APPAREL_SQL),
    "metrics_rounded": (metrics_rounded, ROUND_SQL),
    "first_total_token": (first_total_token, "select o_orderkey as case_id, case when o_orderkey % 10 in (4, 9) then 'Grand' else 'Total' end as value from orders where o_orderkey % 10 in (0, 1, 3, 4, 5, 6, 9)"),
    "shown_confidence": (shown_confidence, "select o_orderkey as case_id, case when o_orderkey % 10 <= 6 then 'verified' when o_orderkey % 10 = 8 then 'failed' else 'partial' end as verification_status, case when o_orderkey % 10 <= 6 then 95 when o_orderkey % 10 = 8 then 30 else 70 end::int as shown from orders"),
    "partial_mail_score": (partial_mail_score, "select o_orderkey as case_id, case o_orderkey % 3 when 0 then 20.0 when 1 then 95.0 else 100.0 end::double as confidence from orders"),
    "ivf_by_category": (ivf_by_category, retrieval.QUERIES["topk_category"][1]),
}
