"""Broken payloads stand apart; totals come with the write; files are committed as a whole or not at all."""

import base64
import glob

import pytest
from pyspark.sql import functions as F

from evidentia.operators.batch import decoded_payloads, read_batch, save_batch, verified_batch
from evidentia.sources.files import files, images, save_files

WHOLE = "Invoice No: TD0000017\nDate: 01/02/2024\nTotal: 12.50"
coded = lambda t: base64.b64encode(t if isinstance(t, bytes) else t.encode()).decode()
ROWS = [(1, coded(WHOLE)), (2, None), (3, "%%%"), (4, ""), (5, coded(b"\xff\xfe")), (6, coded("Thank you")), (7, coded("Total: 3.00")), (1, coded(WHOLE)), (8, coded("naïve 日本"))]


def test_only_broken_rows_are_errors(spark, tmp_path):
    batch = spark.createDataFrame([(*r, "kept") for r in ROWS], "case_id long, payload string, note string")
    got = sorted((r.case_id, r.verification_status, r.error, r.note) for r in verified_batch(batch).collect())
    assert got == [(1, "verified", None, "kept"), (1, "verified", None, "kept"), (2, "error", "no payload", "kept"), (3, "error", "not base64", "kept"), (4, "error", "empty payload", "kept"), (5, "error", "not UTF-8", "kept"), (6, "failed", None, "kept"), (7, "partial", None, "kept"), (8, "failed", None, "kept")]
    path = str(tmp_path / "batch")
    totals = save_batch(verified_batch(batch), path)
    assert totals == {"total_processed": 9, "verified": 2, "partial": 1, "failed": 2, "error": 4}
    back = read_batch(spark, path)
    assert {r.case_id for r in back.where("quarantined").collect()} == {2, 3, 4, 5}
    assert "quarantined" in back.where("quarantined")._jdf.queryExecution().executedPlan().toString()
    assert back.where(F.col("error").isNotNull() != F.col("quarantined")).count() == 0
    assert [r.text for r in decoded_payloads(batch.where("case_id = 8")).collect()] == ["naïve 日本"]
    assert save_batch(verified_batch(batch.limit(0)), str(tmp_path / "none"))["total_processed"] == 0


def test_files_hold_their_bytes(spark, tmp_path):
    rows = [(i, bytes(range(256)) * (i % 3) + b"\r\n\0\xff" * i) for i in range(12)] + [(99, None)]
    save_files(spark.createDataFrame(rows, "name long, content binary"), str(tmp_path / "f"))
    for name, content in rows:
        found = glob.glob(f"{tmp_path}/f/name={name}/*")
        assert [open(f, "rb").read() for f in found] == ([content + b"\n"] if content is not None else [])
    save_files(spark.createDataFrame(rows[:3], "name long, content binary"), f"file:{tmp_path}/g")
    assert files(spark, f"file:{tmp_path}/g", suffixes=(".txt",)).count() == 3
    assert images(spark, f"file:{tmp_path}/g").count() == 0


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    rows = spark.range(20).select(F.col("id").alias("name"), F.when(F.col("id") == 13, F.raise_error(F.lit("broken"))).otherwise(F.lit("x")).cast("binary").alias("content"))
    with pytest.raises(Exception, match="broken"):
        save_files(rows, str(tmp_path / "f"))
    assert [p for p in glob.glob(f"{tmp_path}/f/**/*", recursive=True) if "part-" in p and "_temporary" not in p] == []
