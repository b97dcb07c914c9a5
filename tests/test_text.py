"""Branch tables: one row for each outcome, expected values worked out by hand."""

import datetime

import pytest
from pyspark.sql import functions as F

from evidentia.functions import mail, text
from evidentia.operators import extraction, quality
from evidentia.plans.evidence import CANDIDATES


def _one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v")).alias("r")).first().r


def test_identifier_rules(spark):
    rows = spark.createDataFrame([*CANDIDATES, (None, "id", False), ("A1", "id", False), ("HELLOID", "id", False), ("1234", "zzz", False)], "c string, x string, want boolean")
    got = rows.select("c", "x", "want", text.is_transaction_id(F.col("c"), F.col("x")).alias("got")).collect()
    assert [(r.c, r.x, r.got) for r in got] == [(r.c, r.x, r.want) for r in got]


@pytest.mark.parametrize("value,want", [("12/05/2024", True), ("1-2-24", True), ("2024.1.31", True), ("5 jan", True), ("MAR 7", True), ("5 Jan 2024 x", True), ("2024", False), ("12/05", False), ("x12/05/2024", False), (None, False)])
def test_dates(spark, value, want):
    assert _one(spark, value, text.is_date) is want


@pytest.mark.parametrize("receipt,want", [
    ("Invoice No: TD01167104\nDate: 15/01/2024\nTotal: 99.99", ("TD01167104", "99.99", "15/01/2024", "verified")),
    ("Invoice No: INV-12345", ("1NV-12345", "12345", None, "partial")),
    ("Document No 4567 \nTotal 1,234.50", ("4567", "1,234.50", None, "partial")),
    ("Receipt No:\n  AB-77", ("AB-77", None, None, "partial")),
    ("nothing here", (None, None, None, "failed")),
    ("", (None, None, None, "failed")),
    (None, (None, None, None, "failed")),
    ("Date:\n03.04.23\nSum: $5", (None, "5", "03.04.23", "partial")),
    ("TXN: 99881", (None, "99881", None, "partial")),
])
def test_receipts(spark, receipt, want):
    r = extraction.parse_receipts(spark.createDataFrame([(receipt,)], "text string")).first()
    assert (r.transaction_id, r.amount, r.date, r.verification_status) == want


def test_context_of_short_words_is_what_stands_around(spark):
    far = "TXN: 1234" + " " * 60 + "invoice"
    near = "TXN: 1234 invoice"
    for value, want in ((far, None), (near, "1234"), ("order " + " " * 60 + "TXN: 12345 x TXN: 123456", "123456")):
        assert _one(spark, value, extraction.id_by_patterns) == want


def test_first_token_of_a_line_like_a_keyword(spark):
    rows = spark.createDataFrame([(1, ["shop", "Totai 5.00", "Total 6"]), (2, ["--"]), (3, [])], "case_id long, segments array<string>")
    assert [tuple(r) for r in extraction.first_token(rows, "case_id", "segments", ["total", "amount"]).collect()] == [(1, "Totai")]


def test_fuzzy_fields(spark):
    rows = spark.createDataFrame([(1, [" Tota1 due", "12.50", "Dat3", "03/04/2024"]), (2, ["Ticket no: AB12", "Balance - 7,000"]), (3, ["nothing", "to see"]), (4, ["Ref", "RECEIPT", "Reference", "X9-1"])], "case_id long, segments array<string>")
    got = {r.case_id: tuple(r)[1:] for r in extraction.parse_segments(rows).collect()}
    assert got[1][1:] == ("12.50", "03/04/2024") and got[2] == ("AB12", "7,000", None) and got[3] == (None, None, None) and got[4][0] == "X9-1"


@pytest.mark.parametrize("value,want", [("TD0O1lZvx-9yY", "fd00112y00900"), ("o" * 30, "0" * 24), ("", ""), (None, None)])
def test_identifier_repair(spark, value, want):
    assert _one(spark, value, text.repaired_id) == want


def test_digital_receipt(spark):
    tid = "0123456789abcdef01234567"
    r = _one(spark, f"Rs. 1,250\nTransactionID: {tid}\n05Nov20250330PM\nDestination Acc Title: Some Shop", text.digital_fields)
    assert (r.amount, r.transaction_id, r.timestamp, r.receiver, r.ocr_score) == (1250, tid, datetime.datetime(2025, 11, 5, 15, 30), "some shop", 100)
    r = _one(spark, "RS , nothing", text.digital_fields)
    assert (r.amount, r.transaction_id, r.timestamp, r.receiver, r.ocr_score) == (None, None, None, None, 0)
    r = _one(spark, "Trnsaction1D abcdefabcdefabcdefab\n05Nov20250330pm", text.digital_fields)
    assert (r.transaction_id, r.timestamp, r.ocr_score) == ("abcdefabcdefabcdefab", None, 25)
    # the label is misspelt, so the line is not read again; the next one has it right
    r = _one(spark, "Tranction1D abcdefabcdefabcdefab\ntransaction id: abcdefabcdefabcdefabcdefff", text.digital_fields)
    assert (r.transaction_id, r.ocr_score) == ("abcdefabcdefabcdefabcdef", 28)


@pytest.mark.parametrize("chat,want", [("final: 1,200 then total 900", 1200), ("Total bill 5,000", 5000), ("3000 PKR", 3000), ("banega 750", 750), ("450 rupees", 450), ("hello", None), ("total ,", None), (None, None)])
def test_chat_amounts(spark, chat, want):
    assert _one(spark, chat, text.chat_amount) == want


@pytest.mark.parametrize("chat,want", [
    ("[12/10/2025, 10:30 PM] hi", (2025, 10, 12, 22, 30)), ("12/25/2025, 10:30 PM", (2025, 12, 25, 22, 30)), ("[2025-10-12 10:30]", (2025, 10, 12, 10, 30)), ("2025-10-12 10:30 hello", None),
    ("12/10/25, 10:30 PM", None), ("1/2/2024 9:05\n[2025/10/12 1:30 am]", (2025, 10, 12, 1, 30)), ("[25/12/2025, 14:30]", (2025, 12, 25, 14, 30)), ("no time", None), (None, None),
])
def test_chat_times(spark, chat, want):
    assert _one(spark, chat, text.chat_timestamp) == (datetime.datetime(*want) if want else None)


def test_model_answers(spark):
    def read(raw):
        a = _one(spark, raw, text.model_answer)
        return a and (a.transaction_id, a.confidence)

    whole = '{"transaction_id": "A1", "confidence": {"transaction_id": 0.5}}'
    assert read(f"x ```json\n{whole}\n``` y") == read(f"```{whole}```") == read(f"so {whole} then") == read(whole[:-1]) == ("A1", {"transaction_id": 0.5})
    assert read("nothing") is read("{broken") is read(None) is None


def test_categories_sanitiser_captions(spark):
    want = {"": (False, "missing", 0.0), "TXN": (False, "label_word", 0.0), "12/05/2024": (False, "date_pattern", 0.0), "a1": (True, "transaction_id", 0.8), "12345678": (True, "transaction_id", 0.6), "12": (False, "unknown", 0.3)}
    for value, verdict in want.items():
        assert tuple(_one(spark, value, lambda v: text.field_category(v, "transaction_id"))) == verdict
    assert tuple(_one(spark, "x", lambda v: text.field_category(v, "amount"))) == (True, "amount", 0.7)
    assert _one(spark, "  Café № 5\t* total: $3 ", text.sanitized) == "Caf 5 total: $3"
    assert tuple(_one(spark, "A Navy gown, no sleeve", text.caption_attributes)) == ("dress", "navy", "sleeveless")
    assert tuple(_one(spark, "teapot", text.caption_attributes)) == ("unknown", "unknown", "unknown")


def test_messages(spark):
    import base64
    import json

    def data(s):
        return base64.urlsafe_b64encode(s.encode()).decode().rstrip("=")

    deep = {"mimeType": "text/plain", "body": {"data": data("deep ÿ?>")}}
    for _ in range(300):
        deep = {"mimeType": "multipart/mixed", "parts": [deep]}
    payload = {"parts": [{"mimeType": "text/plain", "body": {"data": data("one")}}, deep, {"mimeType": "text/html", "body": {"data": data("<p>two <b>three</b></p>")}}, {"mimeType": "image/png", "body": {"data": "xx"}}, {"mimeType": "text/plain", "body": {"data": "!"}}]}
    text_of = json.dumps(payload)
    assert mail.flat_text(text_of) == "one\ndeep ÿ?>\ntwo three\n\n"
    assert mail.flat_text(json.dumps({"body": {"data": data("single")}})) == "single\n"
    assert mail.flat_text(None) == mail.flat_text("[]") == mail.flat_text("{bad") == ""
    assert _one(spark, data("ab?>ÿ"), text.base64url) == "ab?>ÿ"
    spark.udtf.register("mime_parts", mail.parts_table())
    spark.udtf.register("text_lines", mail.lines_table())
    spark.createDataFrame([(text_of,)], "p string").createOrReplaceTempView("payloads")
    assert [tuple(r) for r in spark.sql("select mime_type, content from payloads, lateral mime_parts(p)").collect()][0] == ("text/plain", "one")
    assert [r.line for r in spark.sql("select line from text_lines(' a\r\n\n b')").collect()] == ["a", "b"]
    assert _one(spark, "<i>5 Mar 2024, 3:05 PM</i>", text.mail_timestamp) == datetime.datetime(2024, 3, 5, 15, 5)
    assert _one(spark, "12 March 2024, 11:05 AM", text.mail_timestamp) == datetime.datetime(2024, 3, 12, 11, 5)


METHODS = [
    (20, 50, 50, 10, 50, "scale_aware"), (10, 70, 50, 80, 80, "minimal"), (75, 50, 50, 50, 50, "advanced"), (45, 50, 10, 50, 50, "morphology"), (10, 50, 10, 50, 50, "advanced"), (50, 50, 20, 50, 50, "morphology"),
    (50, 50, 40, 50, 50, "medium"), (20, 30, 50, 50, 50, "light"), (30, 30, 50, 50, 50, "medium"), (20, 50, 50, 30, 55, "scale_aware"), (20, 60, 50, 50, 72, "minimal"), (20, 50, 50, 50, 72, "light"),
    (20, 50, 50, 50, 65, "light"), (30, 50, 50, 50, 55, "medium"), (20, 50, 50, 50, 55, "light"), (30, 50, 18, 50, 45, "medium"), (20, 50, 50, 50, 45, "minimal"), (None, None, None, None, None, "minimal"),
]


def test_preprocessing_choice(spark):
    rows = spark.createDataFrame([(*map(lambda x: None if x is None else float(x), m[:5]), m[5]) for m in METHODS], "n double, c double, b double, r double, o double, want string")
    got = rows.select("want", quality.preprocessing(*[F.col(c) for c in "ncbro"]).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]
    assert [_one(spark, p, quality.resolution_score, "double") for p in (5e5, 1.5e6, 3e6)] == [50.0, 100.0, 100.0]
