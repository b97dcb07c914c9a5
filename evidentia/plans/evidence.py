"""Receipts, chats, e-mails and decisions."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keywords, mail, text
from ..operators import evaluate, extraction, reconcile, temporal
from ..sources import derived

CASES = """
c as (
    select o_orderkey as case_id, lpad(o_orderkey::varchar, 7, '0') as key, o_totalprice::decimal(18,2)::varchar as amount,
        floor(o_totalprice)::bigint as rupees, strftime(o_orderdate, '%d/%m/%Y') as day, o_orderkey % 10 as k,
        date_trunc('day', o_orderdate) + to_minutes((o_orderkey % 1300)::int) as paid_at
    from orders
)"""
FIELDS = f"""{CASES}, f as (
    select case_id, k, key, day,
        case k when 0 then 'TD' || key when 1 then '1NV-' || key when 2 then 'AB' || key when 3 then 'AB-' || key
            when 4 then 'XY' || key when 5 then 'QZ' || key when 6 then substr(key, 3, 5) end as transaction_id,
        case when k <= 6 or k = 9 then amount when k = 7 then right(day, 4) end as amount,
        case when k <= 7 then day end as date,
        case when k <= 6 then 'verified' when k in (7, 9) then 'partial' else 'failed' end as verification_status
    from c
)"""
DIGITAL = f"""{CASES}, d as (
    select *, case_id % 6 as j, substr(md5(case_id::varchar), 1, 24) as tid,
        case when case_id % 6 = 4 then case when month(paid_at) in (3, 4) then strftime(paid_at, '%Y%I%M')::bigint end else rupees end as paid
    from c
), x as (
    select case_id, paid as amount, case when j = 3 then substr(tid, 1, 20) else tid end as transaction_id,
        case when j <> 2 then paid_at end as timestamp,
        case when j <> 5 then case case_id % 3 when 0 then 'orchard lane traders' when 1 then 'zzz' else 'to orchard lane traders ltd' end end as receiver,
        case when paid is null then 0 else 40 end + case when j = 3 then 25 else 30 end + case when j = 2 then 0 else 20 end + case when j = 5 then 0 else 10 end as ocr_score,
        j, tid, rupees, paid_at
    from d
)"""
CHATS = f"""{CASES}, h as (
    select case_id, case when case_id % 100 = 77 then null else rupees end as chat_amount,
        paid_at - to_minutes(case case_id % 7 when 0 then -20 when 1 then -10 else 30 end) as said
    from c
), t as (
    select case_id, chat_amount,
        case case_id % 6 when 5 then null
            when 2 then case when day(said) <= 12 then make_timestamp(year(said), day(said), month(said), hour(said), minute(said), 0) else said end
            else said end as chat_time
    from h
)"""
MATCHED = f"""{DIGITAL}, m as (
    select *, (case_id // 10) % 10 as e, j <> 2 and (case_id // 10) % 10 not in (0, 3, 7) and not (j = 3 and (case_id // 10) % 10 = 2) as hit from x
), w as (
    select *,
        case when not hit then null when e = 2 then substr(tid, 1, 1) || 'x' || substr(tid, 3, 6) || 'x' || substr(tid, 10, 6) || 'x' || substr(tid, 17)
            when e = 8 then substr(tid, 1, 4) || substr(tid, 6, 4) || 'x' || substr(tid, 10, 7) || substr(tid, 18, 4) || 'z' || substr(tid, 22) else tid end as mail_id,
        case when hit then rupees + case when e = 1 then 10 else 0 end end as mail_amount,
        case when hit and e <> 6 then paid_at + to_minutes(case e when 4 then 10 when 5 then 40 else 2 end) end as mail_time
    from m
)"""
VERDICTS = f"""{MATCHED}, h as (
    select case_id as hid, case when case_id % 100 = 77 then null else rupees end as chat_amount,
        paid_at - to_minutes(case case_id % 7 when 0 then -20 when 1 then -10 else 30 end) as said
    from c
), t as (
    select hid, chat_amount,
        case hid % 6 when 5 then null
            when 2 then case when day(said) <= 12 then make_timestamp(year(said), day(said), month(said), hour(said), minute(said), 0) else said end
            else said end as chat_time
    from h
), p as (
    select *, list_sum(list_transform(range(1, 25), lambda i: (substr(mail_id, i, 1) = substr(tid, i, 1) and i <= case when j = 3 then 20 else 24 end)::int)) / 24.0 as places, coalesce(mail_amount, nullif(amount, 0)) as paid, epoch(coalesce(mail_time, timestamp)) / 60 - epoch(chat_time) / 60 as after from w join t on case_id = hid
), s as (
    select *, case when ocr_score < 50 then 'unreadable' when chat_amount is null then 'no_chat_amount' when timestamp is null then 'no_timestamp' end as reject_reason,
        0.5 * ocr_score + 5
        + case when paid is null then 0 when paid = chat_amount then 40 else -least(40, abs(chat_amount - paid)) end
        + case when not hit then 0 when places > 0.95 then 25 else -25 * (1 - places) end
        + case when mail_time is null then 0 when e = 4 then 7.5 when e = 5 then -15 else 15 end
        + case when after is null then 0 when after >= -15 then 10 else -55 end
        + case when receiver is null then 0 when receiver = 'zzz' then -15 else 15 end
        + case when hit then 0 else -55 end as raw
    from p
), v as (
    select case_id, reject_reason, hit as mail_found,
        case when reject_reason is not null then null when case_id % 97 = 0 then 0.0 else round(greatest(0, least(100, raw))::double, 6) end as confidence
    from s
), z as (
    select *, case when reject_reason is not null then 'REJECTED' when case_id % 97 = 0 then 'Fraud detected' when confidence >= 90 then 'APPROVED' when confidence >= 50 then 'MANUAL REVIEW' else 'REJECTED' end as status from v
)"""


def receipt_fields_regex(spark: SparkSession, d: str) -> DataFrame:
    return extraction.parse_receipts(derived.receipts(spark, d)).select("case_id", "transaction_id", "amount", "date", "verification_status")


def receipt_fields_plain(spark: SparkSession, d: str) -> DataFrame:
    return extraction.parse_plain(derived.receipts(spark, d)).select("case_id", "transaction_id", "amount", "date")


def txn_id_strategies(spark: SparkSession, d: str) -> DataFrame:
    return extraction.with_transaction_id(derived.receipts(spark, d)).drop("text")


STRATEGIES = f"""with {FIELDS}
select case_id, case when k <= 2 then transaction_id end as by_patterns,
    case k when 0 then 'TD' || key when 1 then 'INV-' || key when 2 then 'AB' || key when 3 then 'AB-' || key when 4 then 'XY' || key end as by_keywords,
    case k when 2 then 'AB' || key when 4 then 'XY' || key when 5 then 'QZ' || key when 6 then substr(key, 3, 5) end as by_line,
    case when k = 6 then substr(key, 3, 5) end as by_number, transaction_id
from f"""

#: Candidates with their context and what the rules say.
CANDIDATES = [
    ("AB", "", False), ("RECEIPT", "", False), ("TOTAL 5", "", False), ("AB_1", "", False), ("12/05/2024", "", False), ("1234", "Invoice 1234", True), ("123", "Invoice 123", False), ("123456", "", True),
    ("12345", "", False), ("TANTRA", "", False), ("HELLO", "", False), ("ABCDEFGH", "document", True), ("ABCDEFGH", "", False), ("A1B", "", True), ("--/--/", "", True), ("12-3", "", True),
]


def _candidate(key: str):
    pairs = F.array(*[F.struct(F.lit(c).alias("candidate"), F.lit(x).alias("context")) for c, x, _ in CANDIDATES])
    return F.get(pairs, F.pmod(F.col(key), F.lit(len(CANDIDATES))).cast("int"))


def txn_id_validator(spark: SparkSession, d: str) -> DataFrame:
    rows = derived.table(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), _candidate("o_orderkey").alias("p")).select("case_id", "p.*")
    return rows.select("case_id", "candidate", text.is_transaction_id(F.col("candidate"), F.col("context")).alias("valid"))


VALIDATOR = "select o_orderkey as case_id, case o_orderkey % 16 " + " ".join(f"when {i} then '{c}'" for i, (c, _, _) in enumerate(CANDIDATES)) + " end as candidate, o_orderkey % 16 in (" + ", ".join(str(i) for i, x in enumerate(CANDIDATES) if x[2]) + ") as valid from orders"


def date_pattern_filter(spark: SparkSession, d: str) -> DataFrame:
    o, k = F.col("o_orderdate"), F.col("o_orderkey") % 8
    shapes = ["dd/MM/yyyy", "d-M-yy", "yyyy.MM.dd", "d MMM yyyy", "MMM d", "yyyy", "HH:mm", "dd/MM"]
    shown = F.coalesce(*[F.when(k == i, F.date_format(o, f)) for i, f in enumerate(shapes)])
    return derived.table(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), text.is_date(shown).alias("is_date"))


def receipt_status_summary(spark: SparkSession, d: str) -> DataFrame:
    parsed = extraction.parse_receipts(derived.receipts(spark, d))
    return parsed.groupBy("verification_status", "extraction_method").agg(F.count(F.lit(1)).alias("n"), F.count("amount").alias("with_amount"), F.bool_and(F.col("date").isNotNull()).alias("all_dated"))


def batch_status_rollup(spark: SparkSession, d: str) -> DataFrame:
    parsed = extraction.parse_receipts(derived.receipts(spark, d)).withColumn("layout", F.col("case_id") % 10)
    return parsed.rollup("verification_status", "layout").agg(F.count(F.lit(1)).alias("n"))


def digital_extract_score(spark: SparkSession, d: str) -> DataFrame:
    return derived.digital_receipts(spark, d).select("case_id", text.digital_fields(F.col("text")).alias("f")).select("case_id", "f.*")


def tid_ocr_repair(spark: SparkSession, d: str) -> DataFrame:
    bad = F.concat(F.translate(F.upper(derived.bank_id(F.col("o_orderkey"))), "015", "OLS"), F.lit("-tail"))
    return derived.table(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), text.repaired_id(bad).alias("repaired"))


def chat_amount(spark: SparkSession, d: str) -> DataFrame:
    return derived.chats(spark, d).select("case_id", text.chat_amount(F.col("text")).alias("chat_amount"))


def chat_timestamp(spark: SparkSession, d: str) -> DataFrame:
    return derived.chats(spark, d).select("case_id", text.chat_timestamp(F.col("text")).alias("chat_time"))


def _payloads(spark: SparkSession, d: str) -> DataFrame:
    m = derived.mails(spark, d)
    data = lambda c: F.translate(F.base64(F.encode(c, "UTF-8")), "+/", "-_")
    part = lambda kind, c: F.struct(F.lit(kind).alias("mimeType"), F.struct(data(c).alias("data")).alias("body"))
    plain = F.concat(F.lit("Transaction ID: "), F.col("transaction_id"))
    shown = F.concat(F.lit("<p>Rs. "), F.format_number("amount", 0), F.lit("</p><b>"), F.date_format("received", "dd MMM yyyy, hh:mm a"), F.lit("</b>"))
    inner = F.struct(F.lit("multipart/alternative").alias("mimeType"), F.array(part("text/plain", plain), part("text/html", shown)).alias("parts"))
    return m.select("id", F.to_json(F.struct(F.lit("multipart/mixed").alias("mimeType"), F.array(inner).alias("parts"))).alias("payload"))


def email_flatten(spark: SparkSession, d: str) -> DataFrame:
    return _payloads(spark, d).select("id", mail.payload_text(F.col("payload")).alias("body"))


def email_fields(spark: SparkSession, d: str) -> DataFrame:
    read = _payloads(spark, d).select("id", mail.payload_text(F.col("payload")).alias("body"), mail.payload_html(F.col("payload")).alias("html"))
    return read.select("id", text.mail_fields(F.col("body")).alias("f"), text.mail_timestamp(F.col("html")).alias("mail_time")).select("id", "f.*", "mail_time")


MAILS = f"""{CASES}, ms as (
    select 'm' || key as id, rupees + case when (case_id // 10) % 10 = 1 then 10 else 0 end as amount, paid_at + interval 3 minutes as received,
        substr(md5(case_id::varchar), 1, 24) as tid, (case_id // 10) % 10 as e
    from c where (case_id // 10) % 10 <> 0
), mm as (
    select *, case e when 2 then substr(tid, 1, 1) || 'x' || substr(tid, 3, 6) || 'x' || substr(tid, 10, 6) || 'x' || substr(tid, 17)
        when 3 then substr(tid, 1, 1) || 'x' || substr(tid, 3, 3) || 'x' || substr(tid, 7, 3) || 'x' || substr(tid, 11, 3) || 'x' || substr(tid, 15, 3) || 'x' || substr(tid, 19, 3) || 'x' || substr(tid, 23)
        when 8 then substr(tid, 1, 4) || substr(tid, 6, 4) || 'x' || substr(tid, 10, 7) || substr(tid, 18, 4) || 'z' || substr(tid, 22) else tid end as transaction_id
    from ms
)"""


def _digital(spark: SparkSession, d: str) -> DataFrame:
    return derived.digital_receipts(spark, d).select("case_id", text.digital_fields(F.col("text")).alias("f")).select("case_id", "f.*")


def email_match_sameday(spark: SparkSession, d: str) -> DataFrame:
    matched = reconcile.match_mails(_digital(spark, d), derived.mails(spark, d).drop("case_id"), derived.SENDER)
    return matched.select("case_id", F.col("mail.transaction_id").alias("mail_id"), F.col("mail.amount").alias("mail_amount"), F.col("mail.timestamp").alias("mail_time"))


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    matched = reconcile.match_mails(_digital(spark, d), derived.mails(spark, d).drop("case_id"), derived.SENDER)
    said = derived.chats(spark, d).select("case_id", text.chat_amount(F.col("text")).alias("chat_amount"), text.chat_timestamp(F.col("text")).alias("chat_time"))
    return reconcile.decide(matched.join(said, "case_id").withColumn("fraud", F.col("case_id") % 97 == 0), derived.MERCHANT)


def payment_verdict(spark: SparkSession, d: str) -> DataFrame:
    return _verdicts(spark, d).select("case_id", "status", F.round("confidence", 6).alias("confidence"), "reject_reason", F.col("mail").isNotNull().alias("mail_found"), reconcile.shown_as(F.col("status")).alias("shown_as"))


def verdict_distribution(spark: SparkSession, d: str) -> DataFrame:
    return _verdicts(spark, d).groupBy("status", "reject_reason").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 4).alias("mean_confidence"))


def _paid(spark: SparkSession, d: str) -> DataFrame:
    customers = derived.table(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_custkey").alias("customer"))
    return derived.cases(spark, d).select("case_id", "paid_at").join(customers, "case_id")


def _said(spark: SparkSession, d: str) -> DataFrame:
    customers = derived.table(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_custkey").alias("customer"))
    return derived.chats(spark, d).select("case_id", "said_at").join(customers, "case_id").withColumnRenamed("case_id", "chat_id")


def latest_chat(spark: SparkSession, d: str) -> DataFrame:
    """For each payment the customer's latest chat at most 15 minutes after it and less than 60 days before."""
    found = temporal.as_of(_paid(spark, d), _said(spark, d), "paid_at", "said_at", timedelta(days=60), timedelta(minutes=15), on=["customer"], ties="chat_id", name="chat")
    return found.select("case_id", "customer", F.col("chat.chat_id").alias("chat_id"), ((F.unix_timestamp("paid_at") - F.unix_timestamp("chat.said_at")) / 60).cast("long").alias("minutes_before"))


def chats_near_payments(spark: SparkSession, d: str) -> DataFrame:
    """All chats, whoever's, from 5 minutes before to 15 minutes after a payment."""
    pairs = temporal.interval_join(_paid(spark, d), _said(spark, d).withColumnRenamed("customer", "chat_customer"), "paid_at", "said_at", timedelta(minutes=5), timedelta(minutes=15))
    return pairs.select("case_id", "chat_id", ((F.unix_timestamp("said_at") - F.unix_timestamp("paid_at")) / 60).cast("long").alias("minutes_after"), (F.col("customer") == F.col("chat_customer")).alias("same_customer"))


TIMES = f"""{CHATS}, p as (select case_id, o_custkey as customer, paid_at from c join orders on o_orderkey = case_id),
s as (select case_id as chat_id, o_custkey as chat_customer, said from h join orders on o_orderkey = case_id)"""


def fuzzy_keyword_fields(spark: SparkSession, d: str) -> DataFrame:
    rows = derived.receipts(spark, d).select("case_id", F.split(F.replace(F.replace("text", F.lit("\r"), F.lit("")), F.lit("Total"), F.lit("Tota1")), "\n").alias("segments"))
    return extraction.parse_segments(rows)


def best_ocr_variant(spark: SparkSession, d: str) -> DataFrame:
    """Five readings of each whole text: without blanks, as it is, sometimes with a mark more, in lower case, on one line."""
    t = F.col("text")
    readings = F.array(F.replace(t, F.lit(" "), F.lit("")), t, F.when(F.col("doc_id") % 3 == 0, F.concat(t, F.lit("!"))).otherwise(t), F.lower(t), F.replace(t, F.lit("\n"), F.lit("")))
    read = derived.table(spark, d, "documents").select(F.col("doc_id").alias("case_id"), (F.col("doc_id") % 4 == 0).alias("blurry"), F.posexplode(readings).alias("variant_no", "text"))
    return evaluate.best_variant(read).withColumn("text", F.md5("text"))


def _answers(spark: SparkSession, d: str) -> DataFrame:
    c = derived.cases(spark, d)
    body = F.concat(F.lit('{"transaction_id": "T'), F.col("key"), F.lit('", "amount": "'), F.col("amount"), F.lit('", "date": null, "confidence": {"amount": 0.9}'))
    whole, n = F.concat(body, F.lit("}")), F.col("case_id") % 5
    raw = F.when(n == 0, F.concat(F.lit("Here:\n```json\n"), whole, F.lit("\n```\nbye"))).when(n == 1, F.concat(F.lit("It is "), whole, F.lit(" I think"))).when(n == 2, F.concat(F.lit("```\n"), whole, F.lit("\n```"))).when(n == 3, body).otherwise("no idea")
    return c.select("case_id", raw.alias("raw"))


def llm_response_parse(spark: SparkSession, d: str) -> DataFrame:
    read = _answers(spark, d).select("case_id", text.model_answer(F.col("raw")).alias("a"))
    return read.select("case_id", "a.transaction_id", "a.amount", "a.date", F.col("a.confidence")["amount"].alias("amount_confidence"), F.col("a").isNotNull().alias("parsed"))


def model_answer_keys(spark: SparkSession, d: str) -> DataFrame:
    """Answers whose further keys no schema names, some of them nested, some cut short, some no JSON."""
    c = derived.cases(spark, d)
    n = F.col("case_id") % 6
    items = F.concat(F.lit('"details": {"items": [{"name": "x", "price": '), F.col("rupees").cast("string"), F.lit('}, {"name": "y"}]}'))
    body = F.concat(F.lit('{"transaction_id": "T'), F.col("key"), F.lit('", "amount": '), F.col("rupees").cast("string"), F.lit(', "tip": null'), F.when(n != 4, F.concat(F.lit(", "), items)).otherwise(""))
    raw = F.when(n == 0, F.concat(F.lit("```json\n"), body, F.lit("}\n```"))).when(n == 1, body).when(n == 2, "[1, 2]").when(n == 3, "no idea").otherwise(F.concat(F.lit("So: "), body, F.lit("} done")))
    v = F.col("v")
    read = c.select("case_id", text.model_answer_variant(raw).alias("v"))
    return read.select("case_id", text.variant_value(v, "$.transaction_id").alias("transaction_id"), text.variant_value(v, "$.amount", "bigint").alias("amount"), text.variant_value(v, "$.details.items[0].price", "bigint").alias("price"), text.variant_value(v, "$.details.items[1].price", "bigint").alias("no_price"), F.array_join(text.other_keys(v), ",").alias("further"))


#: A vocabulary for scans of whole texts: words of the corpus's languages and parts of them, some within others.
SCANNED = ["the", "he", "and", "of", "ou", "our", "que", "der", "die", "license", "copyright", "MIT", "http", "@", "ing", "tion", "\n\n", "zzzz"]


def keyword_scan(spark: SparkSession, d: str) -> DataFrame:
    """All keywords in one pass over each whole text: how many there are, which comes first in the list, and where each stands."""
    rows = derived.table(spark, d, "documents").select("doc_id", keywords.keyword_hits(F.col("text"), SCANNED).alias("h"))
    shown = F.transform("h", lambda x: F.concat_ws(":", x["word"].cast("string"), x["place"].cast("string")))
    return rows.select("doc_id", F.size("h").alias("n_words"), F.try_element_at("h", F.lit(1))["word"].alias("first_word"), F.array_join(shown, " ").alias("places"))


_KEYS = "[" + ", ".join(f"'{w}'" if "\n" not in w else "chr(10) || chr(10)" for w in SCANNED) + "]"


def text_sanitize(spark: SparkSession, d: str) -> DataFrame:
    return derived.table(spark, d, "documents").select("doc_id", text.sanitized(F.col("text")).alias("t")).select("doc_id", F.md5("t").alias("digest"), F.length("t").alias("n"))


def text_lines(spark: SparkSession, d: str) -> DataFrame:
    each = derived.table(spark, d, "documents").select("doc_id", F.posexplode(text.lines(F.col("text"))).alias("line_no", "line"))
    return each.select("doc_id", "line_no", F.md5("line").alias("digest"))


def html_plain_text(spark: SparkSession, d: str) -> DataFrame:
    return derived.table(spark, d, "pages").select("page_id", text.html_plain(F.col("html")).alias("t")).select("page_id", F.md5("t").alias("digest"), F.length("t").alias("n"))


def field_categorise(spark: SparkSession, d: str) -> DataFrame:
    k, key = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    n = k % 7
    value = F.when(n == 1, "").when(n == 2, "Invoice").when(n == 3, F.date_format("o_orderdate", "dd/MM/yyyy")).when(n == 4, F.concat(F.lit("ab"), key)).when(n == 5, "longwords").when(n == 6, "short")
    rows = derived.table(spark, d, "orders").select(k.alias("case_id"), text.field_category(value, "transaction_id").alias("c"), text.field_category(value, "amount").alias("a"))
    return rows.select("case_id", "c.*", F.col("a.category").alias("as_amount"))


def caption_attributes(spark: SparkSession, d: str) -> DataFrame:
    words = ["Red dress, long sleeve", "navy blue T-Shirt short sleeve", "sleeveless gown", "brown leather boots", "grey cardigan", "a teapot", "black tie and white shirt", "denim jeans"]
    caption = F.concat(F.get(F.array(*map(F.lit, words)), (F.col("p_partkey") % len(words)).cast("int")), F.lit(" "), F.col("p_name"))
    rows = derived.table(spark, d, "part").select("p_partkey", text.caption_attributes(caption).alias("c"))
    return rows.select("p_partkey", "c.*")


def _keyword_sql(column: str, words: dict[str, list[str]]) -> str:
    return "case " + " ".join("when " + " or ".join(f"contains({column}, '{w}')" for w in ws) + f" then '{label}'" for label, ws in words.items()) + " else 'unknown' end"


CAPTIONS = f"""with n as (
    select p_partkey, lower(case p_partkey % 8 when 0 then 'Red dress, long sleeve' when 1 then 'navy blue T-Shirt short sleeve' when 2 then 'sleeveless gown' when 3 then 'brown leather boots'
        when 4 then 'grey cardigan' when 5 then 'a teapot' when 6 then 'black tie and white shirt' else 'denim jeans' end || ' ' || p_name) as t from part
)
select p_partkey, {_keyword_sql("t", text.CAPTION_CATEGORIES)} as category, {_keyword_sql("t", {c: [c] for c in text.CAPTION_COLORS})} as color, {_keyword_sql("t", text.CAPTION_SLEEVES)} as sleeve_type from n"""
QUERIES = {
    "receipt_fields_regex": (receipt_fields_regex, f"with {FIELDS} select case_id, transaction_id, amount, date, verification_status from f"),
    "receipt_fields_plain": (receipt_fields_plain, f"with {CASES} select case_id, case k when 0 then 'TD' || key when 1 then 'INV-' || key when 2 then 'ument' end as transaction_id, case when k <= 6 or k = 9 then amount end as amount, case when k in (0, 1, 3) then day end as date from c"),
    "txn_id_strategies": (txn_id_strategies, STRATEGIES),
    "txn_id_validator": (txn_id_validator, VALIDATOR),
    "date_pattern_filter": (date_pattern_filter, "select o_orderkey as case_id, o_orderkey % 8 <= 4 as is_date from orders"),
    "receipt_status_summary": (receipt_status_summary, f"with {FIELDS} select verification_status, 'pytesseract' as extraction_method, count(*) as n, count(amount) as with_amount, bool_and(date is not null) as all_dated from f group by 1"),
    "batch_status_rollup": (batch_status_rollup, f"with {FIELDS} select verification_status, k as layout, count(*) as n from f group by rollup (verification_status, k)"),
    "digital_extract_score": (digital_extract_score, f"with {DIGITAL} select case_id, amount, transaction_id, timestamp, receiver, ocr_score from x"),
    "tid_ocr_repair": (tid_ocr_repair, "select o_orderkey as case_id, substr(md5(o_orderkey::varchar), 1, 24) as repaired from orders"),
    "chat_amount": (chat_amount, f"with {CHATS} select case_id, chat_amount from t"),
    "chat_timestamp": (chat_timestamp, f"with {CHATS} select case_id, chat_time from t"),
    "email_flatten": (email_flatten, f"with {MAILS} select id, 'Transaction ID: ' || transaction_id || chr(10) || 'Rs. ' || format('{{:,}}', amount) || ' ' || strftime(received, '%d %b %Y, %I:%M %p') || chr(10) as body from mm"),
    "email_fields": (email_fields, f"with {MAILS} select id, transaction_id, amount, received as mail_time from mm"),
    "email_match_sameday": (email_match_sameday, f"with {MATCHED} select case_id, mail_id, mail_amount, mail_time from w"),
    "payment_verdict": (payment_verdict, f"with {VERDICTS} select case_id, status, confidence, reject_reason, mail_found, case status when 'APPROVED' then 'success' when 'MANUAL REVIEW' then 'partial' else 'failed' end as shown_as from z"),
    "verdict_distribution": (verdict_distribution, f"with {VERDICTS} select status, reject_reason, count(*) as n, round(avg(confidence), 4) as mean_confidence from z group by 1, 2"),
    "latest_chat": (latest_chat, f"""with {TIMES}, m as (select case_id, chat_id, said, row_number() over (partition by case_id order by said desc, chat_id desc) as n
        from p join s on chat_customer = customer and said <= paid_at + interval 15 minutes and said > paid_at - interval 60 days)
        select p.case_id, customer, m.chat_id, ((epoch(paid_at) - epoch(said)) / 60)::bigint as minutes_before from p left join m on m.case_id = p.case_id and n = 1"""),
    "chats_near_payments": (chats_near_payments, f"with {TIMES} select case_id, chat_id, ((epoch(said) - epoch(paid_at)) / 60)::bigint as minutes_after, customer = chat_customer as same_customer from p join s on said between paid_at - interval 5 minutes and paid_at + interval 15 minutes"),
    "fuzzy_keyword_fields": (fuzzy_keyword_fields, None),
    "best_ocr_variant": (best_ocr_variant, """with a as (select doc_id as case_id, doc_id % 4 = 0 as blurry, [replace(text, ' ', ''), text, case when doc_id % 3 = 0 then text || '!' else text end, lower(text), replace(text, chr(10), '')] as v from documents),
        v as (select case_id, blurry, unnest(v) as text, unnest(range(5)) as variant_no from a),
        r as (select *, row_number() over (partition by case_id order by length(text) desc, variant_no) as n from v) select case_id, variant_no::int as variant_no, md5(text) as text, length(text) < 100 and blurry as rejected from r where n = 1"""),
    "llm_response_parse": (llm_response_parse, f"with {CASES} select case_id, case when case_id % 5 < 4 then 'T' || key end as transaction_id, case when case_id % 5 < 4 then amount end as amount, null::varchar as date, case when case_id % 5 < 4 then 0.9::double end as amount_confidence, case_id % 5 < 4 as parsed from c"),
    "model_answer_keys": (model_answer_keys, f"""with {CASES}, n as (select *, case_id % 6 not in (2, 3) as read, case_id % 6 <> 4 as whole from c)
        select case_id, case when read then 'T' || key end as transaction_id, case when read then rupees end as amount, case when read and whole then rupees end as price, null::bigint as no_price, case when read then case when whole then 'details,tip' else 'tip' end end as further from n"""),
    "keyword_scan": (keyword_scan, f"""with t as (select doc_id, list_filter(list_transform(range(1, {len(SCANNED)} + 1), lambda i: {{'w': i - 1, 'p': strpos(text, ({_KEYS})[i]) - 1}}), lambda x: x.p >= 0) as h from documents where text is not null)
        select doc_id, len(h)::int as n_words, h[1].w::int as first_word, array_to_string(list_transform(h, lambda x: x.w || ':' || x.p), ' ') as places from t
        union all select doc_id, null, null, null from documents where text is null"""),
    "text_sanitize": (text_sanitize, r"with t as (select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '[^\x00-\x7F]', ' ', 'g'), '[^\w\s.,:\-/()$@#%]', ' ', 'g'), '\s+', ' ', 'g')) as t from documents) select doc_id, md5(t) as digest, length(t)::int as n from t"),
    "text_lines": (text_lines, r"with a as (select doc_id, list_filter(list_transform(string_split(replace(text, chr(13), chr(10)), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') as l from documents), u as (select doc_id, unnest(l) as line, unnest(range(len(l))) as line_no from a) select doc_id, line_no::int as line_no, md5(line) as digest from u"),
    "html_plain_text": (html_plain_text, r"with t as (select page_id, trim(regexp_replace(regexp_replace(html, '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) as t from pages) select page_id, md5(t) as digest, length(t)::int as n from t"),
    "field_categorise": (field_categorise, "select o_orderkey as case_id, o_orderkey % 7 in (4, 5) as is_valid, case o_orderkey % 7 when 2 then 'label_word' when 3 then 'date_pattern' when 4 then 'transaction_id' when 5 then 'transaction_id' when 6 then 'unknown' else 'missing' end as category, (case o_orderkey % 7 when 4 then 0.8 when 5 then 0.6 when 6 then 0.3 else 0.0 end)::double as confidence, case when o_orderkey % 7 <= 1 then 'missing' else 'amount' end as as_amount from orders"),
    "caption_attributes": (caption_attributes, CAPTIONS),
}
