"""Text expressions: dates, identifiers, receipts, chats, e-mails and model answers. All are built-in functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns and word lists that decide what is found in receipts. Patterns are tried in this order.
MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
DATE_SHAPES = [
    r"\d{1,2}[/\-\.]\d{1,2}[/\-\.]\d{2,4}$",
    r"\d{1,2}[/\-\.]\d{1,2}[/\-\.]\d{1,2}$",
    r"\d{4}[/\-\.]\d{1,2}[/\-\.]\d{1,2}$",
    r"\d{2}[/\-\.]\d{2}[/\-\.]\d{4}$",
    rf"\d{{1,2}}\s+(?:{MONTHS})",
    rf"(?:{MONTHS})\s+\d{{1,2}}",
]
LABEL_WORDS = [
    "RECEIPT", "INVOICE", "BILL", "DOCUMENT", "DOC", "REFERENCE", "REF", "ORDER", "TRANSACTION", "TRANS", "TXN", "PAYMENT", "AMOUNT", "TOTAL",
    "DATE", "INVOICE NO", "RECEIPT NO", "BILL NO", "DOC NO", "REF NO", "ORDER NO", "TRANSACTION ID", "INVOICE NUMBER", "BILL NUMBER",
    "RECEIPT NUMBER", "DOCUMENT NUMBER", "ORDER NUMBER", "TRANS ID", "ID", "NO", "NUMBER", "INV", "NO.",
]
FIELD_LABELS = ["RECEIPT", "INVOICE", "BILL", "DOCUMENT", "DOC", "REFERENCE", "REF", "ORDER", "TRANSACTION", "TRANS", "TXN", "PAYMENT", "ID"]
BRAND_WORDS = ["TANTRA", "SHOP", "STORE", "MALL", "CENTER", "CENTRE", "MARKET", "SUPERMARKET", "DEPARTMENT", "OUTLET", "BRANCH", "LOCATION"]
ID_CONTEXT = "transaction|invoice|bill|receipt|doc|ref|order|id|no|number"
AMOUNT_CONTEXT = r"total|amount|paid|sum|grand\s*total"
RECEIPT_DATES = [
    r"(?:Date|Invoice\s*Date|Bill\s*Date|Issued\s*On|Payment\s*Date|Transaction\s*Date)\s*[:]?\s*([\d]{1,2}[/\-\.][\d]{1,2}[/\-\.][\d]{2,4})",
    r"\b(\d{1,2}[/\-\.]\d{1,2}[/\-\.]\d{2,4})\b",
    r"(?:Date|Invoice\s*Date)\s*[:]?\s*\n\s*([\d]{1,2}[/\-\.][\d]{1,2}[/\-\.][\d]{2,4})",
]
RECEIPT_AMOUNTS = [
    r"(?:Amount|Total|Grand\s*Total|Amount\s*Paid|Net\s*Total|Subtotal|Sub\s*Total|Sum|Payment)\s*[:]?\s*\$?\s*([\d,]+\.?\d*)",
    r"[₹$€£]?\s*([\d,]+\.?\d{2})\s*(?:USD|EUR|GBP|INR)?",
    r"(?:Total|Amount)\s*[:]?\s*\n\s*\$?\s*([\d,]+\.?\d*)",
]
DIGITAL = {
    "amount": r"(?:Rs|RS|Rs\.?|Rs?|rs|rs\.?|rs?)[\.\s]*([\d,]+)",
    "transaction_id": r"(?:Transaction|Tranction|Transation|Trnsaction|Tranzaction)(?:ID|1D)[^\w\d]*([\w\d]{20,})",
    "timestamp": r"(\d{2}[A-Za-z]{3}\d{4}\d{4}(?:AM|PM))",
    "receiver": r"(?:Destin[a-z]*\s*A[cekg]{1,3}\s*Titl[a-z]*)(?:\s*[:\-]?\s*)([A-Za-z0-9 ._-]+)",
}
CHAT_AMOUNTS = [r"final[^\d]*([\d,]+)", r"total[^\d]*([\d,]+)", r"([\d,]+)\s*pkr", r"ban[ae]ga\s*([\d,]+)", r"([\d,]+)\s*rupees?"]
CHAT_TIME = r"(\d{1,4}[/-]\d{1,2}[/-]\d{1,4}).*?(\d{1,2}:\d{2}\s*(?:AM|PM|am|pm)?)"
CHAT_FORMATS = ["d/M/yyyy h:mm a", "d/M/yyyy H:mm", "M/d/yyyy h:mm a", "yyyy-M-d H:mm", "yyyy/M/d h:mm a"]
MAIL_ID = r"Transaction\s*(?:ID|1D)[^\w\d]*([\w\d]{20,})"
MAIL_AMOUNT = r"Rs[\.\s]*([\d,]+)"
MAIL_TIME = r"\d{1,2}\s+[A-Za-z]{3,9}\s+\d{4},\s+\d{1,2}:\d{2}\s*(?:AM|PM)"
ID_REPAIR = ("olihtsgqzuv", "011bf59920y")


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """The first match's group, or null: the built-in gives an empty string."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def all_found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def first_of(text: Column, patterns: list[str]) -> Column:
    """The first non-blank group 1 over patterns in order, then over matches in order."""
    return F.coalesce(*[F.get(F.filter(F.transform(all_found(text, f"(?i){p}"), lambda x: F.trim(x)), lambda x: x != ""), F.lit(0)) for p in patterns])


def lines(text: Column) -> Column:
    """Trimmed lines that are not empty, in order."""
    return F.filter(F.transform(F.split(F.replace(text, F.lit("\r"), F.lit("\n")), "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def is_date(candidate: Column) -> Column:
    return F.coalesce(candidate.rlike(f"(?i)^(?:{'|'.join(DATE_SHAPES)})"), F.lit(False))


def has_context(context: Column, words: str = ID_CONTEXT) -> Column:
    return F.coalesce(F.lower(context).rlike(words), F.lit(False))


def is_transaction_id(candidate: Column, context: Column) -> Column:
    """Whether a candidate is an identifier, given the text around it (null: none). Rules are tried in order."""
    upper = F.upper(F.trim(candidate))
    size, known = F.length(candidate), has_context(context)
    label = upper.isin(LABEL_WORDS) | reduce(lambda a, b: a | b, [upper.startswith(f"{w} ") for w in LABEL_WORDS])
    digits, letters = candidate.rlike(r"^\d+$"), upper.rlike("^[A-Z]+$")
    return (
        F.when(candidate.isNull() | (size < 3), False)
        .when(label, False)
        .when(~upper.rlike(r"^[A-Z0-9\-/]+$"), False)
        .when(is_date(candidate), False)
        .when(digits & known & (size >= 4), True)
        .when(digits & ~known, size >= 6)
        .when(letters, ~upper.isin(BRAND_WORDS) & known & (F.length(upper) >= 8))
        .when(upper.rlike("[A-Z]") & upper.rlike("[0-9]"), True)
        .when(size >= 6, True)
        .otherwise((size >= 4) & candidate.rlike("[-/]"))
    )


def receipt_status(fields: list[Column]) -> Column:
    """verified, partial or failed: all, some or none of the fields have a value."""
    n = reduce(lambda a, b: a + b, [F.coalesce((f != "").cast("int"), F.lit(0)) for f in fields])
    return F.when(n == len(fields), "verified").when(n > 0, "partial").otherwise("failed")


def extraction_method(source: Column, engine: str) -> Column:
    """``llm`` only for the model's first answer; any other is named after the OCR engine."""
    return F.when(source == "llm", "llm").otherwise(engine)


def whole_number(text: Column) -> Column:
    return F.try_to_number(F.nullif(F.replace(text, F.lit(","), F.lit("")), F.lit("")), F.lit("9" * 18)).cast("bigint")


def repaired_id(raw: Column) -> Column:
    """A hexadecimal identifier as OCR should have read it: look-alikes mapped, other characters zero, 24 at most."""
    known = F.regexp_replace(F.lower(raw), f"[^0-9a-f{ID_REPAIR[0]}]", "0")
    return F.substring(F.translate(known, *ID_REPAIR), 1, 24)


def reread_id(text: Column) -> Column:
    """The identifier on the first line that speaks of a transaction, unrepaired; null if there is none."""
    line = F.get(F.filter(F.split(text, "\n"), lambda x: F.lower(x).contains("transaction")), F.lit(0))
    clean = reduce(lambda c, w: F.replace(c, F.lit(w), F.lit("ID")), ["1D", "Id", "iD"], line)
    return F.substring(found(clean, r"(?i)(?:ID|1D)[^\w\d]*([\w\d]{20,})"), 1, 24)


def digital_fields(text: Column) -> Column:
    """amount, transaction_id, timestamp, receiver of a digital receipt's text, and the score of what was found."""
    amount = whole_number(found(text, f"(?i){DIGITAL['amount']}"))
    first = repaired_id(found(text, f"(?i){DIGITAL['transaction_id']}"))
    again = F.coalesce(reread_id(text), first)
    tid = F.when(F.length(first) == 24, first).when(first.isNotNull(), again)
    tid_score = F.when(first.isNull(), 0).when(F.length(first) == 24, 30).when(F.length(again) == 24, 28).otherwise(25)
    time = F.try_to_timestamp(found(text, DIGITAL["timestamp"]), F.lit("ddMMMyyyyhhmma"))
    receiver = F.lower(F.trim(found(text, f"(?i){DIGITAL['receiver']}")))
    score = F.when(amount.isNotNull(), 40).otherwise(0) + tid_score + F.when(time.isNotNull(), 20).otherwise(0) + F.when(receiver.isNotNull(), 10).otherwise(0)
    return F.struct(amount.alias("amount"), tid.alias("transaction_id"), time.alias("timestamp"), receiver.alias("receiver"), score.alias("ocr_score"))


def chat_amount(text: Column) -> Column:
    """The amount a chat agrees on: of five phrasings the first that occurs, at its first place."""
    return whole_number(F.coalesce(*[found(F.lower(text), p) for p in CHAT_AMOUNTS]))


def chat_timestamp(text: Column) -> Column:
    """The chat's last date with a time on one line, in the first format that fits."""
    last = F.concat_ws(" ", F.try_element_at(all_found(text, CHAT_TIME), F.lit(-1)), F.try_element_at(all_found(text, CHAT_TIME, 2), F.lit(-1)))
    return F.coalesce(*[F.try_to_timestamp(last, F.lit(f)) for f in CHAT_FORMATS])


def sanitized(text: Column) -> Column:
    """ASCII without unusual signs, blanks collapsed."""
    plain = F.regexp_replace(F.regexp_replace(text, r"[^\x00-\x7F]", " "), r"[^\w\s.,:\-/()$€£@#%]", " ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


ANSWER = "transaction_id string, amount string, date string, confidence map<string,double>, explanations map<string,string>"


def model_answer(raw: Column) -> Column:
    """A model's answer as a struct; null where no JSON object can be read from it. A fence around it goes first; an
    answer cut short is tried again with one closing brace."""
    fenced = F.when(raw.contains("```json"), F.get(F.split(F.get(F.split(raw, "```json"), F.lit(1)), "```"), F.lit(0))).when(raw.contains("```"), F.get(F.split(raw, "```"), F.lit(1))).otherwise(raw)

    def read(json: Column) -> Column:
        fields = F.from_json(json, ANSWER + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
        return F.when(fields["_corrupt"].isNull() & json.isNotNull(), fields)

    return F.coalesce(read(found(fenced, r"(?s)\{.*\}", 0)), read(F.concat(found(fenced, r"(?s)\{.*", 0), F.lit("}"))))


def model_answer_variant(raw: Column) -> Column:
    """A model's answer as a VARIANT with all that it holds, whatever its keys; null where no JSON object can be read from it.
    Fences and answers cut short are treated as in ``model_answer``."""
    fenced = F.when(raw.contains("```json"), F.get(F.split(F.get(F.split(raw, "```json"), F.lit(1)), "```"), F.lit(0))).when(raw.contains("```"), F.get(F.split(raw, "```"), F.lit(1))).otherwise(raw)

    def read(json: Column) -> Column:
        value = F.try_parse_json(json)
        return F.when(F.schema_of_variant(value).startswith("OBJECT"), value)

    return F.coalesce(read(found(fenced, r"(?s)\{.*\}", 0)), read(F.concat(found(fenced, r"(?s)\{.*", 0), F.lit("}"))))


def variant_value(answer: Column, path: str, kind: str = "string") -> Column:
    """What stands at a path such as ``$.details.items[0].price``; null where there is nothing, or nothing of that kind."""
    return F.try_variant_get(answer, path, kind)


def other_keys(answer: Column, known: tuple[str, ...] = ("transaction_id", "amount", "date", "confidence", "explanations")) -> Column:
    """The answer's keys that no schema names, in order."""
    return F.sort_array(F.array_except(F.map_keys(F.try_variant_get(answer, "$", "map<string,variant>")), F.array(*map(F.lit, known))))


def field_category(value: Column, field: str) -> Column:
    """is_valid, category and confidence of one field by simple rules."""

    def verdict(valid: bool, category: str, confidence: float) -> Column:
        return F.struct(F.lit(valid).alias("is_valid"), F.lit(category).alias("category"), F.lit(confidence).alias("confidence"))

    missing = value.isNull() | (value == "")
    if field != "transaction_id":
        return F.when(missing, verdict(False, "missing", 0.0)).otherwise(verdict(True, field, 0.7))
    upper = F.upper(value)
    return (
        F.when(missing, verdict(False, "missing", 0.0))
        .when(F.trim(upper).isin(FIELD_LABELS), verdict(False, "label_word", 0.0))
        .when(is_date(value), verdict(False, "date_pattern", 0.0))
        .when(upper.rlike("[A-Z]") & value.rlike("[0-9]"), verdict(True, "transaction_id", 0.8))
        .when(F.length(value) >= 8, verdict(True, "transaction_id", 0.6))
        .otherwise(verdict(False, "unknown", 0.3))
    )


def base64url(data: Column) -> Column:
    padded = F.rpad(F.translate(data, "-_", "+/"), (F.ceil(F.length(data) / 4) * 4).cast("int"), F.lit("="))
    return F.decode(F.unbase64(padded), "UTF-8")


def html_plain(html: Column) -> Column:
    """Markup as blanks, blanks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"(?s)<[^>]*>", " "), r"\s+", " "))


def mail_timestamp(html: Column) -> Column:
    raw = found(html, MAIL_TIME, 0)
    return F.coalesce(F.try_to_timestamp(raw, F.lit("d MMM yyyy, h:mm a")), F.try_to_timestamp(raw, F.lit("d MMMM yyyy, h:mm a")))


def mail_fields(text: Column) -> Column:
    return F.struct(found(text, f"(?i){MAIL_ID}").alias("transaction_id"), whole_number(found(text, f"(?i){MAIL_AMOUNT}")).alias("amount"))


# What captions are searched for, in this order.
CAPTION_CATEGORIES = {
    "dress": ["dress", "gown", "frock"],
    "shirt": ["shirt", "blouse", "top"],
    "tshirt": ["t-shirt", "tshirt", "t shirt"],
    "pants": ["pants", "trousers", "jeans"],
    "shorts": ["shorts"],
    "skirt": ["skirt"],
    "jacket": ["jacket", "blazer", "coat"],
    "sweater": ["sweater", "pullover", "cardigan"],
    "shoes": ["shoes", "sneakers", "boots", "sandals"],
    "bag": ["bag", "purse", "backpack"],
    "accessory": ["scarf", "hat", "belt", "tie"],
}
CAPTION_COLORS = ["red", "blue", "green", "black", "white", "yellow", "pink", "purple", "orange", "brown", "grey", "gray", "beige", "navy", "maroon"]
CAPTION_SLEEVES = {"sleeveless": ["sleeveless", "no sleeve"], "long_sleeve": ["long sleeve"], "short_sleeve": ["short sleeve"]}


def first_keyword(text: Column, words: dict[str, list[str]]) -> Column:
    """The first label with a word that occurs in the text; ``unknown`` if none has."""
    low = F.lower(text)
    return F.coalesce(*[F.when(reduce(lambda a, b: a | b, [low.contains(w) for w in ws]), label) for label, ws in words.items()], F.lit("unknown"))


def caption_attributes(caption: Column) -> Column:
    return F.struct(first_keyword(caption, CAPTION_CATEGORIES).alias("category"), first_keyword(caption, {c: [c] for c in CAPTION_COLORS}).alias("color"), first_keyword(caption, CAPTION_SLEEVES).alias("sleeve_type"))


def decimals(value: Column, n: int = 2) -> Column:
    """A number with ``n`` decimals, a tie to the even one."""
    return F.bround(value, n)
