"""Typed fields from the text of receipts, by prioritised patterns and by fuzzy keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import partial_ratio, words_alike
from ..functions.text import AMOUNT_CONTEXT, RECEIPT_AMOUNTS, RECEIPT_DATES, all_found, extraction_method, first_of, found, has_context, is_date, is_transaction_id, lines, receipt_status

# Where an identifier is looked for, in this order.
ID_PATTERNS = [
    r"Document\s*(?:No\.?|Ho's|Hos|Ho|Number|Num)\s*[:#]?\s*([A-Z0-9\-/]{4,})",
    r"(?:Transaction\s*ID|Trans\s*ID|Invoice\s*No\.?|Invoice\s*Number|Bill\s*No\.?|Bill\s*Number|Receipt\s*No\.?|Receipt\s*Number|Doc\s*No\.?|Document\s*No\.?|Ref\s*No\.?|Reference\s*No\.?|Order\s*No\.?|Order\s*Number|Order\s*ID|ID)\s*[:#\s]*\s*([A-Z0-9\-/]+)",
    r"(?:Transaction|Invoice|Bill|Receipt|Document|Reference|Order)\s*(?:ID|No\.?|Number)\s*([A-Z0-9\-/]+)",
    r"(?:Transaction\s*ID|Trans\s*ID|Invoice\s*No\.?|Bill\s*No\.?|Receipt\s*No\.?|Doc\s*No\.?)\s*[:#\s]*\s*\n\s*([A-Z0-9\-/]+)",
    r"(?:INV|INVOICE|BILL|RECEIPT|DOC|REF|ORDER|TRANS|TXN)\s*[:#]?\s*([A-Z0-9\-/]{3,})",
    r"Document\s*[:#]?\s*([A-Z0-9\-/]{4,})",
]
DOCUMENT_PATTERNS = [r"document\s*(?:no|ho's|hos|ho|number|num)\s*[:#]?\s*([A-Z0-9\-/]{3,})", r"document\s*[:#]?\s*([A-Z0-9\-/]{3,})"]
ID_KEYWORDS = [
    "transaction id", "trans id", "invoice no", "invoice number", "bill no", "bill number", "receipt no", "receipt number",
    "doc no", "document no", "document", "ref no", "reference", "order no", "order number", "order id",
]
FUZZY_KEYWORDS = {
    "transaction_id": [
        "document no", "document number", "invoice id", "invoice no", "invoice number", "bill id", "bill no", "bill number", "transaction id", "trans id", "receipt no",
        "receipt number", "receipt id", "doc no", "doc number", "ref no", "reference no", "order no", "order number", "order id", "ref", "reference", "ticket no",
    ],
    "amount": ["amount", "total", "amt", "total amount", "grand total", "net total", "subtotal", "sub total", "sum", "payment", "paid", "balance"],
    "date": ["date", "invoice date", "bill date", "payment date", "transaction date", "issued on", "issued date", "due date"],
}
FUZZY_VALUES = {"transaction_id": r"(?i)([A-Z0-9\-/]{3,})", "amount": r"([\d,]+\.?\d*)", "date": r"(\d{1,2}[/\-\.]\d{1,2}[/\-\.]\d{2,4})"}
FUZZY_THRESHOLD = 70
# One pattern for each field, for receipts with plain labels.
PLAIN_PATTERNS = {
    "transaction_id": r"(?:Transaction\s*ID|Trans\s*ID|Invoice\s*No\.?|Invoice|Bill\s*No\.?|Bill|Receipt\s*No\.?|Receipt|Doc\s*No\.?|Doc)\s*[:#\s]*\n?\s*([\w\-/]+)",
    "amount": r"(?:Amount|Total|Grand\s*Total|Amount\s*Paid|Net\s*Total)\s*[:\s]*\$?\n?\s*([\d,.]+)",
    "date": r"(?:Date|Invoice\s*Date|Bill\s*Date|Issued\s*On)\s*[:\s]*\n?\s*([\d/.-]+)",
}


def _pair(value: Column, context: Column) -> Column:
    return F.struct(value.alias("value"), context.alias("context"))


def _first_valid(pairs: Column) -> Column:
    return F.get(F.filter(pairs, lambda x: is_transaction_id(x["value"], x["context"])), F.lit(0))["value"]


def _in_context(text: Column, pattern: str, around: int = 50) -> Column:
    """Matches of a pattern with the text around each: places are found one after the other."""
    matches = F.zip_with(all_found(text, pattern, 0), all_found(text, pattern), lambda m, v: F.struct(m.alias("match"), v.alias("value")))
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<value:string,context:string>>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        at = F.call_function("locate", x["match"], text, state["at"])
        first = F.greatest(F.lit(1), at - around)
        context = F.substr(text, first, at + F.length(x["match"]) + around - first)
        return F.struct((at + F.length(x["match"])).alias("at"), F.concat(state["out"], F.array(_pair(F.trim(x["value"]), context))).alias("out"))

    return F.aggregate(matches, start, step, lambda s: s["out"])


def id_by_patterns(text: Column) -> Column:
    """Six patterns anywhere in the text. A match itself gives the context that a candidate needs, except for three short
    words of the fifth pattern, where 50 characters around it do."""
    kept = F.replace(text, F.lit("\r"), F.lit("\n"))
    tries = []
    for i, pattern in enumerate(ID_PATTERNS):
        p = f"(?im){pattern}"
        pairs = _in_context(kept, p) if i == 4 else F.transform(all_found(kept, p), lambda v: _pair(F.trim(v), F.lit("id")))
        tries.append(_first_valid(pairs))
    return F.upper(F.translate(F.coalesce(*tries), "OIS", "015"))


def id_by_keywords(rows: Column) -> Column:
    """Line by line: the document patterns, then after each keyword the longest token, then how the next line begins."""

    def of_line(line: Column, i: Column) -> Column:
        low, following = F.lower(line), F.get(rows, i + 1)
        document = F.filter(F.array(*[_pair(F.upper(found(low, p)), line) for p in DOCUMENT_PATTERNS]), lambda x: low.contains("document"))

        def of_keyword(word: Column) -> Column:
            after = F.regexp_replace(F.trim(F.substr(line, F.call_function("locate", word, low) + F.length(word))), r"^[:#\s\-]+", "")
            tokens = all_found(after, r"(?i)([A-Z0-9\-/]{4,})")
            longest = F.aggregate(tokens, F.lit(""), lambda best, x: F.when(F.length(x) > F.length(best), x).otherwise(best))
            own = F.upper(F.coalesce(F.nullif(longest, F.lit("")), found(after, r"(?i)([A-Z0-9\-/]{3,})")))
            following_id = F.upper(found(following, r"(?i)^([A-Z0-9\-/]{3,})"))
            return F.array(_pair(own, line), _pair(following_id, F.concat_ws(" ", line, following)))

        hits = F.filter(F.array(*map(F.lit, ID_KEYWORDS)), lambda w: low.contains(w))
        return F.concat(document, F.flatten(F.transform(hits, of_keyword)))

    return _first_valid(F.flatten(F.transform(rows, of_line)))


def _around(rows: Column, i: Column) -> Column:
    return F.concat_ws(" ", F.when(i > 0, F.get(rows, i - 1)), F.get(rows, i), F.get(rows, i + 1))


def id_by_whole_line(rows: Column) -> Column:
    """Lines that are one token; of letters alone only near a word that speaks of identifiers."""
    pairs = F.transform(rows, lambda line, i: _pair(F.upper(line), _around(rows, i)))
    return _first_valid(F.filter(pairs, lambda x: x["value"].rlike(r"^[A-Z0-9\-/]{4,}$") & (x["value"].rlike("[0-9]") | has_context(x["context"]))))


def id_by_number(rows: Column) -> Column:
    """Lines of 4 to 15 digits near a word for identifiers and none for amounts."""
    pairs = F.transform(rows, lambda line, i: _pair(line, _around(rows, i)))
    return _first_valid(F.filter(pairs, lambda x: x["value"].rlike(r"^\d{4,15}$") & has_context(x["context"]) & ~has_context(x["context"], AMOUNT_CONTEXT)))


def with_transaction_id(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds what each strategy finds (by_patterns, by_keywords, by_line, by_number) and ``transaction_id``, the first."""
    rows = F.col("_lines")
    tried = df.withColumn("_lines", lines(F.col(text))).withColumns({"by_patterns": id_by_patterns(F.col(text)), "by_keywords": id_by_keywords(rows), "by_line": id_by_whole_line(rows), "by_number": id_by_number(rows)})
    return tried.withColumn("transaction_id", F.coalesce("by_patterns", "by_keywords", "by_line", "by_number")).drop("_lines")


def parse_receipts(df: DataFrame, text: str = "text", engine: str = "pytesseract") -> DataFrame:
    """Adds transaction_id, amount, date, verification_status and extraction_method. Null or empty texts fail."""
    body = F.col(text)
    dates = [F.get(F.filter(F.transform(all_found(body, f"(?im){p}"), lambda x: F.trim(x)), is_date), F.lit(0)) for p in RECEIPT_DATES]
    date = F.coalesce(*dates, first_of(body, RECEIPT_DATES[:2]))
    found_id = with_transaction_id(df, text).withColumn("date", date).withColumn("amount", first_of(body, RECEIPT_AMOUNTS))
    tid = F.col("transaction_id")
    clean = found_id.withColumn("transaction_id", F.when(~tid.eqNullSafe(F.col("date")) & ~is_date(tid), tid)).drop("by_patterns", "by_keywords", "by_line", "by_number")
    return clean.withColumn("verification_status", receipt_status([F.col(c) for c in ("transaction_id", "amount", "date")])).withColumn("extraction_method", extraction_method(F.lit(engine), engine))


def with_fuzzy_values(df: DataFrame, rows: str, fields: tuple[str, ...] = tuple(FUZZY_KEYWORDS), threshold: float = FUZZY_THRESHOLD) -> DataFrame:
    """Adds a column for each field (``_fuzzy_`` and its name): of an array of lines the first value after a keyword that a
    line has or nearly has; null: none.

    Lines in order, keywords in order: a keyword that stands in the line gives what follows it there, and any keyword,
    also one of which the line has something alike by ``threshold``, how the next line begins. All in one row: nothing is
    exploded, shuffled or joined back, and only the shapes of lines go to Python, once for all fields.
    """
    keywords = [word for field in fields for word in FUZZY_KEYWORDS[field]]
    words = F.array(*map(F.lit, keywords))
    clean = df.withColumn("_clean", F.filter(F.transform(rows, lambda x: F.trim(x)), lambda x: x != ""))
    # keywords have letters and blanks only, so all other characters of a line can be one and the same
    shapes = F.transform("_clean", lambda x: F.regexp_replace(F.lower(x), "[^a-z ]", "0"))
    likely = clean.withColumn("_likely", words_alike(shapes, keywords, threshold))
    following = F.slice("_clean", F.lit(2), F.size("_clean"))
    pairs = F.filter(F.arrays_zip(F.col("_clean").alias("line"), following.alias("following"), F.col("_likely").alias("likely")), lambda x: F.size(x["likely"]) > 0)
    paired = likely.withColumn("_pairs", pairs)

    def value(field: str) -> Column:
        first = sum(len(FUZZY_KEYWORDS[f]) for f in fields[: fields.index(field)])
        pattern = FUZZY_VALUES[field]
        begins = pattern.replace("(?i)(", "(?i)^(", 1) if pattern.startswith("(?i)") else "^" + pattern

        def after(line: Column, word: Column) -> Column:
            at = F.call_function("locate", word, F.lower(line))
            rest = F.regexp_replace(F.trim(F.substr(line, at + F.length(word))), r"^[:#\s\-]+", "")
            return F.when(at > 0, found(rest, pattern))

        def of_line(x: Column) -> Column:
            mine = F.filter(x["likely"], lambda n: (n >= first) & (n < first + len(FUZZY_KEYWORDS[field])))
            return F.flatten(F.transform(mine, lambda n: F.array(after(x["line"], F.get(words, n)), found(x["following"], begins))))

        tried = F.filter(F.flatten(F.transform("_pairs", of_line)), lambda x: x.isNotNull())
        if field == "transaction_id":
            tried = F.filter(F.array_distinct(F.transform(tried, lambda x: F.upper(x))), lambda x: is_transaction_id(x, F.lit(None).cast("string")))
        return F.get(tried, F.lit(0))

    return paired.withColumns({f"_fuzzy_{field}": value(field) for field in fields}).drop("_clean", "_likely", "_pairs")


def fuzzy_field(df: DataFrame, key: str, rows: str, field: str, threshold: float = FUZZY_THRESHOLD) -> DataFrame:
    """(key, value): one field of ``with_fuzzy_values`` for each row that has it."""
    fuzzy = with_fuzzy_values(df.select(key, rows), rows, (field,), threshold)
    return fuzzy.select(key, F.col(f"_fuzzy_{field}").alias(field)).where(F.col(field).isNotNull())


def parse_segments(df: DataFrame, key: str = "case_id", rows: str = "segments") -> DataFrame:
    """Fields of receipts whose OCR gave separate segments (an array of strings): patterns first, fuzzy keywords next."""
    text = F.array_join(F.filter(rows, lambda x: F.trim(x) != ""), "\n")
    parsed = with_fuzzy_values(with_transaction_id(df.select(key, rows, text.alias("_text")), "_text"), rows)
    return parsed.select(key, F.coalesce("transaction_id", "_fuzzy_transaction_id").alias("transaction_id"), F.col("_fuzzy_amount").alias("amount"), F.col("_fuzzy_date").alias("date"))


def parse_plain(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds transaction_id, amount and date by one pattern each, as they stand; null where a label is missing."""
    return df.withColumns({field: found(F.col(text), f"(?im){pattern}") for field, pattern in PLAIN_PATTERNS.items()})


def first_token(df: DataFrame, key: str, rows: str, keywords: list[str], threshold: float = FUZZY_THRESHOLD) -> DataFrame:
    """(key, value): the first token of the first line that is like one of the keywords. That is mostly the label itself;
    ``fuzzy_field`` looks behind it."""
    each = df.select(key, F.posexplode(rows).alias("line_no", "line")).select(key, "line_no", "line", F.explode(F.array(*map(F.lit, keywords))).alias("word"))
    alike = each.where(partial_ratio(F.lower("line"), F.lower("word"), threshold) >= threshold).withColumn("value", found(F.col("line"), r"([A-Za-z0-9\-./]+)"))
    return alike.where("value is not null").groupBy(key).agg(F.min_by("value", "line_no").alias("value"))
