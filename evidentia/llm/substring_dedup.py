"""Repeated passages by line, paragraph or sentence hashing.

A pass over the texts cuts them into units and gives each a 128-bit digest of its normalised form and its place. Only
the digests are grouped: each keeps the place of its earliest unit, combined before the shuffle. Units of a digest that
occurs again are joined with that place and removed unless it is their own; the original offsets stay with them.

A passage may begin and end anywhere in a line, so the query cuts lines further, where their own words say so: after each
word whose hash is a multiple of ``EVERY`` (kind ``words``), or at sentence ends (``sentence``). A unit then begins at every cut
and takes in what follows up to the first cut that gives it enough words: units overlap, each is long enough not to
repeat by chance, and two texts that share a passage share all units that lie within it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, only, written

#: Shorter units are never removed: short lines repeat by chance.
MIN_WORDS = 10
#: One of so many different words, on average, ends a part of a line.
EVERY = 10
#: A removed run of so many words, not all of them from the document itself, is counted as a passage.
PASSAGE_WORDS = 20
#: Kinds whose units overlap and make one span in a row.
RUNS = ("sentence", "words")
_BREAKS = {"line": re.compile(r"\n"), "paragraph": re.compile(r"\n[ \t\r]*\n\s*"), "sentence": re.compile(r"\n|(?<=[.!?])[ \t]|[。！？]")}


_NO_WORD = re.compile("[^a-z0-9_\x80-\U0010ffff]+")
#: Blocks of scripts that put no blanks between words; each character there counts as a word.
UNSPACED = "฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿"
_UNSPACED = re.compile(f"[{UNSPACED}]")


def normal(unit: str) -> str:
    """The words in lower case, one space between them: ASCII punctuation does not tell units apart."""
    return _NO_WORD.sub(" ", unit.lower()).strip()


def size(form: str) -> int:
    """Words of a normal form, and the characters of scripts without blanks."""
    return form.count(" ") + 1 + (0 if form.isascii() else len(_UNSPACED.findall(form))) if form else 0


#: Word characters that are not of those scripts.
SPACED = "a-zA-Z0-9_\x80-\u0dff\u0f00-\u0fff\u10a0-\u177f\u1800-\u303f\u3100-\u33ff\u4dc0-\u4dff\ua000-\uf8ff\ufb00-\U0010ffff"
_WORD = re.compile(f"[{UNSPACED}]|[{SPACED}]+")


@lru_cache(1 << 17)
def ends_part(word: str) -> bool:
    """Whether a word (in lower case) is one after which lines are cut."""
    return hashlib.md5(word.encode(errors="surrogatepass"), usedforsecurity=False).hexdigest()[:4] < f"{0x10000 // EVERY:04x}"


def _cut_by_words(text: str) -> Iterator[tuple[int, int]]:
    """Stretches of lines up to the end of a word that ends a part."""
    at = 0
    for line in text.split("\n"):
        start = at
        for found in _WORD.finditer(line):
            if ends_part(found.group().lower()):
                yield start, at + found.end()
                start = at + found.end()
        at += len(line) + 1
        yield start, at - 1


def parts(text: str, kind: str) -> Iterator[tuple[int, int, str, int]]:
    """(start, end, normal form, size) of what stands between breaks, if it has words; offsets are of characters."""
    if kind == "words":
        for start, end in _cut_by_words(text):
            form = normal(text[start:end])
            if form:
                yield start, end, form, size(form)
        return
    at = 0
    for found in [*_BREAKS[kind].finditer(text), None]:
        end = found.start() if found else len(text)
        form = normal(text[at:end])
        if form:
            yield at, end, form, size(form)
        at = found.end() if found else end


def units(text: str, kind: str = "line", min_words: int = MIN_WORDS) -> Iterator[tuple[int, int, str, int, int]]:
    """(start, end, normal form, words before it, words up to its end) of the units that count. A sentence or a part of a line
    that is too short goes on into the next ones; a line or paragraph that is too short does not count."""
    held = list(parts(text, kind))
    before = [0]
    for *_, n in held:
        before.append(before[-1] + n)
    last = 0
    for i, (start, end, form, n) in enumerate(held):
        if n >= min_words:
            yield start, end, form, before[i], before[i + 1]
        elif kind in RUNS:
            last = max(last, i)
            while last < len(held) and before[last + 1] - before[i] < min_words:
                last += 1
            if last == len(held):
                return
            yield start, held[last][1], " ".join([p[2] for p in held[i : last + 1]]), before[i], before[last + 1]


def _again(rows: DataFrame, kind: str, min_words: int) -> tuple[DataFrame, DataFrame]:
    """For ``rows`` (row, doc_id, text): row, doc_id, n_units of each; and all units whose digest occurs again, with
    ``mine`` where the earliest one is this one."""
    out = pa.schema([(c, pa.int64()) for c in ("row", "doc_id", "n_units", "start", "end", "from", "upto", "high", "low")])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row, doc, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                at = len(found)
                for start, end, form, first, upto in units(text or "", kind, min_words):
                    digest = xxhash.xxh3_128_intdigest(form.encode(errors="surrogatepass"))
                    found.append((row, doc, None, start, end, first, upto, (digest >> 64) - (1 << 63), (digest & (1 << 64) - 1) - (1 << 63)))
                found.append((row, doc, len(found) - at, None, None, None, None, None, None))  # the document itself
                if len(found) >= 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], schema=out)
                    found = []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], schema=out)

    placed = written(rows.select("row", "doc_id", "text").mapInArrow(lean(task), ", ".join(f"`{f.name}` long" for f in out)), "units")
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row", "start")
    held = placed.where("start is not null")
    # a table, so that adaptive execution can split the join where a unit is very frequent
    groups = written(held.groupBy("high", "low").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("high", "low", "first"), "repeated-units")
    again = held.join(groups, ["high", "low"]).select("row", "start", "end", "from", "upto", (rank == F.col("first")).alias("mine"), F.col("first.doc_id").alias("first_doc_id"), (F.col("first.row") != F.col("row")).alias("other"))
    return placed.where("start is null").select("row", "doc_id", "n_units"), again


def _spans(rows: DataFrame, kind: str, min_words: int) -> DataFrame:
    """row, doc_id, n_units, n_shared, n_removed, removed_chars, removed_words, n_passages, removed."""
    every, again = _again(rows, kind, min_words)
    order = Window.partitionBy("row").orderBy("start", "end")
    reach: Column = F.max(F.when(~F.col("mine"), F.col("upto"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    # sentences or parts in a row are one span, lines and paragraphs one each
    begins = ~F.col("mine") & (F.coalesce(F.col("from") > reach, F.lit(True)) if kind in RUNS else F.lit(True))
    goes = lambda c: F.when(~F.col("mine"), F.col(c))
    runs = again.withColumn("begins", begins.cast("int")).withColumn("run", F.sum("begins").over(order))
    spans = runs.groupBy("row", "run").agg(F.count(F.lit(1)).alias("n"), F.min(goes("start")).alias("start"), F.max(goes("end")).alias("end"), F.min_by("first_doc_id", goes("start")).alias("first_doc_id"), F.coalesce(F.bool_or(goes("other")), F.lit(False)).alias("other"), (F.max(goes("upto")) - F.min(goes("from"))).alias("words"))
    span = F.when(F.col("start").isNotNull(), F.struct("start", "end", "first_doc_id"))
    per_row = spans.groupBy("row").agg(F.sum("n").alias("n_shared"), F.count("start").alias("n_removed"), F.sum(F.col("end") - F.col("start")).alias("removed_chars"), F.sum("words").alias("removed_words"), F.count_if((F.col("words") >= PASSAGE_WORDS) & F.col("other")).alias("n_passages"), F.sort_array(F.collect_list(span)).alias("removed"))
    full = every.join(per_row, "row", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_shared", "n_removed", "removed_chars", "removed_words", "n_passages")]
    empty = F.array().cast("array<struct<start:bigint,end:bigint,first_doc_id:bigint>>")
    return full.select("row", "doc_id", "n_units", *counts, F.coalesce("removed", empty).alias("removed"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kind: str = "line", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_units, n_shared (units that stand elsewhere, too), n_removed, removed_chars,
    removed_words, n_passages (removed spans of ``PASSAGE_WORDS`` or more that repeat another document) and ``removed``, an array of
    (start, end, first_doc_id) in the order of the text; of sentences or parts in a row first_doc_id is that of the first one.

    Units rank by doc_id (null last), then by place in the text; the earliest of equal units stays. Rows that share a
    doc_id rank one after the other, so a repeated row loses what the first has. Null and empty texts have no units.
    An empty table gives no rows. Other columns are not read.
    """
    rows = only(docs, doc_id=id_col, text=text_col).select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return _spans(rows, kind, min_words).drop("row")


def without(text: str, removed: list[tuple[int, int]]) -> str:
    """The text without the spans and the line break that follows each."""
    kept, at = [], 0
    for start, end in removed:
        kept.append(text[at:start])
        at = end + (text[end : end + 1] == "\n")
    return "".join([*kept, text[at:]])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kind: str = "line", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the repeated units cut out of their texts; all rows stay, also those whose ids repeat or are null."""
    columns = docs.columns
    held = written(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("doc")), "rows")
    rows = held.select("row", F.col("doc").getField(id_col).cast("long").alias("doc_id"), F.col("doc").getField(text_col).alias("text"))
    spans = _spans(rows, kind, min_words).where("n_removed > 0").select("row", "removed")

    @F.pandas_udf("string")
    def cut(text, removed):
        return text.combine(removed, lambda t, r: t if t is None or r is None else without(t, [(x["start"], x["end"]) for x in r]))

    text = F.col("doc").getField(text_col)
    joined = held.join(spans, "row", "left").withColumn("_text", F.when(F.col("removed").isNull(), text).otherwise(cut(text, "removed")))
    return joined.select(*[(F.col("_text") if c == text_col else F.col("doc").getField(c)).alias(c) for c in columns])


def _sql_class(characters: str) -> str:
    return "".join(c if c.isascii() and c.isprintable() else f"\\x{{{ord(c):04X}}}" for c in characters)


_SQL_UNSPACED, _SQL_SPACED = _sql_class(UNSPACED), _sql_class(SPACED)
#: DuckDB SQL for ``op10_substring_dedup``: units from each part of a line on.
ORACLE_SQL = f"""
with t as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents),
n as (select r, doc_id, regexp_extract_all(unnest(l), '[^{_SQL_SPACED}{_SQL_UNSPACED}]*(?:[{_SQL_UNSPACED}]|[{_SQL_SPACED}]+)|[^{_SQL_SPACED}{_SQL_UNSPACED}]+') as ps, unnest(range(len(l))) as li from t),
w as (select r, doc_id, li, unnest(ps) as piece, unnest(range(len(ps))) as pi from n),
x as (select *, coalesce(substr(md5(nullif(lower(regexp_extract(piece, '(?:[{_SQL_UNSPACED}]|[{_SQL_SPACED}]+)$')), '')), 1, 4) < '{0x10000 // EVERY:04x}', false)::int as cut from w),
y as (select *, sum(cut) over before as c, coalesce(sum(length(piece)) over before, 0) + li as pos from x window before as (partition by r order by li, pi rows between unbounded preceding and 1 preceding)),
z as (select r, doc_id, li, coalesce(c, 0) as c, min(pos) as start, sum(length(piece)) as n, string_agg(piece, '' order by pi) as piece from y group by r, doc_id, li, coalesce(c, 0)),
f as (
    select r, doc_id, row_number() over (partition by r order by start) as i, n, start, trim(regexp_replace(lower(piece), '[^a-z0-9_\\x{{80}}-\\x{{10FFFF}}]+', ' ', 'g')) as form from z
),
p as (
    select *, length(form) - length(replace(form, ' ', '')) + 1 + length(regexp_replace(form, '[^\\x{{0E00}}-\\x{{0EFF}}\\x{{1000}}-\\x{{109F}}\\x{{1780}}-\\x{{17FF}}\\x{{3040}}-\\x{{30FF}}\\x{{3400}}-\\x{{4DBF}}\\x{{4E00}}-\\x{{9FFF}}\\x{{F900}}-\\x{{FAFF}}]+', '', 'g')) as words
    from f where form <> ''
),
g as (
    select r, doc_id, start, sum(words) over b - words as w0, list(form) over a as fs, list(words) over a as ws, list(start + n) over a as es
    from p window a as (partition by r order by i rows between current row and {MIN_WORDS - 1} following), b as (partition by r order by i)
),
k as (select *, list_filter(range(1, len(ws) + 1), lambda x: list_sum(ws[1:x]) >= {MIN_WORDS})[1] as k from g),
u as (select r, doc_id, start, es[k] as e, w0, w0 + list_sum(ws[1:k]) as w1, array_to_string(fs[1:k], ' ') as form from k where k is not null),
m as (select *, row_number() over w as k, count(*) over (partition by form) as n, first_value(doc_id) over w as first_doc_id, first_value(r) over w as first_r from u window w as (partition by form order by doc_id nulls last, r, start)),
c as (select r, count(*) as n_units, count(*) filter (n > 1) as n_shared from m group by r),
o as (select *, case when w0 <= max(w1) over (partition by r order by start, e rows between unbounded preceding and 1 preceding) then 0 else 1 end as begins from m where k > 1),
q as (select *, sum(begins) over (partition by r order by start, e) as run from o),
s as (select r, run, min(start) as s, max(e) as e, max(w1) - min(w0) as words, bool_or(first_r <> r) as other, arg_min(first_doc_id, start) as first_doc_id from q group by r, run),
d as (
    select r, count(*) as n_removed, sum(e - s) as removed_chars, sum(words) as removed_words, count(*) filter (words >= {PASSAGE_WORDS} and other) as n_passages,
        string_agg(s || '-' || e || ':' || coalesce(first_doc_id::varchar, 'null'), ' ' order by s) as removed
    from s group by r
)
select doc_id, coalesce(n_units, 0)::bigint as n_units, coalesce(n_shared, 0)::bigint as n_shared, coalesce(n_removed, 0)::bigint as n_removed, coalesce(removed_chars, 0)::bigint as removed_chars,
    coalesce(removed_words, 0)::bigint as removed_words, coalesce(n_passages, 0)::bigint as n_passages, coalesce(removed, '') as removed
from t left join c using (r) left join d using (r)
"""
