"""Token counts by a two-tier lookup on the map side.

Tier one is a table of frequent pre-tokens and their token counts, made from documents that a hash picks all over the
corpus, and broadcast; its entries and its keys' characters are bounded, so it does not grow with the corpus. Tier
two is each worker's cache of the pre-tokens that it met besides. Both hold what the library says of a pre-token, so
the sample decides only how often a worker asks the library, never a count. No pre-token but the sample's is shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, only
from .tokens import PreTokens

#: The broadcast table is made from about so many documents and has so many entries; a task counts so many at most.
SAMPLE_DOCS = 1000
TABLE_ENTRIES = 30_000
TABLE_KEY_CHARS = 32
TASK_ENTRIES = 8 * TABLE_ENTRIES


def frequent_lengths(docs: DataFrame, tokenizer: str, sample_docs: int = SAMPLE_DOCS, entries: int = TABLE_ENTRIES) -> dict[str, int]:
    """{pre-token: tokens} of the most frequent pre-tokens of about ``sample_docs`` whole documents, picked by a hash."""
    one_of = max(1, -(-docs.count() // max(1, sample_docs)))
    picked = docs.where(F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(one_of)) == 0).select("text")
    out = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = None, Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                known = known or PreTokens(tokenizer, "byte")
                for words in known.cut(text) if text and not known.special(text) else ():
                    seen.update(w for w in words if len(w) <= TABLE_KEY_CHARS)
                if len(seen) > TASK_ENTRIES:
                    seen = Counter(dict(seen.most_common(TASK_ENTRIES // 2)))
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], schema=out)

    counts = picked.mapInArrow(lean(task), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    known = PreTokens(tokenizer, "byte")
    return {r.word: known.count(r.word) for r in counts.orderBy(F.desc("n"), "word").limit(entries).collect()}


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit for each row.

    Null text counts as empty: 0 bytes, 0 tokens. Repeated rows and null ids give a row each; an empty table gives
    none; special strings in a text count as the library's default has it. Other columns are not read.
    """
    rows = only(docs, doc_id=id_col, text=text_col)
    table = rows.sparkSession.sparkContext.broadcast(frequent_lengths(rows, tokenizer, sample_docs))
    out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = PreTokens(tokenizer, "byte", table.value).count
        for batch in batches:
            n = [count(text) if text else 0 for text in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], schema=out)

    sized = rows.select(F.col("doc_id").cast("long"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return sized.mapInArrow(lean(task), "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
