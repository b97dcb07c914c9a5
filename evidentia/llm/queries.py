"""The queries of this subpackage: name -> (function of (spark, sf_dir), DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup, exact_dedup, hard_negatives, lm_scoring, mixing, substring_dedup
from .alignment import align
from .common import table
from .embedding_dedup import near_embeddings
from .exact_dedup import exact_groups
from .hard_negatives import mine
from .html_text import extract
from .language import identify
from .lm_scoring import score_documents
from .mixing import mix
from .near_dedup import near_duplicates
from .packing import pack
from .substring_dedup import repeated_spans
from .token_count import count_tokens
from .transducer import decode, encode


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document, with what each of its copies gives and to which output shard, as "copy:shard:words"."""
    found = mix(table(spark, sf_dir, "documents"), shards=mixing.OUTPUT_SHARDS)
    given = F.transform(F.sort_array("copies"), lambda d: F.concat_ws(":", d["copy"].cast("string"), d["shard"].cast("string"), d["words"].cast("string")))
    return found.withColumn("shards", F.array_join(given, " ")).drop("copies")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op6_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_embeddings(table(spark, sf_dir, "embeddings"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: how much of it stands elsewhere and earlier, and where, as "start-end:first document"."""
    spans = F.transform("removed", lambda x: F.concat(x["start"], F.lit("-"), x["end"], F.lit(":"), F.coalesce(x["first_doc_id"].cast("string"), F.lit("null"))))
    return repeated_spans(table(spark, sf_dir, "documents"), kind="words").withColumn("removed", F.array_join(spans, " "))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return mine(vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))


def op12_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and what they decode to, as digests."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN).withColumn("ids_sha256", F.sha2("ids", 256))
    return decode(encoded, ranks).withColumn("decoded_sha256", F.sha2(F.col("decoded").cast("binary"), 256)).drop("decoded")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), digest=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": op1_packing,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_mixing": op3_mixing,
        "op4_near_dedup": op4_near_dedup,
        "op5_lm_scoring": op5_lm_scoring,
        "op6_token_count": op6_token_count,
        "op7_html_text": op7_html_text,
        "op8_language_id": op8_language_id,
        "op9_embedding_dedup": op9_embedding_dedup,
        "op10_substring_dedup": op10_substring_dedup,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_bpe_transducer": op12_bpe_transducer,
        "op13_token_alignment": op13_token_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_dedup": exact_dedup.ORACLE_SQL,
        "op3_mixing": mixing.ORACLE_SQL,
        "op5_lm_scoring": lm_scoring.ORACLE_SQL,
        "op9_embedding_dedup": embedding_dedup.ORACLE_SQL,
        "op10_substring_dedup": substring_dedup.ORACLE_SQL,
        "op11_hard_negatives": hard_negatives.ORACLE_SQL,
    }
