"""Pluggable models: OCR engines, embedders and language models enter as functions over batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import model_answer, sanitized

_registry: dict[tuple[str, str], tuple[Callable, str]] = {}
#: How much of a text is sent to a language model, first and when asked again.
PROMPT_CHARS, RETRY_CHARS = 2000, 1500


def register(kind: str, name: str, load: Callable[[], Callable[[pd.Series], pd.Series]], returns: str) -> None:
    """``load`` is called once in each worker and gives a function from a batch of inputs to a batch of outputs."""
    _registry[kind, name] = (load, returns)


def register_ocr(name: str, load) -> None:
    register("ocr", name, load, "string")


def register_embedder(name: str, load) -> None:
    register("embed", name, load, "array<float>")


def register_llm(name: str, load) -> None:
    register("llm", name, load, "string")


def apply(kind: str, name: str, value: Column) -> Column:
    load, returns = _registry[kind, name]

    @F.pandas_udf(returns)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            yield model(batch)

    return run(value)


def extract_with_model(df: DataFrame, name: str, text: str = "text") -> DataFrame:
    """Adds ``answer`` (the fields) and ``answer_source``: ``llm`` for the first answer, ``llm_retry`` for one to the
    sanitised text, asked only where the first could not be read; null where neither could."""
    first = df.withColumn("_first", model_answer(apply("llm", name, F.substring(text, 1, PROMPT_CHARS))))
    again = F.when(F.col("_first").isNull(), F.substring(sanitized(F.col(text)), 1, RETRY_CHARS))
    second = first.withColumn("_second", model_answer(apply("llm", name, again)))
    source = F.when(F.col("_first").isNotNull(), "llm").when(F.col("_second").isNotNull(), "llm_retry")
    return second.withColumn("answer", F.coalesce("_first", "_second")).withColumn("answer_source", source).drop("_first", "_second")
