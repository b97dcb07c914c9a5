"""Recursive message payloads flattened: a scalar function for columns and a table function for parts."""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.udtf import UserDefinedTableFunction


class _Text(HTMLParser):
    def __init__(self):
        super().__init__()
        self.parts: list[str] = []

    def handle_data(self, data: str) -> None:
        if data.strip():
            self.parts.append(data.strip())


def html_to_text(html: str) -> str:
    """Stripped text nodes joined by blanks."""
    parser = _Text()
    parser.feed(html)
    parser.close()
    return " ".join(parser.parts)


def _decoded(part: dict) -> str | None:
    body = part.get("body")
    data = body.get("data") if isinstance(body, dict) else None
    if not data or not isinstance(data, str):
        return None
    try:
        return base64.urlsafe_b64decode(data + "=" * (-len(data) % 4)).decode()
    except ValueError:
        return None


def _kind(part: dict) -> str:
    kind = part.get("mimeType")
    return kind if isinstance(kind, str) else ""


def _below(part: dict) -> list:
    parts = part.get("parts")
    return parts[::-1] if isinstance(parts, list) else []


def mime_parts(payload: str | None) -> Iterator[tuple[str, str]]:
    """(mime type, decoded content) of the text parts in order, however many or deep; unreadable ones are skipped, and so
    is what is no object where one belongs. A payload that nests deeper than JSON can be read has no parts."""
    try:
        root = json.loads(payload) if payload else None
    except (ValueError, RecursionError):
        root = None
    if not isinstance(root, dict):
        return
    if "parts" not in root:
        content = _decoded(root)
        if content is not None:
            yield _kind(root), content
        return
    stack = _below(root)
    while stack:
        part = stack.pop()
        if not isinstance(part, dict):
            continue
        kind, content = _kind(part), _decoded(part)
        if kind in ("text/plain", "text/html") and content is not None:
            yield kind, content
        elif "parts" in part:
            stack.extend(_below(part))


def flat_text(payload: str | None) -> str:
    return "".join((html_to_text(c) if kind == "text/html" else c) + "\n" for kind, c in mime_parts(payload))


@F.pandas_udf(StringType())
def payload_text(payload: pd.Series) -> pd.Series:
    """A message's text; markup as text."""
    return payload.map(flat_text)


@F.pandas_udf(StringType())
def payload_html(payload: pd.Series) -> pd.Series:
    """The markup of the last part that has any."""
    return payload.map(lambda p: next((c for kind, c in reversed(list(mime_parts(p))) if kind == "text/html"), None))


class _Parts:
    def eval(self, payload: str):
        yield from mime_parts(payload)


def parts_table() -> UserDefinedTableFunction:
    """The table function (payload) -> mime_type, content, to be registered or used laterally."""
    return F.udtf(_Parts, returnType="mime_type string, content string")


class _Lines:
    def eval(self, text: str):
        for i, line in enumerate(x for x in (y.strip() for y in (text or "").replace("\r", "\n").split("\n")) if x):
            yield i, line


def lines_table() -> UserDefinedTableFunction:
    """The table function (text) -> line_no, line."""
    return F.udtf(_Lines, returnType="line_no int, line string")
