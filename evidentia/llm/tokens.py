"""Exact token ids and token counts from public tokenizer files, one pre-token at a time.

A pre-token's ids depend on nothing around it, so a worker asks the library once for each different pre-token and
looks up the rest. Where every character of a text is of a range in which the cut is beyond doubt, one pattern cuts it;
any other text is cut by the library's own normaliser and pre-tokeniser. Only texts that may hold special strings go to
the library as a whole. Either way the ids are the library's.
"""

from __future__ import annotations

import re
import struct
import unicodedata
from collections.abc import Iterator

from .common import remembered

#: The characters whose category, case and normal form the fast path relies on.
SAFE_TEXT = re.compile("[\\t\\n\\r\\x20-\\x7e\\u00a1-\\u012f]*")
#: Pre-tokens that one worker remembers before it starts over.
CACHE_ENTRIES = 320_000
#: Characters cut at a time, so that a very long text never becomes one list.
STEP = 1 << 20
_BOUNDARY = re.compile(r"\S(?= \S)")


def _category(first: str) -> str:
    return "".join(re.escape(chr(i)) for i in range(0x130) if unicodedata.category(chr(i))[0] == first)


def patterns() -> dict[str, tuple[re.Pattern, bool]]:
    """By tokenizer kind: the pre-token pattern over safe text, and whether it is lower-cased first.

    Fixed values: the alternatives of the two patterns, as the tokenizer files give them.
    """
    letter, number = _category("L"), _category("N")
    short = "'s|'t|'re|'ve|'m|'ll|'d"
    return {
        "word": (re.compile(rf"{short}|[{letter}]+|[{number}]|[^\s{letter}{number}]+"), True),
        "byte": (re.compile(rf"{short}| ?[{letter}]+| ?[{number}]+| ?[^\s{letter}{number}]+|\s+(?!\S)|\s+"), False),
    }


def byte_letters() -> dict[int, str]:
    """Byte-level models write each byte as one letter: printable ones as themselves, the rest as letters from 256 on.
    Keys are code points of Latin-1, which stand for bytes."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def steps(text: str, size: int = STEP) -> Iterator[str]:
    """Parts of a text, cut before single spaces between words, where no pre-token crosses."""
    at = 0
    while len(text) - at > size:
        found = _BOUNDARY.search(text, at + size)
        if not found:
            break
        yield text[at : found.end()]
        at = found.end()
    yield text[at:] if at else text


class _Known(dict):
    """pre-token -> value, asking ``miss`` for new ones. Half full, it starts over but still looks at what it had then, so
    what is used again stays; never more than ``most`` own entries in both."""

    def __init__(self, base: dict, miss, most: int):
        super().__init__(base)
        self.base, self.old, self.miss, self.half = base, {}, miss, max(1, most // 2) + len(base)

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.miss(key)
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
            self.update(self.base)
        self[key] = value
        return value


class PreTokens:
    """Ids (as little-endian unsigned 32-bit bytes) and counts of texts for one ``tokenizers`` file."""

    def __init__(self, path: str, kind: str, lengths: dict[str, int] | None = None, cache: int = CACHE_ENTRIES):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.pattern, self.lower = patterns()[kind]
        self._model, self._letters = self.library.model, byte_letters()
        self._ids = _Known({}, lambda word: struct.pack(f"<{len(found := self._word(word))}I", *[t.id for t in found]), cache)
        self._lengths = _Known(lengths or {}, lambda word: len(self._word(word)), cache)

    def _word(self, word: str) -> list:
        """The library's model on one pre-token, which needs no normalising or cutting any more."""
        return self._model.tokenize(word.encode().decode("latin-1").translate(self._letters))

    def _encode(self, text: str) -> bytes:
        ids = self.library.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def special(self, text: str) -> bool:
        """Whether a special string may be in the text; all of them begin with "<|"."""
        return "<|" in text

    def cut(self, text: str) -> Iterator[list[str]]:
        """Lists of pre-tokens, normalised, of a text without special strings."""
        safe = SAFE_TEXT.fullmatch(text) is not None
        for part in steps(text):
            yield self.pattern.findall(part.lower() if self.lower else part) if safe else self._cut_by_library(part)

    def _cut_by_library(self, part: str) -> list[str]:
        if normalizer := self.library.normalizer:
            part = normalizer.normalize_str(part)
        return [part[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(part)]

    def ids(self, text: str) -> bytes:
        if self.special(text):
            return self._encode(text)
        known = self._ids.__getitem__
        return b"".join([b"".join(map(known, words)) for words in self.cut(text)])

    def count(self, text: str) -> int:
        if self.special(text):
            return len(self._encode(text)) // 4
        known = self._lengths.__getitem__
        return sum(sum(map(known, words)) for words in self.cut(text))


def pre_tokens(path: str, kind: str) -> PreTokens:
    """The worker's own, kept from task to task until a task of another operator runs there."""
    return remembered((path, kind), lambda: PreTokens(path, kind))
