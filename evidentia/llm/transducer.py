"""Byte-level BPE as a finite-state transducer, and its way back by a UTF-8 state machine.

A sequence of tokens is the encoding of its bytes exactly if merging gives back each two neighbours as they are, so every
prefix of a text has one encoding, and the encoding of a longer text ends in a token that fits the last token before it.
That is a nondeterministic transducer: a path is (last token, bytes of a token that is not complete). ``Encoder`` makes
it deterministic while it reads: a state is the set of live paths with the tokens that they have not given out; what
all paths agree on is given out at once. A path lives no longer than the longest token, so that is the lookahead. States
are made when a byte first leads to them, and thrown away when there are too many.
"""

from __future__ import annotations

import base64
import struct
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, only, remembered
from .tokens import SAFE_TEXT, patterns, steps

#: States of either machine, and tested pairs of tokens, that one worker keeps before it starts over.
STATES, PAIRS = 250_000, 600_000
#: "No token yet": what precedes the first token of a pre-token.
START = -1
NEVER = 1 << 62
#: A path is given up early if none of so many tokens that it could become fits what precedes it.
ASKED = 16


def ranks_of(path: str) -> dict[bytes, int]:
    """{token: rank} of a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merges(piece: bytes, ranks: dict[bytes, int]) -> tuple[list[bytes], list[tuple[int, bytes, bytes]]]:
    """The parts that are left when the pair of lowest rank is merged, of several the first, until no pair has a rank; and
    before each merge, and at the end, its rank (infinite), the first and the last part."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    history = []
    while True:
        rank, at = min(((ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=(NEVER, 0))
        history.append((rank, parts[0], parts[-1]))
        if rank == NEVER:
            return parts, history
        parts[at : at + 2] = [parts[at] + parts[at + 1]]


class _State(dict):
    """byte -> (ids given out on the way, next state). ``end``: ids still owed if the pre-token ends here."""

    __slots__ = ("machine", "paths", "end")

    def __missing__(self, byte: int) -> tuple[bytes, _State]:
        to = self[byte] = self.machine.step(self, byte)
        return to


class Encoder:
    """Ids of pre-tokens, as little-endian unsigned 32-bit bytes. ``states`` and ``pairs`` bound the memory only."""

    def __init__(self, ranks: dict[bytes, int], states: int = STATES, pairs: int = PAIRS):
        self.ranks, self.most_states, self.most_pairs = ranks, max(1, states), max(1, pairs)
        self.text = {rank: token for token, rank in ranks.items()}
        self.packed = {rank: struct.pack("<I", rank) for rank in self.text}
        # a trie: (node, byte) -> node; which node is which token; the tokens that begin with a node lie in a row
        self.ordered = [ranks[token] for token in sorted(ranks)]
        self.child: dict[int, int] = {}
        self.token: list[int | None] = [None]
        self.first, self.end = [0], [len(ranks)]
        for n, rank in enumerate(self.ordered):
            node = 0
            for byte in self.text[rank]:
                node = self.child.setdefault(node << 8 | byte, len(self.token))
                if node == len(self.token):
                    self.token.append(None)
                    self.first.append(n)
                    self.end.append(n)
                self.end[node] = n + 1
            self.token[node] = rank
        self._fits: dict[tuple[int, int], bool] = {}
        self._open: dict[tuple[int, int], bool] = {}
        self._histories: dict[int, list | None] = {}
        self._known: dict[tuple, _State] = {}
        self.start = self._state(((0, (), START),), None)

    def history(self, token: int) -> list[tuple[int, bytes, bytes]] | None:
        """How merging makes the token of its bytes; None if it does not."""
        if token not in self._histories:
            parts, steps = merges(self.text[token], self.ranks)
            self._histories[token] = steps if len(parts) == 1 else None
        return self._histories[token]

    def fits(self, a: int, b: int) -> bool:
        """Whether merging the bytes of the two tokens gives them back; after ``START``, those of the second alone. Both
        are merged as each would be alone until a pair across their border has its turn; the left one is first at ties."""
        known = self._fits.get((a, b))
        if known is None:
            if len(self._fits) >= self.most_pairs:
                self._fits.clear()
            known = self._fits[a, b] = self._apart(self.history(a), self.history(b)) if a != START else self.history(b) is not None
        return known

    def _apart(self, left: list | None, right: list | None) -> bool:
        if left is None or right is None:
            return False
        i = j = 0
        while True:
            (x, _, last), (y, first, _) = left[i], right[j]
            across = self.ranks.get(last + first, NEVER)
            if across < x and across <= y:
                return False
            if x <= y:
                if x == NEVER:
                    return True
                i += 1
            else:
                j += 1

    def open(self, last: int, node: int) -> bool:
        """Whether a longer token than the node's may follow ``last``; where many would have to be asked, it may."""
        n = self.end[node] - self.first[node] - (self.token[node] is not None)
        if n == 0 or n > ASKED:
            return n > 0
        known = self._open.get((last, node))
        if known is None:
            if len(self._open) >= self.most_pairs:
                self._open.clear()
            longer = self.ordered[self.end[node] - n : self.end[node]]
            known = self._open[last, node] = last == START or any(self.fits(last, token) for token in longer)
        return known

    def _state(self, paths: tuple, whole: int | None) -> _State:
        state = _State()
        state.machine, state.paths = self, paths
        # a pre-token that is a token as a whole is that token, even if merging does not lead there
        state.end = b"".join([self.packed[t] for t in (paths[-1][1] if whole is None else (whole,))])
        return state

    def step(self, state: _State, byte: int) -> tuple[bytes, _State]:
        paths, ended, whole, least = [], None, None, 1 << 30
        for node, owed, last in state.paths:
            node = self.child.get(node << 8 | byte)
            if node is None:
                continue
            token = self.token[node]
            if token is not None:
                if self.fits(last, token):
                    ended = (*owed, token)
                elif last == START:
                    whole = token
            if self.open(last, node) or last == START and whole is not None:
                paths.append((node, owed, last))
                least = min(least, len(owed))
        if ended is None:
            raise ValueError("the vocabulary lacks single bytes")
        agreed, least = 0, min(least, len(ended))
        while agreed < least and all([owed[agreed] == ended[agreed] for _, owed, _ in paths]):
            agreed += 1
        if agreed:
            paths = [(node, owed[agreed:], last) for node, owed, last in paths]
        paths.append((0, ended[agreed:], ended[-1]))
        key = (*paths, whole)
        found = self._known.get(key)
        if found is None:
            if len(self._known) >= self.most_states:
                self._start_over()
            found = self._known[key] = self._state(tuple(paths), whole)
        return b"".join([self.packed[t] for t in ended[:agreed]]), found

    def _start_over(self) -> None:
        for old in self._known.values():
            old.clear()
        self._known.clear()
        self.start.clear()

    def ids(self, words: Iterable[str]) -> bytes:
        given = []
        give = given.append
        for word in words:
            at = self.start
            for byte in word.encode():
                out, at = at[byte]
                if out:
                    give(out)
            give(at.end)
        return b"".join(given)


class Cutter:
    """Pre-tokens of a text as the library cuts them. Its tables of letters and numbers may be of another Unicode version
    than those here: it is asked once for each character outside the common ones, and where the answers differ, a
    character of the class that it names stands in while the text is cut."""

    #: A character of each class that the pattern tells apart.
    STAND_INS = ((r"\p{L}", "a"), (r"\p{N}", "1"), (r"\s", "\t"))

    def __init__(self, pattern: str):
        import tiktoken

        single = {bytes([i]): i for i in range(256)}
        self.asked = [(tiktoken.Encoding(f"class {p}", pat_str=p, mergeable_ranks=single, special_tokens={}), regex.compile(p), c) for p, c in self.STAND_INS]
        self.pattern, self.fast = regex.compile(pattern), patterns()["byte"][0]
        self._instead: dict[str, str] = {}

    def instead(self, char: str) -> str:
        found = self._instead.get(char)
        if found is None:
            theirs = next((c for library, _, c in self.asked if library.encode_ordinary(char)), "!")
            ours = next((c for _, own, c in self.asked if own.match(char)), "!")
            found = self._instead[char] = char if theirs == ours else theirs
        return found

    def cut(self, text: str) -> Iterator[list[str]]:
        safe = SAFE_TEXT.fullmatch(text) is not None
        for part in steps(text):
            if safe:
                yield self.fast.findall(part)
                continue
            odd = {ord(c): s for c in set(part) if (s := self.instead(c)) != c}
            yield [part[m.start() : m.end()] for m in self.pattern.finditer(part.translate(odd))] if odd else self.pattern.findall(part)


def utf8_step(held: bytes, byte: int) -> tuple[str, bytes]:
    """One step of the state machine, whose state is the beginning of a character: (what is complete now, the new state).
    A beginning that cannot go on, and a byte that cannot begin, are U+FFFD."""
    if not held:
        if byte < 0x80:
            return chr(byte), b""
        return ("", bytes([byte])) if 0xC2 <= byte <= 0xF4 else ("�", b"")
    first, low, high = held[0], 0x80, 0xBF
    if len(held) == 1:  # no overlong forms, no surrogates, nothing beyond U+10FFFF
        low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(first, (low, high))
    if not low <= byte <= high:
        text, held = utf8_step(b"", byte)
        return "�" + text, held
    held += bytes([byte])
    size = 2 if first < 0xE0 else 3 if first < 0xF0 else 4
    if len(held) < size:
        return "", held
    code = first & (0xFF >> size + 1)
    for b in held[1:]:
        code = code << 6 | b & 0x3F
    return chr(code), b""


class _Decoding(dict):
    """id -> (text that it completes, next state); the state is the beginning of a character."""

    __slots__ = ("machine", "held")

    def __missing__(self, token: int) -> tuple[str, _Decoding]:
        text, held = [], self.held
        data = self.machine.text.get(token)
        for byte in data or b"":
            now, held = utf8_step(held, byte)
            text.append(now)
        if data is None:
            text, held = ["�" * (1 + bool(held))], b""
        to = self[token] = ("".join(text), self.machine.state(held))
        return to


class Decoder:
    """Text of ids in a row, one id at a time: ``feed`` gives what is complete, ``finish`` what was left open. An id that is
    no token is U+FFFD."""

    def __init__(self, ranks: dict[bytes, int]):
        self.text = {rank: token for token, rank in ranks.items()}
        self._states: dict[bytes, _Decoding] = {}
        self.at = self.state(b"")

    def state(self, held: bytes) -> _Decoding:
        found = self._states.get(held)
        if found is None:
            found = self._states[held] = _Decoding()
            found.machine, found.held = self, held
        return found

    def feed(self, ids: Iterable[int]) -> str:
        at, text = self.at, []
        for token in ids:
            now, at = at[token]
            text.append(now)
        self.at = at
        return "".join(text)

    def finish(self) -> str:
        left, self.at = self.at.held, self.state(b"")
        return "�" if left else ""


def _u32(ids: bytes) -> array:
    found = array("I", ids)
    if struct.pack("=I", 1) != struct.pack("<I", 1):
        found.byteswap()
    return found


def encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) for each row, by the file of ranks and the pattern of pre-tokens.

    Null text counts as empty: no ids. Strings of special tokens are plain text. Repeated rows and null ids give a row
    each, an empty table none. Other columns are not read.
    """
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, encoder = remembered(("transducer", ranks, pattern), lambda: (Cutter(pattern), Encoder(ranks_of(ranks))))
        for batch in batches:
            ids = [b"".join(map(encoder.ids, cutter.cut(text))) if text else b"" for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], schema=out)

    rows = only(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(lean(task, keep=True), "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, ranks: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids in place of them. Null ids give a null text; ids that are no tokens and bytes that
    are no UTF-8 give U+FFFD."""
    rest = [c for c in encoded.columns if c not in (ids_col, text_col)]
    rows = encoded.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{ids_col}`").alias(text_col))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = remembered(("decoder", ranks), lambda: Decoder(ranks_of(ranks)))
        for batch in batches:
            texts = [None if ids is None else decoder.feed(_u32(ids)) + decoder.finish() for ids in batch.column(len(rest)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=batch.schema.names)

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]] + [f"`{text_col}` string"])
    return rows.mapInArrow(lean(task, keep=True), schema)
