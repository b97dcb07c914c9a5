"""Packing by minimum bin slack.

Whole windows are cut off long documents; what remains of each document waits in a pool of bounded size. For each
window the largest remainder is the seed, and a bitset subset-sum programme over the multiset of the other lengths
finds the reachable fill closest to capacity; walking back through the bitsets gives how many of each length to take.

Nothing is shuffled: a task packs what it tokenizes, and tasks are as many as the input has splits. ``sequence_id`` is
the task's partition number and a counter, so a task that runs again after an executor is lost gives the same rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import lean, only
from .tokens import pre_tokens

CAPACITY = 4096
END_ID = 2
#: Remainders that wait in a task; each is shorter than a window, so this bounds the memory.
POOL = 512

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def closest_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many of each length to take so that the sum is the largest that fits: {length: taken}.

    Bit s of a bitset says that sum s is reachable. Counts are split into powers of two, so a length with n copies
    costs log n shifts; the programme stops once the capacity itself is reachable. Of equal sums the one built from
    longer lengths wins.
    """
    mask = (1 << (capacity + 1)) - 1
    reach, trail = 1, []
    for length in sorted((x for x in counts if 0 < x <= capacity), reverse=True):
        left, block = counts[length], 1
        while left and not reach >> capacity & 1:
            take = min(block, left)
            if take * length > capacity:
                break
            trail.append((reach, length, take))
            reach |= (reach << take * length) & mask
            left -= take
            block *= 2
        if reach >> capacity & 1:
            break
    at, taken = reach.bit_length() - 1, defaultdict(int)
    for before, length, take in reversed(trail):
        if not before >> at & 1:
            taken[length] += take
            at -= take * length
    return dict(taken)


class Packer:
    """Pieces of documents in windows; ``add`` and ``finish`` give (doc, start, ids, doc_tokens, sequence, offset)."""

    def __init__(self, capacity: int = CAPACITY, pool: int = POOL, first_sequence: int = 0):
        self.capacity, self.most, self.sequence = capacity, pool, first_sequence
        self.waiting: dict[int, list] = defaultdict(list)
        self.n = 0

    def add(self, doc, ids: bytes) -> Iterator[tuple]:
        total = len(ids) // 4
        whole = total - total % self.capacity
        for start in range(0, whole, self.capacity):
            yield (doc, start, ids[4 * start : 4 * (start + self.capacity)], total, self.sequence, 0)
            self.sequence += 1
        if total > whole:
            self._wait((doc, whole, ids[4 * whole :], total))
            while self.n > self.most:
                yield from self._window()

    def finish(self) -> Iterator[tuple]:
        while self.n:
            yield from self._window()

    def _wait(self, item: tuple) -> None:
        self.waiting[len(item[2]) // 4].append(item)
        self.n += 1

    def _pop(self, length: int) -> tuple:
        items = self.waiting[length]
        item = items.pop()
        if not items:
            del self.waiting[length]
        self.n -= 1
        return item

    def _window(self) -> Iterator[tuple]:
        seed = self._pop(max(self.waiting))
        chosen, slack = [seed], self.capacity - len(seed[2]) // 4
        for length, n in closest_fill({k: len(v) for k, v in self.waiting.items()}, slack).items():
            chosen += [self._pop(length) for _ in range(n)]
            slack -= n * length
        if slack and self.n:  # whatever still waits is longer than the slack: cut the shortest
            doc, start, ids, total = self._pop(min(self.waiting))
            chosen.append((doc, start, ids[: 4 * slack], total))
            self._wait((doc, start + slack, ids[4 * slack :], total))
            slack = 0
        yield from self._placed(chosen, self.capacity - slack)

    def _placed(self, chosen: list[tuple], filled: int) -> Iterator[tuple]:
        """A full window, or the task's last one cut at powers of two, which need no padding."""
        sizes = [self.capacity] if filled == self.capacity else [1 << b for b in range(filled.bit_length() - 1, -1, -1) if filled >> b & 1]
        room, offset, sizes = sizes[0], 0, sizes[1:]
        for doc, start, ids, total in chosen:
            while ids:
                piece = ids[: 4 * room]
                yield (doc, start, piece, total, self.sequence, offset)
                n = len(piece) // 4
                start, ids, room, offset = start + n, ids[4 * n :], room - n, offset + n
                if not room:
                    self.sequence += 1
                    room, offset, sizes = (sizes[0], 0, sizes[1:]) if sizes else (0, 0, [])


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int | None = END_ID, pool: int = POOL, with_ids: bool = False) -> DataFrame:
    """One row per piece of a document: where it begins there, how long it is, and where it lies in which sequence.

    Null and empty texts have the end id alone; with ``end_id=None`` they have no piece. Repeated rows and repeated or
    null ids are packed each for itself. An empty table gives no rows. Other columns are not read. ``with_ids`` adds
    the piece's ids as ``ids binary`` (little-endian unsigned 32-bit).
    """
    end = b"" if end_id is None else end_id.to_bytes(4, "little")
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
    fields += [("ids", pa.binary())] * with_ids
    out = pa.schema(fields)

    def rows(pieces: list[tuple]) -> pa.RecordBatch:
        doc, start, ids, total, sequence, offset = zip(*pieces, strict=True)
        columns = [doc, start, [len(x) // 4 for x in ids], [zlib.crc32(x) for x in ids], total, sequence, offset]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([*columns, ids], out, strict=False)], schema=out)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = pre_tokens(tokenizer, "word").ids
        packer = Packer(capacity, pool, TaskContext.get().partitionId() << 33)
        for batch in batches:
            pieces = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                pieces += packer.add(doc, encode(text or "") + end)
            if pieces:
                yield rows(pieces)
        if pieces := list(packer.finish()):
            yield rows(pieces)

    return only(docs, doc_id=id_col, text=text_col).selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(lean(task, keep=True), SCHEMA + ", ids binary" * with_ids)
