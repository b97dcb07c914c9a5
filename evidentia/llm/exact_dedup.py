"""Exact dedup over an extendible-hash index in shared files.

Texts are equal when their bytes are, after lower-casing A-Z only. Each text has a 64-bit key. Tasks merge the equal
texts that they meet, so a group with a third of all rows is a few entries from each, and ship entries with their bytes
to the owners of key ranges. An owner takes its entries in the order of keys: those of one key are compared byte by
byte, equal ones become one, different ones a chain; then the chain goes into the owner's extendible-hash directory,
which splits a bucket that gets overfull and doubles where the bucket is as deep as itself, as often as it takes. The
buckets are the index, a table in the shared folder. Documents then find their entry by key and digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import lean, only, only_kept, shuffle_partitions, written

#: Entries of a bucket before it splits.
BUCKET_ENTRIES = 512
#: Bytes of different texts that a task holds to merge equal ones before it ships them.
MERGE_BYTES = 16 << 20
#: Key ranges for each shuffle partition: with several, tasks get about equal shares.
RANGES = 4


class Directory:
    """An extendible-hash directory over the leading bits of ``bits``-bit keys: slots point to buckets
    [depth, {key: chain}]."""

    def __init__(self, bits: int, capacity: int = BUCKET_ENTRIES):
        self.bits, self.capacity, self.depth = bits, capacity, 0
        self.slots: list[list] = [[0, {}]]

    def _slot(self, key: int) -> int:
        return key >> (self.bits - self.depth)

    def insert(self, key: int, chain: list) -> None:
        """Puts the chain of a new key into its bucket; keys are what a bucket counts, as equal ones cannot be split."""
        self.slots[self._slot(key)][1][key] = chain
        while len((bucket := self.slots[self._slot(key)])[1]) > self.capacity:
            self._split(self._slot(key), bucket)

    def _split(self, slot: int, bucket: list) -> None:
        local, held = bucket
        if local == self.depth:
            self.slots = [s for s in self.slots for _ in range(2)]
            self.depth += 1
            slot *= 2
        wide = 1 << (self.depth - local)
        first, bit = slot - slot % wide, self.bits - local - 1
        halves = [[local + 1, {}], [local + 1, {}]]
        for key, chain in held.items():
            halves[key >> bit & 1][1][key] = chain
        for k, half in enumerate(halves):
            self.slots[first + k * wide // 2 : first + (k + 1) * wide // 2] = [half] * (wide // 2)

    def buckets(self) -> Iterator[tuple[int, int, dict]]:
        """(first slot's key bits, depth, chains) of each bucket, in the order of keys."""
        at = 0
        while at < len(self.slots):
            local, held = self.slots[at]
            yield at >> (self.depth - local), local, held
            at += 1 << (self.depth - local)


def normal(text: bytes | None) -> bytes:
    return (text or b"").lower()  # bytes.lower() maps A-Z only


def key_of(text: bytes, bits: int) -> int:
    """The leading ``bits`` of the text's 64-bit hash."""
    return xxhash.xxh3_64_intdigest(text) >> (64 - bits)


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))


def digests(docs: DataFrame, bits: int = 64) -> DataFrame:
    """doc_id, key and sha256 of each row."""
    out = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("sha256", pa.string())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [normal(x) for x in batch.column(1).to_pylist()]
            keys = [key_of(x, bits) - (1 << 63) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string())], schema=out)

    return _plain(docs).mapInArrow(lean(task), "doc_id long, key long, sha256 string")


def entries(docs: DataFrame, owners: int, bits: int = 64) -> DataFrame:
    """owner, key, bytes, keep_id, n: the different texts that a task holds at a time."""
    out = pa.schema([("owner", pa.int32()), ("key", pa.int64()), ("bytes", pa.binary()), ("keep_id", pa.int64()), ("n", pa.int64())])

    def rows(held: dict[bytes, list]) -> Iterator[pa.RecordBatch]:
        found = [(k, text, *v) for text, v in held.items() for k in [key_of(text, bits)]]
        for at in range(0, len(found), 2000):
            key, text, keep, n = zip(*found[at : at + 2000], strict=True)
            columns = [[k * owners >> bits for k in key], [k - (1 << 63) for k in key], text, keep, n]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        size = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = normal(text)
                if known := held.get(text):
                    known[0] = doc if known[0] is None else known[0] if doc is None else max(known[0], doc)
                    known[1] += 1
                else:
                    held[text] = [doc, 1]
                    size += len(text)
            if size > MERGE_BYTES:
                yield from rows(held)
                held, size = {}, 0
        yield from rows(held)

    return _plain(docs).mapInArrow(lean(task), "owner int, key long, bytes binary, keep_id long, n long")


def build_index(docs: DataFrame, capacity: int = BUCKET_ENTRIES, bits: int = 64) -> DataFrame:
    """The index as a table in the shared folder: owner, bucket (its leading key bits in the owner's range), depth, key,
    chain (place in it), sha256, keep_id, group_size."""
    parts = shuffle_partitions(docs.sparkSession)
    owners = min(RANGES * parts, 1 << bits)
    fields = [("owner", pa.int32()), ("bucket", pa.int64()), ("depth", pa.int32()), ("key", pa.int64()), ("chain", pa.int32()), ("sha256", pa.string()), ("keep_id", pa.int64()), ("group_size", pa.int64())]
    out = pa.schema(fields)

    def written_out(owner: int, directory: Directory) -> Iterator[pa.RecordBatch]:
        for bucket, depth, chains in directory.buckets():
            if rows := [(owner, bucket, depth, key - (1 << 63), k, *entry) for key, chain in chains.items() for k, entry in enumerate(chain)]:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, directory, key, chain = None, None, None, []  # chain: [bytes, keep_id, n] of one key

        def end_key():
            if chain:
                directory.insert(key, [(hashlib.sha256(text).hexdigest(), keep, n) for text, keep, n in chain])

        for batch in batches:
            for owner, signed, text, keep, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if owner != now or signed + (1 << 63) != key:
                    end_key()
                    key, chain = signed + (1 << 63), []
                if owner != now:
                    if directory:
                        yield from written_out(now, directory)
                    now, directory = owner, Directory(bits, capacity)
                for known in chain:
                    if known[0] == text:
                        known[1] = keep if known[1] is None else known[1] if keep is None else max(known[1], keep)
                        known[2] += n
                        break
                else:
                    chain.append([text, keep, n])
        end_key()
        if directory:
            yield from written_out(now, directory)

    owned = entries(docs, owners, bits).repartition(parts, "owner").sortWithinPartitions("owner", "key")
    schema = "owner int, bucket long, depth int, key long, chain int, sha256 string, keep_id long, group_size long"
    return written(owned.mapInArrow(lean(task), schema), "exact-index")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = BUCKET_ENTRIES, key_bits: int = 64) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty. Of equal texts the largest doc_id stays; where several rows have that doc_id and text,
    one of them does. A null doc_id is smaller than any other; a group of null ids only has a null ``keep_id`` and one
    row that stays. An empty table gives no rows. Other columns are not read. ``key_bits``: fewer make more chains.
    """
    rows = only(docs, doc_id=id_col, text=text_col)
    index = build_index(rows, capacity, key_bits).select("key", F.col("sha256").alias("entry"), "keep_id", "group_size")
    placed = written(digests(rows, key_bits).withColumn("row", F.monotonically_increasing_id()), "exact-digests")
    found = placed.join(index, "key").where("sha256 = entry")
    # the staying row of each group: that with the largest id or, of several, one of them
    stays = written(found.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("key", "sha256").agg(F.min("row").alias("row")).select("row", F.lit(True).alias("kept")), "exact-kept")
    every = found.join(stays, "row", "left")
    return every.select("doc_id", "keep_id", "group_size", F.coalesce("kept", F.lit(False)).alias("kept"), F.col("sha256").alias("text_sha256"))


@F.pandas_udf(StringType())
def _sha256(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: hashlib.sha256(normal(x)).hexdigest())


def distinct_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    kept = exact_groups(docs).where("kept")
    return only_kept(docs.withColumn("_sha256", _sha256(F.col("text").cast("binary"))), kept.withColumnRenamed("text_sha256", "_sha256"), "_sha256")


#: DuckDB SQL for ``op2_exact_dedup``.
ORACLE_SQL = """
with d as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
g as (select t, max(doc_id) as keep_id, count(*) as group_size from d group by t)
select d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id as kept, sha256(d.t) as text_sha256 from d join g on d.t = g.t
"""
