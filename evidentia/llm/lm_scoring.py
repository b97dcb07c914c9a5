"""Stupid-backoff scores with counts of the whole corpus.

Documents are dealt into chunks by a hash. A chunk explodes its documents into n-grams, combines those that are equal
and sends (hash, count) pairs to the count tables, which are partitioned by ranges of the hash, as many as the session
has shuffle partitions. A partition of a table sums what all chunks sent, and joins the sums back to what each chunk
asked for; a chunk joins the answers to the n-grams of its documents and sums the scores of each document.

A row carries the n-grams of a chunk in one range, sorted, as differences: some six bytes each. One row for each n-gram
of each document would say the same in twice the bytes, which the disk budget does not allow. What crosses the network
are n-gram types of chunks, never occurrences, so a frequent n-gram weighs no more than a rare one. From trigrams on a
chunk asks only for those whose shorter n-grams, front and back, other documents have, too: no other can occur there.

Counts leave out the document that is scored: else every n-gram of the corpus would have been seen.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, shuffle_partitions, written
from .words import ngram_hashes, word_hashes

ORDER, BACKOFF = 3, 0.4
#: Text bytes of a chunk: what one task holds at a time.
CHUNK_BYTES = 6 << 20


def _planes(x: np.ndarray) -> bytes:
    """Byte by byte of all numbers in turn: the many equal high bytes shrink when the shuffle is compressed."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplanes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).reshape(-1).view(np.uint64)


class Chunk:
    """The n-grams of some documents: for each order the different hashes, their counts, and where each occurs."""

    def __init__(self, texts: list[str | None], order: int):
        words = [word_hashes(t) for t in texts]
        self.lengths = np.array([len(w) for w in words], np.int64)
        self.types, self.counts, self.places = [], [], []
        for n in range(1, order + 1):
            grams = [ngram_hashes(w, n) for w in words]
            types, places, counts = np.unique(np.concatenate([np.empty(0, np.uint64), *grams]), return_inverse=True, return_counts=True)
            self.types.append(types)
            self.counts.append(counts.astype(np.uint64))
            self.places.append(places)

    def wanted(self, n: int, others: np.ndarray | None) -> np.ndarray:
        """Of the n-gram types those that other documents may have: both (n-1)-grams within are found there."""
        if others is None or n < 3:
            return np.ones(len(self.types[n - 1]), bool)
        length = np.maximum(self.lengths - n + 2, 0)
        seen, last = others > 0, np.zeros(int(length.sum()), bool)
        last[np.cumsum(length)[length > 0] - 1] = True  # the last (n-1)-gram of a document has no follower
        both = (seen[:-1] & seen[1:])[~last[:-1]] if len(seen) else seen
        out = np.zeros(len(self.types[n - 1]), bool)
        out[self.places[n - 1][both]] = True
        return out

    def requests(self, n: int, wanted: np.ndarray, owners: int):
        """(order, owner, hashes, counts) of each range that has wanted n-grams; ranges in the order of hashes."""
        bounds = np.array([(i << 64) // owners for i in range(1, owners)], np.uint64)
        types, counts = self.types[n - 1][wanted], self.counts[n - 1][wanted]
        cuts = [0, *np.searchsorted(types, bounds).tolist(), len(types)]
        for owner in range(owners):
            a, b = cuts[owner], cuts[owner + 1]
            if b > a:
                yield n, owner, _planes(np.diff(types[a:b], prepend=np.uint64(0))), _planes(counts[a:b])

    def others(self, n: int, totals: np.ndarray) -> np.ndarray:
        """For each n-gram in the order of documents and places: occurrences in other documents."""
        docs = len(self.lengths)
        owner = np.repeat(np.arange(docs), np.maximum(self.lengths - n + 1, 0))
        key = owner.astype(np.int64) * max(1, len(self.types[n - 1])) + self.places[n - 1]
        _, at, own = np.unique(key, return_inverse=True, return_counts=True)
        return np.maximum(totals[self.places[n - 1]].astype(np.int64) - own[at], 0)

    def all_others(self, replies: pd.DataFrame, upto: int) -> list[np.ndarray]:
        """``others`` of each order up to ``upto``, from (n, owner, totals) rows; what was not asked for has none."""
        found: list[np.ndarray] = []
        for n in range(1, upto + 1):
            total = np.zeros(len(self.types[n - 1]), np.uint64)
            told = replies[replies["n"] == n].sort_values("owner")["totals"]
            total[self.wanted(n, found[-1] if found else None)] = np.concatenate([np.empty(0, np.uint64), *map(_unplanes, told)])
            found.append(self.others(n, total))
        return found


def answers(hashes: list[bytes], counts: list[bytes]) -> list[bytes]:
    """For each request the counts of its n-grams over all requests."""
    sent = [np.cumsum(_unplanes(h), dtype=np.uint64) for h in hashes]
    types, places = np.unique(np.concatenate(sent), return_inverse=True)
    total = np.zeros(len(types), np.uint64)
    np.add.at(total, places, np.concatenate([_unplanes(c) for c in counts]))
    return [_planes(total[p]) for p in np.split(places, np.cumsum([len(s) for s in sent])[:-1])]


def document_sums(chunk: Chunk, others: list[np.ndarray], order: int, backoff: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By document: the sum of the logarithms of all scores, without the corpus size below unigram counts; how many
    scores end at a unigram; and how many words back off from every longer n-gram that they could have had."""
    docs = len(chunk.lengths)
    score = np.log(np.maximum(others[0], 1).astype(float))
    unigram = np.ones(len(score), bool)
    # a word that no other document has counts as one occurrence
    done = np.zeros(len(score), bool)
    owner = np.repeat(np.arange(docs), chunk.lengths)
    first = np.repeat(np.cumsum(chunk.lengths) - chunk.lengths, chunk.lengths)
    place = np.arange(len(score)) - first
    tried = np.minimum(place + 1, order)
    for n in range(order, 1, -1):
        ends = np.flatnonzero(place >= n - 1)  # words that end an n-gram, in the order of n-grams
        seen = (others[n - 1] > 0) & ~done[ends]
        hit = ends[seen]
        # the context: the (n-1)-gram one place before the one that ends with the word
        context_at = np.flatnonzero(place >= n - 2)
        number = np.full(len(score), -1)
        number[context_at] = np.arange(len(context_at))
        context = others[n - 2][number[hit - 1]]
        score[hit] = np.log(others[n - 1][seen]) - np.log(np.maximum(context, 1)) + (tried[hit] - n) * np.log(backoff)
        unigram[hit] = False
        done[hit] = True
    score[unigram] += (tried[unigram] - 1) * np.log(backoff)
    sums = np.bincount(owner, score, docs)
    return sums, np.bincount(owner, unigram, docs), np.bincount(owner, unigram & (tried > 1), docs)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, backoff: float = BACKOFF, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_backed_off, log_score (sum of logarithms), mean_log_score.

    With counts c over all other documents, S(w | context) is c(context w) / c(context) if that n-gram was seen, else
    ``backoff`` times the score with the context one word shorter; at last c(w) / words of all other documents, an
    unseen word counting once. Null and empty texts have 0 words, a sum of 0 and a null mean. Repeated rows are
    documents each, so each has seen the other. A corpus of one document scores against nothing: its words count once
    in a corpus of one word. An empty table gives no rows. Other columns are not read.
    """
    rows = only(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text")
    spark = rows.sparkSession
    n_bytes = rows.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first().n or 0
    chunks, owners = max(1, -(-n_bytes // chunk_bytes)), shuffle_partitions(spark)
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(chunks)).cast("int")).repartition(max(owners, min(chunks, 4 * owners)), "chunk")
    columns = ["chunk", "n", "owner", "hashes", "counts"]
    request, reply = "chunk int, n int, owner int, hashes binary, counts binary", "chunk int, n int, owner int, totals binary"

    def ask(pdf: pd.DataFrame) -> pd.DataFrame:
        chunk = Chunk(_ordered(pdf)["text"].tolist(), min(order, 2))
        asked = [r for n in range(1, min(order, 2) + 1) for r in chunk.requests(n, chunk.wanted(n, None), owners)]
        return pd.DataFrame([(int(pdf["chunk"].iloc[0]), *r) for r in asked], columns=columns)

    def asks_for(n: int):
        def ask_longer(pdf: pd.DataFrame, answered: pd.DataFrame) -> pd.DataFrame:
            chunk = Chunk(_ordered(pdf)["text"].tolist(), n)
            asked = chunk.requests(n, chunk.wanted(n, chunk.all_others(answered, n - 1)[-1]), owners)
            return pd.DataFrame([(int(pdf["chunk"].iloc[0]), *r) for r in asked], columns=columns)

        return ask_longer

    def own(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[["chunk", "n", "owner"]].assign(totals=answers(pdf["hashes"].tolist(), pdf["counts"].tolist()))

    def score(pdf: pd.DataFrame, answered: pd.DataFrame) -> pd.DataFrame:
        pdf = _ordered(pdf)
        chunk = Chunk(pdf["text"].tolist(), order)
        sums, unigrams, backed = document_sums(chunk, chunk.all_others(answered, order), order, backoff)
        return pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "n_words": chunk.lengths, "n_unigrams": unigrams.astype(np.int64), "n_backed_off": backed.astype(np.int64), "sums": sums})

    requests = dealt.groupBy("chunk").applyInPandas(ask, request)
    replies = written(requests.groupBy("n", "owner").applyInPandas(own, reply), "counts")
    for n in range(3, order + 1):
        longer = dealt.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInPandas(asks_for(n), request)
        replies = replies.unionByName(written(longer.groupBy("n", "owner").applyInPandas(own, reply), "counts"))
    summed = dealt.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInPandas(score, "doc_id long, n_words long, n_unigrams long, n_backed_off long, sums double")
    summed = written(summed, "scores")
    words = summed.agg(F.sum("n_words").alias("n")).first().n or 0
    rest = F.greatest(F.lit(words) - F.col("n_words"), F.lit(1)).cast("double")
    total = F.col("sums") - F.col("n_unigrams") * F.log(rest)
    return summed.select("doc_id", "n_words", "n_backed_off", F.round(total, 6).alias("log_score"), F.when(F.col("n_words") > 0, F.round(total / F.col("n_words"), 6)).alias("mean_log_score"))


def _ordered(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows in an order that both passes over a chunk share."""
    return pdf.sort_values(["doc_id", "text"], kind="stable", na_position="last").reset_index(drop=True)


#: DuckDB SQL for ``op5_lm_scoring``: order 3.
ORACLE_SQL = f"""
with l as (select row_number() over () as r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_\\x{{80}}-\\x{{10FFFF}}]+') as ws from documents),
w as (select r, unnest(ws) as a, unnest(range(len(ws))) as p from l),
g as (select r, p, a, lag(a) over d as b, lag(a, 2) over d as c from w window d as (partition by r order by p)),
c1 as (select a, count(*) as n from g group by 1), o1 as (select r, a, count(*) as n from g group by 1, 2),
c2 as (select b, a, count(*) as n from g where b is not null group by 1, 2), o2 as (select r, b, a, count(*) as n from g where b is not null group by 1, 2, 3),
c3 as (select c, b, a, count(*) as n from g where c is not null group by 1, 2, 3), o3 as (select r, c, b, a, count(*) as n from g where c is not null group by 1, 2, 3, 4),
e1 as (select o1.r, o1.a, c1.n - o1.n as n from o1 join c1 using (a)),
e2 as (select o2.r, o2.b, o2.a, c2.n - o2.n as n from o2 join c2 using (b, a)),
e3 as (select o3.r, o3.c, o3.b, o3.a, c3.n - o3.n as n from o3 join c3 using (c, b, a)),
n as (select l.r, l.doc_id, len(l.ws) as n_words, greatest(1, sum(len(l.ws)) over () - len(l.ws)) as rest from l),
k as (
    select g.r, least(g.p + 1, 3) as tried, e1.n as uni, coalesce(e2.n, 0) as bi, greatest(1, f1.n) as of_bi, coalesce(e3.n, 0) as tri, greatest(1, f2.n) as of_tri
    from g join e1 on e1.r = g.r and e1.a = g.a left join e2 on e2.r = g.r and e2.b = g.b and e2.a = g.a left join e1 f1 on f1.r = g.r and f1.a = g.b
    left join e3 on e3.r = g.r and e3.c = g.c and e3.b = g.b and e3.a = g.a left join e2 f2 on f2.r = g.r and f2.b = g.c and f2.a = g.b
),
s as (
    select n.doc_id, n.r, n.n_words, count(*) filter (tried > 1 and bi = 0) as n_backed_off,
        coalesce(sum(case when tri > 0 then ln(tri / of_tri) when bi > 0 then ln(bi / of_bi) + (tried - 2) * ln({BACKOFF}) else ln(greatest(1, uni) / rest) + (tried - 1) * ln({BACKOFF}) end), 0) as total
    from n left join k on n.r = k.r group by 1, 2, 3
)
select doc_id, n_words::bigint as n_words, n_backed_off, round(total, 6) as log_score, case when n_words > 0 then round(total / n_words, 6) end as mean_log_score from s
"""
