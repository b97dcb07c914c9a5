"""Alignment against its definition: bytes of tokens, ends in common, overlaps, and counts over documents."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from evidentia.llm.alignment import Aligner, align, aligned, groups, links
from evidentia.llm.queries import queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
POOLS = ["ab    \n\t!?'s", "абвгд ", "日本語漢かな。、 ", "éèüñ ß", "0123456789 .,", "aaaaab  ", "\U0001f600\U0001f468‍ ", " <|endoftext|> <s> </s> <0x41> ", "".join(map(chr, range(1, 0x250))) + "    ", "▁ a", "l'homme don't \x00\x85　 "]


class Library:
    def __init__(self):
        self.a, self.b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
        self.a.encode_special_tokens = True
        own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        self.letters = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}

    def tokens(self, text):
        """[(id, bytes)] of both, or None."""
        if not text:
            return None
        a = [(i, bytes(self.letters[c] for c in self.a.id_to_token(i))) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in self.b.encode(text):
            piece = self.b.id_to_piece(i)
            b.append((i, bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()))
        whole = (" " + text).encode()
        return (a, b) if all(b"".join(t for _, t in x) == whole for x in (a, b)) else None


def _ranges(tokens):
    at, out = 0, []
    for i, data in tokens:
        out.append((i, at, at + len(data)))
        at += len(data)
    return out


def brute_force(texts, library):
    """Per text (n_a, n_b, n_groups, n_links, n_best, count_sum, groups)."""
    rows, held = [], Counter()
    for text in texts:
        found = library.tokens(text)
        if not found:
            rows.append(None)
            continue
        a, b = map(_ranges, found)
        ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        parts, start = [], 0
        for end in ends:
            side = [",".join(str(i) for i, s, e in x if start <= s and e <= end) for x in (a, b)]
            parts.append("|".join(side))
            start = end
        overlap, j0 = [], 0
        for i, s, e in a:
            while b[j0][2] <= s:
                j0 += 1
            j = j0
            while j < len(b) and b[j][1] < e:
                overlap.append((i, b[j][0]))
                j += 1
        held.update(set(overlap))
        rows.append((len(a), len(b), len(ends), overlap, ";".join(parts)))
    best = defaultdict(int)
    for (i, _), n in held.items():
        best[i] = max(best[i], n)
    return [(0, 0, 0, 0, 0, 0, "") if r is None else (r[0], r[1], r[2], len(r[3]), sum(held[p] == best[p[0]] for p in r[3]), sum(held[p] for p in r[3]), r[4]) for r in rows]


def _texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(rng.choice(POOLS) + rng.choice(POOLS), k=rng.randrange(70))) for _ in range(n)]


def test_units_are_the_whole_texts_tokens():
    library, aligner, small = Library(), Aligner(A, B), Aligner(A, B, cache=4)
    assert aligner.by_units
    whole = Aligner(A, B)
    whole.by_units = False
    texts = _texts(300, 1)
    for text, want in zip(texts, brute_force(texts, library), strict=True):
        for by in (aligner, small, whole):
            found = by.align(text)
            assert (";".join(found[2][u].text for u in found[0]) if found else "") == want[6]


def test_groups_and_links():
    assert groups([2, 3, 7], [3, 5, 7]) == [(0, 2, 0, 1), (2, 3, 1, 3)]
    assert list(links([2, 3, 7], [3, 5, 7], (0, 2, 0, 1))) == [(0, 0), (1, 0)]
    assert list(links([2, 4, 6], [3, 5, 6], (0, 3, 0, 3))) == [(0, 0), (1, 0), (1, 1), (2, 1), (2, 2)]
    assert groups([], []) == []


def test_counts_by_both_ways(spark):
    texts = [*_texts(120, 2), None, "", "the same words", "the same words", "a ▁ b", "x <|endoftext|> </s>", "word " * 30_000, "漢" * 3000]
    docs = spark.createDataFrame([(n // 2, t, "x", [1]) for n, t in enumerate(texts)], "doc_id long, text string, groups string, pairs array<int>").repartition(3)
    want = sorted((n // 2, *r) for n, r in enumerate(brute_force(texts, Library())))
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    for frequent in (1 << 18, 40, 0):  # all pairs, some, none are broadcast
        assert sorted(map(tuple, align(docs, A, B, frequent=frequent).select(*columns).collect())) == want
    digests = {r.groups_sha256 for r in align(docs, A, B, digest=True).collect()}
    assert digests == {hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "" for r in want}
    for r in aligned(docs, A, B).collect():
        assert sum(r.times) == r.n_links and len(set(r.pairs)) == len(r.pairs)


def test_empty_and_nulls(spark):
    docs = spark.createDataFrame([(None, None), (None, "a b"), (7, "")], "doc_id long, text string")
    assert align(docs.limit(0), A, B).count() == 0
    got = sorted((str(r.doc_id), r.n_a, r.n_best, r.groups) for r in align(docs, A, B).collect())
    assert [g[:3] for g in got] == [("7", 0, 0), ("None", 0, 0), ("None", 2, 2)]


def test_query(spark):
    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries()["op13_token_alignment"](spark, data).collect()}
    assert len(got) == len(docs)
    for d, want in zip(docs, brute_force([d.text for d in docs], Library()), strict=True):
        r = got[d.doc_id]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum) == want[:6]
        assert r.groups_sha256 == (hashlib.sha256(want[6].encode()).hexdigest() if want[6] else "")
