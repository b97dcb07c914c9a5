"""The transducer against the library, its decoder against the bytes, and both against merging by definition."""

import hashlib
import random
from array import array

import public_tokenizers
import pytest
import tiktoken

from evidentia.llm.queries import queries
from evidentia.llm.transducer import Cutter, Decoder, Encoder, decode, encode, merges, ranks_of, utf8_step

FILES = ("byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken")
POOLS = ["ab  \n\t!?'s", "абвгд ", "日本語漢かな。、", "éèüñß ", "0123456789 .,", "aaaaab", "\U0001f600\U0001f468‍ ", "".join(map(chr, range(1, 0x250))), "Ա՘₏Ჱ꟎𞤀\U0001e6c0 \x1c\x85 "]


def _texts(n, seed=1):
    rng = random.Random(seed)
    mixed = ["".join(rng.choices(rng.choice(POOLS) + rng.choice(POOLS), k=rng.randrange(60))) for _ in range(n)]
    anything = ["".join(chr(rng.choice([rng.randrange(0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(15)) for _ in range(n // 2)]
    return [*mixed, *anything, "", " " * 3000, "a" * 3000, "日" * 2000, "<|endoftext|> <|startoftext|>", "ab" * 2500]


def _library(name):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks_of(public_tokenizers.path(name)), special_tokens={})


@pytest.mark.parametrize("name", FILES)
def test_ids_and_text_are_the_librarys(name):
    ranks, library, cutter = ranks_of(public_tokenizers.path(name)), _library(name), Cutter(public_tokenizers.PATTERN)
    encoder, decoder = Encoder(ranks), Decoder(ranks)
    for text in _texts(1200):
        ids = b"".join(map(encoder.ids, cutter.cut(text)))
        assert list(array("I", ids)) == library.encode_ordinary(text)
        assert decoder.feed(array("I", ids)) + decoder.finish() == text


def test_small_memory_changes_nothing():
    ranks, cutter = ranks_of(public_tokenizers.path(FILES[0])), Cutter(public_tokenizers.PATTERN)
    small, large = Encoder(ranks, states=7, pairs=5), Encoder(ranks)
    for text in _texts(60, seed=2)[:90]:
        for words in cutter.cut(text[:300]):
            assert small.ids(words) == large.ids(words)
    assert len(small._known) <= 7


def test_any_vocabulary_follows_the_definition():
    """Made-up ranks, with tokens that merging never makes and equal pieces that several merges can make."""
    rng = random.Random(3)
    for _ in range(150):
        ranks = {bytes([i]): i for i in range(97, 100)}
        for _ in range(rng.randrange(1, 14)):
            ranks.setdefault(bytes(rng.choices(b"abc", k=rng.randrange(2, 6))), 200 + len(ranks))
        order = rng.sample(range(300, 400), len(ranks))
        ranks = {t: r if len(t) == 1 else order[i] for i, (t, r) in enumerate(ranks.items())}
        encoder = Encoder(ranks)
        for _ in range(60):
            word = "".join(rng.choices("abc", k=rng.randrange(1, 16)))
            whole = ranks.get(word.encode())
            want = [whole] if whole is not None else [ranks[p] for p in merges(word.encode(), ranks)[0]]
            assert list(array("I", encoder.ids([word]))) == want


def test_lookahead_is_bounded():
    """What is owed at any time is no longer than the longest token."""
    ranks = ranks_of(public_tokenizers.path(FILES[0]))
    encoder, longest = Encoder(ranks), max(map(len, ranks))
    for text in _texts(200, seed=4):
        at, read, given = encoder.start, 0, 0
        for byte in text.encode():
            out, at = at[byte]
            read += 1
            given += sum(len(encoder.text[t]) for t in array("I", out))
            assert read - given <= longest


def test_utf8_states():
    rng = random.Random(5)
    for _ in range(8000):
        data = bytes(rng.choices([0x41, 0x80, 0xBF, 0xC1, 0xC2, 0xE0, 0xA0, 0xED, 0x9F, 0xEF, 0xF0, 0x90, 0xF4, 0x8F, 0xF5, 0xFF], k=rng.randrange(8)))
        held, text = b"", ""
        for byte in data:
            now, held = utf8_step(held, byte)
            text += now
            assert len(held) < 4
        assert text + ("�" if held else "") == data.decode("utf-8", "replace")


def test_decoding_goes_on_between_feeds():
    ranks = ranks_of(public_tokenizers.path(FILES[0]))
    ids = _library(FILES[0]).encode_ordinary("naïve \U0001f468‍\U0001f469 日本 𞤀")
    decoder = Decoder(ranks)
    assert "".join(decoder.feed([i]) for i in ids) + decoder.finish() == "naïve \U0001f468‍\U0001f469 日本 𞤀"
    half = [ranks[b"\xe3"], 10**6, ranks[b"\xe3"]]
    assert decoder.feed(half) + decoder.finish() == "���"
    assert decoder.finish() == ""


def test_rows(spark):
    path = public_tokenizers.path(FILES[0])
    rows = [(1, "one two", "x"), (1, "one two", "x"), (None, "日本", None), (2, None, "y"), (3, "", "y"), (4, "long " * 60_000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    encoded = encode(docs, path, public_tokenizers.PATTERN)
    got = decode(encoded, path).collect()
    assert sorted((str(r.doc_id), r.decoded) for r in got) == sorted((str(i), t or "") for i, t, _ in rows)
    assert all(r.n_tokens == len(_library(FILES[0]).encode_ordinary(r.decoded)) for r in got)
    assert encode(docs.limit(0), path, public_tokenizers.PATTERN).count() == 0
    null = encoded.selectExpr("doc_id", "cast(null as binary) ids")
    assert {r.decoded for r in decode(null, path).collect()} == {None}


def test_query(spark):
    data = "/root/testdata/sf0.001"
    library = _library(FILES[0])
    got = {r.doc_id: r for r in queries()["op12_bpe_transducer"](spark, data).collect()}
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids, r = library.encode_ordinary(d.text or ""), got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()
