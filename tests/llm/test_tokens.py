import struct
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from evidentia.llm.packing import Packer, closest_fill, pack
from evidentia.llm.token_count import count_tokens
from evidentia.llm.tokens import PreTokens, steps

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  a  b ", "it's I'LL we've 'tis ''s", "ǅ İstanbul ΣΑΣ", "a<|endoftext|>b <|startoftext|>", "x\x85y\xa0z", "½²³ ªº µ", "é né", "漢字 テスト", "\t\n\r a\n\n b", "12 345", "😀😀", "\x1c\x1f", "ſt ĳ", "don’t", "ÀÉ ÇÑ ß"]


@pytest.mark.parametrize("path,kind", [(WORD, "word"), (BYTE, "byte")])
@settings(max_examples=200, deadline=None)
@given(st.one_of(st.sampled_from(ODD), st.text(st.characters(max_codepoint=0x250, exclude_categories=["Cs"]), max_size=60), st.text(alphabet="aB'sté 12.,\n\t<|>", max_size=60)))
def test_ids_are_the_librarys(path, kind, text):
    known = _known(path, kind)
    want = known.library.encode(text, add_special_tokens=False).ids
    assert known.ids(text) == struct.pack(f"<{len(want)}I", *want)
    assert known.count(text) == len(want)


TEXTS = ["it's 5 o’clock — ok", "Привет, мир! ΣΑΣ Ωmega", "日本語のテキスト。 漢字 12３", "naïve “quotes” … ½ ﬁ ǅ", "e\u0301 a \u0301b \u0130x", "ภาษาไทย हिन्दी עברית", "a\u2003b\u00a0 c\u3000\u3000d", "👩‍👩‍👧 ok"]


@pytest.mark.parametrize("path,kind", [(WORD, "word"), (BYTE, "byte")])
def test_only_special_strings_go_to_the_library_as_a_whole(path, kind, monkeypatch):
    known, asked = PreTokens(path, kind), []
    monkeypatch.setattr(known, "_encode", lambda text: asked.append(text) or b"")
    for text in [*TEXTS, " ".join(TEXTS) * 50]:
        want = known.library.encode(text, add_special_tokens=False).ids
        assert known.ids(text) == struct.pack(f"<{len(want)}I", *want), text
        assert known.count(text) == len(want)
        misses = []
        monkeypatch.setattr(known, "_word", lambda word: misses.append(word) or [])
        assert known.ids(text) and known.count(text) == len(want) and not misses, "all pre-tokens are known by now"
        monkeypatch.undo()
        monkeypatch.setattr(known, "_encode", lambda text: asked.append(text) or b"")
    assert not asked
    known.ids("a <|endoftext|>")
    assert asked == ["a <|endoftext|>"]


@pytest.mark.parametrize("path,kind", [(WORD, "word"), (BYTE, "byte")])
@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=40), st.text(alphabet="aΣé\u0301’ \n\u2003日ก5½", max_size=40))
def test_any_text_has_the_librarys_ids(path, kind, text, other):
    known = _known(path, kind)
    for t in (text, other, text + " " + other):
        want = known.library.encode(t, add_special_tokens=False).ids
        assert known.ids(t) == struct.pack(f"<{len(want)}I", *want)


_made = {}


def _known(path, kind):
    return _made.setdefault(path, PreTokens(path, kind))


def test_long_texts_are_cut_where_no_pre_token_crosses():
    text = "The thant's of  re. " * 400 + "x" * 300 + " a\n b" * 100
    assert "".join(steps(text, 64)) == text
    for path, kind in ((WORD, "word"), (BYTE, "byte")):
        known = _known(path, kind)
        whole = known.pattern.findall(text)
        assert [w for part in steps(text, 64) for w in known.pattern.findall(part)] == whole


def test_cache_is_bounded():
    known = PreTokens(BYTE, "byte", {"a": 1}, cache=5)
    for i in range(50):
        known.count(f"w{i}")
        assert len(known._lengths) <= 6


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), max_size=6), st.integers(0, 60))
def test_fill_is_the_closest(counts, capacity):
    sums = {0}
    for length, n in counts.items():
        sums = {s + k * length for s in sums for k in range(n + 1)}
    taken = closest_fill(counts, capacity)
    assert all(0 < n <= counts[k] for k, n in taken.items())
    assert sum(k * n for k, n in taken.items()) == max(s for s in sums if s <= capacity)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 70), max_size=40), st.integers(0, 8))
def test_pieces_hold_each_id_once_without_gaps(lengths, pool):
    packer, pieces = Packer(16, pool), []
    docs = {i: struct.pack(f"<{n}I", *range(i * 1000, i * 1000 + n)) for i, n in enumerate(lengths)}
    for i, ids in docs.items():
        pieces += packer.add(i, ids)
    pieces += packer.finish()
    parts, sequences = defaultdict(list), defaultdict(list)
    for doc, start, ids, total, sequence, offset in pieces:
        assert ids and total == lengths[doc]
        parts[doc].append((start, ids))
        sequences[sequence].append((offset, len(ids) // 4))
    assert all(b"".join(ids for _, ids in sorted(parts[i])) == ids for i, ids in docs.items())
    for i, p in parts.items():
        at = 0
        for start, ids in sorted(p):
            assert start == at
            at += len(ids) // 4
    for p in sequences.values():
        at = 0
        for offset, n in sorted(p):
            assert offset == at
            at += n
        assert at <= 16 and at & (at - 1) == 0, "full or a power of two: no padding"


def test_pack_and_count_over_a_table(spark):
    rows = [(1, "The quick brown fox " * 3000, "s", 5), (2, None, "s", 5), (3, "", None, None), (None, "same", "s", 1), (4, "same", "s", 1), (4, "same", "s", 1), (5, "a<|endoftext|>b", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string, n_tokens int")
    got = pack(docs, WORD, with_ids=True).collect()
    library = Tokenizer.from_file(WORD)
    assert sorted(r.doc_tokens for r in got if r.start == 0) == sorted(1 + len(library.encode(t or "", add_special_tokens=False).ids) for _, t, *_ in rows)
    for r in got:
        assert r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length
    long = b"".join(r.ids for r in sorted((r for r in got if r.doc_id == 1), key=lambda r: r.start))
    want = [*library.encode(rows[0][1], add_special_tokens=False).ids, 2]
    assert long == struct.pack(f"<{len(want)}I", *want)
    counted = sorted(count_tokens(docs, BYTE).collect(), key=str)
    library = Tokenizer.from_file(BYTE)
    assert counted == sorted(((i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t, *_ in rows), key=str)
    assert pack(docs.where("doc_id = -1"), WORD).count() == count_tokens(docs.where("doc_id = -1"), BYTE).count() == 0
