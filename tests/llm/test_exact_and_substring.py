import hashlib
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from evidentia.llm import exact_dedup, substring_dedup
from evidentia.llm.exact_dedup import Directory, build_index, exact_groups
from evidentia.llm.substring_dedup import normal, remove_repeats, repeated_spans, without

SCHEMA = "doc_id long, text string, key long, bytes string, removed int"


def test_directory_splits_overfull_buckets_and_keeps_doubling():
    rng = random.Random(3)
    for capacity, bits in [(1, 64), (3, 64), (25, 64), (2, 12)] * 10:
        keys = {rng.randrange(1 << bits) for _ in range(rng.randrange(200))}
        keys |= {k ^ x << (bits - 10) for k in list(keys)[:5] for x in (1, 2, 3)}  # alike in their first bits
        directory = Directory(bits, capacity)
        for key in keys:
            directory.insert(key, [key])
        assert len(directory.slots) == 1 << directory.depth
        found = {}
        for prefix, depth, chains in directory.buckets():
            assert len(chains) <= capacity and all(k >> (bits - depth) == prefix for k in chains)
            assert directory.depth == 0 or depth <= directory.depth
            found |= chains
        assert found == {k: [k] for k in keys}
        assert max(d for _, d, _ in directory.buckets()) == directory.depth, "it doubles only for a bucket as deep as itself"


def _want(rows):
    groups = defaultdict(list)
    for r in rows:
        groups["".join(c.lower() if "A" <= c <= "Z" else c for c in r[1] or "")].append(r[0])
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        left = True
        for i in ids:
            kept = i == keep and left
            left = left and not kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


ROWS = [(1, "Same TEXT"), (2, "same text"), (3, "same texT"), (4, "SAME TÉXT"), (5, "same téxt"), (6, None), (7, ""), (8, "x" * 200_000), (9, "X" * 200_000), (9, "x" * 200_000), (None, "null id"), (None, "null id"), (10, "null"), (11, "a\nb")]


def test_groups_are_those_of_the_bytes(spark):
    docs = spark.createDataFrame([(*r, 0, "b", 1) for r in ROWS], SCHEMA)
    for capacity in (1, 512):
        assert sorted(map(tuple, exact_groups(docs, capacity=capacity).collect()), key=str) == _want(ROWS)
    assert exact_groups(docs.where("doc_id = -1")).count() == 0


def test_colliding_keys_are_chained_and_bytes_compared(spark):
    docs = spark.createDataFrame([(*r, 0, "b", 1) for r in ROWS], SCHEMA)
    for bits in (1, 3):  # every text gets one of two or eight keys
        assert sorted(map(tuple, exact_groups(docs, capacity=2, key_bits=bits).collect()), key=str) == _want(ROWS)
    index = build_index(docs.select("doc_id", "text"), bits=1)
    assert index.select("key").distinct().count() == 2 and index.count() == len({r[4] for r in _want(ROWS)})
    chains = index.groupBy("key").agg({"chain": "max", "*": "count"}).collect()
    assert all(r["max(chain)"] + 1 == r["count(1)"] for r in chains)


def test_the_index_decides_the_groups(spark, monkeypatch):
    real = exact_dedup.build_index
    monkeypatch.setattr(exact_dedup, "build_index", lambda *a: real(*a).withColumn("keep_id", F.col("keep_id") - 100))
    docs = spark.createDataFrame([(1, "a"), (2, "A")], "doc_id long, text string")
    assert [r.keep_id for r in exact_groups(docs).collect()] == [-98, -98]


LONG = " ".join(f"word{i}" for i in range(60))


def test_repeats_leave_the_earliest(spark):
    rows = [(3, f"intro one two\n{LONG}\nend"), (1, f"{LONG.upper()}  \nshort\nshort"), (2, f"a\n\n{LONG}\n{LONG}"), (4, None), (5, ""), (6, "short\nnothing repeats " + LONG), (7, "z " * 50_000), (8, "z " * 50_000), (8, "z " * 50_000), (None, LONG)]
    docs = spark.createDataFrame([(*r, 0, "b", 1) for r in rows], SCHEMA)
    got = defaultdict(list)
    for r in repeated_spans(docs).collect():
        got[r.doc_id].append([(x.start, x.end, x.first_doc_id) for x in r.removed])
        assert r.n_removed == len(r.removed) and r.removed_chars == sum(x.end - x.start for x in r.removed)
    assert got[1] == [[]] and got[4] == got[5] == got[6] == got[7] == [[]]
    assert got[3] == [[(14, 14 + len(LONG), 1)]]
    assert got[2] == [[(3, 3 + len(LONG), 1), (4 + len(LONG), 4 + 2 * len(LONG), 1)]]
    assert got[8] == [[(0, 100_000, 7)]] * 2 and got[None] == [[(0, len(LONG), 1)]]
    kept = {r.doc_id: r.text for r in remove_repeats(docs.where("doc_id < 8")).collect()}
    assert kept[3] == "intro one two\nend" and kept[2] == "a\n\n" and kept[4] is None and kept[1] == rows[1][1]
    assert repeated_spans(docs.where("doc_id = -1")).count() == 0


def test_spans_are_those_of_brute_force(spark):
    rng = random.Random(5)
    lines = [" ".join(rng.choices("abcdefgh", k=rng.randrange(8, 14))) for _ in range(40)]
    rows = [(i, rng.choice(["\n", "\n\n"]).join(rng.choices(lines, k=rng.randrange(6)))) for i in range(80)]
    seen, want = set(), {}
    for i, text in rows:
        at, want[i] = 0, []
        for line in text.split("\n"):
            form = normal(line)
            if len(form.split()) >= substring_dedup.MIN_WORDS:
                if form in seen:
                    want[i].append((at, at + len(line)))
                seen.add(form)
            at += len(line) + 1
    got = {r.doc_id: [(x.start, x.end) for x in r.removed] for r in repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == want
    assert without("ab\ncd\nef", [(3, 5)]) == "ab\nef"
    assert repeated_spans(spark.createDataFrame([(1, f"{LONG}\nx\n\n{LONG}\nx")], "doc_id long, text string"), kind="paragraph").first().n_removed == 1


def _sentences(rows, least=substring_dedup.MIN_WORDS):
    """By brute force: for each row the words (as places) that a removed unit covers, and whether a run repeats others."""
    words = re.compile("[a-z0-9_\x80-\U0010ffff]+")
    parts = {}
    for i, text in rows:
        at, parts[i] = 0, []
        for piece in re.split("\n|(?<=[.!?])[ \t]", text):
            if found := words.findall(piece.lower()):
                parts[i].append((at, at + len(piece), found))
            at += len(piece) + 1
    seen, out = {}, {}
    for i, held in parts.items():
        count, spans = 0, []
        for k, (start, _, _) in enumerate(held):
            unit, j = [], k
            while j < len(held) and len(unit) < least:
                unit += held[j][2]
                j += 1
            if len(unit) < least:
                continue
            first = seen.setdefault(tuple(unit), (i, start))
            if first != (i, start):
                before = sum(len(p[2]) for p in held[:k])
                if spans and before <= spans[-1][3]:
                    spans[-1][1:] = [held[j - 1][1], spans[-1][2], before + len(unit), spans[-1][4] | (first[0] != i)]
                else:
                    spans.append([start, held[j - 1][1], before, before + len(unit), first[0] != i])
            count += 1
        out[i] = count, [(s, e) for s, e, *_ in spans], sum(b - a >= substring_dedup.PASSAGE_WORDS and other for _, _, a, b, other in spans)
    return out


def test_sentence_units_find_passages_within_lines(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefgh", k=3))
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + rng.choice(".!?")
    passages = [" ".join(sentence(rng.randrange(2, 9)) for _ in range(12)) for _ in range(4)]
    rows = []
    for i in range(60):
        pieces = [sentence(rng.randrange(1, 16)) for _ in range(rng.randrange(6))]
        if i % 2:
            pieces.insert(rng.randrange(len(pieces) + 1), rng.choice(passages).replace(" ", rng.choice([" ", "  "])))
        rows.append((i, "".join(p + rng.choice([" ", "\n", "\n\n"]) for p in pieces)))
    got = {r.doc_id: (r.n_units, [(x.start, x.end) for x in r.removed], r.n_passages) for r in repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), kind="sentence").collect()}
    assert got == _sentences(rows)
    holders = {p: [i for i, t in rows if p.replace(" ", "") in t.replace(" ", "")] for p in passages}
    assert all(got[i][2] == 1 for found in holders.values() for i in found[1:]) and not any(got[i][2] for i in range(0, 60, 2))


def test_rows_that_share_an_id_are_cut_each(spark):
    rows = [(1, f"{LONG}\na"), (1, f"{LONG}\nb"), (None, f"c\n{LONG}"), (None, None), (2, "語" * 12 + "。" + "文" * 12), (3, "文" * 12 + "。他")]
    docs = spark.createDataFrame([(*r, 7, "b", 1) for r in rows], SCHEMA)
    got = sorted(((r.doc_id, r.text) for r in remove_repeats(docs).collect()), key=str)
    assert len(got) == 6 and sum(LONG in (t or "") for _, t in got) == 1 and sorted(t for i, t in got if i is None and t) == ["c\n"]
    assert [r.text for r in remove_repeats(docs, kind="sentence").where("doc_id = 3").collect()] == ["。他"]
    assert remove_repeats(docs).columns == docs.columns


def test_parts_of_lines_are_cut_where_their_words_say():
    rng = random.Random(9)
    text = "\n".join(" ".join("".join(rng.choices("abcdefgh", k=rng.randrange(1, 7))) for _ in range(rng.randrange(40))) for _ in range(30)) + "\n文字をここで切る。Ｗörd, mixed漢字word; end "
    held = list(substring_dedup.parts(text, "words"))
    for (start, end, form, n), (after, *_) in zip(held, [*held[1:], (len(text),)], strict=True):
        assert form == normal(text[start:end]) and n == substring_dedup.size(form) and end <= after
        between = text[end:after]
        last = re.findall(f"[{substring_dedup.UNSPACED}]|[{substring_dedup.SPACED}]+", text[start:end])[-1]
        assert substring_dedup.ends_part(last.lower()) or "\n" in between or not normal(text[end:])
    share = sum(substring_dedup.ends_part(f"w{i}") for i in range(20_000)) / 20_000
    assert 0.09 < share < 0.11


def test_planted_passages_are_found_wherever_they_begin(spark):
    """Passages of 60 words, cut out of documents at any word and planted at any word of others, none of which is alike."""
    rng = random.Random(10)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randrange(2, 9)))
    prose = lambda n: [w + rng.choice(["", "", "", "", ",", "", "", "", ".", "\n"]) if rng.random() < 0.3 else w for w in (word() for _ in range(n))]
    docs, planted = [prose(300) for _ in range(250)], range(100, 200)
    for i in planted:
        at, to = rng.randrange(240), rng.randrange(300)
        docs[i] = docs[i][:to] + docs[i - 100][at : at + 60] + docs[i][to:]
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)]
    got = {r.doc_id: r for r in repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), kind="words").collect()}
    assert sum(got[i].n_removed > 0 for i in planted) >= 95
    assert sum(got[i].n_passages > 0 for i in planted) >= 85
    assert all(got[i].n_removed == 0 for i in range(250) if i not in planted)
