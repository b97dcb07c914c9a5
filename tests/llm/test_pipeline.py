from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from evidentia.llm.mixing import WEIGHTS
from tests.llm.test_mixing import _targets

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = [(90_000, None, None, None, None), (90_001, "", "en", "src1", 0), (90_002, "12 34 !?", "en", "src1", 8), (90_003, "the of and " * 30_000, None, None, 330_000), (None, "the thing that is in the nation", "en", None, 31), (90_004, "Same text of the nation", "en", "src2", 23), (90_004, "Same text of the nation", "en", "src2", 23)]
    path = tmp_path_factory.mktemp("tables")
    source.unionByName(spark.createDataFrame(odd, COLUMNS)).write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.fixture(scope="module")
def stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append(docs)
    return [[r for r in d.collect()] for d in out], [d.columns for d in out]


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact", "near", "mixture", "packed"]
    assert all(c == stages[1][0] for c in stages[1][:-1])


def test_language_drops_what_has_none(stages):
    before, after = stages[0][0], stages[0][1]
    assert Counter(map(tuple, before)) - Counter(map(tuple, after)) == Counter([(90_000, None, None, None, None), (90_001, "", "en", "src1", 0), (90_002, "12 34 !?", "en", "src1", 8)])


def test_one_document_of_each_text(stages):
    before, after = stages[0][1], stages[0][2]
    groups = defaultdict(list)
    for r in before:
        groups["".join(c.lower() if "A" <= c <= "Z" else c for c in r.text)].append(r)
    want = [max(g, key=lambda r: -1 if r.doc_id is None else r.doc_id) for g in groups.values()]
    assert Counter(map(tuple, want)) == Counter(map(tuple, after)) and len(want) < len(before)


def test_no_near_duplicates_stay(stages):
    from tests.llm.test_near_dedup import _brute

    before, after = stages[0][2], stages[0][3]
    rows = [(-1 if r.doc_id is None else r.doc_id, r.text) for r in before]
    want, _ = _brute(rows)
    assert sorted(i for i, _, _, kept in want if kept) == sorted(-1 if r.doc_id is None else r.doc_id for r in after)


def test_sources_come_near_their_targets(stages):
    before, after = stages[0][3], stages[0][4]
    size, taken, times = defaultdict(int), defaultdict(int), Counter()
    by_id = {r.doc_id: r for r in before}
    for r in before:
        size[r.source] += len(r.text.split())
    for r in after:
        whole = by_id[r.doc_id]
        assert whole.text.startswith(r.text) and (r.source, r.lang) == (whole.source, whole.lang) and r.n_chars == len(r.text)
        taken[r.source] += len(r.text.split())
        times[r.doc_id] += 1
    want = _targets(size, WEIGHTS)
    assert all(abs(taken[s] - want[s]) <= 1 for s in size) and max(times.values()) == 2


def test_packed_tokens_are_those_of_the_mix(stages):
    before, after = stages[0][4], stages[0][5]
    starts = Counter((r.doc_id, r.doc_tokens) for r in after if r.start == 0)
    assert sum(starts.values()) == len(before)
    assert sum(r.length for r in after) == sum(n * t for (_, n), t in starts.items())
    sequences = defaultdict(list)
    for r in after:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at & (at - 1) == 0 and at <= 4096


def test_run_applies_the_stages(spark, folder, stages):
    got = corpus_pipeline.run(spark, folder).collect()
    assert sum(r.length for r in got) == sum(r.length for r in stages[0][5])
