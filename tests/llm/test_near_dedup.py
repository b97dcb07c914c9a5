import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.llm import near_dedup
from evidentia.llm.near_dedup import band_keys, document_frequencies, inverse_frequencies, near_duplicates, samples, shingles, similarity
from tests.llm.test_lm_scoring import _words


def test_samples_agree_as_often_as_the_similarity():
    rng = np.random.default_rng(4)
    hashes = np.sort(rng.integers(0, 1 << 63, 300, dtype=np.uint64))
    for share, spread in ((0.9, 0.3), (0.6, 1.0), (0.3, 2.0)):
        wa, wb = np.exp(rng.normal(size=300) * spread), np.exp(rng.normal(size=300) * spread)
        wb = np.where(rng.random(300) < share, wa, wb)
        a, b = (hashes[:280], wa[:280]), (hashes[20:], wb[20:])
        want = np.minimum(wa[20:280], wb[20:280]).sum()
        want /= wa[:280].sum() + wb[20:].sum() - want
        assert similarity(a, b) == pytest.approx(want)
        got = (samples(*a, 4000) == samples(*b, 4000)).mean()
        assert abs(got - want) < 5 * (want * (1 - want) / 4000) ** 0.5 + 0.01
    assert len(band_keys(samples(hashes, np.ones(300), 48), 12, 4)) == 12
    assert (samples(hashes[:0], np.ones(0), 8) == samples(hashes[:0], np.ones(0), 8)).all()


def _plain(text):
    w = _words(text)
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def _brute(rows, gain=near_dedup.IDF_GAIN):
    """Classes by all pairs, with exact document frequencies."""
    bags = [_plain(t) for _, t in rows]
    docs = sum(1 for b in bags if b)
    df = Counter(s for b in bags for s in b)
    weigh = [{s: n * (1 + gain * np.log((1 + docs) / (1 + df[s])) / np.log(1 + docs)) for s, n in b.items()} for b in bags]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    near = []
    for i in range(len(rows)):
        for j in range(i):
            both = sum(min(w, weigh[j][s]) for s, w in weigh[i].items() if s in weigh[j])
            if both:
                s = both / (sum(weigh[i].values()) + sum(weigh[j].values()) - both)
                near.append(s)
                if s >= 0.8:
                    root[find(i)] = find(j)
    least, size = {}, Counter(find(i) for i in range(len(rows)))
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted((r[0], least[find(i)], size[find(i)], r[0] == least[find(i)]) for i, r in enumerate(rows)), near


def _corpus(rng, groups, most):
    rows, n = [], 0
    for _ in range(groups):
        base = [f"w{rng.randrange(2000)}" for _ in range(rng.randrange(20, 200))]
        for _ in range(rng.randrange(1, most)):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 30])):
                text[rng.randrange(len(text))] = f"x{rng.randrange(9000)}"
            rows.append((n, " ".join(text).capitalize() + rng.choice(["", ".", "!"])))
            n += 1
    passage = " ".join(f"p{i}" for i in range(60))
    for _ in range(60):  # a passage that many different documents share
        rows.append((n, passage + " " + " ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randrange(20, 60)))))
        n += 1
    return rows


@pytest.mark.parametrize("side", [256, 5])
def test_classes_are_those_of_brute_force(spark, side):
    rows = _corpus(random.Random(7), 60, 8)  # no pair lies at the threshold
    rows += [(9000, None), (9001, ""), (9002, " .. "), (9003, "one two"), (9004, "One, two!"), (9005, "one two three")]
    want, near = _brute(rows)
    assert sum(s >= 0.8 for s in near) > 100 and not any(abs(s - 0.8) < 1e-3 for s in near)
    docs = spark.createDataFrame([(*r, "n", 1) for r in rows], "doc_id long, text string, node string, band int").repartition(6)
    got = sorted(map(tuple, near_duplicates(docs, side=side).drop("words_digest").collect()))
    assert got == want


def test_links_beside_the_leader_are_found(spark, monkeypatch):
    """Members that fail against their bucket's smallest node are compared among themselves."""
    real = near_dedup.signatures
    monkeypatch.setattr(near_dedup, "signatures", lambda *a: real(*a).withColumn("bands", F.array_repeat(F.lit(7).cast("long"), 12)))  # one bucket for all
    rows = _corpus(random.Random(8), 12, 5)[:70]
    want, _ = _brute(rows)
    assert sorted(map(tuple, near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), side=16).drop("words_digest").collect())) == want


def test_frequencies_and_odd_rows(spark):
    rows = [(i, f"a b c d e f{i % 3} g") for i in range(200)] + [(None, "a b c d e f0 g"), (500, "same words here again ok"), (500, "Same words here again ok"), (501, "x" * 300_000), (502, "word " * 60_000), (503, "word " * 60_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(70)
    found, n = document_frequencies(docs, 1 << 17)
    want = np.zeros(1 << 17, np.int64)
    for _, t in rows:
        np.add.at(want, near_dedup.counter(shingles(t)[0], 1 << 17), 1)
    assert n == len(rows) and (found == want).all()
    got = near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert {(r.class_id, r.class_size) for r in got} == {(0, 68), (1, 67), (2, 66), (500, 2), (501, 1), (502, 2)}
    assert sorted(r.doc_id for r in got if r.kept) == [0, 1, 2, 500, 501, 502]
    assert near_duplicates(docs.where("doc_id = -1")).count() == 0


def test_rare_shingles_stay_rare_when_counters_fill_up():
    rng = np.random.default_rng(4)
    docs, counters = 100_000, 1 << 12
    counts = rng.poisson(5000, counters)  # thousands of rare shingles in each
    counts[:3] += [100_000, 30_000, 3000]
    weights = inverse_frequencies(counts, docs)
    exact = [1 + np.log((1 + docs) / (1 + f)) / np.log(1 + docs) for f in (100_000, 30_000, 3000)]
    assert np.abs(weights[:3] - exact).max() < 0.02
    assert np.median(weights[3:]) > 1.6 and weights.min() >= 1 and weights.max() <= 2
    plain = inverse_frequencies(np.array([1, 2, 50] + [0] * 1000), 50)
    assert plain.dtype == np.float32 and (np.diff(plain[:3]) < 0).all()
