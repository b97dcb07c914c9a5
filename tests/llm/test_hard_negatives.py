"""Hard negatives against every anchor and every row, the curve, the bounds, and what the zone maps save."""

import itertools

import numpy as np
import pytest

from evidentia.llm.hard_negatives import Part, bounds, hilbert_keys, mine, search

SCHEMA = "vec_id long, embedding array<double>, label int, rank string, score int"


def brute_force(rows, every=100, k=5, n=5, share=(80, 100)):
    """Sorted results over (vec_id, vector, label) in which every row takes part that may."""
    good = []
    for vec_id, vector, label in rows:
        if None in (vec_id, vector, label) or any(x is None or not np.isfinite(x) for x in vector):
            continue
        good.append((vec_id, [int(np.floor(256 * x)) for x in vector], label))
    out = []
    for i, (vec_id, x, label) in enumerate(good):
        if vec_id % every:
            continue
        scores = [(-sum(a * b for a, b in zip(x, y, strict=True)), other, j) for j, (other, y, _) in enumerate(good) if j != i and len(y) == len(x)]
        near = sorted(s for s in scores if good[s[2]][2] == label)[:k]
        for p, positive, _ in near:
            window = sorted(s for s in scores if good[s[2]][2] != label and share[0] * -p <= 100 * -s[0] <= share[1] * -p)[:n]
            out += [(vec_id, positive, rank, negative, -p, -s) for rank, (s, negative, _) in enumerate(window, 1)]
    return sorted(out)


def _run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, l, "x", 1) for i, v, l in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, mine(df, **options).collect()))


def test_the_curve_visits_every_cell_and_moves_by_one():
    for dims, bits in ((1, 4), (2, 4), (3, 3), (5, 2), (4, 1)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        keys = hilbert_keys(cells, bits)
        assert len(set(keys)) == len(cells)
        way = cells[np.argsort(np.array(keys, object), kind="stable")]
        assert (np.abs(np.diff(way, axis=0)).sum(axis=1) == 1).all()
    assert hilbert_keys(np.zeros((2, 0), int), 4) == [b"", b""]


def test_bounds_hold_every_product():
    rng = np.random.default_rng(1)
    anchors, block = rng.integers(-50, 50, (20, 6)), rng.integers(-50, 50, (30, 6))
    least, most = bounds(anchors, block.min(axis=0)[None], block.max(axis=0)[None])
    products = anchors @ block.T
    assert (products >= least).all() and (products <= most).all()


def _part(rows, ids, labels, vectors):
    x = np.array(vectors, np.int64)
    return Part({"chunk": 0, "n": len(x), "dims": x.shape[1], "labels": labels, "rows": np.array(rows).tobytes(), "ids": np.array(ids).tobytes(), "wide": True, "vectors": x.tobytes(), "low": x.min(axis=0).tobytes(), "high": x.max(axis=0).tobytes()})


def test_blocks_that_cannot_matter_are_not_read():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 8)) * 400
    blocks = [_part(range(40 * i, 40 * i + 40), range(40 * i, 40 * i + 40), ["a", "b"] * 20, (c + rng.normal(size=(40, 8)) * 9).astype(int)) for i, c in enumerate(centres)]
    chunk = _part([0, 40], [0, 40], ["a", "a"], [blocks[0].vectors[0], blocks[1].vectors[0]])
    everything = {0: {0: (-float("inf"), float("inf"))}, 40: {0: (-float("inf"), float("inf"))}}
    found, reads = search(chunk, blocks, everything, 5, True, False)
    assert reads < 20 < 2 * len(blocks)
    every = np.concatenate([b.vectors for b in blocks])
    for row in (0, 40):
        scores = every @ every[row]
        want = sorted((-int(s), i) for i, s in enumerate(scores) if i % 2 == 0 and i != row)[:5]
        assert [(-s, i) for r, _, s, i, _ in found if r == row] == want
    narrow = {0: {1: (10**7, 10**8)}}
    assert search(chunk, blocks, narrow, 5, False, False) == ([], 0)


@pytest.mark.parametrize("options", [{}, {"block": 7, "chunk": 2, "slot": 3}])
def test_all_rows(spark, options):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.normal(size=6) / 2.4], int(rng.integers(3))) for i in range(400)]
    rows += [(100, rows[100][1], rows[100][2]), (7, rows[7][1], rows[7][2]), (500, [0.0] * 6, 1), (501, [0.0] * 6, 2), (502, [0.0] * 6, 1)]
    rows += [(600, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (700, None, 1), (800, [float("nan")] * 6, 1), (900, [float("inf")] * 6, 1), (None, [0.5] * 6, 1), (1000, [0.5] * 6, None)]
    rows += [(1100, [0.5, 0.2], 1), (1101, [0.5, 0.1], 1), (1102, [0.5, 0.1], 2), (1200, [], 1), (1201, [], 1), (1202, [], 0)]
    want = brute_force(rows)
    assert len(want) > 50
    assert _run(spark, rows, **options) == want


def test_ties_hot_groups_and_one_label(spark):
    same = [(i, [0.5, 0.25], i % 2) for i in range(0, 300)]
    assert _run(spark, same, block=16) == brute_force(same)
    alone = [(i, [0.1 * i], 0) for i in range(0, 200, 50)]
    assert _run(spark, alone) == []
    assert _run(spark, [(100, [1.0], 1)]) == [] and _run(spark, []) == []
    nobody = [(i, [1.0], i % 2) for i in range(1, 9)]
    assert _run(spark, nobody) == []


def test_numbers_beyond_a_doubles(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i) * 50, [float(x) * 2.0**22 for x in rng.normal(size=3)], int(rng.integers(2))) for i in range(30)]
    assert _run(spark, rows) == brute_force(rows)
    huge = [(i * 100, [1e300 * (1 + i % 2), -1.0], i % 2) for i in range(6)]
    assert len(_run(spark, huge)) > 0
