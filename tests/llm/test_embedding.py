import numpy as np
import pytest

from evidentia.llm.components import components
from evidentia.llm.embedding_dedup import codes, hadamard, near_embeddings


def test_transform_is_the_hadamard_matrix():
    h = np.array([[1.0]])
    for _ in range(4):
        h = np.block([[h, h], [h, -h]])
    x = np.random.default_rng(1).normal(size=(5, 16))
    assert np.allclose(hadamard(x), x @ h)


def test_codes_are_the_nearest_axes_and_probes_differ():
    own, visit = codes(np.random.default_rng(2).normal(size=(50, 24)))
    assert own.shape == (50, 4) and visit.shape == (50, 4, 4)
    assert all(len({own[i, t], *visit[i, t].tolist()}) == 5 for i in range(50) for t in range(4))
    assert codes(np.ones((2, 1)))[0].shape == (2, 4)


def _brute(rows):
    usable = [r for r in rows if r[0] is not None and r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    links, root = {i: 0 for i in range(len(usable))}, list(range(len(usable)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(usable):
        for j in range(i):
            b = usable[j]
            if a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], float), np.array(b[1], float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                    links[i] += 1
                    links[j] += 1
                    p, q = find(i), find(j)
                    root[p] = q
    least = {}
    for i, r in enumerate(usable):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    out = [(r[0], links[i], least[find(i)], r[0] == least[find(i)]) for i, r in enumerate(usable)]
    return sorted(out + [(r[0], 0, r[0], True) for r in rows if r not in usable], key=str)


def test_links_are_those_of_brute_force(spark):
    rng, rows, n = np.random.default_rng(3), [], 0
    for group in range(40):
        base = rng.normal(size=32)
        for _ in range(int(rng.integers(1, 9))):
            rows.append((n, [float(np.float32(x)) for x in base + rng.normal(size=32) * rng.choice([0.0, 0.05, 0.1, 0.14])], int(group % 3)))
            n += 1
    hot = [float(np.float32(x)) for x in rng.normal(size=32)]
    rows += [(1000 + i, hot, 1) for i in range(60)] + [(2000, hot, 2), (2001, None, 1), (2002, [0.0] * 32, 1), (2003, [float("nan")] * 32, 1), (2004, [None] * 32, 1), (2005, hot, None), (None, hot, 1), (2006, [], 1), (2007, [1.0], 1), (2008, [5.0], 1), (2009, [-1.0], 1), (2010, [float("inf")] + hot[1:], 1)]
    table = spark.createDataFrame([(*r, 1, True) for r in rows], "vec_id long, embedding array<float>, label int, code int, kept boolean")
    want = _brute(rows)
    for side in (256, 7):
        got = sorted(map(tuple, near_embeddings(table, side=side).collect()), key=str)
        assert len(got) == len(want)
        found, there = sum(r[1] for r in got), sum(r[1] for r in want)
        assert found <= there and found >= 0.99 * there
        if found == there:
            assert got == want
    assert near_embeddings(table.where("vec_id = -1")).count() == 0


@pytest.mark.parametrize("edges,want", [([], {}), ([(1, 1)], {}), ([(2, 1), (3, 2), (4, 3), (9, 8), (8, 9)], {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8}), ([(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)], {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 140), 100)})])
def test_components(spark, edges, want):
    table = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.root for r in components(table).collect()} == want


def test_rows_that_share_an_id_have_links_of_their_own(spark):
    rng = np.random.default_rng(5)
    a, b, c = ([float(np.float32(x)) for x in rng.normal(size=32)] for _ in range(3))
    near = [float(np.float32(x + 0.01)) for x in a]
    rows = [(5, a, 1), (5, b, 1), (6, near, 1), (7, c, 1), (7, c, 1), (8, a, 2), (5, c, 2), (3, c, 2), (9, near, 2), (4, b, 3), (4, near, 3), (2, near, 3)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted(map(tuple, near_embeddings(table).collect()), key=str)
    assert got == _brute(rows)
    assert (5, 1, 5, True) in got and (5, 0, 5, True) in got and got.count((7, 1, 7, True)) == 2 and (5, 1, 3, False) in got
