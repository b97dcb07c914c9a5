"""Keypoints under shifts, turns and scale; descriptors matched over tables; the ratio test against all pairs."""

import numpy as np
import pytest

from evidentia.operators.keypoints import blurred, doubled, keypoints, with_keypoints
from evidentia.operators.search import good_matches
from evidentia.queries import queries


def scene(seed, h=80, w=80):
    rng = np.random.default_rng(seed)
    yy, xx = np.ogrid[:h, :w]
    x = np.zeros((h, w))
    for _ in range(40):
        y0, x0, r = rng.integers(0, h), rng.integers(0, w), rng.integers(2, 9)
        x[(yy - y0) ** 2 + (xx - x0) ** 2 < r * r] = rng.uniform(0, 255)
    return np.repeat(x[:, :, None], 3, 2).astype(np.uint8)


def match(a, b):
    """[(keypoint of a, its match in b)] by the ratio test."""
    sims = np.array([k[-1] for k in a]) @ np.array([k[-1] for k in b]).T
    apart = np.sqrt(np.maximum(0, 2 - 2 * -np.sort(-sims, axis=1)[:, :2]))
    return [(a[i], b[int(sims[i].argmax())]) for i in np.nonzero(apart[:, 0] < 0.7 * apart[:, 1])[0]]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_turned_shifted_brightened_and_enlarged_images_match(seed):
    image = scene(seed)
    own = keypoints(image)
    assert len(own) > 25
    turned = match(own, keypoints(np.rot90(image).copy()))
    assert len(turned) > 0.6 * len(own)
    assert np.median([abs(a[2] - b[1]) + abs(79 - a[1] - b[2]) for a, b in turned]) < 0.5
    assert np.median([min((a[4] - b[4]) % 360, (b[4] - a[4]) % 360) for a, b in turned]) == pytest.approx(90, abs=3)
    shifted = match(own, keypoints(np.roll(image, (5, 7), (0, 1))))
    assert len(shifted) > 0.3 * len(own)
    assert np.median([abs(b[1] - a[1] - 7) + abs(b[2] - a[2] - 5) for a, b in shifted]) < 0.5
    larger = match(own, keypoints(np.kron(image, np.ones((2, 2, 1))).astype(np.uint8)))
    assert len(larger) > 0.4 * len(own) and np.median([b[3] / a[3] for a, b in larger]) == pytest.approx(2, rel=0.1)
    assert len(match(own, keypoints((image * 0.8 + 20).astype(np.uint8)))) > 0.5 * len(own)
    assert len(match(own, keypoints(scene(seed + 50)))) < 0.1 * len(own)


def test_descriptors_and_small_images():
    for k in keypoints(scene(4)):
        assert len(k[-1]) == 128 and np.linalg.norm(k[-1]) == pytest.approx(1, abs=1e-5) and min(k[-1]) >= 0
    for shape in ((1, 1), (3, 40), (8, 8), (9, 2)):
        assert keypoints(np.full((*shape, 3), 7, np.uint8)) == []
    assert np.allclose(blurred(np.full((9, 5), 3.0), 2.5), 3) and doubled(np.eye(3)).shape == (6, 6)


def test_tables(spark):
    images = [(i, 80, 80, 3, scene(i).tobytes()) for i in range(5)] + [(9, 80, 80, 3, b"short"), (10, None, None, None, None)]
    df = spark.createDataFrame(images, "image long, height int, width int, channels int, data binary")
    held = with_keypoints(df, "image").cache()
    assert {r.image for r in held.select("image").distinct().collect()} == set(range(5))
    turned = [(i, 80, 80, 3, np.rot90(scene(i), 2).tobytes()) for i in range(5)]
    asked = with_keypoints(spark.createDataFrame(turned, "query_id long, height int, width int, channels int, data binary"), "query_id").cache()
    want = {}
    rows, others = held.collect(), asked.collect()
    for q in range(5):
        for i in range(5):
            a, b = ([(None, r.clip) for r in x if r[0] == n] for x, n in ((others, q), (rows, i)))
            sims = np.round(np.array([v for _, v in a], float) @ np.array([v for _, v in b], float).T, 6)
            apart = np.sqrt(np.maximum(0, 2 - 2 * -np.sort(-sims, axis=1)[:, :2]))
            want[q, i] = int((apart[:, 0] < 0.7 * apart[:, 1]).sum())
    for chunk in (4096, 16):
        got = {(r.query_id, r.image): r.good for r in good_matches(asked, held, chunk=chunk).collect()}
        assert got == want
    assert all(max(range(5), key=lambda i: want[q, i]) == q for q in range(5))  # noqa: B023


def test_query_finds_the_turned_image(spark):
    got = queries()["keypoint_matches"](spark, "/root/testdata/sf0.001").collect()
    first = [r for r in got if r.rank_no == 1]
    assert len(first) == 25 and sum(r.query_id == r.image for r in first) >= 23


def test_images_of_one_size_are_taken_together(monkeypatch):
    """Bit by bit as each alone, whatever the sizes; so many pixels at a time."""
    from evidentia.operators import keypoints as kp

    images = [scene(n, *shape) for n, shape in enumerate([(32, 32)] * 5 + [(9, 2), (40, 33), (32, 32)])]
    alone = [keypoints(i) for i in images]
    assert sum(map(len, alone)) > 60
    calls, whole = [], kp.octaves
    monkeypatch.setattr(kp, "octaves", lambda x: calls.append(x.shape) or whole(x))
    monkeypatch.setattr(kp, "PIXELS", 2048)
    monkeypatch.setattr(kp, "AROUND", 3000)
    assert kp.keypoints_of(images) == alone
    assert calls == [(2, 32, 32)] * 3 + [(1, 9, 2), (1, 40, 33)]


def test_doubtful_matches_are_reckoned_in_double_precision(spark, monkeypatch):
    """Distances around the ratio's limit, nearer to it than single precision tells, and equal ones: as all pairs say."""
    from evidentia.operators import search

    def at(sim, n):
        v = np.zeros(128)
        v[0], v[n] = sim, np.sqrt(1 - sim**2)
        return v

    rng, held, want = np.random.default_rng(5), [], {}
    query = np.eye(128)[0]
    for image in range(60):
        far = rng.uniform(0.2, 0.9)
        near = 1 - 0.49 * (1 - far) + rng.uniform(-3e-6, 3e-6)
        sims = [near, far, *[far - 0.1] * (image % 3)] if image else [1.0, 1.0]
        held += [(image, n, at(s, n + 1).tolist()) for n, s in enumerate(sims)]
        one, two = sorted((round(float(np.array(h[2]) @ query), 6) for h in held[-len(sims) :]), reverse=True)[:2]
        want[image] = int(np.sqrt(2 - 2 * one) < 0.7 * np.sqrt(2 - 2 * two))
    assert 15 < sum(want.values()) < 45
    rough = []
    whole = search._closer
    monkeypatch.setattr(search, "_closer", lambda *a: rough.append(a) or whole(*a))
    vectors = np.array([h[2] for h in held])
    sizes = np.bincount([h[0] for h in held])
    starts = np.cumsum(sizes) - sizes
    larger = np.argsort(-sizes, kind="stable")
    slots = [starts[larger[: np.count_nonzero(sizes > n)]] + n for n in range(sizes.max())]
    columns = np.ascontiguousarray(vectors[np.concatenate(slots)].T, np.float32)
    good = search._good(query[None], columns, slots, vectors, 1.0, starts[larger], sizes[larger], 0.7)[0, np.argsort(larger)]
    assert good.astype(int).tolist() == list(want.values()) and len(rough) > 50
    descriptors = spark.createDataFrame([(7, 0, query.tolist())], "query_id long, descriptor int, clip array<double>")
    got = good_matches(descriptors, spark.createDataFrame(held, "image long, descriptor int, clip array<double>")).collect()
    assert {r.image: r.good for r in got} == want
