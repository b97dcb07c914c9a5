"""Keypoints of grey images: extrema of differences of Gaussians in scale and place, orientations, and descriptors of
gradients that do not change with scale and turn. NumPy in Arrow batches; images of one size are taken together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from .imaging import _each, grey

# Fixed values of the method: scales of an octave, blur of the first scale and of the camera, least contrast, largest ratio of
# curvatures, bins of directions, cells of a descriptor on a side, bins of a cell, largest share of one entry.
SCALES, FIRST_BLUR, CAMERA_BLUR, CONTRAST, EDGE = 3, 1.6, 0.5, 0.04, 10.0
DIRECTIONS, CELLS, BINS, LARGEST = 36, 4, 8, 0.2
#: Images are not halved below so many pixels on a side; extrema keep so many pixels from the border.
LEAST_SIDE, BORDER = 8, 2
#: Pixels of images that are taken together, and pixels around keypoints: what a pass works on stays in the processor's cache.
PIXELS, AROUND = 1 << 14, 1 << 15
COLUMNS = "descriptor int, x double, y double, size double, angle double, response double, clip array<float>"


def blurred(image: np.ndarray, sigma: float) -> np.ndarray:
    n = max(1, int(np.ceil(3 * sigma)))
    line = np.exp(-(np.arange(-n, n + 1) ** 2) / (2 * sigma**2))
    line /= line.sum()
    for axis in (image.ndim - 2, image.ndim - 1):
        size = image.shape[axis]
        padded = np.pad(image, [(n, n) if a == axis else (0, 0) for a in range(image.ndim)], mode="symmetric" if size >= n else "edge")
        part = lambda i: padded[..., i : i + size] if axis == padded.ndim - 1 else padded[..., i : i + size, :]  # noqa: B023, E731
        image = line[0] * part(0)
        for i, w in enumerate(line[1:], 1):
            image += w * part(i)
    return image


def doubled(image: np.ndarray) -> np.ndarray:
    """Twice as large; pixel (y, x) comes from (y / 2, x / 2)."""
    h, w = image.shape[-2:]
    y, x = np.minimum(np.arange(2 * h) / 2, h - 1), np.minimum(np.arange(2 * w) / 2, w - 1)
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None]
    at = lambda y, x: image[..., y[:, None], x[None]]
    return (at(y0, x0) * (1 - fx) + at(y0, x1) * fx) * (1 - fy) + (at(y1, x0) * (1 - fx) + at(y1, x1) * fx) * fy


def octaves(images: np.ndarray) -> Iterator[np.ndarray]:
    """Stacks of ``SCALES`` + 3 blurred images for each image, each octave of half the size of the one before; the first is of
    double size."""
    step = 2 ** (1 / SCALES)
    now = blurred(doubled(images), np.sqrt(max(FIRST_BLUR**2 - (2 * CAMERA_BLUR) ** 2, 0.01)))
    while min(now.shape[-2:]) >= LEAST_SIDE:
        stack = [now]
        for s in range(1, SCALES + 3):
            before = FIRST_BLUR * step ** (s - 1)
            stack.append(blurred(stack[-1], before * np.sqrt(step**2 - 1)))
        yield np.stack(stack, axis=1)
        now = stack[SCALES][..., ::2, ::2]


def extrema(dog: np.ndarray) -> np.ndarray:
    """(image, scale, y, x) of the values that are greatest or least among their 26 neighbours, and not near zero."""
    inner = dog[:, 1:-1, BORDER:-BORDER, BORDER:-BORDER]
    if 0 in inner.shape:
        return np.zeros((0, 4), int)
    _, s, h, w = inner.shape
    top, low = np.full(inner.shape, -np.inf), np.full(inner.shape, np.inf)
    for a, b, c in np.ndindex(3, 3, 3):
        if (a, b, c) != (1, 1, 1):
            near = dog[:, a : a + s, BORDER - 1 + b : BORDER - 1 + b + h, BORDER - 1 + c : BORDER - 1 + c + w]
            np.maximum(top, near, out=top)
            np.minimum(low, near, out=low)
    strong = np.abs(inner) > 0.5 * CONTRAST / SCALES
    found = strong & (((inner > 0) & (inner > top)) | ((inner < 0) & (inner < low)))
    return np.argwhere(found) + [0, 1, BORDER, BORDER]


def refined(dog: np.ndarray, at: np.ndarray, rounds: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Extrema moved to the top of a parabola through their neighbours: (places, offsets, values) of those that stay, without
    weak ones and those along edges."""
    at, alive = at.copy(), np.ones(len(at), bool)
    settled, offset, value, flat = np.zeros(len(at), bool), np.zeros((len(at), 3)), np.zeros(len(at)), np.zeros(len(at), bool)
    limits = np.array(dog.shape[1:])
    for _ in range(rounds):
        n = np.nonzero(alive & ~settled)[0]
        if not len(n):
            break
        image, s, y, x = at[n].T
        d = lambda a, b, c: dog[image, s + a, y + b, x + c]  # noqa: B023, E731
        mid = d(0, 0, 0)
        g = np.stack([d(1, 0, 0) - d(-1, 0, 0), d(0, 1, 0) - d(0, -1, 0), d(0, 0, 1) - d(0, 0, -1)], axis=1) / 2
        ss, yy, xx = d(1, 0, 0) + d(-1, 0, 0) - 2 * mid, d(0, 1, 0) + d(0, -1, 0) - 2 * mid, d(0, 0, 1) + d(0, 0, -1) - 2 * mid
        sy = (d(1, 1, 0) - d(1, -1, 0) - d(-1, 1, 0) + d(-1, -1, 0)) / 4
        sx = (d(1, 0, 1) - d(1, 0, -1) - d(-1, 0, 1) + d(-1, 0, -1)) / 4
        yx = (d(0, 1, 1) - d(0, 1, -1) - d(0, -1, 1) + d(0, -1, -1)) / 4
        hessian = np.stack([np.stack([ss, sy, sx], 1), np.stack([sy, yy, yx], 1), np.stack([sx, yx, xx], 1)], axis=1)
        singular = np.abs(np.linalg.det(hessian)) < 1e-18
        move = -np.linalg.solve(hessian + singular[:, None, None] * np.eye(3), g[:, :, None])[:, :, 0]
        move[singular] = 9
        near = (np.abs(move) < 0.5).all(axis=1)
        done = n[near]
        settled[done], offset[done] = True, move[near]
        value[done] = (mid + 0.5 * (g * move).sum(axis=1))[near]
        det = yy * xx - yx**2
        flat[done] = ((det > 0) & ((yy + xx) ** 2 * EDGE < (EDGE + 1) ** 2 * det))[near]
        far = ~near
        at[n[far], 1:] += np.rint(np.clip(move[far], -2, 2)).astype(int)
        inside = ((at[n, 1:] >= [1, BORDER, BORDER]) & (at[n, 1:] < limits - [1, BORDER, BORDER])).all(axis=1)
        alive[n[~inside]] = False
    keep = alive & settled & flat & (np.abs(value) * SCALES >= CONTRAST)
    return at[keep], offset[keep], value[keep]


def _gradients(images: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = np.pad(images, [(0, 0)] * (images.ndim - 2) + [(1, 1)] * 2, mode="edge")
    dx, dy = p[..., 1:-1, 2:] - p[..., 1:-1, :-2], p[..., 2:, 1:-1] - p[..., :-2, 1:-1]
    return np.hypot(dx, dy), np.arctan2(dy, dx)


def _windows(shape: tuple[int, int], y: np.ndarray, x: np.ndarray, radius: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """The pixels around points, some points at a time: which points, and for each pixel its point's number among them, y and x."""
    low = [np.maximum(0, np.rint(v).astype(int) - radius) for v in (y, x)]
    high = [np.minimum(n, np.rint(v).astype(int) + radius + 1) for n, v in zip(shape, (y, x), strict=True)]
    h, w = (np.maximum(0, b - a) for a, b in zip(low, high, strict=True))
    ends = np.cumsum(h * w)
    start = 0
    while start < len(ends):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + AROUND)))
        some = slice(start, stop)
        n = (h * w)[some]
        point = np.repeat(np.arange(stop - start), n)
        own = np.arange(len(point)) - np.repeat(np.cumsum(n) - n, n)
        row, col = np.divmod(own, w[some][point])
        yield some, point, low[0][some][point] + row, low[1][some][point] + col
        start = stop


def orientations(size: np.ndarray, angle: np.ndarray, image: np.ndarray, y: np.ndarray, x: np.ndarray, sigma: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directions of the gradients around points of images: the strongest, and others nearly as strong; with the point's number."""
    points, turns = [np.zeros(0, int)], [np.zeros(0)]
    for some, p, ys, xs in _windows(size.shape[1:], y, x, np.rint(4.5 * sigma).astype(int)):
        of, spread = image[some][p], 2 * (1.5 * sigma[some]) ** 2
        weight = size[of, ys, xs] * np.exp(-((ys - y[some][p]) ** 2 + (xs - x[some][p]) ** 2) / spread[p])
        bins = np.rint(angle[of, ys, xs] * DIRECTIONS / (2 * np.pi)).astype(int) % DIRECTIONS
        n = some.stop - some.start
        h = np.bincount(p * DIRECTIONS + bins, weights=weight, minlength=n * DIRECTIONS).reshape(n, DIRECTIONS)
        turned = lambda by: np.roll(h, by, axis=1)  # noqa: B023, E731
        h = (6 * h + 4 * (turned(1) + turned(-1)) + turned(2) + turned(-2)) / 16
        left, right = np.roll(h, 1, axis=1), np.roll(h, -1, axis=1)
        point, peak = np.nonzero((h > left) & (h > right) & (h >= 0.8 * h.max(axis=1)[:, None]))
        a, b, c = left[point, peak], h[point, peak], right[point, peak]
        points.append(some.start + point)
        turns.append((peak + 0.5 * (a - c) / (a - 2 * b + c)) * 2 * np.pi / DIRECTIONS % (2 * np.pi))
    return np.concatenate(points), np.concatenate(turns)


def descriptors(size: np.ndarray, angle: np.ndarray, image: np.ndarray, y: np.ndarray, x: np.ndarray, sigma: np.ndarray, turn: np.ndarray) -> Iterator[np.ndarray | None]:
    """Gradients around points of images in grids that are turned with them, each shared among the neighbouring cells and bins;
    of unit length. None where there are none."""
    width = 3 * sigma
    cos, sin = (np.array([f(t) for t in turn], float) for f in (np.cos, np.sin))
    for some, p, ys, xs in _windows(size.shape[1:], y, x, np.rint(width * np.sqrt(2) * (CELLS + 1) / 2).astype(int)):
        of = lambda values: values[some][p]  # noqa: B023, E731
        dy, dx, c, s, wide, im = ys - of(y), xs - of(x), of(cos), of(sin), of(width), of(image)
        col, row = (c * dx + s * dy) / wide, (c * dy - s * dx) / wide
        keep = np.nonzero((np.abs(row) < CELLS / 2 + 0.5) & (np.abs(col) < CELLS / 2 + 0.5))[0]
        p, col, row, at = p[keep], col[keep], row[keep], (im[keep], ys[keep], xs[keep])
        weight = size[at] * np.exp(-(col**2 + row**2) / (2 * (CELLS / 2) ** 2))
        row, col = row + CELLS / 2 - 0.5, col + CELLS / 2 - 0.5
        inside = (row > -1) & (row < CELLS) & (col > -1) & (col < CELLS)
        bins = (angle[at] - of(turn)) % (2 * np.pi) * BINS / (2 * np.pi)
        p, row, col, bins, weight = p[inside], row[inside], col[inside], bins[inside], weight[inside]
        r, c, b = np.floor(row).astype(int), np.floor(col).astype(int), np.floor(bins).astype(int)
        corner, near = ((p * (CELLS + 2) + r + 1) * (CELLS + 2) + c + 1) * BINS, (b % BINS, (b + 1) % BINS)
        cells, shares = [], []
        for i, wr in ((0, 1 - (row - r)), (1, row - r)):
            by_row = weight * wr
            for j, wc in ((0, 1 - (col - c)), (1, col - c)):
                by_cell, first = by_row * wc, corner + (i * (CELLS + 2) + j) * BINS
                for k, wb in ((0, 1 - (bins - b)), (1, bins - b)):
                    cells.append(first + near[k])
                    shares.append(by_cell * wb)
        n = some.stop - some.start
        grid = np.bincount(np.concatenate(cells), weights=np.concatenate(shares), minlength=n * (CELLS + 2) ** 2 * BINS).reshape(n, CELLS + 2, CELLS + 2, BINS)
        for v in grid[:, 1:-1, 1:-1].reshape(n, -1):
            length = np.linalg.norm(v)
            if length:
                v = np.minimum(v / length, LARGEST)
                yield v / np.linalg.norm(v)
            else:
                yield None


def _found(images: np.ndarray) -> list[list[tuple]]:
    """``keypoints`` of grey images of one size."""
    found: list[list[tuple]] = [[] for _ in images]
    for octave, stack in enumerate(octaves(images.astype(float) / 255)):
        dog = np.diff(stack, axis=1)
        places, offsets, values = refined(dog, extrema(dog))
        if not len(places):
            continue
        # the scales that extrema lie in, one after another
        size, angle = (g.reshape(-1, *g.shape[-2:]) for g in _gradients(stack[:, 1 : SCALES + 1]))
        scale = 2.0**octave / 2
        (image, s, y, x), (ds, dy, dx) = places.T, offsets.T
        sigma = np.array([FIRST_BLUR * 2 ** (v / SCALES) for v in s + ds])
        y, x, layer = y + dy, x + dx, image * SCALES + s - 1
        n, turn = orientations(size, angle, layer, y, x, sigma)
        for i, t, v in zip(n.tolist(), turn, descriptors(size, angle, layer[n], y[n], x[n], sigma[n], turn), strict=True):
            if v is not None:
                found[image[i]].append((float(x[i] * scale), float(y[i] * scale), float(2 * sigma[i] * scale), float(np.degrees(t)), float(abs(values[i])), v.astype(np.float32).tolist()))
    return [[(n, *row) for n, row in enumerate(sorted(each, key=lambda f: (-f[4], f[0], f[1], f[3])))] for each in found]


def keypoints_of(images: list[np.ndarray]) -> list[list[tuple]]:
    """``keypoints`` of each image; those of one size are taken together, so many pixels at a time."""
    greys, found = [grey(bgr) for bgr in images], [[] for _ in images]
    shapes: dict[tuple, list[int]] = {}
    for n, g in enumerate(greys):
        shapes.setdefault(g.shape, []).append(n)
    for (h, w), places in shapes.items():
        step = max(1, PIXELS // max(1, h * w))
        for start in range(0, len(places), step):
            some = places[start : start + step]
            for n, rows in zip(some, _found(np.stack([greys[i] for i in some])), strict=True):
                found[n] = rows
    return found


def keypoints(bgr: np.ndarray) -> list[tuple]:
    """(number, x, y, size, angle in degrees, response, descriptor) of an image, in the image's own pixels."""
    return keypoints_of([bgr])[0]


def with_keypoints(images: DataFrame, key: str = "path") -> DataFrame:
    """key, descriptor (numbered from the strongest), x, y, size, angle, response and clip (128 numbers of unit length) for each
    keypoint of images (height, width, channels, data). Images that can't be read and those without keypoints give none."""
    return _each(images, key, keypoints_of, COLUMNS, together=True)
