"""Words of texts as 64-bit hashes, computed on whole arrays of bytes.

A word is a longest run of ASCII letters, digits and underscores and of characters beyond ASCII, in lower case. Its hash
is a polynomial of its UTF-8 bytes modulo 2**64, mixed; that of n words in a row mixes their hashes with their places.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Bytes hashed at a time.
STEP = 1 << 18
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), 95, *range(128, 256)]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> list[np.ndarray]:
    while len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            now = _powers[i]
            step = np.uint64(pow(int(base), len(now), 1 << 64))
            _powers[i] = np.concatenate([now, now * step])
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit depends on every other (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _parts(data: bytes) -> Iterator[bytes]:
    """Parts of about ``STEP`` bytes that end where a word ends."""
    at = 0
    while len(data) - at > STEP:
        end = at + STEP
        while end < len(data) and _WORD[data[end]]:
            end += 1
        yield data[at:end]
        at = end
    yield data[at:]


def word_hashes(text: str | None) -> np.ndarray:
    if not text:
        return np.empty(0, np.uint64)
    found = []
    for part in _parts(text.lower().encode(errors="surrogatepass")):
        points = np.frombuffer(part, np.uint8)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], _WORD[points], [False]])))
        start, end = edges[::2], edges[1::2]
        if not len(start):
            continue
        power, inverse = _power(len(points) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(points.astype(np.uint64) * power[: len(points)], dtype=np.uint64)])
        found.append(mix((sums[end] - sums[start]) * inverse[start]))
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The hashes of the n-grams of words, in order; none if there are fewer than n words."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    if n == 1:
        return words
    out = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        out += words[i : len(words) - n + 1 + i] * np.uint64(pow(0xD6E8FEB86659FD93, i + 1, 1 << 64))
    return mix(out)
