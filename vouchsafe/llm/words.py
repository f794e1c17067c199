"""Words of many texts at once: spans and hashes from numpy, without a Python object a word.

A word is a run of digits, letters a-z and non-ASCII characters after A-Z are lower-cased.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_SEED = 0x5EED_0F_3A11
_random = np.random.Generator(np.random.PCG64(_SEED))
#: A random number for each byte value, and odd multipliers for places in a gram.
BYTE_CODE = _random.integers(0, 1 << 64, 256, dtype=np.uint64)
PLACE_CODE = _random.integers(0, 1 << 64, 64, dtype=np.uint64) | np.uint64(1)
_BASE = int(_random.integers(0, 1 << 63)) * 2 + 1
BLOCK = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base % (1 << 64)))
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for at least ``n`` places."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        _POWERS[:] = [_powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)]
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values (a bijection)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


@dataclass
class Words:
    """All words of a batch, in order. ``bounds[d]:bounds[d + 1]`` are those of text d."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray
    data: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def text(self, first: int, last: int) -> bytes:
        """Words first..last-1, joined by blanks."""
        spans = zip(self.starts[first:last].tolist(), self.ends[first:last].tolist())
        return b" ".join(self.data[s:e].tobytes() for s, e in spans)


def find_words(data: np.ndarray, offsets: np.ndarray, lower: bool = True, table=IS_WORD) -> Words:
    if lower:
        data = LOWER[data]
    inside = table[data]
    before = np.empty(len(data) + 1, bool)
    before[0] = False
    before[1:] = inside
    edge = offsets[(offsets < len(data))]
    before[edge] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    after = np.empty(len(data), bool)
    if len(data):
        after[:-1] = inside[1:]
        after[-1] = False
        cut = offsets[(offsets > 0)] - 1
        after[cut] = False
    ends = np.flatnonzero(inside & ~after) + 1
    bounds = np.searchsorted(starts, offsets)
    return Words(starts, ends, hash_spans(data, starts, ends), bounds, data)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, from running sums over blocks of the data."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        low = int(starts[i])
        j = int(np.searchsorted(ends, low + BLOCK, "right"))
        j = max(j, i + 1)
        high = int(ends[j - 1])
        up, down = _tables(high - low + 1)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(BYTE_CODE[data[low:high]] * up[: high - low], out=sums[1:])
        s, e = starts[i:j] - low, ends[i:j] - low
        out[i:j] = (sums[e] - sums[s]) * down[s]
        i = j
    return mix(out)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive words, one for each start; those that cross texts are included."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n] * PLACE_CODE[0]
    for j in range(1, k):
        out += hashes[j : n + j] * PLACE_CODE[j]
    return mix(out ^ np.uint64(k))


def gram_texts(bounds: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of the ``n`` grams lie within one text: a mask."""
    inside = np.ones(n, bool)
    for back in range(1, k):
        at = bounds[1:-1] - back
        inside[at[(at >= 0) & (at < n)]] = False
    # an empty text repeats a bound, and a text shorter than k only loses its own starts
    return inside


def text_numbers(bounds: np.ndarray) -> np.ndarray:
    """The text number of each word."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
