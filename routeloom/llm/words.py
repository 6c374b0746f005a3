"""Vectorised words and 64-bit fingerprints of many texts at once (numpy, no loop over words)."""

from __future__ import annotations

import numpy as np

U = np.uint64
_rng = np.random.default_rng(0x5EED)
#: A random odd 64-bit number for each byte value.
BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
#: Weights of the words of a window, by place.
PLACE = _rng.integers(0, 1 << 63, 4096, dtype=np.uint64) * U(2) + U(1)
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
BLOCK = 1 << 19

#: Words of op3 and op9: all but space and \t\n\v\f\r.
PLAIN = np.ones(256, bool)
PLAIN[[0x20, *range(0x09, 0x0E)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_up = np.multiply.accumulate(np.concatenate([[U(1)], np.full(BLOCK * 2, _BASE)]))
_down = np.multiply.accumulate(np.concatenate([[U(1)], np.full(BLOCK * 2, _INVERSE)]))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def bounds(data: np.ndarray, offsets: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of each text, and where each text's words start among them."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = letters[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each span [start, end) (spans in order, none across another)."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        s0 = int(starts[i])
        j = int(np.searchsorted(ends, s0 + BLOCK, side="right"))
        if j <= i:  # one word longer than a block
            out[i] = _long(data[s0 : ends[i]])
            i += 1
            continue
        s1 = int(ends[j - 1])
        sums = np.zeros(s1 - s0 + 1, np.uint64)
        np.cumsum(BYTE[data[s0:s1]] * _up[: s1 - s0], out=sums[1:])
        a, b = starts[i:j] - s0, ends[i:j] - s0
        out[i:j] = (sums[b] - sums[a]) * _down[a] + (b - a).astype(np.uint64)
        i = j
    return mix(out)


def _long(data: np.ndarray) -> np.uint64:
    total, power = 0, 1
    for k in range(0, len(data), BLOCK):
        part = data[k : k + BLOCK]
        total += int(np.sum(BYTE[part] * _up[: len(part)], dtype=np.uint64)) * power
        power = power * int(_up[len(part)]) % (1 << 64)
    return U((total + len(data)) % (1 << 64))


def windows(words: np.ndarray, n: int) -> np.ndarray:
    """A fingerprint of each n consecutive numbers."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out += words[k : k + m] * PLACE[k]
    return mix(out)


def minimizers(values: np.ndarray, w: int) -> np.ndarray:
    """For each w consecutive values the place of the smallest, the leftmost of equal ones."""
    n = len(values)
    if n < w:
        return np.zeros(0, np.int64)
    # doubling: the place of the minimum of 1, 2, 4 ... values, then two overlapping spans
    best = np.arange(n, dtype=np.int64)
    span = 1
    while span * 2 <= w:
        left, right = best[: len(best) - span], best[span:]
        best = np.where(values[right] < values[left], right, left)
        span *= 2
    if span < w:
        left, right = best[: n - w + 1], best[w - span : w - span + n - w + 1]
        best = np.where(values[right] < values[left], right, left)
    return best[: n - w + 1]
