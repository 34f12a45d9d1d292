"""Words of many texts at once, in numpy. A word is a run of bytes outside x20 and x09 - x0D, so ``bytes.split``'s word."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

U = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_random = np.random.default_rng(20240229)
BYTE_VALUES = _random.integers(1, 2**63, 256, dtype=np.uint64) | U(1)
#: Bytes hashed at a time, and powers that a worker keeps.
CHUNK, KEPT_POWERS = 1 << 17, 1 << 18
BASE, WORD_BASE = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)


def inverse(odd: np.uint64) -> np.uint64:
    return U(pow(int(odd), -1, 1 << 64))


class Powers:
    """Powers of an odd number and of its inverse modulo 2^64, as far as asked for; at most ``KEPT_POWERS`` of them stay in memory."""

    def __init__(self, base: np.uint64) -> None:
        self.base, self.up, self.down = base, np.ones(1, U), np.ones(1, U)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) >= n:
            return self.up[:n], self.down[:n]
        size = max(n, 1 << 16)
        up, down = (np.cumprod(np.concatenate([[U(1)], np.full(size - 1, b, U)])) for b in (self.base, inverse(self.base)))
        if size <= KEPT_POWERS:
            self.up, self.down = up, down
        return up[:n], down[:n]


BYTE_POWERS, WORD_POWERS = Powers(BASE), Powers(WORD_BASE)


def mixed(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes, so that every bit depends on all."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def compact(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, begins): words of all texts joined by single spaces, and where each text's words begin."""
    joined = [b" ".join(t.split()) for t in texts]
    lengths = np.array([len(x) for x in joined], np.int64)
    data = np.frombuffer(b" ".join(joined), np.uint8)
    at = np.concatenate([[0], np.cumsum(lengths + 1)])
    space = data == 32
    blank = np.ones(len(data) + 2, bool)
    blank[1:-1] = space
    starts = np.flatnonzero(~space & blank[:-2])
    ends = np.flatnonzero(~space & blank[2:]) + 1
    return data, starts, ends, np.searchsorted(starts, at).astype(np.int64)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = BYTE_VALUES) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over its bytes' random values."""
    return mixed(polynomials(lambda low, high: values[data[low:high]], len(data), starts, ends))


def polynomials(value: Callable[[int, int], np.ndarray], n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The polynomial of each of some disjoint ascending ranges of n values, ``CHUNK`` values at a time, so that memory doesn't follow n."""
    out = np.zeros(len(starts), U)
    up, down = BYTE_POWERS.to(CHUNK + 1)
    with np.errstate(over="ignore"):
        for low in range(0, n, CHUNK):
            own = value(low, min(low + CHUNK, n))
            first, last = int(np.searchsorted(ends, low, side="right")), int(np.searchsorted(starts, low + len(own)))
            if first >= last:
                continue
            a, b = np.maximum(starts[first:last] - low, 0), np.minimum(ends[first:last] - low, len(own))
            sums = np.concatenate([[U(0)], np.cumsum(own * up[: len(own)], dtype=U)])
            part = (sums[b] - sums[a]) * down[a]
            if starts[first] < low:  # the rest of a range that began before
                part[0] *= U(pow(int(BASE), int(low - starts[first]), 1 << 64))
            out[first:last] += part
    return out


def run_hashes(word_hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each run of words [start, end)."""
    up, down = WORD_POWERS.to(len(word_hashes) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([[U(0)], np.cumsum(word_hashes * up[: len(word_hashes)], dtype=U)])
        return mixed((sums[ends] - sums[starts]) * down[starts])


def window_starts(begins: np.ndarray, width: int) -> np.ndarray:
    """Starts of all runs of ``width`` words that lie within one text."""
    n = np.maximum(np.diff(begins) - width + 1, 0)
    return np.arange(n.sum()) + np.repeat(begins[:-1] - (np.cumsum(n) - n), n)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    out, span = x, 1
    while span < width:
        step = min(span, width - span)
        out = np.minimum(out[: len(out) - step], out[step:])
        span += step
    return out


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, .. for lengths[0] values, then the same for the next."""
    return np.arange(lengths.sum()) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
