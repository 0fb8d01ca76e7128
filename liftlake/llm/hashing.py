"""Vectorised hashing of words and byte strings inside a task.

All hashes are polynomials modulo 2**64 over a fixed random table, taken as
differences of prefix sums and finished with a multiply-xorshift mix.
"""

from __future__ import annotations

import functools

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
# A word is a run of bytes other than space and 0x09-0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


@functools.lru_cache(maxsize=None)
def _table(fold_case: bool) -> np.ndarray:
    table = np.random.Generator(np.random.PCG64(20260101)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    if fold_case:
        table[ord("A") : ord("Z") + 1] = table[ord("a") : ord("z") + 1]
    return table


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            p = np.full(size, base & _MASK, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[s:e] for each span."""
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def gram_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive values."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[k:] - total[:n]) * down[:n])


def byte_values(raw: np.ndarray, fold_case: bool = False) -> np.ndarray:
    return _table(fold_case)[raw]


def words(raw: np.ndarray, bounds: np.ndarray, fold_case: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a run of texts, and the word bounds of each text:
    text i has the words [out[i], out[i + 1])."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    inside = ~SPACE[raw]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    cuts = bounds[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    begin[cuts] = inside[cuts]
    close = inside.copy()
    close[:-1] &= ~inside[1:]
    close[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(begin)
    ends = np.flatnonzero(close) + 1
    hashes = span_hashes(byte_values(raw, fold_case), starts, ends)
    return hashes, np.searchsorted(starts, bounds)


def window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive keys, by doubling."""
    n = len(keys) - width + 1
    if n <= 0:
        return keys[:0]
    cur, have = keys, 1
    while have * 2 <= width:
        cur = np.minimum(cur[:-have], cur[have:])
        have *= 2
    return np.minimum(cur[:n], cur[width - have : width - have + n]) if have < width else cur[:n]
