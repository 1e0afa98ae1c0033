"""Vectorised words and hashes of byte strings, in numpy."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n at least; kept between calls."""
    if not _POWERS or len(_POWERS[0]) < n:
        up, down = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
        up[:1] = down[:1] = 1
        _POWERS[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _POWERS[0], _POWERS[1]


def prefix_hashes(buf: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] the weighted sum of bytes i to j; see span_hashes."""
    up, _ = powers(len(buf) + 1)
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=out[1:])
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte strings [start, end); equal strings have equal hashes wherever they stand."""
    _, down = powers(len(prefix))
    return mixed((prefix[end] - prefix[start]) * down[start])


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, piece: int = 1 << 20) -> np.ndarray:
    """span_hashes of strings in order that don't overlap, with prefix hashes of a piece of buf at a time."""
    out = np.zeros(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(int(np.searchsorted(start, start[i] + piece)), i + 1)
        at = start[i]
        out[i:j] = span_hashes(prefix_hashes(buf[at : end[j - 1]]), start[i:j] - at, end[i:j] - at)
        i = j
    return out


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k successive values."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(BASE) + words[j : n + j]
    return mixed(out)


def window_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w successive values."""
    if len(h) < w:
        return h[:0]
    out, width = h, 1
    while width * 2 <= w:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    if width < w:
        out = np.minimum(out[: len(h) - w + 1], out[w - width : w - width + len(h) - w + 1])
    return out


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
