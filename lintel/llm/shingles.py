"""64-bit hashes of a text's words and word n-grams, vectorised over its bytes."""

from __future__ import annotations

import numpy as np

SLICE = 1 << 20      # bytes handled at a time, cut at white space
_RND = np.random.default_rng(20240229)
_VALUE = _RND.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = int(_RND.integers(1 << 40, 1 << 62)) | 5
_POWER: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base, and of its inverse, modulo 2**64."""
    if len(_POWER["up"]) < n:
        size = 1 << (n - 1).bit_length()
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _POWER[name] = np.cumprod(out, dtype=np.uint64)
    return _POWER["up"][:n], _POWER["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes) -> np.ndarray:
    """A hash of each run of bytes other than the six ASCII blanks, A-Z folded."""
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + SLICE)
        while end < len(data) and not _BLANK[data[end]]:
            end += 1
        b = _FOLD[np.frombuffer(data, np.uint8, end - at, at)]
        blank = _BLANK[b]
        edge = np.flatnonzero(np.diff(blank.astype(np.int8), prepend=1, append=1))
        start, stop = edge[::2], edge[1::2]
        up, down = _powers(len(b) + 1)
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_VALUE[b] * up[:-1], out=total[1:])
        h = (total[stop] - total[start]) * down[start]
        out.append(mix(h + (stop - start).astype(np.uint64)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def range_sums(b: np.ndarray) -> np.ndarray:
    """Running sums of bytes, from which :func:`sum_hashes` tells any range's hash."""
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_VALUE[b] * _powers(len(b) + 1)[0][:-1], out=total[1:])
    return total


def sum_hashes(total: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A hash of each range of bytes."""
    down = _powers(len(total))[1]
    return mix((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64))


def range_hashes(b: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A hash of each range of bytes."""
    return sum_hashes(range_sums(b), start, stop)


def shingle_hashes(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the text's ``n``-word shingles (all words as one if fewer)."""
    h = word_hashes((text or "").encode("utf-8", "surrogatepass"))
    k = min(n, len(h))
    if not k:
        return h
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i:len(h) - k + 1 + i]
    return np.unique(mix(out + np.uint64(k)))
