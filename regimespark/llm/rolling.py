"""Polynomial hashes of byte spans, modulo 2**64, with numpy."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SEGMENT = 1 << 18
_cache: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_cache.get("p", ())) < n:
        size = 1 << max(12, (n - 1).bit_length())
        for name, base in (("p", _BASE), ("i", _INVERSE)):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            _cache[name] = np.cumprod(row, dtype=np.uint64)
    return _cache["p"][:n], _cache["i"][:n]


def prefix(data: np.ndarray) -> np.ndarray:
    """h with h[j] - h[i] the hash of data[i:j] times base**i."""
    p, _ = _powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=out[1:])
    return out


def at(h: np.ndarray, starts, ends) -> np.ndarray:
    _, i = _powers(len(h))
    return (h[ends] - h[starts]) * i[starts]


def windows(data: np.ndarray, width: int) -> np.ndarray:
    """Mixed hashes of all spans of `width` bytes."""
    if len(data) < width:
        return np.zeros(0, np.uint64)
    h = prefix(data)
    _, i = _powers(len(h))
    n = len(data) - width + 1
    return mix((h[width:] - h[:n]) * i[:n])


def spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mixed hashes of data[starts[k]:ends[k]], starts ascending; memory follows the segment, not the text."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(starts, base + _SEGMENT)))
        h = prefix(data[base : int(ends[i:j].max())])
        out[i:j] = at(h, starts[i:j] - base, ends[i:j] - base)
        i = j
    return mix(out ^ mix((ends - starts).astype(np.uint64)))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, by doubling."""
    out, have = x, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(x) - width + 1], out[width - have :]) if have < width else out
