"""Vectorised winnowing over many texts at once.

A whole Arrow batch of texts becomes one array of code points; k-gram hashes
and window minima are then a handful of numpy passes over that array, and
windows that would cross from one text into the next are masked out.

Guarantee (Schleimer, Wilkerson, Aiken 2003): of every ``window`` consecutive
k-grams of a text the rightmost smallest one is kept, so any two texts with a
common run of ``k + window - 1`` characters keep the same gram inside it.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_POS_BITS = np.uint64(24)
_POS_MASK = np.uint64((1 << 24) - 1)


def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and the offsets where each begins."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64) if texts else np.zeros(0, np.int64)
    return points, np.concatenate([np.zeros(1, np.int64), ends])


def mix(h: np.ndarray) -> np.ndarray:
    """Finalising 64-bit mixer, so that the order of hashes is as good as random."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def gram_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """Hash of points[i:i+k] for each i, by doubling; len(points) - k + 1 values."""
    n = len(points) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        level = mix(points.astype(np.uint64) + _BASE)  # hashes of runs of 1, 2, 4, ... characters
        width, done, total = 1, 0, None
        while True:
            if k & width:
                part = level[done : done + n]
                total = part.copy() if total is None else total * np.uint64(pow(int(_BASE), width, 1 << 64)) + part
                done += width
            width *= 2
            if width > k:
                break
            half = width // 2
            level = level[:-half] * np.uint64(pow(int(_BASE), half, 1 << 64)) + level[half:]
        return mix(total)


def run_hashes(points: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Hash of points[i:j] for each start i and stop j, by differences of running sums; meant for runs of up to some hundred characters."""
    n = len(points)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(n, _BASE), dtype=np.uint64)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(points.astype(np.uint64) + _BASE) * powers, dtype=np.uint64)])
        back = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, np.uint64(pow(int(_BASE), -1, 1 << 64)))]), dtype=np.uint64)
        return mix((sums[stops] - sums[starts]) * back[starts] + mix((stops - starts).astype(np.uint64)))


def window_min(values: np.ndarray, window: int) -> np.ndarray:
    """min(values[i:i+window]) for each i, by doubling."""
    level, width = values, 1
    while width * 2 <= window:
        level = np.minimum(level[:-width], level[width:])
        width *= 2
    rest = window - width
    return np.minimum(level[:-rest], level[rest:]) if rest else level


def winnow(points: np.ndarray, offsets: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the text, start within the text, hash) of every kept gram, in order.

    Texts shorter than k + window - 1 keep nothing: they cannot hold a run of that length.
    """
    need = k + window - 1
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(points) < need:
        return none
    lengths = np.diff(offsets)
    starts = np.repeat(offsets[:-1], lengths)
    h = gram_hashes(points, k)
    at = np.arange(len(points), dtype=np.int64) - starts
    with np.errstate(over="ignore"):
        packed = (h & ~_POS_MASK) | (_POS_MASK - (at[: len(h)].astype(np.uint64) & _POS_MASK))
    lowest = window_min(packed, window)
    inside = at[: len(lowest)] <= np.repeat(lengths, lengths)[: len(lowest)] - need
    first = np.empty(len(lowest), bool)
    first[0] = True
    np.not_equal(lowest[1:], lowest[:-1], out=first[1:])
    first |= at[: len(lowest)] == 0
    s = np.flatnonzero(first & inside)
    if not len(s):
        return none
    # the kept gram lies in window s at the position whose low bits the minimum carries
    low = (_POS_MASK - (lowest[s] & _POS_MASK)).astype(np.int64)
    pos = at[s] + ((low - at[s]) & int(_POS_MASK))
    text = np.searchsorted(offsets, s, side="right") - 1
    return text, pos, h[offsets[text] + pos]
