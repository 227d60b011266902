"""Words and lines of many texts at a time, as places in one buffer of bytes."""

from __future__ import annotations

import numpy as np

from cardwatch.llm.fragments import PrimeHash

BLANK = np.zeros(256, bool)
BLANK[[*range(9, 14), 32]] = True

_MIX = np.random.default_rng(3).integers(0, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def word_ranges(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of all texts start and stop; ``ends`` has each text's begin and the last end."""
    ink = ~BLANK[raw]
    begins, stops = np.zeros(len(raw) + 1, bool), np.zeros(len(raw) + 1, bool)
    begins[:-1], stops[1:] = ink, ink
    begins[1:-1] &= ~ink[:-1]
    stops[1:-1] &= ~ink[1:]
    at = ends[(ends > 0) & (ends < len(raw))]  # a word ends with its text
    cut = at[ink[at - 1] & ink[at]]
    begins[cut] = stops[cut] = True
    return np.flatnonzero(begins), np.flatnonzero(stops)


def line_ranges(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the lines of all texts start and stop (a newline belongs to none), empty ones too."""
    newline = np.flatnonzero(raw == 10)
    start = np.sort(np.concatenate([ends[:-1], newline + 1]), kind="stable")
    stop = np.sort(np.concatenate([newline, ends[1:]]), kind="stable")
    return start, stop


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` hashes (runs across texts included)."""
    n = max(0, len(hashes) - size + 1)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out += hashes[j:j + n] * _MIX[j]
    return (out ^ (out >> np.uint64(31))) * _MIX[-1]


def inside(first: np.ndarray, size: int, n: int) -> np.ndarray:
    """Of the ``n`` runs of ``size``, those that lie in one text; ``first`` has each text's first word."""
    ok = np.ones(max(0, n), bool)
    for text_end in (first[1:] - size + 1)[first[1:] - size + 1 > -size]:
        ok[max(0, text_end):text_end + size - 1] = False
    return ok


def per_text(first: np.ndarray) -> np.ndarray:
    """The text of each item, from each text's first item and the last end."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def again(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys that occurred before, and of all keys that occur twice or more."""
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    later = order[1:][same]
    return later, np.unique(np.concatenate([later, order[:-1][same]]))


def _alike(raw: np.ndarray, start: np.ndarray, stop: np.ndarray, a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the ranges ``a`` have the bytes of the ranges ``b``, pair by pair; a bounded number of bytes at a time."""
    size = stop[a] - start[a]
    if not np.array_equal(size, stop[b] - start[b]):
        return False
    ends, first = np.cumsum(size), 0
    while first < len(a):
        base = ends[first] - size[first]
        last = max(first + 1, int(np.searchsorted(ends, base + (1 << 20), "right")))
        n = size[first:last]
        step = np.arange(n.sum()) - np.repeat(ends[first:last] - n - base, n)
        if not np.array_equal(raw[np.repeat(start[a[first:last]], n) + step], raw[np.repeat(start[b[first:last]], n) + step]):
            return False
        first = last
    return True


def told_apart(raw: np.ndarray, start: np.ndarray, stop: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Keys of the ranges that are equal only for equal bytes: their hashes, or, should any two clash, numbers."""
    order = np.argsort(hashes, kind="stable")
    same = np.flatnonzero(hashes[order][1:] == hashes[order][:-1])
    if _alike(raw, start, stop, order[same], order[same + 1]):
        return hashes
    whole, seen = raw.tobytes(), {}
    return np.fromiter((seen.setdefault(whole[a:b], len(seen)) for a, b in zip(
        start.tolist(), stop.tolist(), strict=True)), np.uint64, len(start))


def in_text(hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Keys that are equal only for equal hashes of one text."""
    return hashes + text.astype(np.uint64) * _MIX[-2]


__all__ = [
    "BLANK", "PrimeHash", "again", "in_text", "inside", "line_ranges", "per_text", "told_apart", "windows",
    "word_ranges"]
