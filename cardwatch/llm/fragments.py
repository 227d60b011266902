"""Token ids of text fragments, many at a time.

A tokenizer that cuts a text at certain places gives each fragment ids of its own, and fragments
repeat. ``FragmentIds`` hashes all fragments of a buffer at once and reads their ids from a table
of fixed size; only fragments that aren't there go through the tokenizers library, each once by its bytes. The
table holds fragments of at most KEPT bytes, found by 64 bits of hash; longer ones are never taken by hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Slots of the table, ids held by it, bytes of a fragment that is kept, bytes hashed at a time.
SLOTS_LOG2, POOL, KEPT, BLOCK = 21, 12_000_000, 64, 1 << 18

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_BYTE = np.random.default_rng(1).integers(1, 2**64, 256, dtype=np.uint64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def chunks(batches: Iterator[pa.RecordBatch], text: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts come to about ``most`` bytes, one row at least."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch[text]), 0).to_numpy(zero_copy_only=False))
        first = 0
        while first < batch.num_rows:
            base = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, base + most)))
            yield batch.slice(first, last - first)
            first = last


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column in a row, and where each begins and the last ends."""
    texts = column.cast(pa.large_string()).combine_chunks() if isinstance(column, pa.ChunkedArray) \
        else column.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0]:ends[-1]], ends - ends[0]


class RangeHash:
    """64-bit hashes of ranges of a buffer: equal bytes give equal hashes, wherever they stand.

    The sums are modulo 2^64, for which long different texts with equal hashes can be written down (``PrimeHash``
    has none such); this is for short ranges, and for places where a clash only costs work or a feature.
    """

    def __init__(self, size: int = BLOCK):
        self.grow(size)

    def grow(self, size: int) -> None:
        self.power = powers(int(_STEP), size)
        self.inverse = powers(pow(int(_STEP), -1, 2**64), size)

    def __call__(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if len(raw) > len(self.power):
            self.grow(len(raw))
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[raw] * self.power[:len(raw)], out=total[1:])
        # A range that begins at the end of the buffer is empty, whatever its power.
        h = (total[end] - total[start]) * self.inverse[np.minimum(start, len(self.inverse) - 1)]
        h = (h ^ (h >> np.uint64(29))) * _MIX + (end - start).astype(np.uint64) * _STEP
        return h ^ (h >> np.uint64(32))


_PRIME, _BITS = (1 << 31) - 1, np.uint64(31)
_BASES = (0x2545F491, 0x5851F42D)


def _prime_powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers of ``base`` modulo the prime, at most twice as long a run at a time."""
    out, have = np.ones(max(n, 1), np.uint64), 1
    while have < n:
        more = min(have, n - have)
        out[have:have + more] = out[:more] * np.uint64(pow(base, have, _PRIME)) % np.uint64(_PRIME)
        have += more
    return out


def _residue(x: np.ndarray) -> np.ndarray:
    """``x`` modulo the prime 2^31 - 1, by adding up its digits of 31 bits."""
    for _ in range(3):
        x = (x & np.uint64(_PRIME)) + (x >> _BITS)
    return np.where(x == _PRIME, np.uint64(0), x)


class PrimeHash:
    """Hashes of ranges like ``RangeHash``, from two sums over powers of two bases modulo a prime of 31 bits.

    Two different ranges of L bytes agree for at most L of the 2^31 choices of either base, so with a chance of
    at most (L / 2^31)^2; the bases are fixed, as tasks have to agree, and know nothing of the texts.
    """

    #: Bytes whose products with powers can be added up in 64 bits.
    SAFE = 1 << 24

    def __init__(self, size: int = BLOCK):
        self.grow(size)

    def grow(self, size: int) -> None:
        self.power = [_prime_powers(b, size) for b in _BASES]
        self.inverse = [_prime_powers(pow(b, -1, _PRIME), size).astype(np.uint32) for b in _BASES]

    def __call__(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if len(raw) > len(self.power[0]):
            self.grow(len(raw))
        value = raw.astype(np.uint64) + np.uint64(1)
        first = np.minimum(start, len(self.inverse[0]) - 1)
        h = np.zeros(len(start), np.uint64)
        for power, inverse in zip(self.power, self.inverse, strict=True):
            terms = value * power[:len(raw)]
            total = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum(terms if len(raw) <= self.SAFE else _residue(terms), out=total[1:])
            part = _residue(_residue(total[end] - total[start]) * inverse[first].astype(np.uint64))
            h = h << _BITS | part
        h = (h ^ (h >> np.uint64(29))) * _MIX + (end - start).astype(np.uint64) * _STEP
        return h ^ (h >> np.uint64(32))


class FragmentIds:
    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]]):
        self.encode = encode
        self.hashes = RangeHash()
        self.clear()

    def clear(self) -> None:
        n = 1 << SLOTS_LOG2
        self.key, self.at = np.zeros(n, np.uint64), np.zeros(n, np.int32)
        self.count = np.zeros(n, np.int32)
        self.pool, self.held = np.zeros(1 << 16, np.uint32), 0

    def ids(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all fragments (each not empty) one after the other, and how many each has."""
        flat, counts, first = [], [], 0
        while first < len(start):
            last = max(first + 1, int(np.searchsorted(end, start[first] + BLOCK, "right")))
            a, b = start[first], end[last - 1]
            x, n = self._block(raw[a:b], start[first:last] - a, end[first:last] - a)
            flat.append(x)
            counts.append(n)
            first = last
        if not flat:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        return np.concatenate(flat), np.concatenate(counts)

    def _add(self, fresh: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Append the ids to the pool; where each begins, and how many it has."""
        n = np.fromiter(map(len, fresh), np.int64, len(fresh))
        size = int(n.sum())
        if self.held + size > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(size, len(self.pool)), np.uint32)])
        self.pool[self.held:self.held + size] = np.fromiter((i for x in fresh for i in x), np.uint32, size)
        at = self.held + np.cumsum(n) - n
        self.held += size
        return at, n

    def _block(self, raw, start, end):
        if self.held > POOL:
            self.clear()
        h = self.hashes(raw, start, end)
        slot = (h >> np.uint64(64 - SLOTS_LOG2)).astype(np.int64)
        at, n = self.at[slot].astype(np.int64), self.count[slot].astype(np.int64)
        miss = np.flatnonzero(self.key[slot] != h)
        if len(miss):
            # What isn't in the table is told apart by its bytes: hashes of long texts can be made to collide.
            whole, texts = raw.tobytes(), {}
            inverse = np.fromiter((texts.setdefault(whole[a:b], len(texts)) for a, b in zip(
                start[miss].tolist(), end[miss].tolist(), strict=True)), np.int64, len(miss))
            pick = np.empty(len(texts), np.int64)
            pick[inverse[::-1]] = miss[::-1]
            new_at, new_n = self._add(self.encode(list(texts)))
            at[miss], n[miss] = new_at[inverse], new_n[inverse]
            short = end[pick] - start[pick] <= KEPT
            s = slot[pick][short]
            self.key[s], self.at[s], self.count[s] = h[pick][short], new_at[short], new_n[short]
            # Of fragments that share a slot the last one written stays, in all three arrays.
        ends = np.cumsum(n)
        take = np.arange(ends[-1]) + np.repeat(at - ends + n, n)
        return self.pool[take], n
