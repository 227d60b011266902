"""Periodic runs of words by internal pattern matching.

A run is a longest stretch of words with smallest period q, at least ``LEAST`` words and ``TIMES`` periods
long. Dyadic blocks find them: for every k the blocks of 2^k words, at every half block, ask where their
words occur next within 2^k words, that is in their own dyadic window or the neighbouring one. In a run of
period q, with 2^k the least power of two not below q, some block lies a period and its own length before
the run's end, and its next occurrence is exactly q on: an earlier one would give the run a smaller period
(theorem of Fine and Wilf). So the distances in (2^(k-1), 2^k] are all candidate periods there are; successive
blocks of equal distance form a progression, whose ends are extended word by word.

The question is answered by a suffix array of the words and a wavelet matrix over its positions: the block's
occurrences are a range of the suffix array, a window is a node of the matrix, and the next occurrence is the
range's successor there. The matrix holds places within documents, so its depth is that of the longest one
of a batch; documents are batched by length. Memory grows with the longest document, some 150 bytes a word.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from cardwatch.llm.common import in_batches, quoted, text_of

#: A run has this many words and this many periods at least.
LEAST, TIMES = 6, 4
#: Words of a batch of documents; a longer document is a batch of its own.
BATCH_WORDS = 1 << 20

RUN = StructType([StructField("start", LongType()), StructField("length", LongType()),
                  StructField("period", LongType())])


class SuffixRanges:
    """Suffixes of many word lists in order, and for each block of 2^k words its range of that order.

    Suffixes are sorted by list first, so that a range never leaves its list. Ranks double their length round
    by round; only suffixes that share their rank with others are sorted again.
    """

    def __init__(self, words: np.ndarray, first: np.ndarray):
        n, sizes = len(words), np.diff(first)
        self.list_end = np.repeat(first[1:], sizes)
        key = np.repeat(np.arange(len(sizes)), sizes) * (int(words.max(initial=0)) + 1) + words
        self.order = np.argsort(key, kind="stable")
        self.rank = np.empty(n, np.int64)
        self.size = np.empty(n, np.int64)
        self._group(self.order, key[self.order], np.arange(n))

    def _group(self, order: np.ndarray, key: np.ndarray, place: np.ndarray) -> None:
        """Ranks of suffixes sorted by ``key`` at ``place``: the place of the first with an equal key."""
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[:len(key)])
        sizes = np.diff(np.append(starts, len(key)))
        self.rank[order] = np.repeat(place[starts], sizes)
        self.size[order] = np.repeat(sizes, sizes)

    def double(self, width: int) -> None:
        """From ranks by ``width`` words to ranks by twice as many."""
        place = np.flatnonzero(self.size[self.order] > 1)
        if not len(place):
            return
        open_ = self.order[place]
        ahead = open_ + width
        inside = ahead < self.list_end[open_]
        follow = np.zeros(len(open_), np.int64)
        follow[inside] = self.rank[ahead[inside]] + 1
        key = self.rank[open_] * (len(self.order) + 1) + follow
        by = np.argsort(key, kind="stable")
        self.order[place] = open_[by]
        self._group(open_[by], key[by], place)


class PlaceMatrix:
    """A wavelet matrix over places: the least place not below a bound, in a range, for many ranges at once."""

    def __init__(self, places: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        now = places
        for k in range(bits - 1, -1, -1):
            one = (now >> k & 1).astype(bool)
            count = np.zeros(len(now) + 1, np.int32)
            np.cumsum(one, out=count[1:])
            self.ones.append(count)
            self.zeros.append(len(now) - int(count[-1]))
            now = np.concatenate([now[~one], now[one]])

    def window(self, lo: np.ndarray, hi: np.ndarray, place: np.ndarray, k: int, least: int):
        """The part of each range in the window of 2^k places around ``place``: ranges with at least ``least``
        entries there, by their number, and their bounds in the window's node."""
        live = np.arange(len(lo))
        for level in range(self.bits - k):
            ones = self.ones[level]
            a, b = ones[lo], ones[hi]
            right = (place >> (self.bits - 1 - level) & 1).astype(bool)
            lo = np.where(right, self.zeros[level] + a, lo - a)
            hi = np.where(right, self.zeros[level] + b, hi - b)
            some = hi - lo >= least
            if not some.all():
                live, lo, hi, place = live[some], lo[some], hi[some], place[some]
        return live, lo, hi

    def below(self, lo: np.ndarray, hi: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
        """How many entries of a node's range lie below ``place`` (of the node's window of 2^k places)."""
        count = np.zeros(len(lo), np.int64)
        for level in range(self.bits - k, self.bits):
            ones = self.ones[level]
            a, b = ones[lo], ones[hi]
            right = (place >> (self.bits - 1 - level) & 1).astype(bool)
            count += np.where(right, (hi - b) - (lo - a), 0)
            lo = np.where(right, self.zeros[level] + a, lo - a)
            hi = np.where(right, self.zeros[level] + b, hi - b)
        return count

    def nth(self, lo: np.ndarray, hi: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
        """The ``n``-th place (from 0) of a node's range, as an offset in the node's window."""
        out = np.zeros(len(lo), np.int64)
        n = n.copy()
        for level in range(self.bits - k, self.bits):
            ones = self.ones[level]
            a, b = ones[lo], ones[hi]
            left = (hi - b) - (lo - a)
            right = n >= left
            out = out << 1 | right
            n -= np.where(right, left, 0)
            lo = np.where(right, self.zeros[level] + a, lo - a)
            hi = np.where(right, self.zeros[level] + b, hi - b)
        return out

    def successor(self, lo: np.ndarray, hi: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
        """For each range that holds ``place``: its next place, at most 2^k on; -1 if there is none.

        The next place is in the window of 2^k places that holds ``place``, or else in the one behind.
        """
        out = np.full(len(lo), -1, np.int64)
        live, a, b = self.window(lo, hi, place, k, 2)
        before = self.below(a, b, place[live], k) + 1  # with the place itself
        found = before < b - a
        live, a, b, before = live[found], a[found], b[found], before[found]
        out[live] = (place[live] >> k << k) + self.nth(a, b, before, k)
        rest = np.flatnonzero((out < 0) & ((place >> k) + 1 < 1 << (self.bits - k)))
        behind = ((place[rest] >> k) + 1) << k
        live, a, b = self.window(lo[rest], hi[rest], behind, k, 1)
        after = behind[live] + self.nth(a, b, np.zeros(len(live), np.int64), k)
        near = after - place[rest[live]] <= 1 << k
        out[rest[live[near]]] = after[near]
        return out


def candidates(words: np.ndarray, first: np.ndarray, times: int = TIMES):
    """(start, period, end) of stretches that have a period, by the blocks; see the module's text."""
    sizes = np.diff(first)
    longest = int(sizes.max(initial=0))
    bits = max(1, int(longest - 1).bit_length())
    local = np.arange(len(words)) - np.repeat(first[:-1], sizes)
    ranges, asked, k = SuffixRanges(words, first), [], 0
    while 1 << k <= bits_limit(longest, times) and k <= bits:
        step = max(1, 1 << k - 1) if k else 1
        ask = np.flatnonzero((ranges.size > 1) & (local % step == 0))
        if len(ask):
            lo = ranges.rank[ask]
            asked.append((k, ask, lo, lo + ranges.size[ask]))
        elif not (ranges.size > 1).any():
            break
        ranges.double(1 << k)
        k += 1
    matrix = PlaceMatrix(local[ranges.order], bits)
    out = []
    for k, ask, lo, hi in asked:
        period = matrix.successor(lo, hi, local[ask], k) - local[ask]
        good = period > (1 << k >> 1)
        at, period = ask[good], period[good]
        out.append(np.stack([at, period, at + period + (1 << k)]))
    return np.concatenate(out, axis=1) if out else np.zeros((3, 0), np.int64)


def bits_limit(longest: int, times: int) -> int:
    """Blocks longer than this belong to periods too long for a run of ``times`` periods."""
    return max(1, 2 * (longest // times))


def joined_stretches(found: np.ndarray) -> np.ndarray:
    """Stretches of one period that overlap by a period or more, as one."""
    at, period, end = found[:, np.lexsort((found[0], found[1]))]
    if not len(at):
        return found
    reach = np.maximum.accumulate(end + period * (int(end.max()) + 1)) - period * (int(end.max()) + 1)
    fresh = np.concatenate([[True], (period[1:] != period[:-1]) | (reach[:-1] - at[1:] < period[1:])])
    head = np.flatnonzero(fresh)
    return np.stack([at[head], period[head], np.maximum.reduceat(end, head)])


def _extent(words: np.ndarray, a: int, b: int, most: int, step: int) -> int:
    """How many words from ``a`` and ``b`` on are equal, at most ``most``; ``step`` is 1 or -1."""
    done, size = 0, 16
    while done < most:
        size = min(size, most - done)
        i, j = a + step * done, b + step * done
        if step > 0:
            differ = words[i:i + size] != words[j:j + size]
        else:
            differ = words[i - size + 1:i + 1][::-1] != words[j - size + 1:j + 1][::-1]
        if differ.any():
            return done + int(differ.argmax())
        done, size = done + size, size * 4
    return done


def find_runs(words: np.ndarray, first: np.ndarray, least: int = LEAST, times: int = TIMES) -> dict[int, list]:
    """The runs of many word lists, held one after the other from ``first``: list -> [(start, length, period)]."""
    out: dict[int, set] = defaultdict(set)
    if not len(words):
        return out
    at, period, end = joined_stretches(candidates(words, first, times))
    which = np.searchsorted(first, at, "right") - 1
    begin, stop = first[which], first[which + 1]
    more = (end < stop) & (words[np.minimum(end, len(words) - 1)] == words[np.minimum(end, len(words) - 1) - period])
    less = (at > begin) & (words[at - 1] == words[np.minimum(at - 1 + period, len(words) - 1)])
    hopeful = more | less | (end - at >= np.maximum(least, times * period))
    for a, q, e, d, b, s in zip(*(x[hopeful].tolist() for x in (at, period, end, which, begin, stop)), strict=True):
        e += _extent(words, e, e - q, s - e, 1)
        a -= _extent(words, a - 1, a - 1 + q, a - b, -1)
        if e - a >= max(least, times * q):
            out[d].add((a - b, e - a, q))
    return {d: sorted(r, key=lambda x: (x[0], x[2])) for d, r in out.items()}


def collapsed(words: list, runs: list) -> list:
    """The words without those that lie in a run behind its first period."""
    gone = np.zeros(len(words), bool)
    for start, length, period in runs:
        gone[start + period:start + length] = True
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if runs else words


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  rewrite: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """Each row's id, its number of words, all runs by start and period, and the text without repeats.

    ``rewrite`` may change a row's words first, given its id. Null text counts as empty: no words, no runs, an
    empty text. Rows are judged one by one, so repeated rows and missing ids need no care; further columns are
    not read; an empty table gives no rows. No length is too long, but a row is worked on in one task.
    """
    slim = docs.select(quoted(id_col).alias("id"), text_of(text_col).alias("text"))
    schema = StructType([StructField("id", slim.schema["id"].dataType), StructField("n_words", LongType()),
                         StructField("runs", ArrayType(RUN)), StructField("collapsed", StringType())])
    struct = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def report(ids: list, texts: list[list[bytes]], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        runs: dict[int, list] = {}
        sizes = np.array([len(t) for t in texts], np.int64)
        for depth in range(3, int(sizes.max(initial=0)).bit_length() + 1):
            part = np.flatnonzero((sizes >= max(LEAST, 1 << depth - 1)) & (sizes < 1 << depth))
            if not len(part):
                continue
            numbers: defaultdict = defaultdict()
            numbers.default_factory = numbers.__len__
            flat = np.fromiter((numbers[w] for k in part for w in texts[k]), np.int64, int(sizes[part].sum()))
            found = find_runs(flat, np.concatenate([[0], np.cumsum(sizes[part])]))
            runs |= {int(part[d]): r for d, r in found.items()}
        last = 0
        while last < len(ids):  # rows of some 4 MB
            first, size = last, 0
            while last < len(ids) and (size < 4 << 20 or last == first):
                size += sum(map(len, texts[last])) + len(texts[last])
                last += 1
            rows = range(first, last)
            yield pa.RecordBatch.from_arrays([
                pa.array(ids[first:last], kind), pa.array(sizes[first:last]),
                pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in runs.get(k, ())]
                          for k in rows], pa.list_(struct)),
                pa.array([b" ".join(collapsed(texts[k], runs.get(k, ()))) for k in rows], pa.binary()).cast(pa.string()),
            ], ["id", "n_words", "runs", "collapsed"])

    def run(batches):
        ids, texts, held, kind = [], [], 0, pa.null()
        for batch in batches:
            kind = batch["id"].type
            for key, text in zip(batch["id"].to_pylist(), batch["text"], strict=True):
                words = text.as_buffer().to_pybytes().split()
                ids.append(key)
                texts.append(rewrite(key, words) if rewrite else words)
                held += len(texts[-1])
                if held >= BATCH_WORDS:
                    yield from report(ids, texts, kind)
                    ids, texts, held = [], [], 0
        if ids:
            yield from report(ids, texts, kind)

    return in_batches(slim, run, schema)


def plant(key, words: list[bytes]) -> list[bytes]:
    """The contract's repeats: in one of ten documents, by its id's checksum, the words from one place on
    repeat a stretch. A row without an id stays as it is."""
    h, n = zlib.crc32(str(key).encode()), len(words)
    if key is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    period = words[a:a + p]
    return words[:a] + (period * (-(-(n - a) // p)))[:n - a]


def run_report(docs: DataFrame) -> DataFrame:
    """Runs of ``documents`` with planted repeats, as digests and the run with most periods; see
    :func:`periodic_runs` for nulls, repeats and empty tables."""
    found = periodic_runs(docs, rewrite=plant)
    # Most periods first: two fractions compare by cross products, then the smaller start, then the period.
    ahead = ("(a, b) -> CASE WHEN CAST(a.length AS DECIMAL(19,0)) * b.period > CAST(b.length AS DECIMAL(19,0)) * a.period"
             " OR (CAST(a.length AS DECIMAL(19,0)) * b.period = CAST(b.length AS DECIMAL(19,0)) * a.period"
             " AND (a.start < b.start OR (a.start = b.start AND a.period < b.period))) THEN -1 ELSE 1 END")
    line = "x -> concat(x.start, ',', x.length, ',', x.period, '\\n')"
    best = F.when(F.size("runs") > 0, F.expr(f"array_sort(runs, {ahead})")[0])
    found = found.withColumn("best", best)
    return found.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"),
        *[F.col("best").getField(c).alias(c) for c in ("start", "length", "period")],
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.expr(f"transform(runs, {line})")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))
