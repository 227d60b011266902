"""Phrase collocations from sorted count streams.

Counting: texts are cut into pieces and words, and tasks add up the phrases of some millions of words before
they write them. A phrase that occurs often consists of phrases that do, so phrases of n words are only taken
where their parts of n-1 words were often seen; tasks know that from a bitmap of fixed size (a part wrongly
found there costs rows, never results). Partial counts are dealt out by ranges of (lang, words) and summed there:
each length's frequent phrases are one count stream in prefix order.

Merging: the streams of all lengths, put in one order, have a word before its pairs and a pair before its triples.
One pass over that order reads all streams in lockstep and hands each phrase the counts of its first word and
first pair, and each pair its most frequent triple (:func:`lockstep`). In prefix order these are left counts and
right extensions; then the phrases go into suffix order (words reversed), where the same pass gives right counts
and left extensions. Nothing is looked up by hash. Ranges may cut a word's phrases anywhere: each range
reports what it has open at its ends, one row a range, and the ranges that follow take it from there.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from cardwatch.llm.common import in_batches, quoted, text_of, written
from cardwatch.llm.fragments import chunks, joined

#: Least occurrences of a phrase, percent of them in a longer phrase that drop it, phrases returned per language.
LEAST, COVERED, TOP = 10, 50, 2000
#: Words that a task adds up before it writes, and bits of the bitmap of frequent phrases.
WINDOW, BITMAP_BITS = 4_000_000, 1 << 25
PAIR_SHIFT = 26

_CLASS = np.zeros(256, np.uint8)  # 0: part of a word
_CLASS[[9, 32]] = 1
_CLASS[[*b".,;:!?", *range(10, 14)]] = 2
_BLANKS = bytes(32 if c else b for b, c in enumerate(_CLASS.tolist()))


def words_of(texts: pa.Array) -> tuple[list[bytes], np.ndarray]:
    """The words of all texts in a row, A-Z in lower case, and the number of each word's piece."""
    raw, ends = joined(texts)
    kind = _CLASS[raw]
    ink = kind == 0
    start = ink.copy()
    start[1:] &= ~ink[:-1]
    at = ends[(ends > 0) & (ends < len(raw))]
    start[at] = ink[at]
    place = np.flatnonzero(start)
    piece = np.cumsum(kind == 2)[place] + np.searchsorted(ends, place, "right")
    buffer = raw.tobytes().lower().translate(_BLANKS)
    if ink[at].any() and ink[np.maximum(at - 1, 0)].any():  # a word ends with its text
        buffer = b" ".join(buffer[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
    return buffer.split(), piece


class Bitmap:
    """A set of words or of pairs by bits of their hashes: never misses one, may hold others.

    A pair's bit mixes the low bits of the first word's hash with higher bits of the second's.
    """

    def __init__(self, held: np.ndarray, bits: int):
        self.held, self.bits = held, bits

    def has(self, first: np.ndarray, second: np.ndarray | None = None) -> np.ndarray:
        """Which words or pairs are in the set, by the words' hashes."""
        bit = first if second is None else first ^ (second >> np.uint64(PAIR_SHIFT))
        bit = bit & np.uint64(self.bits - 1)
        return (self.held[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)


def hashes(lang: str, words: list[bytes]) -> np.ndarray:
    """xxhash64(lang, word) of Spark for each word."""
    seed = xxhash.xxh64_intdigest(lang.encode(), 42)
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def bitmap(stream: DataFrame, n: int, bits: int = BITMAP_BITS) -> Bitmap:
    """The bitmap of a count stream of words or pairs; ``bits / 64`` rows at most come to the driver."""
    mixed = "xxhash64(lang, w1)" + (f" ^ shiftright(xxhash64(lang, w2), {PAIR_SHIFT})" if n == 2 else "")
    rows = stream.selectExpr(f"({mixed}) & {bits - 1}L AS at") \
        .selectExpr("shiftright(at, 6) AS place", "shiftleft(1L, int(at & 63)) AS bit") \
        .groupBy("place").agg(F.bit_or("bit").alias("bits")).toPandas()
    held = np.zeros(bits // 64, np.uint64)
    held[rows["place"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return Bitmap(held, bits)


class Counter:
    """Phrases of ``n`` words of one language, added up in a task."""

    def __init__(self, lang: str, n: int, parts: Bitmap | None):
        self.lang, self.n, self.parts = lang, n, parts
        self.clear()

    def clear(self) -> None:
        if hasattr(self, "numbers"):
            self.numbers.default_factory = None  # its own method: the table could not be freed at once
        self.numbers: defaultdict[bytes, int] = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        self.held, self.pieces, self.size, self.piece = [], [], 0, 0

    def add(self, words: list[bytes], piece: np.ndarray) -> None:
        self.held.append(np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words)))
        self.pieces.append(piece + self.piece)
        self.piece += int(piece[-1]) + 1 if len(piece) else 0
        self.size += len(words)

    def rows(self) -> Iterator[pa.RecordBatch]:
        """The phrases in ascending order of their words' numbers, with their counts."""
        ids = np.concatenate([np.zeros(0, np.int64), *self.held])
        piece = np.concatenate([np.zeros(0, np.int64), *self.pieces])
        words = list(self.numbers)
        hashed = hashes(self.lang, words) if self.n > 1 else None
        top, together = len(words), piece[1:] == piece[:-1]
        if self.n == 1:
            first, code = np.arange(len(ids)), ids
        elif self.n == 2:
            often = self.parts.has(hashed)[ids]
            first = np.flatnonzero(together & often[1:] & often[:-1])
            code = ids[first] * top + ids[first + 1]
        else:
            mine = hashed[ids]
            often = np.append(together & self.parts.has(mine[:-1], mine[1:]), False)
            first = np.flatnonzero(often[:-1] & often[1:])
            _, pair = np.unique(ids[first] * top + ids[first + 1], return_inverse=True)
            code = pair * top + ids[first + 2]
        _, one, count = np.unique(code, return_index=True, return_counts=True)
        dictionary, step = pa.array(words, pa.binary()).cast(pa.string()), 1 << 16
        for a in range(0, len(count), step):
            at = first[one[a:a + step]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([self.lang] * len(at), pa.string()),
                 *[dictionary.take(pa.array(ids[at + k])) for k in range(self.n)], pa.array(count[a:a + step])],
                ["lang", *[f"w{k}" for k in range(1, self.n + 1)], "n"])


def phrase_counts(texts: DataFrame, n: int, parts: Bitmap | None, least: int) -> DataFrame:
    """The count stream of phrases of ``n`` words with at least ``least`` occurrences, by language, in prefix order."""
    names = [f"w{k}" for k in range(1, n + 1)]
    schema = StructType([StructField("lang", StringType()), *[StructField(w, StringType()) for w in names],
                         StructField("n", LongType())])
    shared = texts.sparkSession.sparkContext.broadcast(parts) if parts is not None else None

    def run(batches):
        counters: dict[str, Counter] = {}
        held = 0
        for batch in chunks(batches, "text"):
            langs = batch["lang"].to_numpy(zero_copy_only=False)
            for lang in dict.fromkeys(langs.tolist()):
                if lang not in counters:
                    counters[lang] = Counter(lang, n, shared.value if shared else None)
                words, piece = words_of(batch["text"].filter(pa.array(langs == lang)))
                counters[lang].add(words, piece)
                held += len(words)
            if held >= WINDOW:
                for counter in counters.values():
                    yield from counter.rows()
                    counter.clear()
                held = 0
        for counter in counters.values():
            yield from counter.rows()

    partial = written(in_batches(texts, run, schema), f"phrases-{n}")
    key = ["lang", *names]
    return written(partial.repartitionByRange(*key).groupBy(*key).agg(F.sum("n").alias("n"))
                   .where(F.col("n") >= least).sortWithinPartitions(*key), f"stream-{n}")


# The pass over count streams in one order

_CARRIED = ["n", "l1", "l2", "right"]
STREAM = StructType([StructField(c, StringType()) for c in ("lang", "k1", "k2", "k3")] + [
    StructField("n", LongType()), StructField("l1", LongType()), StructField("l2", LongType()),
    StructField("right", LongType())])
MERGED = StructType([*STREAM.fields, *[StructField(c, LongType()) for c in ("one", "two", "most")],
                     StructField("part", IntegerType()), StructField("edge", IntegerType())])
#: ``edge`` of phrases, and of a range's own row about its ends.
PHRASE, ENDS = 0, 1


def lockstep(stream: DataFrame, label: str) -> DataFrame:
    """Phrases of two and three keys with the counts of their first key (``one``) and first two (``two``), and for
    two keys the most of the three-key phrases that follow (``most``).

    ``stream`` has rows of one, two and three keys (unused keys are empty, keys are not). It is dealt out by ranges of
    its order. A range reads it once, batch by batch, and holds the counts that are open and one pending pair.
    """
    order = ["lang", "k1", "k2", "k3"]
    ranged = stream.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches):
        part = TaskContext.get().partitionId()
        one = two = None  # open counts: ((lang, k1), n), ((lang, k1, k2), n)
        lead = -1  # most of the triples ahead of the first pair of this range
        pending = None  # the last pair: its row awaits its triples
        for batch in batches:
            f = batch.to_pandas()
            depth = 1 + (f["k2"] != "").to_numpy().astype(int) + (f["k3"] != "").to_numpy()
            n = f["n"].to_numpy(np.int64)
            head1 = np.maximum.accumulate(np.where(depth == 1, np.arange(len(f)), -1))
            head2 = np.maximum.accumulate(np.where(depth == 2, np.arange(len(f)), -1))
            f["one"] = np.where(head1 >= 0, n[head1], -1 if one is None else one)
            f["two"] = np.where(head2 >= 0, n[head2], -1 if two is None else two)
            triples = np.where(depth == 3, n, -1)
            pairs = np.flatnonzero(depth == 2)
            most = np.full(len(f), -1, np.int64)
            cut = int(pairs[0]) if len(pairs) else len(f)
            early = int(triples[:cut].max(initial=-1))
            if len(pairs):
                most[pairs] = np.maximum.reduceat(triples, pairs)
            f["most"] = most
            if pending is not None:
                pending["most"] = max(pending["most"], early)
            elif two is None:
                lead = max(lead, early)
            one = int(n[head1[-1]]) if len(f) and head1[-1] >= 0 else one
            two = int(n[head2[-1]]) if len(f) and head2[-1] >= 0 else two
            out = f[depth > 1]
            if len(pairs):
                if pending is not None:
                    yield _merged(pd.DataFrame([pending]), part, PHRASE)
                pending = f.iloc[int(pairs[-1])].to_dict()
                out = out.drop(index=int(pairs[-1]))
            if len(out):
                yield _merged(out, part, PHRASE)
        if pending is not None:
            # The last pair's triples may go on in the next range.
            yield _merged(pd.DataFrame([pending]), part, PHRASE, last=True)
        ends = {"lang": "", "k1": "", "k2": "", "k3": "", "n": 0, "one": -1 if one is None else one,
                "two": -1 if two is None else two, "most": lead}
        yield _merged(pd.DataFrame([ends]), part, ENDS)

    found = written(in_batches(ranged, run, MERGED), label)
    ends = found.where(F.col("edge") == ENDS).select("part", "one", "two", "most").orderBy("part").collect()
    carry, one, two = [], -1, -1
    for row in ends:  # one row a range: open counts go to the ranges behind
        carry.append([row["part"], one, two, -1])
        one, two = (row["one"] if row["one"] >= 0 else one), (row["two"] if row["two"] >= 0 else two)
    tail = -1
    for k in range(len(ends) - 1, -1, -1):  # triples ahead of a range's first pair go to the range before
        carry[k][3] = tail
        tail = ends[k]["most"] if ends[k]["two"] >= 0 else max(tail, ends[k]["most"])
    bounds = found.sparkSession.createDataFrame(
        carry or [[-1, -1, -1, -1]], "part int, one_before long, two_before long, most_behind long")
    rows = found.where(F.col("edge") != ENDS).join(F.broadcast(bounds), "part")
    at_end = F.when(F.col("edge") == PHRASE, F.lit(-1)).otherwise(F.col("most_behind"))
    return rows.select(
        *STREAM.names, F.when(F.col("one") >= 0, F.col("one")).otherwise(F.col("one_before")).alias("one"),
        F.when(F.col("two") >= 0, F.col("two")).otherwise(F.col("two_before")).alias("two"),
        F.greatest("most", at_end).alias("most"))


def _merged(f: pd.DataFrame, part: int, edge: int, last: bool = False) -> pa.RecordBatch:
    """Rows of MERGED; ``last`` marks the pair that a range leaves open."""
    f = f.assign(part=part, edge=2 if last else edge)
    for c in ("l1", "l2", "right"):
        if c not in f:
            f[c] = None
    types = {StringType(): pa.string(), LongType(): pa.int64(), IntegerType(): pa.int32()}
    return pa.RecordBatch.from_arrays(
        [pa.array(f[s.name], types[s.dataType], from_pandas=True) for s in MERGED], MERGED.names)


def _stream(rows: DataFrame, keys: list[str], extra: list | None = None) -> DataFrame:
    none = F.lit(None).cast("long")
    keys = [F.col(k) for k in keys] + [F.lit("")] * (3 - len(keys))
    carried = extra or [none, none, none]
    return rows.select("lang", *[k.alias(f"k{i}") for i, k in enumerate(keys, 1)], "n",
                       *[c.alias(n) for c, n in zip(carried, ("l1", "l2", "right"), strict=True)])


def collocations(docs: DataFrame, least: int = LEAST, covered: int = COVERED, text_col: str = "text",
                 lang_col: str = "lang") -> DataFrame:
    """All phrases of two and three words with ``least`` occurrences that no longer phrase covers:
    (lang, phrase, a, l, r, n, score), the counts of the parts being those of the lowest-scoring cut.

    Null text counts as empty, a missing language is ``und``. Repeated rows count as often as they stand there. Further
    columns are not read; an empty table, or one without frequent phrases, gives no rows. Counts up to 10^15
    are exact: scores are whole-number divisions of 38 digits.
    """
    texts = docs.select(F.coalesce(quoted(lang_col).cast("string"), F.lit("und")).alias("lang"),
                        text_of(text_col).alias("text"))
    every = phrase_counts(texts, 1, None, 1)
    totals = every.groupBy("lang").agg(F.sum("n").alias("total"))
    words = every.where(F.col("n") >= least)
    pairs = phrase_counts(texts, 2, bitmap(words, 1), least)
    triples = phrase_counts(texts, 3, bitmap(pairs, 2), least)
    prefix = lockstep(_stream(words, ["w1"]).unionByName(_stream(pairs, ["w1", "w2"])).unionByName(
        _stream(triples, ["w1", "w2", "w3"])), "prefix-order")
    short = F.col("k3") == ""
    back = prefix.select("lang", F.when(short, F.col("k2")).otherwise(F.col("k3")).alias("k1"),
                         F.when(short, F.col("k1")).otherwise(F.col("k2")).alias("k2"),
                         F.when(short, F.lit("")).otherwise(F.col("k1")).alias("k3"), "n",
                         F.col("one").alias("l1"), F.when(~short, F.col("two")).alias("l2"),
                         F.col("most").alias("right"))
    both = lockstep(back.unionByName(_stream(words, ["w1"])), "suffix-order")
    score = "cast(n as decimal(16,0)) * n * 1000000 div (cast({l} as decimal(19,0)) * {r})"
    scored = both.where((F.col("k3") != "") | (100 * F.greatest("right", "most") < covered * F.col("n"))).select(
        "lang", F.when(short, F.concat_ws(" ", "k2", "k1")).otherwise(F.concat_ws(" ", "k3", "k2", "k1")).alias("phrase"),
        F.col("n").alias("a"), F.col("l1"), F.when(short, F.col("one")).otherwise(F.col("two")).alias("r1"),
        F.col("l2"), F.when(~short, F.col("one")).alias("r2"),
        F.expr(score.format(l="l1", r="(case when k3 = '' then one else two end)")).alias("s1"),
        F.expr("case when k3 <> '' then " + score.format(l="l2", r="one") + " end").alias("s2"))
    later = F.coalesce(F.col("s2") < F.col("s1"), F.lit(False))
    return scored.join(F.broadcast(totals), "lang").select(
        "lang", "phrase", "a", F.when(later, F.col("l2")).otherwise(F.col("l1")).alias("l"),
        F.when(later, F.col("r2")).otherwise(F.col("r1")).alias("r"), F.col("total").alias("n"),
        F.when(later, F.col("s2")).otherwise(F.col("s1")).alias("score"))


def top_collocations(docs: DataFrame, top: int = TOP, **options) -> DataFrame:
    """The first ``top`` phrases of each language by score, then occurrences, then bytes of the phrase."""
    by = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = collocations(docs, **options).withColumn("rank", F.row_number().over(by).cast("long"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
