"""Packing of documents into training windows by lexical retrieval.

Documents are tokenized once and dealt out by a minhash of their tokens, so that like ones meet, in
ranges that split at any document. A task cuts its range into shards of bounded size and builds a
BM25 inverted index of each; document frequencies and the mean length come from the whole corpus. A
seed document opens a window; the unused documents of the shard that score highest against the seed's
heaviest terms fill it, then those against its other terms, the last one cut at the window's end; what is
left of it is the next seed. Only a window whose seed shares no term with an unused document goes on with the
next document in line.
Only the end of a task's range leaves a window short; it is cut into lengths that are powers of two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BinaryType,
    DoubleType,
    IntegerType,
    LongType,
    StructField,
    StructType,
)

from cardwatch.llm.bpe import codec
from cardwatch.llm.common import in_batches, quoted, text_of, written
from cardwatch.llm.fragments import chunks

WINDOW = 2048
#: Bounds of a shard, terms of a seed that are searched before the others, tokens of a task's range.
SHARD_TOKENS, SHARD_DOCS, QUERY_TERMS, RANGE_TOKENS = 2_000_000, 8192, 24, 64_000_000
#: The usual constants of BM25.
K1, B = 1.2, 0.75


def tokenize(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """Written rows (uid, doc_id, n, near, ids): ids in the least unsigned width, ``near`` the minhash.

    The minhash weighs a token by its rank, as rarer tokens have higher ids in a BPE vocabulary.
    """
    slim = docs.select(F.monotonically_increasing_id().alias("uid"), quoted(id_col).alias("doc_id"),
                       text_of(text_col).alias("text"))
    schema = StructType([StructField("uid", LongType()), slim.schema["doc_id"], StructField("n", LongType()),
                         StructField("near", DoubleType()), StructField("ids", BinaryType())])

    def run(batches):
        own = codec(path)
        kind = width(own.size)
        rank = np.arange(own.size)
        key = -np.log(np.random.default_rng(7).random(own.size)) / np.log2(rank + 2) ** 4
        for part in chunks(batches, "text"):
            flat, ends = own.encode(part["text"])
            flat = np.insert(flat, ends[1:], end_id)
            ends = ends + np.arange(len(ends))
            at = pa.py_buffer((ends * kind.itemsize).astype(np.int32))
            ids = pa.Array.from_buffers(pa.binary(), len(part), [None, at, pa.py_buffer(flat.astype(kind).tobytes())])
            near = np.minimum.reduceat(key[flat], ends[:-1])
            yield pa.RecordBatch.from_arrays(
                [part["uid"], part["doc_id"], pa.array(np.diff(ends)), pa.array(near), ids], schema.names)

    return written(in_batches(slim, run, schema), "pack-tokens")


def width(size: int) -> np.dtype:
    return np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")


def document_frequency(tokens: DataFrame, size: int) -> np.ndarray:
    """For every id of the vocabulary, the documents that hold it. The driver gets one row per id."""
    schema = StructType([StructField("term", IntegerType()), StructField("df", LongType())])
    kind = width(size)

    def run(batches):
        df, last = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            for ids in batch["ids"]:
                terms = np.frombuffer(ids.as_buffer(), kind)
                place = np.arange(len(terms))
                last[terms] = place  # one place of each term stays
                df[terms[last[terms] == place]] += 1
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(df[held])], schema.names)

    rows = in_batches(tokens.select("ids"), run, schema).groupBy("term").agg(F.sum("df").alias("df")).collect()
    out = np.zeros(size)
    out[[r.term for r in rows]] = [r.df for r in rows]
    return out


class Index:
    """BM25 inverted index of the documents of a shard that ``numbers`` names."""

    def __init__(self, docs: list[np.ndarray], numbers: np.ndarray, idf: np.ndarray, mean: float):
        self.numbers, self.idf, self.mean, n = numbers, idf, mean, len(numbers)
        held = [docs[k] for k in numbers.tolist()]
        size = np.array([len(d) for d in held])
        who = np.repeat(np.arange(n, dtype=np.uint64), size)
        key = np.sort(np.concatenate(held).astype(np.uint64) * np.uint64(n) + who)
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        tf = np.diff(np.append(new, len(key)))
        key = key[new]
        term, self.doc = (key // np.uint64(n)).astype(np.int64), (key % np.uint64(n)).astype(np.int64)
        self.weight = self.weights(term, tf, size[self.doc])
        self.first = np.searchsorted(term, np.arange(len(idf) + 1))

    def weights(self, term: np.ndarray, tf: np.ndarray, size) -> np.ndarray:
        return (self.idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / self.mean))).astype(np.float32)

    def neighbours(self, seed: np.ndarray, unused: np.ndarray) -> Iterator[int]:
        """All unused documents that share a term with ``seed``, for a caller that uses each before the next.

        Those that share its heaviest terms (ties to the lower id) come by their score against these, then the
        rest by their score against its other terms; equal scores by number.
        """
        term, tf = np.unique(seed, return_counts=True)
        by_weight = np.argsort(-self.weights(term, tf, len(seed)), kind="stable")
        for part in (by_weight[:QUERY_TERMS], by_weight[QUERY_TERMS:]):
            runs = [slice(a, b) for a, b in zip(self.first[term[part]], self.first[term[part] + 1], strict=True)]
            if not runs:
                return
            score = np.bincount(np.concatenate([self.doc[r] for r in runs]),
                                np.concatenate([self.weight[r] for r in runs]), len(self.numbers))
            score = score * unused[self.numbers]
            left, take = np.flatnonzero(score), 16
            while len(left):
                if len(left) > take:  # all at or above the score of the place ``take``
                    bound = -np.partition(-score[left], take)[take]
                    best, left = left[score[left] >= bound], left[score[left] < bound]
                else:
                    best, left = left, left[:0]
                yield from self.numbers[best[np.lexsort((best, -score[best]))]].tolist()
                take *= 4


class Windows:
    """Places documents one after the other; a piece ends at its document's or the window's end."""

    def __init__(self, window: int):
        self.window, self.fill, self.sequence = window, 0, 0
        self.pieces: list[tuple] = []  # (document, its start, length, sequence, offset)

    def place(self, doc: int, size: int) -> None:
        at = 0
        while at < size:
            take = min(self.window - self.fill, size - at)
            self.pieces.append((doc, at, take, self.sequence, self.fill))
            at, self.fill = at + take, self.fill + take
            if self.fill == self.window:
                self.sequence, self.fill = self.sequence + 1, 0

    def settled(self) -> list[tuple]:
        """Take out the pieces of full windows."""
        done = [p for p in self.pieces if p[3] < self.sequence]
        self.pieces = [p for p in self.pieces if p[3] == self.sequence]
        return done

    def finish(self) -> list[tuple]:
        """Cut the open window into lengths that are powers of two, the largest first."""
        out, room, offset = [], 1 << max(0, self.fill.bit_length() - 1), 0
        left = self.fill
        for doc, start, length, _, _ in self.pieces:
            while length:
                take = min(length, room - offset)
                out.append((doc, start, take, self.sequence, offset))
                start, length, offset, left = start + take, length - take, offset + take, left - take
                if offset == room:
                    self.sequence, offset = self.sequence + 1, 0
                    room = 1 << max(0, left.bit_length() - 1)
        self.pieces, self.fill = [], 0
        return out


def fill_windows(docs: list[np.ndarray], first: int, windows: Windows, idf: np.ndarray, mean: float) -> None:
    """Place all documents of a shard; ``first`` is the number of its first document.

    The index is built again whenever over half of its documents are used.
    """
    unused = np.ones(len(docs))
    index, live = Index(docs, np.arange(len(docs)), idf, mean), len(docs)
    following, seed = 0, None
    while True:
        if seed is None:
            while following < len(docs) and not unused[following]:
                following += 1
            if following == len(docs):
                return
            seed, unused[following], live = following, 0, live - 1
            windows.place(first + seed, len(docs[seed]))
        if not windows.fill or not live:
            seed = None
            continue
        if 2 * live < len(index.numbers):
            index = Index(docs, np.flatnonzero(unused), idf, mean)
        opened, after = windows.sequence, None
        for doc in index.neighbours(docs[seed], unused):
            unused[doc], live = 0, live - 1
            windows.place(first + doc, len(docs[doc]))
            if windows.sequence != opened:  # the window is full; what is left of doc opened the next
                after = doc
                break
        seed = after


def pack(docs: DataFrame, path: str, end_id: int, window: int = WINDOW, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset) of every piece.

    Null and empty texts are packed as their end id alone; repeated rows are packed each; ids are
    little-endian uint32 bytes; an empty table has no pieces. Every id lies in one piece.
    """
    tokens = tokenize(docs, path, end_id, id_col, text_col)
    size = codec(path).size
    kind = width(size)
    total = tokens.agg(F.count("*").alias("docs"), F.sum("n").alias("tokens")).first()
    df = document_frequency(tokens, size)
    idf = np.log1p((total.docs - df + 0.5) / (df + 0.5)).astype(np.float32)
    mean = (total.tokens or 1) / max(total.docs, 1)
    schema = StructType([
        StructField("doc_id", tokens.schema["doc_id"].dataType), StructField("start", LongType()),
        StructField("length", LongType()), StructField("ids", BinaryType()),
        StructField("doc_tokens", LongType()), StructField("sequence_id", LongType()),
        StructField("offset", LongType())])

    def run(batches):
        windows, base = Windows(window), TaskContext.get().partitionId() << 36
        held: dict[int, tuple] = {}  # documents with pieces that aren't out yet
        shard, first, weight, kinds = [], 0, 0, None

        def out(pieces):
            for a in range(0, len(pieces), 4096):
                part = pieces[a:a + 4096]
                ids = [held[d][1][s:s + n].astype("<u4").tobytes() for d, s, n, _, _ in part]
                longs = [pa.array(c, pa.int64()) for c in (
                    [p[1] for p in part], [p[2] for p in part], [len(held[p[0]][1]) for p in part],
                    [base + p[3] for p in part], [p[4] for p in part])]
                names = pa.array([held[p[0]][0] for p in part], kinds)
                yield pa.RecordBatch.from_arrays(
                    [names, longs[0], longs[1], pa.array(ids, pa.binary()), *longs[2:]], schema.names)

        def close():
            nonlocal shard, first, weight
            fill_windows(shard, first, windows, idf, mean)
            yield from out(windows.settled())
            keep = {p[0] for p in windows.pieces}
            for d in [d for d in held if d not in keep]:
                del held[d]
            first, shard, weight = first + len(shard), [], 0

        for batch in batches:
            kinds = batch["doc_id"].type
            for doc, ids in zip(batch["doc_id"].to_pylist(), batch["ids"], strict=True):
                terms = np.frombuffer(ids.as_buffer().to_pybytes(), kind)
                held[first + len(shard)] = (doc, terms)
                shard.append(terms)
                weight += len(terms)
                if weight >= SHARD_TOKENS or len(shard) >= SHARD_DOCS:
                    yield from close()
        if shard:
            yield from close()
        yield from out(windows.finish())

    # As many ranges as the session's shuffles have, or more if a range would outgrow its task.
    ranges = -(-(total.tokens or 0) // RANGE_TOKENS)
    many = [ranges] if ranges > int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) else []
    near = tokens.repartitionByRange(*many, "near", "uid").sortWithinPartitions("near", "uid")
    return in_batches(near.select("doc_id", "ids"), run, schema)


def pack_report(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """The pieces with the CRC-32 of their ids."""
    return pack(docs, path, end_id).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
