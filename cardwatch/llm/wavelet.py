"""Token ids of a shard as a wavelet matrix in one file.

The matrix has a bit plane per bit of an id, the highest first; each plane is stored in the order
that the planes before it have sorted the tokens into (zeros before ones, otherwise in place). A
plane is cut into blocks of 2^16 bits, compressed one by one; the directory holds each block's place
and the ones before it, so a read of single tokens, a count or a search touches one block per plane.

File: 8 bytes ``magic``, 8 bytes length of the head, the head (JSON), then the parts it names by
place: document ids (an Arrow stream), document starts (int64), block directory (int64 pairs), blocks.
"""

from __future__ import annotations

import io
import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BinaryType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)
from pyspark.sql.window import Window

from cardwatch.llm.common import in_batches, quoted, text_of, written
from cardwatch.llm.fragments import FragmentIds, chunks, joined
from cardwatch.llm.words import word_ranges
from cardwatch.session import scratch_path

MAGIC = b"WMTOKEN1"
BLOCK_BITS = 1 << 16
#: Tokens of a shard; a document is never split, so one long document makes a longer shard.
SHARD_TOKENS = 4_000_000


def build(tokens: np.ndarray, starts: np.ndarray, doc_ids: pa.Array) -> bytes:
    """The file of a shard: ``starts`` has each document's first token and the end of the last."""
    top = int(tokens.max()) if len(tokens) else 0
    bits = max(1, top.bit_length())
    now = tokens.astype(np.uint16 if bits <= 16 else np.uint32)
    pack = zstandard.ZstdCompressor(level=1)
    zeros, directory, blocks, place = [], [], [], 0
    for k in range(bits - 1, -1, -1):
        bit = (now >> now.dtype.type(k)) & now.dtype.type(1)
        one = bit.astype(bool)
        zeros.append(int(len(one) - np.count_nonzero(one)))
        before = 0
        for a in range(0, len(one), BLOCK_BITS):
            part = one[a:a + BLOCK_BITS]
            block = pack.compress(np.packbits(part).tobytes())
            directory.append((place, before))
            blocks.append(block)
            place += len(block)
            before += int(np.count_nonzero(part))
        now = np.concatenate([now[~one], now[one]])
    sink = io.BytesIO()
    batch = pa.RecordBatch.from_arrays([doc_ids], ["id"])
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    parts = {"ids": sink.getvalue(), "starts": np.asarray(starts, "<i8").tobytes(),
             "directory": np.array(directory, "<i8").reshape(-1, 2).tobytes(), "blocks": b"".join(blocks)}
    head, at = {"bits": bits, "tokens": len(tokens), "zeros": zeros, "parts": {}}, 0
    for name, part in parts.items():
        head["parts"][name] = [at, len(part)]
        at += len(part)
    text = json.dumps(head).encode()
    return b"".join([MAGIC, len(text).to_bytes(8, "little"), text, *parts.values()])


class WaveletFile:
    """Reads of a shard file: whole, by position, by count and by occurrence."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token shard")
        size = int.from_bytes(data[8:16], "little")
        head = json.loads(data[16:16 + size])
        self.bits, self.n, self.zeros = head["bits"], head["tokens"], head["zeros"]
        view, base = memoryview(data), 16 + size
        part = {k: view[base + a:base + a + n] for k, (a, n) in head["parts"].items()}
        self.doc_ids = pa.ipc.open_stream(part["ids"]).read_all()["id"].combine_chunks()
        self.starts = np.frombuffer(part["starts"], "<i8")
        self.directory = np.frombuffer(part["directory"], "<i8").reshape(-1, 2)
        self.blocks = part["blocks"]
        self.per_plane = -(-self.n // BLOCK_BITS)
        self.unpack = zstandard.ZstdDecompressor()

    def _block(self, plane: int, k: int) -> np.ndarray:
        i = plane * self.per_plane + k
        a = self.directory[i, 0]
        b = self.directory[i + 1, 0] if i + 1 < len(self.directory) else len(self.blocks)
        raw = np.frombuffer(self.unpack.decompress(self.blocks[a:b]), np.uint8)
        return np.unpackbits(raw, count=min(BLOCK_BITS, self.n - k * BLOCK_BITS))

    def _plane(self, plane: int) -> np.ndarray:
        blocks = [self._block(plane, k) for k in range(self.per_plane)]
        return np.concatenate(blocks).view(bool) if blocks else np.zeros(0, bool)

    def _ones(self, plane: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane (rank)."""
        k, rest = divmod(i, BLOCK_BITS)
        if not rest:
            if k < self.per_plane:
                return int(self.directory[plane * self.per_plane + k, 1])
            return self.n - self.zeros[plane]
        before = int(self.directory[plane * self.per_plane + k, 1])
        return before + int(np.count_nonzero(self._block(plane, k)[:rest]))

    def _find(self, plane: int, bit: int, nth: int) -> int:
        """The place of the ``nth`` (from 0) zero or one of a plane (select)."""
        before = self.directory[plane * self.per_plane:(plane + 1) * self.per_plane, 1]
        if not bit:
            before = np.arange(self.per_plane) * BLOCK_BITS - before
        k = int(np.searchsorted(before, nth, "right")) - 1
        inside = np.flatnonzero(self._block(plane, k) == bit)
        return k * BLOCK_BITS + int(inside[nth - int(before[k])])

    def access(self, i: int) -> int:
        """The token at position ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for plane in range(self.bits):
            ones = self._ones(plane, i)
            bit = self._ones(plane, i + 1) - ones
            value = value << 1 | bit
            i = self.zeros[plane] + ones if bit else i - ones
        return value

    def _narrow(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        if token >> self.bits:
            return 0, 0
        for plane in range(self.bits):
            a, b = self._ones(plane, lo), self._ones(plane, hi)
            if token >> (self.bits - 1 - plane) & 1:
                lo, hi = self.zeros[plane] + a, self.zeros[plane] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of ``token`` at positions from ``lo`` to ``hi`` (exclusive)."""
        lo, hi = self._narrow(token, lo, self.n if hi is None else hi)
        return hi - lo

    def occurrence(self, token: int, nth: int) -> int:
        """The position of the ``nth`` (from 0) occurrence of ``token``."""
        lo, hi = self._narrow(token, 0, self.n)
        if not 0 <= nth < hi - lo:
            raise IndexError(nth)
        i = lo + nth
        for plane in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - plane) & 1
            i = self._find(plane, bit, i - self.zeros[plane] if bit else i)
        return i

    def tokens(self) -> np.ndarray:
        """All tokens: the planes are undone from the last to the first."""
        out = np.zeros(self.n, np.uint32)
        for plane in range(self.bits - 1, -1, -1):
            one = self._plane(plane)
            z = self.zeros[plane]
            back = np.empty(self.n, np.uint32)
            back[~one] = out[:z]
            back[one] = out[z:] | np.uint32(1 << (self.bits - 1 - plane))
            out = back
        return out

    def documents(self):
        """(id, tokens) of each document, in the order written."""
        all_tokens = self.tokens()
        for k, doc in enumerate(self.doc_ids):
            yield doc.as_py(), all_tokens[self.starts[k]:self.starts[k + 1]]


#: Between a Latin letter and one of these the pre-tokenizer always splits.
_STOP = np.zeros(256, bool)
_STOP[list(b",.;:!?")] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


class WordCodec:
    """Ids of a vocabulary whose pre-tokenizer drops white space and splits letters from the rest.

    Words are encoded on their own, and so are the stops behind Latin letters.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.words = FragmentIds(self._library_ids)

    def _library_ids(self, words: list[bytes]) -> list[list[int]]:
        """Ids by the library; a word of Latin letters needs no pre-tokenizer, only lower case."""
        out: list[list[int] | None] = [None] * len(words)
        rest = []
        for k, word in enumerate(words):
            if word.isalpha():  # of bytes: ASCII letters only
                out[k] = [t.id for t in self.library.model.tokenize(word.lower().decode())]
            else:
                rest.append(k)
        encoded = self.library.encode_batch_fast([words[k].decode() for k in rest], add_special_tokens=False)
        for k, e in zip(rest, encoded, strict=True):
            out[k] = e.ids
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text's begin and the last end."""
        raw, ends = joined(texts)
        start, stop = word_ranges(raw, ends)
        if len(raw):
            split = np.flatnonzero(_LETTER[raw[:-1]] & _STOP[raw[1:]]) + 1
            split = np.setdiff1d(split, start, assume_unique=True)  # a text can begin with a stop
            start = np.sort(np.concatenate([start, split]), kind="stable")
            stop = np.sort(np.concatenate([stop, split]), kind="stable")
        ids, n = self.words.ids(raw, start, stop)
        total = np.concatenate([[0], np.cumsum(n)])
        return ids, total[np.searchsorted(start, ends)]


_codecs: dict[str, WordCodec] = {}


def codec(path: str) -> WordCodec:
    if path not in _codecs:
        _codecs[path] = WordCodec(path)
    return _codecs[path]


def store(folder: str, name: str, data: bytes) -> None:
    """Write a file under its final name only when it is whole: a lost or repeated task does no harm."""
    files, path = pyarrow.fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") \
        else (pyarrow.fs.LocalFileSystem(), folder)
    files.create_dir(path, recursive=True)
    attempt = f"{path}/.{name}-{TaskContext.get().taskAttemptId()}"
    with files.open_output_stream(attempt) as out:
        out.write(data)
    files.move(attempt, f"{path}/{name}")


MANIFEST = StructType([
    StructField("partition", IntegerType()), StructField("part", IntegerType()),
    StructField("file", StringType()), StructField("tokens", LongType()),
    StructField("documents", LongType()), StructField("bytes", LongType()),
])


def write_shards(docs: DataFrame, folder: str, path: str, id_col: str = "doc_id", text_col: str = "text",
                 end_id: int | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode ``docs`` in ascending id order into shard files; returns the written manifest.

    Null text counts as empty; a missing id comes first; rows with the same id are ordered by their
    text's hash; an empty table has no shards. Ids of any sortable type are kept as they are.
    """
    slim = docs.select(quoted(id_col).alias("id"), text_of(text_col).alias("text"))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    ranged = slim.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches):
        own, partition = codec(path), TaskContext.get().partitionId()
        ids, docs_held, counts, held, part = [], [], [], 0, 0

        def flush():
            nonlocal ids, docs_held, counts, held, part
            name = f"shard-{partition:06d}-{part:05d}.wm"
            data = build(np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(counts))]),
                         pa.concat_arrays(docs_held))
            store(folder, name, data)
            row = [[partition], [part], [name], [held], [sum(map(len, docs_held))], [len(data)]]
            ids, docs_held, counts, held, part = [], [], [], 0, part + 1
            return pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.string(), pa.int64(),
                                                      pa.int64(), pa.int64()), strict=True)],
                [f.name for f in MANIFEST])

        for batch in chunks(batches, "text"):
            flat, ends = own.encode(batch["text"])
            if end_id is not None:
                flat = np.insert(flat, ends[1:], end_id)
                ends = ends + np.arange(len(ends))
            ids.append(flat.astype(np.uint32))
            counts.append(np.diff(ends))
            docs_held.append(batch["id"])
            held += len(flat)
            if held >= shard_tokens:
                yield flush()
        if docs_held:
            yield flush()

    return written(in_batches(ranged, run, MANIFEST), "shard-manifest")


def read_shards(manifest: DataFrame, folder: str, id_type) -> DataFrame:
    """(doc_id, start, ids) of every document of the shards, ids as little-endian uint32 bytes.

    ``start`` counts the tokens of all documents before: shards are summed by partition, and only
    the sums of partitions are put in one line.
    """
    spark = manifest.sparkSession
    whole = Window.orderBy("partition").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("partition").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    bases = manifest.groupBy("partition").agg(F.sum("tokens").alias("n")).select(
        "partition", F.coalesce(F.sum("n").over(whole), zero).alias("base"))
    shards = manifest.withColumn("inner", F.coalesce(F.sum("tokens").over(inside), zero)).join(
        bases, "partition").select("file", (F.col("base") + F.col("inner")).alias("base"))
    schema = StructType([StructField("doc_id", id_type), StructField("start", LongType()),
                         StructField("ids", BinaryType())])
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wm").load(folder).select(
        F.element_at(F.split("path", "/"), -1).alias("file"), "content")

    def run(batches):
        for batch in batches:
            for content, base in zip(batch["content"], batch["base"].to_pylist(), strict=True):
                shard = WaveletFile(content.as_buffer().to_pybytes())
                flat = shard.tokens()
                first = 0
                while first < len(shard.doc_ids):  # rows of about 4 MB
                    last = max(first + 1, int(np.searchsorted(shard.starts, shard.starts[first] + (1 << 20))) - 1)
                    at = shard.starts[first:last + 1]
                    data = pa.py_buffer(flat[at[0]:at[-1]].astype("<u4").tobytes())
                    ids = pa.Array.from_buffers(
                        pa.binary(), last - first, [None, pa.py_buffer(((at - at[0]) * 4).astype(np.int32)), data])
                    yield pa.RecordBatch.from_arrays(
                        [shard.doc_ids[first:last], pa.array(at[:-1] + base), ids], ["doc_id", "start", "ids"])
                    first = last

    return in_batches(files.join(shards, "file").select("content", "base"), run, schema)


def token_files(docs: DataFrame, path: str, end_id: int, folder: str | None = None,
                shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write the shards of ``docs`` and report every document as the files have it."""
    folder = folder or scratch_path(docs.sparkSession, "token-shards")
    manifest = write_shards(docs, folder, path, end_id=end_id, shard_tokens=shard_tokens)
    if manifest.isEmpty():
        rows = docs.sparkSession.createDataFrame([], StructType([
            docs.schema["doc_id"], StructField("start", LongType()), StructField("ids", BinaryType())]))
    else:
        rows = read_shards(manifest, folder, docs.schema["doc_id"].dataType)
    n = (F.octet_length("ids") / 4).cast("long")
    return rows.select("doc_id", "start", n.alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
