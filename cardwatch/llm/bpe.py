"""Byte-level BPE with forced boundaries.

A pair of adjacent bytes that occurs inside no token of the vocabulary can never be merged, so the
encoding of a text is the encodings of the fragments between such pairs, one after the other. Texts
repeat their fragments, so each worker keeps the ids of those it has met (fragments.py).

The pre-tokenizer of the vocabulary looks at neighbouring characters, so a pair counts as a boundary
only where a cut can't change its matches either: the left byte isn't ASCII white space, a control
or an apostrophe, the right one isn't an apostrophe, and behind a longer character only ASCII white
space may follow.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from cardwatch.llm.common import bundled, in_batches, quoted, text_of, unbundled, written
from cardwatch.llm.fragments import FragmentIds, chunks, joined


#: Rows decoded at a time; of their ids only one row's are Python objects at once.
DECODED = 256


def byte_alphabet() -> dict[str, int]:
    """The published mapping of printable characters to bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ForcedBoundaryCodec:
    """Encoder and decoder of one vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_alphabet()
        self.letters = {b: c for c, b in letters.items()}
        tokens = {i: bytes(letters[c] for c in t) for t, i in spec["model"]["vocab"].items()}
        for added in spec.get("added_tokens", ()):  # written as they are, and never cut
            tokens[added["id"]] = added["content"].encode()
        self.size = max(tokens) + 1
        self.table = [tokens.get(i, b"") for i in range(self.size)]
        self.cuts = self._boundaries(tokens.values()).reshape(-1)
        self.fragments = FragmentIds(self._library_ids)

    @staticmethod
    def _boundaries(tokens: Iterable[bytes]) -> np.ndarray:
        """For each pair of bytes, whether a text is cut between them."""
        inside = np.zeros((256, 256), dtype=bool)
        for token in tokens:
            raw = np.frombuffer(token, np.uint8)
            inside[raw[:-1], raw[1:]] = True
        left, right = np.arange(256)[:, None], np.arange(256)[None, :]
        plain = (left > 0x20) & (left < 0x7F) & (left != ord("'"))
        begins = (right < 0x80) | (right >= 0xC0)  # a character begins with this byte
        blank = ((right >= 9) & (right <= 13)) | (right == 0x20)
        safe = (plain & begins & (right != ord("'"))) | ((left >= 0x80) & blank)
        return ~inside & safe

    def _library_ids(self, fragments: list[bytes]) -> list[list[int]]:
        """Ids by the library; a single word of Latin letters needs no pre-tokenizer."""
        out: list[list[int] | None] = [None] * len(fragments)
        rest = []
        for k, fragment in enumerate(fragments):
            text = fragment.decode()
            word = text[1:] if text[0] == " " else text
            if word.isalpha() and max(word) < "\u0250":
                spelled = fragment.decode("latin-1").translate(self.letters)
                out[k] = [t.id for t in self.library.model.tokenize(spelled)]
            else:
                rest.append((k, text))
        encoded = self.library.encode_batch_fast([t for _, t in rest], add_special_tokens=False)
        for (k, _), e in zip(rest, encoded, strict=True):
            out[k] = e.ids
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, as the library gives them for each whole text,
        and where each text's ids begin and the last ends."""
        raw, ends = joined(texts)
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(ends), np.int64)
        pairs = raw[:-1].astype(np.uint16) << 8
        pairs |= raw[1:]
        cut = np.zeros(len(raw) + 1, bool)
        cut[1:-1] = self.cuts[pairs]
        cut[ends] = True
        at = np.flatnonzero(cut)
        ids, n = self.fragments.ids(raw, at[:-1], at[1:])
        total = np.concatenate([[0], np.cumsum(n)])
        return ids, total[np.searchsorted(at, ends)]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.table.__getitem__, ids)).decode("utf-8", "replace")


_codecs: dict[str, ForcedBoundaryCodec] = {}


def codec(path: str) -> ForcedBoundaryCodec:
    """The worker's codec of a vocabulary file."""
    if path not in _codecs:
        _codecs[path] = ForcedBoundaryCodec(path)
    return _codecs[path]


def encode(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``docs`` without its text but with ``ids``, the token ids of each whole text.

    Null and empty texts have no ids; repeated rows stay; other columns pass through, but a column
    already called ``ids`` is replaced.
    """
    rest = [c for c in docs.columns if c not in (text_col, "ids")]
    slim = docs.select(bundled(rest), text_of(text_col).alias("text"))
    schema = StructType([slim.schema["row"], StructField("ids", ArrayType(IntegerType()))])

    def run(batches):
        own = codec(path)
        for part in chunks(batches, "text"):
            ids, ends = own.encode(part["text"])
            column = pa.ListArray.from_arrays(
                pa.array(ends.astype(np.int32)), pa.array(ids.view(np.int32)))
            yield pa.RecordBatch.from_arrays([part["row"], column], schema.names)

    return in_batches(slim, run, schema).select(*unbundled(rest), "ids")


def decode(tokens: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``tokens`` and the text of their ids, special tokens included; no ids give an empty text."""
    rest = [c for c in tokens.columns if c != text_col]
    slim = tokens.select(bundled(rest), quoted(ids_col).alias("ids"))
    schema = StructType([slim.schema["row"], StructField("text", StringType())])

    def run(batches):
        own = codec(path)
        for batch in batches:
            for k in range(0, batch.num_rows, DECODED):
                part = batch.slice(k, DECODED)
                texts = pa.array([own.decode(x.values.to_numpy().tolist() if x.is_valid else [])
                                  for x in part["ids"]], pa.string())
                yield pa.RecordBatch.from_arrays([part["row"], texts], schema.names)

    return in_batches(slim, run, schema).select(*unbundled(rest), F.col("text").alias(text_col))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document.

    The ids are written in between: a task has one Python worker, and none waits for another's rows.
    """
    tokens = written(encode(docs.select("doc_id", "text"), path), "bpe-ids")
    out = decode(tokens, path)
    joined = F.array_join(quoted("ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(joined, 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))
