"""Repeated byte strings by ranks of anchored positions: one round of doubling, then single strings.

Every byte covered by a string of ``LENGTH`` bytes that also starts elsewhere is removed. Sorting all
positions would shuffle many times the input, so positions are thinned by a rule on the text itself:
an anchor is the place of the least 8-byte hash in some window of ``SPAN`` places (the last of equal
ones). Equal strings of LENGTH bytes have the same anchors, but for the outermost ones, and each start
of a string belongs to its first certain anchor.

Ranks grow over anchors by rounds of grouping and joining. The first rank is that of the core, the
LENGTH - SPAN + 1 bytes that all strings belonging to an anchor share; an anchor whose core is unique
has no repeated string and is dropped. The second round ranks pairs of that rank and the rank of the
surroundings, which reach past the threshold of LENGTH for every start: an anchor whose pair
isn't unique is covered. Only where pairs differ within a core are single strings ranked and counted,
with one member for each equal pair. Texts that are equal are one text with a multiplicity.

Ranks are two hashes modulo a prime of 31 bits, so two different strings of a corpus fall together with a chance of
about 1 in 2^62, at most (LENGTH / 2^31)^2, for each pair; in the first round that only costs work.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from cardwatch.llm.common import in_batches, quoted, release, text_of, written
from cardwatch.llm.fragments import PrimeHash, chunks, joined
from cardwatch.llm.words import in_text

#: SPAN can be up to (LENGTH + 3 - GRAM) // 3, so that every string has a certain anchor.
LENGTH, SPAN, GRAM = 400, 128, 8
_ODD = np.uint64(0xC2B2AE3D27D4EB4F)
_LOW = np.uint64(0xFFFFFFFF)


def anchors(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, text) of the anchors of all texts of LENGTH bytes or more, in order."""
    none = np.zeros(0, np.int64)
    grams = len(raw) - GRAM + 1
    if grams < SPAN:
        return none, none
    gram = np.ndarray((grams,), "<u8", buffer=np.ascontiguousarray(raw), strides=(1,))
    key = (gram * _ODD) & ~_LOW
    key |= _LOW - np.arange(grams, dtype=np.uint64)
    size = 1
    while size < SPAN:
        step = min(size, SPAN - size)
        key = np.minimum(key[:-step], key[step:])
        size += step
    begin, end = ends[:-1], ends[1:]
    long = end - begin >= LENGTH
    edge = np.zeros(len(raw) + 2, np.int32)
    np.add.at(edge, begin[long], 1)
    np.add.at(edge, end[long] - SPAN - GRAM + 2, -1)
    inside = np.cumsum(edge)[:len(key)] > 0
    place = (_LOW - (key[inside] & _LOW)).astype(np.int64)
    place = place[np.flatnonzero(np.diff(place, prepend=-1))]
    return place, np.searchsorted(ends, place, "right") - 1


def described(raw: np.ndarray, ends: np.ndarray, hashes: PrimeHash) -> dict[str, np.ndarray]:
    """Of each anchor with strings: its text, the first start and the number of starts (packed, 8 bits
    for the number), and the hashes of its core and its surroundings."""
    place, text = anchors(raw, ends)
    begin, end = ends[text], ends[text + 1]
    before = np.full(len(place), -1)
    before[1:] = np.where(text[1:] == text[:-1], place[:-1], -1)
    low = np.maximum(np.where(before >= 0, before - SPAN + 2, begin), begin)
    high = np.minimum(place - SPAN + 1, end - LENGTH)
    has = high >= low
    place, text, low, high, begin = place[has], text[has], low[has], high[has], begin[has]
    if not len(place):
        none = np.zeros(0, np.uint64)
        return {"text": text, "low": low, "core": none, "around": none}
    return {"text": text, "low": (low - begin) << 8 | (high - low + 1),
            "core": hashes(raw, place - SPAN + 1, place - 2 * SPAN + 2 + LENGTH),
            "around": in_text(hashes(raw, low, high + LENGTH), place - low)}


def _described(docs: DataFrame, full: bool) -> DataFrame:
    """One row per anchor of ``docs`` (k1, k2, text); without ``full`` only its core."""
    names = ["core", *(["k1", "k2", "low", "around"] if full else [])]
    schema = StructType([StructField(c, LongType()) for c in names])

    def run(batches):
        hashes = PrimeHash(1 << 21)
        for part in chunks(batches, "text"):
            raw, ends = joined(part["text"])
            d = described(raw, ends, hashes)
            columns = [pa.array(d["core"].view(np.int64))]
            if full:
                text = pa.array(d["text"])
                columns += [part["k1"].take(text), part["k2"].take(text), pa.array(d["low"]),
                            pa.array(d["around"].view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names)

    return in_batches(docs, run, schema)


def repeated_cores(docs: DataFrame) -> DataFrame:
    """Anchors of ``docs`` whose core isn't unique, equal texts as one with a multiplicity."""
    twice = _described(docs.select("text"), False).groupBy("core").agg(F.count("*").alias("n")) \
        .where("n > 1").select("core")
    rows = _described(docs, True).join(twice, "core", "left_semi")
    return written(rows.groupBy(*rows.columns).agg(F.count("*").alias("copies")), "strings-cores")


def _settle(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(covered, unsettled) anchors with strings: the second with ``alone`` for those to be decided.

    Of equal surroundings only one member is in the second, and only beside one to be decided.
    """
    alike = written(rows.groupBy("core", "around").agg(F.sum("copies").alias("n")), "strings-alike")
    cores = alike.groupBy("core").agg(F.count("*").alias("kinds"), F.min("n").alias("least"))
    kinds = alike.join(cores, "core").where("n > 1 or kinds > 1").select(
        "core", "around", "n", F.expr("kinds > 1 and least = 1").alias("mixed"))
    rows = written(rows.join(kinds, ["core", "around"]).select("k1", "k2", "low", "core", "around", "n", "mixed"),
                   "strings-pairs")
    mixed = rows.where("mixed")
    alone = mixed.where("n = 1").select("k1", "k2", "low", "core", F.lit(True).alias("alone"))
    member = mixed.where("n > 1").groupBy("core", "around").agg(F.min(F.struct("k1", "k2", "low")).alias("m")) \
        .select("m.*", "core", F.lit(False).alias("alone"))
    unsettled = alone.unionByName(member).withColumn("anchor", F.monotonically_increasing_id())
    return rows.where("n > 1").select("k1", "k2", "low"), written(unsettled, "strings-unsettled")


def _strings(texts: DataFrame) -> DataFrame:
    """(w, at) of each string of the unsettled anchors (text, todo): its hash, and the anchor, the number
    of the string among the anchor's (8 bits) and whether it is to be decided (1 bit)."""
    schema = StructType([StructField("w", LongType()), StructField("at", LongType())])

    def run(batches):
        hashes = PrimeHash(1 << 18)
        for batch in batches:
            for k in range(batch.num_rows):
                raw = np.frombuffer(batch["text"][k].as_buffer(), np.uint8)
                todo = batch["todo"][k].values
                low, core, anchor = (todo.field(c).to_numpy() for c in ("low", "core", "anchor"))
                alone = todo.field("alone").to_numpy(zero_copy_only=False)
                size = low & 255
                number = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                p = np.repeat(low >> 8, size) + number
                w = hashes(raw, p, p + LENGTH) ^ np.repeat(core.view(np.uint64), size)
                at = np.repeat(anchor << 9 | alone, size) | number << 1
                yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(at)], schema.names)

    return in_batches(texts.select("text", "todo"), run, schema)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, spans) of every row: ``spans`` are the (first, end) byte ranges of repeated strings,
    unordered and overlapping; null where the text has none. The text is null there too, with ``size``
    and ``digest`` in its place, since nothing of it changes."""
    keyed = docs.select(quoted(id_col).alias("id"), text_of(text_col).alias("text")).select(
        "id", "text", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"))
    cores = repeated_cores(keyed.select("k1", "k2", "text"))
    release(docs)
    covered, unsettled = _settle(cores)
    release(docs)
    touched = covered.select("k1", "k2").unionByName(unsettled.select("k1", "k2")).distinct() \
        .withColumn("touched", F.lit(True))
    rows = keyed.join(touched, ["k1", "k2"], "left")
    rows = written(rows.select(
        "id", F.when(F.col("touched"), F.col("text")).alias("text"), "k1", "k2",
        F.octet_length("text").cast("long").alias("size"),
        F.when(F.col("touched").isNull(), F.sha2("text", 256)).alias("digest")), "strings-rows")
    release(docs)

    todo = unsettled.groupBy("k1", "k2").agg(
        F.collect_list(F.struct("low", "core", "anchor", "alone")).alias("todo"))
    once = written(rows.where("text is not null").join(todo, ["k1", "k2"]).dropDuplicates(["k1", "k2"])
                   .select("text", "todo"), "strings-texts")
    twice = _strings(once).groupBy("w").agg(F.count("*").alias("n")).where("n > 1").select("w")
    found = _strings(once).where("at % 2 = 1").join(twice, "w", "left_semi").select(
        F.shiftright("at", 9).alias("anchor"), F.shiftright("at", 1).bitwiseAND(255).alias("number"))
    found = written(found.groupBy("anchor").agg(F.collect_set("number").alias("numbers")), "strings-found")
    release(docs)
    first = F.shiftright("low", 8)
    single = found.join(unsettled, "anchor").select("k1", "k2", first.alias("first"), "numbers")
    runs = single.select("k1", "k2", F.transform("numbers", lambda i: F.struct(
        (F.col("first") + i).alias("first"), (F.col("first") + i + LENGTH).alias("end"))).alias("part"))
    whole = covered.select("k1", "k2", F.array(F.struct(
        first.alias("first"), (first + F.col("low").bitwiseAND(255) - 1 + LENGTH).alias("end"))).alias("part"))
    spans = whole.unionByName(runs).groupBy("k1", "k2").agg(F.flatten(F.collect_list("part")).alias("spans"))
    return rows.join(spans, ["k1", "k2"], "left").select("id", "text", "size", "digest", "spans")


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row of ``docs``.

    ``kept`` is what is left of the text's bytes, null where all of it stays. Null counts as empty; texts of
    fewer than LENGTH bytes stay; repeated rows are places of their own, so both go; an empty
    table gives an empty result.
    """
    rows = repeated_spans(docs, id_col, text_col)
    touched = rows.where("spans is not null")
    schema = StructType([rows.schema["id"], StructField("size", LongType()), StructField("n_removed", LongType()),
                         StructField("n_spans", LongType()), StructField("digest", StringType()),
                         StructField("kept", touched.select(F.col("text").cast("binary").alias("b")).schema["b"].dataType)])

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                raw = np.frombuffer(batch["text"][k].as_buffer(), np.uint8)
                spans = batch["spans"][k].values
                edge = np.zeros(len(raw) + 1, np.int64)
                np.add.at(edge, spans.field("first").to_numpy(), 1)
                np.add.at(edge, spans.field("end").to_numpy(), -1)
                gone = np.cumsum(edge)[:-1] > 0
                runs = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
                kept = raw[~gone].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch["id"].slice(k, 1), pa.array([len(raw)]), pa.array([int(gone.sum())]), pa.array([runs]),
                     pa.array([hashlib.sha256(kept).hexdigest()]), pa.array([kept], pa.binary())], schema.names)

    cut = in_batches(touched.select("id", "text", "spans"), run, schema)
    whole = rows.where("spans is null").select(
        "id", "size", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"),
        F.coalesce("digest", F.sha2("text", 256)).alias("digest"), F.lit(None).cast("binary").alias("kept"))
    return cut.unionByName(whole).select(
        F.col("id").alias("doc_id"), F.col("size").alias("n_bytes"), "n_removed", "n_spans",
        F.col("digest").alias("kept_sha256"), "kept")


def repeated_report(docs: DataFrame) -> DataFrame:
    """The columns of :func:`remove_repeated`, which says what nulls, repeats and empty tables give; what is left comes
    as a text (null where all of it stays), half characters at cuts as U+FFFD."""
    return remove_repeated(docs).withColumn("kept", F.make_valid_utf8(F.col("kept").cast("string")))
