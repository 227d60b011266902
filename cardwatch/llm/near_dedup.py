"""Near duplicates: consistent weighted sampling of TF-IDF shingles, bands, weighted Jaccard.

A shingle is five words; its weight is its count in the text times the mean weight of its words, and a
word weighs more the fewer documents hold it. Improved consistent weighted sampling draws one shingle
per sample so that two texts draw the same with the probability of their weighted Jaccard similarity;
three samples make a band. Texts that are equal word for word are one node from the start.

Every bucket (texts with an equal band) of up to ``SMALL`` texts has all its pairs checked. A larger one
compares all its texts with its hub, then those that aren't of the hub's class with further leaders; then
all its pairs between classes are checked block by block, texts left alone against each other and against
the hub's class. No pair is left out but within a class. No bucket is cut, and nothing is collected. A pair goes to
the exact check unless its samples put it far below the limit. Classes are connected components of links.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from cardwatch.llm.common import SPACE, in_batches, quoted, text_of, written
from cardwatch.llm.fragments import PrimeHash, chunks, joined
from cardwatch.llm.graph import components
from cardwatch.llm.words import in_text, per_text, windows, word_ranges

SHINGLE, LIMIT = 5, 0.8
#: Bands, samples of each, entries of the table of random draws.
BANDS, ROWS, DRAWS = 13, 3, 1 << 16
#: Equal samples below which a pair can't reach the limit but by a chance of about 1 in 20,000.
LEAST_EQUAL = 21
#: Texts of a bucket whose pairs are all checked; leaders of a larger one besides its hub.
SMALL, LEADERS = 16, 2
#: Texts and bytes of a block of a larger bucket; shingles of two blocks that are compared at a time.
BLOCK_TEXTS, BLOCK_BYTES, COLUMNS = 1024, 4 << 20, 2048
#: Hash buckets of words whose document frequency is counted; the largest weight of a word (least: 1).
WORDS, HEAVIEST = 1 << 16, 1.5


class Shingles:
    """Shingles of many texts: places by text, distinct hashes, weights."""

    def __init__(self, idf: np.ndarray):
        self.idf, self.hash = idf.astype(np.float32), PrimeHash()

    def __call__(self, raw, ends):
        """(hash, weight, first): distinct shingles, sorted by hash within each text.

        A text of one to four words has one shingle, the words it has.
        """
        start, stop = word_ranges(raw, ends)
        word = self.hash(raw, start, stop)
        first = np.searchsorted(start, ends)
        n, text = len(first) - 1, per_text(first)
        weight = self.idf[(word >> np.uint64(48)).astype(np.int64)]
        run = windows(word, SHINGLE)
        whole = np.flatnonzero(text[:len(run)] == text[SHINGLE - 1:]) if len(run) else np.zeros(0, np.int64)
        total = np.concatenate([[0.0], np.cumsum(weight, dtype=np.float64)])
        keys = [run[whole]]
        weights = [(total[whole + SHINGLE] - total[whole]) / SHINGLE]
        texts = [text[whole]]
        size = np.diff(first)
        short = np.flatnonzero((size > 0) & (size < SHINGLE))
        for k in short:
            part = word[first[k]:first[k + 1]]
            keys.append(windows(part, len(part)))
            weights.append([(total[first[k + 1]] - total[first[k]]) / len(part)])
            texts.append([k])
        key, weight = np.concatenate(keys), np.concatenate(weights)
        text = np.concatenate(texts).astype(np.int64)
        order = np.lexsort((key, text)) if len(short) else self._by_text(key, text)
        key, weight, text = key[order], weight[order], text[order]
        new = np.flatnonzero((np.diff(key, prepend=key[:1] + np.uint64(1)) != 0) | (np.diff(text, prepend=-1) != 0))
        count = np.diff(np.append(new, len(key)))
        return key[new], (weight[new] * count).astype(np.float32), np.searchsorted(text[new], np.arange(n + 1))

    @staticmethod
    def _by_text(key, text):
        """Texts stand in a row already; sort each one's keys."""
        edge = np.flatnonzero(np.diff(text, prepend=-1)).tolist()
        return np.concatenate([a + np.argsort(key[a:b]) for a, b in
                               zip(edge, [*edge[1:], len(key)], strict=True)]) if edge else np.zeros(0, np.int64)


class Sampler:
    """Improved consistent weighted sampling (Ioffe) with draws from a table."""

    def __init__(self):
        random, k = np.random.default_rng(17), BANDS * ROWS
        self.step, self.inverse, self.beta, self.base = np.empty((4, k, DRAWS), np.float32)
        for i in range(k):  # one sample at a time, for little memory beside the tables
            gamma, c = random.gamma(2.0, 1.0, DRAWS), random.gamma(2.0, 1.0, DRAWS)
            beta = random.random(DRAWS)
            self.step[i], self.inverse[i], self.beta[i] = gamma, 1 / gamma, beta
            self.base[i] = np.log(c) + gamma * (beta - 1)
        self.odd = random.integers(0, 2**32, k, dtype=np.uint32) | np.uint32(1)

    def __call__(self, key: np.ndarray, weight: np.ndarray, first: np.ndarray) -> np.ndarray:
        """A (texts, samples) table of drawn shingles and levels, hashed; texts without shingles get 0."""
        out = np.zeros((len(first) - 1, BANDS * ROWS), np.uint64)
        full = np.flatnonzero(np.diff(first) > 0)
        if not len(full):
            return out
        begin = first[:-1][full]
        low, log = (key ^ (key >> np.uint64(32))).astype(np.uint32), np.log(weight).astype(np.float32)
        place = np.arange(len(key), dtype=np.uint64)
        for k, odd in enumerate(self.odd):
            draw = (low * odd) >> np.uint32(16)
            level = np.floor(log * self.inverse[k][draw] + self.beta[k][draw])
            value = self.base[k][draw] - self.step[k][draw] * level
            bits = value.view(np.uint32)  # floats as integers of the same order
            bits = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31))
            least = np.minimum.reduceat((bits.astype(np.uint64) << np.uint64(32)) | place, begin)
            at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
            out[full, k] = in_text(key[at], level[at].astype(np.int64) + 4096)
        return out


def word_weights(docs: DataFrame) -> np.ndarray:
    """For each hash bucket of words a weight from 1 (held by all documents) to ``HEAVIEST`` (by one).

    The document frequencies are counted over all documents; the driver gets one number per bucket.
    """
    schema = StructType([StructField("word", IntegerType()), StructField("df", LongType())])

    def run(batches):
        df, last, hashes = np.zeros(WORDS, np.int64), np.zeros(WORDS, np.int64), PrimeHash()
        total = 0
        for part in chunks(batches, "text"):
            raw, ends = joined(part["text"])
            start, stop = word_ranges(raw, ends)
            bucket = (hashes(raw, start, stop) >> np.uint64(48)).astype(np.int64)
            first = np.searchsorted(start, ends)
            total += len(part)
            for a, b in zip(first[:-1], first[1:], strict=True):
                own, place = bucket[a:b], np.arange(b - a)
                last[own] = place  # one place of each bucket stays
                df[own[last[own] == place]] += 1
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(held, -1).astype(np.int32)), pa.array(np.append(df[held], total))], schema.names)

    rows = in_batches(docs.select("text"), run, schema).groupBy("word").agg(F.sum("df").alias("df")).collect()
    counted = {r.word: r.df for r in rows}
    n = max(2, counted.pop(-1, 0) + 1)
    df = np.ones(WORDS)
    df[list(counted)] = list(counted.values())
    return 1 + (HEAVIEST - 1) * np.log(n / df).clip(0) / np.log(n)


def signatures(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """``docs`` (its text left out) with ``bands``, the band keys, and ``samples``, the sample hashes."""
    rest = [c for c in docs.columns if c != "text"]
    schema = StructType([*docs.drop("text").schema, StructField("bands", ArrayType(LongType())),
                         StructField("samples", ArrayType(IntegerType()))])

    def run(batches):
        shingles, sampler = Shingles(idf), Sampler()
        for part in chunks(batches, "text", 1 << 20):
            drawn = sampler(*shingles(*joined(part["text"])))
            n = len(part)
            keys = np.stack([windows(row, ROWS)[::ROWS] for row in drawn]) if n else drawn[:, :BANDS]
            bands = pa.ListArray.from_arrays(
                pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(keys.reshape(-1).view(np.int64)))
            samples = pa.ListArray.from_arrays(
                pa.array(np.arange(n + 1, dtype=np.int32) * BANDS * ROWS),
                pa.array((drawn >> np.uint64(32)).astype(np.uint32).reshape(-1).view(np.int32)))
            yield pa.RecordBatch.from_arrays([*[part[c] for c in rest], bands, samples], schema.names)

    return in_batches(docs.select(*rest, "text"), run, schema)


class Verifier:
    """Checks pairs of nodes: first their samples, then the weighted Jaccard similarity of their texts."""

    def __init__(self, samples: DataFrame, texts: DataFrame, idf: np.ndarray, limit: float):
        self.samples, self.texts = samples, texts
        self.idf, self.limit = idf, limit

    def _with(self, pairs, table, key, column):
        side = table.select(F.col("node").alias(key), F.col(column).alias(f"{column}_{key}"))
        return pairs.join(side, key)

    def links(self, pairs: DataFrame) -> DataFrame:
        """(a, b, similarity) of the pairs (a, b) that reach the limit, written."""
        near = self._with(self._with(pairs, self.samples, "a", "samples"), self.samples, "b", "samples")
        equal = F.aggregate(F.zip_with("samples_a", "samples_b", lambda x, y: (x == y).cast("int")),
                            F.lit(0), lambda n, x: n + x)
        near = written(near.where(equal >= LEAST_EQUAL).select("a", "b"), "near-pairs")
        full = self._with(self._with(near, self.texts, "b", "text"), self.texts, "a", "text")
        idf, limit = self.idf, self.limit

        def run(batches):
            shingles, known = Shingles(idf), (None, None)
            for batch in batches:
                hit = []
                a, b = batch["a"].to_pylist(), batch["b"].to_pylist()
                for k in range(batch.num_rows):
                    if known[0] != a[k]:  # rows come sorted by a, so a hub is read once
                        known = a[k], shingles(*joined(batch["text_a"].slice(k, 1)))[:2]
                    s = similarity(known[1], shingles(*joined(batch["text_b"].slice(k, 1)))[:2])
                    if s >= limit:
                        hit.append((a[k], b[k], s))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([h[0] for h in hit], pa.int64()), pa.array([h[1] for h in hit], pa.int64()),
                     pa.array([h[2] for h in hit], pa.float64())], ["a", "b", "similarity"])

        return written(in_batches(full.select("a", "b", "text_a", "text_b"), run, "a long, b long, similarity double"), "near-links")


def similarity(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (sorted hashes, weights); two empty ones are equal."""
    (ka, wa), (kb, wb) = x, y
    if not len(ka) or not len(kb):
        return float(len(ka) == len(kb))
    at = np.minimum(np.searchsorted(kb, ka), len(kb) - 1)
    same = kb[at] == ka
    least = float(np.minimum(wa[same], wb[at[same]]).sum(dtype=np.float64))
    return least / (float(wa.sum(dtype=np.float64)) + float(wb.sum(dtype=np.float64)) - least)


def _labelled(rows: DataFrame, label: DataFrame, key: str, out: str) -> DataFrame:
    """The component of column ``key``; a node without links is its own."""
    side = label.select(F.col("node").alias(key), F.col("component").alias(out))
    return rows.join(side, key, "left").withColumn(out, F.coalesce(out, key))


class Classes:
    """Links found so far, the classes they make, and the pairs that need no second check."""

    def __init__(self, check: Verifier):
        spark = check.texts.sparkSession
        self.check = check
        self.links = spark.createDataFrame([], "a long, b long, similarity double")
        self.label = spark.createDataFrame([], "node long, component long")
        self.tested = spark.createDataFrame([], "a long, b long")

    def named(self, rows: DataFrame, key: str, out: str) -> DataFrame:
        return _labelled(rows, self.label, key, out)

    def settle(self, pairs: DataFrame) -> None:
        """Check the pairs (a < b) that are new, and merge the classes of those that are links."""
        fresh = written(pairs.distinct().join(self.tested, ["a", "b"], "left_anti"), "near-fresh")
        if fresh.isEmpty():
            return
        self.tested = self.tested.unionByName(fresh)
        self.merge(self.check.links(fresh))

    def merge(self, found: DataFrame) -> None:
        """Merge the classes that the links (a, b, similarity) join."""
        if found.isEmpty():
            return
        self.links = self.links.unionByName(found)
        between = self.named(self.named(found, "a", "x"), "b", "y").select(
            F.col("x").alias("a"), F.col("y").alias("b"))
        merged = written(components(between), "near-merged")  # of classes, and of nodes that had none
        merged = merged.withColumnRenamed("component", "into")
        old = self.label.join(merged.withColumnRenamed("node", "component"), "component", "left").select(
            "node", F.coalesce("into", "component").alias("component"))
        new = merged.join(self.label, "node", "left_anti").select("node", F.col("into").alias("component"))
        self.label = written(old.unionByName(new), "near-labels")


def node_links(nodes: DataFrame, check: Verifier) -> tuple[DataFrame, DataFrame]:
    """All links found and the components of the linked nodes; ``nodes`` has node and bands."""
    band = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    buckets = band.select(F.xxhash64("band", "key").alias("bucket"), "band", "node")
    classes = Classes(check)
    sized = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = written(buckets.join(sized, "bucket"), "near-sized")
    if members.isEmpty():
        return classes.links, classes.label
    members = written(_with_hubs(members), "near-buckets")
    classes.settle(_to_hub(classes, members))
    far = _to_leaders(classes, members)
    classes.settle(_in_small(classes, members).unionByName(far))
    classes.merge(_in_large(classes, members))
    return classes.links, classes.label


def _with_hubs(members: DataFrame) -> DataFrame:
    """Each bucket's hub: the text that shares its buckets with most others, as the original of many
    copies does; of equal ones the first."""
    near = members.groupBy("node").agg(F.sum("n").alias("near"))
    hubs = members.join(near, "node").groupBy("bucket").agg(
        F.max_by("node", F.struct(F.col("near"), -F.col("node"))).alias("hub"))
    return members.join(hubs, "bucket")


def _to_hub(classes: Classes, members: DataFrame) -> DataFrame:
    """Each text with the hub of its bucket, unless they are of one class."""
    named = classes.named(classes.named(members.where("node <> hub"), "node", "c"), "hub", "h")
    return named.where("c <> h").select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b"))


def _to_leaders(classes: Classes, members: DataFrame) -> DataFrame:
    """In large buckets, each text that isn't of the hub's class with further leaders of the bucket."""
    many = classes.named(classes.named(members.where(F.col("n") > SMALL), "node", "c"), "hub", "h")
    order = [F.xxhash64("bucket", "node", F.lit(i)) for i in range(LEADERS)]
    lead = members.where(F.col("n") > SMALL).groupBy("bucket").agg(
        F.array_distinct(F.array(*[F.min_by("node", o) for o in order])).alias("lead"))
    far = many.where("c <> h").join(lead, "bucket").select("node", "c", F.explode("lead").alias("leader"))
    far = classes.named(far, "leader", "d").where("c <> d")
    return far.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b"))


def _in_small(classes: Classes, members: DataFrame) -> DataFrame:
    """All pairs of a small bucket that aren't of one class (those with the hub are known)."""
    few = classes.named(members.where((F.col("n") <= SMALL) & (F.col("n") > 2)), "node", "c").where("node <> hub")
    few = written(few.select("bucket", "node", "c"), "near-small")
    other = few.select("bucket", F.col("node").alias("b"), F.col("c").alias("d"))
    return few.join(other, (few["bucket"] == other["bucket"]) & (F.col("node") < F.col("b")) & (
        F.col("c") != F.col("d"))).select(F.col("node").alias("a"), "b")


def _in_large(classes: Classes, members: DataFrame) -> DataFrame:
    """(a, b, similarity): links that join all classes which pairs of large buckets join, written.

    A bucket's texts outside its hub's class, and those of it, are dealt into blocks by hash. Each pair
    of blocks but two of the hub's class is one group of rows, which holds all it needs.
    """
    check = classes.check
    many = classes.named(classes.named(members.where(F.col("n") > SMALL), "node", "c"), "hub", "h")
    many = written(many.select("bucket", "band", "node", "c", (F.col("c") != F.col("h")).alias("far")), "near-many")
    sizes = check.texts.select("node", F.octet_length("text").cast("long").alias("bytes"))
    blocks = lambda side: F.ceil(F.greatest(
        F.count(F.when(side, 1)) / BLOCK_TEXTS, F.sum(F.when(side, F.col("bytes")).otherwise(0)) / BLOCK_BYTES))
    dealt = many.join(sizes, "node").groupBy("bucket").agg(
        blocks(F.col("far")).alias("k_far"), blocks(~F.col("far")).alias("k_near")).where("k_far > 0")
    own = F.pmod(F.xxhash64("node", F.lit(7)), F.when(F.col("far"), F.col("k_far")).otherwise(F.col("k_near")))
    to_far, to_near = (F.sequence(F.lit(0).cast("long"), F.col(k) - 1) for k in ("k_far", "k_near"))
    group = lambda near, i, j: F.struct(F.lit(near).alias("near"), i.alias("i"), j.alias("j"))
    block = F.col("block")
    mates = F.when(F.col("far"), F.concat(
        F.transform(to_far, lambda j: group(False, F.least(block, j), F.greatest(block, j))),
        F.transform(to_near, lambda j: group(True, block, j)))).otherwise(
        F.transform(to_far, lambda i: group(True, i, block)))
    # Of two blocks of one kind, the rows of the lower one are left; of one with itself, each is both.
    placed = many.join(dealt, "bucket").withColumn("block", own).withColumn("g", F.explode(mates)).select(
        "bucket", "band", "node", "c", (F.col("far") & (F.col("block") == F.col("g.i"))).alias("left"),
        F.when(F.col("g.near"), ~F.col("far")).otherwise(F.col("block") == F.col("g.j")).alias("right"), "g.*")
    placed = written(placed, "near-placed")
    rows = placed.join(check.samples, "node").join(check.texts, "node")
    idf, limit, held = check.idf, check.limit, {}

    def run(frame):
        if not held:
            held["shingles"] = Shingles(idf)
        found = block_links(frame, held["shingles"], limit)
        return pd.DataFrame(found, columns=["a", "b", "similarity"]).astype(
            {"a": "int64", "b": "int64", "similarity": "float64"})

    return written(rows.groupBy("bucket", "near", "i", "j").applyInPandas(
        run, "a long, b long, similarity double"), "near-block-links")


def block_links(frame: pd.DataFrame, shingles: Shingles, limit: float) -> list[tuple[int, int, float]]:
    """Links (a, b, similarity) between the left and the right rows, as many as join the classes they join.

    A pair belongs to the first band it shares, the samples of which are equal.
    """
    frame = frame.sort_values("node", ignore_index=True)
    samples, node, name = np.stack(frame["samples"].to_numpy()), frame["node"].to_numpy(), frame["c"].to_numpy()
    left, right = (np.flatnonzero(frame[side].to_numpy()) for side in ("left", "right"))
    if not len(left) or not len(right):
        return []
    maybe = name[left][:, None] != name[right][None, :]
    equal, own = np.zeros(maybe.shape, np.int8), int(frame["band"].iloc[0])
    for k in range(BANDS):
        shared = np.ones(maybe.shape, bool)
        for r in range(k * ROWS, (k + 1) * ROWS):
            same = samples[left, r][:, None] == samples[right, r][None, :]
            equal += same
            shared &= same
        if k < own:
            maybe &= ~shared
    maybe &= equal >= LEAST_EQUAL
    left, maybe = left[maybe.any(1)], maybe[maybe.any(1)]
    right, maybe = right[maybe.any(0)], maybe[:, maybe.any(0)]
    if not maybe.size:
        return []
    used = np.union1d(left, right)
    key, weight, first = shingles(*joined(pa.array(frame["text"].to_numpy()[used], pa.large_string())))
    parts = {row: (key[x:y], weight[x:y]) for row, x, y in zip(used.tolist(), first[:-1], first[1:], strict=True)}
    maybe &= _bound([parts[x] for x in left.tolist()], [parts[x] for x in right.tolist()]) >= limit - 1e-3
    root = {c: c for c in name[used].tolist()}

    def top(c):
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    out = []
    for x, y in zip(*(at.tolist() for at in np.nonzero(maybe)), strict=True):
        a, b = left[x], right[y]
        one, two = top(name[a]), top(name[b])
        if one != two:
            s = similarity(parts[a], parts[b])
            if s >= limit:
                root[one] = two
                out.append((min(node[a], node[b]), max(node[a], node[b]), s))
    return out


def _bound(left: list, right: list) -> np.ndarray:
    """A similarity that no pair of (sorted hashes, weights) exceeds but by rounding: the geometric mean of
    two weights for the lesser, which is the same where they are equal."""
    total = [np.array([w.sum(dtype=np.float64) for _, w in side]) for side in (left, right)]
    flat = []
    for side in (left, right):
        text = np.repeat(np.arange(len(side)), [len(k) for k, _ in side])
        flat.append((np.concatenate([k for k, _ in side]), text, np.sqrt(np.concatenate([w for _, w in side]))))
    shared = np.intersect1d(flat[0][0], flat[1][0])
    least = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, len(shared), COLUMNS):
        part, dense = shared[at:at + COLUMNS], []
        for (k, text, w), side in zip(flat, (left, right), strict=True):
            place = np.minimum(np.searchsorted(part, k), len(part) - 1)
            held = part[place] == k
            table = np.zeros((len(side), len(part)), np.float32)
            table[text[held], place[held]] = w[held]
            dense.append(table)
        least += dense[0] @ dense[1].T
    both = total[0][:, None] + total[1][None, :]
    none = (total[0] == 0)[:, None] & (total[1] == 0)[None, :]
    return np.where(none, 1.0, least / np.maximum(both - least, 1e-9))


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 limit: float = LIMIT) -> tuple[DataFrame, DataFrame]:
    """Rows (uid, id, hash, node, component) of ``docs`` and the links between nodes.

    Null counts as empty; texts without words are one class; repeated rows share a node; an empty
    table has no rows and no links.
    """
    text = text_of(text_col)
    words = F.trim(F.regexp_replace(text, SPACE + "+", " "))
    # The words of a text, one blank between them: texts that agree in them are equal here.
    slim = docs.select(quoted(id_col).alias("id"), F.unhex(F.substring(F.sha2(words, 256), 1, 32)).alias("hash"),
                       text.alias("text"))
    idf = word_weights(slim)
    drawn = written(signatures(slim.withColumn("uid", F.monotonically_increasing_id()), idf), "near-signatures")
    first = drawn.groupBy("hash").agg(F.min("uid").alias("node")).withColumnRenamed("hash", "h")
    nodes = written(drawn.join(first, F.col("uid") == F.col("node")).select(
        "node", "hash", "id", "bands", "samples"), "near-nodes")
    rows = written(drawn.select("uid", "id", "hash").join(nodes.select("hash", "node"), "hash"), "near-rows")

    band = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    shared = band.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    wanted = written(band.join(shared, ["band", "key"]).select("node").distinct(), "near-wanted")
    held = nodes.select("node", F.col("hash").alias("h"), F.col("id").alias("i")).join(wanted, "node")
    texts = slim.join(held, (F.col("hash") == F.col("h")) & F.col("id").eqNullSafe(F.col("i")))
    texts = written(texts.select("node", "text").dropDuplicates(["node"]), "near-texts")
    samples = written(nodes.select("node", "samples").join(wanted, "node"), "near-samples")
    links, label = node_links(nodes.select("node", "bands"), Verifier(samples, texts, idf, limit))
    return _labelled(rows, label, "node", "component"), links


def _firsts(rows: DataFrame) -> DataFrame:
    """(component, class_id, first, group_size): the row with the least id; a missing id comes last."""
    order = F.struct(F.col("id").isNull().alias("none"), "id", "uid")
    return rows.groupBy("component").agg(F.min(order).alias("o"), F.count("*").alias("group_size")).select(
        "component", F.col("o.id").alias("class_id"), F.col("o.uid").alias("first"), "group_size")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, group_size, n_links, kept) of every row; one row of each class is kept.

    ``n_links`` counts the links found between the row's text and other texts.
    """
    rows, links = near_classes(docs, id_col, text_col)
    rows = written(rows, "near-classes")
    ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node")))
    degree = ends.groupBy("node").agg(F.count("*").alias("n_links"))
    out = rows.join(_firsts(rows), "component").join(degree, "node", "left")
    return out.select(F.col("id").alias("doc_id"), "class_id", "group_size",
                      F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
                      (F.col("uid") == F.col("first")).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, with the columns of ``docs`` unchanged."""
    rows, _ = near_classes(docs, id_col, text_col)
    rows = written(rows, "near-classes")
    kept = rows.join(_firsts(rows), "component").where("uid = first").select(
        F.col("id").alias("_kept_id"), F.col("hash").alias("_kept_hash"))
    words = F.trim(F.regexp_replace(text_of(text_col), SPACE + "+", " "))
    names = [quoted(c) for c in docs.columns]
    keyed = docs.select(F.struct(*names).alias("_row"), quoted(id_col).alias("_id"),
                        F.unhex(F.substring(F.sha2(words, 256), 1, 32)).alias("_hash"))
    out = keyed.join(kept, (F.col("_hash") == F.col("_kept_hash")) & F.col("_id").eqNullSafe(F.col("_kept_id")))
    repeated = rows.groupBy("id", "hash").agg(F.count("*").alias("n")).where("n > 1").limit(1)
    if not repeated.isEmpty():  # rows with equal id and words: any one of them stays
        out = out.dropDuplicates(["_id", "_hash"])
    return out.select("_row.*")
