"""Quality classifier: Naive Bayes support vectors over byte n-gram indicators.

Training texts become sets of hashed byte trigrams and of runs of repeated words. Each indicator is scaled by the log ratio of its
smoothed counts in the two classes, rows are brought to unit length, and a linear hinge-loss model is
fitted by dual coordinate descent. A logistic curve through margins of texts left out of the fit turns
margins into probabilities at the classes' true shares. The fit uses a bounded sample of the labelled
rows (``per_class`` of each class, by hash of the id); scoring is one narrow pass over all documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, StructField, StructType

from cardwatch.llm.common import bundled, in_batches, quoted, text_of, unbundled
from cardwatch.llm.fragments import RangeHash, chunks, joined
from cardwatch.llm.words import word_ranges

#: Bits of a hashed trigram; places of all indicators (32 runs of words follow the trigrams).
BITS = 18
SIZE = (1 << BITS) + 32
#: Labelled texts of each class that are used at most: the bound of the sample.
PER_CLASS = 6000
#: Smoothing of counts, cost of the hinge loss, passes, share of the sample kept for the curve.
SMOOTH, COST, PASSES, CURVE = 1.0, 4.0, 12, 0.25
#: A text is predicted to be good from this score on.
THRESHOLD = 0.3


def indicators(raw: np.ndarray, repeats: np.ndarray) -> np.ndarray:
    """Hashed n-grams of one text: byte trigrams, and runs of five words by which repeat the one before.

    ``repeats`` has for each word whether it is the word before it once more.
    """
    found = []
    if len(raw) >= 3:
        x = raw.astype(np.uint32)
        gram = x[:-2] | x[1:-1] << np.uint32(8) | x[2:] << np.uint32(16)
        found.append(((gram * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64))
    if len(repeats) >= 5:
        flags = repeats.astype(np.int64)
        run = sum(flags[j:len(flags) - 4 + j] << j for j in range(5))
        found.append((1 << BITS) + run)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


class Distinct:
    """Keeps one of each value, by a table of the last place of each."""

    def __init__(self):
        self.last = np.zeros(SIZE, np.int64)

    def __call__(self, values: np.ndarray) -> np.ndarray:
        place = np.arange(len(values))
        self.last[values] = place
        return values[self.last[values] == place]


def features(part: pa.RecordBatch, text_col: str, hashes: RangeHash, distinct: Distinct) -> list[np.ndarray]:
    """The distinct indicators of each text of a batch."""
    raw, ends = joined(part[text_col])
    start, stop = word_ranges(raw, ends)
    word, first = hashes(raw, start, stop), np.searchsorted(start, ends)
    same = np.zeros(len(word), bool)
    same[1:] = word[1:] == word[:-1]
    same[first[:-1][first[:-1] < len(word)]] = False
    return [distinct(indicators(raw[a:b], same[i:j])) for a, b, i, j in zip(
        ends[:-1], ends[1:], first[:-1], first[1:], strict=True)]


@dataclass(frozen=True)
class Model:
    """Weights of scaled indicators, the ratios they are scaled by, intercept and curve."""

    weight: np.ndarray
    ratio: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, found: np.ndarray) -> float:
        norm = float(np.sqrt(np.square(self.ratio[found]).sum()))
        return self.bias + (float((self.weight[found] * self.ratio[found]).sum()) / norm if norm else 0.0)

    def score(self, found: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(found) + self.shift, -500, 500))))


def log_ratios(rows: list[np.ndarray], good: np.ndarray) -> np.ndarray:
    p, q = np.full(SIZE, SMOOTH), np.full(SIZE, SMOOTH)
    for found, y in zip(rows, good, strict=True):
        (p if y else q)[found] += 1
    return np.log(p / p.sum()) - np.log(q / q.sum())


def descend(rows: list[np.ndarray], good: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss with squared norm; the intercept is a feature of 1."""
    weight, bias = np.zeros(len(ratio)), 0.0
    norm = np.array([np.sqrt(np.square(ratio[found]).sum()) for found in rows])
    sign, alpha = np.where(good, 1.0, -1.0), np.zeros(len(rows))
    order = np.random.default_rng(11)
    for _ in range(PASSES):
        for i in order.permutation(len(rows)):
            found, y = rows[i], sign[i]
            x = ratio[found] / norm[i] if norm[i] else np.zeros(len(found))
            gradient = y * (weight[found] @ x + bias) - 1
            size = 2.0 if norm[i] else 1.0
            new = min(max(alpha[i] - gradient / size, 0.0), COST)
            step = (new - alpha[i]) * y
            if step:
                weight[found] += step * x
                bias += step
                alpha[i] = new
    return weight, bias


def curve(margin: np.ndarray, good: np.ndarray, share: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve, by Newton steps on smoothed targets (``share``: weights)."""
    target = np.where(good, (good.sum() + 1) / (good.sum() + 2), 1 / ((~good).sum() + 2))
    theta, x = np.array([1.0, 0.0]), np.stack([margin, np.ones(len(margin))], 1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        gradient = x.T @ (share * (p - target)) + 1e-6 * theta
        hessian = (x * (share * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        theta = theta - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(theta[0]), float(theta[1])


def held_out(id_col):
    """Rows that never teach: the checksum of the id's text, modulo 5, is 0. A missing id is left out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, id_col: str = "doc_id",
          text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit on the labelled rows that may teach. Without both classes the model gives the known share."""
    known = labels.select(quoted(id_col).alias("id"), quoted(label_col).cast("int").alias("good")).where(
        F.col("good").isin(0, 1) & ~held_out(F.col("id"))).dropDuplicates(["id"])
    share = {r.good: r["count"] for r in known.groupBy("good").count().collect()}
    picks = [known.where(F.col("good") == y).orderBy(F.xxhash64("id"), "id").limit(per_class) for y in (0, 1)]
    sample = picks[0].unionByName(picks[1])  # two bounded lists of ids
    rows = docs.select(quoted(id_col).alias("id"), text_of(text_col).alias("text")).join(F.broadcast(sample), "id")
    schema = StructType([rows.schema["id"], rows.schema["good"],
                         StructField("found", BinaryType())])

    def run(batches):
        hashes, distinct = RangeHash(), Distinct()
        for part in chunks(batches, "text"):
            found = [x.astype("<u4").tobytes() for x in features(part, "text", hashes, distinct)]
            yield pa.RecordBatch.from_arrays([part["id"], part["good"], pa.array(found, pa.binary())], schema.names)

    got = sorted(in_batches(rows, run, schema).collect(), key=lambda r: (str(r.id), bytes(r.found)))
    # the rows stay as they came, 4 bytes an indicator: this is what the driver holds
    return fit([np.frombuffer(r.found, "<u4") for r in got], np.array([r.good == 1 for r in got], bool), share)


def fit(rows: list[np.ndarray], good: np.ndarray, share: dict[int, int]) -> Model:
    """The model of the sampled rows; ``share`` has the classes' true sizes."""
    empty = np.zeros(SIZE)
    if len(rows) < 8 or good.all() or not good.any():
        known = (share.get(1, 0) + 1) / (share.get(0, 0) + share.get(1, 0) + 2)
        return Model(empty, empty, 0.0, 0.0, float(np.log(known / (1 - known))))
    mixed = np.random.default_rng(5).permutation(len(rows))
    kept = mixed[:max(1, int(len(rows) * CURVE))]
    rest = mixed[len(kept):]
    if good[rest].all() or not good[rest].any():
        kept = rest = mixed
    ratio = log_ratios([rows[i] for i in rest], good[rest])
    weight, bias = descend([rows[i] for i in rest], good[rest], ratio)
    raw = Model(weight, ratio, bias, 1.0, 0.0)
    margin = np.array([raw.margin(rows[i]) for i in kept])
    weights = np.where(good[kept], share.get(1, 1) / max(1, good.sum()), share.get(0, 1) / max(1, (~good).sum()))
    slope, shift = curve(margin, good[kept], weights / weights.mean())
    return Model(weight, ratio, bias, slope, shift)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All other columns of ``docs`` plus held_out, score and predicted, one row per row.

    The score depends on the text alone. Null and empty texts get the intercept's score; columns of
    ``docs`` that have the names of the results are replaced.
    """
    rest = [c for c in docs.columns if c not in (text_col, "held_out", "score", "predicted")]
    slim = docs.select(bundled(rest), held_out(quoted(id_col)).alias("held_out"), text_of(text_col).alias("text"))
    schema = StructType([slim.schema["row"], slim.schema["held_out"], StructField("score", DoubleType()),
                         StructField("predicted", IntegerType())])
    slim_model = Model(model.weight.astype(np.float32), model.ratio.astype(np.float32), model.bias,
                       model.slope, model.shift)  # 2 MB, whatever the corpus

    def run(batches):
        hashes, distinct = RangeHash(), Distinct()
        for part in chunks(batches, "text"):
            got = np.array([slim_model.score(x) for x in features(part, "text", hashes, distinct)])
            yield pa.RecordBatch.from_arrays(
                [part["row"], part["held_out"], pa.array(got), pa.array((got >= THRESHOLD).astype(np.int32))],
                schema.names)

    return in_batches(slim, run, schema).select(*unbundled(rest), "held_out", "score", "predicted")


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(docs.select("doc_id", "text"), labels.select("doc_id", "quality"))
    return score(docs.select("doc_id", "text"), model).select("doc_id", "held_out", "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` predicted to be good, with their columns unchanged."""
    model = train(docs, labels)
    slim = docs.select(quoted("doc_id").alias("doc_id"), text_of("text").alias("text"), bundled(docs.columns))
    return score(slim, model).where("predicted = 1").select(*unbundled(docs.columns))
