"""Quality rules: text statistics, base limits and robust multivariate outliers.

For each language and source the statistics of the documents that pass the base limits get a minimum
covariance determinant estimate: from medians and deviations, concentration steps take the mean and
covariance of the three quarters of the documents nearest to the last estimate, over all documents of
the cell, as combined aggregations. The estimate of a cell is drawn toward that of its language, and that
toward the corpus's, the more the fewer documents it has, so cells of any size have one. Documents beyond
a chi-square limit of Mahalanobis distance go.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from cardwatch.llm.common import in_batches, quoted, spread_join, text_of, written
from cardwatch.llm.fragments import PrimeHash, chunks, joined
from cardwatch.llm.words import again, in_text, line_ranges, per_text, told_apart, windows, word_ranges

#: Words of a repeated window; base limits: least words, largest share (per cent) of repeated words.
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
#: Documents that the wider estimate counts for in a narrower one; the share that an estimate covers; steps.
PRIOR, COVER, STEPS = 30, 0.75, 5
#: Chi-square quantiles for five dimensions: the median, and the limit (one in 10^7 of clean documents).
MEDIAN_5, LIMIT_5 = 4.35146, 41.1
#: Transformed statistics with the least deviation that counts as spread: without it, a cell in which
#: nearly all documents have no symbols would reject the first symbol.
FEATURES = {
    "f_length": ("ln(greatest(word_chars, 1) / greatest(n_words, 1))", 0.05),
    "f_symbols": ("sqrt(n_symbols / greatest(n_words, 1))", 0.04),
    "f_lines": ("sqrt(n_dup_lines / greatest(n_lines, 1))", 0.15),
    "f_repeats": ("sqrt(n_repeat_words / greatest(n_words, 1))", 0.12),
    "f_upper": ("sqrt(n_upper / greatest(word_chars, 1))", 0.03),
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper"]

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


def counts(raw: np.ndarray, ends: np.ndarray, hashes: PrimeHash) -> dict[str, np.ndarray]:
    """The counts of each text of a buffer. Lines and words are equal by their bytes; windows of words by 64 bits
    that mix the keys of their words."""
    n = len(ends) - 1
    start, stop = word_ranges(raw, ends)
    first = np.searchsorted(start, ends)
    text = per_text(first)

    def summed(mask):
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[ends[1:]] - total[ends[:-1]]

    begins = (raw & 0xC0) != 0x80
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    line_a, line_b = line_ranges(raw, ends)
    worded = np.searchsorted(start, line_b) > np.searchsorted(start, line_a)
    line_a, line_b = line_a[worded], line_b[worded]
    line_text = np.searchsorted(ends, line_a, "right") - 1
    later, _ = again(in_text(told_apart(raw, line_a, line_b, hashes(raw, line_a, line_b)), line_text))
    word = told_apart(raw, start, stop, hashes(raw, start, stop))
    run = windows(word, WINDOW)
    place = np.flatnonzero(text[:len(run)] == text[WINDOW - 1:]) if len(run) else np.zeros(0, np.int64)
    _, twice = again(in_text(run[place], text[place]))
    cover = np.zeros(len(start) + 1, np.int64)
    np.add.at(cover, place[twice], 1)
    np.add.at(cover, place[twice] + WINDOW, -1)
    repeated = np.cumsum(cover)[:-1] > 0
    return {
        "n_words": np.diff(first), "word_chars": summed(begins & ~blank), "n_symbols": summed(_SYMBOL[raw]),
        "n_dup_lines": np.bincount(line_text[later], minlength=n),
        "n_repeat_words": np.bincount(text[repeated], minlength=n),
        "n_lines": np.bincount(line_text, minlength=n), "n_upper": summed(_UPPER[raw])}


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without its text but with the counts of it. Null text has no words."""
    rest = [c for c in docs.columns if c != text_col and c not in COUNTS]
    slim = docs.select(*[quoted(c) for c in rest], text_of(text_col).alias(text_col))
    schema = StructType([*slim.drop(text_col).schema, *[StructField(c, LongType()) for c in COUNTS]])

    def run(batches):
        hashes = PrimeHash(1 << 21)
        for part in chunks(batches, text_col):
            raw, ends = joined(part[text_col])
            found = counts(raw, ends, hashes)
            yield pa.RecordBatch.from_arrays(
                [*[part[c] for c in rest], *[pa.array(found[c].astype(np.int64)) for c in COUNTS]], schema.names)

    return in_batches(slim, run, schema)


#: Keys of a document's cell, of its language and of the corpus; arrays, as they keep missing values.
LEVELS = ("to_json(array())", "to_json(array(lang))", "to_json(array(lang, source))")


def _shrunk(moments: DataFrame, keys: list[DataFrame]) -> DataFrame:
    """(cell, mean, cov) of every key from the (cell, n, mean, cov) of cells with documents.

    ``keys`` has (cell, above) of each level but the widest; ``n`` against ``PRIOR`` weighs a cell's own
    moments against those of the level above, and a cell without documents has the latter.
    """
    moments = written(moments, "mcd-moments")  # each level reads them
    now = moments.where(F.col("cell") == F.expr(LEVELS[0])).select("cell", "mean", "cov")
    out = now
    for level in keys:
        wide = now.select(F.col("cell").alias("above"), F.col("mean").alias("m"), F.col("cov").alias("c"))
        own = F.coalesce(F.col("n"), F.lit(0)) / (F.coalesce(F.col("n"), F.lit(0)) + PRIOR)
        mixed = lambda x, y: F.zip_with(
            F.coalesce(x, y), y, lambda a, b: F.col("w") * a + (1 - F.col("w")) * b)
        now = level.join(moments, "cell", "left").join(wide, "above").withColumn("w", own).select(
            "cell", mixed("mean", "m").alias("mean"), mixed("cov", "c").alias("cov"))
        out = out.unionByName(now)
    return out


def _inverses(moments: DataFrame) -> DataFrame:
    """(cell, mean, inverse) from (cell, mean, cov): the covariance and the least spread, inverted."""
    floor = np.diag([least ** 2 for _, least in FEATURES.values()])
    p = len(FEATURES)

    def run(frames):
        for frame in frames:
            frame["inverse"] = [np.linalg.inv(np.reshape(c, (p, p)) + floor).reshape(-1).tolist()
                                for c in frame["cov"]]
            yield frame[["cell", "mean", "inverse"]]

    return moments.mapInPandas(run, "cell string, mean array<double>, inverse array<double>")


def _distances(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    names, p = list(FEATURES), len(FEATURES)
    gaps = [F.col(f) - F.col("mean")[i] for i, f in enumerate(names)]
    squares = [F.col("inverse")[i * p + j] * gaps[i] * gaps[j] for i in range(p) for j in range(p)]
    total = squares[0]
    for s in squares[1:]:
        total = total + s
    # The corpus's cell has every row: the join is one that adaptive execution can split.
    return spread_join(rows, estimate, ["cell"]).withColumn("d2", total).drop("mean", "inverse")


def estimates(rows: DataFrame, keys: list[DataFrame]) -> DataFrame:
    """(cell, mean, inverse) of all ``keys``, from ``rows`` (cell and features), one for each level."""
    names, p = list(FEATURES), len(FEATURES)
    mid = rows.groupBy("cell").agg(F.count("*").alias("n"), *[F.percentile_approx(f, [0.25, 0.5, 0.75], 1000).alias(f) for f in names])
    spread = [F.pow((F.col(f)[2] - F.col(f)[0]) / 1.349, 2) for f in names]
    zero = F.lit(0.0)
    now = _inverses(_shrunk(mid.select(
        "cell", "n", F.array(*[F.col(f)[1] for f in names]).alias("mean"),
        F.array(*[spread[i] if i == j else zero for i in range(p) for j in range(p)]).alias("cov")), keys))
    now = written(now, "mcd")
    for step in range(STEPS):
        far = _distances(rows, now)
        limit = far.groupBy("cell").agg(F.count("*").alias("n"), F.percentile_approx("d2", [0.5, COVER], 1000).alias("q"))
        near = spread_join(far, limit, ["cell"]).where(F.col("d2") <= F.col("q")[1])
        pairs = [F.covar_pop(a, b) for a in names for b in names]
        # The last step scales the covariance so that the median distance is that of a normal cell; the
        # scale of a few documents says as little as their covariance.
        n, normal = F.first("n"), F.greatest(F.first(F.col("q")[0]) / MEDIAN_5, F.lit(1.0))
        scale = (n * normal + PRIOR) / (n + PRIOR) if step == STEPS - 1 else F.lit(1.0)
        moments = near.groupBy("cell").agg(
            n.alias("n"), F.array(*[F.avg(f) for f in names]).alias("mean"),
            F.transform(F.array(*pairs), lambda x: F.coalesce(x, zero)).alias("cov"), scale.alias("scale"))
        moments = moments.select("cell", "n", "mean", F.transform("cov", lambda x: x * F.col("scale")).alias("cov"))
        now = written(_inverses(_shrunk(moments, keys)), "mcd")
    return now


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: id, counts, base_failed, kept and the squared distance.

    Null text has no words and fails the base; a missing language or source is a value of its own;
    repeated rows are judged alike; an empty table gives an empty result.
    """
    slim = docs.select(quoted(id_col).alias("doc_id"), quoted(lang_col).cast("string").alias("lang"),
                       quoted(source_col).cast("string").alias("source"), text_of(text_col).alias("text"))
    failed = F.expr(f"n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words")
    rows = statistics(slim).withColumn("base_failed", failed)
    rows = written(rows.select("*", *[F.expr(e).alias(f) for f, (e, _) in FEATURES.items()]), "rule-statistics")
    rows = rows.withColumn("cell", F.expr(LEVELS[2]))
    keys = [written(rows.select(F.expr(cell).alias("cell"), F.expr(above).alias("above")).distinct(), "rule-keys")
            for above, cell in zip(LEVELS, LEVELS[1:])]
    usable = rows.where("not base_failed").select(
        F.explode(F.array(*[F.expr(x) for x in LEVELS])).alias("cell"), *FEATURES)
    open_cell = estimates(usable, keys)
    p = len(FEATURES)
    none = F.array(*[F.lit(None).cast("double")] * (p * p))
    judged = rows.join(open_cell, "cell", "left").withColumn("inverse", F.coalesce("inverse", none)) \
        .withColumn("mean", F.coalesce("mean", none))
    gaps = [F.col(f) - F.col("mean")[i] for i, f in enumerate(FEATURES)]
    d2 = sum((F.col("inverse")[i * p + j] * gaps[i] * gaps[j] for i in range(p) for j in range(p)), F.lit(0.0))
    return judged.select(
        "doc_id", *COUNTS[:5], "base_failed",
        (~F.col("base_failed") & F.coalesce(d2 <= LIMIT_5, F.lit(True))).alias("kept"), d2.alias("distance2"))
