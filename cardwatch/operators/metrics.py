"""Classifier evaluation as aggregations.

Curves start from counts per distinct score. The running totals over scores are
split by a monotone bin of the score: bins are summed (a few thousand rows at
most), carried in order, and completed inside each bin, so no task sorts them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cardwatch.functions import columns as fx
from cardwatch.operators.ordering import exact_quantiles
from cardwatch.session import materialize

SCORE_BINS_PER_UNIT = 100
LOGIT_LIMIT = 40.0  # bins are bounded: 2 * 40 * 100 + 1


def score_bin(score: Column) -> Column:
    """Log-odds bin: monotone in the score and fine near 0 and 1, where scores crowd."""
    odds = F.greatest(score, F.lit(1e-300)) / F.greatest(1 - score, F.lit(1e-16))
    limited = F.least(F.lit(LOGIT_LIMIT), F.greatest(F.lit(-LOGIT_LIMIT), F.ln(odds)))
    return F.floor(limited * SCORE_BINS_PER_UNIT).cast("int")


def score_counts(df: DataFrame, label: str, score: str) -> DataFrame:
    """(score, pos, neg) per distinct score."""
    hit = F.col(label) == 1
    return df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("score")).agg(
        F.count(F.when(hit, 1)).alias("pos"), F.count(F.when(~hit, 1)).alias("neg"))


def running_counts(df: DataFrame, label: str, score: str) -> tuple[DataFrame, int, int]:
    """(score, pos, neg, tp, fp) and the class totals.

    tp and fp count rows at or above the score. The per-score counts are written
    once, because the bins, the totals and the curve all read them.
    """
    counts = materialize(
        score_counts(df, label, score).withColumn("bin", score_bin(F.col("score"))), "scores")
    bins = counts.groupBy("bin").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    above = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    carried = bins.select(
        "bin", F.coalesce(F.sum("p").over(above), zero).alias("p_above"),
        F.coalesce(F.sum("n").over(above), zero).alias("n_above"))
    inside = Window.partitionBy("bin").orderBy(F.desc("score")).rowsBetween(
        Window.unboundedPreceding, 0)
    table = (
        counts.withColumns({"p_in": F.sum("pos").over(inside), "n_in": F.sum("neg").over(inside)})
        .join(F.broadcast(carried), "bin")  # at most 8001 rows
        .select("score", "pos", "neg", (F.col("p_above") + F.col("p_in")).alias("tp"),
                (F.col("n_above") + F.col("n_in")).alias("fp"))
    )
    row = bins.agg(F.sum("p"), F.sum("n")).first()
    return table, row[0] or 0, row[1] or 0


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Share of (positive, negative) pairs ranked right, ties counting half."""
    table, p, n = running_counts(df, label, score)
    whole = "decimal(19,0)"
    pairs = F.col("neg").cast(whole) * (2 * F.col("tp") - F.col("pos")).cast(whole)
    twice = F.sum(pairs.cast("decimal(38,0)")).cast("double")
    return table.agg(F.try_divide(twice, F.lit(2.0 * p * n)).alias("roc_auc"))


def average_precision(df: DataFrame, label: str, score: str) -> DataFrame:
    """Sum over descending scores of recall gain times precision."""
    table, p, _ = running_counts(df, label, score)
    gain = F.col("pos") * (F.col("tp") / (F.col("tp") + F.col("fp")))
    return table.agg(F.try_divide(F.sum(gain), F.lit(float(p))).alias("average_precision"))


def roc_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """(threshold, fpr, tpr) per distinct score, plus the origin at infinity."""
    table, p, n = running_counts(df, label, score)
    points = table.select(
        F.col("score").alias("threshold"), (F.col("fp") / max(n, 1)).alias("fpr"),
        (F.col("tp") / max(p, 1)).alias("tpr"))
    origin = df.sparkSession.range(1).select(
        F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.unionByName(origin)


def pr_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """(threshold, precision, recall) per distinct score."""
    table, p, _ = running_counts(df, label, score)
    return table.select(
        F.col("score").alias("threshold"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        (F.col("tp") / max(p, 1)).alias("recall"))


def f1_optimal_threshold(df: DataFrame, label: str, score: str) -> DataFrame:
    """The threshold of the best F1; the lowest one on a tie."""
    p, r = F.col("precision"), F.col("recall")
    points = pr_curve(df, label, score).withColumn("f1", 2 * (p * r) / (p + r + 1e-12))
    best = points.agg(F.max(F.struct(
        "f1", (-F.col("threshold")).alias("low"), "precision", "recall")).alias("b"))
    return best.select(
        (-F.col("b.low")).alias("threshold"), F.col("b.precision").alias("precision"),
        F.col("b.recall").alias("recall"), F.col("b.f1").alias("f1"))


def even_thresholds(start: float, stop: float, n: int) -> list[float]:
    step = (stop - start) / (n - 1)
    return [start + i * step for i in range(n - 1)] + [stop]


def threshold_sweep(df: DataFrame, label: str, score: str, thresholds: list[float]) -> DataFrame:
    """Precision, recall and F1 at given ascending thresholds.

    Each row is mapped to the number of thresholds it reaches, so one aggregation
    to at most len(thresholds) + 1 rows replaces a scan per threshold.
    """
    n = len(thresholds)
    s = F.col(score)
    step = (thresholds[-1] - thresholds[0]) / max(n - 1, 1) or 1.0
    grid = F.array(*[F.lit(t) for t in thresholds])
    guess = F.least(F.lit(n), F.greatest(F.lit(0), F.floor((s - thresholds[0]) / step) + 1))
    guess = guess.cast("int")

    def reached(i: Column) -> Column:
        return F.coalesce(F.get(grid, i - 1) <= s, F.lit(False))

    # the guess is off by at most one through rounding
    level = (F.when((guess < n) & reached(guess + 1), guess + 1)
             .when((guess > 0) & ~reached(guess), guess - 1).otherwise(guess))
    hit = F.col(label) == 1
    levels = df.where(s.isNotNull()).groupBy(level.alias("level")).agg(
        F.count(F.when(hit, 1)).alias("pos"), F.count(F.when(~hit, 1)).alias("neg"))
    steps = df.sparkSession.createDataFrame(
        [(i + 1, t) for i, t in enumerate(thresholds)] + [(0, None)],
        "level int, threshold double")
    onward = Window.orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy()
    table = steps.join(levels, "level", "left").fillna(0, ["pos", "neg"])
    tp, fp = F.sum("pos").over(onward), F.sum("neg").over(onward)
    total = F.sum("pos").over(everything)
    precision = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))
    recall = F.coalesce(F.try_divide(tp, total), F.lit(0.0))
    scored = table.select("threshold", precision.alias("precision"), recall.alias("recall"))
    p, r = F.col("precision"), F.col("recall")
    return scored.where("threshold IS NOT NULL").withColumn(
        "f1", F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)))


def confusion_counts(df: DataFrame, label: str, predicted: Column) -> DataFrame:
    """tp, fp, tn, fn and the four rates (0 where undefined)."""
    y = F.col(label) == 1
    counts = df.agg(
        F.count(F.when(y & predicted, 1)).alias("tp"),
        F.count(F.when(~y & predicted, 1)).alias("fp"),
        F.count(F.when(~y & ~predicted, 1)).alias("tn"),
        F.count(F.when(y & ~predicted, 1)).alias("fn"))

    def rate(top: str, rest: str) -> Column:
        return F.coalesce(F.try_divide(F.col(top), F.col(top) + F.col(rest)), F.lit(0.0))

    return counts.withColumns({
        "tpr": rate("tp", "fn"), "fpr": rate("fp", "tn"),
        "tnr": rate("tn", "fp"), "fnr": rate("fn", "tp")})


def classification_metrics(df: DataFrame, label: str, predicted: Column) -> DataFrame:
    c = confusion_counts(df, label, predicted)
    tp, fp, tn, fn = (F.col(x).cast("double") for x in ("tp", "fp", "tn", "fn"))
    n = tp + fp + tn + fn

    def part(top: Column, bottom: Column) -> Column:
        return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))

    def f1(p: Column, r: Column) -> Column:
        return part(2 * p * r, p + r)

    precision, recall = part(tp, tp + fp), part(tp, tp + fn)
    legit_precision, legit_recall = part(tn, tn + fn), part(tn, tn + fp)
    chance = part((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp), n * n)
    accuracy = part(tp + tn, n)
    mcc = part(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))
    return c.select(
        precision.alias("precision"), recall.alias("recall"),
        f1(precision, recall).alias("f1"), accuracy.alias("accuracy"),
        ((recall + legit_recall) / 2).alias("balanced_accuracy"), mcc.alias("mcc"),
        part(accuracy - chance, 1 - chance).alias("kappa"),
        legit_precision.alias("legit_precision"), legit_recall.alias("legit_recall"),
        f1(legit_precision, legit_recall).alias("legit_f1"))


def score_histogram(
    df: DataFrame, value: Column, bins: int, by: str | None = None
) -> DataFrame:
    """Equal-width bins over each class's own range: count and density."""
    group = F.col(by) if by else F.lit(0)
    rows = df.select(group.alias("class"), value.alias("x")).where("x IS NOT NULL")
    ranges = rows.groupBy("class").agg(
        F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("n"))
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.least(
        F.lit(bins - 1), F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins))
    place = F.when(F.col("hi") > F.col("lo"), place).otherwise(F.lit(0))
    counted = rows.join(ranges, "class").groupBy(
        "class", place.cast("int").alias("bin"), "lo", "hi", "n"
    ).agg(F.count(F.lit(1)).alias("rows"))
    return counted.select(
        "class", "bin", (F.col("lo") + F.col("bin") * width).alias("bin_start"), "rows",
        F.try_divide(F.col("rows"), F.col("n") * width).alias("density"))


def score_boxplot(df: DataFrame, label: str, score: str) -> DataFrame:
    """Exact quartiles of the score per class."""
    rows = []
    for value, name in ((0, "Legit"), (1, "Fraud")):
        part = df.where(F.col(label) == value)
        rows.append((name, *exact_quantiles(part, score, [0.25, 0.5, 0.75])))
    return df.sparkSession.createDataFrame(
        rows, "class string, q1 double, median double, q3 double")


def imbalance_ratio(df: DataFrame, label: str) -> DataFrame:
    y = F.col(label)
    return df.agg(
        F.sum(1 - y).alias("negatives"), F.sum(y).alias("positives"),
        F.try_divide(F.sum(1 - y), F.sum(y)).alias("scale_pos_weight"))


# ---- comparing models -----------------------------------------------------------
def model_consensus(
    df: DataFrame, models: list[str], label: str, threshold: float = 0.5
) -> DataFrame:
    votes = sum(((F.col(m) >= threshold).cast("int") for m in models), F.lit(0))
    n = len(models)
    mean = sum((F.col(m) for m in models[1:]), F.col(models[0])) / n
    right = F.array_compact(F.array(*[
        F.when((F.col(m) >= threshold) == (F.col(label) == 1), F.lit(m)) for m in models]))
    text = (
        F.when(votes == n, "strong_fraud").when(votes == 0, "strong_legit")
        .when(votes * 2 > n, "moderate_fraud").otherwise("minority_fraud"))
    return df.withColumns({
        "votes": votes, "mean_probability": mean, "consensus": text, "right_models": right})


MODEL_WEIGHTS = {"roc_auc": 0.35, "f1": 0.25, "precision": 0.20, "recall": 0.15}
SPEED_WEIGHT = 0.05


def weighted_model_score(models: DataFrame, seconds: str = "train_seconds") -> DataFrame:
    """One row per model; speed counts relative to the slowest."""
    slowest = F.max(seconds).over(Window.partitionBy())
    speed = 1 - F.col(seconds) / slowest
    score = sum((F.col(m) * w for m, w in MODEL_WEIGHTS.items()), F.lit(0.0)) + (
        speed * SPEED_WEIGHT)
    rank = F.row_number().over(Window.orderBy(F.desc("weighted_score"), "model"))
    return models.withColumn("weighted_score", score).withColumn("place", rank)


def overfit_check(df: DataFrame, train_auc="train_auc", valid_auc="valid_auc",
                  recall="recall", fpr="fpr") -> DataFrame:
    gap, auc = F.col(train_auc) - F.col(valid_auc), F.col(valid_auc)
    return df.withColumns({
        "auc_gap": gap,
        "fit": F.when(gap > 0.05, "OVERFITTING").when(gap < -0.02, "UNDERFITTING")
        .otherwise("GOOD"),
        "auc_grade": F.when(auc >= 0.90, "EXCELLENT").when(auc >= 0.85, "GOOD")
        .when(auc >= 0.80, "FAIR").otherwise("POOR"),
        "low_detection": fx.flag(F.col(recall) < 0.70),
        "many_false_alarms": fx.flag(F.col(fpr) > 0.10),
    })
