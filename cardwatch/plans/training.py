"""Training, calibration, selection and scoring with Spark ML."""

from __future__ import annotations

import random

from pyspark.ml import Model
from pyspark.ml.classification import (
    GBTClassifier, LogisticRegression, RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame, functions as F

from cardwatch.operators import clean, metrics, split
from cardwatch.operators.encode import contiguous_folds
from cardwatch.plans.features import ID, LABEL, FeatureEstimator, select_model_features
from cardwatch.session import materialize

POSITIVE_WEIGHT = 20.0


def assemble(df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """``features`` vector with NULL as 0, next to the kept columns."""
    filled = df.select(*keep, *[
        F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features
        if c not in keep], *[
        F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"{c}_value") for c in features
        if c in keep])
    inputs = [f"{c}_value" if c in keep else c for c in features]
    return VectorAssembler(inputCols=inputs, outputCol="features").transform(filled).select(
        *keep, "features")


def weighted(df: DataFrame, positive_weight: float, label: str = LABEL) -> DataFrame:
    return df.withColumn(
        "weight", F.when(F.col(label) == 1, float(positive_weight)).otherwise(1.0))


def train_classifier(
    train: DataFrame, iterations: int = 500, depth: int = 7, step: float = 0.05,
    subsample: float = 0.8, column_share: str = "0.8", positive_weight: float = POSITIVE_WEIGHT,
    seed: int = 42,
) -> Model:
    """Boosted trees on an assembled frame."""
    return GBTClassifier(
        labelCol=LABEL, featuresCol="features", weightCol="weight", maxIter=iterations,
        maxDepth=depth, stepSize=step, subsamplingRate=subsample,
        featureSubsetStrategy=column_share, seed=seed,
    ).fit(weighted(train, positive_weight))


def probability_of(model: Model, df: DataFrame, out: str = "fraud_probability") -> DataFrame:
    """Adds the positive-class probability and drops the model's own columns."""
    scored = model.transform(df)
    return scored.withColumn(out, vector_to_array("probability")[1]).drop(
        "rawPrediction", "probability", "prediction")


def calibrate(model: Model, valid: DataFrame, max_iter: int = 100) -> Model:
    """Sigmoid on the margin, fitted on held-out rows."""
    return LogisticRegression(
        labelCol=LABEL, featuresCol="margin", maxIter=max_iter).fit(_margin(model, valid))


def _margin(model: Model, df: DataFrame) -> DataFrame:
    raw = model.transform(df).withColumn("_m", vector_to_array("rawPrediction")[1]).drop(
        "rawPrediction", "probability", "prediction")
    return VectorAssembler(inputCols=["_m"], outputCol="margin").transform(raw).drop("_m")


def score(model: Model, df: DataFrame, calibration: Model | None = None) -> DataFrame:
    if calibration is None:
        return probability_of(model, df)
    return probability_of(calibration, _margin(model, df)).drop("margin")


def base_learners(iterations: int, depth: int, seed: int = 42) -> list[tuple[str, object]]:
    common = {"labelCol": LABEL, "weightCol": "weight"}
    return [
        ("boosted", GBTClassifier(maxIter=iterations, maxDepth=depth, stepSize=0.1, seed=seed,
                                  **common)),
        ("forest", RandomForestClassifier(numTrees=iterations, maxDepth=depth, seed=seed,
                                          **common)),
        ("logistic", LogisticRegression(maxIter=iterations, regParam=0.01, **common)),
    ]


class StackedModel:
    """Base learners plus a logistic model over their probabilities."""

    def __init__(self, bases: list[tuple[str, Model]], meta: Model):
        self.bases, self.meta = bases, meta

    def transform(self, df: DataFrame) -> DataFrame:
        return probability_of(self.meta, _meta_features(df, self.bases)).drop("meta")


def _meta_features(df: DataFrame, bases: list[tuple[str, Model]]) -> DataFrame:
    out = df
    for name, model in bases:
        out = probability_of(model, out, f"p_{name}")
    names = [f"p_{name}" for name, _ in bases]
    return VectorAssembler(inputCols=names, outputCol="meta").transform(out).drop(*names)


def train_stacked(
    train: DataFrame, order: tuple[str, str], iterations: int = 20, depth: int = 5, folds: int = 3,
    positive_weight: float = POSITIVE_WEIGHT,
) -> StackedModel:
    """Meta model fitted on out-of-fold predictions of the base learners."""
    work = weighted(train, positive_weight).withColumn(
        "fold", contiguous_folds(train, order, folds))
    work = materialize(work, "stack")
    held = None
    for k in range(folds):
        fitted = [(n, e.fit(work.where(F.col("fold") != k)))
                  for n, e in base_learners(iterations, depth)]
        part = _meta_features(work.where(F.col("fold") == k), fitted)
        held = part if held is None else held.unionByName(part)
    meta = LogisticRegression(labelCol=LABEL, featuresCol="meta", weightCol="weight").fit(held)
    return StackedModel([(n, e.fit(work)) for n, e in base_learners(iterations, depth)], meta)


# ---- selection -------------------------------------------------------------------------
def importance_table(model: Model, features: list[str], df: DataFrame) -> DataFrame:
    rows = [(f, float(v)) for f, v in zip(features, model.featureImportances.toArray())]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def low_importance(model: Model, features: list[str], threshold: float = 0.0002) -> list[str]:
    return [f for f, v in zip(features, model.featureImportances.toArray()) if v < threshold]


def area_under_roc(df: DataFrame, score_col: str = "fraud_probability") -> float:
    return metrics.roc_auc(df, LABEL, score_col).first()[0]


def forward_selection(
    train: DataFrame, valid: DataFrame, candidates: list[str], max_features: int = 50,
    min_gain: float = 1e-5, iterations: int = 20, depth: int = 5,
) -> tuple[list[str], float]:
    """Greedily add the column that raises the validation AUC most.

    The loop is over candidate columns; every fit and every AUC is a Spark job.
    """
    chosen: list[str] = []
    left, best = list(candidates), 0.0
    while left and len(chosen) < max_features:
        round_best, winner = best, None
        for c in left:
            columns = [*chosen, c]
            model = GBTClassifier(labelCol=LABEL, maxIter=iterations, maxDepth=depth, stepSize=0.1,
                                  seed=42).fit(assemble(train, columns, [LABEL]))
            auc = area_under_roc(probability_of(model, assemble(valid, columns, [LABEL])))
            if auc > round_best:
                round_best, winner = auc, c
        if winner is None or round_best - best < min_gain:
            break
        chosen.append(winner)
        left.remove(winner)
        best = round_best
    return chosen, best


def random_search(
    train: DataFrame, draws: int = 10, folds: int = 2, parallelism: int = 2, seed: int = 42,
    iterations: tuple[int, int] = (20, 60), depth: tuple[int, int] = (3, 6),
) -> tuple[Model, dict[str, float], float]:
    """Best of randomly drawn parameters by cross-validated area under the PR curve."""
    rng = random.Random(seed)
    tree = GBTClassifier(labelCol=LABEL, weightCol="weight", seed=seed)
    grid = [{
        tree.maxIter: rng.randint(*iterations), tree.maxDepth: rng.randint(*depth),
        tree.stepSize: rng.uniform(0.01, 0.1), tree.subsamplingRate: rng.uniform(0.7, 1.0),
    } for _ in range(draws)]
    search = CrossValidator(
        estimator=tree, estimatorParamMaps=grid, numFolds=folds, parallelism=parallelism,
        seed=seed, evaluator=BinaryClassificationEvaluator(
            labelCol=LABEL, metricName="areaUnderPR"))
    fitted = search.fit(weighted(train, POSITIVE_WEIGHT))
    at = max(range(draws), key=lambda i: fitted.avgMetrics[i])
    return fitted.bestModel, {p.name: v for p, v in grid[at].items()}, fitted.avgMetrics[at]


# ---- the whole flow --------------------------------------------------------------------
def clean_rows(df: DataFrame, percentile: float = 99.99) -> DataFrame:
    out = clean.select_opaque_subset(df)
    out = clean.drop_unstable_columns(out)
    out = clean.drop_high_null_columns(out)
    out = clean.filter_amount_outliers(out, percentile=percentile)
    return clean.filter_negative_deltas(clean.filter_count_outliers(out))


def train_flow(
    df: DataFrame, ratio: float = 0.8, iterations: int = 500, depth: int = 7,
    transductive: bool = False,
) -> dict[str, object]:
    """Clean, split by time in three, fit features, train, calibrate, pick the threshold, report.

    The model learns from the first ``ratio`` of the rows; the earlier half of the rest calibrates it and picks
    the threshold, the later half is only reported on (``scored``). The cleaned rows and the assembled frames are written once; every later step reads
    those files.
    """
    rows = materialize(clean_rows(df), "cleaned")
    train_raw, rest = split.chronological_split(rows, ratio)
    valid_raw, test_raw = split.chronological_split(rest, 0.5)
    fitted = FeatureEstimator(statistics=rows if transductive else None).fit(train_raw)
    train_wide, valid_wide, test_wide = (
        fitted.transform_train(train_raw), fitted.transform(valid_raw), fitted.transform(test_raw))
    features = select_model_features(train_wide.columns)
    keep = [ID, "TransactionDT", LABEL]
    train = materialize(assemble(train_wide, features, keep), "train")
    valid = materialize(assemble(valid_wide, features, keep), "valid")
    test = materialize(assemble(test_wide, features, keep), "test")
    model = train_classifier(train, iterations, depth)
    calibration = calibrate(model, valid)
    tuned = materialize(score(model, valid, calibration).drop("features"), "tuned")
    best = metrics.f1_optimal_threshold(tuned, LABEL, "fraud_probability").first()
    scored = materialize(score(model, test, calibration).drop("features"), "scored")
    report = metrics.classification_metrics(
        scored, LABEL, F.col("fraud_probability") >= best["threshold"])
    return {
        "model": model, "calibration": calibration, "feature_model": fitted,
        "features": features, "threshold": best["threshold"], "scored": scored, "report": report,
        "train": train, "valid": valid, "test": test,
    }
