"""Fitted features, training and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardwatch.catalog.base import TXN_CTE, query
from cardwatch.operators import clean, metrics, split
from cardwatch.plans import training
from cardwatch.plans.features import FeatureEstimator, prepare, select_model_features
from cardwatch.session import scratch_path
from cardwatch.sources import tables
from cardwatch.sources.binding import transactions

_ID, _Y = "TransactionID", "isFraud"

_TRAIN = f"""{TXN_CTE}, ranked AS (SELECT *, row_number() OVER (ORDER BY TransactionDT,
  TransactionID) AS rn, count(*) OVER () AS n FROM txn),
train AS (SELECT * FROM ranked WHERE rn <= floor(n * 0.8)),
c AS (SELECT card1, count(*) AS card1_FE, avg(TransactionAmt) AS m, stddev_samp(TransactionAmt) AS s
  FROM train WHERE card1 IS NOT NULL GROUP BY card1),
a AS (SELECT addr1, avg(D15) AS m, stddev_samp(D15) AS s FROM train WHERE addr1 IS NOT NULL
  GROUP BY addr1),
p AS (SELECT lower(trim(ProductCD)) AS v, count(*) / (SELECT count(*) FROM train) AS share
  FROM train GROUP BY 1)"""


@query("fit_features", f"""WITH {_TRAIN}
SELECT t.TransactionID, c.card1_FE, round(COALESCE(c.m, -1), 4) AS TransactionAmt_card1_mean,
  round(t.TransactionAmt / (c.m + 1e-5), 4) AS TransactionAmt_to_mean_card1,
  round(t.TransactionAmt / (c.s + 1e-5), 4) AS TransactionAmt_to_std_card1,
  round(t.D15 / (a.m + 1e-5), 4) AS D15_to_mean_addr1,
  round(COALESCE(p.share, 0), 8) AS ProductCD_freq
FROM txn t LEFT JOIN c ON t.card1 = c.card1 LEFT JOIN a ON t.addr1 = a.addr1
LEFT JOIN p ON lower(trim(t.ProductCD)) = p.v""")
def fit_features(spark, d):
    """Statistics of the first 80 % of rows, applied to all rows."""
    df = transactions(spark, d)
    train, _ = split.chronological_split(df)
    out = FeatureEstimator().fit(train).transform(df)
    names = ["TransactionAmt_card1_mean", "TransactionAmt_to_mean_card1",
             "TransactionAmt_to_std_card1", "D15_to_mean_addr1"]
    return out.select(_ID, "card1_FE", *[F.round(c, 4).alias(c) for c in names],
                      F.round("ProductCD_freq", 8).alias("ProductCD_freq"))


@query("select_model_features")
def select_features(spark, d):
    df = clean.drop_unstable_columns(clean.select_opaque_subset(transactions(spark, d)))
    train, _ = split.chronological_split(df)
    wide = FeatureEstimator().fit(train).transform(df)
    return wide.select(_ID, *select_model_features(wide.columns)).fillna(0)


_INPUTS = ["TransactionAmt", "D15_normalized", "C1", "C13", "D10", "dist1", "V127", "id_02",
           "outsider15", "TransactionAmt_decimal"]


def _frames(spark, d):
    rows = prepare(transactions(spark, d))
    train, valid = split.chronological_split(rows)
    keep = [_ID, "TransactionDT", _Y]
    return (training.assemble(train, _INPUTS, keep), training.assemble(valid, _INPUTS, keep),
            train, valid)


def _model(spark, d):
    train, valid, _, _ = _frames(spark, d)
    return training.train_classifier(train, iterations=5, depth=4), train, valid


@query("train_classifier")
def train_classifier(spark, d):
    model, _, valid = _model(spark, d)
    return training.score(model, valid).select(_ID, _Y, "fraud_probability")


@query("calibrate_probability")
def calibrate_probability(spark, d):
    model, _, valid = _model(spark, d)
    calibration = training.calibrate(model, valid)
    return training.score(model, valid, calibration).select(_ID, _Y, "fraud_probability")


@query("score")
def score(spark, d):
    """Saved, loaded again, and applied to every row."""
    from pyspark.ml.classification import GBTClassificationModel

    model, train, valid = _model(spark, d)
    path = scratch_path(spark, "model")
    model.save(path)
    again = GBTClassificationModel.load(path)
    return training.score(again, train.unionByName(valid)).select(_ID, "fraud_probability")


@query("train_stacked")
def train_stacked(spark, d):
    train, valid, _, _ = _frames(spark, d)
    stacked = training.train_stacked(train, ("TransactionDT", _ID), iterations=3, depth=3, folds=2)
    return stacked.transform(valid).select(_ID, _Y, "fraud_probability")


@query("top_features")
def top_features(spark, d):
    model, train, _ = _model(spark, d)
    return tables.top_features(training.importance_table(model, _INPUTS, train), 20)


@query("export_importance")
def export_importance(spark, d):
    model, train, _ = _model(spark, d)
    path = scratch_path(spark, "importance")
    tables.export_importance(training.importance_table(model, _INPUTS, train), path)
    return spark.read.schema("feature string, importance double").option("header", True).csv(path)


@query("drop_low_importance")
def drop_low_importance(spark, d):
    model, _, _ = _model(spark, d)
    weak = training.low_importance(model, _INPUTS, 0.02)
    return prepare(transactions(spark, d)).select(
        _ID, *[c for c in _INPUTS if c not in weak])


@query("forward_selection")
def forward_selection(spark, d):
    _, _, train, valid = _frames(spark, d)
    chosen, auc = training.forward_selection(
        train, valid, ["D5", "C1", "TransactionAmt"], max_features=2, iterations=2, depth=3)
    return spark.createDataFrame([(i, c, auc) for i, c in enumerate(chosen)],
                                 "place int, feature string, auc double")


@query("random_search")
def random_search(spark, d):
    train, valid, _, _ = _frames(spark, d)
    model, _, _ = training.random_search(train, draws=2, iterations=(2, 4), depth=(2, 3))
    return training.score(model, valid).select(_ID, _Y, "fraud_probability")


@query("map_batches")
def map_batches(spark, d):
    """Batch scoring in Python for models Spark cannot run: one Arrow batch at a time."""
    import numpy as np

    def run(frames):
        for pdf in frames:
            z = 0.0004 * pdf["TransactionAmt"].to_numpy(float) - 3.6
            yield pdf[[_ID]].assign(fraud_probability=1 / (1 + np.exp(-z)))

    df = transactions(spark, d).select(_ID, "TransactionAmt")
    return df.mapInPandas(run, f"{_ID} bigint, fraud_probability double")


@query("train_batch_flow")
def train_batch_flow(spark, d):
    out = training.train_flow(transactions(spark, d), iterations=5, depth=4)
    extra = {
        "threshold": F.lit(out["threshold"]), "n_features": F.lit(len(out["features"])),
    }
    auc = metrics.roc_auc(out["scored"], _Y, "fraud_probability").first()[0]
    return out["report"].withColumns({**extra, "roc_auc": F.lit(auc)})
