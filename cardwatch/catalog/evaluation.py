"""Evaluation metrics, model comparison and ordered recursions."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardwatch.catalog.base import query, with_scored, with_txn
from cardwatch.operators import folds, metrics, split
from cardwatch.sources.binding import scored, transactions

_ID = "TransactionID"
_Y, _P = "isFraud", "fraud_probability"


def _txn(spark, d):
    return scored(transactions(spark, d)).select(
        _ID, "TransactionDT", "t_us", "TransactionAmt", "card1", _Y, _P, "D5", "C13")


def _rounded(df, digits=8):
    kinds = dict(df.dtypes)
    return df.select(*[(F.round(c, digits) if kinds[c] == "double" else F.col(c)).alias(c)
                       for c in df.columns])


_T = "0.08e0"
_CONFUSION = f""", cm AS (SELECT sum(CASE WHEN isFraud = 1 AND h THEN 1 ELSE 0 END) AS tp,
  sum(CASE WHEN isFraud = 0 AND h THEN 1 ELSE 0 END) AS fp,
  sum(CASE WHEN isFraud = 0 AND NOT h THEN 1 ELSE 0 END) AS tn,
  sum(CASE WHEN isFraud = 1 AND NOT h THEN 1 ELSE 0 END) AS fn
FROM (SELECT isFraud, fraud_probability >= {_T} AS h FROM scored))"""


@query("confusion_counts", with_scored(_CONFUSION + """SELECT CAST(tp AS BIGINT) AS tp,
  CAST(fp AS BIGINT) AS fp, CAST(tn AS BIGINT) AS tn, CAST(fn AS BIGINT) AS fn,
  round(tp / (tp + fn), 8) AS tpr, round(fp / (fp + tn), 8) AS fpr,
  round(tn / (tn + fp), 8) AS tnr, round(fn / (fn + tp), 8) AS fnr FROM cm"""))
def confusion_counts(spark, d):
    return _rounded(metrics.confusion_counts(_txn(spark, d), _Y, F.col(_P) >= 0.08))


@query("classification_metrics", with_scored(_CONFUSION + """, r AS (SELECT *,
  tp / (tp + fp) AS p, tp / (tp + fn) AS r, tn / (tn + fn) AS lp, tn / (tn + fp) AS lr,
  (tp + fp + tn + fn) AS n FROM (SELECT CAST(tp AS DOUBLE) AS tp, CAST(fp AS DOUBLE) AS fp,
  CAST(tn AS DOUBLE) AS tn, CAST(fn AS DOUBLE) AS fn FROM cm)),
k AS (SELECT *, (tp + tn) / n AS acc,
  ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (n * n) AS pe FROM r)
SELECT round(p, 8) AS precision, round(r, 8) AS recall, round(2 * p * r / (p + r), 8) AS f1,
  round(acc, 8) AS accuracy, round((r + lr) / 2, 8) AS balanced_accuracy,
  round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 8) AS mcc,
  round((acc - pe) / (1 - pe), 8) AS kappa, round(lp, 8) AS legit_precision,
  round(lr, 8) AS legit_recall, round(2 * lp * lr / (lp + lr), 8) AS legit_f1 FROM k"""))
def classification_metrics(spark, d):
    return _rounded(metrics.classification_metrics(_txn(spark, d), _Y, F.col(_P) >= 0.08))


@query("roc_auc", with_scored("""
SELECT round((sum(CASE WHEN isFraud = 1 THEN rk + (ties - 1) / 2 ELSE 0 END)
  - sum(isFraud) * (sum(isFraud) + 1) / 2) / (sum(isFraud) * sum(1 - isFraud)), 8) AS roc_auc
FROM (SELECT isFraud, rank() OVER (ORDER BY fraud_probability) AS rk,
  count(*) OVER (PARTITION BY fraud_probability) AS ties FROM scored)"""))
def roc_auc(spark, d):
    return _rounded(metrics.roc_auc(_txn(spark, d), _Y, _P))


_CURVE = """, pts AS (SELECT fraud_probability AS s, sum(isFraud) AS pos, sum(1 - isFraud) AS neg
  FROM scored GROUP BY 1),
cum AS (SELECT s, pos, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
  sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM pts
  WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING))"""


@query("average_precision", with_scored(
    f"{_CURVE} SELECT round(sum(pos / p * (tp / (tp + fp))), 8) AS average_precision FROM cum"))
def average_precision(spark, d):
    return _rounded(metrics.average_precision(_txn(spark, d), _Y, _P))


@query("roc_curve", with_scored(f"""{_CURVE} SELECT s AS threshold, fp / n AS fpr, tp / p AS tpr
FROM cum UNION ALL SELECT CAST('Infinity' AS DOUBLE), 0e0, 0e0"""))
def roc_curve(spark, d):
    return metrics.roc_curve(_txn(spark, d), _Y, _P)


@query("pr_curve", with_scored(
    f"{_CURVE} SELECT s AS threshold, tp / (tp + fp) AS precision, tp / p AS recall FROM cum"))
def pr_curve(spark, d):
    return metrics.pr_curve(_txn(spark, d), _Y, _P)


@query("f1_optimal_threshold", with_scored(f"""{_CURVE}, f AS (SELECT s AS threshold,
  tp / (tp + fp) AS precision, tp / p AS recall FROM cum),
g AS (SELECT *, 2 * (precision * recall) / (precision + recall + 1e-12) AS f1 FROM f)
SELECT threshold, round(precision, 8) AS precision, round(recall, 8) AS recall,
  round(f1, 8) AS f1 FROM g ORDER BY g.f1 DESC, threshold LIMIT 1"""))
def f1_optimal_threshold(spark, d):
    best = metrics.f1_optimal_threshold(_txn(spark, d), _Y, _P)
    return best.withColumns({c: F.round(c, 8) for c in ("precision", "recall", "f1")})


_GRID = metrics.even_thresholds(0.01, 0.99, 100)
_COARSE = metrics.even_thresholds(0.1, 0.9, 17)


def _sweep_sql(grid):
    values = ", ".join(f"({t!r}e0)" for t in grid)
    return with_scored(f""", th(threshold) AS (VALUES {values}),
c AS (SELECT threshold, sum(CASE WHEN fraud_probability >= threshold AND isFraud = 1 THEN 1
    ELSE 0 END) AS tp, sum(CASE WHEN fraud_probability >= threshold AND isFraud = 0 THEN 1
    ELSE 0 END) AS fp, sum(isFraud) AS p FROM th, scored GROUP BY threshold)
SELECT threshold, round(COALESCE(tp / NULLIF(tp + fp, 0), 0), 8) AS precision,
  round(tp / p, 8) AS recall,
  round(CASE WHEN tp = 0 THEN 0 ELSE 2 * (tp / (tp + fp)) * (tp / p) / (tp / (tp + fp) + tp / p)
    END, 8) AS f1 FROM c""")


def _sweep(spark, d, grid):
    out = metrics.threshold_sweep(_txn(spark, d), _Y, _P, grid)
    return out.withColumns({c: F.round(c, 8) for c in ("precision", "recall", "f1")})


@query("threshold_sweep", _sweep_sql(_GRID))
def threshold_sweep(spark, d):
    return _sweep(spark, d, _GRID)


@query("threshold_sweep_coarse", _sweep_sql(_COARSE))
def threshold_sweep_coarse(spark, d):
    return _sweep(spark, d, _COARSE)


def _hist_sql(value, bins, by):
    part = f"PARTITION BY {by}" if by else ""
    cls = by or "0"
    return with_scored(f""", h AS (SELECT {cls} AS class, {value} AS x,
  min({value}) OVER ({part}) AS lo, max({value}) OVER ({part}) AS hi,
  count(*) OVER ({part}) AS n FROM scored)
SELECT class, CAST(least({bins - 1}, floor((x - lo) / (hi - lo) * {bins})) AS INT) AS bin,
  round(lo + least({bins - 1}, floor((x - lo) / (hi - lo) * {bins})) * ((hi - lo) / {bins}), 8)
    AS bin_start, count(*) AS rows,
  round(count(*) / (n * ((hi - lo) / {bins})), 6) AS density
FROM h GROUP BY 1, 2, 3, lo, hi, n""")


def _hist(df):
    return df.withColumns({"bin_start": F.round("bin_start", 8), "density": F.round("density", 6)})


@query("score_histogram", _hist_sql("fraud_probability", 50, "isFraud"))
def score_histogram(spark, d):
    return _hist(metrics.score_histogram(_txn(spark, d), F.col(_P), 50, _Y))


@query("score_histogram_20", _hist_sql("fraud_probability", 20, None))
def score_histogram_20(spark, d):
    return _hist(metrics.score_histogram(_txn(spark, d), F.col(_P), 20))


@query("amount_histogram", _hist_sql("greatest(0, least(2000, TransactionAmt))", 50, "isFraud"))
def amount_histogram(spark, d):
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(2000.0), F.col("TransactionAmt")))
    return _hist(metrics.score_histogram(_txn(spark, d), clipped, 50, _Y))


@query("score_boxplot", with_scored("""
SELECT CASE WHEN isFraud = 1 THEN 'Fraud' ELSE 'Legit' END AS class,
  round(quantile_cont(fraud_probability, 0.25), 8) AS q1,
  round(quantile_cont(fraud_probability, 0.5), 8) AS median,
  round(quantile_cont(fraud_probability, 0.75), 8) AS q3 FROM scored GROUP BY 1"""))
def score_boxplot(spark, d):
    return _rounded(metrics.score_boxplot(_txn(spark, d), _Y, _P))


@query("imbalance_ratio", with_txn("""
SELECT CAST(sum(1 - isFraud) AS BIGINT) AS negatives, CAST(sum(isFraud) AS BIGINT) AS positives,
  round(sum(1 - isFraud) / sum(isFraud), 8) AS scale_pos_weight FROM txn"""))
def imbalance_ratio(spark, d):
    return _rounded(metrics.imbalance_ratio(transactions(spark, d), _Y))


@query("top_errors", with_scored("""
(SELECT 'FP' AS kind, TransactionID, isFraud, fraud_probability FROM scored
  WHERE isFraud = 0 AND fraud_probability >= 0.08e0
  ORDER BY fraud_probability DESC, TransactionID LIMIT 5)
UNION ALL (SELECT 'FN', TransactionID, isFraud, fraud_probability FROM scored
  WHERE isFraud = 1 AND fraud_probability < 0.08e0
  ORDER BY fraud_probability, TransactionID LIMIT 5)"""))
def top_errors(spark, d):
    return split.top_errors(_txn(spark, d), _Y, _P, 0.08, _ID)


_MODELS = {"model_a": "fraud_probability", "model_b": "round(1e0 / (1e0 + exp(5 - D5)), 6)",
           "model_c": "C13 / 600"}


@query("model_consensus", with_scored(", m AS (SELECT TransactionID, isFraud, " + ", ".join(
    f"{e} AS {n}" for n, e in _MODELS.items()) + """ FROM scored),
v AS (SELECT *, (CASE WHEN model_a >= 0.5e0 THEN 1 ELSE 0 END)
  + (CASE WHEN model_b >= 0.5e0 THEN 1 ELSE 0 END) + (CASE WHEN model_c >= 0.5e0 THEN 1 ELSE 0 END)
  AS votes FROM m)
SELECT TransactionID, votes, round((model_a + model_b + model_c) / 3, 8) AS mean_probability,
  CASE votes WHEN 3 THEN 'strong_fraud' WHEN 2 THEN 'moderate_fraud' WHEN 1 THEN 'minority_fraud'
    ELSE 'strong_legit' END AS consensus,
  array_to_string(list_filter([""" + ", ".join(
    f"CASE WHEN ({n} >= 0.5e0) = (isFraud = 1) THEN '{n}' END" for n in _MODELS)
    + "], lambda x: x IS NOT NULL), '|') AS right_models FROM v"))
def model_consensus(spark, d):
    df = _txn(spark, d).selectExpr(_ID, _Y, *[f"{e} AS {n}" for n, e in _MODELS.items()])
    out = metrics.model_consensus(df, list(_MODELS), _Y)
    return out.select(_ID, "votes", F.round("mean_probability", 8).alias("mean_probability"),
                      "consensus", F.array_join("right_models", "|").alias("right_models"))


def _model_table(spark, d):
    """Metrics of three scorecards; the "training time" is a count taken from the data."""
    df = _txn(spark, d).selectExpr(_ID, _Y, *[f"{e} AS {n}" for n, e in _MODELS.items()])
    parts = []
    for name in _MODELS:
        quality = metrics.classification_metrics(df, _Y, F.col(name) >= 0.5).select(
            F.lit(name).alias("model"), "precision", "recall", "f1")
        auc = metrics.roc_auc(df, _Y, name).withColumn("model", F.lit(name))
        slow = df.agg(F.sum((F.col(name) >= 0.25).cast("int")).cast("double").alias(
            "train_seconds")).withColumn("model", F.lit(name))
        parts.append(quality.join(auc, "model").join(slow, "model"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _model_cte():
    rows = []
    for n, e in _MODELS.items():
        rows.append(f"""SELECT '{n}' AS model, (sum(CASE WHEN y = 1 THEN rk + (ties - 1) / 2
    ELSE 0 END) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)) AS roc_auc,
  COALESCE(sum(CASE WHEN y = 1 AND x >= 0.5e0 THEN 1 ELSE 0 END)
    / NULLIF(sum(CASE WHEN x >= 0.5e0 THEN 1 ELSE 0 END), 0), 0) AS precision,
  sum(CASE WHEN y = 1 AND x >= 0.5e0 THEN 1 ELSE 0 END) / sum(y) AS recall,
  CAST(sum(CASE WHEN x >= 0.25e0 THEN 1 ELSE 0 END) AS DOUBLE) AS train_seconds
FROM (SELECT isFraud AS y, {e} AS x, rank() OVER (ORDER BY {e}) AS rk,
  count(*) OVER (PARTITION BY {e}) AS ties FROM scored)""")
    return f""", mt AS ({' UNION ALL '.join(rows)}),
mf AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE
  2 * precision * recall / (precision + recall) END AS f1 FROM mt)"""


@query("weighted_model_score", with_scored(_model_cte() + """, ms AS (SELECT model,
  0.35e0 * roc_auc + 0.25e0 * f1 + 0.20e0 * precision + 0.15e0 * recall
    + 0.05e0 * (1 - train_seconds / max(train_seconds) OVER ()) AS s FROM mf)
SELECT model, round(s, 7) AS weighted_score,
  CAST(row_number() OVER (ORDER BY s DESC, model) AS INT) AS place FROM ms"""))
def weighted_model_score(spark, d):
    out = metrics.weighted_model_score(_model_table(spark, d))
    return out.select("model", F.round("weighted_score", 7).alias("weighted_score"), "place")


def _auc_sql(where):
    return (f"(SELECT (sum(CASE WHEN isFraud = 1 THEN rk + (ties - 1) / 2 ELSE 0 END) "
            "- sum(isFraud) * (sum(isFraud) + 1) / 2) / (sum(isFraud) * sum(1 - isFraud)) FROM "
            "(SELECT isFraud, rank() OVER (ORDER BY fraud_probability) AS rk, count(*) OVER "
            f"(PARTITION BY fraud_probability) AS ties FROM rk8 WHERE {where}))")


@query("overfit_check", with_scored(f""", rk8 AS (SELECT *, row_number() OVER (ORDER BY
  TransactionDT, TransactionID) AS rn, count(*) OVER () AS n FROM scored),
a AS (SELECT {_auc_sql('rn <= floor(n * 0.8)')} AS train_auc,
  {_auc_sql('rn > floor(n * 0.8)')} AS valid_auc),
c AS (SELECT sum(CASE WHEN isFraud = 1 AND fraud_probability >= {_T} THEN 1 ELSE 0 END)
    / sum(isFraud) AS recall,
  sum(CASE WHEN isFraud = 0 AND fraud_probability >= {_T} THEN 1 ELSE 0 END)
    / sum(1 - isFraud) AS fpr FROM rk8 WHERE rn > floor(n * 0.8))
SELECT round(train_auc, 7) AS train_auc, round(valid_auc, 7) AS valid_auc,
  round(train_auc - valid_auc, 7) AS auc_gap,
  CASE WHEN train_auc - valid_auc > 0.05 THEN 'OVERFITTING'
    WHEN train_auc - valid_auc < -0.02 THEN 'UNDERFITTING' ELSE 'GOOD' END AS fit,
  CASE WHEN valid_auc >= 0.9 THEN 'EXCELLENT' WHEN valid_auc >= 0.85 THEN 'GOOD'
    WHEN valid_auc >= 0.8 THEN 'FAIR' ELSE 'POOR' END AS auc_grade,
  CASE WHEN recall < 0.7 THEN 1 ELSE 0 END AS low_detection,
  CASE WHEN fpr > 0.1 THEN 1 ELSE 0 END AS many_false_alarms FROM a, c"""))
def overfit_check(spark, d):
    train, valid = split.chronological_split(_txn(spark, d))
    one = F.lit(1).alias("_one")
    rows = [
        metrics.roc_auc(train, _Y, _P).select(one, F.col("roc_auc").alias("train_auc")),
        metrics.roc_auc(valid, _Y, _P).select(one, F.col("roc_auc").alias("valid_auc")),
        metrics.confusion_counts(valid, _Y, F.col(_P) >= 0.08).select(
            one, F.col("tpr").alias("recall"), "fpr"),
    ]
    table = rows[0].join(rows[1], "_one").join(rows[2], "_one").drop("_one")
    return _rounded(metrics.overfit_check(table).drop("recall", "fpr"), 7)


# ---- ordered recursions ------------------------------------------------------------
@query("ewma_confidence", with_scored(""", b AS (
  SELECT TransactionDT // 3600 AS batch_id, avg(fraud_probability) AS mean_probability,
    row_number() OVER (ORDER BY TransactionDT // 3600) AS i
  FROM scored WHERE fraud_probability >= 0.0564e0 GROUP BY 1),
e(i, batch_id, ewma) AS (SELECT i, batch_id, 0.1e0 * mean_probability FROM b WHERE i = 1
  UNION ALL SELECT b.i, b.batch_id, 0.9e0 * e.ewma + 0.1e0 * b.mean_probability
  FROM e JOIN b ON b.i = e.i + 1)
SELECT batch_id, round(ewma, 7) AS ewma FROM e""").replace("WITH base", "WITH RECURSIVE base", 1))
def ewma_confidence(spark, d):
    batches = _txn(spark, d).where(F.col(_P) >= 0.0564).groupBy(
        F.floor(F.col("TransactionDT") / 3600).alias("batch_id")
    ).agg(F.avg(_P).alias("mean_probability"))
    out = folds.ewma_confidence(batches, "batch_id", "mean_probability")
    return out.select("batch_id", F.round("ewma", 7).alias("ewma"))


_VR = "CASE WHEN D5 > 8 THEN 0.8e0 ELSE 0.2e0 END"


def _replay_sql(key, window, least):
    return with_scored(f""", r AS (
  SELECT TransactionID, {key} AS key, isFraud, fraud_probability AS p, {_VR} AS v,
    row_number() OVER w AS i, count(*) OVER f AS n, avg(isFraud) OVER f AS rate
  FROM scored WINDOW w AS (PARTITION BY {key} ORDER BY t_us, TransactionID),
    f AS (PARTITION BY {key} ORDER BY t_us, TransactionID ROWS BETWEEN {window - 1} PRECEDING
      AND CURRENT ROW)),
m AS (SELECT *, CASE WHEN rate > 0.05 THEN -0.02e0 WHEN rate < 0.02 THEN 0.02e0 ELSE 0e0 END
  - CASE WHEN v > 0.7 THEN 0.01e0 ELSE 0e0 END AS mv FROM r),
e(key, i, before, x) AS (
  SELECT key, i, 0.5e0, 0.5e0 FROM m WHERE i = 1
  UNION ALL SELECT m.key, m.i, e.x, CASE WHEN m.n >= {least} THEN
    least(0.9e0, greatest(0.1e0, e.x + m.mv)) ELSE e.x END
  FROM e JOIN m ON m.key = e.key AND m.i = e.i + 1)
SELECT m.TransactionID, round(e.x, 6) AS threshold, m.n >= {least} AS active,
  CASE WHEN m.n >= {least} THEN round(m.rate, 6) END AS fraud_rate,
  CASE WHEN m.n >= {least} THEN round((SELECT avg(CASE WHEN (o.p >= e.before) = (o.isFraud = 1) THEN 1
    ELSE 0 END) FROM m o WHERE o.key = m.key AND o.i BETWEEN m.i - {window - 1} AND m.i), 6) END
    AS accuracy
FROM m JOIN e ON m.key = e.key AND m.i = e.i""").replace("WITH base", "WITH RECURSIVE base", 1)


def _rounded_replay(out):
    return out.select(_ID, F.round("threshold", 6).alias("threshold"), "active",
                      F.round("fraud_rate", 6).alias("fraud_rate"),
                      F.round("accuracy", 6).alias("accuracy"))


@query("adaptive_threshold_replay", _replay_sql("card1", 20, 5))
def adaptive_threshold_replay(spark, d):
    df = _txn(spark, d).withColumn("v", F.expr(_VR))
    return _rounded_replay(folds.adaptive_threshold_replay(
        df, "card1", ["t_us", _ID], _Y, _P, "v", window=20, min_rows=5))


@query("adaptive_threshold_global", _replay_sql("'all'", 1000, 100))
def adaptive_threshold_global(spark, d):
    """All rows as one sequence with the production window of 1000 rows."""
    df = _txn(spark, d).withColumns({"v": F.expr(_VR), "model": F.lit("all")})
    return _rounded_replay(folds.adaptive_threshold_replay(df, "model", ["t_us", _ID], _Y, _P, "v"))
