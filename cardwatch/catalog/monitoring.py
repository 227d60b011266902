"""Monitoring aggregates, report rows and alerts over decided transactions."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardwatch.catalog.base import query
from cardwatch.catalog.risk import CFG, DECISION_SQL, decided
from cardwatch.functions import risk
from cardwatch.operators import monitor, split
from cardwatch.sources import payload

_ID = "TransactionID"
_HAS = "len(list_filter(risk_factors, lambda x: contains(lower(x), '{}'))) > 0"
_PRED = (f"{DECISION_SQL}, pred AS (SELECT *, CASE WHEN fraud_probability >= 0.0564e0 "
         "THEN 'FRAUD' ELSE 'LEGIT' END AS type FROM fin)")
_NEWEST = "ORDER BY t_us DESC, TransactionID DESC"


def predictions(spark, d):
    made = risk.simple_decision(F.col("fraud_probability"), CFG.model.base_threshold)
    kind = F.when(made["decision"] == "FRAUD", "FRAUD").otherwise("LEGIT")
    return decided(spark, d).withColumn("type", kind)


@query("monitor_counters", f"""{_PRED} SELECT count(*) AS total_predictions,
  count(CASE WHEN type = 'FRAUD' THEN 1 END) AS fraud_count,
  count(CASE WHEN type = 'LEGIT' THEN 1 END) AS legit_count,
  round(count(CASE WHEN type = 'FRAUD' THEN 1 END) * 100.0e0 / count(*), 6) AS fraud_rate,
  round(avg(CASE WHEN type = 'FRAUD' THEN fraud_probability END), 6) AS avg_fraud_probability,
  count(CASE WHEN ato_detected THEN 1 END) AS ato_detections,
  count(CASE WHEN {_HAS.format('txn_count')} THEN 1 END) AS velocity_alerts,
  count(CASE WHEN {_HAS.format('amount')} THEN 1 END) AS amount_alerts,
  count(CASE WHEN {_HAS.format('email')} THEN 1 END) AS email_risk_alerts,
  count(CASE WHEN hybrid_threshold <> base_threshold THEN 1 END) AS threshold_adjustments
FROM pred""")
def monitor_counters(spark, d):
    return monitor.monitor_counters(predictions(spark, d)).withColumns({
        c: F.round(c, 6) for c in ("fraud_rate", "avg_fraud_probability")})


@query("takeover_summary", f"""{_PRED} SELECT count(*) AS incidents,
  round(avg(ato_risk), 6) AS avg_ato_risk, round(avg(velocity_risk), 6) AS avg_velocity_risk,
  count(CASE WHEN len(ato_factors) > 1 THEN 1 END) AS multi_signal
FROM (SELECT * FROM pred WHERE ato_detected {_NEWEST} LIMIT 50)""")
def takeover_summary(spark, d):
    return monitor.takeover_summary(predictions(spark, d)).withColumns({
        c: F.round(c, 6) for c in ("avg_ato_risk", "avg_velocity_risk")})


@query("decision_distribution", f"""{_PRED}, last AS (SELECT * FROM pred {_NEWEST} LIMIT 100)
SELECT 'decision' AS kind, decision AS value, count(*) AS rows FROM last GROUP BY 2
UNION ALL SELECT 'risk_level', risk_level, count(*) FROM last GROUP BY 2
UNION ALL SELECT 'type', type, count(*) FROM last GROUP BY 2""")
def decision_distribution(spark, d):
    df = predictions(spark, d)
    parts = [
        monitor.decision_distribution(df, c).select(
            F.lit(c).alias("kind"), F.col(c).alias("value"), "rows")
        for c in ("decision", "risk_level", "type")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("detection_breakdown", f"""{_PRED} SELECT CASE WHEN ato_detected THEN 'ATO Detection'
  WHEN {_HAS.format('txn_count')} THEN 'Velocity Rules'
  WHEN {_HAS.format('amount')} THEN 'Amount Rules' WHEN {_HAS.format('email')} THEN 'Email Rules'
  ELSE 'ML Model Only' END AS cause, count(*) AS rows
FROM (SELECT * FROM pred WHERE type = 'FRAUD' {_NEWEST} LIMIT 100) GROUP BY 1""")
def detection_breakdown(spark, d):
    return monitor.detection_breakdown(predictions(spark, d))


@query("threshold_adjust_breakdown", f"""{_PRED} SELECT shift, count(*) AS rows FROM (
  SELECT CASE WHEN hybrid_threshold < base_threshold THEN 'lowered' ELSE 'raised' END AS shift
  FROM pred WHERE hybrid_threshold <> base_threshold {_NEWEST} LIMIT 50) GROUP BY 1""")
def threshold_adjust_breakdown(spark, d):
    return monitor.threshold_adjust_breakdown(predictions(spark, d))


@query("rolling_fraud_rate", f"""{_PRED}, last AS (SELECT *, row_number() OVER (ORDER BY t_us,
  TransactionID) - 1 AS position, count(*) OVER () AS n FROM (SELECT * FROM pred {_NEWEST}
  LIMIT 100))
SELECT CAST(position AS INT) AS position, fraud_rate FROM (SELECT position, n,
  avg(CASE WHEN type = 'FRAUD' THEN 1 ELSE 0 END) OVER (ORDER BY position ROWS BETWEEN CURRENT ROW
    AND 9 FOLLOWING) * 100 AS fraud_rate FROM last) WHERE position < n - 10""")
def rolling_fraud_rate(spark, d):
    return monitor.rolling_fraud_rate(predictions(spark, d))


@query("recent_window_stats", f"""{_PRED} SELECT
  (SELECT count(*) FROM (SELECT 1 FROM pred WHERE type = 'FRAUD' {_NEWEST} LIMIT 60))
    AS fraud_last_minute,
  (SELECT count(*) FROM (SELECT 1 FROM pred WHERE type = 'LEGIT' {_NEWEST} LIMIT 60))
    AS legit_last_minute,
  round((SELECT avg(fraud_probability) FROM (SELECT fraud_probability FROM pred
    WHERE type = 'FRAUD' {_NEWEST} LIMIT 10)), 6) AS avg_fraud_probability,
  round((SELECT avg(TransactionAmt) FROM (SELECT TransactionAmt FROM pred {_NEWEST} LIMIT 10)), 6)
    AS avg_amount""")
def recent_window_stats(spark, d):
    return monitor.recent_window_stats(predictions(spark, d)).withColumns({
        c: F.round(c, 6) for c in ("avg_fraud_probability", "avg_amount")})


@query("recent_n", f"{_PRED} SELECT TransactionID, t_us, type FROM pred {_NEWEST} LIMIT 1000")
def recent_n(spark, d):
    return split.recent_n(predictions(spark, d), 1000, monitor.ARRIVAL).select(
        _ID, "t_us", "type")


@query("route_by_decision", f"""{_PRED} SELECT TransactionID,
  CASE WHEN dist1 IS NULL THEN 'error' WHEN type = 'FRAUD' THEN 'fraud' ELSE 'legit' END AS route
FROM pred""")
def route_by_decision(spark, d):
    p = F.when(F.col("dist1").isNotNull(), F.col("fraud_probability"))
    made = risk.simple_decision(p, CFG.model.base_threshold)
    routes = payload.split_by_decision(
        decided(spark, d).select(_ID, made["decision"].alias("decision")))
    parts = [df.select(_ID, F.lit(name).alias("route")) for name, df in routes.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("filter_by_factor", f"""{_PRED} SELECT TransactionID,
  array_to_string(risk_factors, '|') AS risk_factors FROM pred WHERE {_HAS.format('spike')}""")
def filter_by_factor(spark, d):
    return monitor.filter_by_factor(predictions(spark, d), "SPIKE").select(
        _ID, F.array_join("risk_factors", "|").alias("risk_factors"))


@query("filter_high_amount",
       f"{_PRED} SELECT TransactionID, TransactionAmt FROM pred WHERE TransactionAmt > 1000")
def filter_high_amount(spark, d):
    return monitor.filter_high_amount(predictions(spark, d)).select(_ID, "TransactionAmt")


@query("lookup_by_id", f"""{_PRED} SELECT TransactionID, card1, TransactionAmt, decision FROM pred
WHERE TransactionID = 7""")
def lookup_by_id(spark, d):
    return monitor.lookup_by_id(predictions(spark, d), 7).select(
        _ID, "card1", "TransactionAmt", "decision")


@query("format_transaction_row", f"""{_PRED}, tx AS (SELECT *,
  array_to_string(risk_factors, ',') AS txt, array_to_string(list_filter([
    CASE WHEN ato_detected THEN 'ATO' END, CASE WHEN {_HAS.format('txn_count')} THEN 'VELOCITY' END,
    CASE WHEN {_HAS.format('email')} THEN 'EMAIL' END], lambda x: x IS NOT NULL), ' ') AS badge
  FROM pred)
SELECT substr(CAST(TransactionID AS VARCHAR), 1, 12) AS tx_id, decision, risk_level AS risk,
  printf('%.3f', fraud_probability) AS prob, '$' || printf('%.2f', TransactionAmt) AS amount,
  CAST(card1 AS VARCHAR) || ' (' || card4 || ')' AS card,
  COALESCE(substr(P_emaildomain, 1, 20), 'N/A') AS email, ProductCD AS product,
  CASE WHEN badge = '' THEN '-' ELSE badge END AS alerts,
  CASE WHEN length(txt) > 80 THEN substr(txt, 1, 80) || '...' ELSE txt END AS risk_factors
FROM tx""")
def format_transaction_row(spark, d):
    return monitor.format_transaction_row(predictions(spark, d))


@query("alert_payload", f"""{_PRED} SELECT TransactionID,
  'Fraud Alert: ' || risk_level || ' Risk Transaction Detected (ID: ' || TransactionID || ')'
    AS subject,
  '- Transaction ID: ' || TransactionID || chr(10) || '- User ID: ' || card1 || chr(10)
    || '- Amount: $' || printf('%.2f', TransactionAmt) || ' USD' || chr(10)
    || '- Risk Level: ' || risk_level || chr(10)
    || '- Fraud Probability: ' || printf('%.1f', fraud_probability * 100) || '%' || chr(10)
    || '- Decision: ' || decision AS body
FROM pred WHERE type = 'FRAUD'""")
def alert_payload(spark, d):
    df = predictions(spark, d).where(F.col("type") == "FRAUD")
    return monitor.alert_payload(df.withColumn("user_id", F.col("card1")))
