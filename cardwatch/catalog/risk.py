"""Risk scores, takeover signals, decisions and adaptive thresholds."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardwatch.catalog.base import SCORED_CTE, query
from cardwatch.catalog.velocity import online_cte
from cardwatch.config import Settings
from cardwatch.functions import columns as fx, fixed, risk
from cardwatch.operators import profile
from cardwatch.operators.velocity import online_velocity_counts
from cardwatch.plans import scoring
from cardwatch.sources.binding import scored, transactions

_ID = "TransactionID"
CFG = Settings().validate()


def _in(values):
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _bands(value, *bands):
    return ("CASE " + " ".join(f"WHEN {value} >= {b} THEN {p}e0" for b, p in bands)
            + " ELSE 0e0 END")


def _cap(e):
    return f"least(1e0, {e})"


def _list(*items):
    return f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)"


def _join(name):
    return f"array_to_string({name}, '|') AS {name}"


def _joined(df, *names):
    return df.withColumns({n: F.array_join(n, "|") for n in names})


_BASE = SCORED_CTE.replace("scored AS (", "pre AS (", 1) + ", " + online_cte().replace(
    "FROM txn)", "FROM pre)", 1)

_VEL = f"""vr AS (SELECT *,
  {_cap(_bands('txn_count_1h', (10, .9), (5, .7), (3, .3)) + ' + '
        + _bands('txn_count_6h', (30, .5), (15, .3)) + ' + '
        + _bands('txn_count_24h', (50, .4), (30, .2)))} AS velocity_risk,
  {_cap(_bands('spike', (5, .8), (3, .5), (2, .3)) + ' + '
        + _bands('amt_sum_24h', (10000, .7), (5000, .4), (2000, .2)) + ' + '
        + _bands('TransactionAmt', (5000, .5), (2000, .3)))} AS amount_risk,
  {_list("CASE WHEN txn_count_1h >= 5 THEN 'high_1h_txn_count_' || txn_count_1h END",
         "CASE WHEN txn_count_6h >= 15 THEN 'high_6h_txn_count_' || txn_count_6h END",
         "CASE WHEN txn_count_24h >= 30 THEN 'high_24h_txn_count_' || txn_count_24h END",
         "CASE WHEN spike >= 5 THEN 'amount_spike_5x_' || printf('%.1f', spike) || 'x' "
         "WHEN spike >= 3 THEN 'amount_spike_3x_' || printf('%.1f', spike) || 'x' END",
         "CASE WHEN TransactionAmt >= 5000 THEN 'high_amount_' || printf('%.0f', TransactionAmt)"
         " END")} AS velocity_factors
  FROM (SELECT *, CASE WHEN amt_mean_24h > 0 THEN TransactionAmt / amt_mean_24h END AS spike
    FROM ov))"""


def _seen(c, n):
    return (f"COALESCE(list({c}) FILTER (WHERE {c} IS NOT NULL) OVER (PARTITION BY card1 "
            f"ORDER BY t_us, TransactionID ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING), [])")


_AMOUNTS = ("OVER (PARTITION BY card1 ORDER BY t_us, TransactionID "
            "ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)")
_PROFILE = f"""pr AS (SELECT *, {_seen('addr1', 10)} AS seen_addr1,
  {_seen('addr2', 10)} AS seen_addr2, {_seen('DeviceInfo', 10)} AS seen_devices,
  {_seen('P_emaildomain', 5)} AS seen_emails, {_seen('card6', 10)} AS seen_card_types,
  count(TransactionAmt) {_AMOUNTS} AS seen_amount_n,
  avg(TransactionAmt) {_AMOUNTS} AS seen_amount_mean,
  stddev_pop(TransactionAmt) {_AMOUNTS} AS seen_amount_std FROM vr)"""


def _unseen(c, seen, points):
    return (f"CASE WHEN len({seen}) > 0 AND {c} IS NOT NULL AND NOT list_contains({seen}, {c}) "
            f"THEN {points}e0 ELSE 0e0 END")


_Z = "abs((TransactionAmt - seen_amount_mean) / seen_amount_std)"
_RISKY = f"P_emaildomain IN {_in(fixed.PROFILE_RISKY_DOMAINS)}"
_ATO = f"""sg AS (SELECT *,
  {_cap(_unseen('addr1', 'seen_addr1', .5) + ' + ' + _unseen('addr2', 'seen_addr2', .3)
        + ' + CASE WHEN dist1 > 1000 THEN 0.7e0 WHEN dist1 > 500 THEN 0.4e0 ELSE 0e0 END')}
    AS ato_geo,
  {_cap(_unseen('DeviceInfo', 'seen_devices', .6) + ' + CASE WHEN regexp_matches(lower(DeviceInfo),'
        f" '{fixed.PROFILE_DEVICE_PATTERN}') THEN 0.8e0 ELSE 0e0 END")} AS ato_device,
  {_cap(_unseen('P_emaildomain', 'seen_emails', .5) + f' + CASE WHEN {_RISKY} THEN 0.7e0 ELSE 0e0 '
        f"END + CASE WHEN regexp_matches(lower(P_emaildomain), '{fixed.PROFILE_EMAIL_PATTERN}') "
        "THEN 0.6e0 ELSE 0e0 END")} AS ato_email,
  CASE WHEN TransactionAmt = 0 THEN 0e0 ELSE {_cap(
      _bands('TransactionAmt', (2000, .7), (1000, .4))
      + f' + CASE WHEN seen_amount_n < 5 OR seen_amount_std = 0 THEN 0e0 WHEN {_Z} > 3 THEN 0.6e0 '
        f'WHEN {_Z} > 2 THEN 0.3e0 ELSE 0e0 END + CASE WHEN seen_amount_n >= 5 AND '
        'seen_amount_mean > 0 THEN '
      + _bands('TransactionAmt / seen_amount_mean', (5, .5), (3, .3)) + ' ELSE 0e0 END')} END
    AS ato_amount,
  {_unseen('card6', 'seen_card_types', .4)} AS ato_card_type FROM pr),
ats AS (SELECT *, ato_risk >= 0.6e0 AS ato_detected, {_list(
    "CASE WHEN ato_geo > 0.5e0 AND dist1 > 500 THEN 'geo_anomaly_distance_' || "
    "printf('%.0f', dist1) || 'km' END",
    "CASE WHEN ato_geo > 0.5e0 AND dist1 > 500 THEN 'geo_anomaly_new_address' END",
    "CASE WHEN ato_device > 0.5e0 THEN 'device_anomaly_new_device' END",
    f"CASE WHEN ato_email > 0.5e0 AND {_RISKY} THEN 'email_risky_domain_' || P_emaildomain "
    "WHEN ato_email > 0.5e0 THEN 'email_anomaly_new_domain' END",
    "CASE WHEN ato_amount > 0.5e0 THEN 'amount_anomaly_' || printf('%.0f', TransactionAmt) END",
    "CASE WHEN ato_card_type > 0.3e0 THEN 'card_type_anomaly' END")} AS ato_factors
  FROM (SELECT *, {_cap('ato_geo * 0.30e0 + ato_device * 0.20e0 + ato_email * 0.35e0 + '
                        'ato_amount * 0.15e0 + ato_card_type * 0.10e0')} AS ato_risk FROM sg))"""

_B = "0.0564e0"
_TAUS = [_B] + [f"greatest(0.01e0, {_B} - {r} * {k}e0)" for r, k in
                (("velocity_risk", .15), ("amount_risk", "0.10"), ("ato_risk", .25))]


def _mix(weights):
    return " + ".join(f"{t} * {w}e0" for t, w in zip(_TAUS, weights))


def _boost(p, r, hi, mid):
    return (f"({p} + CASE WHEN {r} > 0.8e0 THEN {hi}e0 WHEN {r} > 0.6e0 THEN {mid}e0 ELSE 0e0 END"
            f" * (1 - {p}))")


_NIGHT = "(dt_hour >= 22 OR dt_hour <= 5)"
_RULES = _list(
    "CASE WHEN TransactionAmt >= 10000 THEN 'extreme_amount_' || printf('%.0f', TransactionAmt)"
    " END",
    f"CASE WHEN {_NIGHT} AND TransactionAmt >= 1000 THEN 'night_high_amount_' || "
    "printf('%.0f', TransactionAmt) END",
    f"CASE WHEN P_emaildomain IN {_in(fixed.RULE_RISKY_DOMAINS)} THEN 'risky_email_' || "
    "P_emaildomain END",
    "CASE WHEN ProductCD = 'W' AND TransactionAmt >= 5000 THEN 'suspicious_wire_transfer_' || "
    "printf('%.0f', TransactionAmt) END")
_MODEL = _list(
    "CASE WHEN fraud_probability >= 0.20e0 THEN 'high_ml_score_' || "
    "printf('%.3f', fraud_probability) WHEN fraud_probability >= 0.10e0 THEN "
    "'medium_ml_score_' || printf('%.3f', fraud_probability) END")
_CONTEXT = _list(
    f"CASE WHEN {_NIGHT} THEN 'night_transaction' WHEN dt_hour BETWEEN 9 AND 17 THEN "
    "'business_hours' END",
    "CASE WHEN TransactionAmt >= 5000 THEN 'very_high_amount_' || printf('%.0f', TransactionAmt) "
    "WHEN TransactionAmt >= 2000 THEN 'high_amount_' || printf('%.0f', TransactionAmt) "
    "WHEN TransactionAmt <= 1 AND TransactionAmt <> 0 THEN 'micro_transaction_' || "
    "printf('%.2f', TransactionAmt) END")
_P1 = _boost("fraud_probability", "velocity_risk", .15, "0.10")
_DEC = f"""ht AS (SELECT *, (TransactionDT // 3600) % 24 AS dt_hour,
    least(0.50e0, greatest(0.01e0, CASE
      WHEN ato_risk > 0.6e0 THEN {_mix((.1, .2, .1, .6))}
      WHEN velocity_risk > 0.7e0 THEN {_mix((.2, .5, .2, .1))}
      WHEN amount_risk > 0.7e0 THEN {_mix((.2, .2, .5, .1))}
      ELSE {_mix((.6, .2, .1, .1))} END)) AS hybrid_threshold,
    {_P1} AS p1 FROM ats),
ap AS (SELECT *, least(1e0, {_boost('p2', 'ato_risk', '0.20', .15)}) AS adjusted_probability,
    {_RULES} AS rule_factors
  FROM (SELECT *, {_boost('p1', 'amount_risk', '0.10', .05)} AS p2 FROM ht)),
dc AS (SELECT *, {_B} AS base_threshold, len(rule_factors) > 0 AS rule_triggered,
    {_MODEL} || velocity_factors || ato_factors || rule_factors || {_CONTEXT} AS risk_factors,
    CASE WHEN adjusted_probability >= 0.20e0 THEN 'BLOCK'
      WHEN adjusted_probability >= 0.10e0 THEN 'HOLD'
      WHEN adjusted_probability >= hybrid_threshold OR ato_detected OR len(rule_factors) > 0
        THEN 'REVIEW' ELSE 'APPROVE' END AS decision FROM ap),
fin AS (SELECT *, CASE WHEN decision IN ('BLOCK', 'HOLD') THEN 'HIGH'
    WHEN decision = 'REVIEW' THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM dc)"""

VELOCITY_SQL = f"WITH {_BASE}, {_VEL}"
PROFILE_SQL = f"{VELOCITY_SQL}, {_PROFILE}"
ATO_SQL = f"{PROFILE_SQL}, {_ATO}"
DECISION_SQL = f"{ATO_SQL}, {_DEC}"


def _txn(spark, d):
    return scored(transactions(spark, d))


def velocity_frame(spark, d):
    df = _txn(spark, d).select(_ID, "card1", "t_us", "TransactionAmt")
    return scoring.add_velocity_risk(online_velocity_counts(df, ["card1"]), CFG)


def assessed(spark, d):
    return scoring.assess(_txn(spark, d), CFG)


def decided(spark, d):
    return scoring.decide_rows(assessed(spark, d), CFG)


@query("velocity_risk", f"{VELOCITY_SQL} SELECT TransactionID, velocity_risk FROM vr")
def velocity_risk(spark, d):
    return velocity_frame(spark, d).select(_ID, "velocity_risk")


@query("amount_risk", f"{VELOCITY_SQL} SELECT TransactionID, amount_risk FROM vr")
def amount_risk(spark, d):
    return velocity_frame(spark, d).select(_ID, "amount_risk")


@query("velocity_factors",
       f"{VELOCITY_SQL} SELECT TransactionID, {_join('velocity_factors')} FROM vr")
def velocity_factors(spark, d):
    return _joined(velocity_frame(spark, d).select(_ID, "velocity_factors"), "velocity_factors")


_ARRAYS = ("seen_addr1", "seen_addr2", "seen_devices", "seen_emails", "seen_card_types")


@query("profile_history", f"""{PROFILE_SQL} SELECT TransactionID,
  {', '.join(_join(c) for c in _ARRAYS)}, seen_amount_n, seen_amount_mean,
  round(seen_amount_std, 4) AS seen_amount_std FROM pr""")
def profile_history(spark, d):
    out = profile.profile_history(transactions(spark, d))
    return _joined(out, *_ARRAYS).select(
        _ID, *_ARRAYS, "seen_amount_n", "seen_amount_mean",
        F.round("seen_amount_std", 4).alias("seen_amount_std"))


@query("profile_history_text", f"""{PROFILE_SQL}, tx AS (SELECT TransactionID,
  COALESCE(list(COALESCE(CAST(addr1 AS VARCHAR), 'None')) OVER (PARTITION BY card1
    ORDER BY t_us, TransactionID ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), []) AS seen_addr1
  FROM vr) SELECT TransactionID, {_join('seen_addr1')} FROM tx""")
def profile_history_text(spark, d):
    out = profile.profile_history(transactions(spark, d), missing_text="None")
    return _joined(out.select(_ID, "seen_addr1"), "seen_addr1")


@query("profile_stats", f"""{VELOCITY_SQL} SELECT card1,
  count(DISTINCT CASE WHEN bk <= 10 THEN addr1 END) AS n_addresses,
  count(DISTINCT CASE WHEN bk <= 10 THEN DeviceInfo END) AS n_devices,
  count(DISTINCT CASE WHEN bk <= 5 THEN P_emaildomain END) AS n_email_domains,
  count(TransactionAmt) AS n_transactions, avg(TransactionAmt) AS mean_amount,
  round(stddev_pop(TransactionAmt), 4) AS std_amount, min(TransactionAmt) AS min_amount,
  max(TransactionAmt) AS max_amount
FROM (SELECT *, row_number() OVER (PARTITION BY card1 ORDER BY t_us DESC, TransactionID DESC)
  AS bk FROM vr) WHERE bk <= 50 GROUP BY card1""")
def profile_stats(spark, d):
    return profile.profile_stats(transactions(spark, d)).withColumn(
        "std_amount", F.round("std_amount", 4))


for _name in ("ato_geo", "ato_device", "ato_email", "ato_amount", "ato_card_type"):
    def _signal(spark, d, name=_name):
        return assessed(spark, d).select(_ID, name)

    query(_name, f"{ATO_SQL} SELECT TransactionID, {_name} FROM ats")(_signal)


@query("ato_score", f"{ATO_SQL} SELECT TransactionID, ato_risk, "
       "ato_detected FROM ats")
def ato_score(spark, d):
    return assessed(spark, d).select(
        _ID, "ato_risk", "ato_detected")


@query("ato_factors", f"{ATO_SQL} SELECT TransactionID, {_join('ato_factors')} FROM ats")
def ato_factors(spark, d):
    return _joined(assessed(spark, d).select(_ID, "ato_factors"), "ato_factors")


@query("hybrid_threshold",
       f"{DECISION_SQL} SELECT TransactionID, hybrid_threshold "
       "FROM fin")
def hybrid_threshold(spark, d):
    return decided(spark, d).select(_ID, "hybrid_threshold")


@query("adjust_probability", f"{DECISION_SQL} SELECT TransactionID, "
       "adjusted_probability FROM fin")
def adjust_probability(spark, d):
    return decided(spark, d).select(
        _ID, "adjusted_probability")


@query("rule_triggers", f"{DECISION_SQL} SELECT TransactionID, {_join('rule_factors')}, "
       "rule_triggered FROM fin")
def rule_triggers(spark, d):
    df = transactions(spark, d).withColumn("dt_hour", fx.hour_of_day())
    made = df.select(_ID, risk.rule_factors().alias("rule_factors"))
    return _joined(made.withColumn("rule_triggered", F.size("rule_factors") > 0), "rule_factors")


@query("decide", f"{DECISION_SQL} SELECT TransactionID, decision, risk_level FROM fin")
def decide(spark, d):
    return decided(spark, d).select(_ID, "decision", "risk_level")


@query("simple_decision", f"""{VELOCITY_SQL} SELECT TransactionID,
  CASE WHEN p IS NULL THEN 0.5 ELSE p END AS fraud_probability,
  CASE WHEN p IS NULL THEN 'ERROR' WHEN p >= 0.0564e0 THEN 'FRAUD' ELSE 'LEGITIMATE' END
    AS decision,
  CASE WHEN p IS NULL THEN 'UNKNOWN' WHEN p >= 0.0564e0 THEN 'HIGH' ELSE 'LOW' END AS risk_level,
  CASE WHEN p IS NULL THEN 0.5e0 ELSE 0.0564e0 END AS threshold
FROM (SELECT TransactionID, CASE WHEN dist1 IS NOT NULL THEN fraud_probability END AS p FROM vr)""")
def simple_decision(spark, d):
    p = F.when(F.col("dist1").isNotNull(), F.col("fraud_probability"))
    made = risk.simple_decision(p, CFG.model.base_threshold)
    return _txn(spark, d).select(_ID, *[c.alias(n) for n, c in made.items()])


@query("collect_factors", f"{DECISION_SQL} SELECT TransactionID, {_join('risk_factors')} FROM fin")
def collect_factors(spark, d):
    return _joined(decided(spark, d).select(_ID, "risk_factors"), "risk_factors")


@query("dedupe_factors", f"""{VELOCITY_SQL} SELECT TransactionID, array_to_string(
  list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS factors
FROM (SELECT TransactionID, velocity_factors || ['high_amount'] || velocity_factors
  || ['high_amount', 'z'] AS l FROM vr)""")
def dedupe_factors(spark, d):
    doubled = F.concat("velocity_factors", F.array(F.lit("high_amount")), "velocity_factors",
                       F.array(F.lit("high_amount"), F.lit("z")))
    return velocity_frame(spark, d).select(
        _ID, F.array_join(risk.dedupe_factors(doubled), "|").alias("factors"))


@query("make_decision", f"""{DECISION_SQL} SELECT TransactionID,
  fraud_probability,
  adjusted_probability, base_threshold,
  hybrid_threshold, velocity_risk, amount_risk,
  ato_risk, ato_detected, rule_triggered, decision, risk_level,
  {_join('risk_factors')} FROM fin""")
def make_decision(spark, d):
    out = scoring.make_decision(_txn(spark, d), CFG)
    return _joined(out, "risk_factors")


@query("mock_risk_fallback", f"""{ATO_SQL} SELECT TransactionID,
  CASE WHEN addr1 IS NULL THEN 0e0 ELSE velocity_risk END AS velocity_risk,
  CASE WHEN addr1 IS NULL THEN 0e0 ELSE amount_risk END AS amount_risk,
  CASE WHEN addr1 IS NULL THEN 0e0 ELSE ato_risk END AS ato_risk,
  CASE WHEN addr1 IS NULL THEN FALSE ELSE ato_detected END AS ato_detected,
  CASE WHEN addr1 IS NULL THEN '' ELSE array_to_string(velocity_factors, '|') END
    AS velocity_factors FROM ats""")
def mock_risk_fallback(spark, d):
    """Risks looked up for addressed rows only, as if the rest had no state."""
    txn = _txn(spark, d)
    state = assessed(spark, d).where("addr1 IS NOT NULL").select(
        _ID, "velocity_risk", "amount_risk", "ato_risk",
        "ato_detected", "velocity_factors", "ato_factors")
    out = scoring.neutral_if_missing(txn.select(_ID).join(state, _ID, "left"))
    return _joined(out.drop("ato_factors"), "velocity_factors")


def _hybrid_sql(method):
    taus = ["fraud_probability", "0.5e0 - velocity_risk * 0.15e0", "0.5e0 - amount_risk * 0.10e0"]

    def mix(w):
        return " + ".join(f"({t}) * {x}e0" for t, x in zip(taus, w))

    return {
        "max": f"greatest({', '.join(taus)})", "min": f"least({', '.join(taus)})",
        "weighted": mix((.6, .3, .1)),
        "dynamic": f"CASE WHEN velocity_risk > 0.7e0 THEN {mix((.3, .5, .2))} "
                   f"WHEN amount_risk > 0.7e0 THEN {mix((.3, .2, .5))} "
                   f"ELSE {mix((.6, .2, .2))} END",
    }[method]


@query("adaptive_threshold_hybrid", f"""WITH {_BASE}, {_VEL}
SELECT v.TransactionID, least(0.95e0, greatest(0.05e0, fraud_probability * CASE
    WHEN velocity_risk > 0.8e0 THEN 0.9e0 WHEN velocity_risk > 0.6e0 THEN 0.95e0 ELSE 1e0 END))
    AS threshold, """ + ", ".join(
        f"least(0.95e0, greatest(0.05e0, {_hybrid_sql(m)})) AS tau_{m}"
        for m in ("weighted", "dynamic", "max", "min")) + " FROM vr v")
def adaptive_threshold_hybrid(spark, d):
    df = _txn(spark, d).select(_ID, "card1", "t_us", "TransactionAmt", "fraud_probability")
    df = scoring.add_velocity_risk(online_velocity_counts(df, ["card1"]), CFG)
    current, base = F.col("fraud_probability"), F.lit(0.5)
    v, a = F.col("velocity_risk"), F.col("amount_risk")
    return df.select(
        _ID, risk.adaptive_threshold(current, v).alias("threshold"), *[
            risk.adaptive_hybrid(current, base, v, a, m).alias(f"tau_{m}")
            for m in ("weighted", "dynamic", "max", "min")])


_E = "1e-7"


def _focal_sql():
    def side(a, x, y):
        slope = f"(2 * {y} * ln({x} + {_E}) + {y} * {y} / ({x} + {_E}))"
        curve = (f"(2 * ln({x} + {_E}) + 4 * {y} / ({x} + {_E}) + {y} * {y} / ({x} * {x} + {_E}))")
        return (f"-{a}e0 * {y} * {y} * ln({x} + {_E})", f"-{a}e0 * {y} * {slope}",
                f"{a}e0 * {x} * {y} * {curve}")

    names = ("focal_loss", "focal_gradient", "focal_hessian")
    cols = ", ".join(f"round(CASE WHEN isFraud = 1 THEN {f} ELSE {g} END, 5) AS {n}" for n, f, g in
                     zip(names, side(.25, "p", "(1 - p)"), side(.75, "(1 - p)", "p")))
    return (f"{VELOCITY_SQL} SELECT TransactionID, {cols} FROM (SELECT TransactionID, isFraud, "
            "1 / (1 + exp(-(D5 - 5))) AS p FROM vr)")


@query("focal_loss", _focal_sql())
def focal_loss(spark, d):
    made = risk.focal_loss(F.col("isFraud"), F.col("D5") - 5)
    return transactions(spark, d).select(
        _ID, *[F.round(c, 5).alias(n) for n, c in made.items()])
