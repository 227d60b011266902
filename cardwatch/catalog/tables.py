"""Scans, payloads, joins and fitted artifacts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cardwatch.catalog.base import SCORED_CTE, TXN_CTE, query, with_scored, with_txn
from cardwatch.functions import risk
from cardwatch.operators import encode, groups, joins, split
from cardwatch.session import scratch_path
from cardwatch.sources import payload, schemas, tables
from cardwatch.sources.binding import TRANSACTION_RULES, scored, transactions

_ID = "TransactionID"
_IDENTITY = ["DeviceType", "DeviceInfo", "id_02", "id_12", "id_31", "id_33"]


#: Columns that the written file lacks.
_ABSENT = ("dist1", "id_33")


@query("scan_transactions", with_txn("SELECT " + ", ".join(
    f"NULL AS {c}" if c in _ABSENT else c for c in TRANSACTION_RULES) + " FROM txn"))
def scan_transactions(spark, d):
    """A CSV file with its columns in another order, two of them absent and one unknown."""
    df = transactions(spark, d)
    path = scratch_path(spark, "transactions")
    names = [c for c in reversed(df.columns) if c not in _ABSENT]
    df.select(*names, F.lit("x").alias("unknown")).write.options(
        header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return tables.scan_transactions(spark, path, "csv", schema=df.schema)


@query("scan_csv", with_txn(
    "SELECT TransactionID, card1, TransactionAmt, P_emaildomain, addr1 FROM txn"))
def scan_csv(spark, d):
    """Writes the table as CSV with a header and scans it back with a fixed schema."""
    df = transactions(spark, d).select(_ID, "card1", "TransactionAmt", "P_emaildomain", "addr1")
    path = scratch_path(spark, "csv")
    df.write.option("header", True).csv(path)
    return tables.scan_transactions(spark, path, "csv", schema=df.schema)


def _identity(spark, d):
    """Identity rows exist for some transactions only."""
    return transactions(spark, d).where("C1 < 4").select(_ID, *_IDENTITY)


@query("scan_identity_optional", with_txn(
    "SELECT TransactionID, DeviceInfo FROM txn WHERE C1 < 4"))
def scan_identity_optional(spark, d):
    path = scratch_path(spark, "identity")
    identity = _identity(spark, d)
    identity.write.parquet(path)
    found = tables.scan_identity_optional(spark, path, schema=identity.schema)
    absent = tables.scan_identity_optional(spark, path + "-absent", schema=identity.schema)
    return found.unionByName(absent).select(_ID, "DeviceInfo")


@query("join_identity", with_txn(f"""SELECT t.TransactionID, t.TransactionAmt,
  {', '.join('i.' + c for c in _IDENTITY)} FROM txn t
LEFT JOIN (SELECT * FROM txn WHERE C1 < 4) i ON t.TransactionID = i.TransactionID"""))
def join_identity(spark, d):
    return joins.join_identity(
        transactions(spark, d).select(_ID, "TransactionAmt"), _identity(spark, d))


def _wire(spark, d):
    """Transactions as JSON messages; some are cut short."""
    names = {f.name for f in schemas.transaction_schema()}
    df = transactions(spark, d)
    text = F.to_json(F.struct(*[F.col(c) for c in df.columns if c in names]))
    broken = F.col("C13") == 42
    return df.select(_ID, F.when(broken, F.substring(text, 1, 20)).otherwise(text)
                     .cast("binary").alias("value"))


_WIRE = ["TransactionAmt", "ProductCD", "card1", "addr1", "P_emaildomain", "D15", "M4", "V127",
         "DeviceInfo", "id_02"]


@query("parse_payload_json", with_txn("SELECT CAST(TransactionID AS VARCHAR) AS TransactionID, "
       "TransactionDT, " + ", ".join(
           f"CAST({c} AS DOUBLE) AS {c}" if c in ("card1", "addr1") else c for c in _WIRE)
       + ", FALSE AS corrupt FROM txn WHERE C13 <> 42 UNION ALL SELECT NULL, NULL, "
       + ", ".join("NULL" for _ in _WIRE) + ", TRUE FROM txn WHERE C13 = 42"))
def parse_payload_json(spark, d):
    out = payload.parse_payload_json(_wire(spark, d), schemas.transaction_schema())
    good = F.col(payload.CORRUPT).isNull()
    return out.select(*[F.when(good, F.col(c)).alias(c) for c in [_ID, "TransactionDT", *_WIRE]],
                      (~good).alias("corrupt"))


@query("open_payload_fields", with_txn(
    "SELECT TransactionID, CAST(card1 AS VARCHAR) AS extra_card1 FROM txn"))
def open_payload_fields(spark, d):
    df = transactions(spark, d).select(
        _ID, F.to_json(F.struct("TransactionID", "TransactionAmt", "card1")).alias("value"))
    extra = payload.extra_fields("value", ["TransactionID", "TransactionAmt"])
    return df.select(_ID, F.try_element_at(extra, F.lit("card1")).alias("extra_card1"))


@query("serialize_prediction_json", with_scored("""
SELECT CAST(json_extract_string(value, '$.transaction_id') AS BIGINT) AS transaction_id,
  json_extract_string(value, '$.decision') AS decision,
  CAST(json_extract(value, '$.TransactionAmt') AS DOUBLE) AS amount
FROM (SELECT to_json({'transaction_id': TransactionID, 'decision': CASE WHEN fraud_probability
  >= 0.0564e0 THEN 'FRAUD' ELSE 'LEGITIMATE' END, 'TransactionAmt': TransactionAmt}) AS value
  FROM scored)"""))
def serialize_prediction_json(spark, d):
    made = risk.simple_decision(F.col("fraud_probability"), 0.0564)
    df = scored(transactions(spark, d)).select(
        F.col(_ID).alias("transaction_id"), made["decision"].alias("decision"), "TransactionAmt")
    text = payload.serialize_prediction_json(df)
    return text.select(
        F.get_json_object("value", "$.transaction_id").cast("bigint").alias("transaction_id"),
        F.get_json_object("value", "$.decision").alias("decision"),
        F.get_json_object("value", "$.TransactionAmt").cast("double").alias("amount"))


def _topic(spark, d, fraud):
    hit = F.col("fraud_probability") >= 0.0564
    df = scored(transactions(spark, d)).where(hit if fraud else ~hit).select(
        _ID, "fraud_probability")
    return payload.serialize_prediction_json(df)


@query("consume_predictions", with_scored("""SELECT TransactionID, fraud_probability,
  CASE WHEN fraud_probability >= 0.0564e0 THEN 'FRAUD' ELSE 'LEGIT' END AS type FROM scored"""))
def consume_predictions(spark, d):
    schema = StructType.fromDDL("TransactionID bigint, fraud_probability double")

    def parsed(fraud):
        return payload.parse_payload_json(_topic(spark, d, fraud), schema).drop(payload.CORRUPT)

    return joins.union_predictions(parsed(True), parsed(False))


@query("union_predictions", with_scored("""
SELECT TransactionID, card1, NULL AS P_emaildomain, 'FRAUD' AS type FROM scored
WHERE fraud_probability >= 0.0564e0 UNION ALL
SELECT TransactionID, card1, P_emaildomain, 'LEGIT' FROM scored
WHERE fraud_probability < 0.0564e0"""))
def union_predictions(spark, d):
    df = scored(transactions(spark, d))
    hit = F.col("fraud_probability") >= 0.0564
    return joins.union_predictions(
        df.where(hit).select(_ID, "card1"), df.where(~hit).select(_ID, "card1", "P_emaildomain"))


@query("normalize_payload", with_txn("""SELECT CAST(TransactionID AS VARCHAR) AS TransactionID,
  CASE WHEN D5 IN (0, 1, 2) THEN NULL ELSE TransactionAmt END AS TransactionAmt,
  CASE WHEN D5 = 3 THEN 'W' ELSE ProductCD END AS ProductCD, '2024-01-01T00:00:00' AS timestamp
FROM txn"""))
def normalize_payload(spark, d):
    odd = (F.when(F.col("D5") == 0, F.lit(float("nan"))).when(F.col("D5") == 1, float("inf"))
           .when(F.col("D5") == 2, float("-inf")).otherwise(F.col("TransactionAmt")))
    df = transactions(spark, d).select(
        _ID, odd.alias("TransactionAmt"),
        F.when(F.col("D5") != 3, F.col("ProductCD")).alias("ProductCD"),
        F.lit("2024-01-01T00:00:00").alias("timestamp"))
    return payload.normalize_payload(df)


@query("validate_payload", with_txn("""SELECT TransactionID,
  CASE WHEN addr1 IS NOT NULL AND TransactionAmt - 100 > 0 THEN 'accepted' ELSE 'rejected' END
    AS outcome FROM txn"""))
def validate_payload(spark, d):
    amount = F.when(F.col("addr1").isNotNull(), F.col("TransactionAmt") - 100)
    good, bad = payload.validate_payload(
        transactions(spark, d).select(_ID, amount.alias("TransactionAmt")))
    return good.select(_ID, F.lit("accepted").alias("outcome")).unionByName(
        bad.select(_ID, F.lit("rejected").alias("outcome")))


@query("dedup_against_seen", with_txn("""SELECT DISTINCT TransactionID, card1 FROM txn
WHERE NOT (C13 < 100)"""))
def dedup_against_seen(spark, d):
    txn = transactions(spark, d)
    seen = txn.where("C13 < 100").select(_ID)
    twice = txn.select(_ID, "card1").unionAll(txn.select(_ID, "card1"))
    return joins.dedup_against_seen(twice, seen)


_REPLIES = """q AS (SELECT TransactionID AS transaction_id, t_us // 1000 AS request_ts FROM txn),
rp AS (SELECT TransactionID AS transaction_id,
    t_us // 1000 + CAST(D5 * 300 AS BIGINT) AS reply_ts,
    CASE WHEN fraud_probability >= 0.0564e0 THEN 'BLOCK' ELSE 'APPROVE' END AS decision,
    fraud_probability AS probability, 'LOW' AS risk_level FROM scored WHERE C1 < 5)"""


@query("match_reply", f"""WITH {SCORED_CTE}, {_REPLIES}
SELECT q.transaction_id, CASE WHEN rp.decision IS NULL THEN 'timeout'
    WHEN rp.decision = 'APPROVE' THEN 'approved' ELSE 'blocked' END AS status,
  rp.decision, rp.probability, rp.risk_level, rp.reply_ts - q.request_ts AS latency_ms
FROM q LEFT JOIN rp ON q.transaction_id = rp.transaction_id
  AND rp.reply_ts BETWEEN q.request_ts AND q.request_ts + 2000""")
def match_reply(spark, d):
    df = scored(transactions(spark, d)).withColumn("asked", F.floor(F.col("t_us") / 1000))
    requests = df.select(F.col(_ID).alias("transaction_id"), F.col("asked").alias("request_ts"))
    replies = df.where("C1 < 5").select(
        F.col(_ID).alias("transaction_id"),
        (F.col("asked") + (F.col("D5") * 300).cast("bigint")).alias("reply_ts"),
        F.when(F.col("fraud_probability") >= 0.0564, "BLOCK").otherwise("APPROVE")
        .alias("decision"),
        F.col("fraud_probability").alias("probability"), F.lit("LOW").alias("risk_level"))
    return joins.match_reply(requests, replies)


_TRAIN_CTE = f"""{TXN_CTE}, ranked AS (SELECT *, row_number() OVER (ORDER BY TransactionDT,
  TransactionID) AS rn, count(*) OVER () AS n FROM txn),
train AS (SELECT * FROM ranked WHERE rn <= floor(n * 0.8))"""


@query("save_fitted_stats", f"""WITH {_TRAIN_CTE}
SELECT CAST(card1 AS VARCHAR) AS value, count(*) / (SELECT count(*) FROM train) AS share
FROM train GROUP BY card1""")
def save_fitted_stats(spark, d):
    return _round_trip(spark, d)[0]["shares"].where("column_name = 'card1'").select(
        "value", "share")


@query("load_fitted_stats", with_txn(
    "SELECT count(*) AS n, 0.38e0 AS threshold, TRUE AS threshold_mismatch FROM txn"))
def load_fitted_stats(spark, d):
    _, meta = _round_trip(spark, d)
    rows = transactions(spark, d).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("n", F.lit(meta["threshold"]).alias("threshold"),
                       F.lit(meta["threshold_mismatch"]).alias("threshold_mismatch"))


def _round_trip(spark, d):
    train, _ = split.chronological_split(transactions(spark, d))
    fitted = {
        "shares": encode.fit_shares(train, ["card1", "ProductCD"]),
        "card1_amounts": groups.fit_amount_stats(train, "card1"),
    }
    path = scratch_path(spark, "fitted")
    tables.save_fitted_stats(fitted, {"threshold": 0.38, "feature_names": ["a", "b"]}, path)
    return tables.load_fitted_stats(spark, path, list(fitted), config_threshold=0.0564)
