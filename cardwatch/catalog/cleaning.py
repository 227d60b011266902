"""Cleaning, filtering and column selection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardwatch.catalog.base import query, with_txn
from cardwatch.functions import fixed
from cardwatch.operators import clean
from cardwatch.operators.ordering import exact_quantiles
from cardwatch.sources.binding import TRANSACTION_RULES, transactions

ALL = ", ".join(TRANSACTION_RULES)
DELTAS = [c for c in TRANSACTION_RULES if c[0] == "D" and c[1:].isdigit()]
COUNTS = [c for c in TRANSACTION_RULES if c[0] == "C" and c[1:].isdigit()]
OPAQUE = [c for c in TRANSACTION_RULES if c[0] == "V"]


@query("normalize_text", with_txn(
    "SELECT TransactionID, " + ", ".join(
        f"lower(trim({c})) AS {c}" for c in fixed.TEXT_COLUMNS) + " FROM txn"))
def normalize_text(spark, d):
    return clean.normalize_text(transactions(spark, d)).select("TransactionID", *fixed.TEXT_COLUMNS)


@query("coerce_numeric", with_txn(
    "SELECT TransactionID, TRY_CAST(id_33 AS DOUBLE) AS id_33, "
    "TRY_CAST(CASE WHEN addr1 IS NULL THEN 'n/a' ELSE CAST(addr1 AS VARCHAR) END AS DOUBLE)"
    " AS addr1, CAST(card1 AS DOUBLE) AS card1 FROM txn"))
def coerce_numeric(spark, d):
    txn = transactions(spark, d).select(
        "TransactionID", "id_33", "card1",
        F.coalesce(F.col("addr1").cast("string"), F.lit("n/a")).alias("addr1"))
    return clean.coerce_numeric(txn, ["id_33", "addr1", "card1"])


@query("sentinel_to_null", with_txn(
    "SELECT TransactionID, NULLIF(NULLIF(CASE WHEN D5 = 3 THEN 'unknown' WHEN D5 = 4 THEN "
    "'email_not_provided' ELSE P_emaildomain END, 'unknown'), 'email_not_provided')"
    " AS P_emaildomain FROM txn"))
def sentinel_to_null(spark, d):
    dirty = F.when(F.col("D5") == 3, "unknown").when(F.col("D5") == 4, "email_not_provided")
    txn = transactions(spark, d).select(
        "TransactionID", dirty.otherwise(F.col("P_emaildomain")).alias("P_emaildomain"))
    return clean.sentinel_to_null(txn)


_MATCH = ("CASE {c} WHEN 'T' THEN 1 WHEN 't' THEN 1 WHEN 'F' THEN 0 WHEN 'f' THEN 0 "
          "WHEN 'M0' THEN 0 WHEN 'M1' THEN 1 WHEN 'M2' THEN 2 ELSE -1 END AS {c}")


@query("encode_match_flags", with_txn(
    "SELECT TransactionID, " + ", ".join(_MATCH.format(c=c) for c in fixed.MATCH_COLUMNS)
    + " FROM txn"))
def encode_match_flags(spark, d):
    return clean.encode_match_flags(transactions(spark, d)).select(
        "TransactionID", *fixed.MATCH_COLUMNS)


@query("fill_missing", with_txn(
    "SELECT TransactionID, COALESCE(DeviceType, 'missing') AS DeviceType, "
    "COALESCE(dist1, 0) AS dist1, COALESCE(D4, -999) AS D4 FROM txn"))
def fill_missing(spark, d):
    return clean.fill_missing(
        transactions(spark, d), {"DeviceType": "missing", "dist1": 0, "D4": -999}
    ).select("TransactionID", "DeviceType", "dist1", "D4")


@query("select_opaque_subset", with_txn(
    f"SELECT TransactionID, {', '.join(c for c in OPAQUE if c not in ('V2', 'V5'))} FROM txn"))
def select_opaque_subset(spark, d):
    return clean.select_opaque_subset(
        transactions(spark, d).select("TransactionID", *OPAQUE))


@query("drop_unstable_columns", with_txn(
    "SELECT " + ", ".join(c for c in TRANSACTION_RULES
                          if c not in ("C3", "M5", "id_33", "card4", "D9")) + " FROM txn"))
def drop_unstable_columns(spark, d):
    return clean.drop_unstable_columns(transactions(spark, d))


@query("drop_high_null_columns", with_txn(
    "SELECT TransactionID, addr1, D4, D11, DeviceType FROM txn"))
def drop_high_null_columns(spark, d):
    txn = transactions(spark, d).select(
        "TransactionID", "addr1", "D4", "D11", "DeviceType",
        F.when(F.col("C13") > 560, F.col("C13")).alias("mostly_missing"))
    return clean.drop_high_null_columns(txn)


@query("null_share", with_txn(
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, round(avg(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END), 6)"
        " AS null_share FROM txn" for c in TRANSACTION_RULES)))
def null_share(spark, d):
    return clean.null_share(transactions(spark, d)).select(
        "column_name", F.round("null_share", 6).alias("null_share"))


@query("filter_amount_outliers", with_txn(
    "SELECT TransactionID, TransactionAmt FROM txn WHERE TransactionAmt <= "
    "(SELECT quantile_cont(TransactionAmt, 0.99) FROM txn)"))
def filter_amount_outliers(spark, d):
    return clean.filter_amount_outliers(
        transactions(spark, d).select("TransactionID", "TransactionAmt"))


@query("exact_quantiles", with_txn(
    "SELECT round(quantile_cont(TransactionAmt, 0.01), 6) AS p01, "
    "round(quantile_cont(TransactionAmt, 0.5), 6) AS p50, "
    "round(quantile_cont(TransactionAmt, 0.9999), 6) AS p9999 FROM txn"))
def exact_quantile_row(spark, d):
    p = exact_quantiles(transactions(spark, d), "TransactionAmt", [0.01, 0.5, 0.9999])
    return spark.range(1).select(
        *[F.round(F.lit(v), 6).alias(n) for n, v in zip(("p01", "p50", "p9999"), p)])


@query("filter_count_outliers", with_txn(
    f"SELECT TransactionID, {', '.join(COUNTS)} FROM txn WHERE "
    + " AND ".join(f"({c} <= 500 OR {c} IS NULL)" for c in COUNTS)))
def filter_count_outliers(spark, d):
    return clean.filter_count_outliers(
        transactions(spark, d).select("TransactionID", *COUNTS))


@query("filter_negative_deltas", with_txn(
    f"SELECT TransactionID, {', '.join(DELTAS)} FROM txn WHERE "
    + " AND ".join(f"({c} >= 0 OR {c} IS NULL)" for c in DELTAS)))
def filter_negative_deltas(spark, d):
    return clean.filter_negative_deltas(
        transactions(spark, d).select("TransactionID", *DELTAS))


@query("inf_to_null", with_txn(
    "SELECT TransactionID, CASE WHEN D5 = 0 THEN NULL ELSE round(TransactionAmt / D5, 6) END"
    " AS ratio FROM txn"))
def inf_to_null(spark, d):
    ratio = F.when(F.col("D5") == 0, F.lit(float("inf"))).otherwise(
        F.try_divide("TransactionAmt", "D5"))
    txn = transactions(spark, d).select("TransactionID", F.round(ratio, 6).alias("ratio"))
    return clean.inf_to_null(txn, ["ratio"])


_CORR = ["C1", "C2", "C13", "D5", "D9", "D10", "D11", "D15", "V1", "V127"]


@query("correlation_matrix", with_txn(" UNION ALL ".join(
    f"SELECT '{a}' AS left_column, '{b}' AS right_column, round(abs(corr({a}, {b})), 6)"
    " AS abs_corr FROM txn" for i, a in enumerate(_CORR) for b in _CORR[i + 1:])))
def correlation_matrix(spark, d):
    return clean.correlation_pairs(transactions(spark, d), _CORR).select(
        "left_column", "right_column", F.round("abs_corr", 6).alias("abs_corr"))


@query("drop_correlated", with_txn("SELECT TransactionID, C1, C13, D15 FROM txn"))
def drop_correlated(spark, d):
    txn = transactions(spark, d).select(
        "TransactionID", "C1", "C13", "D15", (F.col("C13") * 2 + 1).alias("C13_copy"))
    return clean.drop_correlated(txn, ["C1", "C13", "D15", "C13_copy"])


@query("numeric_columns_only", with_txn(
    "SELECT TransactionAmt, card1, addr1, D15 FROM txn"))
def numeric_columns_only(spark, d):
    return clean.numeric_columns_only(transactions(spark, d).select(
        "TransactionID", "TransactionAmt", "card1", "card4", "addr1", "ProductCD", "D15",
        "isFraud"))


@query("downcast_numeric", with_txn(
    "SELECT TransactionID, CAST(card2 AS TINYINT) AS card2, CAST(card5 AS SMALLINT) AS card5, "
    "CAST(D5 AS FLOAT) AS D5 FROM (SELECT TransactionID, card2, card5, D5 FROM txn)"))
def downcast_numeric(spark, d):
    narrow = clean.downcast_numeric(transactions(spark, d).select("card2", "card5", "D5",
                                                                  "TransactionID"))
    return narrow.withColumn("TransactionID", F.col("TransactionID").cast("bigint"))


@query("validate_feature_parity", with_txn("SELECT D15, C1, TransactionAmt FROM txn"))
def validate_feature_parity(spark, d):
    txn = transactions(spark, d)
    ordered, _ = clean.validate_features(txn, ["D15", "C1", "TransactionAmt"])
    return ordered


@query("common_columns", with_txn("SELECT " + ", ".join(
    c for c in TRANSACTION_RULES if c not in ("D4", "C1", "TransactionID", "isFraud")) + " FROM txn"))
def common_columns(spark, d):
    left = transactions(spark, d)
    names = clean.common_columns(left, left.drop("D4", "C1"), drop=("TransactionID", "isFraud"))
    return left.select(*names)
