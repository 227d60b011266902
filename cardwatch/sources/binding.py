"""Transaction-shaped views over the supplied event tables.

The rules are written as SQL expressions that mean the same in Spark and in any
ANSI engine, so a test can rebuild the identical input elsewhere. Amounts are
multiples of 1/8, which keeps every sum exact whatever the order of addition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def _pick(index: str, values: list[str | None]) -> str:
    whens = " ".join(
        f"WHEN {i} THEN " + ("NULL" if v is None else f"'{v}'") for i, v in enumerate(values)
    )
    return f"CASE {index} {whens} END"


def _num(expr: str, null_when: str | None = None, kind: str = "DOUBLE") -> str:
    body = f"CAST({expr} AS {kind})"
    return f"CASE WHEN {null_when} THEN NULL ELSE {body} END" if null_when else body


EMAILS = [
    "gmail.com", "yahoo.com", "hotmail.com", "anonymous.com",
    "tempmail.com", "outlook.com", "aol.com", None,
]
DEVICES = [
    "SM-G960F Build", "iOS Device", "Windows", "MacOS", "HUAWEI P20",
    "Moto G5", "Redmi Note", "LG-H870", "Pixel 3", "android emulator",
]
SCREENS = ["1920x1080", "360x640", "2220x1080", "2208x1242", "unreadable", None]
BROWSERS = ["Chrome 63.0", " SAFARI generic ", "Firefox 57", None]

# Opaque numeric columns present in the derived view.
OPAQUE = [1, 2, 3, 4, 5, 6, 8, 127, 136, 307, 309, 314, 320]

# column -> expression over (event_id, user_id, event_type, value, k, us)
TRANSACTION_RULES: dict[str, str] = {
    "TransactionID": "event_id",
    "TransactionDT": "CAST(floor(us / 1000000) AS BIGINT)",
    "t_us": "CAST(floor(us / 60) AS BIGINT)",
    "TransactionAmt": "floor(value * 200 + 0.5e0) / 8",
    "ProductCD": (
        "CASE event_type WHEN 'view' THEN 'W' WHEN 'click' THEN 'H' "
        "WHEN 'purchase' THEN 'C' WHEN 'signup' THEN 'S' ELSE 'R' END"
    ),
    "card1": "user_id",
    "card2": "CAST(user_id % 13 AS BIGINT)",
    "card3": "CAST(150 + user_id % 3 AS BIGINT)",
    "card4": _pick("user_id % 4", ["visa", "mastercard", "discover", "american express"]),
    "card5": "CAST(200 + user_id % 7 AS BIGINT)",
    "card6": _pick(
        "(user_id + CAST(floor(k / 90) AS BIGINT)) % 3", ["credit", "debit", "charge card"]
    ),
    "addr1": _num("100 + k % 5", "k % 10 = 0", "BIGINT"),
    "addr2": _num("80 + k % 4", "k % 10 = 0", "BIGINT"),
    "dist1": _num("(k * 37) % 1500", "k % 25 = 24"),
    "P_emaildomain": _pick("k % 8", EMAILS),
    "R_emaildomain": _pick("k % 3", ["gmail.com", "prodigy.net.mx", None]),
    "DeviceType": _pick("user_id % 3", ["desktop", "mobile", None]),
    "DeviceInfo": (
        "CASE WHEN k % 20 = 19 THEN NULL ELSE "
        + _pick("(user_id + CAST(floor(k / 60) AS BIGINT)) % 10", DEVICES)
        + " END"
    ),
    "D1": _num(
        "floor(us / 86400000000) - user_id % 10", "floor(us / 86400000000) < user_id % 10"
    ),
    "D2": _num("k % 13", "k % 6 = 0"),
    "D3": _num("k % 6 - 1", "k % 4 = 0"),
    "D4": _num("k % 20", "k % 7 = 0"),
    "D5": _num("k % 11"),
    "D9": _num("k % 24", "k % 8 = 0"),
    "D10": _num("k % 15"),
    "D11": _num("k % 12", "k % 5 = 0"),
    "D15": _num("k % 9", "k % 11 = 0"),
    **{
        f"C{i}": _num("k * 6" if i == 13 else f"(k * {i} + user_id) % {i + 5}",
                      "k % 9 = 0" if i == 14 else None)
        for i in range(1, 15)
    },
    **{
        f"M{i}": _pick(f"(k + {i}) % 3", ["M0", "M1", "M2"] if i == 4 else ["T", "F", None])
        for i in range(1, 10)
    },
    **{f"V{i}": _num(f"(k * {i % 17 + 1} + user_id) % 11", f"(k + {i}) % 6 = 0") for i in OPAQUE},
    "id_02": _num("(k * 13) % 50", "k % 4 = 0"),
    "id_12": _pick("k % 2", ["Found", "NotFound"]),
    "id_15": _pick("k % 3", ["New", "Found", "Unknown"]),
    "id_16": _pick("k % 4", ["Found", "NotFound", None, "Found"]),
    "id_28": _pick("user_id % 2", ["New", "Found"]),
    "id_29": _pick("k % 5", ["Found", "NotFound", "Found", None, "Found"]),
    "id_31": _pick("k % 4", BROWSERS),
    "id_33": _pick("k % 6", SCREENS),
    **{f"id_{i}": _pick(f"(k + {i}) % 4", ["T", "F", "T", None]) for i in (35, 36, 37, 38)},
    "isFraud": "CASE WHEN event_type = 'error' THEN 1 ELSE 0 END",
}

# A fixed logistic scorecard: the probability input of oracle-checked queries. The
# last two digits keep printed probabilities off rounding boundaries.
SCORE_RULE = (
    "floor(1e6 / (1e0 + exp(3.6e0 - 0.0004e0 * TransactionAmt"
    " - CASE WHEN P_emaildomain IN ('anonymous.com', 'tempmail.com') THEN 0.8e0 ELSE 0e0 END"
    " - CASE WHEN dist1 > 1000 THEN 0.5e0 ELSE 0e0 END"
    " - CASE WHEN isFraud = 1 AND D5 < 5 THEN 1.5e0 ELSE 0e0 END))) / 1e6 + 25e-8"
)

EVENT_SCHEMA = (
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string"
)


def shape_events(events: DataFrame) -> DataFrame:
    """Events -> one transaction row each (narrow map, no shuffle)."""
    base = events.select(
        "event_id",
        "user_id",
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.expr(
            "unix_micros(cast(ts as timestamp))"
            " - unix_micros(cast(timestamp_ntz'2024-01-01' as timestamp))"
        ).alias("us"),
    )
    return base.selectExpr(
        *[f"{expr} AS {name}" for name, expr in TRANSACTION_RULES.items()]
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.schema(EVENT_SCHEMA).parquet(f"{sf_dir}/events.parquet")
    return shape_events(events)


def scored(txn: DataFrame) -> DataFrame:
    """Add the scorecard probability as ``fraud_probability``."""
    return txn.selectExpr("*", f"{SCORE_RULE} AS fraud_probability")


def order_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as card payments: ties in time and a customer dimension to join."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select(
        F.col("o_orderkey").alias("TransactionID"),
        F.expr(
            "cast(floor((unix_micros(cast(o_orderdate as timestamp)) - "
            "unix_micros(cast(timestamp_ntz'1992-01-01' as timestamp))) / 1000000) as bigint)"
        ).alias("TransactionDT"),
        F.col("o_custkey").alias("card1"),
        F.floor("o_totalprice").cast("double").alias("TransactionAmt"),
        F.col("o_orderstatus").alias("ProductCD"),
    )
