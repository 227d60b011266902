"""Aggregates a monitoring view needs over the prediction stream or table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cardwatch.functions import risk
from cardwatch.operators.split import recent_n

ARRIVAL = ("t_us", "TransactionID")


def has_factor(text: str, factors: str = "risk_factors") -> Column:
    """Any factor containing the text, case-insensitively."""
    return F.exists(F.col(factors), lambda f: F.contains(F.lower(f), F.lit(text.lower())))


def filter_by_factor(df: DataFrame, text: str, factors: str = "risk_factors") -> DataFrame:
    return df.where(has_factor(text, factors))


def filter_high_amount(df: DataFrame, amount: str = "TransactionAmt", bound: float = 1000):
    return df.where(F.col(amount) > bound)


def lookup_by_id(df: DataFrame, value: object, column: str = "TransactionID") -> DataFrame:
    return df.where(F.col(column) == F.lit(value))


def threshold_shift() -> Column:
    """How the row's threshold moved against the base."""
    return (F.when(F.col("hybrid_threshold") < F.col("base_threshold"), "lowered")
            .when(F.col("hybrid_threshold") > F.col("base_threshold"), "raised"))


def alert_families() -> dict[str, Column]:
    return {
        "ato_detections": F.col("ato_detected"),
        "velocity_alerts": has_factor("txn_count"),
        "amount_alerts": has_factor("amount"),
        "email_risk_alerts": has_factor("email"),
        "threshold_adjustments": threshold_shift().isNotNull(),
    }


def monitor_counters(df: DataFrame) -> DataFrame:
    """One row of totals over predictions tagged with ``type``."""
    fraud = F.col("type") == "FRAUD"
    n = F.count(F.lit(1))
    return df.agg(
        n.alias("total_predictions"),
        F.count(F.when(fraud, 1)).alias("fraud_count"),
        F.count(F.when(~fraud, 1)).alias("legit_count"),
        F.try_divide(F.count(F.when(fraud, 1)) * 100.0, n).alias("fraud_rate"),
        F.avg(F.when(fraud, F.col("fraud_probability"))).alias("avg_fraud_probability"),
        *[F.count(F.when(c, 1)).alias(name) for name, c in alert_families().items()],
    )


def takeover_summary(df: DataFrame, n: int = 50) -> DataFrame:
    """Averages over the last takeover incidents."""
    last = recent_n(df.where("ato_detected"), n, ARRIVAL)
    return last.agg(
        F.count(F.lit(1)).alias("incidents"), F.avg("ato_risk").alias("avg_ato_risk"),
        F.avg("velocity_risk").alias("avg_velocity_risk"),
        F.count(F.when(F.size("ato_factors") > 1, 1)).alias("multi_signal"))


def decision_distribution(df: DataFrame, column: str, n: int = 100) -> DataFrame:
    return recent_n(df, n, ARRIVAL).groupBy(column).agg(F.count(F.lit(1)).alias("rows"))


def detection_breakdown(df: DataFrame, n: int = 100) -> DataFrame:
    """First matching cause of the last fraud rows."""
    cause = (
        F.when(F.col("ato_detected"), "ATO Detection")
        .when(has_factor("txn_count"), "Velocity Rules")
        .when(has_factor("amount"), "Amount Rules")
        .when(has_factor("email"), "Email Rules")
        .otherwise("ML Model Only"))
    last = recent_n(df.where(F.col("type") == "FRAUD"), n, ARRIVAL)
    return last.groupBy(cause.alias("cause")).agg(F.count(F.lit(1)).alias("rows"))


def threshold_adjust_breakdown(df: DataFrame, n: int = 50) -> DataFrame:
    # ordering by the condition instead of filtering on it first: a pushed filter would
    # repeat the whole threshold expression and outgrow generated code
    moved = df.select(*ARRIVAL, threshold_shift().alias("shift"))
    newest = [F.desc(c) for c in ARRIVAL]
    last = moved.orderBy(F.col("shift").isNull(), *newest).limit(n)
    return last.where("shift IS NOT NULL").groupBy("shift").agg(
        F.count(F.lit(1)).alias("rows"))


def rolling_fraud_rate(df: DataFrame, n: int = 100, window: int = 10) -> DataFrame:
    """Fraud percentage of every ``window`` consecutive rows among the last ``n``."""
    last = recent_n(df, n, ARRIVAL)  # at most n rows from here on
    forward = Window.orderBy(*ARRIVAL).rowsBetween(0, window - 1)
    hit = (F.col("type") == "FRAUD").cast("int")
    place = F.row_number().over(Window.orderBy(*ARRIVAL)) - 1
    rows = last.select(
        place.alias("position"), (F.avg(hit).over(forward) * 100).alias("fraud_rate"),
        F.count(F.lit(1)).over(Window.partitionBy()).alias("_n"))
    return rows.where(F.col("position") < F.col("_n") - window).drop("_n")


def recent_window_stats(df: DataFrame) -> DataFrame:
    """Row-based "last minute" counts and last-ten averages."""
    def last(kind: str | None, n: int) -> DataFrame:
        return recent_n(df if kind is None else df.where(F.col("type") == kind), n, ARRIVAL)

    parts = [
        last("FRAUD", 60).agg(F.count(F.lit(1)).alias("fraud_last_minute")),
        last("LEGIT", 60).agg(F.count(F.lit(1)).alias("legit_last_minute")),
        last("FRAUD", 10).agg(F.coalesce(F.avg("fraud_probability"), F.lit(0.0))
                              .alias("avg_fraud_probability")),
        last(None, 10).agg(F.coalesce(F.avg("TransactionAmt"), F.lit(0.0)).alias("avg_amount")),
    ]
    out = parts[0].withColumn("_one", F.lit(1))
    for part in parts[1:]:  # one row each
        out = out.join(part.withColumn("_one", F.lit(1)), "_one")
    return out.drop("_one")


def format_transaction_row(df: DataFrame) -> DataFrame:
    """The display row: texts cut to length, badges for alert families."""
    text = F.array_join("risk_factors", ",")
    badges = F.array_join(F.array_compact(F.array(
        F.when(F.col("ato_detected"), "ATO"), F.when(has_factor("txn_count"), "VELOCITY"),
        F.when(has_factor("email"), "EMAIL"))), " ")
    return df.select(
        F.substring(F.coalesce(F.col("TransactionID").cast("string"), F.lit("N/A")), 1, 12)
        .alias("tx_id"),
        F.coalesce("decision", F.lit("N/A")).alias("decision"),
        F.coalesce("risk_level", F.lit("N/A")).alias("risk"),
        risk.fixed_text(F.coalesce("fraud_probability", F.lit(0.0)), 3).alias("prob"),
        F.concat(F.lit("$"), risk.fixed_text(F.coalesce("TransactionAmt", F.lit(0.0)), 2))
        .alias("amount"),
        F.concat(F.coalesce(F.col("card1").cast("string"), F.lit("N/A")), F.lit(" ("),
                 F.coalesce("card4", F.lit("N/A")), F.lit(")")).alias("card"),
        F.coalesce(F.substring("P_emaildomain", 1, 20), F.lit("N/A")).alias("email"),
        F.coalesce("ProductCD", F.lit("N/A")).alias("product"),
        F.when(badges == "", F.lit("-")).otherwise(badges).alias("alerts"),
        F.when(F.length(text) > 80, F.concat(F.substring(text, 1, 80), F.lit("...")))
        .otherwise(text).alias("risk_factors"))


def alert_payload(df: DataFrame, key: str = "TransactionID", user: str | None = "user_id"):
    """Subject and body of the alert mail of each fraud row."""
    ident = F.col(key).cast("string")
    user_text = (F.coalesce(F.col(user).cast("string"), F.lit("N/A"))
                 if user and user in df.columns else F.lit("N/A"))
    subject = F.concat(F.lit("Fraud Alert: "), F.coalesce("risk_level", F.lit("UNKNOWN")),
                       F.lit(" Risk Transaction Detected (ID: "), ident, F.lit(")"))
    body = F.concat_ws(
        "\n",
        F.concat(F.lit("- Transaction ID: "), ident),
        F.concat(F.lit("- User ID: "), user_text),
        F.concat(F.lit("- Amount: $"), risk.fixed_text(F.col("TransactionAmt"), 2),
                 F.lit(" USD")),
        F.concat(F.lit("- Risk Level: "), F.coalesce("risk_level", F.lit("UNKNOWN"))),
        F.concat(F.lit("- Fraud Probability: "),
                 risk.fixed_text(F.col("fraud_probability") * 100, 1), F.lit("%")),
        F.concat(F.lit("- Decision: "), F.coalesce("decision", F.lit("REVIEW"))))
    return df.where(F.col(key).isNotNull()).select(
        F.col(key), subject.alias("subject"), body.alias("body"))
