"""The full scoring plan: velocity, profile, rules, adaptive threshold, decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cardwatch.config import Settings
from cardwatch.functions import columns as fx, risk
from cardwatch.operators.profile import profile_history, takeover_risk
from cardwatch.operators.velocity import MICROS, online_velocity_counts

RISKS = ("velocity_risk", "amount_risk", "ato_risk")


def assess(df: DataFrame, cfg: Settings, time: str = "t_us", card: str = "card1",
           unit: int = MICROS) -> DataFrame:
    """Velocity and takeover signals of each row, from earlier rows of its card.

    One plan for all cards: windows over points split by time, profiles over chunks of rows.
    """
    seen = online_velocity_counts(df, [card], time=time, unit=unit)
    profiled = profile_history(seen, card, (time, "TransactionID"))
    return takeover_risk(add_velocity_risk(profiled, cfg), cfg)


def add_velocity_risk(df: DataFrame, cfg: Settings) -> DataFrame:
    return df.withColumns({
        "velocity_risk": risk.velocity_risk(cfg),
        "amount_risk": risk.amount_risk(cfg),
        "velocity_factors": risk.velocity_factors(cfg),
    })


def neutral_if_missing(df: DataFrame) -> DataFrame:
    """Zero risk where the state lookup gave nothing."""
    empty = F.array().cast("array<string>")
    fills: dict[str, Column] = {r: F.coalesce(r, F.lit(0.0)) for r in RISKS}
    fills["ato_detected"] = F.coalesce("ato_detected", F.lit(False))
    fills["velocity_factors"] = F.coalesce("velocity_factors", empty)
    fills["ato_factors"] = F.coalesce("ato_factors", empty)
    return df.withColumns(fills)


def decide_rows(
    df: DataFrame, cfg: Settings, probability: str = "fraud_probability",
    base: Column | None = None, hour: Column | None = None,
) -> DataFrame:
    """Combine probability, risks and rules into the decision columns."""
    base = F.lit(cfg.model.base_threshold) if base is None else base
    hour = fx.hour_of_day() if hour is None else hour
    staged = df.withColumn("dt_hour", hour).withColumns({
        "rule_factors": risk.rule_factors(),
        "hybrid_threshold": risk.hybrid_threshold(cfg, base),
        "adjusted_probability": risk.adjust_probability(F.col(probability)),
    })
    verdict = risk.decide(
        cfg, F.col("adjusted_probability"), F.col("hybrid_threshold"), F.col("ato_detected"),
        F.size("rule_factors") > 0)
    return staged.withColumns({
        "base_threshold": base,
        "rule_triggered": F.size("rule_factors") > 0,
        "risk_factors": risk.collect_factors(probability),
        "_verdict": verdict,
    }).withColumns({
        "decision": F.col("_verdict.decision"),
        "risk_level": F.col("_verdict.risk_level"),
    }).drop("_verdict")


DECISION_COLUMNS = [
    "TransactionID", "fraud_probability", "adjusted_probability", "base_threshold",
    "hybrid_threshold", "velocity_risk", "amount_risk", "ato_risk", "ato_detected",
    "rule_triggered", "decision", "risk_level", "risk_factors",
]


def make_decision(df: DataFrame, cfg: Settings | None = None) -> DataFrame:
    """Transactions with a probability -> one decision row each."""
    cfg = cfg or Settings().validate()
    return decide_rows(assess(df, cfg), cfg).select(*DECISION_COLUMNS)
