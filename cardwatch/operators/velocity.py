"""Velocity features: how often and how much an entity paid lately."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cardwatch.operators.trailing import (
    complete_key, distinct_trailing, trailing_stats,
)

HOUR = 3600
CARD_WINDOWS = {"1h": 1, "3h": 3, "6h": 6, "12h": 12, "24h": 24}
USER_WINDOWS = {"1h": 1, "6h": 6, "24h": 24, "7d": 168}
MICROS = 1_000_000


def _widths(hours: dict[str, int], unit: int) -> dict[str, int]:
    return {name: h * HOUR * unit for name, h in hours.items()}


def card_window_velocity(
    df: DataFrame, card: str = "card1", time: str = "TransactionDT",
    amount: str = "TransactionAmt", unit: int = 1,
) -> DataFrame:
    """Count, sum, mean and sample deviation in [t - w, t], the row included.

    Missing cards and undefined statistics become 0. ``unit`` is ticks per second.
    """
    out = trailing_stats(
        df, key=[card], time=time, value=amount, widths=_widths(CARD_WINDOWS, unit),
        stats=("rows", "sum", "mean", "std_samp"), inclusive=True)
    names = {"sum": "sum", "mean": "mean", "std_samp": "std"}
    renames = {f"rows_{w}": f"card1_txn_count_{w}" for w in CARD_WINDOWS}
    for stat, label in names.items():
        renames.update({f"{stat}_{w}": f"card1_amt_{label}_{w}" for w in CARD_WINDOWS})
    out = out.withColumnsRenamed(renames)
    return out.fillna(0, [f"card1_amt_{label}_{w}" for w in CARD_WINDOWS
                          for label in names.values()])


def velocity_ratios() -> dict[str, Column]:
    def count(w: str) -> Column:
        return F.col(f"card1_txn_count_{w}")

    return {
        "velocity_ratio_3h_1h": count("3h") / (count("1h") + 1),
        "velocity_ratio_24h_3h": count("24h") / (count("3h") + 1),
    }


def amount_spike(amount: str = "TransactionAmt") -> dict[str, Column]:
    return {
        f"amt_spike_{w}": F.col(amount) / (F.col(f"card1_amt_mean_{w}") + 1) - 1
        for w in ("1h", "24h")
    }


def user_window_velocity(
    df: DataFrame, uid: str = "uid", time: str = "t_us", row_id: str = "TransactionID",
    amount: str = "TransactionAmt", unit: int = MICROS,
) -> DataFrame:
    """Statistics of strictly earlier rows (by time, then id) with t >= now - w.

    The RANGE part ends before t; rows of equal time and smaller id are added by
    pooling both parts, so ties count exactly once.
    """
    work = df.withColumn("_amt", F.coalesce(amount, F.lit(0.0)))
    out = trailing_stats(
        work, key=[uid], time=time, value="_amt", widths=_widths(USER_WINDOWS, unit),
        stats=("n", "sum", "mean", "std_pop", "max"))
    tied = Window.partitionBy(uid, time).orderBy(row_id).rowsBetween(
        Window.unboundedPreceding, -1)
    peers = {
        "_pn": F.count("_amt").over(tied), "_ps": F.sum("_amt").over(tied),
        "_pd": F.stddev_pop("_amt").over(tied), "_pm": F.max("_amt").over(tied),
    }
    # rows without an entity are nobody's peers
    out = out.select("*", *[F.when(complete_key([uid]), c).alias(n) for n, c in peers.items()])
    zero = F.lit(0.0)
    made: dict[str, Column] = {}
    for w in USER_WINDOWS:
        n1, n2 = F.col(f"n_{w}"), F.coalesce("_pn", F.lit(0))
        s1, s2 = F.coalesce(f"sum_{w}", zero), F.coalesce("_ps", zero)
        d1, d2 = F.coalesce(f"std_pop_{w}", zero), F.coalesce("_pd", zero)
        n, total = n1 + n2, s1 + s2
        gap = F.when((n1 > 0) & (n2 > 0), s1 / n1 - s2 / n2).otherwise(zero)
        square = n1 * d1 * d1 + n2 * d2 * d2 + F.when(n > 0, gap * gap * n1 * n2 / n)
        made[f"txn_count_{w}"] = n
        made[f"amt_sum_{w}"] = total
        made[f"amt_mean_{w}"] = F.when(n > 0, total / n).otherwise(zero)
        made[f"amt_std_{w}"] = F.when(n > 1, F.sqrt(square / n)).otherwise(zero)
        made[f"amt_max_{w}"] = F.coalesce(F.greatest(f"max_{w}", "_pm"), zero)
    return out.select(*df.columns, *[c.alias(n) for n, c in made.items()])


def velocity_risk_score(amount: str = "TransactionAmt") -> dict[str, Column]:
    """Score over the columns of :func:`user_window_velocity`."""
    def clip(c: Column, top: float = 1.0) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(top), c))

    def spike(w: str) -> Column:
        mean = F.col(f"amt_mean_{w}")
        return F.when(mean > 0, clip(F.col(amount) / mean, 10.0) / 10).otherwise(0.0)

    parts = {
        "freq_risk_1h": clip(F.col("txn_count_1h") / 10),
        "freq_risk_24h": clip(F.col("txn_count_24h") / 50),
        "amt_risk_24h": clip(F.col("amt_sum_24h") / 10000),
        **{f"amt_spike_{w}": spike(w) for w in ("1h", "6h", "24h")},
    }
    score = clip(
        0.3 * parts["freq_risk_1h"] + 0.2 * parts["freq_risk_24h"] + 0.2 * parts["amt_risk_24h"]
        + 0.15 * parts["amt_spike_1h"] + 0.15 * parts["amt_spike_24h"])
    return {**parts, "velocity_risk_score": score}


def online_velocity_counts(
    df: DataFrame, key: list[str], time: str = "t_us", amount: str = "TransactionAmt",
    unit: int = MICROS, distinct: bool = False,
) -> DataFrame:
    """What the state store would answer before recording the row.

    Rows without an amount are never recorded, but still asked about. With
    ``distinct`` equal amounts and equal times count once, as a sorted set of
    their texts would.
    """
    widths = _widths(USER_WINDOWS, unit)
    zero = F.lit(0.0)
    if not distinct:
        out = trailing_stats(
            df, key=key, time=time, value=amount, widths=widths, stats=("n", "sum", "mean"))
        return out.select(
            *df.columns,
            *[F.col(f"n_{w}").alias(f"txn_count_{w}") for w in USER_WINDOWS],
            F.coalesce("sum_1h", zero).alias("amt_sum_1h"),
            F.coalesce("sum_24h", zero).alias("amt_sum_24h"),
            F.coalesce("mean_24h", zero).alias("amt_mean_24h"))
    times = df.where(F.col(amount).isNotNull()).groupBy(*key, time).agg(
        F.lit(1.0).alias("_seen"))
    asked = df.select(*key, time).distinct().join(times, [*key, time], "left")
    counted = trailing_stats(
        asked, key=key, time=time, value="_seen", widths=widths, stats=("n",))
    amounts = distinct_trailing(
        df, key=key, time=time, value=amount, widths={w: widths[w] for w in ("1h", "24h")})
    mean = F.when(F.col("n_24h") > 0, F.col("sum_24h") / F.col("n_24h"))
    out = amounts.select(
        *df.columns,
        F.coalesce("sum_1h", zero).alias("amt_sum_1h"),
        F.coalesce("sum_24h", zero).alias("amt_sum_24h"),
        F.coalesce(mean, zero).alias("amt_mean_24h"))
    counts = counted.select(
        *key, time, *[F.col(f"n_{w}").alias(f"txn_count_{w}") for w in USER_WINDOWS])
    out = out.join(counts, [*key, time], "left")
    return out.fillna(0, [f"txn_count_{w}" for w in USER_WINDOWS])


def velocity_stats(
    df: DataFrame, key: list[str], now: int, time: str = "t_us",
    amount: str = "TransactionAmt", unit: int = MICROS,
) -> DataFrame:
    """Counts and amounts per key in [now - w, now]: one partial aggregation."""
    widths = _widths(USER_WINDOWS, unit)

    def within(w: str) -> Column:
        return F.col(time).between(now - widths[w], now) & F.col(amount).isNotNull()

    aggs = [F.count(F.when(within(w), 1)).alias(f"txn_count_{w}") for w in widths]
    zero = F.lit(0.0)
    for w in ("1h", "24h"):
        aggs.append(F.coalesce(F.sum(F.when(within(w), F.col(amount))), zero)
                    .alias(f"amt_sum_{w}"))
    aggs.append(F.coalesce(F.avg(F.when(within("24h"), F.col(amount))), zero)
                .alias("amt_mean_24h"))
    return df.where(complete_key(key)).groupBy(*key).agg(*aggs)
