"""Behaviour profile of a card: what its last transactions looked like."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from cardwatch.config import Settings
from cardwatch.functions import risk
from cardwatch.operators.trailing import complete_key
from cardwatch.session import materialize

# How many earlier rows each part of the profile remembers.
REMEMBER = {"addresses": 10, "devices": 10, "emails": 5, "amounts": 50, "card_types": 10}


def with_history(
    df: DataFrame,
    key: list[str],
    order: list[str],
    reach: int,
    build: Callable[[WindowSpec], dict[str, Column]],
) -> DataFrame:
    """Add window columns whose frames look at most ``reach`` rows back.

    Rows are range-partitioned by (key, order), so a key spans as many chunks as its rows
    need; each chunk borrows the last ``reach`` rows before it and is then computed on its
    own. Rows whose key has a NULL part see no other row.
    """
    def apply(frame: DataFrame, window: WindowSpec) -> DataFrame:
        return frame.select("*", *[c.alias(n) for n, c in build(window).items()])

    lone = df.where(~complete_key(key)).withColumn("_alone", F.monotonically_increasing_id())
    lone = apply(lone, Window.partitionBy("_alone").orderBy(*order)).drop("_alone")
    chunks = materialize(
        df.where(complete_key(key)).repartitionByRange(*key, *order)
        .withColumn("_chunk", F.spark_partition_id()), "chunks")
    row = F.struct(*[F.col(c) for c in df.columns])
    newest = Window.partitionBy(*key, "_chunk").orderBy(*[F.desc(c) for c in order])
    tails = chunks.withColumn("_back", F.row_number().over(newest)).where(
        F.col("_back") <= reach).select(*key, *order, "_chunk", row.alias("_row"))
    starts = chunks.select(*key, "_chunk").distinct()
    line = tails.withColumn("_kind", F.lit(1)).unionByName(
        starts.withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    # at most one chunk start lies between two tail rows, so twice the reach suffices
    seen = F.collect_list("_row").over(
        Window.partitionBy(*key).orderBy("_chunk", "_kind", *order).rowsBetween(-2 * reach, -1))
    borrowed = line.select("_chunk", "_kind", seen.alias("_rows")).where("_kind = 0").select(
        "_chunk", F.explode(F.slice(
            "_rows", F.greatest(F.size("_rows") - reach + 1, F.lit(1)), reach)).alias("_row")
    ).select("_row.*", "_chunk", F.lit(True).alias("_borrowed"))
    work = chunks.withColumn("_borrowed", F.lit(False)).unionByName(borrowed)
    split = Window.partitionBy(*key, "_chunk").orderBy(*order)
    done = apply(work, split).where(~F.col("_borrowed")).drop("_borrowed", "_chunk")
    return done.unionByName(lone)


def _back(window: WindowSpec, n: int) -> WindowSpec:
    return window.rowsBetween(-n, -1)


def profile_history(
    df: DataFrame, card: str = "card1", order: tuple[str, ...] = ("t_us", "TransactionID"),
    addr1: str = "addr1", addr2: str = "addr2", device: str = "DeviceInfo",
    email: str = "P_emaildomain", card_type: str = "card6", amount: str = "TransactionAmt",
    with_amounts: bool = False, missing_text: str | None = None,
) -> DataFrame:
    """Add the profile before each row: ``seen_*`` arrays and amount statistics.

    A NULL takes a place in the history but is no value of it; ``missing_text``
    stores it as that text instead. Rows without a card have an empty profile.
    """
    def build(window: WindowSpec) -> dict[str, Column]:
        def values(c: str, n: int) -> Column:
            value = F.col(c)
            if missing_text is not None:
                value = F.coalesce(value.cast("string"), F.lit(missing_text))
            return F.collect_list(value).over(_back(window, n))

        amounts = _back(window, REMEMBER["amounts"])
        known = complete_key([card])
        made = {
            "seen_addr1": values(addr1, REMEMBER["addresses"]),
            "seen_addr2": values(addr2, REMEMBER["addresses"]),
            "seen_devices": values(device, REMEMBER["devices"]),
            "seen_emails": values(email, REMEMBER["emails"]),
            "seen_card_types": values(card_type, REMEMBER["card_types"]),
            "seen_amount_n": F.when(known, F.count(amount).over(amounts)).otherwise(F.lit(0)),
            "seen_amount_mean": F.avg(amount).over(amounts),
            "seen_amount_std": F.stddev_pop(amount).over(amounts),
        }
        if with_amounts:
            made["seen_amounts"] = F.collect_list(amount).over(amounts)
        return made

    return with_history(df, [card], list(order), REMEMBER["amounts"], build)


def takeover_risk(df: DataFrame, cfg: Settings, email: str = "P_emaildomain",
                  device: str = "DeviceInfo", card_type: str = "card6",
                  amount: str = "TransactionAmt") -> DataFrame:
    """Five anomaly signals, the weighted score, the flag and the factor texts."""
    signals = df.withColumns({
        "ato_geo": risk.ato_geo(cfg),
        "ato_device": risk.ato_device(device),
        "ato_email": risk.ato_email(cfg, email),
        "ato_amount": risk.ato_amount(cfg, amount),
        "ato_card_type": risk.ato_card_type(card_type),
    })
    return signals.withColumn("ato_risk", risk.ato_score(cfg)).withColumns({
        "ato_detected": F.col("ato_risk") >= cfg.ato.ato_detection_threshold,
        "ato_factors": risk.ato_factors(cfg, amount, "dist1", email),
    })


def profile_stats(
    df: DataFrame, card: str = "card1", order: tuple[str, ...] = ("t_us", "TransactionID"),
    address: str = "addr1", device: str = "DeviceInfo", email: str = "P_emaildomain",
    amount: str = "TransactionAmt",
) -> DataFrame:
    """Profile of every card after its last row.

    Only each card's newest rows matter: the row-number limit is applied before
    the shuffle too, so a hot card sends no more rows than any other.
    """
    newest = Window.partitionBy(card).orderBy(*[F.desc(c) for c in order])
    recent = (
        df.where(F.col(card).isNotNull())
        .withColumn("_back", F.row_number().over(newest))
        .where(F.col("_back") <= max(REMEMBER.values()))
    )

    def distinct(c: str, n: int) -> Column:
        return F.count_distinct(F.when(F.col("_back") <= n, F.col(c)))

    kept = F.when(F.col("_back") <= REMEMBER["amounts"], F.col(amount))
    return recent.groupBy(card).agg(
        distinct(address, REMEMBER["addresses"]).alias("n_addresses"),
        distinct(device, REMEMBER["devices"]).alias("n_devices"),
        distinct(email, REMEMBER["emails"]).alias("n_email_domains"),
        F.count(kept).alias("n_transactions"),
        F.avg(kept).alias("mean_amount"),
        F.stddev_pop(kept).alias("std_amount"),
        F.min(kept).alias("min_amount"),
        F.max(kept).alias("max_amount"),
    )
