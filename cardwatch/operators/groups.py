"""Per-entity statistics attached to every row.

All statistics of one key come from one ``groupBy``: partial aggregation runs
before the shuffle, so a key holding a third of the table costs no more than any
other there. The result is joined back without hints (see :func:`join_stats`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cardwatch.functions import columns as fx

EPS = 1e-5


def attach_stats(
    df: DataFrame, key: str, stats: dict[str, Column], fill: dict[str, object] | None = None
) -> DataFrame:
    """Left join of ``stats`` aggregated per ``key``; NULL keys get NULL."""
    per_key = df.where(F.col(key).isNotNull()).groupBy(key).agg(
        *[c.alias(n) for n, c in stats.items()]
    )
    return join_stats(df, per_key, key, fill)


def join_stats(
    df: DataFrame, per_key: DataFrame, key: str, fill: dict[str, object] | None = None
) -> DataFrame:
    """Left equi join that adaptive execution can broadcast or split.

    A small ``per_key`` is broadcast after its size was measured. Otherwise the row
    side may be skewed, by a hot key or by NULL keys. Skewed partitions are split only
    if both sides are plain shuffles, and an aggregate would keep the shuffle of its
    ``groupBy``; the second, redundant join key gives it a shuffle of its own.
    """
    stats = per_key.withColumnRenamed(key, "_stat_key")
    same = (F.col(key) == F.col("_stat_key")) & (
        F.xxhash64(key) == F.xxhash64("_stat_key"))
    out = df.join(stats, same, "left").drop("_stat_key")
    return out.fillna(fill) if fill else out


def ratio(value: str, stat: str) -> Column:
    """value / (stat + 1e-5); an infinite result becomes NULL."""
    return fx.inf_to_null(F.try_divide(F.col(value), F.col(stat) + F.lit(EPS)))


def amount_ratios(df: DataFrame, key: str, value: str = "TransactionAmt") -> DataFrame:
    """value to the mean and the sample deviation of its key."""
    mean, std = f"{value}_to_mean_{key}", f"{value}_to_std_{key}"
    out = attach_stats(df, key, {"_mean": F.avg(value), "_std": F.stddev_samp(value)})
    return out.withColumns({mean: ratio(value, "_mean"), std: ratio(value, "_std")}).drop(
        "_mean", "_std"
    )


def fit_amount_stats(
    df: DataFrame, key: str, value: str = "TransactionAmt", std_default: float = 50
) -> DataFrame:
    """The lookup table scoring uses: mean and deviation per key."""
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(
            F.avg(value).alias("mean_value"),
            F.coalesce(F.stddev_samp(value), F.lit(float(std_default))).alias("std_value"),
        )
    )


def behaviour_stats(columns: list[str]) -> tuple[dict[str, Column], dict[str, object]]:
    """Aggregates of the behaviour uid and the value standing for "no value"."""
    have = set(columns)
    stats = {
        "magic_uid_TransactionAmt_mean": F.avg("TransactionAmt"),
        "magic_uid_TransactionAmt_std": F.stddev_samp("TransactionAmt"),
    }
    fill: dict[str, object] = {}

    def add(name: str, agg: Column, default: object = -1) -> None:
        stats[name] = agg
        fill[name] = default

    for c in ("D4", "D9", "D10", "D15"):
        if c in have:
            add(f"magic_uid_{c}_mean", F.avg(c))
            add(f"magic_uid_{c}_std", F.stddev_samp(c))
    for c in [f"C{i}" for i in range(1, 15) if i != 3] + [f"M{i}" for i in range(1, 10)]:
        if c in have:
            add(f"magic_uid_{c}_mean", F.avg(c))
    if "C14" in have:
        add("magic_uid_C14_std", F.stddev_samp("C14"))
    return stats, fill


# feature suffix -> source column of the distinct counts per behaviour uid
BEHAVIOUR_DISTINCT = {
    "email": "P_emaildomain", "dist1": "dist1", "DT_M": "DT_M", "id02": "id_02",
    "cents": "TransactionAmt_decimal", "C13": "C13", "V314": "V314", "V127": "V127",
    "V136": "V136", "V309": "V309", "V307": "V307", "V320": "V320",
}


def behaviour_distinct(columns: list[str]) -> dict[str, str]:
    """Feature -> column whose values are counted once per behaviour uid."""
    have = set(columns)
    return {f"magic_uid_{name}_nunique": c for name, c in BEHAVIOUR_DISTINCT.items() if c in have}


def distinct_counts(df: DataFrame, key: str, counted: dict[str, str]) -> DataFrame:
    """Per ``key``, how many different values each of some columns has: new name -> column. NULL keys are left out.

    One long table of (key, column, value), of which every task keeps each triple once before it is dealt out by all
    three: a key that holds much of the table is spread over the tasks by its values. Counts of a key are then
    summed from at most one row per task. NULL is no value.
    """
    names = list(counted)

    def text(c: str) -> Column:
        real = df.schema[c].dataType.typeName() in ("double", "float")
        return (F.col(c) + F.lit(0.0) if real else F.col(c)).cast("string")  # -0.0 is 0.0

    values = [F.struct(F.lit(i).alias("_which"), text(counted[n]).alias("_value")) for i, n in enumerate(names)]
    present = F.struct(F.lit(-1).alias("_which"), F.lit("").alias("_value"))  # a key without any value has a row too
    long = df.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.inline(F.array(present, *values)))
    once = long.where(F.col("_value").isNotNull()).groupBy("_key", "_which", "_value").agg(F.lit(1).alias("_one"))
    counts = once.groupBy("_key").agg(*[
        F.count(F.when(F.col("_which") == i, 1)).alias(n) for i, n in enumerate(names)])
    return counts.withColumnRenamed("_key", key)


def attach_distinct(df: DataFrame, key: str, counted: dict[str, str]) -> DataFrame:
    """Left join of :func:`distinct_counts`: 0 where a key has no value, NULL for NULL keys."""
    out = join_stats(df, distinct_counts(df, key, counted), key)
    return out.withColumns({n: F.when(F.col(key).isNotNull(), F.coalesce(n, F.lit(0))) for n in counted})


def key_share(df: DataFrame, key: str, out: str) -> DataFrame:
    """Share of all rows holding the same key."""
    total = df.count()
    return attach_stats(df, key, {out: F.count(F.lit(1)) / F.lit(float(max(total, 1)))})


UID_MEANS = ["M9", "M5", "M4", "M1", "M7", "M8", "D2", "D15", "C13", "C9", "C1", "C11"]


def uid_aggregates(df: DataFrame) -> DataFrame:
    """Means per card1 + D1 + addr1 (missing parts become -999)."""
    key = fx.composite_key(["card1", "D1", "addr1"], "_", "-999")
    stats = {
        "TransactionAmt_uid_mean": F.avg("TransactionAmt"),
        "TransactionAmt_uid_std": F.stddev_samp("TransactionAmt"),
        **{f"{c}_uid_mean": F.avg(c) for c in UID_MEANS if c in df.columns},
    }
    return attach_stats(df.withColumn("uid_agg", key), "uid_agg", stats).drop("uid_agg")


def uid2_aggregates(df: DataFrame) -> DataFrame:
    """Match-flag mean and deviation per card1 + addr1."""
    key = fx.composite_key(["card1", "addr1"], "_", "-999")
    stats: dict[str, Column] = {}
    for c in ("M4", "M1", "M7", "M8"):
        if c in df.columns:
            stats[f"{c}_uid2_mean"] = F.avg(c)
            stats[f"{c}_uid2_std"] = F.stddev_samp(c)
    return attach_stats(df.withColumn("uid2", key), "uid2", stats).drop("uid2")


def uid_profile_wide(df: DataFrame, key: str = "magic_uid") -> DataFrame:
    """One wide row per uid."""
    have = set(df.columns)
    aggs = [f(F.col("TransactionAmt")).alias(f"uid_TransactionAmt_{n}") for n, f in
            (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))]
    deltas = ["D1", "D2", "D3", "D4", "D5", "D10", "D11", "D15"]
    for c in [f"C{i}" for i in range(1, 15)] + deltas:
        if c in have:
            aggs += [F.avg(c).alias(f"uid_{c}_mean"), F.stddev_samp(c).alias(f"uid_{c}_std")]
    aggs += [F.count_distinct(c).alias(f"uid_{c}_nunique") for c in ("M1", "M2", "M3")
             if c in have]
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*aggs)


def group_mean_std(df: DataFrame, groups: dict[str, Column], values: list[str]) -> DataFrame:
    """{value}_{group}_{mean,std} for every group key, NULL -> -1."""
    out = df
    for group, key in groups.items():
        stats: dict[str, Column] = {}
        for v in values:
            stats[f"{v}_{group}_mean"] = F.avg(v)
            stats[f"{v}_{group}_std"] = F.stddev_samp(v)
        out = attach_stats(
            out.withColumn("_group_key", key), "_group_key", stats, {n: -1 for n in stats}
        ).drop("_group_key")
    return out


def row_mean(cols: list[Column]) -> Column:
    """Mean over the non-NULL values of a row."""
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cols), F.lit(0.0))
    n = sum((c.isNotNull().cast("int") for c in cols), F.lit(0))
    return F.when(n > 0, total / n)


def opaque_group_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Row mean over the opaque columns of each per-group statistic."""
    plans = {
        "card1": {"mean": F.avg, "std": F.stddev_samp, "max": F.max, "min": F.min},
        "addr1": {"mean": F.avg, "std": F.stddev_samp},
        "DeviceInfo": {"mean": F.avg},
    }
    out = df
    for key, stats in plans.items():
        if key not in df.columns:
            continue
        label = "device" if key == "DeviceInfo" else key
        per_key = (
            df.where(F.col(key).isNotNull())
            .groupBy(key)
            .agg(*[f(F.col(c).cast("double")).alias(f"{s}_{c}")
                   for s, f in stats.items() for c in columns])
            .select(key, *[row_mean([F.col(f"{s}_{c}") for c in columns])
                           .alias(f"v_{label}_{s}") for s in stats])
        )
        out = join_stats(out, per_key, key)
    return out


def opaque_row_stats(columns: list[str]) -> dict[str, Column]:
    nulls = sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0))
    cols = [F.col(c) for c in columns]
    return {
        "v_null_count": nulls,
        "v_null_ratio": nulls / len(columns),
        "v_range": F.greatest(*cols) - F.least(*cols),
    }


def network_counts(df: DataFrame) -> DataFrame:
    """Distinct partners of a card, address and e-mail domain, and the flags they raise."""
    zero = F.lit(0)
    out = attach_distinct(df, "card1", {
        "card1_addr1_count": "addr1", "card1_device_count": "DeviceInfo", "card1_product_count": "ProductCD"})
    out = attach_distinct(out, "addr1", {"addr1_card1_count": "card1"})
    out = attach_distinct(out, "P_emaildomain", {"email_card1_count": "card1"})
    counts = ["card1_addr1_count", "card1_device_count", "card1_product_count",
              "addr1_card1_count", "email_card1_count"]
    out = out.withColumns({c: F.coalesce(c, zero) for c in counts})
    flags = {
        "card1_multiple_addr": F.col("card1_addr1_count") > 1,
        "addr1_multiple_cards": F.col("addr1_card1_count") > 3,
        "card1_multiple_devices": F.col("card1_device_count") > 1,
        "email_multiple_cards": F.col("email_card1_count") > 2,
    }
    score = sum((c.cast("int") for c in flags.values()), zero)
    return out.withColumns({
        **{n: c.cast("int") for n, c in flags.items()},
        "card1_single_product": (F.col("card1_product_count") == 1).cast("int"),
        "network_risk_score": score,
    })


def rare_to_other(
    df: DataFrame, column: str, min_rows: int = 100, other: str = "OTHER"
) -> DataFrame:
    """Values with fewer rows become OTHER; all values upper case."""
    out = attach_stats(df, column, {"_rows": F.count(F.lit(1))})
    value = F.when(F.col("_rows") < min_rows, other).otherwise(F.upper(column))
    return out.withColumn(column, value).drop("_rows")


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).distinct()
