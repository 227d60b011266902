"""Category encodings: counts, shares, smoothed target means, dense codes.

The maps of all columns are fitted in one pass: the columns are unpivoted into
(column_name, value) pairs, which partial aggregation collapses before the
shuffle. Fitted maps are written once and read back, so each lookup join is
planned from the real size of its map.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from cardwatch.functions import fixed
from cardwatch.operators.groups import attach_stats, join_stats
from cardwatch.operators.ordering import at_or_before, order_cuts, with_row_index
from cardwatch.session import materialize


def _present(df: DataFrame, columns: list[str]) -> list[str]:
    return [c for c in columns if c in df.columns]


def _long(df: DataFrame, columns: list[str], keep: list[Column], missing: str | None) -> DataFrame:
    """(column_name, value, keep...) with every value as text."""
    value = [F.col(c).cast("string") for c in columns]
    if missing is not None:
        value = [F.coalesce(v, F.lit(missing)) for v in value]
    pairs = F.array(*[
        F.struct(F.lit(c).alias("column_name"), v.alias("value"))
        for c, v in zip(columns, value)
    ])
    return df.select(*keep, F.inline(pairs))


# ---- row counts ---------------------------------------------------------------
# feature -> key parts; the first part of a composite key writes NULL as "nan"
COUNT_KEYS = {
    "card1_addr1_FE": ["card1", "addr1"],
    "card4_addr1_P_emaildomain_FE": ["card4", "addr1", "P_emaildomain"],
    "card1_addr1_R_emaildomain_FE": ["card1", "addr1", "R_emaildomain"],
    "card2_FE": ["card2"],
    "card1_FE": ["card1"],
    "card3_addr1_P_emaildomain_FE": ["card3", "addr1", "P_emaildomain"],
    "card4_addr1_R_emaildomain_FE": ["card4", "addr1", "R_emaildomain"],
}


def frequency_count_encode(
    df: DataFrame, keys: dict[str, list[str]] = COUNT_KEYS
) -> DataFrame:
    out = df
    for name, parts in keys.items():
        if any(p not in df.columns for p in parts):
            continue
        if len(parts) == 1:
            out = attach_stats(out, parts[0], {name: F.count(F.lit(1))}, {name: 0})
        else:
            key = F.concat_ws("_", *[
                F.coalesce(F.col(p).cast("string"), F.lit("nan" if i == 0 else "na"))
                for i, p in enumerate(parts)
            ])
            out = attach_stats(
                out.withColumn("_count_key", key), "_count_key", {name: F.count(F.lit(1))}
            ).drop("_count_key")
    return out


# ---- shares -------------------------------------------------------------------
def fit_shares(train: DataFrame, columns: list[str] = fixed.SHARE_COLUMNS) -> DataFrame:
    """(column_name, value, share); NULL is a value of its own."""
    names = _present(train, columns)
    counts = _long(train, names, [], None).groupBy("column_name", "value").agg(
        F.count(F.lit(1)).alias("n")
    )
    total = max(train.count(), 1)
    shares = counts.select("column_name", "value", (F.col("n") / float(total)).alias("share"))
    return materialize(shares, "shares", "column_name")


def apply_shares(
    df: DataFrame, shares: DataFrame, columns: list[str] = fixed.SHARE_COLUMNS,
    drop_text: bool = True,
) -> DataFrame:
    """{column}_freq, 0 for values the fit never saw."""
    out = df
    names = _present(df, columns)
    for c in names:
        out = _lookup(out, shares, c, F.col(c).cast("string"), "share", f"{c}_freq", 0.0)
    text = [f.name for f in df.schema if f.name in names and isinstance(f.dataType, StringType)]
    return out.drop(*text) if drop_text else out


def _lookup(
    df: DataFrame, maps: DataFrame, column: str, key: Column, value: str, out: str, default
) -> DataFrame:
    """NULL-safe left lookup of one column's map."""
    dim = maps.where(F.col("column_name") == column).select(
        F.col("value").alias("_map_key"), F.col(value).alias(out)
    )
    joined = df.withColumn("_row_key", key).join(
        dim, F.col("_row_key").eqNullSafe(F.col("_map_key")), "left"
    )
    default = default if isinstance(default, Column) else F.lit(default)
    return joined.withColumn(out, F.coalesce(out, default)).drop("_row_key", "_map_key")


def lookup_fitted_map(
    df: DataFrame, dim: DataFrame, key: str, value: str, default: object
) -> DataFrame:
    """Left lookup in a fitted (key, value) table; unseen keys get ``default``."""
    return join_stats(df, dim.select(key, value), key, {value: default})


# ---- smoothed target means ------------------------------------------------------
def fit_target_sums(
    train: DataFrame, columns: list[str], label: str = "isFraud", fold: Column | None = None
) -> DataFrame:
    """(column_name, value, fold, positives, n): every encoding derives from these sums."""
    names = _present(train, columns)
    fold = F.lit(0) if fold is None else fold
    long = _long(train, names, [F.col(label).alias("_y"), fold.alias("fold")], "missing")
    sums = long.groupBy("column_name", "value", "fold").agg(
        F.sum("_y").cast("double").alias("positives"), F.count(F.lit(1)).alias("n")
    )
    return materialize(sums, "target-sums", "column_name")


def smoothed(positives: Column, n: Column, rate: float, weight: float) -> Column:
    return (positives + rate * weight) / (n + weight)


def target_means(
    sums: DataFrame, rate: float, weight: float = fixed.TARGET_SMOOTHING
) -> DataFrame:
    """Full-train map (column_name, value, fraud_rate)."""
    return sums.groupBy("column_name", "value").agg(
        smoothed(F.sum("positives"), F.sum("n"), rate, weight).alias("fraud_rate")
    )


def apply_target(
    df: DataFrame, means: DataFrame, columns: list[str], rate: float
) -> DataFrame:
    """{column}_fraud_rate from the full-train map, the global rate when unseen."""
    out = df
    for c in _present(df, columns):
        key = F.coalesce(F.col(c).cast("string"), F.lit("missing"))
        out = _lookup(out, means, c, key, "fraud_rate", f"{c}_fraud_rate", rate)
    return out


def apply_target_oof(
    train: DataFrame, sums: DataFrame, columns: list[str], rate: float, fold: str = "fold",
    weight: float = fixed.TARGET_SMOOTHING,
) -> DataFrame:
    """Encode each fold from the others: total sums minus the fold's own."""
    totals = sums.groupBy("column_name", "value").agg(
        F.sum("positives").alias("all_positives"), F.sum("n").alias("all_n")
    )
    out = train
    for c in _present(train, columns):
        own = sums.where(F.col("column_name") == c).select(
            F.col("value"), F.col("fold"), "positives", "n")
        rest = own.join(totals.where(F.col("column_name") == c), "value").select(
            F.col("value").alias("_map_key"),
            F.col("fold").alias("_map_fold"),
            (F.col("all_positives") - F.col("positives")).alias("_pos"),
            (F.col("all_n") - F.col("n")).alias("_n"),
        )
        name = f"{c}_fraud_rate"
        # a value seen in one fold only is unseen elsewhere: the global rate
        out = (
            out.withColumn("_row_key", F.coalesce(F.col(c).cast("string"), F.lit("missing")))
            .join(rest, (F.col("_row_key") == F.col("_map_key"))
                  & (F.col(fold) == F.col("_map_fold")), "left")
            .withColumn(name, F.when(F.col("_n") > 0, smoothed(
                F.col("_pos"), F.col("_n"), rate, weight)).otherwise(F.lit(rate)))
            .drop("_row_key", "_map_key", "_map_fold", "_pos", "_n")
        )
    return out


def contiguous_folds(
    df: DataFrame, order: tuple[str, str] = ("TransactionDT", "TransactionID"), k: int = 5
) -> Column:
    """Fold number by position in time; the first n % k folds hold one row more."""
    n = df.count()
    sizes = [n // k + (1 if i < n % k else 0) for i in range(k)]
    ends, at = [], 0
    for size in sizes[:-1]:
        at += size
        ends.append(at - 1)
    cuts = order_cuts(df, order, [e for e in ends if e >= 0]) if n else {}
    fold = F.lit(k - 1)
    for i in range(k - 2, -1, -1):
        if ends[i] in cuts:
            fold = F.when(at_or_before(order, cuts[ends[i]]), F.lit(i)).otherwise(fold)
    return fold


# ---- dense codes ----------------------------------------------------------------
def fit_label_codes(df: DataFrame, column: str) -> DataFrame:
    """(value, code): 0-based alphabetical position among the distinct values."""
    value = F.coalesce(F.col(column).cast("string"), F.lit("missing"))
    return with_row_index(df.select(value.alias("value")).distinct(), ["value"], "code")


def label_encode(df: DataFrame, codes: dict[str, DataFrame]) -> DataFrame:
    out = df
    for c, map_ in codes.items():
        dim = map_.select(F.col("value").alias("_v"), F.col("code").alias("_code"))
        out = (
            out.withColumn("_row_key", F.coalesce(F.col(c).cast("string"), F.lit("missing")))
            .join(dim, F.col("_row_key") == F.col("_v"), "left")
            .withColumn(c, F.col("_code"))
            .drop("_row_key", "_v", "_code")
        )
    return out
