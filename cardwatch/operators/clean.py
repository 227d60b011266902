"""Row and column cleaning."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, FloatType, IntegralType, NumericType

from cardwatch.functions import columns as fx, fixed
from cardwatch.operators.comoments import correlation_pairs
from cardwatch.operators.ordering import exact_quantiles


def _present(df: DataFrame, names: list[str]) -> list[str]:
    have = set(df.columns)
    return [n for n in names if n in have]


def normalize_text(df: DataFrame, columns: list[str] = fixed.TEXT_COLUMNS) -> DataFrame:
    return df.withColumns({c: fx.clean_text(c) for c in _present(df, columns)})


def coerce_numeric(df: DataFrame, columns: list[str] = fixed.NUMERIC_COLUMNS) -> DataFrame:
    return df.withColumns({c: fx.to_number(c) for c in _present(df, columns)})


def sentinel_to_null(df: DataFrame, columns: list[str] = fixed.EMAIL_COLUMNS) -> DataFrame:
    return df.withColumns({c: fx.drop_sentinels(c) for c in _present(df, columns)})


def encode_match_flags(df: DataFrame, columns: list[str] = fixed.MATCH_COLUMNS) -> DataFrame:
    return df.withColumns({c: fx.match_code(c) for c in _present(df, columns)})


def fill_missing(df: DataFrame, values: dict[str, object]) -> DataFrame:
    return df.fillna({c: v for c, v in values.items() if c in df.columns})


def select_opaque_subset(df: DataFrame, keep: list[int] = fixed.OPAQUE_KEEP) -> DataFrame:
    kept = {f"V{i}" for i in keep}
    return df.select(*[c for c in df.columns if not _family(c, "V") or c in kept])


def drop_unstable_columns(df: DataFrame, names: list[str] = fixed.UNSTABLE_COLUMNS) -> DataFrame:
    return df.drop(*_present(df, names))


def null_share(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per column: share of NULLs, from a single pass."""
    names = columns or df.columns
    totals = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in names])
    return totals.unpivot([], names, "column_name", "null_share")


def drop_high_null_columns(
    df: DataFrame, threshold: float = 0.9, keep: tuple[str, ...] = ("isFraud",)
) -> DataFrame:
    shares = {r["column_name"]: r["null_share"] for r in null_share(df).collect()}
    return df.drop(*[c for c, s in shares.items() if s is not None and s > threshold
                     and c not in keep])


def filter_amount_outliers(
    df: DataFrame, column: str = "TransactionAmt", percentile: float = 99
) -> DataFrame:
    """Rows at or below the exact percentile; NULL amounts go too."""
    (limit,) = exact_quantiles(df, column, [percentile / 100])
    return df.where(F.col(column) <= limit)


def filter_count_outliers(df: DataFrame, limit: float = 500) -> DataFrame:
    return _keep_where(df, "C", lambda c: F.col(c) <= limit)


def filter_negative_deltas(df: DataFrame) -> DataFrame:
    return _keep_where(df, "D", lambda c: F.col(c) >= 0)


def _keep_where(df: DataFrame, letter: str, test) -> DataFrame:
    """Conjunction over a column family; NULL passes."""
    condition = F.lit(True)
    for c in df.columns:
        if _family(c, letter):
            condition = condition & (test(c) | F.col(c).isNull())
    return df.where(condition)


def _family(name: str, letter: str) -> bool:
    return name.startswith(letter) and name[1:].isdigit()


def inf_to_null(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    names = columns or [
        f.name for f in df.schema if isinstance(f.dataType, (DoubleType, FloatType))
    ]
    return df.withColumns({c: fx.inf_to_null(F.col(c)) for c in names})


def numeric_columns_only(
    df: DataFrame, drop: tuple[str, ...] = ("TransactionID", "isFraud")
) -> DataFrame:
    return df.select(
        *[f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in drop]
    )


def downcast_numeric(df: DataFrame) -> DataFrame:
    """Narrow integers by their range and halve doubles, after one min/max pass."""
    whole = [f.name for f in df.schema if isinstance(f.dataType, IntegralType)]
    real = [f.name for f in df.schema if isinstance(f.dataType, DoubleType)]
    ranges = df.agg(
        *[F.min(c).alias(f"lo_{c}") for c in whole + real],
        *[F.max(c).alias(f"hi_{c}") for c in whole + real],
    ).first()
    casts: dict[str, Column] = {}
    for c in whole:
        lo, hi = ranges[f"lo_{c}"], ranges[f"hi_{c}"]
        if lo is None:
            continue
        for kind, bits in (("tinyint", 7), ("smallint", 15), ("int", 31)):
            if lo > -(2**bits) and hi < 2**bits - 1:
                casts[c] = F.col(c).cast(kind)
                break
    for c in real:
        lo, hi = ranges[f"lo_{c}"], ranges[f"hi_{c}"]
        # only columns inside the half-precision range are narrowed
        if lo is not None and not math.isnan(hi) and lo > -65504 and hi < 65504:
            casts[c] = F.col(c).cast("float")
    return df.withColumns(casts) if casts else df


def correlated_columns(df: DataFrame, columns: list[str], threshold: float = 0.95) -> list[str]:
    """Later column of every pair above the threshold, in column order."""
    hits = {
        r["right_column"]
        for r in correlation_pairs(df, columns).where(F.col("abs_corr") > threshold).collect()
    }
    return [c for c in columns if c in hits]


def drop_correlated(df: DataFrame, columns: list[str], threshold: float = 0.95) -> DataFrame:
    return df.drop(*correlated_columns(df, columns, threshold))


def validate_features(df: DataFrame, expected: list[str]) -> tuple[DataFrame, list[str]]:
    """Columns in the expected order, plus the unexpected ones; missing is an error."""
    missing = [c for c in expected if c not in df.columns]
    if missing:
        raise ValueError(f"{len(missing)} features missing: {missing[:10]}")
    extra = [c for c in df.columns if c not in set(expected)]
    return df.select(*expected), extra


def common_columns(left: DataFrame, right: DataFrame, drop: tuple[str, ...] = ()) -> list[str]:
    have = set(right.columns)
    return [c for c in left.columns if c in have and c not in drop]
