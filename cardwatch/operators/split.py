"""Chronological, quantile and stratified splits, time order, top-k reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cardwatch.operators.ordering import (
    at_or_before, exact_quantiles, known_time, order_cuts, with_row_index,
)

TIME_ORDER = ("TransactionDT", "TransactionID")


def sort_by_time(df: DataFrame, keys: tuple[str, ...] = TIME_ORDER) -> DataFrame:
    return df.orderBy(*keys)


def train_condition(
    df: DataFrame, ratio: float = 0.8, order: tuple[str, str] = TIME_ORDER
) -> Column:
    """True for the first int(n * ratio) rows in time order, rows without a time being the last.

    One comparison per row, and never NULL.
    """
    n = df.count()
    size = int(n * ratio)
    if size <= 0:
        return F.lit(False)
    cut = order_cuts(df.select(*order), order, [size - 1])[size - 1]
    return at_or_before(order, cut)


def chronological_split(
    df: DataFrame, ratio: float = 0.8, order: tuple[str, str] = TIME_ORDER
) -> tuple[DataFrame, DataFrame]:
    condition = train_condition(df, ratio, order)
    return df.where(condition), df.where(~condition)


def quantile_time_split(
    df: DataFrame, ratio: float = 0.8, time: str = "TransactionDT"
) -> tuple[DataFrame, DataFrame]:
    """Rows up to the quantile of time, and the rest with all rows that have no time."""
    (cut,) = exact_quantiles(df, time, [ratio])
    early = F.lit(False) if cut is None else known_time(time) & (F.col(time) <= cut)
    return df.where(early), df.where(~early)


def mixed(df: DataFrame, id_col: str, seed: int) -> Column:
    """A multiplicative hash of the id, spelled out so that any engine can repeat it.

    A whole number is folded to 31 bits first, so the product never leaves 64 bits; any other id
    enters by the first seven hex digits of the MD5 of its text.
    """
    if df.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long"):
        folded = F.pmod(F.col(id_col).cast("long"), F.lit(2**31))
    else:
        folded = F.conv(F.substring(F.md5(F.col(id_col).cast("string")), 1, 7), 16, 10).cast("long")
    return F.pmod((folded + seed) * F.lit(2654435761), F.lit(4294967296))


def stratified_split(
    df: DataFrame, label: str, id_col: str, ratio: float = 0.8, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """floor(ratio * n) rows of every class, chosen by a seeded hash of the id.

    Rows are put in order of class and hash by one range partitioning, which also cuts large
    classes; the place inside a class is the place less that of its first row. Any number of classes.
    """
    work = df.withColumn("_mix", mixed(df, id_col, seed))
    placed = with_row_index(work, [label, "_mix", id_col], "_at")
    classes = placed.groupBy(F.col(label).alias("_class")).agg(
        F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    marked = placed.join(classes, F.col(label).eqNullSafe(F.col("_class")))
    train = F.col("_at") - F.col("_first") < F.floor(F.col("_n") * F.lit(ratio))
    return marked.where(train).select(*df.columns), marked.where(~train).select(*df.columns)


def top_errors(
    df: DataFrame, label: str, score: str, threshold: float, id_col: str, n: int = 5
) -> DataFrame:
    """The most confident mistakes of both kinds."""
    wrong_hit = df.where((F.col(label) == 0) & (F.col(score) >= threshold))
    missed = df.where((F.col(label) == 1) & (F.col(score) < threshold))
    parts = [
        wrong_hit.orderBy(F.desc(score), id_col).limit(n).withColumn("kind", F.lit("FP")),
        missed.orderBy(F.asc(score), id_col).limit(n).withColumn("kind", F.lit("FN")),
    ]
    return parts[0].unionByName(parts[1]).select("kind", id_col, label, score)


def recent_n(df: DataFrame, n: int, order: tuple[str, ...] = TIME_ORDER) -> DataFrame:
    """Newest first; a top-n per task, never a full sort."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)


