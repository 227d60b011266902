"""Helpers shared by the text operators."""

from __future__ import annotations

import gc
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cardwatch.session import scratch_path

#: The white space of the contracts: blank, tab, newline, vertical tab, form feed, return.
SPACE = r"[\x20\x09-\x0D]"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def quoted(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_of(name: str) -> Column:
    """A text column with null read as empty."""
    return F.coalesce(quoted(name).cast("string"), F.lit(""))


def written(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Let go of the shuffle files of finished writes: Spark removes them once the driver has collected
    the plans they belong to, which otherwise may be long after a heavy step."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def spread_join(df: DataFrame, grouped: DataFrame, keys: list[str]) -> DataFrame:
    """Inner equi join of rows with an aggregate by ``keys``, such that a key of many rows can be split.

    Adaptive execution splits a skewed partition only where both sides are plain shuffles; an aggregate
    keeps the shuffle of its ``groupBy``. The second, redundant key gives it a shuffle of its own.
    """
    named = {k: f"_of_{k}" for k in keys}
    same = F.xxhash64(*keys) == F.xxhash64(*named.values())
    for k, of in named.items():
        same &= F.col(k) == F.col(of)
    return df.join(grouped.withColumnsRenamed(named), same).drop(*named.values())


#: Rows that go to a Python worker at a time. Texts can be long, so Spark's default of 10,000 rows
#: would take far more memory than an executor leaves to its workers.
BATCH_ROWS = 512


def in_batches(df: DataFrame, run: Callable, schema: StructType | str) -> DataFrame:
    """``df.mapInArrow(run, schema)`` with small batches, a setting of the session that stays."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, BATCH_ROWS)
    return df.mapInArrow(run, schema)


def numbered(df: DataFrame, label: str, uid: str = "_uid") -> DataFrame:
    """Write a table with one unique number per row; repeated rows get their own."""
    return written(df.withColumn(uid, F.monotonically_increasing_id()), label)


def bundled(columns: list[str]) -> Column:
    """A column ``row`` with the named columns, so that none clashes with a working column."""
    return F.struct(F.lit(True).alias("_bundle"), *[quoted(c) for c in columns]).alias("row")


def unbundled(columns: list[str]) -> list[Column]:
    """The columns of ``row`` under their own names."""
    return [F.col("row").getField(c).alias(c) for c in columns]
