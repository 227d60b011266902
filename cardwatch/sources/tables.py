"""Table scans and fitted artifacts."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from cardwatch.sources.schemas import identity_schema, transaction_schema


def scan_transactions(
    spark: SparkSession, path: str, fmt: str = "parquet", labelled: bool = True,
    schema: StructType | None = None,
) -> DataFrame:
    """Typed scan with the columns of ``schema`` in its order; nothing is inferred from the data.

    Columns are found by name. CSV needs a header row, whose order and extra columns don't
    matter; a column that the file lacks is NULL.
    """
    if schema is None:
        schema = transaction_schema(list(range(1, 340)))
        if labelled:
            schema = StructType(schema.fields + [StructField("isFraud", IntegerType(), True)])
    if fmt != "csv":
        return spark.read.schema(schema).format(fmt).load(path)
    header = spark.read.option("header", True).csv(path).columns  # reads one line
    known = {f.name: f for f in schema}
    in_file = StructType([known.get(c, StructField(c, StringType(), True)) for c in header])
    rows = spark.read.schema(in_file).option("header", True).csv(path)
    return rows.select(*[
        F.col(f.name) if f.name in header else F.lit(None).cast(f.dataType).alias(f.name)
        for f in schema])


def path_exists(spark: SparkSession, path: str) -> bool:
    """Asks the file system the path belongs to, also on object stores."""
    files, target = _file_system(spark, path)
    return bool(files.exists(target))


def scan_identity_optional(
    spark: SparkSession, path: str, fmt: str = "parquet", schema: StructType | None = None
) -> DataFrame:
    """The identity table, or an empty one with the same columns if the path is absent."""
    schema = schema or identity_schema()
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return scan_transactions(spark, path, fmt, schema=schema)


# ---- fitted artifacts ---------------------------------------------------------------
def save_fitted_stats(
    tables: dict[str, DataFrame], metadata: dict[str, object], path: str
) -> None:
    """Each fitted map as a Parquet table, the metadata as a one-row JSON table."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark.createDataFrame([(json.dumps(metadata),)], "metadata string").coalesce(1).write.mode(
        "overwrite").json(f"{path}/metadata")


def load_fitted_stats(
    spark: SparkSession, path: str, names: list[str] | None = None,
    config_threshold: float | None = None,
) -> tuple[dict[str, DataFrame], dict[str, object]]:
    """Maps (those that the metadata lists, if none are named) and metadata.

    The stored threshold wins over the configured one.
    """
    row = spark.read.schema("metadata string").json(f"{path}/metadata").first()
    metadata = json.loads(row["metadata"])
    tables = {name: spark.read.parquet(f"{path}/{name}")
              for name in (metadata["tables"] if names is None else names)}
    stored = metadata.get("threshold")
    metadata["threshold_mismatch"] = (
        stored is not None and config_threshold is not None
        and abs(stored - config_threshold) > 0.01)
    if stored is None:
        metadata["threshold"] = config_threshold
    return tables, metadata


def publish_fitted_stats(
    tables: dict[str, DataFrame], metadata: dict[str, object], root: str
) -> str:
    """Write a new version below ``root`` and make it the current one; returns its name.

    A version is written whole in a folder of its own. Only then a pointer to it appears, an empty file whose
    number is above all others: readers see the old version or the new one, never a part. A publish that fails
    leaves the old version current.
    """
    spark = next(iter(tables.values())).sparkSession
    version = uuid.uuid4().hex
    save_fitted_stats(tables, {**metadata, "tables": list(tables)}, f"{root}/versions/{version}")
    number = 1 + max((n for n, _ in _pointers(spark, root)), default=0)
    files, at = _file_system(spark, f"{root}/current/{number:012d}-{version}")
    files.mkdirs(at.getParent())
    files.create(at, False).close()
    return version


def published_versions(spark: SparkSession, root: str) -> list[str]:
    """All published versions, the current one last."""
    return [version for _, version in _pointers(spark, root)]


def load_published(
    spark: SparkSession, root: str, version: str | None = None, config_threshold: float | None = None,
) -> tuple[dict[str, DataFrame], dict[str, object]]:
    """The maps and metadata of a published version, the current one if none is named."""
    known = published_versions(spark, root)
    if not known or (version is not None and version not in known):
        raise FileNotFoundError(f"{version or 'nothing'} is not published in {root}")
    return load_fitted_stats(spark, f"{root}/versions/{version or known[-1]}", config_threshold=config_threshold)


def _pointers(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    files, at = _file_system(spark, f"{root}/current")
    names = [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []
    return sorted((int(n.split("-")[0]), n.split("-")[1]) for n in names if n[0].isdigit())


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def export_importance(importance: DataFrame, path: str) -> None:
    importance.orderBy(F.desc("importance")).write.mode("overwrite").option(
        "header", True).csv(path)


def top_features(importance: DataFrame, n: int = 20) -> DataFrame:
    return importance.orderBy(F.desc("importance"), "feature").limit(n)
