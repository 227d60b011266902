"""The newest rows of a stream, as a buffer of bounded size that micro-batches merge into.

The newest ``n`` rows of a union are the newest of each part's newest, so a micro-batch is first cut to ``n`` rows
of each kind per task, before any shuffle, then merged with the buffer, which has ``n`` rows of each kind. The cost
of a micro-batch doesn't grow with the stream's past, and any cut of the stream into micro-batches, in any order of
arrival, ends with the same buffer. The batch operators over recent rows then read the buffer as their table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from cardwatch.streaming.sinks import exists, folders, remove

_PLACE, _PREFIX = "_place", "batch="


def newest(df: DataFrame, n: int, order: tuple[str, ...], by: str | None = None) -> DataFrame:
    """The last ``n`` rows in ``order`` of each value of ``by`` (null is one), unsorted; cut in each task first.

    ``order`` should tell rows apart; missing values are the oldest. Values of ``by`` should be few.
    """
    last = Window.partitionBy(*([by] if by else [F.lit(0)])).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.withColumn(_PLACE, F.row_number().over(last)).where(F.col(_PLACE) <= n).drop(_PLACE)


class RecentRows:
    """A sink for ``foreachBatch``: version ``k`` of the buffer holds the newest rows up to micro-batch ``k``.

    A version is made of the one before and the micro-batch, so a batch that is run again after a stop gives the
    same version. Readers take the highest whole version; the two highest are kept. Repeated rows take a place
    each; an empty micro-batch or stream is no special case.
    """

    def __init__(self, path: str, n: int, order: tuple[str, ...], by: str | None = None):
        self.path, self.n, self.order, self.by = path.rstrip("/"), n, order, by

    def _at(self, batch: int) -> str:
        return f"{self.path}/{_PREFIX}{batch}"

    def versions(self, spark: SparkSession) -> list[int]:
        """Numbers of the whole versions; one that was stopped in the middle has no mark of success."""
        found = [int(f.removeprefix(_PREFIX)) for f in folders(spark, self.path) if f.startswith(_PREFIX)]
        return sorted(k for k in found if exists(spark, f"{self._at(k)}/_SUCCESS"))

    def before(self, spark: SparkSession, schema: StructType, batch: int) -> DataFrame | None:
        """The version that micro-batch ``batch`` starts from; none if there is no earlier one."""
        whole = [k for k in self.versions(spark) if k < batch]
        return spark.read.schema(schema).parquet(self._at(whole[-1])) if whole else None

    def __call__(self, rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        before = [k for k in self.versions(spark) if k < batch]
        if before:
            rows = rows.unionByName(spark.read.schema(rows.schema).parquet(self._at(before[-1])))
        kept = newest(rows, self.n, self.order, self.by)
        kept.write.mode("overwrite").parquet(self._at(batch))
        for old in before[:-1]:
            remove(spark, self._at(old))

    def read(self, spark: SparkSession, schema: StructType) -> DataFrame:
        """The newest rows, at most ``n`` of each kind; none before the first micro-batch."""
        whole = self.versions(spark)
        if not whole:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(self._at(whole[-1]))
