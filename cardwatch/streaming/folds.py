"""Ordered recursions over a stream: each micro-batch goes on where the one before stopped.

A micro-batch is run by the block-wise batch operators, which take the last rows of the sequence with their
results as their past. What is kept of a sequence is a buffer of bounded size (:class:`RecentRows`), whatever the
length of the stream. A sequence is the micro-batches in turn, each in its own order: a stream in time order, cut
anywhere, gives the rows of the batch operator; a row that comes late takes its place among the rows it came with.
A micro-batch that is run again after a stop starts from the same version of the buffer and replaces its own rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from cardwatch.operators import folds
from cardwatch.streaming.recent import RecentRows
from cardwatch.streaming.sinks import folders

_BATCH = "_batch"


class _Sequence:
    """A sink for ``foreachBatch``: results of micro-batch ``k`` in a folder of their own, and the buffer."""

    def __init__(self, path: str, past: int, order: list[str], by: str | None):
        self.path, self.order = path.rstrip("/"), [_BATCH, *order]
        self.past = RecentRows(f"{self.path}/past", past, tuple(self.order), by)

    def step(self, rows: DataFrame, before: DataFrame | None, batch: int) -> DataFrame:
        """The rows of a micro-batch with their results and all columns that the next step needs."""
        raise TypeError(type(self))

    def held(self, rows: DataFrame) -> StructType:
        """The columns of ``step``'s result for rows like these."""
        raise TypeError(type(self))

    def __call__(self, rows: DataFrame, batch: int) -> None:
        spark, rows = rows.sparkSession, rows.withColumn(_BATCH, F.lit(batch).cast("bigint"))
        schema = self.held(rows)
        out = f"{self.path}/rows/batch={batch}"
        self.step(rows, self.past.before(spark, schema, batch), batch).write.mode("overwrite").parquet(out)
        self.past(spark.read.schema(schema).parquet(out), batch)

    def read(self, spark: SparkSession, rows: StructType) -> DataFrame:
        """Results of all micro-batches for a stream with the columns ``rows``; none before the first."""
        empty = spark.createDataFrame([], rows).withColumn(_BATCH, F.lit(0).cast("bigint"))
        schema = self.held(empty)
        done = [f"{self.path}/rows/{f}" for f in folders(spark, f"{self.path}/rows")]
        found = spark.read.schema(schema).parquet(*done) if done else spark.createDataFrame([], schema)
        return found.drop(_BATCH)


class DecayingAverage(_Sequence):
    """:func:`folds.ewma_confidence` over a stream of batch rows; one row is its past."""

    def __init__(self, path: str, order: str, value: str, decay: float = 0.9, start: float = 0.0):
        super().__init__(path, 1, [order], None)
        self.by, self.value, self.decay, self.start = order, value, decay, start

    def held(self, rows: DataFrame) -> StructType:
        return rows.select(self.by, F.col(self.value).cast("double"), F.lit(0.0).alias("ewma"), _BATCH).schema

    def step(self, rows: DataFrame, before: DataFrame | None, batch: int) -> DataFrame:
        last = before.first() if before is not None else None
        begin = last["ewma"] if last else self.start
        out = folds.ewma_confidence(rows.select(self.by, self.value), self.by, self.value, self.decay, begin)
        return out.withColumn(_BATCH, F.lit(batch).cast("bigint"))


class ThresholdReplay(_Sequence):
    """:func:`folds.adaptive_threshold_replay` over a stream; the past is ``window`` - 1 rows of each key.

    Keys should be few (models, segments), as a micro-batch writes the past of all of them.
    """

    def __init__(self, path: str, key: str, order: list[str], label: str, score: str, velocity: str,
                 window: int = 1000, **options):
        super().__init__(path, max(1, window - 1), order, key)
        self.columns = [key, self.order, label, score, velocity]
        self.window, self.options = window, options

    def held(self, rows: DataFrame) -> StructType:
        key, order, *inputs = self.columns
        numbers = [F.lit(0.0).alias(c) for c in ("fraud_rate", "accuracy")]
        return rows.select(key, *order, *inputs, F.lit(0.0).alias("threshold"), F.lit(True).alias("active"),
                           *numbers).schema

    def step(self, rows: DataFrame, before: DataFrame | None, batch: int) -> DataFrame:
        return folds.adaptive_threshold_replay(
            rows, *self.columns, window=self.window, before=before, inputs=True, **self.options)
