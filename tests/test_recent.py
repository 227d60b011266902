"""The buffer of recent rows equals the batch operators, however the stream is cut."""

import pytest
from pyspark.sql import functions as F

from cardwatch.operators import monitor
from cardwatch.session import scratch_path
from cardwatch.streaming import jobs
from cardwatch.streaming.recent import RecentRows, newest

SCHEMA = "TransactionID bigint, t_us bigint, type string, fraud_probability double, TransactionAmt double"


@pytest.fixture(scope="module")
def rows(spark):
    """Times with ties and gaps, in no order; one kind in three rows of ten, a missing kind and a missing time."""
    made = spark.range(700).select(
        F.col("id").alias("TransactionID"), F.when(F.col("id") != 13, F.col("id") * 7919 % 211).alias("t_us"),
        F.when(F.col("id") % 10 < 3, "FRAUD").when(F.col("id") != 40, "LEGIT").alias("type"),
        (F.col("id") % 97 / 97).alias("fraud_probability"), (F.col("id") % 31).cast("double").alias("TransactionAmt"))
    return spark.createDataFrame(made.collect(), SCHEMA)


def _held(df):
    return sorted(df.collect(), key=repr)


@pytest.mark.parametrize("cuts", [[700], [1, 2, 300, 300, 700], [500, 700]])
def test_any_cut_gives_the_batch_rows(spark, rows, cuts):
    path, low = scratch_path(spark, "recent-in"), 0
    for high in cuts:
        rows.where(F.col("TransactionID").between(low, high - 1)).coalesce(1).write.mode("append").parquet(path)
        low = high
    buffer = RecentRows(scratch_path(spark, "recent"), 120, monitor.ARRIVAL, by="type")
    jobs.run_each(jobs.file_stream(spark, path, rows.schema, files_per_trigger=1), buffer, "recent-run")
    last = buffer.read(spark, rows.schema)
    assert _held(last) == _held(newest(rows, 120, monitor.ARRIVAL, "type"))
    assert last.groupBy("type").count().where("count > 120").isEmpty()
    assert len(buffer.versions(spark)) <= 2
    for operator in (monitor.rolling_fraud_rate, monitor.recent_window_stats):
        assert _held(operator(last)) == _held(operator(rows))


def test_a_batch_run_again_gives_the_same_version(spark, rows):
    buffer = RecentRows(scratch_path(spark, "recent"), 50, monitor.ARRIVAL, by="type")
    assert buffer.read(spark, rows.schema).count() == 0
    parts = [rows.where(F.col("TransactionID") % 3 == k) for k in range(3)]
    for k in (0, 1, 1, 2, 2):
        buffer(parts[k], k)
    assert _held(buffer.read(spark, rows.schema)) == _held(newest(rows, 50, monitor.ARRIVAL, "type"))
    buffer(rows.limit(0), 3)
    assert _held(buffer.read(spark, rows.schema)) == _held(newest(rows, 50, monitor.ARRIVAL, "type"))


def test_tasks_cut_their_rows_before_the_shuffle(rows):
    plan = newest(rows, 50, monitor.ARRIVAL, "type")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
