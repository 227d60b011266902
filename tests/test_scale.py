"""Plans keep their shape when one key holds most rows."""

import pytest
from pyspark.sql import functions as F

from cardwatch.catalog.risk import CFG
from cardwatch.operators import groups
from cardwatch.plans import scoring
from cardwatch.session import scratch_path
from cardwatch.sources.binding import EVENT_SCHEMA, scored, shape_events, transactions
from cardwatch.streaming import jobs

TIGHT = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
}


@pytest.fixture()
def tight(spark):
    before = {k: spark.conf.get(k, None) for k in TIGHT}
    for k, v in TIGHT.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("hot", ["1", "NULL"])
def test_hot_key_is_split_in_the_join_back(tight, hot):
    df = tight.range(0, 60000, 1, 8).selectExpr(
        "id", f"CASE WHEN id % 3 > 0 THEN {hot} ELSE id END AS k", "rand(1) AS v")
    out = groups.attach_stats(df, "k", {"m": F.avg("v"), "n": F.count("v")})
    rows = out.collect()
    assert len(rows) == 60000
    assert "skew=true" in plan_of(out)
    hot_rows = [r for r in rows if r["id"] % 3 > 0]
    assert {r["n"] for r in hot_rows} == ({40000} if hot == "1" else {None})


def test_decision_plan_stays_in_the_engine(spark, sf_dir):
    plan = plan_of(scoring.make_decision(scored(transactions(spark, sf_dir)), CFG))
    assert "EvalPython" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_rows_behind_the_watermark_are_dropped(spark, sf_dir):
    """The oldest rows arrive last; lateness is judged by the watermark one batch back."""
    events = spark.read.schema(EVENT_SCHEMA).parquet(f"{sf_dir}/events.parquet")
    path = scratch_path(spark, "late")
    for part in ("event_id BETWEEN 100 AND 899", "event_id >= 900", "event_id < 100"):
        events.where(part).coalesce(1).write.mode("append").parquet(path)
    stream = shape_events(jobs.file_stream(spark, path, EVENT_SCHEMA, files_per_trigger=1))
    once = jobs.dedup(jobs.with_watermark(
        stream.select("TransactionID", "TransactionDT", "card1"), CFG))
    done = jobs.run_available(once.select("TransactionID"), "late")
    assert done.where("TransactionID >= 100").count() == events.where("event_id >= 100").count()
    assert done.where("TransactionID < 100").count() == 0
