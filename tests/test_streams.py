"""Micro-batches give what the batch plan gives."""

import pytest
from pyspark.sql import functions as F

from cardwatch.catalog.risk import CFG
from cardwatch.operators import folds
from cardwatch.plans import scoring
from cardwatch.session import scratch_path
from cardwatch.sources import payload, schemas, tables
from cardwatch.sources.binding import EVENT_SCHEMA, scored, shape_events, transactions
from cardwatch.streaming import jobs

STATE_IN = ["TransactionID", "TransactionDT", "t_us", "card1", "TransactionAmt", "ProductCD",
            "addr1", "addr2", "dist1", "DeviceInfo", "P_emaildomain", "card6",
            "fraud_probability"]


def test_stream_over_ordered_files_equals_batch(spark, sf_dir):
    """Three files in time order, one micro-batch each."""
    events = spark.read.schema(EVENT_SCHEMA).parquet(f"{sf_dir}/events.parquet")
    path = scratch_path(spark, "events")
    for low, high in ((0, 400), (400, 700), (700, 10**9)):
        events.where(F.col("event_id").between(low, high - 1)).coalesce(1).write.mode(
            "append").parquet(path)
    own = jobs.job_session(spark, 4)
    stream = scored(shape_events(jobs.file_stream(own, path, EVENT_SCHEMA, files_per_trigger=1)))
    done = jobs.run_available(jobs.score_stream(stream.select(*STATE_IN), CFG).select(
        "TransactionID", "decision", "risk_level", "risk_factors", "txn_count_7d"), "scored")
    batch = scoring.decide_rows(
        scoring.assess(scored(transactions(spark, sf_dir)), CFG), CFG).select(*done.columns)
    assert done.count() == batch.count() == events.count()
    assert batch.exceptAll(done).isEmpty()


def test_malformed_messages_become_error_records(spark):
    df = spark.createDataFrame([('{"TransactionID": "1", "TransactionAmt": 2.5}',),
                                ('{"TransactionID": "2", "Transac',), ("",)], "value string")
    good, dead = jobs.isolate_errors(
        payload.parse_payload_json(df, schemas.transaction_schema()))
    assert [r["TransactionAmt"] for r in good.collect()] == [2.5]
    assert {r["decision"] for r in jobs.error_records(dead).collect()} == {"ERROR"}
    assert dead.count() == 2


def test_routes_cover_every_decision(spark):
    df = spark.createDataFrame(
        [("FRAUD",), ("LEGITIMATE",), ("ERROR",), (None,), ("REVIEW",)], "decision string")
    topics = [r[0] for r in df.select(payload.route_topic(CFG)).collect()]
    k = CFG.kafka
    assert topics == [k.fraud_output_topic, k.legit_output_topic, k.error_output_topic,
                      k.error_output_topic, k.legit_output_topic]


def test_schema_covers_the_trained_columns():
    names = [f.name for f in schemas.transaction_schema()]
    assert len(names) == len(set(names)) == 216
    assert {"V320", "id_38", "timestamp"} <= set(names)


def test_artifacts_survive_a_round_trip(spark, sf_dir):
    path = scratch_path(spark, "fitted")
    df = transactions(spark, sf_dir).groupBy("card1").count()
    tables.save_fitted_stats({"counts": df}, {"threshold": 0.4}, path)
    loaded, meta = tables.load_fitted_stats(spark, path, ["counts"], config_threshold=0.1)
    assert loaded["counts"].exceptAll(df).isEmpty()
    assert meta["threshold"] == 0.4 and meta["threshold_mismatch"]


def test_payload_defaults(spark):
    df = spark.createDataFrame([(None, float("nan"), None)],
                               "TransactionID string, TransactionAmt double, ProductCD string")
    row = payload.normalize_payload(df).first()
    assert row["TransactionID"].startswith("TXN_") and len(row["TransactionID"]) == 16
    assert row["TransactionAmt"] is None and row["ProductCD"] == "W" and row["timestamp"]


@pytest.mark.parametrize("block", [7, 1000])
def test_ewma_blocks_equal_one_pass(spark, block):
    values = [((i * 7919) % 100) / 100 for i in range(50)]
    df = spark.createDataFrame(list(enumerate(values)), "batch_id bigint, v double")
    got = {r["batch_id"]: r["ewma"] for r in folds.ewma_confidence(
        df, "batch_id", "v", block=block).collect()}
    avg = 0.0
    for i, v in enumerate(values):
        avg = 0.9 * avg + 0.1 * v
        assert got[i] == pytest.approx(avg, abs=1e-12)


def test_adaptive_threshold_blocks_equal_one_pass(spark):
    window, min_rows = 10, 4
    rows = [("m", i, int((i * 31) % 17 == 0 or 60 < i < 80), ((i * 37) % 100) / 100,
             0.9 if i % 13 == 0 else 0.1) for i in range(200)]
    df = spark.createDataFrame(rows, "model string, t bigint, y int, p double, v double")
    got = {r["t"]: r for r in folds.adaptive_threshold_replay(
        df, "model", ["t"], "y", "p", "v", window=window, min_rows=min_rows, block=10).collect()}
    x = 0.5
    for i in range(len(rows)):
        seen = rows[max(0, i - window + 1):i + 1]
        if len(seen) >= min_rows:
            rate = sum(r[2] for r in seen) / len(seen)
            accuracy = sum((r[3] >= x) == (r[2] == 1) for r in seen) / len(seen)
            move = -0.02 if rate > 0.05 else 0.02 if rate < 0.02 else 0.0
            move -= 0.01 if rows[i][4] > 0.7 else 0.0
            x = min(max(x + move, 0.1), 0.9)
            assert got[i]["accuracy"] == pytest.approx(accuracy)
        assert got[i]["threshold"] == pytest.approx(x), i


def _wire(spark, sf_dir):
    df = transactions(spark, sf_dir)
    names = {f.name for f in schemas.transaction_schema()}
    card = F.when(F.col("TransactionID") % 4 != 1, F.col("card1"))
    amount = F.when(F.col("TransactionID") % 10 != 7, F.col("TransactionAmt")).otherwise(-1.0)
    path = scratch_path(spark, "wire")
    df.withColumns({"card1": card, "TransactionAmt": amount}).write.parquet(path)
    rows = spark.read.parquet(path)
    text = F.to_json(F.struct(*[F.col(c) for c in rows.columns if c in names]))
    cut = F.when(F.col("TransactionID") % 50 == 3, F.substring(text, 1, 30)).otherwise(text)
    return rows.select(cut.cast("binary").alias("value"))


def test_job_answers_every_message_like_the_batch_plan(spark, sf_dir):
    """Messages of all kinds, each sent twice, against the plan over a table."""
    from cardwatch.catalog.streams import _scorecard

    path = scratch_path(spark, "messages")
    messages = _wire(spark, sf_dir)
    messages.unionByName(messages).write.parquet(path)
    stream = jobs.file_stream(jobs.job_session(spark, 4), path, "value binary")
    done = jobs.run_available(jobs.decision_job(stream, CFG, _scorecard), "job")
    k = CFG.kafka
    answers = done.select("key", "topic", F.get_json_object("value", "$.decision").alias("decision"))

    parsed = payload.parse_payload_json(messages, schemas.transaction_schema())
    good, dead = jobs.isolate_errors(parsed)
    accepted, rejected = payload.validate_payload(
        good.withColumns({c: F.col(c).cast("bigint") for c in jobs.WHOLE}))
    decided = scoring.decide_rows(
        scoring.assess(_scorecard(accepted), CFG, time="TransactionDT", unit=1), CFG)
    want = decided.select(F.col("TransactionID").alias("key"), payload.route_topic(CFG).alias("topic"),
                          "decision")
    regular = answers.where(F.col("decision") != "ERROR")
    assert regular.count() == want.count() == accepted.count()
    assert want.exceptAll(regular).isEmpty()
    errors = answers.where(F.col("decision") == "ERROR")
    assert errors.where(F.col("topic") != k.error_output_topic).isEmpty()
    assert errors.select("key").distinct().count() == rejected.count() + dead.select("value").distinct().count()


def test_late_rows_are_counted(spark):
    path = scratch_path(spark, "late")
    rows = [[("a", 10**7)], [("b", 100)]]  # the second is far behind the watermark
    for part in rows:
        spark.createDataFrame(part, "TransactionID string, TransactionDT bigint").coalesce(1).write.mode(
            "append").parquet(path)
        stream = jobs.file_stream(spark, path, "TransactionID string, TransactionDT bigint")
        once = jobs.dedup(jobs.with_watermark(stream, CFG)).select("TransactionID")
        query = once.writeStream.format("parquet").option("path", path + "-out").option(
            "checkpointLocation", path + "-checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    assert jobs.late_rows(query) == 1
    assert [r[0] for r in spark.read.parquet(path + "-out").collect()] == ["a"]


def test_kafka_options_without_a_broker():
    options = jobs.kafka_options(CFG, {"startingOffsets": "earliest"})
    assert options["subscribe"] == CFG.kafka.input_topic and options["startingOffsets"] == "earliest"
    assert options["maxOffsetsPerTrigger"] == str(CFG.kafka.max_offsets_per_trigger)


def test_a_message_is_parsed_once_by_each_reader(spark):
    """Filters on parsed fields stay above the parser, and fields of a message without any text are empty."""
    df = spark.createDataFrame([(b'{"TransactionID": "1", "TransactionAmt": 2.5}',), (b'{"Trans',), (None,)], "value binary")
    good, dead = jobs.isolate_errors(payload.parse_payload_json(df, schemas.transaction_schema()))
    explain = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    for part, rows in ((good.where("TransactionAmt > 0"), 1), (dead, 2)):
        assert part._jdf.queryExecution().explainString(explain).count("from_json") == 1
        assert part.count() == rows


def test_rows_of_one_file_are_shaped_by_all_cores(spark, sf_dir):
    from cardwatch.catalog import streams

    assert "RepartitionByExpression" in streams._messages(spark, sf_dir)._jdf.queryExecution().logical().toString()
