"""Card state: what a micro-batch touches, late and repeated rows, restarts, histories, sinks."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cardwatch.catalog.risk import CFG
from cardwatch.operators.profile import profile_history
from cardwatch.operators.velocity import online_velocity_counts
from cardwatch.session import scratch_path
from cardwatch.sources.binding import EVENT_SCHEMA, scored, shape_events, transactions
from cardwatch.streaming import jobs, sinks, state


STATE_IN = ["TransactionID", "TransactionDT", "t_us", "card1", "TransactionAmt", "ProductCD", "addr1", "addr2",
            "dist1", "DeviceInfo", "P_emaildomain", "card6", "fraud_probability"]
SEEN = [c.split()[0] for c in state.STATE_COLUMNS.split(", ")]


class _Value:
    def __init__(self):
        self.value, self.moved = None, 0

    def get(self):
        self.moved += len(json.dumps(self.value))
        return self.value

    def update(self, value):
        self.value = value
        self.moved += len(json.dumps(value))

    def clear(self):
        self.value = None


class _Map(dict):
    moved = 0

    def getValue(self, key):
        value = self.get(key)
        self.moved += len(json.dumps(value))
        return value

    def updateValue(self, key, value):
        self[key] = value
        self.moved += len(json.dumps(value))

    def containsKey(self, key):
        return key in self

    def removeKey(self, key):
        self.pop(key, None)


class _Handle:
    """State in memory, counting what is read and written."""

    def __init__(self):
        self.states, self.timers = {}, []

    def getValueState(self, name, schema):
        return self.states.setdefault(name, _Value())

    def getMapState(self, name, key, value):
        return self.states.setdefault(name, _Map())

    def registerTimer(self, at):
        self.timers.append(at)

    @property
    def moved(self):
        return sum(s.moved for s in self.states.values())


class _Now:
    def __init__(self, watermark=0):
        self.watermark = watermark

    def getCurrentWatermarkInMs(self):
        return self.watermark


COLUMNS = ["TransactionID", "t", "TransactionAmt", *state.PROFILE, "_event_ms"]
OUT = "TransactionID bigint, t bigint, TransactionAmt double, " + state.STATE_COLUMNS + ", _fate string"


def _card(handle):
    card = state.CardState(COLUMNS, StructType.fromDDL(OUT), "t", "TransactionID", 1, 10**9)
    card.init(handle)
    return card


def _batch(rows):
    """(id, seconds, amount)"""
    return pd.DataFrame([(i, t, a, 1, 2, "dev", "mail", "debit", t * 1000) for i, t, a in rows], columns=COLUMNS)


def _feed(card, rows, watermark=0, key="7"):
    (out,) = card.handleInputRows((key,), iter([_batch(rows)]), _Now(watermark))
    return out


def test_a_batch_moves_no_more_state_for_a_busy_week(spark):
    moved = []
    for per_hour in (2, 40):
        handle = _Handle()
        card = _card(handle)
        n = 0
        for hour in range(24 * 7 - 2):  # quiet hours at the ends of the windows, busy ones between
            busy = hour not in (0, 1, 142, 143, 144, 160, 161, 162) and hour < 164
            size = per_hour if busy else 1
            _feed(card, [(n + k, hour * 3600 + k, 1.0) for k in range(size)])
            n += size
        before, at = handle.moved, 24 * 7 * 3600 + 1800
        out = _feed(card, [(10**6, at, 5.0)])
        moved.append(handle.moved - before)
        assert out["txn_count_7d"].tolist() == [n - (1 if 0 < 1800 else 0)]
    assert moved[1] < 1.3 * moved[0]


def test_hours_expire_with_their_ids(spark):
    handle = _Handle()
    card = _card(handle)
    for day in range(30):
        _feed(card, [(day, day * 86400, 1.0)])
    assert len(handle.states["hours"]) == len(handle.states["card"].value[0]) == 8
    assert set(handle.states["ids"]) == {(str(d),) for d in range(22, 30)}
    card.handleExpiredTimer(("7",), _Now(10**9), None)
    list(card.handleExpiredTimer(("7",), _Now(10**13), None))
    assert handle.states["card"].value is None and not handle.states["hours"]


@pytest.mark.parametrize("size", [1, 7, 200])
def test_any_cut_gives_the_same_counts(spark, size):
    rng = np.random.default_rng(3)
    times = np.sort(rng.integers(0, 20 * 86400, 200)).tolist()
    rows = [(i, t, float(rng.integers(1, 99)) / 8 if i % 9 else None) for i, t in enumerate(times)]
    card, got = _card(_Handle()), []
    for a in range(0, len(rows), size):
        got.append(_feed(card, rows[a:a + size]))
    got = pd.concat(got).set_index("TransactionID")
    for i, t, _ in rows:
        for w, hours in (("1h", 1), ("6h", 6), ("24h", 24), ("7d", 168)):
            seen = [a for _, u, a in rows if t - hours * 3600 <= u < t and a is not None]
            assert got.loc[i, f"txn_count_{w}"] == len(seen)
            if w == "24h":
                assert got.loc[i, "amt_sum_24h"] == pytest.approx(sum(seen), abs=1e-9)


def test_late_and_repeated_rows_are_told_apart_and_not_recorded(spark):
    card = _card(_Handle())
    _feed(card, [(1, 1000, 5.0), (2, 5000, 5.0)])
    out = _feed(card, [(3, 900, 5.0), (2, 5000, 5.0), (4, 6000, 5.0), (4, 6000, 5.0)], watermark=4_000_000)
    assert dict(zip(zip(out["TransactionID"], out["t"]), out["_fate"])) == {
        (3, 900): "late", (2, 5000): "duplicate", (4, 6000): "duplicate"}
    assert out["_fate"].tolist().count("decided") == 1
    out = _feed(card, [(5, 7000, 1.0)], watermark=4_000_000)
    assert out["txn_count_24h"].tolist() == [3]


def test_every_message_has_one_fate(spark):
    path = scratch_path(spark, "disorder")
    own, made = jobs.job_session(spark, 4), []
    parts = [[("a", 10**7, "c"), ("b", 10**7 + 5, None), ("a", 10**7, "c")], [("x", 50, "c"), ("y", 60, None),
             ("b", 10**7 + 5, None), ("d", 10**7 + 9, "c")]]
    for part in parts:
        rows = [json.dumps({"TransactionID": i, "TransactionDT": t, "TransactionAmt": 5.0, "ProductCD": "W",
                            **({"card1": 9} if c else {})}) for i, t, c in part] + ['{"TransactionID": "cut', ""]
        spark.createDataFrame([(r.encode(),) for r in rows], "value binary").coalesce(1).write.mode("append").parquet(path)
        stream = jobs.file_stream(own, path, "value binary")
        rows = jobs.decision_job(stream, CFG, lambda df: df.withColumn("fraud_probability", F.lit(0.01)))
        run = rows.writeStream.format("parquet").option("path", path + "-out").option(
            "checkpointLocation", path + "-checkpoint").trigger(availableNow=True).start()
        run.awaitTermination()
    made = spark.read.parquet(path + "-out").select("key", "topic", F.get_json_object("value", "$.decision").alias("d"))
    rows = sorted((r.key[:8], r.d == "ERROR", r.topic == CFG.kafka.error_output_topic) for r in made.collect())
    assert [r[:2] for r in rows if not r[0].startswith("unknown_")] == [
        ("a", False), ("b", False), ("d", False), ("x", True), ("y", True)]
    assert all(r[1] == r[2] for r in rows)
    assert sum(r[0].startswith("unknown_") for r in rows) == 4


def test_a_stream_goes_on_where_a_table_or_a_stopped_run_ends(spark, sf_dir):
    """First third as a table, the rest in two runs over one checkpoint: equal to one batch plan."""
    events = spark.read.schema(EVENT_SCHEMA).parquet(f"{sf_dir}/events.parquet")
    own, path = jobs.job_session(spark, 4), scratch_path(spark, "resumed")
    whole = scored(transactions(spark, sf_dir))
    cuts = [r[0] for r in events.selectExpr("explode(array_sort(collect_list(ts)))").collect()]
    first, second = cuts[len(cuts) // 3], cuts[2 * len(cuts) // 3]
    table = own.read.schema(EVENT_SCHEMA).parquet(f"{sf_dir}/events.parquet").where(F.col("ts") < F.lit(first))
    history = state.card_history(jobs.with_watermark(scored(shape_events(table)), CFG))
    for part in ((F.col("ts") >= F.lit(first)) & (F.col("ts") < F.lit(second)), F.col("ts") >= F.lit(second)):
        events.where(part).coalesce(1).write.mode("append").parquet(path)
        stream = scored(shape_events(jobs.file_stream(own, path, EVENT_SCHEMA)))
        out = jobs.with_card_state(stream.select(*STATE_IN), CFG, history=history)
        out.select("TransactionID", *SEEN).writeStream.format("parquet").option("path", path + "-out").option(
            "checkpointLocation", path + "-checkpoint").trigger(availableNow=True).start().awaitTermination()
    done = spark.read.parquet(path + "-out")
    late = events.where(F.col("ts") >= F.lit(first)).select(F.col("event_id").alias("TransactionID"))
    batch = profile_history(online_velocity_counts(whole, ["card1"])).join(late, "TransactionID").select(
        "TransactionID", *SEEN)
    rounded = ["amt_sum_1h", "amt_sum_24h", "amt_mean_24h", "seen_amount_mean", "seen_amount_std"]
    done, batch = (df.withColumns({c: F.round(c, 6) for c in rounded}) for df in (done, batch))
    assert done.count() == batch.count()
    assert batch.exceptAll(done).isEmpty()


def test_sinks_hold_each_row_once_after_a_stop(spark):
    path = scratch_path(spark, "sinks")
    log, calls = sinks.BatchLog(f"{path}/log", keep=1), []
    rows = spark.createDataFrame([("1", "x", "a"), ("2", "y", "b"), ("3", "z", "a")], "key string, value string, topic string")

    def counted(name, write, stop=False):
        def run(df, batch):
            calls.append((name, batch))
            write(df, batch)
            if stop:
                raise InterruptedError
        return run

    a, b = sinks.topic_folder(f"{path}/a", "a"), sinks.topic_folder(f"{path}/b", "b")
    with pytest.raises(InterruptedError):
        sinks.deliver({"a": counted("a", a), "b": counted("b", b, stop=True)}, log)(rows, 0)
    assert sinks.read_topic(spark, f"{path}/b", log, "b").count() == 0  # no record of it
    other = rows.withColumn("key", F.lit("changed"))  # a second evaluation need not give the same rows
    sinks.deliver({"a": counted("a", a), "b": counted("b", b)}, log)(other, 0)
    sinks.deliver({"a": counted("a", a), "b": counted("b", b)}, log)(other, 0)
    assert calls == [("a", 0), ("b", 0), ("b", 0)]
    assert sorted(r.key for r in sinks.read_topic(spark, f"{path}/a", log, "a").collect()) == ["1", "3"]
    assert [r.key for r in sinks.read_topic(spark, f"{path}/b", log, "b").collect()] == ["2"]
    sinks.deliver({"a": a, "b": b}, log)(rows, 1)
    assert not sinks.exists(spark, f"{path}/log/staged/batch=0") and sinks.exists(spark, f"{path}/log/staged/batch=1")
    assert sinks.read_topic(spark, f"{path}/a", log, "a").count() == 4
