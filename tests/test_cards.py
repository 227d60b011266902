"""Groups of cards: equal to a card on its own, ids without a card, expiry, histories, requests sent together."""

import json
import pickle
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cardwatch.catalog import streams
from cardwatch.catalog.risk import CFG
from cardwatch.session import scratch_path
from cardwatch.sources import schemas
from cardwatch.streaming import jobs, state
from test_state import OUT, _Handle, _Now

COLUMNS = ["TransactionID", "t", "TransactionAmt", *state.PROFILE, state.KEY, "_event_ms"]
TTL = 40 * state.DAY_MS


class _Group(_Handle):
    """State in memory that clears a timer when it is registered twice, as the engine does."""

    def expire(self, step, key, watermark):
        due = sorted({t for t in self.timers if t <= watermark})
        self.timers = [t for t in self.timers if t > watermark]
        for at in due:
            list(step.handleExpiredTimer((key,), _Now(watermark), SimpleNamespace(getExpiryTimeInMs=lambda at=at: at)))


def _step(handle, kind=state.CardsState):
    step = kind(COLUMNS, StructType.fromDDL(OUT), "t", "TransactionID", 1, TTL)
    step.init(handle)
    return step


def _rows(rng, n, cards, days=30):
    t = rng.integers(0, days * 86400, n)
    return pd.DataFrame({
        "TransactionID": rng.permutation(n), "t": t, "TransactionAmt": np.where(rng.random(n) < 0.1, np.nan, rng.integers(1, 99, n) / 8),
        **{c: pd.Series([None if v == 3 else f"{c}{v}" for v in rng.integers(0, 6, n)], dtype=object)
           if c not in ("addr1", "addr2") else pd.Series(np.where(rng.random(n) < 0.2, np.nan, rng.integers(0, 5, n)))
           for c in state.PROFILE},
        state.KEY: [str(c) for c in rng.integers(0, cards, n)], "_event_ms": t * 1000})


def _run(step, key, rows, watermark=0):
    return pd.concat(step.handleInputRows((key,), iter([rows.iloc[:7], rows.iloc[7:]]), _Now(watermark)), ignore_index=True)


def _plain(frame):
    frame = frame.sort_values(["TransactionID", "_fate"], kind="stable")
    return [[round(v, 9) if isinstance(v, float) and v == v else str(v) for v in row] for row in frame.astype(object).to_numpy().tolist()]


def test_a_group_gives_what_its_cards_give(spark, monkeypatch):
    """cards share the calls of a group; rows, fates and what is kept are those of a card on its own."""
    monkeypatch.setattr(state, "ROWS_AT_ONCE", 40)  # a group is worked on in parts
    rng = np.random.default_rng(5)
    rows = _rows(rng, 400, 9).sort_values("t", kind="stable")
    parts = [pd.concat([p, p.iloc[::5], rows.iloc[:9]]) for p in (rows.iloc[:150], rows.iloc[150:170], rows.iloc[170:])]
    group, handle = None, _Group()
    group, alone = _step(handle), {}
    for part, watermark in zip(parts, (0, 86_400_000, 12 * 86_400_000), strict=True):
        got = _run(group, "5", part, watermark)
        want = []
        for card, own in part.groupby(state.KEY):
            one = alone.setdefault(card, _step(_Handle(), state.CardState))
            want.append(_run(one, card, own, watermark))
        assert _plain(got) == _plain(pd.concat(want, ignore_index=True))
        assert set(got["_fate"]) >= {"decided", "duplicate"}
    kept = {(card, *k): v for card, one in alone.items() for k, v in one.hours.items()}
    assert kept == dict(handle.states["hours"])
    assert {(card, *k) for card, one in alone.items() for k in one.ids} == set(handle.states["ids"])
    assert {card: one.card.value for card, one in alone.items()} == {k[0]: v for k, v in handle.states["cards"].items()}


def test_a_group_hands_on_tables_not_cards(spark):
    """what each call of the operator costs is paid for a group."""
    rows = _rows(np.random.default_rng(1), 300, 100)
    assert len(list(_step(_Group()).handleInputRows(("5",), iter([rows]), _Now()))) == 1


def test_cards_of_a_group_go_each_at_its_time(spark):
    handle = _Group()
    step = _step(handle)
    rows = _rows(np.random.default_rng(2), 60, 3, days=1)
    rows.loc[rows[state.KEY] == "1", ["t", "_event_ms"]] += np.array([20 * 86400, 20 * 86400 * 1000])
    _run(step, "5", rows)
    handle.expire(step, "5", TTL + 10 * state.DAY_MS)
    assert set(handle.states["cards"]) == {("1",)}
    assert {k[0] for k in [*handle.states["hours"], *handle.states["ids"]]} == {"1"}
    # one that comes again when the watermark has passed it, before its timer, begins anew
    again = rows[rows[state.KEY] == "1"].iloc[:1].assign(t=70 * 86400, _event_ms=70 * 86400 * 1000 + TTL)
    watermark = int(rows["_event_ms"].max()) + TTL
    out = _run(step, "5", again, watermark)
    assert out["_fate"].tolist() == ["decided"] and out["seen_amount_n"].tolist() == [0]
    assert len(handle.states["ids"]) == len(handle.states["hours"]) == 1
    handle.expire(step, "5", watermark + state.DAY_MS)
    assert set(handle.states["cards"]) == {("1",)}  # it has a later day now
    handle.expire(step, "5", 10**14)
    assert not any(handle.states[s] for s in ("cards", "hours", "ids", "due"))


@pytest.mark.parametrize("kind", [state.CardState, state.CardsState])
def test_ids_without_a_card_share_a_key(spark, kind):
    """many messages without a card in one call; each id is known till its time is over, and has no history."""
    handle = _Group()
    step = _step(handle, kind)
    rows = _rows(np.random.default_rng(3), 50, 1, days=3).assign(**{state.KEY: None})
    first = _run(step, "id:7", rows)
    assert first["_fate"].tolist() == ["decided"] * 50
    assert not first[["txn_count_7d", "amt_sum_24h", "seen_amount_n"]].to_numpy().any()
    assert first["seen_amount_mean"].isna().all() and not any(first["seen_devices"])
    other = rows.iloc[:20].assign(t=rows["t"] + 9, _event_ms=rows["_event_ms"] + 9000)
    assert set(_run(step, "id:7", other)["_fate"]) == {"duplicate"}
    none = rows.iloc[:3].assign(TransactionID=None)
    assert set(_run(step, "id:7", none)["_fate"]) == {"decided"}
    handle.expire(step, "id:7", TTL + state.DAY_MS)
    old = rows["_event_ms"] // state.HOUR_MS < 24
    assert len(handle.states["ids"]) == (~old).sum() > 0
    assert set(_run(step, "id:7", rows[old])["_fate"]) == {"decided"}
    assert set(_run(step, "id:7", rows[~old])["_fate"]) == {"duplicate"}
    handle.expire(step, "id:7", 10**14)
    assert not handle.states["ids"] and not handle.states["hours"]


def test_groups_are_bounded_and_refused_rows_have_none_of_a_card(spark):
    """the number of keys doesn't grow with the messages."""
    ids = spark.range(20000).select(jobs._group(F.col("id").cast("string")).alias("g"))
    assert state.GROUPS * 0.99 < ids.distinct().count() <= state.GROUPS
    assert spark.range(1).select(jobs._group(F.lit(None).cast("string"))).first()[0] is None


def test_a_group_begins_with_histories(spark):
    """the cards of a group are taken over in one call and go on like those that were fed."""
    rng = np.random.default_rng(8)
    rows = _rows(rng, 120, 4, days=5).sort_values("t", kind="stable").fillna({"TransactionAmt": 1.0})
    fed, begun = _Group(), _Group()
    step = _step(fed)
    _run(step, "5", rows.iloc[:80])
    names = [c.split()[0] for c in state.CARD_SCHEMA.split(", ")]
    lines = [{"key": k[0], "hour": None, **dict(zip(names, v, strict=True))} for k, v in fed.states["cards"].items()]
    lines += [{"key": k[0], "hour": k[1], **dict(zip(("times", "amounts", "ids"), v, strict=True))} for k, v in fed.states["hours"].items()]
    frame = pd.DataFrame(lines, columns=state.HISTORY).assign(group="5")
    frame.columns = range(frame.shape[1])  # computed columns come by number
    other = _step(begun)
    other.handleInitialState(("5",), frame.iloc[:9], _Now())
    other.handleInitialState(("5",), frame.iloc[9:], _Now())
    assert begun.states == fed.states and set(begun.timers) == set(fed.timers)
    assert _plain(_run(step, "5", rows.iloc[70:])) == _plain(_run(other, "5", rows.iloc[70:]))


class _Wire:
    """The far side of a state's socket: answers in turn, and only to what was sent before."""

    def __init__(self):
        self.kept, self.sent, self.answers, self.most = {}, b"", [], 0
        self.sockfile = SimpleNamespace(write=self._write, flush=self._flush)
        self.pickleSer = pickle
        self._send_proto_message = None

    def _write(self, data):
        self.sent += data

    def _flush(self):
        import pyspark.sql.streaming.proto.StateMessage_pb2 as wire

        while self.sent:
            size = int.from_bytes(self.sent[4:8], "big")
            call = wire.StateRequest.FromString(self.sent[8:8 + size]).stateVariableRequest.mapStateCall
            self.sent = self.sent[8 + size:]
            kind = call.WhichOneof("method")
            key = pickle.loads(getattr(call, kind).userKey)
            if kind == "updateValue":
                self.kept[key] = call.updateValue.value
            elif kind == "removeKey":
                self.kept.pop(key, None)
            known = key in self.kept
            self.answers.append((0 if known or kind != "containsKey" else 2, "", self.kept.get(key, b"") if kind == "getValue" else b""))
        self.most = max(self.most, len(self.answers))

    def _receive_proto_message(self):
        return self.answers.pop(0)

    def _deserialize_from_bytes(self, value):
        return pickle.loads(value)


def test_requests_to_the_state_go_out_together():
    wire = _Wire()
    absent = lambda *a: pytest.fail("one by one")
    held = SimpleNamespace(_stateName="ids", _mapStateClient=SimpleNamespace(_stateful_processor_api_client=wire),
                           getValue=absent, containsKey=absent, updateValue=absent, removeKey=absent)
    keys = [("c", k) for k in range(300)]
    state._put(held, keys[:200], [(k, [0.5] * k) for k in range(200)])
    state._drop(held, keys[:50])
    assert state._has(held, keys) == [50 <= k < 200 for k in range(300)]
    assert state._get(held, keys) == [(k, [0.5] * k) if 50 <= k < 200 else None for k in range(300)]
    assert wire.most == state._TOGETHER and not wire.answers
    wire.answers = []
    wire._flush = wire.sockfile.flush = lambda: wire.answers.extend([(1, "broken", b"")] * 2)
    with pytest.raises(RuntimeError, match="broken"):
        state._put(held, keys[:2], [(1,), (2,)])
    assert not wire.answers


def test_the_job_reads_a_message_once_and_passes_what_it_decides_by(spark):
    """one parser for decided, malformed and rejected messages; few columns go through the state."""
    stream = jobs.file_stream(jobs.job_session(spark, 2), _messages(spark, []), "value binary")
    plan = jobs.decision_job(stream, CFG, streams._scorecard)._jdf.queryExecution().analyzed()
    text = plan.toString()
    assert text.count("StreamingRelation") == 1 and text.count("from_json") == 1
    step = next(line for line in text.splitlines() if "TransformWithState" in line)
    assert not any(f"{f.name}#" in step for f in schemas.transaction_schema() if f.name.startswith(("V", "id_", "C", "M")))


def _messages(spark, texts):
    path = scratch_path(spark, "wire")
    spark.createDataFrame([(t.encode(),) for t in texts], "value binary").coalesce(1).write.parquet(path)
    return path


def test_messages_set_apart_have_their_records(spark):
    """records of malformed, rejected and late messages, each for every copy; a model sees no missing amount."""
    own, path = jobs.job_session(spark, 2), scratch_path(spark, "apart")
    made = {"TransactionDT": 10**7, "TransactionAmt": 5.0, "card1": 9}
    first = [json.dumps({"TransactionID": "a", **made}), json.dumps({"TransactionID": "far", **made, "TransactionDT": 10**9, "TransactionAmt": -1}),
             json.dumps({"TransactionID": "neg", **made, "TransactionAmt": -1}), json.dumps({"TransactionID": "no", "card1": 9}),
             json.dumps({"TransactionAmt": 3.0}), '{"TransactionID": "cut', ""]
    second = [json.dumps({"TransactionID": "b", **made, "TransactionDT": 10**7 + 9}), json.dumps({"TransactionID": "late", **made, "TransactionDT": 5})]

    def score(df):
        strict = F.udf(lambda i, a: 0.01 if i is not None and a > 0 else 1 / 0, "double")
        return df.withColumn("fraud_probability", strict("TransactionID", "TransactionAmt"))

    for texts in (first * 2, second):
        spark.createDataFrame([(t.encode(),) for t in texts], "value binary").coalesce(1).write.mode("append").parquet(path)
        rows = jobs.decision_job(jobs.file_stream(own, path, "value binary"), CFG, score)
        rows.writeStream.format("parquet").option("path", path + "-out").option(
            "checkpointLocation", path + "-checkpoint").trigger(availableNow=True).start().awaitTermination()
    found = {}
    for r in spark.read.parquet(path + "-out").collect():
        found.setdefault(r.key, []).append((r.topic == CFG.kafka.error_output_topic, json.loads(r.value)))
    record = {"fraud_probability": 0.5, "decision": "ERROR", "risk_level": "UNKNOWN"}
    for key in ("neg", "no", "far"):
        assert found.pop(key) == [(True, {"transaction_id": key, **record, "threshold": 0.5})] * 2
    assert found.pop("late") == [(True, {"TransactionID": "late", **record})]
    assert [len(found[k]) for k in ("a", "b")] == [1, 1]  # what is far ahead but rejected moved no watermark
    assert not found.pop("a")[0][0] and not found.pop("b")[0][0]
    assert sorted(len(v) for v in found.values()) == [2, 4] and all(k.startswith("unknown_") for k in found)


def test_a_row_without_a_time_counts_nothing_of_its_own(spark):
    """It stands before all times; the other rows of its card are counted as without it."""
    rows = _rows(np.random.default_rng(4), 30, 1, days=1).astype({"t": float, "_event_ms": float})
    want = _run(_step(_Group()), "5", rows).set_index("TransactionID")
    odd = rows.iloc[:2].assign(TransactionID=[100, 101], t=np.nan, _event_ms=np.nan, TransactionAmt=2.0)
    got = _run(_step(_Group()), "5", pd.concat([rows, odd], ignore_index=True)).set_index("TransactionID")
    counts = [f"txn_count_{w}" for w in ("1h", "6h", "24h", "7d")]
    assert got.loc[want.index, counts].equals(want[counts])
    assert got.loc[[100, 101], "txn_count_1h"].tolist() == [-(rows["TransactionAmt"].notna().sum() + 2)] * 2
