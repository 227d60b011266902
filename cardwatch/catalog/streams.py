"""Streaming queries, run over the tables until everything available is processed."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from cardwatch.catalog import evaluation, monitoring  # noqa: F401  their SQL is used here
from cardwatch.catalog.base import ORACLE, SCORED_CTE, TXN_CTE, query, with_scored, with_txn
from cardwatch.catalog.risk import CFG, DECISION_SQL, _join, _joined
from cardwatch.functions import risk
from cardwatch.operators import monitor, split
from cardwatch.sources import payload, schemas
from cardwatch.sources.binding import EVENT_SCHEMA, TRANSACTION_RULES, scored, shape_events
from cardwatch.session import scratch_path
from cardwatch.streaming import jobs, sinks
from cardwatch.streaming.folds import ThresholdReplay
from cardwatch.streaming.recent import RecentRows
from cardwatch.streaming.state import FATE, card_history

_ID = "TransactionID"

#: State partitions of the queries here; a job on a cluster sets its own.
STATE_PARTITIONS = 8


def events_stream(spark, d, spread=False):
    """The events table as a stream of transactions with a probability.

    The pattern matches the one table, whether it is a file or a folder of files. With ``spread`` the rows of a file
    that can't be split are dealt to all cores as they are read, before they are shaped and made into messages.
    """
    session = jobs.job_session(spark, STATE_PARTITIONS)
    events = jobs.file_stream(session, f"{d}/event[s].parquet", EVENT_SCHEMA)
    if spread:  # by all columns: a task that is run again deals its rows the same way
        events = events.repartition(2 * max(STATE_PARTITIONS, spark.sparkContext.defaultParallelism), *events.columns)
    return scored(shape_events(events))


_STATE_IN = [_ID, "TransactionDT", "t_us", "card1", "TransactionAmt", "ProductCD", "addr1", "addr2",
             "dist1", "DeviceInfo", "P_emaildomain", "card6", "fraud_probability"]


@query("stream_source", with_txn("SELECT TransactionID, TransactionAmt, card1 FROM txn"))
def stream_source(spark, d):
    return jobs.run_available(
        events_stream(spark, d).select(_ID, "TransactionAmt", "card1"), "source")


@query("stateful_velocity", ORACLE["online_velocity_counts"])
def stateful_velocity(spark, d):
    out = jobs.with_card_state(events_stream(spark, d, spread=True).select(*_STATE_IN), CFG)
    return jobs.run_available(out.select(
        _ID, "txn_count_1h", "txn_count_6h", "txn_count_24h", "txn_count_7d", "amt_sum_1h",
        "amt_sum_24h", "amt_mean_24h"), "velocity")


_SEEN = ("seen_addr1", "seen_addr2", "seen_devices", "seen_emails", "seen_card_types")


@query("stateful_profile", ORACLE["profile_history"])
def stateful_profile(spark, d):
    out = jobs.with_card_state(events_stream(spark, d, spread=True).select(*_STATE_IN), CFG)
    done = jobs.run_available(out.select(
        _ID, *_SEEN, "seen_amount_n", "seen_amount_mean", "seen_amount_std"), "profile")
    return _joined(done, *_SEEN).withColumn("seen_amount_std", F.round("seen_amount_std", 4))


@query("stream_decisions", f"""{DECISION_SQL} SELECT TransactionID, decision, risk_level,
  {_join('risk_factors')} FROM fin""")
def stream_decisions(spark, d):
    out = jobs.score_stream(events_stream(spark, d, spread=True).select(*_STATE_IN), CFG)
    done = jobs.run_available(out.select(_ID, "decision", "risk_level", "risk_factors"), "scored")
    return _joined(done, "risk_factors")


def _routed(spark, d):
    """Two-way decisions written once, a folder per topic."""
    p = F.when(F.col("dist1").isNotNull(), F.col("fraud_probability"))
    made = risk.simple_decision(p, CFG.model.base_threshold)
    df = events_stream(spark, d).select(_ID, "TransactionAmt", *[
        c.alias(n) for n, c in made.items()])
    rows = jobs.to_topic_rows(df, CFG)
    return jobs.run_available(rows, "topics")


def _route_sql(condition):
    return with_scored(f"""SELECT CAST(TransactionID AS VARCHAR) AS key FROM scored
WHERE {condition}""")


@query("sink_fraud", _route_sql("dist1 IS NOT NULL AND fraud_probability >= 0.0564e0"))
def sink_fraud(spark, d):
    return _routed(spark, d).where(F.col("topic") == CFG.kafka.fraud_output_topic).select("key")


@query("sink_legit", _route_sql("dist1 IS NOT NULL AND fraud_probability < 0.0564e0"))
def sink_legit(spark, d):
    return _routed(spark, d).where(F.col("topic") == CFG.kafka.legit_output_topic).select("key")


@query("sink_error", _route_sql("dist1 IS NULL"))
def sink_error(spark, d):
    return _routed(spark, d).where(F.col("topic") == CFG.kafka.error_output_topic).select("key")


@query("stream_dedup", with_txn("SELECT TransactionID, card1 FROM txn"))
def stream_dedup(spark, d):
    """Every message arrives twice."""
    stream = events_stream(spark, d).select(
        _ID, "TransactionDT", "card1", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    once = jobs.dedup(jobs.with_watermark(stream.drop("copy"), CFG))
    return jobs.run_available(once.select(_ID, "card1"), "dedup")


def _messages(spark, d):
    df = events_stream(spark, d, spread=True)
    names = {f.name for f in schemas.transaction_schema()}
    text = F.to_json(F.struct(*[F.col(c) for c in df.columns if c in names]))
    return df.select(F.when(F.col("C13") == 42, F.substring(text, 1, 20)).otherwise(text)
                     .cast("binary").alias("value"))


@query("error_isolation", with_txn("""
SELECT CASE WHEN C13 = 42 THEN 'ERROR' ELSE 'parsed' END AS outcome, count(*) AS rows
FROM txn GROUP BY 1"""))
def error_isolation(spark, d):
    parsed = payload.parse_payload_json(_messages(spark, d), schemas.transaction_schema())
    good, dead = jobs.isolate_errors(parsed)
    done = jobs.run_available(
        good.select(F.lit("parsed").alias("outcome")).unionByName(
            jobs.error_records(dead).select(F.col("decision").alias("outcome"))), "isolated")
    return done.groupBy("outcome").agg(F.count(F.lit(1)).alias("rows"))


#: Seconds behind any event time: the last row of a stream that ends.
_FOREVER = 10**10


def _watermarked(spark, d):
    made = risk.simple_decision(F.col("fraud_probability"), CFG.model.base_threshold)
    df = events_stream(spark, d).select(
        "TransactionDT", "card1", "TransactionAmt", "fraud_probability",
        made["decision"].alias("decision"))
    df, flush = jobs.flushable(df, {"TransactionDT": F.lit(_FOREVER)})
    return jobs.with_watermark(df, CFG), [flush]


@query("windowed_counts", f"""WITH {SCORED_CTE}
SELECT (TransactionDT // 3600) * 3600 AS start_dt, CASE WHEN fraud_probability >= 0.0564e0
  THEN 'FRAUD' ELSE 'LEGITIMATE' END AS decision, count(*) AS rows,
  round(sum(fraud_probability), 8) AS probability_sum
FROM scored GROUP BY 1, 2""")
def windowed_counts(spark, d):
    rows, flushes = _watermarked(spark, d)
    done = jobs.run_available(jobs.windowed_counts(rows), "windows", flushes=flushes)
    base = F.unix_timestamp(F.lit("2017-11-30 00:00:00+00:00").cast("timestamp"))
    return done.select((F.unix_timestamp("span.start") - base).alias("start_dt"), "decision",
                       "rows",
                       F.round(F.col("mean_probability") * F.col("rows"), 8)
                       .alias("probability_sum"))


@query("card_sessions", f"""WITH {TXN_CTE}, g AS (SELECT card1, TransactionDT AS t, TransactionAmt,
  CASE WHEN TransactionDT - lag(TransactionDT) OVER w < 14400 THEN 0 ELSE 1 END AS fresh
  FROM txn WINDOW w AS (PARTITION BY card1 ORDER BY TransactionDT, TransactionID)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY card1 ORDER BY t ROWS UNBOUNDED PRECEDING) AS sid
  FROM g)
SELECT card1, min(t) AS start_dt, count(*) AS rows, sum(TransactionAmt) AS amount FROM s
GROUP BY card1, sid""")
def card_sessions(spark, d):
    rows, flushes = _watermarked(spark, d)
    done = jobs.run_available(jobs.card_sessions(rows, "4 hours"), "sessions", flushes=flushes)
    base = F.unix_timestamp(F.lit("2017-11-30 00:00:00+00:00").cast("timestamp"))
    return done.select("card1", (F.unix_timestamp("span.start") - base).alias("start_dt"),
                       "rows", "amount")


@query("reply_correlation", with_scored("""SELECT TransactionID AS transaction_id,
  t_us AS requested_us, CASE WHEN wait <= 2000000 THEN t_us + wait END
    AS replied_us, CASE WHEN wait <= 2000000 THEN made END AS decision,
  CASE WHEN wait <= 2000000 THEN (CASE WHEN made = 'APPROVE' THEN 'approved' ELSE 'blocked' END)
    ELSE 'timeout' END AS status
FROM (SELECT *, CASE WHEN C1 < 5 THEN CAST(D5 * 300000 AS BIGINT) END AS wait,
  CASE WHEN fraud_probability >= 0.0564e0 THEN 'BLOCK' ELSE 'APPROVE' END AS made FROM scored)"""))
def reply_correlation(spark, d):
    """Requests and recorded replies as two streams that end; every request has one row."""
    at = F.timestamp_micros(F.col("t_us"))
    requests = events_stream(spark, d).select(
        F.col(_ID).alias("transaction_id"), at.alias("request_time"))
    replies = events_stream(spark, d).where("C1 < 5").select(
        F.col(_ID).alias("transaction_id"),
        F.timestamp_micros(F.col("t_us") + (F.col("D5") * 300000).cast("bigint"))
        .alias("reply_time"),
        F.when(F.col("fraud_probability") >= 0.0564, "BLOCK").otherwise("APPROVE")
        .alias("decision"))
    end = F.timestamp_seconds(F.lit(_FOREVER))
    key = "transaction_id"  # without a key a row never reaches the join; unlike keys never meet
    requests, last_request = jobs.flushable(requests, {key: F.lit(-1), "request_time": end})
    replies, last_reply = jobs.flushable(replies, {key: F.lit(-2), "reply_time": end})
    done = jobs.run_available(
        jobs.correlate_replies(requests, replies), "replies", flushes=[last_request, last_reply])
    return done.select("transaction_id", F.unix_micros("request_time").alias("requested_us"),
                       F.unix_micros("reply_time").alias("replied_us"), "decision", "status")


@query("stream_job")
def stream_job(spark, d):
    """From message bytes to the rows of the three topics, with messages cut short and sent twice."""
    messages = _messages(spark, d).select(F.explode(F.array("value", "value")).alias("value"))
    rows = jobs.decision_job(messages, CFG, _scorecard)
    return jobs.run_available(rows, "job")


def _scorecard(df):
    """A fixed logistic score, for a model that a deployment brings."""
    margin = F.col("TransactionAmt") * 0.0004 + F.coalesce("dist1", F.lit(0.0)) * 0.001 - 3.6
    return df.withColumn("fraud_probability", 1 / (1 + F.exp(-margin)))


_GAPS_SQL = DECISION_SQL.replace(
    f"{TRANSACTION_RULES['card1']} AS card1", "CASE WHEN event_id % 4 <> 1 THEN user_id ELSE -event_id END AS card1", 1)  # a card seen once


@query("stream_decisions_missing_card", f"""{_GAPS_SQL} SELECT TransactionID, decision, risk_level,
  {_join('risk_factors')} FROM fin""")
def stream_decisions_missing_card(spark, d):
    """A quarter of the messages have no card: no history, but a decision."""
    card = F.when(F.col(_ID) % 4 != 1, F.col("card1"))
    rows = scored(events_stream(spark, d, spread=True).drop("fraud_probability").withColumn("card1", card))
    out = jobs.score_stream(rows.select(*_STATE_IN), CFG)
    done = jobs.run_available(out.select(_ID, "decision", "risk_level", "risk_factors"), "scored")
    return _joined(done, "risk_factors")


@query("stream_fates", with_txn("""SELECT unnest(['decided', 'duplicate']) AS fate, unnest([n, n]) AS rows
FROM (SELECT count(*) AS n FROM txn)"""))
def stream_fates(spark, d):
    """Every message arrives twice: the state operator decides the one and sets the other apart."""
    stream = events_stream(spark, d, spread=True).select(*_STATE_IN, F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    out = jobs.card_fates(stream.drop("copy"), CFG).select(F.col(FATE).alias("fate"))
    return jobs.run_available(out, "fates").groupBy("fate").agg(F.count(F.lit(1)).alias("rows"))


_LATER = "t_us > (SELECT (min(t_us) + max(t_us)) // 2 FROM txn)"


@query("stateful_from_history", with_txn(f"""SELECT h.* FROM ({ORACLE["online_velocity_counts"]}) h
JOIN (SELECT TransactionID FROM txn WHERE {_LATER}) l ON l.TransactionID = h.TransactionID"""))
def stateful_from_history(spark, d):
    """The first half as a table, the second as a stream that begins with its state."""
    stream = events_stream(spark, d, spread=True).select(*_STATE_IN)
    rows = jobs.with_watermark(shape_events(
        stream.sparkSession.read.schema(EVENT_SCHEMA).parquet(f"{d}/events.parquet")), CFG)
    low, high = rows.agg(F.min("t_us"), F.max("t_us")).first()
    cut = (low + high) // 2
    out = jobs.with_card_state(stream.where(F.col("t_us") > cut), CFG,
                               history=card_history(rows.where(F.col("t_us") <= cut)))
    return jobs.run_available(out.select(
        _ID, "txn_count_1h", "txn_count_6h", "txn_count_24h", "txn_count_7d", "amt_sum_1h",
        "amt_sum_24h", "amt_mean_24h"), "velocity")


@query("sinks_once", _route_sql("dist1 IS NOT NULL").replace(
    "AS key", "AS key, CASE WHEN fraud_probability >= 0.0564e0 THEN 'fraud' ELSE 'legit' END AS sink"))
def sinks_once(spark, d):
    """Two sinks, stopped between their writes and started again: each holds each row once."""
    p = F.col("fraud_probability")
    made = risk.simple_decision(p, CFG.model.base_threshold)
    df = events_stream(spark, d).where("dist1 is not null").select(
        _ID, "TransactionAmt", *[c.alias(n) for n, c in made.items()])
    rows, path = jobs.to_topic_rows(df, CFG), scratch_path(spark, "sinks")
    topics = {"fraud": CFG.kafka.fraud_output_topic, "legit": CFG.kafka.legit_output_topic}
    both = {name: sinks.topic_folder(f"{path}/{name}", topic) for name, topic in topics.items()}
    log = sinks.BatchLog(f"{path}/log")

    def stopped(batch_rows, batch):
        both["legit"](batch_rows.limit(3), batch)  # half of a write
        raise InterruptedError("stopped between two writes")

    for now in ({**both, "legit": stopped}, both):
        run = sinks.start(rows, now, log, f"{path}/checkpoint")
        try:
            run.awaitTermination()
        except StreamingQueryException:
            if now is both:
                raise
    return sinks.read_topic(spark, f"{path}/fraud", log, "fraud").select("key", F.lit("fraud").alias("sink")).unionByName(
        sinks.read_topic(spark, f"{path}/legit", log, "legit").select("key", F.lit("legit").alias("sink")))


def _recent(spark, d, n):
    """What the stream's buffer of recent predictions holds when all of the table has passed."""
    made = risk.simple_decision(F.col("fraud_probability"), CFG.model.base_threshold)
    rows = events_stream(spark, d).select(
        _ID, "t_us", "TransactionAmt", "fraud_probability",
        F.when(made["decision"] == "FRAUD", "FRAUD").otherwise("LEGIT").alias("type"))
    buffer = RecentRows(scratch_path(spark, "recent"), n, monitor.ARRIVAL, by="type")
    jobs.run_each(rows, buffer, "recent-run")
    return buffer.read(spark, rows.schema)


@query("stream_recent_n", ORACLE["recent_n"])
def stream_recent_n(spark, d):
    return split.recent_n(_recent(spark, d, 1000), 1000, monitor.ARRIVAL).select(_ID, "t_us", "type")


@query("stream_rolling_fraud_rate", ORACLE["rolling_fraud_rate"])
def stream_rolling_fraud_rate(spark, d):
    return monitor.rolling_fraud_rate(_recent(spark, d, 100))


@query("stream_recent_window_stats", ORACLE["recent_window_stats"])
def stream_recent_window_stats(spark, d):
    return monitor.recent_window_stats(_recent(spark, d, 60)).withColumns({
        c: F.round(c, 6) for c in ("avg_fraud_probability", "avg_amount")})


def _in_turn(spark, rows, sink):
    """Give the stream to ``sink`` in two steps, cut in time within each micro-batch; then what it holds."""
    def handle(part, batch):
        for k, piece in enumerate(split.chronological_split(part)):
            sink(piece, 2 * batch + k)

    jobs.run_each(rows, handle, "folds-run")
    return sink.read(spark, rows.schema)


@query("stream_adaptive_threshold", ORACLE["adaptive_threshold_global"])
def stream_adaptive_threshold(spark, d):
    """The replay of all rows as one sequence, stopped within a window and gone on with."""
    rows = events_stream(spark, d).withColumns({"v": F.expr(evaluation._VR), "model": F.lit("all")})
    sink = ThresholdReplay(scratch_path(spark, "replay"), "model", ["t_us", _ID], "isFraud", "fraud_probability", "v")
    return evaluation._rounded_replay(_in_turn(spark, rows, sink))
