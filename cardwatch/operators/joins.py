"""Identity join, deduplication against kept rows, request/reply matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def join_identity(txn: DataFrame, identity: DataFrame, key: str = "TransactionID") -> DataFrame:
    return txn.join(identity, key, "left")


def dedup_against_seen(
    new: DataFrame, seen: DataFrame, key: str = "TransactionID"
) -> DataFrame:
    """New messages whose id was not kept before, one per id.

    Copies collapse first (combined before the shuffle), so an id repeated in much of
    the table is one row by the time it is joined.
    """
    return new.dropDuplicates([key]).join(seen.select(key), key, "left_anti")


def union_predictions(fraud: DataFrame, legit: DataFrame) -> DataFrame:
    """Both topics as one table, tagged by origin."""
    return fraud.withColumn("type", F.lit("FRAUD")).unionByName(
        legit.withColumn("type", F.lit("LEGIT")), allowMissingColumns=True)


def match_reply(
    requests: DataFrame, replies: DataFrame, key: str = "transaction_id",
    asked: str = "request_ts", answered: str = "reply_ts", timeout_ms: int = 2000,
) -> DataFrame:
    """First reply of the same id within the timeout; times are in milliseconds."""
    a, b = F.col(f"q.{asked}"), F.col(f"r.{answered}")
    in_time = (F.col(f"q.{key}") == F.col(f"r.{key}")) & (b >= a) & (b <= a + timeout_ms)
    firsts = (
        requests.alias("q").join(replies.alias("r"), in_time, "left")
        .groupBy(F.col(f"q.{key}").alias(key), a.alias(asked))
        .agg(F.min(F.when(b.isNotNull(), F.struct(
            b.alias("at"), F.col("r.decision").alias("decision"),
            F.col("r.probability").alias("probability"),
            F.col("r.risk_level").alias("risk_level")))).alias("reply"))
    )
    status = (F.when(F.col("reply").isNull(), "timeout")
              .when(F.col("reply.decision") == "APPROVE", "approved").otherwise("blocked"))
    return firsts.select(
        key, status.alias("status"), F.col("reply.decision").alias("decision"),
        F.col("reply.probability").alias("probability"),
        F.col("reply.risk_level").alias("risk_level"),
        (F.col("reply.at") - F.col(asked)).alias("latency_ms"))
