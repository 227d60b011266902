"""Registry of runnable queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cardwatch.sources import binding

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

_TXN_COLUMNS = ",\n    ".join(f"{e} AS {n}" for n, e in binding.TRANSACTION_RULES.items())

# The transaction view in DuckDB's dialect; everything after `base` is shared text.
TXN_CTE = f"""base AS (
  SELECT event_id, user_id, event_type, value,
    CAST(json_extract_string(props, '$.k') AS INT) AS k,
    epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS us
  FROM events
), txn AS (
  SELECT {_TXN_COLUMNS}
  FROM base
)"""

SCORED_CTE = f"""{TXN_CTE}, scored AS (
  SELECT *, {binding.SCORE_RULE} AS fraud_probability FROM txn
)"""

ORDERS_CTE = """otxn AS (
  SELECT o_orderkey AS TransactionID,
    CAST(floor((epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1992-01-01')) / 1000000) AS BIGINT)
      AS TransactionDT,
    o_custkey AS card1, CAST(floor(o_totalprice) AS DOUBLE) AS TransactionAmt, o_orderstatus AS ProductCD
  FROM orders
)"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is its independent DuckDB formulation."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def with_txn(body: str) -> str:
    return f"WITH {TXN_CTE}\n{body}"


def with_scored(body: str) -> str:
    return f"WITH {SCORED_CTE}\n{body}"
