"""Nearest neighbours and oversampling of the rarer class."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardwatch.catalog.base import query, with_txn
from cardwatch.operators import neighbours
from cardwatch.sources.binding import transactions

FEATURES = ["TransactionAmt", "dist1", "C1", "C13", "D2", "D15", "V127"]
K, SEED = 5, 42

_FILLED = ", ".join(f"coalesce({c}, 0) AS {c}" for c in FEATURES)
_D2 = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in FEATURES)
_NEAR_SQL = f"""rare AS (SELECT TransactionID AS id, {_FILLED} FROM txn WHERE isFraud = 1),
near AS (SELECT a.id, b.id AS other, {_D2} AS d2,
  row_number() OVER (PARTITION BY a.id ORDER BY {_D2}, b.id) AS place
  FROM rare a JOIN rare b ON a.id <> b.id QUALIFY place <= {K})"""


@query("nearest_neighbours", with_txn("").rstrip() + f""", {_NEAR_SQL}
SELECT id AS TransactionID, place, other AS neighbour_id, d2 FROM near""")
def nearest_neighbours(spark, d):
    rare = transactions(spark, d).where("isFraud = 1")
    near = neighbours.nearest_neighbours(rare, "TransactionID", FEATURES, K)
    return near.select("TransactionID", F.posexplode("neighbours").alias("place", "n")).select(
        "TransactionID", (F.col("place") + 1).cast("bigint").alias("place"),
        F.col("n.id").alias("neighbour_id"), F.col("n.d2").alias("d2"))


def _share(tag: str) -> str:
    return f"CAST('0x' || substr(md5('{SEED}:' || m.id || ':' || copy || ':{tag}'), 1, 7) AS BIGINT)"


@query("smote_oversample", with_txn("").rstrip() + f""", {_NEAR_SQL},
size AS (SELECT count(*) FILTER (isFraud = 0) - count(*) FILTER (isFraud = 1) AS more,
  count(*) FILTER (isFraud = 1) AS have FROM txn),
ranked AS (SELECT id, row_number() OVER (ORDER BY (id % 2147483648 + {SEED}) * 2654435761 % 4294967296, id) - 1 AS pos
  FROM rare),
made AS (SELECT id, unnest(range(1, 1 + more // have + CASE WHEN pos < more % have THEN 1 ELSE 0 END)) AS copy
  FROM ranked, size),
picked AS (SELECT m.id, copy, {_share('u')} / 268435456e0 AS gap, n.other FROM made m JOIN near n ON n.id = m.id
  AND n.place = 1 + {_share('n')} % {K})
SELECT TransactionID, isFraud, {_FILLED}, NULL AS base_id, NULL AS copy, NULL AS neighbour_id FROM txn
UNION ALL SELECT NULL, 1, {", ".join(f"a.{c} + gap * (b.{c} - a.{c})" for c in FEATURES)}, a.id, copy, other
FROM picked p JOIN rare a ON a.id = p.id JOIN rare b ON b.id = p.other""")
def smote_oversample(spark, d):
    """The rarer class up to the size of the other."""
    return neighbours.smote_oversample(
        transactions(spark, d), "isFraud", "TransactionID", FEATURES, k=K, seed=SEED)
