"""Exact nearest neighbours of every row among all rows, and oversampling between them.

Rows with equal features are one class, so copies are never paired. Classes go to the nearest of a bounded
number of pivots; a cell's classes are put in order of their distance to its pivot and cut into blocks. A first
round compares within blocks, which bounds each class's k-th distance. By the triangle inequality a
block whose distances to its pivot lie between two values holds nothing nearer than their gap to the class's own
distance to that pivot; a second round visits just the blocks which the bound leaves open. Blocks have a
bounded number of classes and of visitors in a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import (
    ArrayType, DoubleType, LongType, StructField, StructType,
)

from cardwatch.operators.ordering import with_row_index
from cardwatch.operators.split import mixed
from cardwatch.session import materialize

PIVOTS = 256  # rows that cells are built around
BLOCK, MOST_BLOCKS = 256, 100_000  # classes of a block; blocks get larger beyond that many
VISITORS = 2048  # classes that meet a block in one task, about
SLACK = 1e-12  # relative error allowed to a computed distance


def finite(c: str) -> Column:
    """A feature as the distance sees it: missing and infinite values are 0."""
    v = F.col(c).cast("double")
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == math.inf), 0.0).otherwise(v).alias(c)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, added up feature by feature so that any engine gets the same bits."""
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        gap = a[:, j, None] - b[None, :, j]
        out += gap * gap
    return out


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    return np.array(column.tolist(), float).reshape(len(column), width)


def _nearest(d2: np.ndarray, need: np.ndarray, ids: list, limit: np.ndarray) -> list[list]:
    """For each row of ``d2`` the ``need`` nearest ids of the columns' classes, by (distance, id)."""
    out = []
    for line, n, most in zip(d2, need.tolist(), limit.tolist(), strict=True):
        bound = most
        if n < len(line):
            bound = min(bound, float(np.partition(line, n - 1)[n - 1])) if n else -1.0
        near = np.flatnonzero(line <= bound) if n and math.isfinite(bound) else (
            np.flatnonzero(np.isfinite(line)) if n else [])
        found = sorted((float(line[c]), i) for c in near for i in ids[c])
        out.append([{"d2": d, "id": i} for d, i in found[:n]])
    return out


def _classes(rows: DataFrame, id_col: str, features: list[str], k: int) -> DataFrame:
    """Distinct feature vectors: the smallest id ``c``, the vector ``x`` and the first k + 1 ids."""
    first = Window.partitionBy(*features).orderBy(id_col)
    few = rows.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k + 1)
    return few.groupBy(*features).agg(F.sort_array(F.collect_list(id_col)).alias("ids")).select(
        F.col("ids")[0].alias("c"), F.array(*features).alias("x"), "ids",
        F.greatest(F.lit(0), F.lit(k + 1) - F.size("ids")).alias("need"))


def nearest_neighbours(
    df: DataFrame, id_col: str, features: list[str], k: int = 5, pivots: int = PIVOTS,
    block: int = BLOCK, visitors: int = VISITORS,
) -> DataFrame:
    """Every row's id and ``neighbours``: the k other rows nearest by Euclid, ties by id, as (d2, id) in order.

    Ids are unique and not missing; they may be of any type that sorts. Missing and infinite features
    count as 0. With k or fewer rows each has all others; an empty table gives no rows.
    """
    rows = df.select(F.col(id_col).alias("_id"), *[finite(c) for c in features])
    kind, width = rows.schema["_id"].dataType, len(features)
    found = StructType([StructField("d2", DoubleType()), StructField("id", kind)])
    classes = materialize(_classes(rows, "_id", features, k), "classes")
    spark, total = df.sparkSession, classes.count()
    sample = classes.select("x", mixed(classes, "c", 42).alias("_m"), "c").orderBy("_m", "c").limit(pivots).collect()
    centres = np.array([r["x"] for r in sample], float).reshape(len(sample), width)
    size = max(block, -(-total // MOST_BLOCKS))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            far = np.sqrt(_squares(_matrix(f["x"], width), centres))
            cell = far.argmin(axis=1) if len(f) else np.zeros(0, int)
            yield f.assign(cell=cell.astype(np.int64), r=far[np.arange(len(f)), cell])

    schema = StructType([*classes.schema.fields, StructField("cell", LongType()), StructField("r", DoubleType())])
    placed = with_row_index(classes.mapInPandas(place, schema), ["cell", "r", "c"], "_at")
    blocks = materialize(placed.withColumn("block", F.floor(F.col("_at") / size).cast("long")).drop("_at"), "blocks")

    def within(f: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(f["x"], width)
        d2 = _squares(x, x)
        np.fill_diagonal(d2, np.inf)
        need = f["need"].to_numpy()
        near = _nearest(d2, need, [list(i) for i in f["ids"]], np.full(len(f), np.inf))
        limit = [0.0 if not n else (p[-1]["d2"] if len(p) == n else np.inf) for p, n in zip(near, need, strict=True)]
        return f[["c", "x", "need", "cell", "block"]].assign(near=near, limit=limit)

    opened = StructType([StructField("c", kind), StructField("x", ArrayType(DoubleType())),
                         StructField("need", classes.schema["need"].dataType), StructField("cell", LongType()),
                         StructField("block", LongType()), StructField("near", ArrayType(found)),
                         StructField("limit", DoubleType())])
    first = materialize(blocks.groupBy("block").applyInPandas(within, opened), "first")
    # one row per block and cell in it: MOST_BLOCKS + pivots rows at most
    rings = blocks.groupBy("block", "cell").agg(F.min("r").alias("low"), F.max("r").alias("high")).toPandas()
    rings = rings.sort_values(["cell", "low"], kind="stable")
    ring = {c: rings[c].to_numpy() for c in rings}
    begin = np.searchsorted(ring["cell"], np.arange(len(centres) + 1))
    shared = spark.sparkContext.broadcast((centres, ring, begin))

    def visits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres, ring, begin = shared.value
        for f in frames:
            f = f[f["need"] > 0].reset_index(drop=True)
            far = np.sqrt(_squares(_matrix(f["x"], width), centres))
            reach = np.sqrt(f["limit"].to_numpy(float)) * (1 + SLACK)
            who, where = [], []
            for k_, (d, own, u, home) in enumerate(zip(
                    far, f["cell"].tolist(), reach.tolist(), f["block"].tolist(), strict=True)):
                half = (d - d[own]) / 2 - SLACK * (d + d[own])  # nothing of the cell is nearer than this
                for cell in np.flatnonzero(half <= u).tolist():
                    part = slice(begin[cell], begin[cell + 1])
                    low, high, near = ring["low"][part], ring["high"][part], d[cell]
                    gap = np.maximum(near - high, low - near) - SLACK * (near + high)
                    open_ = ring["block"][part][gap <= u]
                    open_ = open_[open_ != home]
                    who.append(np.full(len(open_), k_))
                    where.append(open_)
            who = np.concatenate([np.zeros(0, int), *who]).astype(int)
            out = f[["c", "x", "need", "limit"]].iloc[who].assign(
                block=np.concatenate([np.zeros(0, np.int64), *where]).astype(np.int64))
            for a in range(0, len(out), 10_000):
                yield out.iloc[a:a + 10_000].drop_duplicates(["c", "block"])

    asked = StructType([f for f in opened if f.name in ("c", "x", "need", "limit")] + [StructField("block", LongType())])
    visit = materialize(first.select("c", "x", "need", "limit", "cell", "block").mapInPandas(visits, asked), "visits")
    load = visit.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / visitors).cast("long").alias("parts"))
    visit = visit.join(load, "block").withColumn("part", F.pmod(F.xxhash64("c"), F.col("parts"))).drop("parts")
    hosts = blocks.join(load, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "block", F.col("part").cast("long").alias("part"), "x", "ids")

    def meet(asking: pd.DataFrame, host: pd.DataFrame) -> pd.DataFrame:
        out, ids = [], [list(i) for i in host["ids"]]
        y = _matrix(host["x"], width)
        for a in range(0, len(asking), 512):
            part = asking.iloc[a:a + 512]
            near = _nearest(_squares(_matrix(part["x"], width), y), part["need"].to_numpy(), ids,
                            part["limit"].to_numpy(float))
            out.append(pd.DataFrame({"c": part["c"], "near": near}))
        return pd.concat(out) if out else pd.DataFrame({"c": [], "near": []})

    met = visit.groupBy("block", "part").cogroup(hosts.groupBy("block", "part")).applyInPandas(
        meet, StructType([StructField("c", kind), StructField("near", ArrayType(found))]))
    every = first.select("c", "near").unionByName(met).select("c", F.explode("near").alias("near")).distinct()
    best = Window.partitionBy("c").orderBy("near.d2", "near.id")
    others = every.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k).groupBy("c").agg(
        F.collect_list("near").alias("others"))
    known = classes.join(others, "c", "left").select(
        *[F.col("x")[i].alias(f"_x{i}") for i in range(width)], "ids", "others")
    same = [F.col(c) == F.col(f"_x{i}") for i, c in enumerate(features)]
    # a second, redundant key lets adaptive execution split rows of one class (see groups.join_stats)
    same.append(F.xxhash64(*features) == F.xxhash64(*[f"_x{i}" for i in range(width)]))
    zero = F.transform("ids", lambda i: F.struct(F.lit(0.0).alias("d2"), i.alias("id")))
    none = F.array().cast(ArrayType(found))
    line = F.array_sort(F.concat(zero, F.coalesce("others", none)))
    line = F.filter(line, lambda n: n["id"] != F.col("_id"))
    return rows.join(known, same).select(F.col("_id").alias(id_col), F.slice(line, 1, k).alias("neighbours"))


def _share(parts: list[Column]) -> Column:
    """A whole number below 2^28 from the MD5 of the parts' text."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("long")


def smote_oversample(
    df: DataFrame, label: str, id_col: str, features: list[str], ratio: float = 1.0, k: int = 5, seed: int = 42,
) -> DataFrame:
    """The rows of both classes, and new ones of the rarer class until it has ``ratio`` times the other's rows.

    A new row lies between a row and one of its k nearest of the same class, at a fraction; both are chosen by
    hash of (seed, id, copy), so a run can be repeated. All rows get equally many copies, those first by
    hash one more. Columns: id (missing in new rows), label, the features (missing and infinite values
    as 0), ``base_id``, ``copy``, ``neighbour_id`` (missing in given rows). With fewer than two rows of the rarer
    class, or enough of them, nothing is added. The label is 0 or 1; rows with another label stay as they are.
    """
    rows = df.select(F.col(id_col).alias("_id"), F.col(label).alias("_y"), *[finite(c) for c in features])
    n = {r["_y"]: r["count"] for r in rows.where(F.col("_y").isin(0, 1)).groupBy("_y").count().collect()}
    rare = 1 if n.get(1, 0) <= n.get(0, 0) else 0
    have, add = n.get(rare, 0), max(0, math.floor(ratio * n.get(1 - rare, 0)) - n.get(rare, 0))
    kind = rows.schema["_id"].dataType
    given = rows.select(F.col("_id").alias(id_col), F.col("_y").alias(label), *features,
                        F.lit(None).cast(kind).alias("base_id"), F.lit(None).cast("long").alias("copy"),
                        F.lit(None).cast(kind).alias("neighbour_id"))
    if have < 2 or not add:
        return given
    few = rows.where(F.col("_y") == rare).drop("_y")
    near = nearest_neighbours(few, "_id", features, k)
    ranked = with_row_index(few.select("_id", mixed(few, "_id", seed).alias("_m")), ["_m", "_id"], "_at")
    copies = F.lit(add // have) + (F.col("_at") < add % have).cast("long")
    made = ranked.where(copies > 0).select("_id", F.explode(F.sequence(F.lit(1).cast("long"), copies.cast("long"))).alias("copy"))
    made = made.join(near, "_id")
    pick = F.pmod(_share([F.lit(seed), F.col("_id"), F.col("copy"), F.lit("n")]), F.size("neighbours")).cast("int")
    gap = _share([F.lit(seed), F.col("_id"), F.col("copy"), F.lit("u")]) / float(2**28)
    made = made.select("_id", "copy", F.col("neighbours")[pick]["id"].alias("_other"), gap.alias("_gap"))
    other = few.select(F.col("_id").alias("_other"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(features)])
    new = made.join(few, "_id").join(other, "_other").select(
        F.lit(None).cast(kind).alias(id_col), F.lit(rare).cast(df.schema[label].dataType).alias(label),
        *[(F.col(c) + F.col("_gap") * (F.col(f"_o{i}") - F.col(c))).alias(c) for i, c in enumerate(features)],
        F.col("_id").alias("base_id"), "copy", F.col("_other").alias("neighbour_id"))
    return given.unionByName(new)
