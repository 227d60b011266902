"""Ordered recursions, evaluated block by block.

A recursion x[i+1] = f_i(x[i]) is sequential, but if the f_i compose into a small
form (a linear map, a clipped shift) the table can be cut into blocks: every block
reports its composed map, the block maps are chained in order, and every block
is replayed from the value it really starts with. Blocks have a fixed size, and maps
are chained in levels of ``FAN``, so no task depends on how many rows one key has.
The last rows of one part of a sequence are all that the next part needs (``before``).
Results are those of one pass but for the rounding of sums (some 1e-15 of a threshold).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cardwatch.operators.ordering import with_row_index
from cardwatch.session import materialize

#: Rows of a block; maps that are composed to one of the next level.
BLOCK, FAN = 50_000, 1_000
_MAP = ["scale", "shift", "floor", "roof"]


def _then(first: tuple, second: tuple) -> tuple:
    """The map x -> second(first(x)) of two maps x -> min(max(scale * x + shift, floor), roof), scale >= 0."""
    scale, shift, floor, roof = second

    def inner(x: float) -> float:
        return min(max((scale * x if scale else 0.0) + shift, floor), roof)

    # a scale of nothing makes a constant, whatever the first map's bounds
    return first[0] * scale, first[1] * scale + shift, inner(first[2]), inner(first[3])


def _begins(maps: DataFrame, key: str, starts: DataFrame, fan: int) -> DataFrame:
    """(key, block, begin): the value that each block starts with, from the maps of all blocks.

    ``starts`` has (key, begin) of the first block. ``fan`` maps in a row are composed to one map of the
    next level until each key has one map; the way back hands each map its beginning.
    """
    kind = dict(maps.dtypes)[key]
    numbers = ", ".join(f"{c} double" for c in _MAP)

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        total = (1.0, 0.0, -np.inf, np.inf)
        for step in pdf.sort_values("block")[_MAP].itertuples(index=False, name=None):
            total = _then(total, step)
        return pd.DataFrame([[pdf[key].iloc[0], pdf["up"].iloc[0], *total]], columns=[key, "block", *_MAP])

    def hand_on(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        begins, x = [], pdf["begin"].iloc[0]
        for scale, shift, floor, roof in pdf[_MAP].itertuples(index=False, name=None):
            begins.append(x)
            x = min(max(scale * x + shift, floor), roof)
        return pd.DataFrame({key: pdf[key], "block": pdf["block"], "begin": begins})

    up = F.floor(F.col("block") / fan).cast("bigint").alias("up")
    levels = [materialize(maps.select(key, "block", *_MAP), "fold-maps")]
    while (levels[-1].agg(F.max("block")).first()[0] or 0) > 0:
        higher = levels[-1].select("*", up).groupBy(key, "up").applyInPandas(
            compose, f"{key} {kind}, block bigint, {numbers}")
        levels.append(materialize(higher, "fold-maps"))
    begins = levels.pop().select(key, "block").join(starts, key)
    while levels:
        above = begins.withColumnRenamed("block", "up")
        begins = levels.pop().select("*", up).join(above, [key, "up"]).groupBy(key, "up").applyInPandas(
            hand_on, f"{key} {kind}, block bigint, begin double")
    return begins


def _indexed(df: DataFrame, key: str, order: list[str], block: int) -> DataFrame:
    """Adds the position inside the key, the key's row count and the block number."""
    rows = with_row_index(df.where(F.col(key).isNotNull()), [key, *order])
    spans = rows.groupBy(key).agg(
        F.min("row_index").alias("_first"), F.count(F.lit(1)).alias("key_rows"))
    placed = rows.join(spans, key).withColumn("place", F.col("row_index") - F.col("_first"))
    return placed.drop("row_index", "_first").withColumn("block", F.floor(
        F.col("place") / block).cast("bigint"))


def ewma_confidence(
    batches: DataFrame, order: str, value: str, decay: float = 0.9, start: float = 0.0,
    block: int = BLOCK, fan: int = FAN,
) -> DataFrame:
    """avg <- decay * avg + (1 - decay) * value over ordered batch rows.

    Inside a block the recursion is a fold over at most ``block`` batch means; the
    block's map is avg -> decay^n * avg + c.
    """
    work = materialize(
        _indexed(batches.withColumn("_key", F.lit(0)), "_key", [order], block), "ewma")
    gain = 1 - decay

    def local(pdf: pd.DataFrame, begin: float) -> list[float]:
        out, avg = [], begin
        for x in pdf.sort_values("place")[value]:
            avg = decay * avg + gain * x
            out.append(avg)
        return out

    def summary(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({
            "_key": [0], "block": [pdf["block"].iloc[0]], "scale": [decay ** len(pdf)],
            "shift": [local(pdf, 0.0)[-1]], "floor": [-np.inf], "roof": [np.inf]})

    maps = work.groupBy("block").applyInPandas(
        summary, "_key int, block bigint, scale double, shift double, floor double, roof double")
    first = maps.sparkSession.range(1).select(F.lit(0).alias("_key"), F.lit(float(start)).alias("begin"))
    begins = _begins(maps, "_key", first, fan).drop("_key")

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        return pd.DataFrame({
            order: pdf[order], value: pdf[value], "ewma": local(pdf, pdf["begin"].iloc[0])})

    schema = f"{order} {dict(batches.dtypes)[order]}, {value} double, ewma double"
    return work.join(begins, "block").groupBy("block").applyInPandas(replay, schema)


def adaptive_threshold_replay(
    df: DataFrame, key: str, order: list[str], label: str, score: str, velocity: str,
    base: float = 0.5, window: int = 1000, min_rows: int = 100, low: float = 0.1,
    high: float = 0.9, block: int = BLOCK, fan: int = FAN, before: DataFrame | None = None,
    inputs: bool = False,
) -> DataFrame:
    """Threshold after every labelled row of a key, with fraud rate and accuracy.

    Each row shifts the threshold by an amount that depends on the last ``window``
    labels only and clips it, so a block composes into one clipped shift. Every
    block carries the ``window`` - 1 rows before it to see full windows. ``before`` has the last
    ``window`` - 1 rows of each key of an earlier part (fewer only where there are no more) with their
    thresholds, all earlier in ``order``: the sequence goes on from there. With ``inputs`` the result
    has the columns that a later part needs for that.
    """
    block = max(block, window)
    names = [key, *order, label, score, velocity]
    rows = df.select(*names, F.lit(False).alias("_old"))
    if before is not None:
        rows = rows.unionByName(before.select(*names, F.lit(True).alias("_old")))
    placed = _indexed(rows, key, order, block)
    ahead = (F.col("place") % block >= block - (window - 1)) & (
        (F.col("block") + 1) * block < F.col("key_rows"))
    homes = F.when(ahead, F.array("block", F.col("block") + 1)).otherwise(F.array("block"))
    blocks = materialize(
        placed.withColumn("home", F.explode(homes)).withColumn(
            "own", (F.col("home") == F.col("block")) & ~F.col("_old")), "replay")

    def shifts(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
        pdf = pdf.sort_values("place").reset_index(drop=True)
        y = pdf[label].to_numpy(float)
        sums = np.concatenate([[0.0], np.cumsum(y)])
        ends = np.arange(1, len(y) + 1)
        begins = np.maximum(0, ends - window)
        # only the block's own rows are used, and those see their whole window
        seen = np.minimum(pdf["place"].to_numpy() + 1, window)
        rate = (sums[ends] - sums[begins]) / np.maximum(1, np.minimum(ends - begins, seen))
        move = np.where(rate > 0.05, -0.02, np.where(rate < 0.02, 0.02, 0.0))
        move = move - np.where(pdf[velocity].to_numpy(float) > 0.7, 0.01, 0.0)
        return pdf, rate, move, seen >= min_rows

    def summary(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, _, move, active = shifts(pdf)
        use = active & pdf["own"].to_numpy(bool)
        shift, floor, roof = 0.0, -np.inf, np.inf
        for m in move[use]:
            shift += m
            floor = min(max(floor + m, low), high)
            roof = min(max(roof + m, low), high)
        return pd.DataFrame({
            key: [pdf[key].iloc[0]], "block": [pdf["home"].iloc[0]], "scale": [1.0], "shift": [shift],
            "floor": [floor], "roof": [roof]})

    kinds = dict(df.dtypes)
    maps = blocks.groupBy(key, "home").applyInPandas(
        summary, f"{key} {kinds[key]}, block bigint, scale double, shift double, floor double, roof double")
    starts = blocks.select(key).distinct()
    if before is None:
        starts = starts.withColumn("begin", F.lit(float(base)))
    else:
        last = before.groupBy(key).agg(F.max_by("threshold", F.struct(*order)).alias("begin"))
        starts = starts.join(last, key, "left").select(key, F.coalesce("begin", F.lit(float(base))).alias("begin"))
    begins = _begins(maps, key, starts, fan).withColumnRenamed("block", "home")

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, rate, move, active = shifts(pdf)
        own = pdf["own"].to_numpy(bool)
        y, p = pdf[label].to_numpy(float), pdf[score].to_numpy(float)
        x = pdf["begin"].iloc[0]
        after, accuracy = np.full(len(pdf), np.nan), np.full(len(pdf), np.nan)
        used = np.full(len(pdf), np.nan)
        for i in np.flatnonzero(own):
            if active[i]:
                used[i] = x
                x = min(max(x + move[i], low), high)
            after[i] = x
        # the threshold moves on a grid, so rows share few thresholds: one running sum for each
        for level in np.unique(used[~np.isnan(used)]):
            rows = np.flatnonzero(used == level)
            right = np.concatenate([[0], np.cumsum((p >= level) == (y == 1))])
            first = np.maximum(0, rows + 1 - window)
            accuracy[rows] = (right[rows + 1] - right[first]) / (rows + 1 - first)
        out = pdf[names if inputs else [key, *order]].copy()
        out["threshold"], out["active"] = after, active
        out["fraud_rate"] = np.where(active, rate, np.nan)
        out["accuracy"] = accuracy
        return out[own].reset_index(drop=True)

    schema = ", ".join(f"{c} {kinds[c]}" for c in (names if inputs else [key, *order]))
    return blocks.join(begins, [key, "home"]).groupBy(key, "home").applyInPandas(
        replay, f"{schema}, threshold double, active boolean, fraud_rate double, accuracy double")
