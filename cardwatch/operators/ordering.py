"""Exact order statistics without sorting the table.

A rank is located by repeated histograms: each pass counts values in at most
``bins`` intervals (map-side combined, so only the bins travel), keeps the
interval holding the rank and narrows to it. Ties cost nothing, and no task
ever sees more than one interval's distinct values.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

from cardwatch.session import materialize

BINS = 1024
SMALL = 10_000  # rows of an interval whose values are listed, instead of counted once more


def values_at_ranks(
    df: DataFrame, column: str, ranks: Iterable[int], bins: int = BINS, small: int = SMALL
) -> dict[int, tuple[float, int]]:
    """0-based rank -> (value, rows strictly below it), NULLs left out."""
    work = df.select(F.col(column).alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    ranks = sorted(set(ranks))
    if not ranks:
        return {}
    lo, hi, n = work.agg(F.min("v"), F.max("v"), F.count("v")).first()
    if any(r < 0 or r >= n for r in ranks):
        raise ValueError(f"rank out of range for {n} rows")
    spans = {r: (lo, hi, 0, n) for r in ranks}  # low, high, rows below, rows inside
    while True:
        wide = sorted({s[:2] for s in spans.values() if s[0] < s[1] and s[3] > small})
        if not wide:
            break
        found = _histogram(work, wide, bins)
        for r, (low, high, below, _) in spans.items():
            if (low, high) not in wide:
                continue
            seen = below
            for bin_low, bin_high, count in found[(low, high)]:
                if r < seen + count:
                    spans[r] = (bin_low, bin_high, seen, count)
                    break
                seen += count
    out: dict[int, tuple[float, int]] = {}
    narrow = sorted({s[:2] for s in spans.values() if s[0] < s[1]})
    listed = {}
    for low, high in narrow:
        rows = work.where(F.col("v").between(low, high)).groupBy("v").count().collect()
        listed[(low, high)] = sorted((row["v"], row["count"]) for row in rows)
    for r, (low, high, below, _) in spans.items():
        if low == high:
            out[r] = (low, below)
            continue
        for value, count in listed[(low, high)]:
            if r < below + count:
                out[r] = (value, below)
                break
            below += count
    return out


def _histogram(work: DataFrame, spans: list[tuple], bins: int) -> dict[tuple, list[tuple]]:
    v = F.col("v")
    span_id, bin_id = F.lit(None).cast("int"), F.lit(None).cast("int")
    for i, (low, high) in enumerate(spans):
        inside = v.between(low, high)
        # halves keep high - low finite for the widest doubles
        share = (v / 2 - F.lit(low) / 2) / (high / 2 - low / 2)
        span_id = F.when(inside, F.lit(i)).otherwise(span_id)
        bin_id = F.when(inside, F.floor(share * bins).cast("int")).otherwise(bin_id)
    rows = (
        work.select(span_id.alias("s"), bin_id.alias("b"), "v")
        .where("s IS NOT NULL")
        .groupBy("s", "b")
        .agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("v").alias("n"))
        .collect()
    )
    found: dict[tuple, list[tuple]] = {span: [] for span in spans}
    for row in sorted(rows, key=lambda x: (x["s"], x["b"])):
        found[spans[row["s"]]].append((row["lo"], row["hi"], row["n"]))
    return found


def exact_quantiles(df: DataFrame, column: str, qs: list[float]) -> list[float]:
    """Linearly interpolated quantiles."""
    n = df.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))).count()
    if n == 0:
        return [None] * len(qs)
    places = [q * (n - 1) for q in qs]
    ranks = {math.floor(p) for p in places} | {math.ceil(p) for p in places}
    at = values_at_ranks(df, column, ranks)
    out = []
    for p in places:
        low, high = at[math.floor(p)][0], at[math.ceil(p)][0]
        out.append(low + (high - low) * (p - math.floor(p)))
    return out


def known_time(column: str) -> Column:
    """Rows with a usable place in time; the others come after all of them."""
    t = F.col(column)
    return t.isNotNull() & ~F.isnan(t.cast("double"))


def order_cuts(df: DataFrame, order: tuple[str, str], ranks: Iterable[int]) -> dict[int, tuple]:
    """0-based rank -> (time, id) of the row there, in (time, id) order.

    Rows without a time follow the others (their cut has time None), ordered by id. Ids may be
    of any type that sorts; ties are ranked by a range partitioning, never on one task.
    """
    time_col, id_col = order
    timed = df.where(known_time(time_col))
    n = timed.count()
    ranks = sorted(set(ranks))
    wanted: dict = {}
    for rank, (value, below) in values_at_ranks(timed, time_col, [r for r in ranks if r < n]).items():
        wanted.setdefault(value, []).append((rank, rank - below))
    if ranks and ranks[-1] >= n:
        wanted[None] = [(r, r - n) for r in ranks if r >= n]
    out = {}
    for value, places in wanted.items():
        same = ~known_time(time_col) if value is None else F.col(time_col) == value
        ids = with_row_index(df.where(same).select(id_col), [id_col]).where(
            F.col("row_index").isin([inner for _, inner in places])).collect()
        by_place = {r["row_index"]: r[id_col] for r in ids}
        out |= {rank: (value, by_place[inner]) for rank, inner in places}
    return out


def at_or_before(order: tuple[str, str], cut: tuple) -> Column:
    """Never NULL: a row without a time is behind every row that has one, a missing id before all."""
    timed, i = known_time(order[0]), F.col(order[1])
    early = F.coalesce(i <= F.lit(cut[1]), i.isNull()) if cut[1] is not None else i.isNull()
    if cut[0] is None:
        return timed | early
    t = F.col(order[0])
    return timed & ((t < cut[0]) | ((t == cut[0]) & early))


def with_row_index(df: DataFrame, order: list[str], out: str = "row_index") -> DataFrame:
    """Add the 0-based position in ``order`` without a single-task sort.

    Rows are range-partitioned and written once, so part numbers are stable; a
    position is the size of all earlier parts plus the place inside the own part.
    """
    parts = materialize(
        df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    # one row per part: the ordered running sum is over the number of parts only
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        "_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return (
        parts.withColumn("_place", place)
        .join(F.broadcast(starts), "_part")
        .withColumn(out, F.col("_start") + F.col("_place"))
        .drop("_part", "_place", "_start")
    )
