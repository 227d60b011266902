"""Trailing time windows per key, one plan whatever a key's size.

* Rows of equal time collapse into one point per (key, time), combined before the shuffle;
* points are grouped in short time buckets; a frame [t - w, t) is the suffix of
  the bucket holding t - w, the whole buckets between, and the prefix of the
  bucket holding t. Each of the three is a running aggregate, no task holds
  more than one bucket's points or one key's buckets, and the answers return by an equi join.

A key with most of the table is so split by time, and its arithmetic is that of every key.
"""

from __future__ import annotations

from functools import reduce
from math import gcd

from pyspark.sql import Column, DataFrame, Window, functions as F

from cardwatch.session import materialize

BUCKETS_PER_WIDTH = 4
STATS = ("rows", "n", "sum", "mean", "std_pop", "std_samp", "max")


def trailing_stats(
    df: DataFrame,
    *,
    key: list[str],
    time: str,
    value: str,
    widths: dict[str, int],
    stats: tuple[str, ...] = ("n", "sum"),
    inclusive: bool = False,
) -> DataFrame:
    """Add ``{stat}_{width}`` over non-NULL values in [t - w, t) of the same key.

    ``rows`` counts rows, ``n`` non-NULL values. ``inclusive`` closes the frame at
    t, so the row and its peers count too. A row whose key has a NULL part gets
    zero counts and no other statistic.
    """
    unknown = set(stats) - set(STATS)
    if unknown:
        raise ValueError(f"unknown statistics {sorted(unknown)}")
    answers = _answers(df.where(complete_key(key)), key, time, value, widths, stats, inclusive)
    counts = [f"{s}_{w}" for s in stats if s in ("rows", "n") for w in widths]
    return df.join(answers, [*key, time], "left").fillna(0, counts)


def complete_key(key: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key])


def _answers(df, key, time, value, widths, stats, inclusive) -> DataFrame:
    """(key, time, statistics) of every point of ``df``."""
    bucket = max(1, reduce(gcd, widths.values()) // BUCKETS_PER_WIDTH)
    while any(w % bucket for w in widths.values()):
        bucket -= 1
    sums = ["r", "n", "s", "x", "xx"]  # rows, values, sum, centred first and second moments
    points = materialize(df.groupBy(*key, F.col(time).alias("_t")).agg(
        F.count(F.lit(1)).alias("r"), F.count(value).alias("n"), F.sum(value).alias("s"),
        (F.var_pop(value) * F.count(value)).alias("_own"), F.max(value).alias("m")), "points")
    # moments are taken around the key's mean, so that squares don't cancel
    centre = points.groupBy(*key).agg(F.coalesce(F.sum("s") / F.sum("n"), F.lit(0.0)).alias("_centre")) \
        if {"std_pop", "std_samp"} & set(stats) else None
    if centre is None:
        points = points.withColumn("_centre", F.lit(0.0))
    else:
        points = points.join(centre, key)
    offset = F.col("s") - F.col("n") * F.col("_centre")
    points = points.select(
        *key, "_t", "r", "n", "s", offset.alias("x"),
        F.when(F.col("n") > 0, F.col("_own") + offset * offset / F.col("n")).alias("xx"), "m",
        F.floor(F.col("_t") / bucket).alias("_b"))
    if centre is not None:
        points = materialize(points, "points")

    names = list(widths)
    marks = [F.struct(F.lit(-1).alias("w"), F.col("_t").alias("q"), F.col("_b").alias("qb"))] + [
        F.struct(F.lit(i).alias("w"), (F.col("_t") - widths[name]).alias("q"),
                 (F.col("_b") - widths[name] // bucket).alias("qb"))
        for i, name in enumerate(names)
    ]
    # every point also asks, at t - w, what its first bucket holds from there on
    asks = points.select(*key, "_t", "_b", *sums, "m", F.inline(F.array(*marks)))
    real = F.col("w") == -1
    asks = asks.withColumns({c: F.when(real, F.col(c)) for c in [*sums, "m"]})
    part = Window.partitionBy(*key, "qb")
    before = part.orderBy("q").rangeBetween(
        Window.unboundedPreceding, 0 if inclusive else -1)
    onward = part.orderBy(F.desc("q")).rangeBetween(Window.unboundedPreceding, 0)
    edge = {}
    for c in [*sums, "m"]:
        agg = F.max if c == "m" else F.sum
        edge[f"e_{c}"] = F.when(real, agg(c).over(before)).otherwise(agg(c).over(onward))
    edges = asks.select(*key, "_t", "_b", "w", *[c.alias(n) for n, c in edge.items()])
    per_point = edges.groupBy(*key, "_t", "_b").agg(*[
        F.max(F.when(F.col("w") == i, F.col(f"e_{c}"))).alias(f"{c}_{i}")
        for i in range(-1, len(names)) for c in [*sums, "m"]
    ])

    totals = points.groupBy(*key, "_b").agg(
        *[F.sum(c).alias(c) for c in sums], F.max("m").alias("m"))
    by_bucket = Window.partitionBy(*key).orderBy("_b")
    whole = {}
    for i, name in enumerate(names):
        reach = widths[name] // bucket - 1
        for c in [*sums, "m"]:
            agg = F.max if c == "m" else F.sum
            whole[f"w_{c}_{i}"] = (
                agg(c).over(by_bucket.rangeBetween(-reach, -1)) if reach >= 1
                else F.lit(None).cast("double")
            )
    whole_buckets = totals.select(*key, "_b", *[c.alias(n) for n, c in whole.items()])

    answers = per_point.join(whole_buckets, [*key, "_b"], "left")
    zero = F.lit(0.0)

    def total(c: str, i: int) -> Column:
        pieces = [F.col(f"{c}_-1"), F.col(f"w_{c}_{i}"), F.col(f"{c}_{i}")]
        if c == "m":
            return F.greatest(*pieces)
        return sum((F.coalesce(p, zero) for p in pieces), zero)

    out: dict[str, Column] = {}
    for i, name in enumerate(names):
        r, n, s, x, xx = (total(c, i) for c in sums)
        spread = F.greatest(xx - x * x / n, zero)
        made = {
            "rows": r.cast("bigint"),
            "n": n.cast("bigint"),
            "sum": F.when(n > 0, s),
            "mean": F.when(n > 0, s / n),
            "std_pop": F.when(n > 0, F.sqrt(spread / n)),
            "std_samp": F.when(n > 1, F.sqrt(spread / (n - 1))),
            "max": total("m", i),
        }
        out.update({f"{stat}_{name}": made[stat] for stat in stats})
    return answers.select(
        *key, F.col("_t").alias(time), *[c.alias(n) for n, c in out.items()])


def distinct_trailing(
    df: DataFrame,
    *,
    key: list[str],
    time: str,
    value: str,
    widths: dict[str, int],
) -> DataFrame:
    """Add ``n_``/``sum_`` of the distinct values a key showed in [t - w, t).

    A value occurring at s is visible for t in (s, s + w]. Occurrences of one
    value inside one bucket chain into a single visible stretch, so they collapse
    in a map-side combined aggregation; stretches then add +1 where they begin
    and -1 where they end, and a row reads the running total before t. The
    running total is split by bucket with carried totals, so no key is one task.
    """
    bucket = min(widths.values())
    key_time = [*key, "_at"]
    rows = df.where(complete_key(key))
    stretches = (
        rows.where(F.col(value).isNotNull())
        .groupBy(*key, F.col(value).alias("_v"), F.floor(F.col(time) / bucket).alias("_b"))
        .agg(F.min(time).alias("lo"), F.max(time).alias("hi"))
        .withColumn("prev", F.lag("hi").over(Window.partitionBy(*key, "_v").orderBy("_b")))
    )
    # amounts are summed as decimals: begins and ends must cancel exactly
    amount = F.col("_v").cast("decimal(30,6)")
    zero_amount = F.lit(0).cast("decimal(30,6)")
    changes = []
    for i, (name, width) in enumerate(widths.items()):
        begin = F.greatest("lo", F.col("prev") + width)
        end = F.col("hi") + width
        changes += [
            F.struct(F.lit(i).alias("w"), begin.alias("_at"), F.lit(1).alias("dn"),
                     amount.alias("dv")),
            F.struct(F.lit(i).alias("w"), end.alias("_at"), F.lit(-1).alias("dn"),
                     (-amount).cast("decimal(30,6)").alias("dv")),
        ]
    moved = stretches.select(*key, F.inline(F.array(*changes)))
    per_time = moved.groupBy(*key_time).agg(*[
        agg for i, name in enumerate(widths) for agg in (
            F.sum(F.when(F.col("w") == i, F.col("dn")).otherwise(0)).alias(f"dn_{i}"),
            F.sum(F.when(F.col("w") == i, F.col("dv")).otherwise(zero_amount)).alias(f"dv_{i}"),
        )
    ])
    fields = [f"{p}_{i}" for i in range(len(widths)) for p in ("dn", "dv")]
    asked = rows.select(*key, F.col(time).alias("_at")).distinct().withColumn("_ask", F.lit(True))
    line = per_time.join(asked, key_time, "full").withColumn(
        "_b", F.floor(F.col("_at") / bucket))
    line = materialize(line, "sweep")
    carried = line.groupBy(*key, "_b").agg(*[F.sum(f).alias(f) for f in fields])
    earlier = Window.partitionBy(*key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = carried.select(*key, "_b", *[F.sum(f).over(earlier).alias(f"c_{f}") for f in fields])
    inside = Window.partitionBy(*key, "_b").orderBy("_at").rowsBetween(
        Window.unboundedPreceding, -1)
    at = line.select(*key, "_b", "_at", "_ask", *[
        F.sum(f).over(inside).alias(f) for f in fields
    ]).where("_ask").join(carried, [*key, "_b"], "left")
    out = {}
    for i, name in enumerate(widths):
        n = F.coalesce(f"dn_{i}", F.lit(0)) + F.coalesce(f"c_dn_{i}", F.lit(0))
        v = F.coalesce(f"dv_{i}", zero_amount) + F.coalesce(f"c_dv_{i}", zero_amount)
        out[f"n_{name}"], out[f"sum_{name}"] = n, v.cast("double")
    answers = at.select(*key, F.col("_at").alias(time), *[c.alias(n) for n, c in out.items()])
    return df.join(answers, [*key, time], "left")
