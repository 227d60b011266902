"""Work over many columns: one scan for all correlations, no expansion for distinct counts."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardwatch.functions import columns as fx
from cardwatch.operators import clean, comoments, groups
from cardwatch.session import scratch_path


def _pearson(x, y):
    both = [(a, b) for a, b in zip(x, y, strict=True) if a is not None and b is not None]
    if len(both) < 2:
        return None
    a, b = (np.array(v) - np.mean(v) for v in zip(*both, strict=True))
    down = math.sqrt((a * a).sum() * (b * b).sum())
    return abs((a * b).sum() / down) if down else None


@pytest.mark.parametrize("parts", [1, 40])
def test_correlations_equal_brute_force(spark, parts):
    rng = np.random.default_rng(1)
    wide = rng.normal(0, 1, (400, 5)) @ rng.normal(0, 1, (5, 70)) + 1e7  # far from zero: sums alone would lose it
    rows = [[None if (i * 7 + j) % 11 == 0 else float(v) for j, v in enumerate(r)] for i, r in enumerate(wide)]
    for r in rows:
        r[3], r[4] = 5.0, None  # constant, and never set
    rows[5][6] = float("nan")
    names = [f"v.{j}" if j == 9 else f"v{j}" for j in range(70)]
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` double" for n in names)).repartition(parts)
    df = df.withColumnRenamed("v.9", "v9")
    names[9] = "v9"
    got = {(r[0], r[1]): r[2] for r in comoments.correlation_pairs(df, names).collect()}
    rows[5][6] = None
    assert len(got) == 70 * 69 // 2
    columns = list(zip(*rows, strict=True))
    for i in range(70):
        for j in range(i + 1, 70):
            want = _pearson(columns[i], columns[j])
            assert got[names[i], names[j]] == (want if want is None else pytest.approx(want, abs=1e-6))


def test_correlations_of_339_columns_scan_once(spark):
    path = scratch_path(spark, "wide")
    spark.range(2000).select(*[
        ((F.col("id") * (j % 17 + 1) + j) % (j + 3)).cast("double").alias(f"V{j}") for j in range(339)]).write.parquet(path)
    df = spark.read.parquet(path)
    assert comoments.correlation_pairs(df, df.columns).count() == 339 * 338 // 2
    copy = df.select("V40", "V41", (F.col("V40") * 3 - 1).alias("again"))
    assert clean.correlated_columns(copy, copy.columns) == ["again"]
    assert comoments.correlation_pairs(df.limit(0), df.columns[:5]).count() == 0


def test_distinct_counts_without_expansion(spark):
    rows = [(k % 3 if k % 7 else None, float(k % 5) if k % 4 else None, f"t{k % 6}", None) for k in range(300)]
    rows += [(0, -0.0, "t0", None), (0, 0.0, "t0", None), (9, None, None, None)]
    df = spark.createDataFrame(rows, "k int, v double, t string, n int")
    counted = {"n_v": "v", "n_t": "t", "n_n": "n"}
    got = {r.k: (r.n_v, r.n_t, r.n_n) for r in groups.distinct_counts(df, "k", counted).collect()}
    want = {}
    for k, v, t, _ in rows:
        if k is not None:
            a, b = want.setdefault(k, (set(), set()))
            a |= set() if v is None else {v + 0.0}
            b |= set() if t is None else {t}
    assert got == {k: (len(a), len(b), 0) for k, (a, b) in want.items()}
    joined = groups.attach_distinct(df, "k", counted)
    assert joined.count() == len(rows)
    assert joined.where("k is null and n_v is not null").isEmpty()
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan


def test_rare_makers_are_counted_as_written(spark):
    rows = [("Windows",)] * 3 + [("windows x",)] * 5 + [("Other thing",)] * 2 + [("OTHER THING",)] * 2
    df = spark.createDataFrame(rows, "DeviceInfo string").withColumn("corp", fx.device_corp(upper=False))
    got = groups.rare_to_other(df, "corp", min_rows=3).groupBy("DeviceInfo", "corp").count().collect()
    assert {r.DeviceInfo: r.corp for r in got if r.DeviceInfo.lower() == "other thing"} == {
        "Other thing": "OTHER", "OTHER THING": "OTHER"}  # two and two, not four
