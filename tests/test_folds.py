"""Ordered recursions in levels, and on a stream cut anywhere, equal one pass."""

import pytest
from pyspark.sql import functions as F

from cardwatch.operators import folds
from cardwatch.session import scratch_path
from cardwatch.streaming import jobs
from cardwatch.streaming.folds import DecayingAverage, ThresholdReplay

COLUMNS = ["model", "t", "y", "p", "v"]
OPTIONS = {"window": 10, "min_rows": 4}


def _rows(n=150):
    """One key with two thirds of all rows, a small one, one that comes late, and rows without a key.

    No score lies on the grid of the thresholds, where the rounding of sums would decide.
    """
    keys = ["hot"] * 6 + ["small"] * 2 + [None]
    return [(keys[i % 9] if i < 110 or i % 3 else "late", i, int((i * 31) % 17 == 0 or 60 < i < 80),
             (i * 37) % 100 / 100 + 0.003, 0.9 if i % 13 == 0 else 0.1) for i in range(n)]


def _one_pass(rows, window, min_rows):
    past, x, out = {}, {}, {}
    for key, t, y, p, v in rows:
        if key is None:
            continue
        seen = past.setdefault(key, [])
        seen.append((y, p))
        last, now = seen[-window:], x.get(key, 0.5)
        right = None
        if len(last) >= min_rows:
            rate = sum(a for a, _ in last) / len(last)
            right = sum((b >= now) == (a == 1) for a, b in last) / len(last)
            now += (-0.02 if rate > 0.05 else 0.02 if rate < 0.02 else 0.0) - (0.01 if v > 0.7 else 0.0)
            now = min(max(now, 0.1), 0.9)
        x[key] = now
        out[t] = (key, pytest.approx(now), right if right is None else pytest.approx(right))
    return out


def _got(df):
    return {r.t: (r.model, r.threshold, r.accuracy if r.active else None) for r in df.collect()}


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(_rows(), "model string, t bigint, y int, p double, v double")


@pytest.mark.parametrize("fan", [2, 1000])
def test_levels_of_maps_equal_one_pass(table, fan):
    got = folds.adaptive_threshold_replay(table, *_names(), block=10, fan=fan, **OPTIONS)
    assert _got(got) == _one_pass(_rows(), **OPTIONS)


def _names():
    key, t, *rest = COLUMNS
    return [key, [t], *rest]


def test_composed_maps_are_the_maps_in_turn():
    maps = [(1.0, 0.3, 0.1, 0.9), (0.5, 0.1, float("-inf"), float("inf")), (0.0, 0.4, float("-inf"), float("inf")),
            (1.0, -0.7, 0.1, 0.9), (0.9, 0.2, 0.0, 0.6)]
    for n in range(1, len(maps) + 1):
        total = (1.0, 0.0, float("-inf"), float("inf"))
        for m in maps[:n]:
            total = folds._then(total, m)
        for x in (-3.0, 0.0, 0.2, 0.5, 4.0):
            y = x
            for scale, shift, floor, roof in maps[:n]:
                y = min(max(scale * y + shift, floor), roof)
            assert min(max(total[0] * x + total[1], total[2]), total[3]) == pytest.approx(y)


@pytest.mark.parametrize("cuts", [[1, 4, 60, 61, 150], [75, 75, 150]])
def test_a_stream_cut_anywhere_equals_one_pass(spark, table, cuts):
    """Empty micro-batches, cuts inside windows, keys that pause and that begin late."""
    sink = ThresholdReplay(scratch_path(spark, "replay"), *_names(), block=10, fan=2, **OPTIONS)
    assert sink.read(spark, table.schema).count() == 0
    low = 0
    for number, high in enumerate(cuts):
        sink(table.where(F.col("t").between(low, high - 1)), number)
        low = high
    sink(table.where(F.col("t").between(cuts[-2], cuts[-1] - 1)), len(cuts) - 1)  # run again after a stop
    assert _got(sink.read(spark, table.schema)) == _one_pass(_rows(), **OPTIONS)


def test_a_decaying_average_goes_on(spark):
    values = [((i * 7919) % 100) / 100 for i in range(40)]
    df = spark.createDataFrame(list(enumerate(values)), "batch_id bigint, v double")
    path = scratch_path(spark, "batches")
    for low, high in ((0, 1), (1, 25), (25, 40)):
        df.where(F.col("batch_id").between(low, high - 1)).coalesce(1).write.mode("append").parquet(path)
    sink = DecayingAverage(scratch_path(spark, "average"), "batch_id", "v")
    jobs.run_each(jobs.file_stream(spark, path, df.schema, files_per_trigger=1), sink, "average-run")
    sink(df.limit(0), 3)
    got, avg = {r.batch_id: r.ewma for r in sink.read(spark, df.schema).collect()}, 0.0
    for i, v in enumerate(values):
        avg = 0.9 * avg + 0.1 * v
        assert got[i] == pytest.approx(avg, abs=1e-12)
    one = folds.ewma_confidence(df, "batch_id", "v", block=7, fan=2).collect()
    assert {r.batch_id: r.ewma for r in one} == pytest.approx(got)
