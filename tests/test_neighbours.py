"""Nearest neighbours against brute force, and what oversampling adds."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardwatch.operators import neighbours

FEATURES = ["a", "b", "c"]


def _brute(rows, k):
    out = {}
    x = {i: [0.0 if v is None or v != v or abs(v) == float("inf") else float(v) for v in f] for i, *f in rows}
    def d2(a, b):
        total = 0.0  # not sum(), which compensates rounding
        for p, q in zip(a, b, strict=True):
            total += (p - q) * (p - q)
        return total

    for i in x:
        out[i] = sorted((d2(x[i], x[j]), j) for j in x if j != i)[:k]
    return out


def _found(spark, rows, k, **options):
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    got = neighbours.nearest_neighbours(df, "id", FEATURES, k, **options).collect()
    assert len(got) == len(rows)
    return {r.id: [(n.d2, n.id) for n in r.neighbours] for r in got}


@pytest.mark.parametrize("spread", [3, 1000])
def test_neighbours_equal_brute_force(spark, spread):
    """Few values make ties and copies; many make the blocks' bounds work."""
    rnd = random.Random(spread)
    rows = [(i, float(rnd.randrange(spread)), rnd.random() if spread > 3 else 1.0, float(rnd.randrange(spread) // 2))
            for i in range(400)]
    rows += [(1000 + i, None if i % 2 else float("nan"), float("inf") if i % 3 else 0.0, -0.0) for i in range(30)]
    assert _found(spark, rows, 5, pivots=12, block=16, visitors=7) == _brute(rows, 5)


def test_a_third_of_all_rows_alike(spark):
    rows = [(i, 7.0, 7.0, 7.0) for i in range(200)] + [(500 + i, float(i), 7.0, float(i % 5)) for i in range(300)]
    assert _found(spark, rows, 4, pivots=5, block=20) == _brute(rows, 4)


def test_fewer_rows_than_neighbours(spark):
    rows = [(1, 0.0, 0.0, 0.0), (2, 3.0, 0.0, 4.0), (3, 0.0, 0.0, 0.0)]
    assert _found(spark, rows, 5) == _brute(rows, 5)
    assert _found(spark, rows[:1], 5) == {1: []}
    assert _found(spark, [], 5) == {}


def test_second_round_visits_few_blocks(spark):
    """The bound spares most pairs of blocks, whatever order the rows come in."""
    rng = np.random.default_rng(1)
    rows = [(i, *map(float, p)) for i, p in enumerate(rng.normal(0, 100, (2000, 3)))]
    seen = []
    real = neighbours.materialize
    try:
        neighbours.materialize = lambda df, label: seen.append((label, t := real(df, label))) or t
        assert _found(spark, rows, 3, pivots=64, block=32) == _brute(rows, 3)
    finally:
        neighbours.materialize = real
    visits = dict(seen)["visits"].count()
    assert 0 < visits < 2000 * 63 / 4


def test_oversampling_reaches_the_ratio(spark):
    rows = [(f"r{i}", int(i % 10 == 0), float(i), float(i % 7), None) for i in range(100)]
    df = spark.createDataFrame(rows, "id string, y int, a double, b double, c double")
    out = neighbours.smote_oversample(df, "y", "id", FEATURES, ratio=0.5, k=3).cache()
    made = out.where("id is null").collect()
    assert out.where("y = 1").count() == 45 and len(made) == 35 and out.where("y = 0").count() == 90
    by_id = {r[0]: r for r in rows}
    near = _brute([(r[0], *r[2:]) for r in rows if r[1]], 3)
    copies = {}
    for r in made:
        base, other = by_id[r.base_id], by_id[r.neighbour_id]
        assert r.neighbour_id in [j for _, j in near[r.base_id]]
        assert min(base[2], other[2]) <= r.a <= max(base[2], other[2]) and r.c == 0
        copies[r.base_id] = copies.get(r.base_id, 0) + 1
    assert set(copies.values()) == {3, 4}
    assert out.exceptAll(neighbours.smote_oversample(df, "y", "id", FEATURES, ratio=0.5, k=3)).isEmpty()


def test_nothing_to_add(spark):
    df = spark.createDataFrame([(1, 1, 1.0, 1.0, 1.0), (2, 0, 1.0, 1.0, 1.0), (3, 0, 1.0, 1.0, 1.0)],
                               "id long, y int, a double, b double, c double")
    assert neighbours.smote_oversample(df, "y", "id", FEATURES).count() == 3
    assert neighbours.smote_oversample(df.limit(0), "y", "id", FEATURES).count() == 0
    even = df.unionByName(df.withColumn("id", F.col("id") + 10).withColumn("y", 1 - F.col("y")))
    assert neighbours.smote_oversample(even, "y", "id", FEATURES).count() == 6
