"""Trailing windows, profiles and rank statistics against brute force."""

import math
import statistics

import pytest
from pyspark.sql import Window, functions as F

from cardwatch.operators import ordering, profile, trailing, velocity
from cardwatch.sources.binding import transactions

TIES = [(1, 1, 0, 10.0), (2, 1, 100, 20.0), (3, 1, 100, 30.0), (4, 1, 3600, 40.0),
        (5, 1, 3700, 50.0), (6, None, 100, 60.0), (7, None, 200, 70.0), (8, 2, 5, 80.0)]
SCHEMA = "TransactionID bigint, card1 bigint, TransactionDT bigint, TransactionAmt double"


@pytest.fixture(scope="module")
def ties(spark):
    return spark.createDataFrame(TIES, SCHEMA)


def by_id(df, column, key="TransactionID"):
    return {r[key]: r[column] for r in df.select(key, column).collect()}


def test_inclusive_counts_include_peers(ties):
    out = velocity.card_window_velocity(ties)
    counts = by_id(out, "card1_txn_count_1h")
    assert [counts[i] for i in range(1, 6)] == [1, 3, 3, 4, 4]
    assert counts[6] == counts[7] == 0
    assert by_id(out, "card1_amt_std_1h")[1] == 0


def test_strictly_earlier_rows_by_position(ties):
    out = velocity.user_window_velocity(ties, uid="card1", time="TransactionDT", unit=1)
    counts = by_id(out, "txn_count_1h")
    assert [counts[i] for i in range(1, 6)] == [0, 1, 2, 3, 3]
    assert by_id(out, "amt_std_1h")[3] == pytest.approx(5.0)
    assert by_id(out, "amt_max_1h")[5] == 40.0


def test_rows_without_an_entity_are_nobodys_peers(spark):
    df = spark.createDataFrame([(1, None, 5, 1.0), (2, None, 5, 2.0), (3, 4, 5, 3.0), (4, 4, 5, 4.0)], SCHEMA)
    out = velocity.user_window_velocity(df, uid="card1", time="TransactionDT", unit=1)
    assert by_id(out, "txn_count_1h") == {1: 0, 2: 0, 3: 0, 4: 1}


def test_windows_of_a_card_with_most_rows(spark, sf_dir):
    """Against plain windows, one task for the card."""
    df = transactions(spark, sf_dir).select("TransactionID", "card1", "t_us", "TransactionAmt")
    df = df.withColumn("card1", F.when(F.col("TransactionID") % 3 > 0, 1).otherwise(F.col("card1")))
    got = velocity.online_velocity_counts(df, ["card1"])
    hour = 3600 * velocity.MICROS
    frame = Window.partitionBy("card1").orderBy("t_us").rangeBetween(-hour, -1)
    plain = df.select("*", F.count("TransactionAmt").over(frame).alias("n"),
                      F.coalesce(F.sum("TransactionAmt").over(frame), F.lit(0.0)).alias("s"))
    want = {r["TransactionID"]: (r["n"], r["s"]) for r in plain.collect()}
    assert {r["TransactionID"]: (r["txn_count_1h"], r["amt_sum_1h"]) for r in got.collect()} == want


def test_distinct_mode_counts_values_once(spark):
    rows = [(1, 1, 0, 5.0), (2, 1, 10, 5.0), (3, 1, 10, 7.0), (4, 1, 20, 5.0),
            (5, 1, 3605, 9.0), (6, 1, 3625, 1.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = velocity.online_velocity_counts(
        df, ["card1"], time="TransactionDT", unit=1, distinct=True)
    sums, counts = by_id(out, "amt_sum_1h"), by_id(out, "txn_count_1h")
    for ident, _, t, _ in rows:
        seen = [(s, a) for _, _, s, a in rows if t - 3600 <= s < t]
        assert sums[ident] == sum({a for _, a in seen}), ident
        assert counts[ident] == len({s for s, _ in seen}), ident


def test_profile_of_a_card_with_all_rows(spark, sf_dir):
    df = transactions(spark, sf_dir).withColumn("card1", F.lit(7))
    cut = profile.profile_history(df, with_amounts=True)
    last = Window.partitionBy("card1").orderBy("t_us", "TransactionID").rowsBetween(-50, -1)
    plain = df.select("TransactionID", F.collect_list("TransactionAmt").over(last).alias("want"))
    both = cut.join(plain, "TransactionID")
    assert both.where(F.col("seen_amounts") != F.col("want")).isEmpty()
    assert both.count() == df.count()


def test_profile_of_rows_without_a_card_is_empty(spark, sf_dir):
    df = transactions(spark, sf_dir).withColumns({"card1": F.lit(None).cast("bigint"), "t_us": F.lit(5)})
    out = profile.profile_history(df)
    assert out.where("size(seen_emails) > 0 or seen_amount_n > 0").isEmpty() and out.count() == df.count()


def test_profile_null_takes_a_slot(spark):
    rows = [(i, 1, i, 1.0, None if i == 10 else i) for i in range(1, 13)]
    df = spark.createDataFrame(
        rows, "TransactionID bigint, card1 bigint, t_us bigint, TransactionAmt double, addr1 bigint"
    ).withColumns({c: F.lit("x") for c in ("DeviceInfo", "P_emaildomain", "card6")}
                  ).withColumn("addr2", F.lit(1))
    last = profile.profile_history(df).where("TransactionID = 12").first()
    assert last["seen_addr1"] == [2, 3, 4, 5, 6, 7, 8, 9, 11]


def test_exact_quantile_interpolates(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 4, 10)], "v double")
    assert ordering.exact_quantiles(df, "v", [0.5]) == [3.0]


def test_ranks_are_exact_with_tiny_bins(spark, sf_dir):
    df = transactions(spark, sf_dir)
    values = sorted(r[0] for r in df.select("TransactionAmt").collect())
    ranks = [0, 17, len(values) // 2, len(values) - 1]
    found = ordering.values_at_ranks(df, "TransactionAmt", ranks, bins=4, small=3)
    for r in ranks:
        value, below = found[r]
        assert value == values[r]
        assert below == sum(v < value for v in values)


def test_order_cut_splits_ties_by_id(spark):
    df = spark.createDataFrame([(i, 5) for i in range(10)], "TransactionID int, TransactionDT int")
    assert ordering.order_cuts(df, ("TransactionDT", "TransactionID"), [3])[3] == (5, 3)


def test_row_index_is_the_sorted_position(spark, sf_dir):
    df = transactions(spark, sf_dir).select("TransactionID", "TransactionAmt")
    out = ordering.with_row_index(df, ["TransactionAmt", "TransactionID"]).collect()
    ordered = sorted(out, key=lambda r: (r["TransactionAmt"], r["TransactionID"]))
    assert [r["row_index"] for r in ordered] == list(range(len(ordered)))


def test_window_boundaries_are_inclusive_below(spark):
    df = spark.createDataFrame([(1, 1, 0, 1.0), (2, 1, 3600, 1.0), (3, 1, 7201, 1.0)], SCHEMA)
    out = velocity.online_velocity_counts(df, ["card1"], time="TransactionDT", unit=1)
    counts = by_id(out, "txn_count_1h")
    assert (counts[2], counts[3]) == (1, 0)


def test_bucketed_deviation_matches_statistics(spark):
    rows = [(i, 1, i * 37 % 5000, float((i * 7919) % 1000) + 1e6) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = trailing.trailing_stats(
        df, key=["card1"], time="TransactionDT", value="TransactionAmt", widths={"w": 400},
        stats=("n", "std_samp"))
    got = {r["TransactionID"]: (r["n_w"], r["std_samp_w"]) for r in out.collect()}
    for ident, _, t, _ in rows:
        seen = [a for _, _, s, a in rows if t - 400 <= s < t]
        n, std = got[ident]
        assert n == len(seen)
        if n > 1:
            assert math.isclose(std, statistics.stdev(seen), rel_tol=1e-6, abs_tol=1e-6)
