"""Trailing-window queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardwatch.catalog.base import ORDERS_CTE, TXN_CTE, query, with_txn
from cardwatch.catalog.grouping import _rounded
from cardwatch.functions import columns as fx
from cardwatch.operators import velocity
from cardwatch.sources.binding import TRANSACTION_RULES, order_transactions, transactions

_ID = "TransactionID"
_H = 3600 * 1_000_000


def _frame(key, hours, end, time="t_us", unit=1_000_000):
    return (f"(PARTITION BY {key} ORDER BY {time} RANGE BETWEEN {hours * 3600 * unit} PRECEDING "
            f"AND {end})")


def _card_velocity_cte(src="txn", time="t_us", unit=1_000_000):
    cols, windows = [], []
    for w, h in velocity.CARD_WINDOWS.items():
        cols += [
            f"count(*) OVER w{w} AS card1_txn_count_{w}",
            f"sum(TransactionAmt) OVER w{w} AS card1_amt_sum_{w}",
            f"avg(TransactionAmt) OVER w{w} AS card1_amt_mean_{w}",
            f"COALESCE(stddev_samp(TransactionAmt) OVER w{w}, 0) AS card1_amt_std_{w}"]
        windows.append(f"w{w} AS " + _frame("card1", h, "CURRENT ROW", time, unit))
    return (f"vel AS (SELECT TransactionID, TransactionAmt, {', '.join(cols)} FROM {src} "
            f"WINDOW {', '.join(windows)})")


# Amounts here are exact in binary, so sums and means agree to the last bit in any
# order of addition; only deviations are rounded.
def _card_cols():
    return ", ".join(
        f"card1_txn_count_{w}, card1_amt_sum_{w}, card1_amt_mean_{w}, "
        f"round(card1_amt_std_{w}, 4) AS card1_amt_std_{w}" for w in velocity.CARD_WINDOWS)


def _round_std(df, digits=4):
    return df.withColumns({c: F.round(c, digits) for c in df.columns if "_std_" in c})


@query("card_window_velocity",
       f"WITH {TXN_CTE}, {_card_velocity_cte()} SELECT TransactionID, {_card_cols()} FROM vel")
def card_window_velocity(spark, d):
    df = transactions(spark, d).select(_ID, "card1", "t_us", "TransactionAmt")
    out = velocity.card_window_velocity(df, time="t_us", unit=velocity.MICROS)
    return _round_std(out.drop("card1", "t_us", "TransactionAmt"))


@query("card_window_velocity_ties",
       f"WITH {ORDERS_CTE}, {_card_velocity_cte('otxn', 'TransactionDT', 720)} "
       f"SELECT TransactionID, {_card_cols()} FROM vel")
def card_window_velocity_ties(spark, d):
    """Orders fall on whole days, so most cards have rows of equal time."""
    df = order_transactions(spark, d).select(_ID, "card1", "TransactionDT", "TransactionAmt")
    out = velocity.card_window_velocity(df, unit=720)
    return _round_std(out.drop("card1", "TransactionDT", "TransactionAmt"))


@query("velocity_ratios", f"""WITH {TXN_CTE}, {_card_velocity_cte()}
SELECT TransactionID, round(card1_txn_count_3h / (card1_txn_count_1h + 1), 6)
    AS velocity_ratio_3h_1h,
  round(card1_txn_count_24h / (card1_txn_count_3h + 1), 6) AS velocity_ratio_24h_3h FROM vel""")
def velocity_ratios(spark, d):
    df = transactions(spark, d).select(_ID, "card1", "t_us", "TransactionAmt")
    out = velocity.card_window_velocity(df, time="t_us", unit=velocity.MICROS)
    return _rounded(out.select(_ID, *[c.alias(n) for n, c in velocity.velocity_ratios().items()]),
                    6)


@query("amount_spike", f"""WITH {TXN_CTE}, {_card_velocity_cte()}
SELECT TransactionID, round(TransactionAmt / (card1_amt_mean_1h + 1) - 1, 5) AS amt_spike_1h,
  round(TransactionAmt / (card1_amt_mean_24h + 1) - 1, 5) AS amt_spike_24h FROM vel""")
def amount_spike(spark, d):
    df = transactions(spark, d).select(_ID, "card1", "t_us", "TransactionAmt")
    out = velocity.card_window_velocity(df, time="t_us", unit=velocity.MICROS)
    return _rounded(out.select(_ID, *[c.alias(n) for n, c in velocity.amount_spike().items()]), 5)


_UID = "concat_ws('-', CAST(card1 AS VARCHAR), COALESCE(CAST(addr1 AS VARCHAR), 'na'))"


def _user_cte():
    cols, windows = [], []
    for w, h in velocity.USER_WINDOWS.items():
        cols += [f"count(*) OVER w{w} AS txn_count_{w}",
                 f"COALESCE(sum(TransactionAmt) OVER w{w}, 0) AS amt_sum_{w}",
                 f"COALESCE(avg(TransactionAmt) OVER w{w}, 0) AS amt_mean_{w}",
                 f"COALESCE(stddev_pop(TransactionAmt) OVER w{w}, 0) AS amt_std_{w}",
                 f"COALESCE(max(TransactionAmt) OVER w{w}, 0) AS amt_max_{w}"]
        windows.append(f"w{w} AS " + _frame("uid", h, "1 PRECEDING"))
    return (f"u AS (SELECT *, {_UID} AS uid FROM txn), uv AS (SELECT TransactionID, "
            f"TransactionAmt, {', '.join(cols)} FROM u WINDOW {', '.join(windows)})")


def _user_velocity(spark, d):
    df = transactions(spark, d).select(
        _ID, "t_us", "TransactionAmt",
        fx.composite_key(["card1", "addr1"], "-", "na").alias("uid"))
    return velocity.user_window_velocity(df)


@query("user_window_velocity", f"WITH {TXN_CTE}, {_user_cte()} SELECT TransactionID, " + ", ".join(
    f"txn_count_{w}, amt_max_{w}, amt_sum_{w}, amt_mean_{w}, round(amt_std_{w}, 4) AS amt_std_{w}"
    for w in velocity.USER_WINDOWS) + " FROM uv")
def user_window_velocity(spark, d):
    return _round_std(_user_velocity(spark, d).drop("t_us", "TransactionAmt", "uid"))


# Same-day orders of one customer, told apart by order key only.
_TIES = {"1h": 3600 * 24, "6h": 6 * 3600 * 24, "24h": 86400 * 24, "7d": 7 * 86400 * 24}


@query("user_window_velocity_ties", f"WITH {ORDERS_CTE} SELECT o.TransactionID, " + ", ".join(
    f"count(CASE WHEN e.TransactionDT >= o.TransactionDT - {s} THEN 1 END) AS txn_count_{w}, "
    f"COALESCE(sum(CASE WHEN e.TransactionDT >= o.TransactionDT - {s} THEN e.TransactionAmt "
    f"END), 0) AS amt_sum_{w}, round(COALESCE(stddev_pop(CASE WHEN e.TransactionDT >= "
    f"o.TransactionDT - {s} THEN e.TransactionAmt END), 0), 4) AS amt_std_{w}"
    for w, s in _TIES.items()) + """ FROM otxn o LEFT JOIN otxn e ON e.card1 = o.card1
  AND (e.TransactionDT < o.TransactionDT
    OR (e.TransactionDT = o.TransactionDT AND e.TransactionID < o.TransactionID))
GROUP BY o.TransactionID""")
def user_window_velocity_ties(spark, d):
    df = order_transactions(spark, d).select(_ID, "card1", "TransactionDT", "TransactionAmt")
    out = velocity.user_window_velocity(df, uid="card1", time="TransactionDT", unit=24)
    keep = [f"{p}_{w}" for w in _TIES for p in ("txn_count", "amt_sum", "amt_std")]
    return _round_std(out.select(_ID, *keep))


def _clip(e, top="1e0"):
    return f"greatest(0e0, least({top}, {e}))"


_SPIKE = {w: f"CASE WHEN amt_mean_{w} > 0 THEN {_clip(f'TransactionAmt / amt_mean_{w}', '10e0')} "
             "/ 10 ELSE 0 END" for w in ("1h", "6h", "24h")}


@query("velocity_risk_score", f"""WITH {TXN_CTE}, {_user_cte()}, parts AS (
  SELECT TransactionID, {_clip('txn_count_1h / 10')} AS freq_risk_1h,
    {_clip('txn_count_24h / 50')} AS freq_risk_24h, {_clip('amt_sum_24h / 10000')} AS amt_risk_24h,
    {', '.join(f'{e} AS amt_spike_{w}' for w, e in _SPIKE.items())} FROM uv)
SELECT *, {_clip('0.3e0 * freq_risk_1h + 0.2e0 * freq_risk_24h + 0.2e0 * amt_risk_24h + '
                '0.15e0 * amt_spike_1h + 0.15e0 * amt_spike_24h')} AS velocity_risk_score
FROM parts""")
def velocity_risk_score(spark, d):
    made = velocity.velocity_risk_score()
    return _user_velocity(spark, d).select(_ID, *[c.alias(n) for n, c in made.items()])


# API identity: the card plus a card/address/e-mail uid.
_API_UID = ("concat_ws('_', CAST(card1 AS VARCHAR), COALESCE(CAST(addr1 AS VARCHAR), 'na'), "
            "COALESCE(P_emaildomain, 'na'))")


def online_cte(key="card1"):
    windows = ", ".join(f"w{w} AS " + _frame(key, h, "1 PRECEDING")
                        for w, h in velocity.USER_WINDOWS.items())
    counts = ", ".join(f"count(TransactionAmt) OVER w{w} AS txn_count_{w}"
                       for w in velocity.USER_WINDOWS)
    return f"""ov AS (SELECT *, {counts},
    COALESCE(sum(TransactionAmt) OVER w1h, 0) AS amt_sum_1h,
    COALESCE(sum(TransactionAmt) OVER w24h, 0) AS amt_sum_24h,
    COALESCE(avg(TransactionAmt) OVER w24h, 0) AS amt_mean_24h
  FROM (SELECT *, {_API_UID} AS uid FROM txn) WINDOW {windows})"""


_ONLINE_COLS = (", ".join(f"txn_count_{w}" for w in velocity.USER_WINDOWS)
                + ", amt_sum_1h, amt_sum_24h, amt_mean_24h")


@query("online_velocity_counts",
       f"WITH {TXN_CTE}, {online_cte()} SELECT TransactionID, {_ONLINE_COLS} FROM ov")
def online_velocity_counts(spark, d):
    df = transactions(spark, d).select(_ID, "card1", "t_us", "TransactionAmt")
    return velocity.online_velocity_counts(df, ["card1"]).drop(
        "card1", "t_us", "TransactionAmt")


_HOT_CARD = TXN_CTE.replace(f"{TRANSACTION_RULES['card1']} AS card1",
                            "CASE WHEN event_id % 5 > 0 THEN 1 ELSE user_id END AS card1", 1)


@query("online_velocity_counts_hot_card",
       f"WITH {_HOT_CARD}, {online_cte()} SELECT TransactionID, {_ONLINE_COLS} FROM ov")
def online_velocity_counts_hot_card(spark, d):
    """One card holds four fifths of the rows."""
    df = transactions(spark, d).select(
        _ID, F.when(F.col(_ID) % 5 > 0, 1).otherwise(F.col("card1")).alias("card1"), "t_us",
        "TransactionAmt")
    return velocity.online_velocity_counts(df, ["card1"]).drop(
        "card1", "t_us", "TransactionAmt")


@query("online_velocity_counts_by_user",
       f"WITH {TXN_CTE}, {online_cte('card1, uid')} SELECT TransactionID, {_ONLINE_COLS} FROM ov")
def online_velocity_counts_by_user(spark, d):
    uid = fx.composite_key(["card1", "addr1", "P_emaildomain"], "_", "na")
    df = transactions(spark, d).select(_ID, "card1", uid.alias("uid"), "t_us", "TransactionAmt")
    return velocity.online_velocity_counts(df, ["card1", "uid"]).drop(
        "card1", "uid", "t_us", "TransactionAmt")


@query("online_velocity_counts_distinct", f"""WITH {ORDERS_CTE}, o AS (
  SELECT TransactionID, card1, TransactionDT AS t, floor(TransactionAmt / 100000) AS v FROM otxn)
SELECT o.TransactionID,
  count(DISTINCT CASE WHEN e.t >= o.t - 86400 THEN e.t END) AS txn_count_1h,
  count(DISTINCT CASE WHEN e.t >= o.t - 6 * 86400 THEN e.t END) AS txn_count_6h,
  count(DISTINCT CASE WHEN e.t >= o.t - 24 * 86400 THEN e.t END) AS txn_count_24h,
  count(DISTINCT CASE WHEN e.t >= o.t - 168 * 86400 THEN e.t END) AS txn_count_7d,
  COALESCE(sum(DISTINCT CASE WHEN e.t >= o.t - 86400 THEN e.v END), 0) AS amt_sum_1h,
  COALESCE(sum(DISTINCT CASE WHEN e.t >= o.t - 24 * 86400 THEN e.v END), 0) AS amt_sum_24h,
  round(COALESCE(sum(DISTINCT CASE WHEN e.t >= o.t - 24 * 86400 THEN e.v END)
    / count(DISTINCT CASE WHEN e.t >= o.t - 24 * 86400 THEN e.v END), 0), 6) AS amt_mean_24h
FROM o LEFT JOIN o e ON e.card1 = o.card1 AND e.t < o.t AND e.t >= o.t - 168 * 86400
GROUP BY o.TransactionID""")
def online_velocity_counts_distinct(spark, d):
    """Coarse order amounts repeat often, so distinct sums differ from plain ones."""
    df = order_transactions(spark, d).select(
        _ID, "card1", "TransactionDT",
        F.floor(F.col("TransactionAmt") / 100000).cast("double").alias("v"))
    out = velocity.online_velocity_counts(
        df, ["card1"], time="TransactionDT", amount="v", unit=24, distinct=True)
    return _rounded(out.drop("card1", "TransactionDT", "v"), 6)


_NOW = "(SELECT max(t_us) FROM txn)"


@query("velocity_stats", with_txn("SELECT card1, " + ", ".join(
    f"count(CASE WHEN t_us >= {_NOW} - {h * _H} THEN 1 END) AS txn_count_{w}"
    for w, h in velocity.USER_WINDOWS.items()) + f""",
  COALESCE(sum(CASE WHEN t_us >= {_NOW} - {_H} THEN TransactionAmt END), 0) AS amt_sum_1h,
  COALESCE(sum(CASE WHEN t_us >= {_NOW} - {24 * _H} THEN TransactionAmt END), 0) AS amt_sum_24h,
  COALESCE(avg(CASE WHEN t_us >= {_NOW} - {24 * _H} THEN TransactionAmt END), 0)
    AS amt_mean_24h FROM txn GROUP BY card1"""))
def velocity_stats(spark, d):
    df = transactions(spark, d).select("card1", "t_us", "TransactionAmt")
    now = df.agg(F.max("t_us")).first()[0]
    return velocity.velocity_stats(df, ["card1"], now)
