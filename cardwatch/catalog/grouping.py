"""Per-entity statistics and category encodings."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardwatch.catalog.base import TXN_CTE, query, with_txn
from cardwatch.functions import columns as fx, fixed
from cardwatch.operators import clean, encode, groups, split
from cardwatch.sources.binding import TRANSACTION_RULES, transactions

_ID = "TransactionID"


def _rounded(df, digits=4, keep=(_ID,)):
    kinds = dict(df.dtypes)
    return df.select(*keep, *[
        (F.round(c, digits) if kinds[c] in ("double", "float") else F.col(c)).alias(c)
        for c in df.columns if c not in keep])


def _ratio(value, key):
    return (f"round({value} / (avg({value}) OVER w_{key} + 1e-5), 4)",
            f"round({value} / (stddev_samp({value}) OVER w_{key} + 1e-5), 4)")


def _ratio_sql(value, keys):
    cols, cases, windows = [], [], []
    for key in keys:
        mean, std = _ratio(value, key)
        cols += [f"CASE WHEN {key} IS NOT NULL THEN {mean} END AS {value}_to_mean_{key}",
                 f"CASE WHEN {key} IS NOT NULL THEN {std} END AS {value}_to_std_{key}"]
        windows.append(f"w_{key} AS (PARTITION BY {key})")
    return with_txn(f"SELECT TransactionID, {', '.join(cols)} FROM txn WINDOW "
                    + ", ".join(windows))


def _ratios(df, value, keys):
    out = df.select(_ID, value, *keys)
    for key in keys:
        out = groups.amount_ratios(out, key, value)
    return _rounded(out.drop(value, *keys))


@query("amount_ratio_by_card", _ratio_sql("TransactionAmt", ["card1"]))
def amount_ratio_by_card(spark, d):
    return _ratios(transactions(spark, d), "TransactionAmt", ["card1"])


@query("amount_ratio_by_network", _ratio_sql("TransactionAmt", ["card4"]))
def amount_ratio_by_network(spark, d):
    return _ratios(transactions(spark, d), "TransactionAmt", ["card4"])


@query("delta_ratio_by_group", _ratio_sql("D15", ["card1", "addr1"]))
def delta_ratio_by_group(spark, d):
    return _ratios(transactions(spark, d), "D15", ["card1", "addr1"])


@query("fit_amount_stats", with_txn("""
SELECT card1, round(avg(TransactionAmt), 4) AS mean_value,
  round(COALESCE(stddev_samp(TransactionAmt), 50), 4) AS std_value
FROM txn WHERE card1 IS NOT NULL GROUP BY card1"""))
def fit_amount_stats(spark, d):
    return _rounded(groups.fit_amount_stats(transactions(spark, d), "card1"), keep=("card1",))


_MCODE = {c: f"(CASE {c} WHEN 'T' THEN 1 WHEN 'F' THEN 0 WHEN 'M0' THEN 0 WHEN 'M1' THEN 1 "
             f"WHEN 'M2' THEN 2 ELSE -1 END)" for c in fixed.MATCH_COLUMNS}
_CENTS = "CAST((TransactionAmt - trunc(TransactionAmt)) * 1000 AS INT)"
_MONTH = ("CAST((year(TIMESTAMP '2017-11-30' + to_seconds(TransactionDT)) - 2017) * 12 + "
          "month(TIMESTAMP '2017-11-30' + to_seconds(TransactionDT)) AS INT)")
_BUID = ("concat_ws('_', COALESCE(CAST(card1 AS VARCHAR), 'nan'), COALESCE(CAST(addr1 AS VARCHAR)"
         ", 'nan'), CAST(COALESCE(CAST(floor(TransactionDT / 86400 - D1) AS BIGINT), -999) "
         "AS VARCHAR))")
_KEYED_CTE = f"""{TXN_CTE}, keyed AS (
  SELECT * REPLACE ({', '.join(f'{e} AS {c}' for c, e in _MCODE.items())}),
    {_BUID} AS magic_uid, {_CENTS} AS TransactionAmt_decimal, {_MONTH} AS DT_M FROM txn)"""


def _keyed(spark, d):
    txn = clean.encode_match_flags(transactions(spark, d))
    return txn.withColumns({
        "magic_uid": fx.behaviour_uid(txn.columns),
        "TransactionAmt_decimal": fx.amount_decimal(),
        "DT_M": fx.month_index(),
    })


def _buid_stats_sql():
    cols = ["round(avg(TransactionAmt) OVER w, 4) AS magic_uid_TransactionAmt_mean",
            "round(stddev_samp(TransactionAmt) OVER w, 4) AS magic_uid_TransactionAmt_std"]
    for c in ("D4", "D9", "D10", "D15"):
        cols += [f"round(COALESCE(avg({c}) OVER w, -1), 4) AS magic_uid_{c}_mean",
                 f"round(COALESCE(stddev_samp({c}) OVER w, -1), 4) AS magic_uid_{c}_std"]
    for c in [f"C{i}" for i in range(1, 15) if i != 3] + fixed.MATCH_COLUMNS:
        cols.append(f"round(COALESCE(avg({c}) OVER w, -1), 4) AS magic_uid_{c}_mean")
    cols.append("round(COALESCE(stddev_samp(C14) OVER w, -1), 4) AS magic_uid_C14_std")
    return (f"WITH {_KEYED_CTE} SELECT TransactionID, {', '.join(cols)} FROM keyed "
            "WINDOW w AS (PARTITION BY magic_uid)")


@query("behaviour_uid_stats", _buid_stats_sql())
def behaviour_uid_stats(spark, d):
    df = _keyed(spark, d)
    stats, fill = groups.behaviour_stats(df.columns)
    out = groups.attach_stats(df, "magic_uid", stats, fill)
    return _rounded(out.select(_ID, *stats))


@query("behaviour_uid_nunique", f"WITH {_KEYED_CTE} SELECT TransactionID, " + ", ".join(
    f"count(DISTINCT {c}) OVER w AS magic_uid_{n}_nunique"
    for n, c in groups.BEHAVIOUR_DISTINCT.items())
    + " FROM keyed WINDOW w AS (PARTITION BY magic_uid)")
def behaviour_uid_nunique(spark, d):
    df = _keyed(spark, d)
    counted = groups.behaviour_distinct(df.columns)
    return groups.attach_distinct(df, "magic_uid", counted).select(_ID, *counted)


@query("behaviour_uid_freq", f"""WITH {_KEYED_CTE}
SELECT TransactionID, round(count(*) OVER (PARTITION BY magic_uid) * 1.0e0 / count(*) OVER (), 8)
  AS magic_uid_freq FROM keyed""")
def behaviour_uid_freq(spark, d):
    return _rounded(groups.key_share(_keyed(spark, d), "magic_uid", "magic_uid_freq").select(
        _ID, "magic_uid_freq"), 8)


def _part(c):
    return f"COALESCE(CAST(CAST({c} AS BIGINT) AS VARCHAR), '-999')"


@query("uid_aggregates", f"WITH {_KEYED_CTE} SELECT TransactionID, "
       "round(avg(TransactionAmt) OVER w, 4) AS TransactionAmt_uid_mean, "
       "round(stddev_samp(TransactionAmt) OVER w, 4) AS TransactionAmt_uid_std, " + ", ".join(
           f"round(avg({c}) OVER w, 4) AS {c}_uid_mean" for c in groups.UID_MEANS)
       + f" FROM keyed WINDOW w AS (PARTITION BY {_part('card1')}, {_part('D1')}, "
       f"{_part('addr1')})")
def uid_aggregates(spark, d):
    out = groups.uid_aggregates(_keyed(spark, d))
    return _rounded(out.select(_ID, *[c for c in out.columns if "_uid_m" in c or "_uid_s" in c
                                      if not c.startswith("magic")]))


@query("uid2_aggregates", f"WITH {_KEYED_CTE} SELECT TransactionID, " + ", ".join(
    f"round(avg({c}) OVER w, 4) AS {c}_uid2_mean, round(stddev_samp({c}) OVER w, 4) AS "
    f"{c}_uid2_std" for c in ("M4", "M1", "M7", "M8"))
    + f" FROM keyed WINDOW w AS (PARTITION BY {_part('card1')}, {_part('addr1')})")
def uid2_aggregates(spark, d):
    out = groups.uid2_aggregates(_keyed(spark, d))
    return _rounded(out.select(_ID, *[c for c in out.columns if "_uid2_" in c]))


def _wide_sql():
    cols = ["round(avg(TransactionAmt), 4) AS uid_TransactionAmt_mean",
            "round(stddev_samp(TransactionAmt), 4) AS uid_TransactionAmt_std",
            "min(TransactionAmt) AS uid_TransactionAmt_min",
            "max(TransactionAmt) AS uid_TransactionAmt_max"]
    for c in [f"C{i}" for i in range(1, 15)] + ["D1", "D2", "D3", "D4", "D5", "D10", "D11",
                                                "D15"]:
        cols += [f"round(avg({c}), 4) AS uid_{c}_mean",
                 f"round(stddev_samp({c}), 4) AS uid_{c}_std"]
    cols += [f"count(DISTINCT {c}) AS uid_{c}_nunique" for c in ("M1", "M2", "M3")]
    return f"WITH {_KEYED_CTE} SELECT magic_uid, {', '.join(cols)} FROM keyed GROUP BY magic_uid"


@query("uid_profile_wide", _wide_sql())
def uid_profile_wide(spark, d):
    return _rounded(groups.uid_profile_wide(_keyed(spark, d)), keep=("magic_uid",))


@query("join_group_stats", with_txn("""
SELECT t.TransactionID, s.n, round(s.mean_amt, 4) AS mean_amt, round(s.std_amt, 4) AS std_amt,
  s.max_amt FROM txn t LEFT JOIN (
    SELECT addr1, count(*) AS n, avg(TransactionAmt) AS mean_amt,
      stddev_samp(TransactionAmt) AS std_amt, max(TransactionAmt) AS max_amt
    FROM txn WHERE addr1 IS NOT NULL GROUP BY addr1) s ON t.addr1 = s.addr1"""))
def join_group_stats(spark, d):
    df = transactions(spark, d)
    per_key = df.where("addr1 IS NOT NULL").groupBy("addr1").agg(
        F.count(F.lit(1)).alias("n"), F.avg("TransactionAmt").alias("mean_amt"),
        F.stddev_samp("TransactionAmt").alias("std_amt"),
        F.max("TransactionAmt").alias("max_amt"))
    return _rounded(groups.join_stats(df.select(_ID, "addr1"), per_key, "addr1").drop("addr1"))


_GROUPS = {
    "card1": "CAST(card1 AS VARCHAR)",
    "card1_addr1": "concat_ws('_', COALESCE(CAST(card1 AS VARCHAR), 'nan'), "
                   "COALESCE(CAST(addr1 AS VARCHAR), 'nan'))",
    "card1_addr1_P_emaildomain": "concat_ws('_', COALESCE(CAST(card1 AS VARCHAR), 'nan'), "
                                 "COALESCE(CAST(addr1 AS VARCHAR), 'nan'), "
                                 "COALESCE(P_emaildomain, 'na'))",
}


def _group_sql():
    cols = []
    for g, key in _GROUPS.items():
        for v in ("TransactionAmt", "D9", "D11"):
            for stat, fn in (("mean", "avg"), ("std", "stddev_samp")):
                cols.append(f"round(COALESCE({fn}({v}) OVER (PARTITION BY {key}), -1), 4)"
                            f" AS {v}_{g}_{stat}")
    return with_txn(f"SELECT TransactionID, {', '.join(cols)} FROM txn")


@query("group_mean_std", _group_sql())
def group_mean_std(spark, d):
    df = transactions(spark, d)
    base = fx.composite_key(["card1", "addr1"])
    keys = {
        "card1": F.col("card1").cast("string"),
        "card1_addr1": base,
        "card1_addr1_P_emaildomain": F.concat_ws(
            "_", base, fx.key_part("P_emaildomain", "na")),
    }
    out = groups.group_mean_std(df, keys, ["TransactionAmt", "D9", "D11"])
    return _rounded(out.select(_ID, *[c for c in out.columns
                                      if "_card1" in c and not c.startswith("magic")]))


_V = [c for c in TRANSACTION_RULES if c[0] == "V"]


def _row_mean(exprs):
    total = " + ".join(f"COALESCE({e}, 0)" for e in exprs)
    n = " + ".join(f"CASE WHEN {e} IS NULL THEN 0 ELSE 1 END" for e in exprs)
    return f"({total}) / NULLIF({n}, 0)"


def _opaque_sql():
    ctes, joins, cols = [], [], []
    for key, label, stats in (("card1", "card1", ("avg", "stddev_samp", "max", "min")),
                              ("addr1", "addr1", ("avg", "stddev_samp")),
                              ("DeviceInfo", "device", ("avg",))):
        names = {"avg": "mean", "stddev_samp": "std", "max": "max", "min": "min"}
        inner = ", ".join(f"{s}({v}) AS {s}_{v}" for s in stats for v in _V)
        outer = ", ".join(f"{_row_mean([f'{s}_{v}' for v in _V])} AS v_{label}_{names[s]}"
                          for s in stats)
        ctes.append(f"g_{label} AS (SELECT {key}, {outer} FROM (SELECT {key}, {inner} FROM txn "
                    f"WHERE {key} IS NOT NULL GROUP BY {key}))")
        joins.append(f"LEFT JOIN g_{label} ON txn.{key} = g_{label}.{key}")
        cols += [f"round(v_{label}_{names[s]}, 4) AS v_{label}_{names[s]}" for s in stats]
    return (f"WITH {TXN_CTE}, {', '.join(ctes)} SELECT TransactionID, {', '.join(cols)} FROM txn "
            + " ".join(joins))


@query("opaque_group_stats", _opaque_sql())
def opaque_group_stats(spark, d):
    out = groups.opaque_group_stats(
        transactions(spark, d).select(_ID, "card1", "addr1", "DeviceInfo", *_V), _V)
    return _rounded(out.select(_ID, *[c for c in out.columns if c.startswith("v_")]))


@query("opaque_row_stats", with_txn(
    "SELECT TransactionID, " + " + ".join(f"(CASE WHEN {v} IS NULL THEN 1 ELSE 0 END)" for v in _V)
    + " AS v_null_count, round((" + " + ".join(
        f"(CASE WHEN {v} IS NULL THEN 1 ELSE 0 END)" for v in _V)
    + f") / {len(_V)}, 6) AS v_null_ratio, greatest({', '.join(_V)}) - least({', '.join(_V)})"
    " AS v_range FROM txn"))
def opaque_row_stats(spark, d):
    out = transactions(spark, d).select(_ID, *[
        c.alias(n) for n, c in groups.opaque_row_stats(_V).items()])
    return _rounded(out, 6)


@query("network_counts", with_txn("""
SELECT *, CASE WHEN card1_product_count = 1 THEN 1 ELSE 0 END AS card1_single_product,
  card1_multiple_addr + addr1_multiple_cards + card1_multiple_devices + email_multiple_cards
    AS network_risk_score
FROM (SELECT *, CASE WHEN card1_addr1_count > 1 THEN 1 ELSE 0 END AS card1_multiple_addr,
    CASE WHEN addr1_card1_count > 3 THEN 1 ELSE 0 END AS addr1_multiple_cards,
    CASE WHEN card1_device_count > 1 THEN 1 ELSE 0 END AS card1_multiple_devices,
    CASE WHEN email_card1_count > 2 THEN 1 ELSE 0 END AS email_multiple_cards
  FROM (SELECT TransactionID,
    count(DISTINCT addr1) OVER (PARTITION BY card1) AS card1_addr1_count,
    count(DISTINCT DeviceInfo) OVER (PARTITION BY card1) AS card1_device_count,
    count(DISTINCT ProductCD) OVER (PARTITION BY card1) AS card1_product_count,
    CASE WHEN addr1 IS NULL THEN 0 ELSE count(DISTINCT card1) OVER (PARTITION BY addr1) END
      AS addr1_card1_count,
    CASE WHEN P_emaildomain IS NULL THEN 0
      ELSE count(DISTINCT card1) OVER (PARTITION BY P_emaildomain) END AS email_card1_count
    FROM txn))"""))
def network_counts(spark, d):
    df = transactions(spark, d).select(
        _ID, "card1", "addr1", "DeviceInfo", "P_emaildomain", "ProductCD")
    return groups.network_counts(df).drop(
        "card1", "addr1", "DeviceInfo", "P_emaildomain", "ProductCD")


def _count_key(parts):
    if len(parts) == 1:
        return parts[0]
    return "concat_ws('_', " + ", ".join(
        f"COALESCE(CAST({p} AS VARCHAR), '{'nan' if i == 0 else 'na'}')"
        for i, p in enumerate(parts)) + ")"


@query("frequency_count_encode", with_txn("SELECT TransactionID, " + ", ".join(
    f"CASE WHEN {_count_key(p)} IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY "
    f"{_count_key(p)}) END AS {n}" for n, p in encode.COUNT_KEYS.items()) + " FROM txn"))
def frequency_count_encode(spark, d):
    df = transactions(spark, d)
    return encode.frequency_count_encode(df).select(_ID, *encode.COUNT_KEYS)


_RANKED_CTE = f"""{TXN_CTE}, ranked AS (
  SELECT *, row_number() OVER (ORDER BY TransactionDT, TransactionID) AS rn,
    count(*) OVER () AS n FROM txn
), train AS (SELECT * FROM ranked WHERE rn <= floor(n * 0.8))"""
_SHARE = ["ProductCD", "card1", "card4", "addr1", "P_emaildomain"]


@query("frequency_share_encode", f"WITH {_RANKED_CTE} SELECT TransactionID, card1, addr1, "
       + ", ".join(f"round(COALESCE((SELECT count(*) FROM train t WHERE t.{c} IS NOT DISTINCT "
                   f"FROM x.{c}) / (SELECT count(*) FROM train), 0), 8) AS {c}_freq"
                   for c in _SHARE) + " FROM txn x")
def frequency_share_encode(spark, d):
    df = transactions(spark, d)
    train, _ = split.chronological_split(df)
    shares = encode.fit_shares(train, _SHARE)
    return _rounded(encode.apply_shares(df.select(_ID, *_SHARE), shares, _SHARE), 8)


@query("lookup_fitted_map", f"""WITH {_RANKED_CTE}, fit AS (
  SELECT card1, avg(TransactionAmt) AS mean_value FROM train GROUP BY card1)
SELECT TransactionID, round(COALESCE(mean_value, -1), 4) AS mean_value
FROM txn LEFT JOIN fit ON txn.card1 = fit.card1""")
def lookup_fitted_map(spark, d):
    df = transactions(spark, d)
    train, _ = split.chronological_split(df)
    dim = groups.fit_amount_stats(train, "card1")
    return _rounded(encode.lookup_fitted_map(
        df.select(_ID, "card1"), dim, "card1", "mean_value", -1).drop("card1"))


_TARGET = ["P_emaildomain", "DeviceInfo", "card4", "id_31"]


def _target_sql():
    ctes, joins, cols = [], [], []
    for c in _TARGET:
        ctes.append(
            f"m_{c} AS (SELECT COALESCE({c}, 'missing') AS v, (sum(isFraud) + (SELECT g FROM r) "
            f"* 10) / (count(*) + 10) AS fr FROM train GROUP BY 1)")
        joins.append(f"LEFT JOIN m_{c} ON COALESCE(txn.{c}, 'missing') = m_{c}.v")
        cols.append(f"round(COALESCE(m_{c}.fr, (SELECT g FROM r)), 6) AS {c}_fraud_rate")
    return (f"WITH {_RANKED_CTE}, r AS (SELECT avg(isFraud) AS g FROM train), {', '.join(ctes)} "
            f"SELECT TransactionID, {', '.join(cols)} FROM txn {' '.join(joins)}")


@query("target_mean_encode", _target_sql())
def target_mean_encode(spark, d):
    df = transactions(spark, d)
    train, _ = split.chronological_split(df)
    rate = train.agg(F.avg("isFraud")).first()[0]
    means = encode.target_means(encode.fit_target_sums(train, _TARGET), rate)
    out = encode.apply_target(df.select(_ID, *_TARGET), means, _TARGET, rate)
    return _rounded(out.drop(*_TARGET), 6)


def _oof_sql():
    joins, cols, ctes = [], [], []
    for c in _TARGET:
        ctes.append(f"s_{c} AS (SELECT COALESCE({c}, 'missing') AS v, fold, sum(isFraud) AS p, "
                    "count(*) AS n FROM folds GROUP BY 1, 2)")
        ctes.append(f"o_{c} AS (SELECT a.v, a.fold, sum(b.p) AS p, sum(b.n) AS n FROM s_{c} a "
                    f"LEFT JOIN s_{c} b ON a.v = b.v AND a.fold <> b.fold GROUP BY 1, 2)")
        joins.append(f"LEFT JOIN o_{c} ON COALESCE(f.{c}, 'missing') = o_{c}.v "
                     f"AND f.fold = o_{c}.fold")
        cols.append(f"round(CASE WHEN o_{c}.n IS NULL THEN (SELECT g FROM r) ELSE (o_{c}.p + "
                    f"(SELECT g FROM r) * 10) / (o_{c}.n + 10) END, 6) AS {c}_fraud_rate")
    return (f"WITH {TXN_CTE}, folds AS (SELECT *, ntile(5) OVER (ORDER BY TransactionDT, "
            f"TransactionID) - 1 AS fold FROM txn), r AS (SELECT avg(isFraud) AS g FROM txn), "
            f"{', '.join(ctes)} SELECT TransactionID, CAST(f.fold AS INT) AS fold, "
            f"{', '.join(cols)} FROM folds f {' '.join(joins)}")


@query("target_mean_encode_oof", _oof_sql())
def target_mean_encode_oof(spark, d):
    df = transactions(spark, d)
    fold = encode.contiguous_folds(df)
    rate = df.agg(F.avg("isFraud")).first()[0]
    sums = encode.fit_target_sums(df, _TARGET, fold=fold)
    out = encode.apply_target_oof(
        df.select(_ID, fold.alias("fold"), *_TARGET), sums, _TARGET, rate)
    return _rounded(out.drop(*_TARGET), 6)


@query("label_encode", with_txn("SELECT TransactionID, " + ", ".join(
    f"dense_rank() OVER (ORDER BY COALESCE(CAST({c} AS VARCHAR), 'missing')) - 1 AS {c}"
    for c in ("ProductCD", "card1", "DeviceInfo")) + " FROM txn"))
def label_encode(spark, d):
    df = transactions(spark, d)
    cols = ["ProductCD", "card1", "DeviceInfo"]
    codes = {c: encode.fit_label_codes(df, c) for c in cols}
    return encode.label_encode(df.select(_ID, *cols), codes)


@query("fraud_rate", with_txn("""
SELECT count(*) AS n, sum(isFraud) AS positives, round(avg(isFraud), 6) AS fraud_rate,
  round(avg(TransactionAmt), 4) AS amt_mean, round(stddev_samp(TransactionAmt), 4) AS amt_std,
  min(TransactionAmt) AS amt_min, max(TransactionAmt) AS amt_max FROM txn"""))
def fraud_rate(spark, d):
    return transactions(spark, d).agg(
        F.count(F.lit(1)).alias("n"), F.sum("isFraud").alias("positives"),
        F.round(F.avg("isFraud"), 6).alias("fraud_rate"),
        F.round(F.avg("TransactionAmt"), 4).alias("amt_mean"),
        F.round(F.stddev_samp("TransactionAmt"), 4).alias("amt_std"),
        F.min("TransactionAmt").alias("amt_min"), F.max("TransactionAmt").alias("amt_max"))


# ---- splits -------------------------------------------------------------------
@query("sort_by_time", with_txn(
    "SELECT TransactionID, TransactionDT FROM txn ORDER BY TransactionDT, TransactionID"))
def sort_by_time(spark, d):
    return split.sort_by_time(transactions(spark, d).select(_ID, "TransactionDT"))


@query("chronological_split", f"WITH {_RANKED_CTE} SELECT TransactionID, "
       "CASE WHEN rn <= floor(n * 0.8) THEN 'train' ELSE 'valid' END AS part FROM ranked")
def chronological_split(spark, d):
    df = transactions(spark, d).select(_ID, "TransactionDT")
    is_train = split.train_condition(df)
    return df.select(_ID, F.when(is_train, "train").otherwise("valid").alias("part"))


@query("quantile_time_split", with_txn("""
SELECT TransactionID, CASE WHEN TransactionDT <= (SELECT quantile_cont(TransactionDT, 0.8)
  FROM txn) THEN 'train' ELSE 'valid' END AS part FROM txn"""))
def quantile_time_split(spark, d):
    df = transactions(spark, d).select(_ID, "TransactionDT")
    train, valid = split.quantile_time_split(df)
    return train.withColumn("part", F.lit("train")).unionByName(
        valid.withColumn("part", F.lit("valid"))).drop("TransactionDT")


@query("stratified_split", with_txn("""
SELECT TransactionID, isFraud, CASE WHEN rk <= floor(n * 0.8) THEN 'train' ELSE 'valid' END
  AS part FROM (SELECT TransactionID, isFraud, count(*) OVER (PARTITION BY isFraud) AS n,
  row_number() OVER (PARTITION BY isFraud ORDER BY ((TransactionID % 2147483648 + 42) * 2654435761)
    % 4294967296, TransactionID) AS rk FROM txn)"""))
def stratified_split(spark, d):
    df = transactions(spark, d).select(_ID, "isFraud")
    train, valid = split.stratified_split(df, "isFraud", _ID)
    return train.withColumn("part", F.lit("train")).unionByName(
        valid.withColumn("part", F.lit("valid")))


# Rows without a time, and ids that are texts: both as the wire brings them.
_TEXT_ID = f"""WITH {TXN_CTE}, gaps AS (
  SELECT 'TXN_' || TransactionID AS TransactionID,
    CASE WHEN TransactionID % 5 <> 3 THEN TransactionDT END AS TransactionDT FROM txn)"""


def _gaps(spark, d):
    return transactions(spark, d).select(
        F.concat(F.lit("TXN_"), F.col(_ID).cast("string")).alias(_ID),
        F.when(F.col(_ID) % 5 != 3, F.col("TransactionDT")).alias("TransactionDT"))


@query("split_missing_time", f"""{_TEXT_ID}, ranked AS (SELECT *, count(*) OVER () AS n,
  row_number() OVER (ORDER BY TransactionDT NULLS LAST, TransactionID) AS rn FROM gaps)
SELECT TransactionID, CASE WHEN rn <= floor(n * 0.7) THEN 'train' ELSE 'valid' END AS by_rank,
  CASE WHEN rn <= floor(n * 0.9) THEN 'train' ELSE 'valid' END AS by_rank_late,
  CASE WHEN TransactionDT <= (SELECT quantile_cont(TransactionDT, 0.8) FROM gaps)
    THEN 'train' ELSE 'valid' END AS by_quantile FROM ranked""")
def split_missing_time(spark, d):
    """The second cut falls among the rows without a time."""
    df = _gaps(spark, d)
    named = lambda c: F.when(c, "train").otherwise("valid")
    marked = df.withColumns({"by_rank": named(split.train_condition(df, 0.7)),
                             "by_rank_late": named(split.train_condition(df, 0.9))})
    train, valid = split.quantile_time_split(marked)
    return train.withColumn("by_quantile", F.lit("train")).unionByName(
        valid.withColumn("by_quantile", F.lit("valid"))).drop("TransactionDT")


@query("stratified_split_many_classes", f"""{_TEXT_ID}, classed AS (SELECT TransactionID,
  CAST(substr(TransactionID, 5) AS BIGINT) // 7 AS class FROM gaps)
SELECT TransactionID, class, CASE WHEN rk <= floor(n * 0.8) THEN 'train' ELSE 'valid' END AS part
FROM (SELECT *, count(*) OVER (PARTITION BY class) AS n, row_number() OVER (PARTITION BY class
  ORDER BY ((CAST('0x' || substr(md5(TransactionID), 1, 7) AS BIGINT) + 42) * 2654435761)
    % 4294967296, TransactionID) AS rk FROM classed)""")
def stratified_split_many_classes(spark, d):
    number = F.substring(_ID, 5, 20).cast("bigint")
    df = _gaps(spark, d).select(_ID, F.floor(number / 7).alias("class"))
    train, valid = split.stratified_split(df, "class", _ID)
    return train.withColumn("part", F.lit("train")).unionByName(
        valid.withColumn("part", F.lit("valid")))
