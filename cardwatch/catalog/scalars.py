"""Row-wise feature expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardwatch.catalog.base import TXN_CTE, query, with_txn
from cardwatch.functions import columns as fx, fixed
from cardwatch.operators import groups
from cardwatch.sources.binding import transactions


def _in(values):
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _flag(cond):
    return f"CASE WHEN {cond} THEN 1 ELSE 0 END"


@query("composite_key", with_txn(
    "SELECT TransactionID, COALESCE(CAST(card1 AS VARCHAR), 'nan') || '_' || "
    "COALESCE(CAST(addr1 AS VARCHAR), 'nan') AS card1_addr1 FROM txn"))
def composite_key(spark, d):
    return transactions(spark, d).select(
        "TransactionID", fx.composite_key(["card1", "addr1"]).alias("card1_addr1"))


@query("make_uid", with_txn(
    "SELECT TransactionID, concat_ws('-', COALESCE(CAST(card1 AS VARCHAR), 'na'), "
    "COALESCE(CAST(card2 AS VARCHAR), 'na'), COALESCE(CAST(addr1 AS VARCHAR), 'na'), "
    "COALESCE(P_emaildomain, 'na')) AS uid FROM txn"))
def make_uid(spark, d):
    txn = transactions(spark, d)
    parts = ["card1", "card2", "addr1", "P_emaildomain"]
    return txn.select("TransactionID", fx.make_uid(parts, txn.columns).alias("uid"))


_BUID = ("concat_ws('_', COALESCE(CAST(card1 AS VARCHAR), 'nan'), "
         "COALESCE(CAST(addr1 AS VARCHAR), 'nan'), CAST(COALESCE(CAST(floor(TransactionDT / "
         "86400 - D1) AS BIGINT), -999) AS VARCHAR))")


@query("behaviour_uid", with_txn(f"SELECT TransactionID, {_BUID} AS uid FROM txn"))
def behaviour_uid(spark, d):
    txn = transactions(spark, d)
    return txn.select("TransactionID", fx.behaviour_uid(txn.columns).alias("uid"))


@query("time_features", with_txn("""
SELECT TransactionID, dd AS dt_day, hh AS dt_hour, dd % 7 AS dt_wday,
  CASE WHEN dd % 7 >= 5 THEN 1 ELSE 0 END AS dt_is_weekend,
  CASE WHEN hh >= 22 OR hh <= 6 THEN 1 ELSE 0 END AS dt_is_night
FROM (SELECT TransactionID, CAST(TransactionDT // 86400 AS INT) AS dd,
  CAST((TransactionDT // 3600) % 24 AS INT) AS hh FROM txn)"""))
def time_features(spark, d):
    return transactions(spark, d).select(
        "TransactionID", *[c.alias(n) for n, c in fx.time_features().items()])


@query("time_flags", with_txn("""
SELECT TransactionID,
  CASE WHEN dd % 7 IN (5, 6) THEN 1 ELSE 0 END AS is_weekend,
  CASE WHEN hh IN (22, 23, 0, 1, 2, 3, 4, 5) THEN 1 ELSE 0 END AS is_night,
  CASE WHEN hh BETWEEN 9 AND 17 THEN 1 ELSE 0 END AS is_business_hours,
  dd % 31 + 1 AS day_of_month,
  CASE WHEN dd % 31 + 1 <= 5 THEN 1 ELSE 0 END AS is_month_start,
  CASE WHEN dd % 31 + 1 >= 25 THEN 1 ELSE 0 END AS is_month_end
FROM (SELECT TransactionID, CAST(TransactionDT // 86400 AS INT) AS dd,
  CAST((TransactionDT // 3600) % 24 AS INT) AS hh FROM txn)"""))
def time_flags(spark, d):
    return transactions(spark, d).select(
        "TransactionID", *[c.alias(n) for n, c in fx.time_flags().items()])


@query("month_index", with_txn("""
SELECT TransactionID, CAST((year(m) - 2017) * 12 + month(m) AS INT) AS DT_M
FROM (SELECT TransactionID, TIMESTAMP '2017-11-30' + to_seconds(TransactionDT) AS m FROM txn)"""))
def month_index(spark, d):
    return transactions(spark, d).select("TransactionID", fx.month_index().alias("DT_M"))


@query("amount_transforms", with_txn("""
SELECT TransactionID, round(ln(1 + COALESCE(TransactionAmt, 0)), 6) AS log_TransactionAmt,
  round(sqrt(COALESCE(TransactionAmt, 0)), 6) AS sqrt_TransactionAmt FROM txn"""))
def amount_transforms(spark, d):
    return transactions(spark, d).select("TransactionID", *[
        F.round(c, 6).alias(n) for n, c in fx.amount_transforms().items()])


@query("amount_decimal", with_txn("""
SELECT TransactionID, CAST((TransactionAmt - trunc(TransactionAmt)) * 1000 AS INT)
    AS TransactionAmt_decimal,
  TransactionAmt - trunc(TransactionAmt) AS fraction,
  CASE WHEN TransactionAmt <> trunc(TransactionAmt) THEN 1 ELSE 0 END AS amt_has_cents FROM txn"""))
def amount_decimal(spark, d):
    return transactions(spark, d).select(
        "TransactionID", fx.amount_decimal().alias("TransactionAmt_decimal"),
        fx.amount_fraction().alias("fraction"), fx.has_cents().alias("amt_has_cents"))


@query("outsider_flag", with_txn(
    "SELECT TransactionID, CASE WHEN abs(D1 - D15) > 3 THEN 1 ELSE 0 END AS outsider15 FROM txn"))
def outsider_flag(spark, d):
    return transactions(spark, d).select("TransactionID", fx.outsider().alias("outsider15"))


@query("normalize_deltas", with_txn(
    "SELECT TransactionID, " + ", ".join(
        f"{c} - TransactionDT / 86400 AS {c}_normalized"
        for c in ("D4", "D10", "D11", "D15")) + " FROM txn"))
def normalize_deltas(spark, d):
    return transactions(spark, d).select("TransactionID", *[
        fx.normalized_delta(c).alias(f"{c}_normalized")
        for c in ("D4", "D10", "D11", "D15")])


_COMPANY = "CASE " + " ".join(
    f"WHEN {{c}} IN {_in(domains)} THEN '{company}'"
    for company, domains in fixed.EMAIL_COMPANIES.items()) + " ELSE 'OTHER' END"
_P = "COALESCE(P_emaildomain, '')"


@query("email_flags", with_txn(f"""
SELECT TransactionID, {_flag('P_emaildomain = R_emaildomain')} AS email_match,
  {_flag('P_emaildomain IN ' + _in(fixed.RISKY_DOMAINS))} AS email_risky,
  {_flag('P_emaildomain IN ' + _in(fixed.GENERIC_DOMAINS))} AS email_is_generic,
  {_flag('P_emaildomain IN ' + _in(fixed.HIGH_RISK_DOMAINS))} AS is_high_risk_email,
  {_flag(f"regexp_matches(lower({_P}), '{fixed.DISPOSABLE_PATTERN}')")} AS is_disposable_email,
  {_flag(_COMPANY.format(c='P_emaildomain') + ' NOT IN ' + _in(fixed.FREE_COMPANIES))}
    AS email_is_corporate,
  {_flag(_COMPANY.format(c='P_emaildomain') + ' IN ' + _in(fixed.FREE_COMPANIES))}
    AS email_is_free,
  CAST(length({_P}) AS INT) AS email_domain_length,
  {_flag(f'length({_P}) <= 8')} AS email_is_short_domain FROM txn"""))
def email_flags(spark, d):
    return transactions(spark, d).select(
        "TransactionID", *[c.alias(n) for n, c in fx.email_flags().items()])


@query("lookup_constant_map", with_txn(
    f"SELECT TransactionID, {_COMPANY.format(c='P_emaildomain')} AS P_emaildomain_company, "
    f"{_COMPANY.format(c='R_emaildomain')} AS R_emaildomain_company FROM txn"))
def lookup_constant_map(spark, d):
    return transactions(spark, d).select(
        "TransactionID", *[fx.email_company(c).alias(f"{c}_company")
                           for c in ("P_emaildomain", "R_emaildomain")])


@query("member_of_list", with_txn(
    "SELECT TransactionID, P_emaildomain FROM txn WHERE P_emaildomain IN "
    + _in(fixed.RISKY_DOMAINS)))
def member_of_list(spark, d):
    risky = spark.createDataFrame([(x,) for x in fixed.RISKY_DOMAINS], "P_emaildomain string")
    return transactions(spark, d).select("TransactionID", "P_emaildomain").join(
        risky, "P_emaildomain", "left_semi")


def _suffix(c):
    last = f"split_part(COALESCE({c}, ''), '.', -1)"
    return f"CASE WHEN {last} IN {_in(fixed.US_SUFFIXES)} THEN 'us' ELSE {last} END"


@query("email_suffix", with_txn(
    f"SELECT TransactionID, {_suffix('P_emaildomain')} AS p_suffix, "
    f"{_suffix('R_emaildomain')} AS r_suffix FROM txn"))
def email_suffix(spark, d):
    return transactions(spark, d).select(
        "TransactionID", fx.email_suffix("P_emaildomain").alias("p_suffix"),
        fx.email_suffix("R_emaildomain").alias("r_suffix"))


_MAKER = "CASE " + " ".join(
    f"WHEN starts_with(raw, '{p}') THEN '{m}'" for p, m in reversed(fixed.DEVICE_PREFIXES)
) + f" WHEN raw IN {_in(fixed.SAMSUNG_CODES)} THEN 'SAMSUNG' " + " ".join(
    f"WHEN regexp_matches(lower(raw), '{p}') THEN '{m}'" for p, m in reversed(fixed.DEVICE_MAKERS)
) + " ELSE upper(raw) END"
_DEVICES_CTE = (f"{TXN_CTE}, dev AS (SELECT TransactionID, COALESCE(DeviceInfo, 'unknown') AS raw"
                " FROM txn)")


@query("device_corp", f"WITH {_DEVICES_CTE} SELECT TransactionID, {_MAKER} AS DeviceCorp FROM dev")
def device_corp(spark, d):
    return transactions(spark, d).select("TransactionID", fx.device_corp().alias("DeviceCorp"))


_MIXED = ("(SELECT TransactionID, CASE WHEN TransactionID % 3 = 0 AND raw <> 'unknown' THEN lower(raw) ELSE raw END"
          " AS raw FROM dev)")


@query("rare_category_other", f"""WITH {_DEVICES_CTE}, corp AS (
  SELECT TransactionID, {_MAKER.replace("upper(raw)", "raw")} AS corp FROM {_MIXED})
SELECT TransactionID, CASE WHEN count(*) OVER (PARTITION BY corp) < 1050 THEN 'OTHER'
  ELSE upper(corp) END AS DeviceCorp FROM corp""")
def rare_category_other(spark, d):
    """A third of the texts come in lower case: unlike spellings are counted apart."""
    text = F.when(F.col("TransactionID") % 3 == 0, F.lower("DeviceInfo")).otherwise(F.col("DeviceInfo"))
    txn = transactions(spark, d).withColumn("DeviceInfo", text)
    corp = txn.select("TransactionID", fx.device_corp(upper=False).alias("DeviceCorp"))
    return groups.rare_to_other(corp, "DeviceCorp", min_rows=1050).select(
        "TransactionID", "DeviceCorp")


@query("device_flags", f"WITH {_DEVICES_CTE} SELECT *, greatest(" + ", ".join(
    fixed.PREMIUM_DEVICES) + ") AS device_is_premium FROM (SELECT TransactionID, " + ", ".join(
    f"CASE WHEN regexp_matches(lower(raw), '{p}') THEN 1 ELSE 0 END AS {n}"
    for n, p in fixed.DEVICE_FLAGS.items()) + " FROM dev)")
def device_flags(spark, d):
    return transactions(spark, d).select(
        "TransactionID", *[c.alias(n) for n, c in fx.device_flags().items()])


@query("screen_features", with_txn(f"""
SELECT TransactionID, w AS screen_width, h AS screen_height, w * h AS screen_area,
  round(w / (h + 1), 6) AS screen_ratio,
  {_flag('r IN ' + _in(fixed.FAKE_SCREENS))} AS screen_is_fake,
  {_flag('r IN ' + _in(fixed.MODERN_SCREENS))} AS screen_is_modern,
  {_flag('w * h > 2000000')} AS screen_is_high_res
FROM (SELECT TransactionID, r, COALESCE(TRY_CAST(split_part(r, 'x', 1) AS BIGINT), 0) AS w,
  COALESCE(TRY_CAST(split_part(r, 'x', 2) AS BIGINT), 0) AS h
  FROM (SELECT TransactionID, COALESCE(id_33, '0x0') AS r FROM txn))"""))
def screen_features(spark, d):
    return transactions(spark, d).select("TransactionID", *[
        (F.round(c, 6) if n == "screen_ratio" else c).alias(n)
        for n, c in fx.screen_features().items()])


@query("distinct_products", with_txn(
    "SELECT DISTINCT ProductCD FROM txn WHERE ProductCD IS NOT NULL"))
def distinct_products(spark, d):
    return groups.distinct_values(transactions(spark, d), "ProductCD")


@query("interaction_features", with_txn(
    "SELECT TransactionID, " + ", ".join(
        f"TransactionAmt * {c} AS amt_x_{c.lower()}"
        for c in ("C1", "C2", "C6", "C13", "C14", "D1", "D2", "D10", "D15"))
    + ", CAST(card1 * addr1 AS BIGINT) AS card1_x_addr1, "
    "CAST(card2 * addr1 AS BIGINT) AS card2_x_addr1, "
    + ", ".join(f"CASE WHEN ProductCD = '{p}' THEN TransactionAmt ELSE 0 END AS amt_is_{p}"
                for p in "CHRSW")
    + ", TransactionAmt * ((TransactionDT // 3600) % 24) AS amt_x_hour FROM txn"))
def interaction_features(spark, d):
    txn = transactions(spark, d).withColumn("dt_hour", fx.hour_of_day())
    products = fx.one_hot_values(groups.distinct_values(txn, "ProductCD"))
    made = fx.interaction_features(txn.columns, products)
    return txn.select("TransactionID", *[c.alias(n) for n, c in made.items()])


@query("hash_interaction")
def hash_interaction(spark, d):
    return transactions(spark, d).select(
        "TransactionID",
        fx.hash_interaction("card1", "DeviceInfo").alias("card1_x_device"),
        fx.hash_interaction("card1", "P_emaildomain").alias("card1_x_email"))
