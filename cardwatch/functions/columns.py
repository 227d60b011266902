"""Column expressions: keys, time, amount, e-mail, device and screen features.

Every function returns Columns (or a name -> Column dict), so a caller adds any
number of features in one projection and the whole set stays in one codegen stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cardwatch.functions import fixed

DAY = 86400


def flag(condition: Column) -> Column:
    """1/0 with NULL counted as false."""
    return F.coalesce(condition, F.lit(False)).cast("int")


# ---- text and numeric cleaning ---------------------------------------------
def clean_text(c: str) -> Column:
    return F.lower(F.trim(F.col(c).cast("string")))


def to_number(c: str) -> Column:
    return F.expr(f"try_cast(`{c}` AS DOUBLE)")


def drop_sentinels(c: str) -> Column:
    return F.when(~F.col(c).isin(fixed.EMAIL_SENTINELS), F.col(c))


def match_code(c: str) -> Column:
    pairs = [F.lit(x) for kv in fixed.MATCH_CODES.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(c)), F.lit(-1))


def finite(c: Column) -> Column:
    """NULL for NaN and both infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def inf_to_null(c: Column) -> Column:
    return F.when(F.abs(c) != float("inf"), c)


# ---- keys -------------------------------------------------------------------
def key_part(c: str, missing: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(missing))


def composite_key(cols: list[str], sep: str = "_", missing: str = "nan") -> Column:
    return F.concat_ws(sep, *[key_part(c, missing) for c in cols])


def make_uid(columns: list[str], available: list[str]) -> Column:
    present = [c for c in columns if c in available]
    return composite_key(present, "-", "na") if present else F.lit("global")


def behaviour_uid(available: list[str]) -> Column:
    """card1_addr1 plus the day the card was first seen (day minus D1)."""
    base = composite_key(["card1", "addr1"])
    if "D1" not in available:
        return base
    first_day = F.floor(F.col("TransactionDT") / DAY - F.col("D1"))
    return F.concat_ws("_", base, F.coalesce(first_day, F.lit(-999)).cast("string"))


# ---- time -------------------------------------------------------------------
def day_number(dt: str = "TransactionDT") -> Column:
    return F.floor(F.col(dt) / DAY).cast("int")


def hour_of_day(dt: str = "TransactionDT") -> Column:
    return (F.floor(F.col(dt) / 3600) % 24).cast("int")


def time_features(dt: str = "TransactionDT") -> dict[str, Column]:
    day, hour = day_number(dt), hour_of_day(dt)
    return {
        "dt_day": day,
        "dt_hour": hour,
        "dt_wday": day % 7,
        "dt_is_weekend": (day % 7 >= 5).cast("int"),
        "dt_is_night": ((hour >= 22) | (hour <= 6)).cast("int"),
    }


def time_flags(dt: str = "TransactionDT") -> dict[str, Column]:
    day, hour = day_number(dt), hour_of_day(dt)
    month_day = day % 31 + 1
    return {
        "is_weekend": (day % 7).isin(5, 6).cast("int"),
        "is_night": is_night(hour).cast("int"),
        "is_business_hours": hour.between(9, 17).cast("int"),
        "day_of_month": month_day,
        "is_month_start": (month_day <= 5).cast("int"),
        "is_month_end": (month_day >= 25).cast("int"),
    }


def is_night(hour: Column) -> Column:
    """The decision engine's night: 22..5 (midnight counts)."""
    return (hour >= 22) | (hour <= 5)


def month_index(dt: str = "TransactionDT", epoch: str = "2017-11-30") -> Column:
    """Months since January 2017 of ``epoch`` + seconds, from date arithmetic only."""
    date = F.date_add(F.lit(epoch).cast("date"), day_number(dt))
    return (F.year(date) - 2017) * 12 + F.month(date)


def event_time(dt: str = "TransactionDT", epoch: str = "2017-11-30") -> Column:
    start = f"unix_timestamp(timestamp'{epoch} 00:00:00 UTC')"
    return F.expr(f"timestamp_seconds({start} + {dt})")


# ---- amount -----------------------------------------------------------------
def amount_transforms(amt: str = "TransactionAmt") -> dict[str, Column]:
    value = F.coalesce(F.col(amt), F.lit(0.0))
    return {"log_TransactionAmt": F.log1p(value), "sqrt_TransactionAmt": F.sqrt(value)}


def amount_decimal(amt: str = "TransactionAmt") -> Column:
    """Thousandths after the decimal point, as an integer."""
    whole = F.col(amt).cast("bigint")
    return F.round((F.col(amt) - whole) * 1000).cast("int")


def amount_fraction(amt: str = "TransactionAmt") -> Column:
    return F.col(amt) - F.col(amt).cast("bigint")


def has_cents(amt: str = "TransactionAmt") -> Column:
    return flag(F.col(amt) % 1 != 0)


def outsider() -> Column:
    return flag(F.abs(F.col("D1") - F.col("D15")) > 3)


def normalized_delta(c: str, dt: str = "TransactionDT") -> Column:
    return F.col(c) - F.col(dt) / DAY


# ---- e-mail -----------------------------------------------------------------
def email_company(c: str) -> Column:
    pairs = [
        F.lit(x)
        for company, domains in fixed.EMAIL_COMPANIES.items()
        for domain in domains
        for x in (domain, company)
    ]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(c)), F.lit("OTHER"))


def email_suffix(c: str) -> Column:
    last = F.element_at(F.split(F.coalesce(F.col(c), F.lit("")), r"\."), -1)
    return F.when(last.isin(fixed.US_SUFFIXES), F.lit("us")).otherwise(last)


def email_flags(p: str = "P_emaildomain", r: str = "R_emaildomain") -> dict[str, Column]:
    text = F.coalesce(F.col(p), F.lit(""))
    company = email_company(p)
    return {
        "email_match": flag(F.col(p) == F.col(r)),
        "email_risky": flag(F.col(p).isin(fixed.RISKY_DOMAINS)),
        "email_is_generic": flag(F.col(p).isin(fixed.GENERIC_DOMAINS)),
        "is_high_risk_email": flag(F.col(p).isin(fixed.HIGH_RISK_DOMAINS)),
        "is_disposable_email": text.rlike(f"(?i){fixed.DISPOSABLE_PATTERN}").cast("int"),
        "email_is_corporate": (~company.isin(fixed.FREE_COMPANIES)).cast("int"),
        "email_is_free": company.isin(fixed.FREE_COMPANIES).cast("int"),
        "email_domain_length": F.length(text),
        "email_is_short_domain": (F.length(text) <= 8).cast("int"),
    }


# ---- device and screen ------------------------------------------------------
def device_corp(c: str = "DeviceInfo", upper: bool = True) -> Column:
    """Maker group; later rules override earlier ones, so test them last to first.

    Rare makers are counted as written: pass ``upper=False`` to
    :func:`~cardwatch.operators.groups.rare_to_other`, which puts the rest in upper case.
    """
    raw = F.coalesce(F.col(c), F.lit("unknown"))
    low = F.lower(raw)
    rules = [(low.rlike(pattern), maker) for pattern, maker in fixed.DEVICE_MAKERS]
    rules.append((raw.isin(fixed.SAMSUNG_CODES), "SAMSUNG"))
    rules += [(raw.startswith(prefix), maker) for prefix, maker in fixed.DEVICE_PREFIXES]
    chosen = F.coalesce(*[F.when(hit, F.lit(maker)) for hit, maker in reversed(rules)], raw)
    return F.upper(chosen) if upper else chosen


def device_flags(c: str = "DeviceInfo") -> dict[str, Column]:
    low = F.lower(F.coalesce(F.col(c), F.lit("unknown")))
    out = {name: low.rlike(p).cast("int") for name, p in fixed.DEVICE_FLAGS.items()}
    out["device_is_premium"] = F.greatest(*[out[n] for n in fixed.PREMIUM_DEVICES])
    return out


def screen_features(c: str = "id_33") -> dict[str, Column]:
    text = F.coalesce(F.col(c), F.lit("0x0"))
    parts = F.split(text, "x")

    def side(i: int) -> Column:
        number = F.get(parts, F.lit(i)).try_cast("double").try_cast("bigint")
        return F.coalesce(number, F.lit(0))

    width, height = side(0), side(1)
    area = F.try_multiply(width, height)  # NULL beyond 64 bits
    return {
        "screen_width": width,
        "screen_height": height,
        "screen_area": area,
        "screen_ratio": width / (height + 1),
        "screen_is_fake": text.isin(fixed.FAKE_SCREENS).cast("int"),
        "screen_is_modern": text.isin(fixed.MODERN_SCREENS).cast("int"),
        "screen_is_high_res": (area > fixed.HIGH_RES_PIXELS).cast("int"),
    }


# ---- interactions -----------------------------------------------------------
#: Values of a column that may become columns of their own.
MOST_ONE_HOT = 1000


def one_hot_values(distinct: DataFrame, most: int = MOST_ONE_HOT) -> list:
    """The sorted values of a one-column table; more than ``most`` are an error, never a silent cut."""
    values = [r[0] for r in distinct.limit(most + 1).collect()]
    if len(values) > most:
        raise ValueError(f"more than {most} values to make columns of")
    return sorted(values)


def interaction_features(available: list[str], products: list[str]) -> dict[str, Column]:
    amt = F.col("TransactionAmt")
    out: dict[str, Column] = {}
    for c in ("C1", "C2", "C6", "C13", "C14", "D1", "D2", "D10", "D15"):
        if c in available:
            out[f"amt_x_{c.lower()}"] = amt * F.col(c)
    for card in ("card1", "card2"):
        if card in available and "addr1" in available:
            out[f"{card}_x_addr1"] = F.col(card) * F.col("addr1")
    for product in products:
        same = F.coalesce(F.col("ProductCD") == product, F.lit(False))
        out[f"amt_is_{product}"] = F.when(same, amt).otherwise(amt * 0)
    if "dt_hour" in available:
        out["amt_x_hour"] = amt * F.col("dt_hour")
    return out


def hash_interaction(number: str, text: str) -> Column:
    """number x stable text hash, folded into 2^31 so the product stays exact."""
    digest = F.pmod(F.xxhash64(F.coalesce(F.col(text), F.lit("unknown"))), F.lit(2**31))
    return F.col(number).cast("double") * digest
