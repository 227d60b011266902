"""Risk scores and decisions as column expressions.

The same expressions serve batch and stream: inputs are columns, settings are
literals, nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from cardwatch.config import Settings
from cardwatch.functions import columns as fx, fixed


def _bands(value: Column, *bands: tuple[float, float]) -> Column:
    """Points of the first band whose lower bound the value reaches, else 0."""
    out = F.lit(0.0)
    for bound, points in reversed(bands):
        out = F.when(value >= bound, F.lit(points)).otherwise(out)
    return out


def _capped(score: Column) -> Column:
    return F.least(F.lit(1.0), score)


def _points(condition: Column, points: float) -> Column:
    return F.when(condition, F.lit(points)).otherwise(F.lit(0.0))


def whole(amount: Column) -> Column:
    """Text of the nearest integer, ties to even."""
    return F.format_string("%.0f", F.bround(amount, 0))


def fixed_text(value: Column, digits: int) -> Column:
    """A non-negative number with ``digits`` decimals, rounded on its exact binary value.

    The fraction is taken as a whole number of 2^-60 steps, so the remainder is compared
    without error (bits below that step are cut); only true ties go to the even digit.
    """
    unit, scale = 2**60, 10**digits
    below = F.floor(value)
    steps = ((value - below) * float(unit)).cast("bigint").cast("decimal(19,0)")
    scaled = steps * F.lit(scale).cast("decimal(6,0)")
    rest = scaled % F.lit(unit).cast("decimal(19,0)")
    digit = ((scaled - rest) / F.lit(unit).cast("decimal(19,0)")).cast("bigint")
    half = F.lit(unit // 2).cast("decimal(19,0)")
    up = (rest > half) | ((rest == half) & (digit % 2 == 1))
    total = below * scale + digit + up.cast("int")
    return F.concat(
        F.floor(total / scale).cast("string"), F.lit("."),
        F.lpad((total % scale).cast("string"), digits, "0"))


def present(*items: Column) -> Column:
    """Array of the non-NULL items."""
    return F.array_compact(F.array(*items))


# ---- velocity and amount --------------------------------------------------------
def velocity_risk(cfg: Settings, n1h="txn_count_1h", n6h="txn_count_6h", n24h="txn_count_24h"):
    v = cfg.velocity
    return _capped(
        _bands(F.col(n1h), (10, 0.9), (v.high_1h_count, 0.7), (3, 0.3))
        + _bands(F.col(n6h), (30, 0.5), (v.high_6h_count, 0.3))
        + _bands(F.col(n24h), (50, 0.4), (v.high_24h_count, 0.2))
    )


def amount_risk(cfg: Settings, amount="TransactionAmt", mean="amt_mean_24h", total="amt_sum_24h"):
    v = cfg.velocity
    spike = F.when(F.col(mean) > 0, F.col(amount) / F.col(mean))
    return _capped(
        F.coalesce(
            _bands(spike, (v.amount_spike_5x, 0.8), (v.amount_spike_3x, 0.5), (2.0, 0.3)),
            F.lit(0.0))
        + _bands(F.col(total), (10000, 0.7), (5000, 0.4), (2000, 0.2))
        + _bands(F.col(amount), (5000, 0.5), (2000, 0.3))
    )


def velocity_factors(cfg: Settings, amount="TransactionAmt", mean="amt_mean_24h") -> Column:
    v = cfg.velocity
    amt = F.col(amount)
    spike = F.when(F.col(mean) > 0, amt / F.col(mean))

    def busy(window: str, bound: int) -> Column:
        n = F.col(f"txn_count_{window}")
        return F.when(n >= bound, F.format_string(f"high_{window}_txn_count_%d", n))

    return present(
        busy("1h", v.high_1h_count),
        busy("6h", v.high_6h_count),
        busy("24h", v.high_24h_count),
        F.when(spike >= v.amount_spike_5x,
               F.concat(F.lit("amount_spike_5x_"), fixed_text(spike, 1), F.lit("x")))
        .when(spike >= v.amount_spike_3x,
              F.concat(F.lit("amount_spike_3x_"), fixed_text(spike, 1), F.lit("x"))),
        F.when(amt >= 5000, F.concat(F.lit("high_amount_"), whole(amt))),
    )


# ---- account takeover -------------------------------------------------------------
def _unseen(value: Column, history: Column) -> Column:
    """A value the non-empty history does not hold."""
    return F.coalesce((F.size(history) > 0) & ~F.array_contains(history, value), F.lit(False))


def ato_geo(cfg: Settings, addr1="addr1", addr2="addr2", dist="dist1") -> Column:
    d = F.col(dist)
    return _capped(
        _points(_unseen(F.col(addr1), F.col("seen_addr1")), 0.5)
        + _points(_unseen(F.col(addr2), F.col("seen_addr2")), 0.3)
        + F.when(d > cfg.ato.geo_anomaly_distance, 0.7).when(d > 500, 0.4).otherwise(0.0)
    )


def ato_device(device="DeviceInfo") -> Column:
    value = F.col(device)
    odd = F.coalesce(F.lower(value).rlike(fixed.PROFILE_DEVICE_PATTERN), F.lit(False))
    return _capped(
        _points(_unseen(value, F.col("seen_devices")), 0.6) + _points(odd, 0.8))


def ato_email(cfg: Settings, email="P_emaildomain") -> Column:
    value = F.col(email)
    risky = F.coalesce(value.isin(cfg.ato.risky_email_domains), F.lit(False))
    odd = F.coalesce(F.lower(value).rlike(fixed.PROFILE_EMAIL_PATTERN), F.lit(False))
    return _capped(
        _points(_unseen(value, F.col("seen_emails")), 0.5) + _points(risky, 0.7)
        + _points(odd, 0.6))


def ato_amount(cfg: Settings, amount="TransactionAmt") -> Column:
    amt, n = F.col(amount), F.col("seen_amount_n")
    mean, std = F.col("seen_amount_mean"), F.col("seen_amount_std")
    z = F.when((n >= 5) & (std > 0), F.abs((amt - mean) / std))
    spike = F.when((n >= 5) & (mean > 0), amt / mean)
    zero = F.lit(0.0)
    score = (
        _bands(amt, (cfg.ato.high_amount_threshold, 0.7), (1000, 0.4))
        + F.when(z > 3.0, 0.6).when(z > 2.0, 0.3).otherwise(zero)
        + F.coalesce(_bands(spike, (5.0, 0.5), (3.0, 0.3)), zero)
    )
    return F.when(F.coalesce(amt, zero) == 0, zero).otherwise(_capped(score))


def ato_card_type(card_type="card6") -> Column:
    return _points(_unseen(F.col(card_type), F.col("seen_card_types")), 0.4)


def ato_score(cfg: Settings, geo="ato_geo", device="ato_device", email="ato_email",
              amount="ato_amount", card="ato_card_type") -> Column:
    a = cfg.ato
    return _capped(
        F.col(geo) * a.geo_anomaly_weight + F.col(device) * a.new_address_ip_weight
        + F.col(email) * a.email_mismatch_weight + F.col(amount) * a.high_amount_weight
        + F.col(card) * a.unusual_card_weight
    )


def ato_factors(cfg: Settings, amount="TransactionAmt", dist="dist1",
                email="P_emaildomain") -> Column:
    far = (F.col("ato_geo") > 0.5) & (F.col(dist) > 500)
    risky = F.col(email).isin(cfg.ato.risky_email_domains)
    return present(
        F.when(far, F.concat(F.lit("geo_anomaly_distance_"), whole(F.col(dist)), F.lit("km"))),
        F.when(far, F.lit("geo_anomaly_new_address")),
        F.when(F.col("ato_device") > 0.5, F.lit("device_anomaly_new_device")),
        F.when((F.col("ato_email") > 0.5) & risky,
               F.concat(F.lit("email_risky_domain_"), F.col(email)))
        .when(F.col("ato_email") > 0.5, F.lit("email_anomaly_new_domain")),
        F.when(F.col("ato_amount") > 0.5,
               F.concat(F.lit("amount_anomaly_"), whole(F.col(amount)))),
        F.when(F.col("ato_card_type") > 0.3, F.lit("card_type_anomaly")),
    )


# ---- decision ------------------------------------------------------------------------
def hybrid_threshold(cfg: Settings, base: Column, velocity="velocity_risk",
                     amount="amount_risk", ato="ato_risk") -> Column:
    v, a, o = F.col(velocity), F.col(amount), F.col(ato)
    floor = F.lit(0.01)
    taus = [
        base,
        F.greatest(floor, base - v * 0.15),
        F.greatest(floor, base - a * 0.10),
        F.greatest(floor, base - o * 0.25),
    ]

    def mix(weights: list[float]) -> Column:
        return sum((tau * w for w, tau in zip(weights[1:], taus[1:])), taus[0] * weights[0])

    w = cfg.threshold_weights
    mixed = (
        F.when(o > 0.6, mix(w.high_ato)).when(v > 0.7, mix(w.high_velocity))
        .when(a > 0.7, mix(w.high_amount)).otherwise(mix(w.normal))
    )
    return F.least(F.lit(0.50), F.greatest(floor, mixed))


def _boost(p: Column, risk: Column, high: float, medium: float) -> Column:
    share = F.when(risk > 0.8, high).when(risk > 0.6, medium).otherwise(0.0)
    return p + share * (1 - p)


def adjust_probability(probability: Column, velocity="velocity_risk", amount="amount_risk",
                       ato="ato_risk") -> Column:
    p = _boost(probability, F.col(velocity), 0.15, 0.10)
    p = _boost(p, F.col(amount), 0.10, 0.05)
    p = _boost(p, F.col(ato), 0.20, 0.15)
    return F.least(p, F.lit(1.0))


def rule_factors(amount="TransactionAmt", hour="dt_hour", email="P_emaildomain",
                 product="ProductCD") -> Column:
    """One text per rule that fires; an empty array means no rule did."""
    amt = F.coalesce(F.col(amount), F.lit(0.0))
    return present(
        F.when(amt >= 10000, F.concat(F.lit("extreme_amount_"), whole(amt))),
        F.when(fx.is_night(F.col(hour)) & (amt >= 1000),
               F.concat(F.lit("night_high_amount_"), whole(amt))),
        F.when(F.col(email).isin(fixed.RULE_RISKY_DOMAINS),
               F.concat(F.lit("risky_email_"), F.col(email))),
        F.when((F.col(product) == "W") & (amt >= 5000),
               F.concat(F.lit("suspicious_wire_transfer_"), whole(amt))),
    )


def decide(cfg: Settings, adjusted: Column, threshold: Column, ato_detected: Column,
           rule_triggered: Column) -> Column:
    """Struct of decision and risk_level; the first matching band wins."""
    def result(decision: str, level: str) -> Column:
        return F.struct(F.lit(decision).alias("decision"), F.lit(level).alias("risk_level"))

    return (
        F.when(adjusted >= cfg.model.block_threshold, result("BLOCK", "HIGH"))
        .when(adjusted >= cfg.model.hold_threshold, result("HOLD", "HIGH"))
        .when((adjusted >= threshold) | ato_detected | rule_triggered,
              result("REVIEW", "MEDIUM"))
        .otherwise(result("APPROVE", "LOW"))
    )


def simple_decision(probability: Column, threshold: float | Column) -> dict[str, Column]:
    """Two-way stream decision; a missing probability is an ERROR record."""
    failed = probability.isNull() | F.isnan(probability)
    hit = probability >= threshold
    return {
        "fraud_probability": F.when(failed, 0.5).otherwise(probability),
        "decision": F.when(failed, "ERROR").when(hit, "FRAUD").otherwise("LEGITIMATE"),
        "risk_level": F.when(failed, "UNKNOWN").when(hit, "HIGH").otherwise("LOW"),
        "threshold": F.when(failed, 0.5).otherwise(F.lit(threshold)),
    }


def collect_factors(probability="fraud_probability", velocity="velocity_factors",
                    ato="ato_factors", rules="rule_factors", hour="dt_hour",
                    amount="TransactionAmt") -> Column:
    """All factors in fixed order, first occurrence kept."""
    p, h, amt = F.col(probability), F.col(hour), F.col(amount)
    model = present(
        F.when(p >= 0.20, F.concat(F.lit("high_ml_score_"), fixed_text(p, 3)))
        .when(p >= 0.10, F.concat(F.lit("medium_ml_score_"), fixed_text(p, 3))))
    context = present(
        F.when(fx.is_night(h), "night_transaction").when(h.between(9, 17), "business_hours"),
        F.when(amt >= 5000, F.concat(F.lit("very_high_amount_"), whole(amt)))
        .when(amt >= 2000, F.concat(F.lit("high_amount_"), whole(amt)))
        .when((amt <= 1) & (amt != 0), F.concat(F.lit("micro_transaction_"), fixed_text(amt, 2))),
    )
    return dedupe_factors(
        F.concat(model, F.col(velocity), F.col(ato), F.col(rules), context))


def dedupe_factors(factors: Column) -> Column:
    return F.array_distinct(factors)


# ---- adaptive threshold -------------------------------------------------------------
def adaptive_threshold(current: Column, velocity: Column, low=0.05, high=0.95) -> Column:
    """Current threshold lowered for busy cards, clipped."""
    factor = F.when(velocity > 0.8, 0.9).when(velocity > 0.6, 0.95).otherwise(1.0)
    return F.least(F.lit(high), F.greatest(F.lit(low), current * factor))


def adaptive_hybrid(
    current: Column, base: Column, velocity: Column, amount: Column, method: str = "weighted",
    weights: tuple[float, float, float] = (0.6, 0.3, 0.1), low: float = 0.05, high: float = 0.95,
) -> Column:
    taus = [current, base - velocity * 0.15, base - amount * 0.10]

    def mix(w: tuple[float, float, float]) -> Column:
        return taus[0] * w[0] + taus[1] * w[1] + taus[2] * w[2]

    if method == "max":
        tau = F.greatest(*taus)
    elif method == "min":
        tau = F.least(*taus)
    elif method == "dynamic":
        tau = (F.when(velocity > 0.7, mix((0.3, 0.5, 0.2)))
               .when(amount > 0.7, mix((0.3, 0.2, 0.5))).otherwise(mix((0.6, 0.2, 0.2))))
    elif method == "weighted":
        tau = mix(weights)
    else:
        raise ValueError(f"unknown method {method}")
    return F.least(F.lit(high), F.greatest(F.lit(low), tau))


def focal_loss(label: Column, raw: Column, alpha: float = 0.25, gamma: float = 2.0):
    """Loss, gradient and hessian of the focal loss at a raw (pre-sigmoid) score."""
    p = 1 / (1 + F.exp(-raw))
    q = 1 - p
    eps = 1e-7
    hit = label == 1

    def side(a: float, x: Column, y: Column) -> tuple[Column, Column, Column]:
        # x is the probability of the true class, y of the other one
        loss = -a * F.pow(y, gamma) * F.log(x + eps)
        slope = gamma * F.pow(y, gamma - 1) * F.log(x + eps) + F.pow(y, gamma) / (x + eps)
        curve = (
            gamma * (gamma - 1) * F.pow(y, gamma - 2) * F.log(x + eps)
            + 2 * gamma * F.pow(y, gamma - 1) / (x + eps) + F.pow(y, gamma) / (x * x + eps)
        )
        return loss, -a * y * slope, a * x * y * curve

    of_fraud, of_legit = side(alpha, p, q), side(1 - alpha, q, p)
    names = ("focal_loss", "focal_gradient", "focal_hessian")
    return {n: F.when(hit, f).otherwise(g) for n, f, g in zip(names, of_fraud, of_legit)}
