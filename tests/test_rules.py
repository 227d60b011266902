"""Hand-computed risk and decision cases."""

import pytest
from pyspark.sql import functions as F

from cardwatch.config import Settings, resolve_config
from cardwatch.functions import columns as fx, risk
from cardwatch.operators import encode, metrics
from cardwatch.operators.profile import takeover_risk
from cardwatch.plans import scoring

CFG = Settings().validate()


def value(spark, column, **cols):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()])
    return df.select(column.alias("x")).first()["x"]


def test_hybrid_threshold_worked_example(spark):
    got = value(spark, risk.hybrid_threshold(CFG, F.lit(0.5)),
                velocity_risk=0.7, amount_risk=0.8, ato_risk=0.9)
    assert got == pytest.approx(0.1 * 0.5 + 0.2 * 0.395 + 0.1 * 0.42 + 0.6 * 0.275)


@pytest.mark.parametrize("adjusted,ato,rule,expected", [
    (0.20, False, False, ("BLOCK", "HIGH")), (0.1999, False, False, ("HOLD", "HIGH")),
    (0.10, False, False, ("HOLD", "HIGH")), (0.05, False, False, ("REVIEW", "MEDIUM")),
    (0.01, True, False, ("REVIEW", "MEDIUM")), (0.01, False, True, ("REVIEW", "MEDIUM")),
    (0.01, False, False, ("APPROVE", "LOW"))])
def test_decision_edges(spark, adjusted, ato, rule, expected):
    got = value(spark, risk.decide(
        CFG, F.lit(adjusted), F.lit(0.05), F.lit(ato), F.lit(rule)), unused=1)
    assert (got["decision"], got["risk_level"]) == expected


def test_adjustments_apply_in_order(spark):
    got = value(spark, risk.adjust_probability(F.lit(0.1)),
                velocity_risk=0.9, amount_risk=0.7, ato_risk=0.9)
    p = 0.1 + 0.15 * 0.9
    p += 0.05 * (1 - p)
    assert got == pytest.approx(p + 0.20 * (1 - p))


def _takeover(spark, **change):
    row = {"addr1": 315, "addr2": 87, "dist1": 19.0, "DeviceInfo": "Windows",
           "P_emaildomain": "gmail.com", "card6": "credit", "TransactionAmt": 50.0,
           "seen_addr1": [315], "seen_addr2": [87], "seen_devices": ["Windows"],
           "seen_emails": ["gmail.com"], "seen_card_types": ["credit"],
           "seen_amount_n": 5, "seen_amount_mean": 50.0, "seen_amount_std": 5.0, **change}
    types = ("addr1 int, addr2 int, dist1 double, DeviceInfo string, P_emaildomain string, "
             "card6 string, TransactionAmt double, seen_addr1 array<int>, seen_addr2 array<int>, "
             "seen_devices array<string>, seen_emails array<string>, "
             "seen_card_types array<string>, seen_amount_n int, seen_amount_mean double, "
             "seen_amount_std double")
    return takeover_risk(spark.createDataFrame([tuple(row.values())], types), CFG).first()


def test_near_distance_gives_no_factor(spark):
    got = _takeover(spark)
    assert got["ato_risk"] == 0 and got["ato_factors"] == []


def test_far_distance_alone_stays_below_the_gate(spark):
    got = _takeover(spark, dist1=650.0)
    assert got["ato_geo"] == pytest.approx(0.4) and got["ato_factors"] == []


def test_takeover_is_detected(spark):
    got = _takeover(spark, addr1=589, dist1=1500.0, P_emaildomain="tempmail.com",
                    TransactionAmt=2500.0)
    assert got["ato_geo"] == 1.0 and got["ato_email"] == 1.0 and got["ato_amount"] == 1.0
    assert got["ato_risk"] == pytest.approx(0.80) and got["ato_detected"]
    assert got["ato_factors"] == [
        "geo_anomaly_distance_1500km", "geo_anomaly_new_address",
        "email_risky_domain_tempmail.com", "amount_anomaly_2500"]


def test_rules_fire_for_risky_mail_and_midnight(spark):
    got = value(spark, risk.rule_factors(), TransactionAmt=1500.5, dt_hour=0,
                P_emaildomain="anonymous.com", ProductCD="C")
    assert got == ["night_high_amount_1500", "risky_email_anonymous.com"]


def test_amounts_print_half_to_even(spark):
    assert value(spark, risk.whole(F.lit(2500.5)), unused=1) == "2500"


@pytest.mark.parametrize("number,digits", [
    (42.85, 1), (42.25, 1), (42.75, 1), (3.45, 1), (9.999, 1), (0.1235, 3), (0.1005, 3),
    (0.9999, 3), (0.125, 2), (0.875, 2), (120.005, 2), (0.0, 3), (7.0, 1)])
def test_printed_digits_match_exact_rounding(spark, number, digits):
    assert value(spark, risk.fixed_text(F.lit(number), digits), unused=1) == f"{number:.{digits}f}"


@pytest.mark.parametrize("hour,engine,feature", [(0, 1, 1), (6, 0, 1), (22, 1, 1), (12, 0, 0)])
def test_two_nights(spark, hour, engine, feature):
    dt = hour * 3600
    assert value(spark, fx.time_flags()["is_night"], TransactionDT=dt) == engine
    assert value(spark, fx.time_features()["dt_is_night"], TransactionDT=dt) == feature


def test_later_device_rule_wins(spark):
    corp = fx.device_corp()
    assert value(spark, corp, DeviceInfo="Galaxy") == "SONY"
    assert value(spark, corp, DeviceInfo="moto g") == "MOTOROLA"
    assert value(spark, corp, DeviceInfo="SM") == "SAMSUNG"


def test_missing_state_is_neutral(spark):
    df = spark.createDataFrame(
        [(None,) * 6], "velocity_risk double, amount_risk double, ato_risk double, "
        "ato_detected boolean, velocity_factors array<string>, ato_factors array<string>")
    got = scoring.neutral_if_missing(df).first()
    assert got["ato_risk"] == 0 and got["ato_detected"] is False and got["ato_factors"] == []


def test_fold_sizes_and_out_of_fold(spark):
    df = spark.createDataFrame(
        [(i, i, "a" if i < 3 else "b", i % 2) for i in range(13)],
        "TransactionID int, TransactionDT int, c string, isFraud int")
    fold = encode.contiguous_folds(df)
    folded = df.withColumn("fold", fold)
    sizes = {r["fold"]: r["count"] for r in folded.groupBy("fold").count().collect()}
    assert [sizes[i] for i in range(5)] == [3, 3, 3, 2, 2]
    sums = encode.fit_target_sums(df, ["c"], fold=fold)
    out = encode.apply_target_oof(folded, sums, ["c"], 0.4)
    # "a" lives in fold 0 only, so its rows never see their own labels
    assert {r["c_fraud_rate"] for r in out.where("c = 'a'").collect()} == {0.4}


def test_auc_against_all_pairs(spark):
    rows = [(i % 3 == 0, (i * 37 % 11) / 11) for i in range(40)]
    df = spark.createDataFrame([(int(y), p) for y, p in rows], "isFraud int, p double")
    pos = [p for y, p in rows if y]
    neg = [p for y, p in rows if not y]
    wins = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
    got = metrics.roc_auc(df, "isFraud", "p").first()["roc_auc"]
    assert got == pytest.approx(wins / len(pos) / len(neg))


def test_config_precedence(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("model:\n  base_threshold: 0.07\n  hold_threshold: 0.12\nother: 1\n")
    got = resolve_config(str(path), {"BASE_THRESHOLD": "0.08"})
    assert (got.model.base_threshold, got.model.hold_threshold) == (0.08, 0.12)
    with pytest.raises(ValueError):
        resolve_config(None, {"HOLD_THRESHOLD": "0.5"})
