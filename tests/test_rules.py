"""Hand-computed values of features, business rules and reason texts."""

import pytest
from pyspark.sql import functions as F

from checks.derived import rule_based_probability
from ebbtide.functions import features, reasons, risk
from ebbtide.functions.rounding import fixed_text, round_even, round_exact
from ebbtide.operators import encoding, monitoring, reports
from ebbtide.plans.features import engineer_features
from ebbtide.plans.scoring import decisions
from ebbtide.sources.tables import customers_from_records

QUIET = {
    "customer_id": "q", "tenure": 24, "monthly_charges": 300.0, "support_calls": 0, "contract_type": "Two Year",
    "internet_service": "DSL", "payment_method": "Credit Card", "number_of_logins": 45.0, "usage_hours": 170.0,
}


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "tenure, group, bucket",
    [
        (0, "new", "0–12 mo"), (12, "new", "0–12 mo"), (13, "developing", "13–36 mo"), (36, "developing", "13–36 mo"),
        (37, "established", "37–60 mo"), (60, "established", "37–60 mo"), (61, "loyal", "61–72 mo"),
        (72, "loyal", "61–72 mo"), (73, "loyal", None), (None, "nan", None), (-1, "nan", None),
    ],
)
def test_tenure_bands(spark, tenure, group, bucket):
    df = spark.createDataFrame([(tenure,)], "tenure int")
    row = df.select(features.tenure_group().alias("g"), features.tenure_bucket().alias("b")).first()
    assert (row["g"], row["b"]) == (group, bucket)
    code = value(spark, features.tenure_group_position(F.lit(group)))
    assert code == {"developing": 1, "established": 2, "loyal": 3}.get(group, 0)


def test_engineered_values(spark):
    rows = [{**QUIET, "customer_id": "a"}, {**QUIET, "customer_id": "b", "number_of_logins": 9.0, "usage_hours": None}]
    got = {r["customer_id"]: r for r in engineer_features(customers_from_records(spark, rows)).collect()}
    assert got["a"]["customer_lifetime_value"] == 7200.0 and got["a"]["engagement_score"] == 1.0
    assert got["b"]["engagement_score"] == round((9 / 45 + 40 / 170) / 2, 4)
    assert got["a"]["charge_ratio"] == round(300 / 7201, 6) and got["a"]["total_charges"] == 7200.0
    assert len(engineer_features(customers_from_records(spark, rows)).columns) == 15


def test_maxima_are_at_least_one(spark):
    idle = [{**QUIET, "number_of_logins": 0.0, "usage_hours": 0.5}]
    row = engineer_features(customers_from_records(spark, idle)).first()
    assert row["engagement_score"] == 0.25


def test_roundings(spark):
    assert value(spark, round_even(F.lit(2.5), 0)) == 2.0 and value(spark, round_even(F.lit(0.125), 2)) == 0.12
    for x in (0.5, 2.5, 2.675, 1.005, 1234567.895, 0.125, 99999.994999):
        assert value(spark, round_exact(F.lit(x), 2)) == round(x, 2)
        assert value(spark, fixed_text(F.lit(x), 0)) == f"{x:.0f}"
        assert value(spark, fixed_text(F.lit(x), 1)) == f"{x:.1f}"


@pytest.mark.parametrize(
    "p, segment, label",
    [
        (0.75, "Critical", 1), (0.7499999, "High", 1), (0.5, "High", 1), (0.4999999, "Medium", 0), (0.25, "Medium", 0),
        (0.2499999, "Low", 0), (0.0, "Low", 0), (1.0, "Critical", 1),
    ],
)
def test_segments(spark, p, segment, label):
    assert value(spark, risk.risk_segment(F.lit(None).cast("double"))) is None
    assert value(spark, risk.risk_segment(F.lit(p))) == segment
    assert value(spark, risk.churn_label(F.lit(p))) == label


def decide(spark, p=0.3, engagement=None, **change):
    df = customers_from_records(spark, [{**QUIET, **change}])
    df = df.withColumns({"churn_probability": F.lit(p), "given": F.lit(engagement).cast("double")})
    return decisions(df, engagement="given").first()


def test_nothing_fires(spark):
    row = decide(spark, p=0.1234)
    assert row["retention_strategy"] == ["Monitor account health — no immediate escalation required"]
    assert row["top_reasons"] == [
        "Churn probability of 12.3% detected — load model with background data for detailed SHAP reasons"
    ]
    assert row["expected_revenue_loss"] == round(0.1234 * 300 * 6, 2)


def test_rule_edges(spark):
    assert decide(spark, monthly_charges=800.0)["retention_strategy"][0].startswith("Monitor")
    assert decide(spark, monthly_charges=800.01)["retention_strategy"] == [
        "Offer a loyalty discount or reduced-rate plan (current charge: $800/mo)"
    ]
    assert decide(spark, monthly_charges=802.5)["retention_strategy"][0].endswith("$802/mo)")
    assert decide(spark, support_calls=4)["retention_strategy"][0].startswith("Monitor")
    assert decide(spark, support_calls=5)["retention_strategy"] == [
        "Escalate to a Priority Support Agent (5 support calls logged)"
    ]
    assert decide(spark, engagement=0.3)["retention_strategy"][0].startswith("Monitor")
    assert decide(spark, engagement=0.2999)["retention_strategy"][0].startswith("Trigger")
    assert decide(spark, contract_type="month by MONTH")["retention_strategy"][0].startswith("Upsell")


def test_all_rules_and_first_three_reasons(spark):
    row = decide(
        spark, tenure=4, monthly_charges=980.0, support_calls=8, contract_type="Month-to-Month",
        number_of_logins=None, usage_hours=None,
    )
    assert len(row["retention_strategy"]) == 4
    assert row["top_reasons"] == [
        "Short account tenure (4 months) increases churn risk significantly",
        "High monthly charges ($980) increase churn risk moderately",
        "High support call volume (8 calls) indicates service friction",
    ]
    low = decide(spark, number_of_logins=None, usage_hours=None)
    assert low["top_reasons"] == ["Low engagement score (0.18) suggests reduced product attachment"]


def ranked(spark, parts):
    names = [f"part_{i}" for i in range(len(parts))]
    df = spark.range(1).select(*[F.lit(1.005).alias(name) for name in names])
    return reasons.with_contribution_reasons(df, names, [F.lit(float(x)) for x in parts]).first()["top_reasons"]


def test_contribution_ranking(spark):
    assert ranked(spark, [0.2, 0.1, 0.05, -0.9]) == [
        "Part 0 (1.00) increases churn risk significantly",
        "Part 1 (1.00) increases churn risk moderately",
        "Part 2 (1.00) increases churn risk slightly",
    ]
    assert ranked(spark, [0.2, -0.9, -0.5]) == [
        "Part 1 (1.00) decreases churn risk significantly",
        "Part 2 (1.00) decreases churn risk significantly",
        "Part 0 (1.00) increases churn risk significantly",
    ]
    assert [t[:6] for t in ranked(spark, [0.1, 0.1, 0.1, 0.1])] == ["Part 0", "Part 1", "Part 2"]
    assert ranked(spark, [0.07, 0.15])[0].endswith("significantly") and ranked(spark, [0.07])[0].endswith("moderately")


def test_displays_and_run_ids(spark):
    assert value(spark, risk.segment_display(F.lit("High"))) == "🟠 High"
    assert value(spark, risk.segment_display(F.lit("Odd"))) == "⚪ Odd"
    assert value(spark, risk.run_id(F.lit("random_forest"), F.lit(True))) == "random_forest_smote"
    assert value(spark, risk.run_id(F.lit("random_forest"), F.lit(False))) == "random_forest_no_smote"


def test_clipped_sigmoid(spark):
    rows = [{**QUIET, "tenure": 720, "support_calls": 0}, {**QUIET, "support_calls": 100, "contract_type": "Month-to-Month"}]
    got = [r[0] for r in customers_from_records(spark, rows).select(rule_based_probability()).collect()]
    assert got[0] == pytest.approx(1 / (1 + 2.718281828459045**20)) and got[1] == pytest.approx(1 / (1 + 2.718281828459045**-20))


def test_encoding_with_a_loaded_state(spark, tmp_path):
    rows = [{**QUIET, "contract_type": c, "payment_method": p} for c, p in
            (("Two Year", "Mailed Check"), ("Month-to-Month", "Bank Transfer"), ("One Year", "Credit Card"))]
    df = encoding.impute(customers_from_records(spark, rows))
    state = encoding.fit_encoder(df)
    assert state.vocabulary["contract_type"] == ["Month-to-Month", "One Year", "Two Year"]
    assert state.dummy_columns == [
        "contract_type_One Year", "contract_type_Two Year", "payment_method_Credit Card", "payment_method_Mailed Check"
    ]
    state.save(spark, str(tmp_path / "state"))
    assert encoding.EncoderState.load(spark, str(tmp_path / "state")) == state
    new = encoding.impute(customers_from_records(spark, [{**QUIET, "payment_method": "Crypto"}]))
    coded = encoding.encode(encoding.engineered(new, 50.0, 200.0), state).first()
    assert coded["payment_method_Credit Card"] == 0 and coded["payment_method_Mailed Check"] == 0
    assert coded["contract_type_Two Year"] == 1 and coded["tenure_group"] == 1


def test_empty_batch_reports(spark):
    empty = spark.createDataFrame(
        [], "batch_id int, churn_probability double, churn_label int, risk_segment string, expected_revenue_loss double"
    )
    assert reports.has_result_columns(empty) and not reports.has_result_columns(empty.drop("churn_label"))
    summary = reports.batch_summary(empty).first()
    assert (summary["total"], summary["predicted_churn"], summary["total_expected_loss"]) == (0, 0, None)
    assert monitoring.batch_log(empty).count() == 0 and monitoring.latest(monitoring.batch_log(empty)).count() == 0


def test_alert_is_strict(spark):
    log = spark.createDataFrame([(1, 50.0, 70.0), (2, 50.01, 70.01)], "batch_id int, avg_prob double, high_risk_pct double")
    rows = monitoring.with_alerts(log).orderBy("batch_id").collect()
    assert [(r["alert"], r["probability_status"]) for r in rows] == [(False, "OK"), (True, "HIGH")]
