"""Business rules over a probability and the raw customer columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ebbtide.functions.rounding import fixed_text, round_exact
from ebbtide.sources.schema import DEFAULT_LOGINS, DEFAULT_USAGE

# Thresholds of the risk and retention rules.
SEGMENT_FLOORS = (("Critical", 0.75), ("High", 0.50), ("Medium", 0.25))
LOWEST_SEGMENT = "Low"
HIGH_SEGMENTS = ("High", "Critical")
CHURN_THRESHOLD = 0.5
HIGH_CHARGES = 800.0
MANY_SUPPORT_CALLS = 5
LOW_ENGAGEMENT = 0.3
SHORT_TENURE = 12
LOSS_MONTHS = 6
TOP_REASONS = 3
ALERT_HIGH_RISK_PCT = 70.0
ALERT_MEAN_PROBABILITY_PCT = 50.0
LIST_SEPARATOR = " | "

# Texts shown to users.
ACTION_MONTHLY = "Upsell to an Annual or Two-Year contract with incentive pricing"
ACTION_ENGAGEMENT = "Trigger a personalised re-engagement campaign (low login frequency and usage hours detected)"
ACTION_NONE = "Monitor account health — no immediate escalation required"
REASON_MONTHLY = "Month-to-month contract type increases likelihood of switching"
SEGMENT_MARKS = {"Critical": "🔴", "High": "🟠", "Medium": "🟡", "Low": "🟢"}
UNKNOWN_MARK = "⚪"


def churn_label(probability: Column) -> Column:
    return (probability >= CHURN_THRESHOLD).cast("int")


def risk_segment(probability: Column) -> Column:
    """NULL for a NULL probability: a row that could not be scored must not look safe."""
    (top, at), *rest = SEGMENT_FLOORS
    segment = F.when(probability >= at, top)
    for name, floor in rest:
        segment = segment.when(probability >= floor, name)
    return segment.when(probability.isNotNull(), LOWEST_SEGMENT)


def expected_revenue_loss(probability: Column, charges: Column | None = None) -> Column:
    charges = F.col("monthly_charges") if charges is None else charges
    return round_exact(probability * charges * F.lit(float(LOSS_MONTHS)), 2)


def rule_engagement(supplied: str | None = None) -> Column:
    """Engagement on fixed scales (50 logins, 200 hours); a column that already holds a score wins."""
    logins = F.coalesce(F.col("number_of_logins"), F.lit(DEFAULT_LOGINS))
    usage = F.coalesce(F.col("usage_hours"), F.lit(DEFAULT_USAGE))
    estimate = (logins / F.lit(50.0) + usage / F.lit(200.0)) / F.lit(2.0)
    return F.coalesce(F.col(supplied), estimate) if supplied else estimate


def is_monthly_contract() -> Column:
    return F.lower(F.col("contract_type")).contains("month")


def _texts(default: Column, rules: list[tuple[Column, Column]], at_most: int | None = None) -> Column:
    """Texts of the rules that fire, in order, or the default.

    Short arrays are concatenated rather than filtered: that stays in generated code, and each text is built only
    where its rule fires.
    """
    none = F.array().cast("array<string>")
    fires = [F.coalesce(condition, F.lit(False)) for condition, _ in rules]
    found = F.concat(*[F.when(fire, F.array(text)).otherwise(none) for fire, (_, text) in zip(fires, rules)])
    if at_most is not None:
        found = F.slice(found, 1, at_most)
    return F.when(reduce(lambda a, b: a | b, fires), found).otherwise(F.array(default))


def retention_strategy(engagement: Column | None = None) -> Column:
    """Every action whose rule fires, in a fixed order, or the watch-and-wait action."""
    charges, calls = F.col("monthly_charges"), F.col("support_calls")
    engagement = rule_engagement() if engagement is None else engagement
    discount = F.concat(
        F.lit("Offer a loyalty discount or reduced-rate plan (current charge: $"), fixed_text(charges, 0), F.lit("/mo)")
    )
    escalate = F.concat(
        F.lit("Escalate to a Priority Support Agent ("), calls.cast("string"), F.lit(" support calls logged)")
    )
    return _texts(
        F.lit(ACTION_NONE),
        [
            (charges > HIGH_CHARGES, discount),
            (calls >= MANY_SUPPORT_CALLS, escalate),
            (is_monthly_contract(), F.lit(ACTION_MONTHLY)),
            (engagement < LOW_ENGAGEMENT, F.lit(ACTION_ENGAGEMENT)),
        ],
    )


def rule_reasons(probability: Column) -> Column:
    """The first three risk factors that apply to the raw columns, or one sentence with the probability."""
    tenure, charges, calls = F.col("tenure"), F.col("monthly_charges"), F.col("support_calls")
    engagement = rule_engagement()

    def sentence(before: str, value: Column, after: str) -> Column:
        return F.concat(F.lit(before), value, F.lit(after))

    nothing_found = sentence(
        "Churn probability of ",
        fixed_text(probability * F.lit(100.0), 1),
        "% detected — load model with background data for detailed SHAP reasons",
    )
    return _texts(
        nothing_found,
        [
            (
                tenure < SHORT_TENURE,
                sentence("Short account tenure (", tenure.cast("string"), " months) increases churn risk significantly"),
            ),
            (
                charges > HIGH_CHARGES,
                sentence("High monthly charges ($", fixed_text(charges, 0), ") increase churn risk moderately"),
            ),
            (
                calls >= MANY_SUPPORT_CALLS,
                sentence("High support call volume (", calls.cast("string"), " calls) indicates service friction"),
            ),
            (is_monthly_contract(), F.lit(REASON_MONTHLY)),
            (
                engagement < LOW_ENGAGEMENT,
                sentence("Low engagement score (", fixed_text(engagement, 2), ") suggests reduced product attachment"),
            ),
        ],
        at_most=TOP_REASONS,
    )


def segment_display(segment: Column) -> Column:
    marks = F.create_map(*[F.lit(text) for pair in SEGMENT_MARKS.items() for text in pair])
    return F.concat(F.coalesce(F.try_element_at(marks, segment), F.lit(UNKNOWN_MARK)), F.lit(" "), segment)


def join_texts(texts: Column) -> Column:
    return F.concat_ws(LIST_SEPARATOR, texts)


def run_id(model_name: Column, smote: Column) -> Column:
    return F.concat(model_name, F.when(smote, "_smote").otherwise("_no_smote"))
