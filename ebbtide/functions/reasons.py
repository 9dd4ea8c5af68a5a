"""Turn per-feature contributions into ranked sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.functions.risk import TOP_REASONS
from ebbtide.functions.rounding import fixed_text

# How a feature is named in a sentence, and when a contribution is called large.
FEATURE_LABELS = {
    "tenure": "account tenure",
    "monthly_charges": "monthly charges",
    "total_charges": "total charges to date",
    "support_calls": "number of support calls",
    "number_of_logins": "login frequency",
    "usage_hours": "usage hours",
    "customer_lifetime_value": "customer lifetime value",
    "engagement_score": "overall engagement score",
    "support_interaction_ratio": "support call rate",
    "charge_ratio": "charge-to-total ratio",
    "tenure_group": "tenure group",
    "contract_type_One Year": "one-year contract status",
    "contract_type_Two Year": "two-year contract status",
    "internet_service_Fiber Optic": "fiber optic service",
    "internet_service_No": "no internet service",
    "payment_method_Credit Card": "credit card payment",
    "payment_method_Electronic Check": "electronic check payment",
    "payment_method_Mailed Check": "mailed check payment",
}
SIGNIFICANT = 0.15
MODERATE = 0.07


def feature_label(name: str) -> str:
    return FEATURE_LABELS.get(name, name.replace("_", " ")).capitalize()


def _sentence(part: Column, labels: Column) -> Column:
    size = F.abs(part["contribution"])
    magnitude = F.when(size >= SIGNIFICANT, "significantly").when(size >= MODERATE, "moderately").otherwise("slightly")
    direction = F.when(part["contribution"] > 0, "increases").otherwise("decreases")
    return F.concat(
        F.element_at(labels, part["position"]), F.lit(" ("), fixed_text(part["value"], 2), F.lit(") "),
        direction, F.lit(" churn risk "), magnitude,
    )


def with_contribution_reasons(
    df: DataFrame,
    features: list[str],
    contributions: list[Column],
    output: str = "top_reasons",
    top: int = TOP_REASONS,
) -> DataFrame:
    """Adds sentences for the largest risk-raising parts, or for the largest parts of either sign if those are too few.

    The parts become an array that sorts by: in the running, falling size, position. Sorting, picking and formatting
    need no lambda and so stay in generated code; the sorted array is its own projection, computed once per row.
    """
    labels = F.array(*[F.lit(feature_label(name)) for name in features])
    raising = sum((F.when(part > 0, 1).otherwise(0) for part in contributions), F.lit(0))
    rows = df.withColumn("enough_raising", raising >= top)
    parts = [
        F.struct(
            (F.col("enough_raising") & (part <= 0)).alias("out"),
            (-F.abs(part)).alias("order"),
            F.lit(i).alias("position"),
            F.col(f"`{name}`").cast("double").alias("value"),
            part.alias("contribution"),
        )
        for i, (name, part) in enumerate(zip(features, contributions), 1)
    ]
    rows = rows.withColumn("ranked_parts", F.slice(F.sort_array(F.array(*parts)), 1, top))
    places = range(min(top, len(features)))
    texts = F.array(*[_sentence(F.get("ranked_parts", F.lit(i)), labels) for i in places])
    return rows.withColumn(output, texts).drop("ranked_parts", "enough_raising")
