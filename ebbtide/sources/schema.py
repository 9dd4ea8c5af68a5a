"""Declared columns, value domains and defaults of the customer table.

Fixed values: names, ranges, categories and fill values are part of the data contract.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

ID = "customer_id"
LABEL = "churn"

REQUIRED = (
    "tenure",
    "monthly_charges",
    "support_calls",
    "contract_type",
    "internet_service",
    "payment_method",
)

OPTIONAL = ("total_charges", "number_of_logins", "usage_hours")

DEFAULT_LOGINS = 8.0
DEFAULT_USAGE = 40.0

COLUMN_TYPES = {
    "customer_id": T.StringType(),
    "tenure": T.IntegerType(),
    "monthly_charges": T.DoubleType(),
    "total_charges": T.DoubleType(),
    "contract_type": T.StringType(),
    "internet_service": T.StringType(),
    "payment_method": T.StringType(),
    "support_calls": T.IntegerType(),
    "number_of_logins": T.DoubleType(),
    "usage_hours": T.DoubleType(),
    "churn": T.IntegerType(),
}

CATEGORIES = {
    "contract_type": ("Month-to-Month", "One Year", "Two Year"),
    "internet_service": ("DSL", "Fiber Optic", "No"),
    "payment_method": ("Electronic Check", "Mailed Check", "Bank Transfer", "Credit Card"),
}

TENURE_GROUPS = ("new", "developing", "established", "loyal")

NUMERIC_FEATURES = (
    "tenure",
    "monthly_charges",
    "total_charges",
    "support_calls",
    "number_of_logins",
    "usage_hours",
    "customer_lifetime_value",
    "engagement_score",
    "support_interaction_ratio",
    "charge_ratio",
    "tenure_group",
)


@dataclass(frozen=True)
class Range:
    low: float
    low_is_allowed: bool
    high: float | None


RANGES = {
    "tenure": Range(0, True, 720),
    "monthly_charges": Range(0, False, 10_000),
    "support_calls": Range(0, True, 100),
    "total_charges": Range(0, True, None),
    "number_of_logins": Range(0, True, 1000),
    "usage_hours": Range(0, True, 8760),
}

# Text cells that stand for "no value" in a CSV file.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

RESULT_COLUMNS = ("churn_label", "risk_segment", "churn_probability", "expected_revenue_loss")


class SchemaError(ValueError):
    """The table lacks columns, or has columns that cannot be told apart."""


class ValueRuleError(ValueError):
    """Rows break a value rule in strict mode."""


def customer_schema(with_label: bool = True) -> T.StructType:
    names = [name for name in COLUMN_TYPES if with_label or name != LABEL]
    return T.StructType([T.StructField(name, COLUMN_TYPES[name]) for name in names])
