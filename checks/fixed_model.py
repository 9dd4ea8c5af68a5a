"""A linear model with fixed numbers, so that scoring can be compared with SQL.

Fixed values: rounded from one fit on the derived churn table.
"""

from __future__ import annotations

from ebbtide.operators.classifiers import FittedClassifier, build_variant
from ebbtide.operators.encoding import EncoderState
from ebbtide.operators.linear import LinearModel, ScalerState
from ebbtide.plans.scoring import ChurnScorer
from ebbtide.sources.schema import CATEGORIES

MAX_LOGINS = 22.0
MAX_USAGE = 305.0
INTERCEPT = -0.687

# feature, mean, scale, coefficient
TABLE = (
    ("tenure", 43.822, 25.351, -1.227),
    ("monthly_charges", 799.637, 96.521, 0.315),
    ("total_charges", 35312.976, 20868.546, -0.175),
    ("support_calls", 4.594, 3.228, 0.956),
    ("number_of_logins", 12.965, 3.492, 0.089),
    ("usage_hours", 134.216, 55.823, -0.228),
    ("customer_lifetime_value", 35070.008, 20871.182, -0.185),
    ("engagement_score", 0.515, 0.12, -0.115),
    ("support_interaction_ratio", 0.783, 2.049, -0.166),
    ("charge_ratio", 2.426, 35.824, -0.044),
    ("tenure_group", 1.838, 1.087, -0.114),
    ("contract_type_One Year", 0.196, 0.397, -0.796),
    ("contract_type_Two Year", 0.203, 0.403, -1.034),
    ("internet_service_Fiber Optic", 0.329, 0.47, 0.07),
    ("internet_service_No", 0.314, 0.464, 0.103),
    ("payment_method_Credit Card", 0.251, 0.434, -0.172),
    ("payment_method_Electronic Check", 0.251, 0.434, 0.01),
    ("payment_method_Mailed Check", 0.248, 0.432, -0.031),
)
FEATURES = [row[0] for row in TABLE]
STATE = EncoderState(MAX_LOGINS, MAX_USAGE, {name: sorted(found) for name, found in CATEGORIES.items()})


def linear(drop: tuple[str, ...] = ()) -> LinearModel:
    """The model, optionally with the coefficients of some features set to 0."""
    scaler = ScalerState([row[1] for row in TABLE], [row[2] for row in TABLE])
    coefficients = [0.0 if row[0] in drop else row[3] for row in TABLE]
    return LinearModel(FEATURES, scaler, coefficients, INTERCEPT, [0.0] * len(TABLE))


def scorer(drop: tuple[str, ...] = ()) -> ChurnScorer:
    variant = build_variant("logistic_regression", False)
    return ChurnScorer(STATE, FittedClassifier(variant, FEATURES, linear=linear(drop)))


# Three scorers for the run comparison: all features, no contract, no tenure and calls.
RUNS = (
    ("logistic_regression", True, ()),
    ("no_contract", False, ("contract_type_One Year", "contract_type_Two Year")),
    ("no_history", False, ("tenure", "support_calls")),
)
