"""A linear classifier as plain columns: scaling, probability and per-feature contributions stay in generated code."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ScalerState:
    mean: list[float]
    scale: list[float]


def fit_scaler(df: DataFrame, features: list[str]) -> ScalerState:
    """Mean and population standard deviation per feature, in one pass; a constant feature gets scale 1."""
    row = df.agg(
        *[F.avg(f"`{name}`").alias(f"m{i}") for i, name in enumerate(features)],
        *[F.stddev_pop(f"`{name}`").alias(f"s{i}") for i, name in enumerate(features)],
    ).first()
    width = len(features)
    if row[0] is None:
        raise ValueError("no rows to fit the scaler on")
    return ScalerState(list(row[:width]), [s if s > 0 else 1.0 for s in row[width:]])


def scaled_columns(features: list[str], scaler: ScalerState) -> list[Column]:
    return [
        (F.col(f"`{name}`") - F.lit(float(m))) / F.lit(float(s))
        for name, m, s in zip(features, scaler.mean, scaler.scale)
    ]


@dataclass(frozen=True)
class LinearModel:
    """Coefficients in scaled space; ``background`` is the mean of the scaled training rows."""

    features: list[str]
    scaler: ScalerState
    coefficients: list[float]
    intercept: float
    background: list[float] | None = None

    def margin(self) -> Column:
        parts = [F.lit(float(c)) * x for c, x in zip(self.coefficients, scaled_columns(self.features, self.scaler))]
        return reduce(lambda a, b: a + b, parts, F.lit(float(self.intercept)))

    def probability(self) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-self.margin()))

    def contributions(self) -> list[Column]:
        """Coefficient times distance from the background mean, per feature."""
        background = self.background or [0.0] * len(self.features)
        return [
            F.lit(float(c)) * (x - F.lit(float(b)))
            for c, x, b in zip(self.coefficients, scaled_columns(self.features, self.scaler), background)
        ]

    def with_background(self, df: DataFrame) -> "LinearModel":
        """Background mean over training rows, in scaled space."""
        means = df.agg(*[F.avg(x) for x in scaled_columns(self.features, self.scaler)]).first()
        return LinearModel(self.features, self.scaler, self.coefficients, self.intercept, list(means))
