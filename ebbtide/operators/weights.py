"""Class weights that make both classes count the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.sources.schema import LABEL


def class_weight_table(df: DataFrame, label: str = LABEL) -> DataFrame:
    """n / (classes * n_class) for each class of the rows given to the classifier."""
    counts = df.groupBy(label).agg(F.count("*").alias("rows"))
    totals = counts.agg(F.struct(F.sum("rows").alias("n"), F.count("*").alias("classes"))).scalar()
    weight = totals["n"] / (totals["classes"] * F.col("rows"))
    return counts.select(label, "rows", weight.alias("weight"))


def class_weight_column(df: DataFrame, label: str = LABEL) -> tuple[Column, float]:
    """The weight of a binary label as a column of literals, and the sum of the weights (the row count)."""
    weight, total = F.lit(None).cast("double"), 0.0
    classes = class_weight_table(df, label).limit(3).collect()
    if len(classes) > 2 or any(row[label] is None for row in classes):
        raise ValueError(f"{label} must be binary and not NULL")
    for row in classes:
        weight = F.when(F.col(label) == row[label], F.lit(row["weight"])).otherwise(weight)
        total += row["weight"] * row["rows"]
    return weight, total
