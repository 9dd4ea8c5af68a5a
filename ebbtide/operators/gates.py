"""Data and model gates: one row per rule with its value, its limit and the verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.sources.schema import COLUMN_TYPES, ID, LABEL

# Limits of the gates.
MAX_NULL_RATE = 0.05
MIN_CHURN_RATE, MAX_CHURN_RATE = 0.10, 0.40
MIN_ROC_AUC = 0.80
MIN_PR_AUC = 0.55


def null_rates(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """NULL count and share of every column: one aggregate row, then turned on its side."""
    columns = columns or df.columns
    counts = df.agg(
        F.count("*").alias("rows_total"), *[F.count_if(F.col(f"`{name}`").isNull()).alias(name) for name in columns]
    )
    return counts.unpivot("rows_total", columns, "column_name", "nulls").select(
        "column_name", "nulls", F.try_divide(F.col("nulls"), F.col("rows_total")).alias("null_rate")
    )


def duplicate_ids(df: DataFrame, key: str = ID) -> DataFrame:
    """Ids that occur more than once, with their rows. Rows without an id are counted by the NULL rule, not here."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("rows")).filter("rows > 1")


def label_rate(df: DataFrame) -> DataFrame:
    return df.agg(F.avg(LABEL).alias("churn_rate")).withColumn(
        "passed", F.col("churn_rate").between(MIN_CHURN_RATE, MAX_CHURN_RATE)
    )


def type_faults(df: DataFrame) -> list[tuple[str, str, str]]:
    """(column, declared type, found type or 'absent') for every column that is not as declared."""
    found = dict(df.dtypes)
    return [
        (name, wanted.simpleString(), found.get(name, "absent"))
        for name, wanted in COLUMN_TYPES.items()
        if found.get(name) != wanted.simpleString()
    ]


def _rule(name: str, value: Column, low: float | None, high: float | None) -> Column:
    passed = F.lit(True)
    if low is not None:
        passed = passed & (value >= low)
    if high is not None:
        passed = passed & (value <= high)
    return F.struct(
        F.lit(name).alias("rule"),
        value.cast("double").alias("value"),
        F.lit(low).cast("double").alias("min_allowed"),
        F.lit(high).cast("double").alias("max_allowed"),
        F.coalesce(passed, F.lit(False)).alias("passed"),
    )


def data_gates(df: DataFrame, key: str = ID) -> DataFrame:
    """All data rules from two passes: one flat aggregate, and one grouped by id."""
    checked = [name for name in df.columns if name in COLUMN_TYPES and name != key]
    rows = F.count("*")
    flat = df.agg(
        *[F.try_divide(F.count_if(F.col(name).isNull()), rows).alias(f"null_{name}") for name in checked],
        F.try_divide(F.count_if(F.col(key).isNull()), rows).alias(f"null_{key}"),
        F.avg(LABEL).alias("churn_rate"),
        F.count_if(F.col("tenure") < 0).alias("negative_tenure"),
        F.count_if(F.col("monthly_charges") <= 0).alias("charges_not_positive"),
    )
    copies = duplicate_ids(df, key).agg(F.count("*").alias("n")).scalar()
    rules = [_rule(f"null_rate:{name}", F.col(f"null_{name}"), None, MAX_NULL_RATE) for name in [key, *checked]]
    rules += [
        _rule("churn_rate", F.col("churn_rate"), MIN_CHURN_RATE, MAX_CHURN_RATE),
        _rule("negative_tenure", F.col("negative_tenure"), None, 0),
        _rule("charges_not_positive", F.col("charges_not_positive"), None, 0),
        _rule("duplicate_ids", copies, None, 0),
        _rule("type_faults", F.lit(len(type_faults(df.select(*[n for n in df.columns if n in COLUMN_TYPES])))), None, 0),
    ]
    return flat.select(F.explode(F.array(*rules)).alias("gate")).select("gate.*")


def model_gates(metrics: DataFrame, by: list[str] = ()) -> DataFrame:
    """ROC-AUC and average precision against their lower limits, per row of ``metrics``."""
    rules = [
        _rule("roc_auc", F.col("roc_auc"), MIN_ROC_AUC, None),
        _rule("pr_auc", F.col("pr_auc"), MIN_PR_AUC, None),
    ]
    return metrics.select(*by, F.explode(F.array(*rules)).alias("gate")).select(*by, "gate.*")


def all_passed(gates: DataFrame) -> bool:
    return bool(gates.agg(F.bool_and("passed")).first()[0])


def failed_rules(gates: DataFrame) -> list[str]:
    return [row["rule"] for row in gates.filter(~F.col("passed")).select("rule").collect()]

