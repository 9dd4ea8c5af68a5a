"""Churn reports over a labelled table, and reports over scored rows and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.functions.features import tenure_bucket
from ebbtide.functions.risk import HIGH_SEGMENTS, join_texts
from ebbtide.functions.rounding import round_even, round_exact
from ebbtide.operators.selection import hashed_sample
from ebbtide.sources.schema import ID, LABEL, RESULT_COLUMNS

HISTOGRAM_BINS = 40


def overview(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("customers"),
        F.avg(LABEL).alias("churn_rate"),
        F.avg("monthly_charges").alias("avg_monthly_charges"),
        F.avg("tenure").alias("avg_tenure"),
    )


def churn_counts(df: DataFrame) -> DataFrame:
    name = F.when(F.col(LABEL) == 0, "Retained").when(F.col(LABEL) == 1, "Churned")
    return df.groupBy(LABEL).count().select(name.alias("status"), F.col("count").alias("customers")).orderBy(
        F.desc("customers"), "status"
    )


def churn_rate_pct() -> Column:
    return round_even(F.avg(LABEL) * F.lit(100.0), 1)


def churn_rate_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(churn_rate_pct().alias("churn_rate_pct")).orderBy(column)


def churn_rate_by_tenure_bucket(df: DataFrame) -> DataFrame:
    bucketed = df.select(tenure_bucket().alias("tenure_bucket"), LABEL).filter(F.col("tenure_bucket").isNotNull())
    return churn_rate_by(bucketed, "tenure_bucket")


def charges_histogram(df: DataFrame, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Rows per equal-width bin of monthly charges and churn label; the largest value closes the last bin."""
    span = df.agg(
        F.struct(F.min("monthly_charges").alias("low"), F.max("monthly_charges").alias("high"))
    ).scalar()
    width = (span["high"] - span["low"]) / F.lit(float(bins))
    place = F.coalesce(F.floor(F.try_divide(F.col("monthly_charges") - span["low"], width)), F.lit(0))
    return (
        df.filter(F.col("monthly_charges").isNotNull())
        .groupBy((F.least(place, F.lit(bins - 1)) + 1).cast("int").alias("bin"), LABEL)
        .agg(F.count("*").alias("customers"))
    )


def scatter_sample(df: DataFrame, n: int = 1000, seed=42) -> DataFrame:
    return hashed_sample(df, n, seed).select(ID, "tenure", "monthly_charges", LABEL)


def preview(df: DataFrame, n: int, key: str = ID) -> DataFrame:
    return df.orderBy(key).limit(n)


def class_balance(df: DataFrame) -> DataFrame:
    """Rows and churn percentage per split."""
    return df.groupBy("split").agg(F.count("*").alias("rows"), (F.avg(LABEL) * 100).alias("churn_pct"))


def high_risk(segment: str = "risk_segment") -> Column:
    return F.col(segment).isin(*HIGH_SEGMENTS)


def segment_distribution(scored: DataFrame) -> DataFrame:
    return scored.groupBy("risk_segment").agg(F.count("*").alias("customers")).orderBy(
        F.desc("customers"), "risk_segment"
    )


def sum_of_cents(column: str) -> Column:
    """Sum of amounts in whole cents: the same whatever the order of summation."""
    return F.sum(F.round(F.col(column) * F.lit(100.0)).cast("decimal(38,0)")).cast("double") / F.lit(100.0)


def batch_summary(scored: DataFrame) -> DataFrame:
    """One row: rows scored, predicted churners, high and critical rows, sum of the rounded losses."""
    return scored.agg(
        F.count("*").alias("total"),
        F.coalesce(F.sum("churn_label"), F.lit(0)).alias("predicted_churn"),
        F.count_if(high_risk()).alias("high_risk_count"),
        sum_of_cents("expected_revenue_loss").alias("total_expected_loss"),
    )


def scored_by_risk(scored: DataFrame) -> DataFrame:
    return scored.orderBy(F.desc("churn_probability"), ID)


def has_result_columns(df: DataFrame) -> bool:
    return set(RESULT_COLUMNS) <= set(df.columns)


def result_table(scored: DataFrame) -> DataFrame:
    """The flat form for files and tables: probability to 4 digits, loss to 2, lists joined with a bar."""
    return scored.select(
        ID,
        round_exact(F.col("churn_probability"), 4).alias("churn_probability"),
        "churn_label",
        "risk_segment",
        round_exact(F.col("expected_revenue_loss"), 2).alias("expected_revenue_loss"),
        join_texts(F.col("retention_strategy")).alias("retention_strategy"),
        join_texts(F.col("top_reasons")).alias("top_reasons"),
    )


# Headings of the run table.
RUN_HEADINGS = {
    "run_id": "Run",
    "smote": "SMOTE",
    "cv_roc_auc": "CV AUC",
    "test_roc_auc": "Test AUC",
    "test_precision": "Precision",
    "test_recall": "Recall",
    "test_f1": "F1",
}


def run_table(runs: DataFrame) -> DataFrame:
    """Runs by test ROC-AUC with report headings."""
    ordered = runs.orderBy(F.desc("test_roc_auc"), "run_order")
    return ordered.select(*[F.col(name).alias(heading) for name, heading in RUN_HEADINGS.items()])


def best_run(runs: DataFrame) -> DataFrame:
    """Highest test ROC-AUC; the run trained first wins a tie."""
    return runs.orderBy(F.desc("test_roc_auc"), "run_order").limit(1)


def run_comparison(runs: DataFrame) -> DataFrame:
    """Runs with their rank and the winner's mark; the run table holds one row per variant."""
    order = Window.orderBy(F.desc("test_roc_auc"), "run_order")
    return runs.withColumn("rank", F.row_number().over(order)).withColumn("is_best", F.col("rank") == 1)


def top_importances(importances: DataFrame, n: int = 15) -> DataFrame:
    return importances.orderBy(F.desc("importance"), "feature").limit(n)
