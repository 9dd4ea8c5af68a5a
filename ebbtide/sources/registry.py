"""Run metadata, tuned-model metadata and feature importances as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_SCHEMA = (
    "run_order int, run_id string, model_name string, smote boolean, cv_roc_auc double, cv_roc_auc_std double, "
    "test_roc_auc double, test_pr_auc double, test_precision double, test_recall double, test_f1 double"
)
_RUN = (
    "run_id: string, model_name: string, smote: boolean, cv_roc_auc: double, cv_roc_auc_std: double, "
    "test_roc_auc: double, test_pr_auc: double, test_precision: double, test_recall: double, test_f1: double"
)
METADATA_SCHEMA = (
    f"trained_at string, random_state int, cv_folds int, best_model struct<{_RUN}>, "
    f"feature_names array<string>, all_runs array<struct<{_RUN}>>"
)
TUNED_SCHEMA = (
    "optimized_at string, model_name string, use_smote boolean, n_trials int, cv_folds int, random_state int, "
    "best_params map<string,string>, best_cv_roc_auc double, best_cv_roc_auc_std double, baseline_test_auc double, "
    "test_roc_auc double, test_precision double, test_recall double, test_f1 double, improvement double"
)
_RUN_FIELDS = [part.split(":")[0].strip() for part in _RUN.split(",")]


def write_run_metadata(
    runs: DataFrame, path: str, best_run_id: str, features: list[str], trained_at: str, random_state: int, cv_folds: int
) -> None:
    """One JSON document: the best run, all runs in training order, and the feature list."""
    run = F.struct(*_RUN_FIELDS)
    document = runs.agg(
        F.array_sort(F.collect_list(F.struct("run_order", run.alias("run")))).alias("ordered"),
        F.max_by(run, F.col("run_id") == best_run_id).alias("best_model"),
    ).select(
        F.lit(trained_at).alias("trained_at"),
        F.lit(random_state).alias("random_state"),
        F.lit(cv_folds).alias("cv_folds"),
        "best_model",
        F.array(*[F.lit(name) for name in features]).alias("feature_names"),
        F.col("ordered.run").alias("all_runs"),
    )
    document.coalesce(1).write.mode("overwrite").json(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METADATA_SCHEMA).option("multiLine", True).json(path)


def best_model_record(metadata: DataFrame) -> DataFrame:
    """The best run with the training stamp and the feature list, as one flat row."""
    return metadata.select(
        "best_model.*", "trained_at", "feature_names", F.size("feature_names").alias("n_features"), "all_runs"
    )


def runs_from_metadata(metadata: DataFrame) -> DataFrame:
    """One row per run, in training order."""
    return metadata.select(F.posexplode("all_runs").alias("run_order", "run")).select("run_order", "run.*")


def write_tuned_metadata(row: DataFrame, path: str) -> None:
    row.coalesce(1).write.mode("overwrite").json(path)


def read_tuned_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TUNED_SCHEMA).option("multiLine", True).json(path)


def write_importances(importances: DataFrame, path: str) -> None:
    """Sorted CSV; the table has one row per feature, so one file holds it."""
    ordered = importances.coalesce(1).sortWithinPartitions(F.desc("importance"), "feature")
    ordered.write.mode("overwrite").option("header", True).csv(path)


def read_importances(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("feature string, importance double").option("header", True).csv(path)
