"""Hyper-parameter search: adaptive trials with pruning, ranked by mean cross-validated ROC-AUC, best one refitted."""

from __future__ import annotations

import time
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from ebbtide.operators.classifiers import FittedClassifier, Variant, build_variant, fit_many, model_name
from ebbtide.plans import study
from ebbtide.plans.training import TrainingSets, cross_validate_all, held_out_scores, metrics_of, scorer_of
from ebbtide.sources.registry import TUNED_SCHEMA, write_tuned_metadata

# Ranges of the search.
# (kind, low, high, step) or ("choice", values)
SEARCH_SPACES = {
    "logistic_regression": {
        "C": ("log", 1e-3, 100.0),
        "max_iter": ("int", 200, 2000, 100),
    },
    "random_forest": {
        "n_estimators": ("int", 100, 500, 50),
        "max_depth": ("int", 3, 20, 1),
        "min_samples_split": ("int", 2, 20, 1),
        "min_samples_leaf": ("int", 1, 10, 1),
        "max_features": ("choice", ("sqrt", "log2", 0.3, 0.5)),
    },
    "gradient_boosting": {
        "n_estimators": ("int", 100, 500, 50),
        "max_depth": ("int", 3, 9, 1),
        "learning_rate": ("log", 0.01, 0.3),
        "subsample": ("real", 0.6, 1.0),
        "colsample": ("real", 0.6, 1.0),
        "gamma": ("real", 0.0, 1.0),
        "reg_alpha": ("log", 1e-4, 10.0),
        "reg_lambda": ("log", 1e-4, 10.0),
        "min_child_weight": ("int", 1, 10, 1),
    },
}


@dataclass(frozen=True)
class SearchResult:
    variant: Variant
    fitted: FittedClassifier
    trials: list[study.Trial]
    best_cv: tuple[float, float]
    baseline_cv: float
    baseline_test_auc: float
    test: dict

    @property
    def improvement(self) -> float:
        return round(self.test["roc_auc"] - self.baseline_test_auc, 4)


def optimise(
    sets: TrainingSets,
    model: str = "gradient_boosting",
    n_trials: int = 50,
    smote: bool = True,
    seed: int = 42,
    timeout_seconds: float | None = None,
    space: dict | None = None,
    baseline: dict | None = None,
    batch: int = 5,
    log_path: str | None = None,
    pruner: study.MedianPruner = study.MedianPruner(),
) -> SearchResult:
    """Search until ``n_trials`` are done or the time limit passes, refit the best, compare it with the defaults.

    The trials of a batch go through a fold together, and those that fall behind do not see the next one. With a
    ``log_path`` the trials there count, and new ones are appended: a stopped search goes on where it was.
    """
    default = build_variant(model, smote, seed, **(baseline or {}))
    space = SEARCH_SPACES[model_name(model)] if space is None else space
    log = study.TrialLog(sets.train.sparkSession, log_path, space)
    trials = study.Study(study.ParzenSampler(space, seed), pruner, sets.folds, batch, log)
    started = time.monotonic()

    def score(fold: int, candidates: list[dict]) -> list[float]:
        tries = [build_variant(model, smote, seed, **params) for params in candidates]
        fitted = fit_many(sets.tables({smote}, [fold]), [(sets.fit_number(smote, fold), v) for v in tries])
        found = held_out_scores(sets, {(str(k), fold): f for k, f in enumerate(fitted)})
        by_run = {r["run"]: r["roc_auc"] for r in found.collect()}
        return [by_run[str(k)] for k in range(len(tries))]

    trials.run(n_trials, score, lambda: timeout_seconds is None or time.monotonic() - started <= timeout_seconds)
    best = trials.best()
    tuned = build_variant(model, smote, seed, **best.params)
    baseline_cv = cross_validate_all(sets, {"default": default})["default"][0]
    whole = sets.fit_number(smote)
    fitted, plain = fit_many(sets.tables({smote}, [None]), [(whole, tuned), (whole, default)])
    test, plain_test = metrics_of(sets, [fitted, plain])
    return SearchResult(tuned, fitted, trials.trials, (best.mean, best.std), baseline_cv, plain_test["roc_auc"], test)


def trials_frame(spark: SparkSession, result: SearchResult) -> DataFrame:
    return study.trials_frame(spark, result.trials)


def tuned_frame(spark: SparkSession, sets: TrainingSets, result: SearchResult) -> DataFrame:
    row = (
        datetime.now(timezone.utc).isoformat(), result.variant.model, result.variant.smote, len(result.trials),
        sets.folds, sets.seed, {k: str(v) for k, v in result.variant.params.items()},
        round(result.best_cv[0], 4), round(result.best_cv[1], 4), result.baseline_test_auc,
        result.test["roc_auc"], result.test["precision"], result.test["recall"], result.test["f1"],
        result.improvement,
    )
    return spark.createDataFrame([row], TUNED_SCHEMA)


def save_search(spark: SparkSession, sets: TrainingSets, result: SearchResult, path: str) -> None:
    scorer_of(sets, result.fitted).save(spark, f"{path}/optimized_model")
    write_tuned_metadata(tuned_frame(spark, sets, result), f"{path}/optimized_metadata")


def comparison_frame(spark: SparkSession, result: SearchResult) -> DataFrame:
    """Default against tuned, metric by metric; the default is compared on ROC-AUC only."""
    t = result.test
    rows = [("roc_auc", result.baseline_test_auc, t["roc_auc"], result.improvement)]
    rows += [(name, None, t[name], None) for name in ("precision", "recall", "f1")]
    return spark.createDataFrame(rows, "metric string, baseline double, tuned double, delta double")
