"""Cross-validate, refit and compare the six variants.

The folds are fixed by hash, so every variant and every search candidate sees the same ones. All fits, those without a fold
and the refits on all rows, with and without over-sampling, stand in one written table, and each model's fits go through it
together. An over-sampled fold is built once; one search of neighbours serves all of them. The held-out predictions of all
variants and folds are scored by one grouped plan, those of the test rows by another.
"""

from __future__ import annotations

from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone
from functools import reduce
from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.operators.classifiers import (
    MODEL_NAMES,
    FitTables,
    FittedClassifier,
    Variant,
    build_variant,
    fit_many,
    importance_table,
)
from ebbtide.operators.evaluate import all_metrics, fold_summary, ranking_metrics
from ebbtide.operators.neighbours import leaving_out, neighbours_by_fold
from ebbtide.operators.selection import stratified_folds
from ebbtide.operators.smote import class_points, minority_plan, oversample
from ebbtide.plans.features import Matrices, model_matrices
from ebbtide.plans.scoring import ChurnScorer
from ebbtide.session import cut_lineage
from ebbtide.sources.registry import RUN_SCHEMA, write_importances, write_run_metadata
from ebbtide.sources.schema import ID, LABEL
from ebbtide.sources.tables import read_customers

FOLDS = 5
#: Folds over-sampled at the same time.
OVERSAMPLED_AT_ONCE = 6


@dataclass
class TrainingSets:
    """Encoded rows with a fold column, and the over-sampled versions and fit tables made so far."""

    matrices: Matrices
    folds: int = FOLDS
    seed: int = 42
    made: dict = field(default_factory=dict)
    kept: dict = field(default_factory=dict)
    searched: dict = field(default_factory=dict)
    #: Folds that are over-sampled beside each other wait for the search that one of them runs.
    searching: Lock = field(default_factory=Lock, repr=False)

    def __post_init__(self):
        self.train = cut_lineage(stratified_folds(cut_lineage(self.matrices.train), self.folds, self.seed))
        self.test = cut_lineage(self.matrices.test)

    @property
    def features(self) -> list[str]:
        return self.matrices.state.feature_names

    def rows(self, smote: bool, without_fold: int | None = None) -> DataFrame:
        """Training rows, all of them or without one fold; over-sampled rows come from these rows only."""
        rows = self.train if without_fold is None else self.train.filter(F.col("fold") != without_fold)
        if not smote:
            return rows
        if without_fold not in self.made:
            plan = minority_plan(rows)
            more = oversample(rows, self.features, seed=self.seed, search=lambda _, k: self.neighbours(plan[0], without_fold, k), plan=plan)
            self.made[without_fold] = cut_lineage(more.sortWithinPartitions(ID))
        return self.made[without_fold]

    def neighbours(self, minority: int, without_fold: int | None, k: int) -> DataFrame:
        """Neighbours within the minority class outside a fold; all folds are searched together, once."""
        with self.searching:
            if (minority, k) not in self.searched:
                self.searched[minority, k] = neighbours_by_fold(class_points(self.train, self.features, minority), self.folds, k)
        return leaving_out(self.searched[minority, k], without_fold, k)

    def fit_number(self, smote: bool, without_fold: int | None = None) -> int:
        """The number of a set of training rows among all fits: folds first, then all rows; over-sampled ones after that."""
        return (self.folds if without_fold is None else without_fold) + (self.folds + 1 if smote else 0)

    def tables(self, smote: set[bool], left_out: Iterable[int | None]) -> FitTables:
        """The rows of the asked fits, each with its number, and the tables made of them; kept for the next model."""
        asked = (frozenset(smote), frozenset(left_out))
        if asked not in self.kept:
            parts = []
            if False in smote:
                numbers = F.array(*[F.lit(self.fit_number(False, fold)) for fold in asked[1]])
                inside = F.filter(numbers, lambda k: F.col("fold") != k)
                parts.append(self.train.withColumn("fit", F.explode(inside)))
            if True in smote:
                # An over-sampling is a chain of short jobs: those of several folds run beside each other.
                with ThreadPoolExecutor(OVERSAMPLED_AT_ONCE) as pool:
                    made = list(pool.map(lambda fold: self.rows(True, fold), asked[1]))
                parts += [rows.withColumn("fit", F.lit(self.fit_number(True, fold))) for rows, fold in zip(made, asked[1], strict=True)]
            columns = [F.col(f"`{name}`") for name in ("fit", ID, LABEL, *self.features)]
            stacked = reduce(DataFrame.unionByName, [p.select(*columns) for p in parts])
            self.kept[asked] = FitTables(stacked, self.features, cuts_from=self.train)
        return self.kept[asked]

    def held_out(self, fold: int) -> DataFrame:
        return self.train.filter(F.col("fold") == fold)


def prepare(df: DataFrame, test_size: float = 0.2, folds: int = FOLDS, seed: int = 42) -> TrainingSets:
    """The table is parsed or derived once; the passes that fit split and encoder read the written copy."""
    return TrainingSets(model_matrices(cut_lineage(df), test_size, seed), folds, seed)


def held_out_scores(sets: TrainingSets, fitted: dict[tuple[str, int], FittedClassifier]) -> DataFrame:
    """run, fold, roc_auc on the held-out rows of each fold, for fitted classifiers by (run, fold)."""
    parts = [
        f.transform(sets.held_out(fold)).select(F.lit(run).alias("run"), "fold", "churn_probability", LABEL)
        for (run, fold), f in fitted.items()
    ]
    return ranking_metrics(reduce(DataFrame.unionByName, parts), "churn_probability", by=["run", "fold"])


def cross_validate_all(sets: TrainingSets, variants: dict[str, Variant]) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation of the held-out ROC-AUC of every variant, by its name."""
    wanted = [(run, fold) for run in variants for fold in range(sets.folds)]
    tables = sets.tables({v.smote for v in variants.values()}, range(sets.folds))
    fitted = fit_many(tables, [(sets.fit_number(variants[run].smote, fold), variants[run]) for run, fold in wanted])
    scores = held_out_scores(sets, dict(zip(wanted, fitted, strict=True)))
    return {r["run"]: (r["cv_mean"], r["cv_std"]) for r in fold_summary(scores, by=["run"]).collect()}


def metrics_of(sets: TrainingSets, fitted: list[FittedClassifier]) -> list[dict]:
    """Test metrics of every classifier, from one grouped plan."""
    parts = [f.transform(sets.test).select(F.lit(k).alias("run"), "churn_probability", LABEL) for k, f in enumerate(fitted)]
    rows = all_metrics(reduce(DataFrame.unionByName, parts), "churn_probability", by=["run"]).collect()
    return [r.asDict() for r in sorted(rows, key=lambda r: r["run"])]


@dataclass(frozen=True)
class Run:
    order: int
    variant: Variant
    fitted: FittedClassifier
    cv_roc_auc: float | None
    cv_roc_auc_std: float | None
    test: dict
    fold_scores: tuple[float | None, ...] = ()
    fit_rows: tuple[int, int] = (0, 0)

    def as_row(self) -> tuple:
        rounded = [None if x is None else round(x, 4) for x in (self.cv_roc_auc, self.cv_roc_auc_std)]
        v, t = self.variant, self.test
        return (
            self.order, v.run_id, v.model, v.smote, *rounded,
            t["roc_auc"], t["pr_auc"], t["precision"], t["recall"], t["f1"],
        )


def six_variants(seed: int = 42, overrides: dict | None = None) -> list[Variant]:
    overrides = overrides or {}
    return [
        build_variant(name, smote, seed, **overrides.get(name, {})) for name in MODEL_NAMES for smote in (False, True)
    ]


def train_all(sets: TrainingSets, variants: list[Variant] | None = None, validate: bool = True) -> list[Run]:
    """Cross-validate, refit and test all variants; every fit of a model, folds and refits, shares its jobs."""
    variants = six_variants(sets.seed) if variants is None else variants
    folds = [*(range(sets.folds) if validate else ()), None]
    wanted = [(k, fold) for k in range(len(variants)) for fold in folds]
    tables = sets.tables({v.smote for v in variants}, folds)
    fitted = dict(zip(wanted, fit_many(tables, [(sets.fit_number(variants[k].smote, fold), variants[k]) for k, fold in wanted]), strict=True))
    summary, by_fold = {}, {}
    refitted = [fitted[k, None] for k in range(len(variants))]
    with ThreadPoolExecutor(1) as pool:  # test rows are scored beside the held-out ones
        testing = pool.submit(metrics_of, sets, refitted)
        if validate:
            scores = cut_lineage(held_out_scores(sets, {(str(k), fold): f for (k, fold), f in fitted.items() if fold is not None}))
            summary = {r["run"]: (r["cv_mean"], r["cv_std"]) for r in fold_summary(scores, by=["run"]).collect()}
            by_fold = {(r["run"], r["fold"]): r["roc_auc"] for r in scores.collect()}
        tests = testing.result()
    return [
        Run(
            k, v, refitted[k], *summary.get(str(k), (None, None)), tests[k],
            tuple(by_fold.get((str(k), fold)) for fold in folds if fold is not None), tables.counts[sets.fit_number(v.smote)],
        )
        for k, v in enumerate(variants)
    ]


def best_of(runs: list[Run]) -> Run:
    """Highest test ROC-AUC; the variant trained first wins a tie."""
    return max(runs, key=lambda run: run.test["roc_auc"])


def runs_frame(spark: SparkSession, runs: list[Run]) -> DataFrame:
    return spark.createDataFrame([run.as_row() for run in runs], RUN_SCHEMA)


def scorer_of(sets: TrainingSets, fitted: FittedClassifier) -> ChurnScorer:
    """The fitted classifier with its encoder; a linear model is explained against the mean of the real training rows."""
    if fitted.linear:
        fitted = replace(fitted, linear=fitted.linear.with_background(sets.train))
    return ChurnScorer(sets.matrices.state, fitted)


def save_training(spark: SparkSession, sets: TrainingSets, runs: list[Run], path: str) -> None:
    """Best scorer, run metadata and importances under one directory."""
    best = best_of(runs)
    scorer_of(sets, best.fitted).save(spark, f"{path}/best_model")
    write_run_metadata(
        runs_frame(spark, runs),
        path=f"{path}/model_metadata",
        best_run_id=best.variant.run_id,
        features=sets.features,
        trained_at=datetime.now(timezone.utc).isoformat(),
        random_state=sets.seed,
        cv_folds=sets.folds,
    )
    write_importances(importance_table(spark, best.fitted), f"{path}/feature_importance")


def run_training(
    spark: SparkSession,
    data_path: str,
    out_path: str,
    fmt: str = "csv",
    test_size: float = 0.2,
    folds: int = FOLDS,
    seed: int = 42,
    variants: list[Variant] | None = None,
) -> list[Run]:
    """The whole job: read, check, split, encode, train all variants, keep the best."""
    sets = prepare(read_customers(spark, data_path, fmt), test_size, folds, seed)
    runs = train_all(sets, variants)
    save_training(spark, sets, runs, out_path)
    return runs
