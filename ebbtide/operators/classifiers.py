"""Three classifiers, each with or without over-sampling, fitted on encoded rows; many fits share their passes.

Logistic regression takes Newton steps (`newton`), forests and boosting grow level by level (`tree_growing`). Both work on
any number of fits at once: a fit is one set of training rows, such as all rows without a fold.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.operators import newton, tree_growing
from ebbtide.operators.linear import LinearModel, ScalerState
from ebbtide.operators.tree_models import TreeEnsemble, load_ensemble, probability_column, save_ensemble
from ebbtide.sources.schema import ID, LABEL

MODEL_NAMES = ("logistic_regression", "random_forest", "gradient_boosting")
ALIASES = {"xgboost": "gradient_boosting"}

# Hyper-parameters of the three default models.
DEFAULT_PARAMS = {
    "logistic_regression": {"C": 1.0, "max_iter": 1000},
    "random_forest": {"n_estimators": 200, "max_depth": 10, "min_samples_split": 5, "min_samples_leaf": 4, "max_features": "sqrt"},
    "gradient_boosting": {
        "n_estimators": 300, "max_depth": 5, "learning_rate": 0.05, "subsample": 0.8, "colsample": 0.8,
        "gamma": 0.1, "reg_alpha": 0.1, "reg_lambda": 1.0, "min_child_weight": 1.0,
    },
}


def model_name(name: str) -> str:
    name = ALIASES.get(name, name)
    if name not in MODEL_NAMES:
        raise ValueError(f"unknown model {name!r}; choose from {MODEL_NAMES}")
    return name


@dataclass(frozen=True)
class Variant:
    """One thing to train: a model, its parameters, and whether the training rows are over-sampled first."""

    model: str
    smote: bool
    params: dict = field(default_factory=dict)
    seed: int = 42

    @property
    def run_id(self) -> str:
        return f"{self.model}_{'smote' if self.smote else 'no_smote'}"

    @property
    def balanced(self) -> bool:
        """Boosting takes the rows as they come; the other two weigh the classes."""
        return self.model != "gradient_boosting"

    @property
    def steps(self) -> list[str]:
        scaled = ["scaler"] if self.model == "logistic_regression" else []
        return [*(["smote"] if self.smote else []), *scaled, "classifier"]


def build_variant(name: str, smote: bool, seed: int = 42, **params) -> Variant:
    name = model_name(name)
    unknown = set(params) - set(DEFAULT_PARAMS[name])
    if unknown:
        raise ValueError(f"{name} has no parameter {sorted(unknown)}")
    return Variant(name, smote, {**DEFAULT_PARAMS[name], **params}, seed)


@dataclass(frozen=True)
class FittedClassifier:
    """A fitted variant: a linear model as columns, or a tree ensemble over the feature columns."""

    variant: Variant
    features: list[str]
    linear: LinearModel | None = None
    trees: TreeEnsemble | None = None

    def transform(self, df: DataFrame, output: str = "churn_probability") -> DataFrame:
        probability = self.linear.probability() if self.linear else probability_column(df, self.trees, self.features)
        return df.withColumn(output, probability)

    def importances(self) -> dict[str, float]:
        """Importances of trees by gain, absolute coefficients of the linear model, largest first."""
        raw = [abs(c) for c in self.linear.coefficients] if self.linear else self.trees.importances().tolist()
        if len(raw) != len(self.features):
            raise ValueError(f"{len(raw)} importances for {len(self.features)} features")
        return dict(sorted(zip(self.features, map(float, raw)), key=lambda pair: -pair[1]))


def importance_table(spark: SparkSession, fitted: FittedClassifier) -> DataFrame:
    rows = list(fitted.importances().items())
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


@dataclass
class FitTables:
    """Training rows of many fits (a ``fit`` column beside features, id and label), written in the form each model reads.

    ``cuts_from`` are the rows whose quantiles become the trees' cut points; the rows themselves if not given.
    """

    rows: DataFrame
    features: list[str]
    label: str = LABEL
    key: str = ID
    cuts_from: DataFrame | None = None
    made: dict = field(default_factory=dict)
    #: Models that are fitted beside each other wait for a table that one of them writes.
    writing: Lock = field(default_factory=Lock, repr=False)

    @property
    def binned(self) -> tree_growing.BinnedRows:
        with self.writing:
            if "binned" not in self.made:
                cuts = tree_growing.cut_points(self.rows if self.cuts_from is None else self.cuts_from, self.features)
                self.made["binned"] = tree_growing.bin_rows(self.rows, self.features, cuts, self.key, self.label)
        return self.made["binned"]

    @property
    def counts(self) -> dict[int, tuple[int, int]]:
        """Rows of each fit by class."""
        return self.made["binned"].rows if "binned" in self.made else self.scaled.counts

    @property
    def scaled(self) -> newton.FitRows:
        if "scaled" not in self.made:
            self.made["scaled"] = newton.fit_rows(self.rows, self.features, self.label)
        return self.made["scaled"]


def _grown(tables: FitTables, model: str, wanted: list[tuple[int, Variant]]) -> list[TreeEnsemble]:
    specs = [tree_growing.Spec(fit, model == "gradient_boosting", seed=v.seed, **v.params) for fit, v in wanted]
    return tree_growing.grow_boosted(tables.binned, specs) if model == "gradient_boosting" else tree_growing.grow_forests(tables.binned, specs)


def fit_many(tables: FitTables, wanted: list[tuple[int, Variant]]) -> list[FittedClassifier]:
    """One fitted classifier per (fit, variant), in that order; each model's fits share their jobs."""
    found: dict[int, FittedClassifier] = {}
    for model in MODEL_NAMES:
        some = [(k, fit, v) for k, (fit, v) in enumerate(wanted) if v.model == model]
        if not some:
            continue
        if model == "logistic_regression":
            models = newton.fit_logistic(tables.scaled, [newton.LogisticSpec(fit, **v.params) for _, fit, v in some])
            found |= {k: FittedClassifier(v, tables.features, linear=m) for (k, _, v), m in zip(some, models, strict=True)}
        else:
            models = _grown(tables, model, [(fit, v) for _, fit, v in some])
            found |= {k: FittedClassifier(v, tables.features, trees=m) for (k, _, v), m in zip(some, models, strict=True)}
    return [found[k] for k in range(len(wanted))]


def fit_classifier(rows: DataFrame, features: list[str], variant: Variant, label: str = LABEL, key: str = ID) -> FittedClassifier:
    """Fit on rows that are already over-sampled if the variant asks for it."""
    return fit_many(FitTables(rows.withColumn("fit", F.lit(0)), features, label, key), [(0, variant)])[0]


def save_classifier(spark: SparkSession, fitted: FittedClassifier, path: str) -> None:
    """A linear model is a table with one row per feature; trees are a node table. Both have a one-row header."""
    variant = fitted.variant
    header = spark.createDataFrame(
        [(variant.model, variant.smote, {k: str(v) for k, v in variant.params.items()}, variant.seed, fitted.features,
          fitted.linear.intercept if fitted.linear else None)],
        "model string, smote boolean, params map<string,string>, seed int, features array<string>, intercept double",
    )
    header.coalesce(1).write.mode("overwrite").parquet(f"{path}/header")
    if fitted.linear:
        m = fitted.linear
        rows = list(zip(range(len(m.features)), m.features, m.scaler.mean, m.scaler.scale, m.coefficients,
                        m.background or [0.0] * len(m.features)))
        table = spark.createDataFrame(
            rows, "position int, feature string, mean double, scale double, coefficient double, background double"
        )
        table.coalesce(1).write.mode("overwrite").parquet(f"{path}/linear")
    else:
        save_ensemble(spark, fitted.trees, path)


def _param(text: str):
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return text


def load_classifier(spark: SparkSession, path: str) -> FittedClassifier:
    head = spark.read.parquet(f"{path}/header").first()
    variant = Variant(head["model"], head["smote"], {k: _param(v) for k, v in head["params"].items()}, head["seed"])
    features = list(head["features"])
    if head["intercept"] is None:
        return FittedClassifier(variant, features, trees=load_ensemble(spark, path))
    rows = sorted(spark.read.parquet(f"{path}/linear").collect(), key=lambda row: row["position"])
    scaler = ScalerState([r["mean"] for r in rows], [r["scale"] for r in rows])
    linear = LinearModel(
        features, scaler, [r["coefficient"] for r in rows], head["intercept"], [r["background"] for r in rows]
    )
    return FittedClassifier(variant, features, linear=linear)

