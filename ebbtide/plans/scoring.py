"""From customer rows to decisions: probability, segment, expected loss, actions and reasons in one narrow plan.

A row's result depends on the row and on fitted state only, never on the other rows of the batch, so the same plan
serves one record, a nightly table and a stream.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.functions import risk
from ebbtide.functions.features import tenure_group_position
from ebbtide.functions.reasons import with_contribution_reasons
from ebbtide.operators.checks import require_clean, split_rejects
from ebbtide.operators.classifiers import FittedClassifier, load_classifier, save_classifier
from ebbtide.operators.encoding import EncoderState, engineered, impute
from ebbtide.operators.tree_contributions import with_tree_contributions
from ebbtide.sources.schema import ID, SchemaError
from ebbtide.sources.tables import fill_ids

SCORED_COLUMNS = (
    "churn_probability", "churn_label", "risk_segment", "expected_revenue_loss", "retention_strategy", "top_reasons",
)


def with_feature_columns(df: DataFrame, state: EncoderState, features: list[str]) -> DataFrame:
    """Feature columns next to the raw ones; a feature the state does not know is 0."""
    df = engineered(impute(df), state.max_logins, state.max_usage)
    made = {"tenure_group": tenure_group_position()}
    for column, categories in state.vocabulary.items():
        for category in categories[1:]:
            made[f"{column}_{category}"] = F.coalesce((F.col(column) == category).cast("double"), F.lit(0.0))
    df = df.withColumns(made)
    absent = {name: F.lit(0.0) for name in features if name not in df.columns}
    return df.withColumns(absent) if absent else df


def decisions(df: DataFrame, keep: tuple[str, ...] = (ID,), engagement: str | None = None) -> DataFrame:
    """Business columns for rows that already carry ``churn_probability`` and, possibly, ``top_reasons``."""
    p = F.col("churn_probability")
    reasons = F.col("top_reasons") if "top_reasons" in df.columns else risk.rule_reasons(p)
    return df.select(
        *keep,
        p,
        risk.churn_label(p).alias("churn_label"),
        risk.risk_segment(p).alias("risk_segment"),
        risk.expected_revenue_loss(p).alias("expected_revenue_loss"),
        risk.retention_strategy(risk.rule_engagement(engagement)).alias("retention_strategy"),
        reasons.alias("top_reasons"),
    )


@dataclass(frozen=True)
class ChurnScorer:
    """Fitted encoder and classifier."""

    state: EncoderState
    classifier: FittedClassifier

    def probabilities(self, df: DataFrame) -> DataFrame:
        features = self.classifier.features
        if not features:
            raise SchemaError("the feature list is empty")
        return self.classifier.transform(with_feature_columns(df, self.state, features))

    def score(self, df: DataFrame, reasons: str = "rules", keep: tuple[str, ...] = (ID,)) -> DataFrame:
        """Score rows that satisfy the record rules.

        ``reasons`` is ``rules`` (risk factors read from the raw columns) or ``contributions`` (the model's own).
        An ``engagement_score`` column in the input overrides the estimate used by the retention rules.
        """
        supplied = None
        if "engagement_score" in df.columns:
            supplied = "supplied_engagement"
            df = df.withColumn(supplied, F.col("engagement_score").cast("double"))
        df = fill_ids(df)
        if reasons not in ("rules", "contributions"):
            raise ValueError(f"reasons must be rules or contributions, not {reasons!r}")
        rows = self.probabilities(df)
        if reasons == "contributions":
            rows = self._linear_reasons(rows) if self.classifier.linear else self._tree_reasons(rows)
        return decisions(rows, keep, supplied)

    def score_strict(self, df: DataFrame, reasons: str = "rules", keep: tuple[str, ...] = (ID,)) -> DataFrame:
        """All rows must satisfy the record rules."""
        return self.score(require_clean(df), reasons, keep)

    def score_lenient(
        self, df: DataFrame, reasons: str = "rules", keep: tuple[str, ...] = (ID,)
    ) -> tuple[DataFrame, DataFrame]:
        """Scored good rows, and rejected rows with their violation codes and, if the reader gave it, ``source_row_id``.

        Where an id is missing, the row's position takes its place.
        """
        good, rejects = split_rejects(df)
        return self.score(good, reasons, keep), rejects

    def _linear_reasons(self, rows: DataFrame) -> DataFrame:
        linear = self.classifier.linear
        return with_contribution_reasons(rows, linear.features, linear.contributions())

    def _tree_reasons(self, rows: DataFrame) -> DataFrame:
        features = self.classifier.features
        rows = with_tree_contributions(rows, self.classifier)
        parts = [F.element_at("contributions", i) for i in range(1, len(features) + 1)]
        return with_contribution_reasons(rows, features, parts)

    def save(self, spark: SparkSession, path: str) -> None:
        self.state.save(spark, f"{path}/encoder")
        save_classifier(spark, self.classifier, f"{path}/classifier")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "ChurnScorer":
        return ChurnScorer(EncoderState.load(spark, f"{path}/encoder"), load_classifier(spark, f"{path}/classifier"))
