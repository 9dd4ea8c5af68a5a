"""Imputation, fitted encoder state, one-hot and label encoding, alignment to a feature list."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ebbtide.functions import features as X
from ebbtide.sources.schema import (
    CATEGORIES,
    DEFAULT_LOGINS,
    DEFAULT_USAGE,
    ID,
    LABEL,
    NUMERIC_FEATURES,
    OPTIONAL,
    SchemaError,
)


def impute(df: DataFrame) -> DataFrame:
    """Optional columns always present and filled; an absent column is treated as a column of NULLs."""
    absent = {name: F.lit(None).cast("double") for name in OPTIONAL if name not in df.columns}
    df = df.withColumns(absent) if absent else df
    return df.withColumns(
        {
            "total_charges": F.coalesce("total_charges", F.col("tenure") * F.col("monthly_charges")),
            "number_of_logins": F.coalesce("number_of_logins", F.lit(DEFAULT_LOGINS)),
            "usage_hours": F.coalesce("usage_hours", F.lit(DEFAULT_USAGE)),
        }
    )


def usage_maxima(df: DataFrame) -> DataFrame:
    """Largest logins and usage of an imputed table, at least 1."""
    return df.agg(
        F.greatest(F.max("number_of_logins"), F.lit(1.0)).alias("max_logins"),
        F.greatest(F.max("usage_hours"), F.lit(1.0)).alias("max_usage"),
    )


@dataclass(frozen=True)
class EncoderState:
    """What the encoders learn from training rows: two maxima and a sorted vocabulary per column."""

    max_logins: float
    max_usage: float
    vocabulary: dict[str, list[str]] = field(default_factory=dict)

    @property
    def dummy_columns(self) -> list[str]:
        return [f"{col}_{cat}" for col, cats in self.vocabulary.items() for cat in cats[1:]]

    @property
    def feature_names(self) -> list[str]:
        return [*NUMERIC_FEATURES, *self.dummy_columns]

    def to_frame(self, spark: SparkSession) -> DataFrame:
        rows = [("max_logins", None, 0, self.max_logins), ("max_usage", None, 0, self.max_usage)]
        rows += [(col, cat, i, None) for col, cats in self.vocabulary.items() for i, cat in enumerate(cats)]
        return spark.createDataFrame(rows, "name string, category string, position int, value double")

    def save(self, spark: SparkSession, path: str) -> None:
        self.to_frame(spark).coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "EncoderState":
        return EncoderState.from_frame(spark.read.parquet(path))

    @staticmethod
    def from_frame(frame: DataFrame) -> "EncoderState":
        rows = frame.collect()
        numbers = {row["name"]: row["value"] for row in rows if row["category"] is None}
        vocabulary = {}
        for name in CATEGORIES:
            found = sorted((row["position"], row["category"]) for row in rows if row["name"] == name)
            if found:
                vocabulary[name] = [category for _, category in found]
        return EncoderState(numbers["max_logins"], numbers["max_usage"], vocabulary)


def vocabulary_table(df: DataFrame, columns=tuple(CATEGORIES)) -> DataFrame:
    """Distinct categories of each text column with their sorted position, from one grouped pass.

    Grouping comes first, so the window only ever sees one row per distinct category.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("category")) for c in columns]))
    distinct = df.select(pairs.alias("pair")).select("pair.*").filter("category IS NOT NULL").distinct()
    order = Window.partitionBy("name").orderBy("category")
    return distinct.withColumn("position", F.row_number().over(order) - 1)


def fit_encoder(df: DataFrame) -> EncoderState:
    """Learn maxima and vocabularies from imputed training rows, in one pass.

    The pass groups by (column, category), so what reaches the driver is the sum of the columns' vocabularies, one row
    per dummy column to come.
    """
    columns = [name for name in CATEGORIES if name in df.columns]
    pairs = [F.struct(F.lit(c).alias("name"), F.col(c).alias("category")) for c in columns] or [F.struct(F.lit("").alias("name"), F.lit("").alias("category"))]
    found = df.select(F.explode(F.array(*pairs)).alias("pair"), "number_of_logins", "usage_hours").groupBy("pair.name", "pair.category")
    rows = found.agg(F.max("number_of_logins").alias("max_logins"), F.max("usage_hours").alias("max_usage")).collect()
    if not rows:
        raise SchemaError("no rows to fit the encoder on")
    vocabulary = {name: sorted(r["category"] for r in rows if r["name"] == name and r["category"] is not None) for name in columns}
    return EncoderState(
        max(1.0, *[row["max_logins"] for row in rows]), max(1.0, *[row["max_usage"] for row in rows]), vocabulary
    )


def engineered(df: DataFrame, max_logins, max_usage) -> DataFrame:
    """The five derived columns on top of an imputed table."""
    return df.withColumns(
        {
            "customer_lifetime_value": X.lifetime_value(),
            "engagement_score": X.engagement_score(max_logins, max_usage),
            "support_interaction_ratio": X.support_interaction_ratio(),
            "charge_ratio": X.charge_ratio(),
            "tenure_group": X.tenure_group(),
        }
    )


def one_hot(df: DataFrame, column: str, categories: list[str]) -> DataFrame:
    """0/1 columns for all but the first category; a category never seen gives zeros everywhere."""
    if column not in df.columns:
        return df
    dummies = {f"{column}_{cat}": F.coalesce((F.col(column) == cat).cast("int"), F.lit(0)) for cat in categories[1:]}
    return df.withColumns(dummies).drop(column)


def label_codes(column: Column, classes: list[str]) -> Column:
    """Position of the value among the sorted classes; an unseen value takes the first class."""
    code = F.lit(0)
    for i, name in reversed(list(enumerate(classes))):
        code = F.when(column == name, i).otherwise(code)
    return code


def encode(df: DataFrame, state: EncoderState) -> DataFrame:
    """Text columns to numbers with a fitted state; columns that are absent are skipped."""
    for column, categories in state.vocabulary.items():
        df = one_hot(df, column, categories)
    if "tenure_group" in df.columns:
        df = df.withColumn("tenure_group", X.tenure_group_position())
    return df


def align(df: DataFrame, features: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Exactly the feature list, in order, as doubles: absent columns are 0, others are dropped."""
    if not features:
        raise SchemaError("the feature list is empty")
    columns = [
        F.col(f"`{name}`").cast("double").alias(name) if name in df.columns else F.lit(0.0).alias(name)
        for name in features
    ]
    return df.select(*[F.col(name) for name in keep if name in df.columns], *columns)


def drop_identifiers(df: DataFrame, columns=(ID,)) -> DataFrame:
    return df.drop(*columns)


def features_and_label(df: DataFrame, features: list[str], label: str = LABEL) -> DataFrame:
    """The modelling columns and the label as a whole number; a row without a label fails the job."""
    if label not in df.columns:
        raise SchemaError(f"label column {label} is missing; columns: {df.columns}")
    known = F.coalesce(F.col(label), F.raise_error(F.lit(f"{label} is NULL")).cast(df.schema[label].dataType))
    return df.select(*[F.col(f"`{name}`") for name in features], known.cast("int").alias(label))
