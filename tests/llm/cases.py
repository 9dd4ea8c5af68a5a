"""Rows that every operator must bear: nulls, empty and very long texts, ties, repeated rows, clashing column names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LONG = "ab cd. ef " * 30_000
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog.", "en", "s", 44),
    (1, "The quick brown fox jumps over the lazy dog.", "en", "s", 44),
    (2, None, "en", "s", None),
    (3, "", "de", None, 0),
    (4, " \t\n ", None, "s", 4),
    (None, "The quick brown fox jumps over the lazy dog.", "en", "s", 44),
    (5, LONG, "en", "s", len(LONG)),
    (6, "x" * 100_000, None, "s", 100_000),
    (7, "1234 56 %%% <|endoftext|> it's éß \U0001f600 a  b", "fr", "s", 40),
    (2**40, "THE QUICK BROWN FOX JUMPS OVER THE LAZY DOG.", "en", "s", 44),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark: SparkSession, rows: list[tuple] = ROWS) -> DataFrame:
    """The rows with columns named like those that operators make."""
    extra = ("row", "band", "id", "keys", "score", "kept", "n_tokens", "term", "bucket", "component", "doc", "found")
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", *[f"'x' AS `{name}`" for name in extra])


def texts(spark: SparkSession, *found: str | None) -> DataFrame:
    return documents(spark, [(k, text, "en", "s", 0) for k, text in enumerate(found)])


def by_id(df: DataFrame) -> dict:
    return {row["doc_id"]: row for row in df.collect()}
