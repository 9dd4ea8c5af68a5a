"""Writers for scored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ebbtide.operators.reports import result_table


def write_results_csv(scored: DataFrame, path: str) -> None:
    """Flat scored rows as CSV part files with headers; every task writes its own part."""
    result_table(scored).write.mode("overwrite").option("header", True).csv(path)
