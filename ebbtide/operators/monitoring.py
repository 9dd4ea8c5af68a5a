"""One monitoring row per scored batch, its alerts, its trend, and the append-only log."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.functions.risk import ALERT_HIGH_RISK_PCT, ALERT_MEAN_PROBABILITY_PCT
from ebbtide.functions.rounding import round_even, round_exact
from ebbtide.operators.reports import high_risk, sum_of_cents

# Headings of the history table.
HISTORY_HEADINGS = {
    "batch_id": "Batch",
    "batch_time": "Time",
    "total": "Customers",
    "avg_prob": "Avg Prob (%)",
    "high_risk_pct": "High-Risk (%)",
    "total_loss": "Expected Loss ($)",
}


def batch_figures() -> list[Column]:
    """The aggregates of a batch of scored rows."""
    probability = round_exact(F.col("churn_probability"), 4)
    share = F.try_divide(F.count_if(high_risk()).cast("double"), F.count("*").cast("double"))
    return [
        F.count("*").alias("total"),
        round_even(F.avg(probability) * F.lit(100.0), 2).alias("avg_prob"),
        round_even(share * F.lit(100.0), 2).alias("high_risk_pct"),
        sum_of_cents("expected_revenue_loss").alias("total_loss"),
    ]


def batch_log(scored: DataFrame, batch: str = "batch_id", time: datetime | None = None) -> DataFrame:
    """Rows, mean probability, high-risk share and loss per batch; probabilities enter with 4 digits.

    ``time`` is the time of the batch, the same for all of its rows; it becomes the column ``batch_time``.
    """
    stamp = [] if time is None else [F.lit(time).cast("timestamp").alias("batch_time")]
    return scored.groupBy(batch, *stamp).agg(*batch_figures())


def with_alerts(log: DataFrame) -> DataFrame:
    return log.withColumns(
        {
            "alert": F.col("high_risk_pct") > ALERT_HIGH_RISK_PCT,
            "probability_status": F.when(F.col("avg_prob") > ALERT_MEAN_PROBABILITY_PCT, "HIGH").otherwise("OK"),
        }
    )


def trend(log: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Change against the batch before. The log has one row per batch, never one per customer."""
    before = Window.orderBy(batch)
    return log.select(
        batch,
        "avg_prob",
        "high_risk_pct",
        (F.col("avg_prob") - F.lag("avg_prob").over(before)).alias("avg_prob_change"),
        (F.col("high_risk_pct") - F.lag("high_risk_pct").over(before)).alias("high_risk_pct_change"),
    )


def latest(log: DataFrame, batch: str = "batch_id") -> DataFrame:
    rest = [name for name in log.columns if name != batch]
    row = F.max_by(F.struct(batch, *rest), batch).alias("row")
    return log.agg(row).filter(F.col("row").isNotNull()).select("row.*")


def history(log: DataFrame, batch: str = "batch_id") -> DataFrame:
    """The log with report headings, latest batch first; the time is shown where the log has one."""
    names = {batch if n == "batch_id" else n: h for n, h in HISTORY_HEADINGS.items()}
    return log.orderBy(F.desc(batch)).select(*[F.col(n).alias(h) for n, h in names.items() if n in log.columns])


def append_log(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").parquet(path)
