"""Score files as they arrive.

Scoring is stateless, so each micro-batch runs the batch plan. The stream itself carries the names of new files; a
micro-batch reads them with the batch reader, so headers, missing columns and malformed cells are treated alike. It
writes its scored rows, its rejects and one monitoring row into directories named by batch id: a batch that is run again
after a failure overwrites itself. A second stream follows the monitoring rows and tells the change from batch to batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ebbtide.operators.checks import with_violations
from ebbtide.operators.monitoring import batch_figures, with_alerts
from ebbtide.plans.scoring import ChurnScorer
from ebbtide.sources.tables import read_customers

LOG_SCHEMA = "batch_time timestamp, total long, avg_prob double, high_risk_pct double, total_loss double"
LOGGED_SCHEMA = f"{LOG_SCHEMA}, alert boolean, probability_status string"
TREND_SCHEMA = (
    "scorer string, batch_id long, avg_prob double, high_risk_pct double, avg_prob_change double, high_risk_pct_change double, "
    "alert boolean, probability_status string"
)
TREND_STATE = "batch_id long, avg_prob double, high_risk_pct double"
FILES = "path string, modificationTime timestamp, length long, content binary"


def customer_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Names of the files that arrive in a directory; their content is not read here."""
    reader = spark.readStream.schema(FILES).format("binaryFile")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path).select("path")


def write_files(scorer: ChurnScorer, files: DataFrame, fmt: str, batch_id: int, out: str, reasons: str = "rules") -> None:
    """One batch of files (column ``path``); their number is bounded by the stream's files_per_batch."""
    paths = sorted(row["path"] for row in files.distinct().collect())
    if paths:
        rows = read_customers(files.sparkSession, paths, fmt, with_label=False, malformed="collect")
        write_batch(scorer, rows, batch_id, out, reasons)


def write_batch(scorer: ChurnScorer, rows: DataFrame, batch_id: int, out: str, reasons: str = "rules") -> None:
    """One batch: its rows are read and checked once; the figures of the log are observed while the scored rows are written."""
    spark = rows.sparkSession
    checked = with_violations(rows).persist()
    figures = Observation()
    scored = scorer.score(checked.filter(F.size("violations") == 0).drop("violations"), reasons)
    scored.observe(figures, *batch_figures()).write.mode("overwrite").parquet(f"{out}/scored/batch_id={batch_id}")
    checked.filter(F.size("violations") > 0).write.mode("overwrite").parquet(f"{out}/rejects/batch_id={batch_id}")
    checked.unpersist()
    seen = figures.get
    rows_of_log = [(datetime.now(timezone.utc), seen["total"], seen["avg_prob"], seen["high_risk_pct"], seen["total_loss"])] if seen["total"] else []
    entry = with_alerts(spark.createDataFrame(rows_of_log, LOG_SCHEMA))
    entry.coalesce(1).write.mode("overwrite").parquet(f"{out}/log/batch_id={batch_id}")


def start_scoring(
    scorer: ChurnScorer, stream: DataFrame, fmt: str, out: str, checkpoint: str, available_now: bool = False, reasons: str = "rules"
) -> StreamingQuery:
    """Score the files of ``customer_stream`` in the given format."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda files, batch_id: write_files(scorer, files, fmt, batch_id, out, reasons)
    )
    return writer.trigger(availableNow=True).start() if available_now else writer.start()


def _changes(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The change of each batch against the one before it; the last record is the state. A batch seen before is left out."""
    last = state.get if state.exists else None
    rows = pd.concat(list(parts)).drop_duplicates("batch_id").sort_values("batch_id")
    out = []
    for row in rows.itertuples():
        if last is not None and row.batch_id <= last[0]:
            continue
        change = (None, None) if last is None else (row.avg_prob - last[1], row.high_risk_pct - last[2])
        out.append((*key, row.batch_id, row.avg_prob, row.high_risk_pct, *change, row.alert, row.probability_status))
        last = (row.batch_id, row.avg_prob, row.high_risk_pct)
    if out:
        state.update(last)
        yield pd.DataFrame(out, columns=[part.split()[0] for part in TREND_SCHEMA.split(", ")])


def start_trend(
    spark: SparkSession, logs: dict[str, str], out: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Trend and alerts of running scorers: follows their monitoring logs (folder by scorer's name) and appends to ``out``.

    The state holds one record per scorer, so a restart goes on from the last batch seen.
    """
    parts = [spark.readStream.schema(f"{LOGGED_SCHEMA}, batch_id long").parquet(f"{folder}/log").withColumn("scorer", F.lit(name)) for name, folder in logs.items()]
    entries = reduce(DataFrame.unionByName, parts).select("scorer", "batch_id", "avg_prob", "high_risk_pct", "alert", "probability_status")
    trend = entries.groupBy("scorer").applyInPandasWithState(_changes, TREND_SCHEMA, TREND_STATE, "append", GroupStateTimeout.NoTimeout)
    writer = trend.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", out)
    return writer.trigger(availableNow=True).start() if available_now else writer.start()


def monitoring_log(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/log")
