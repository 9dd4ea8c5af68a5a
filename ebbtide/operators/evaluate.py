"""Classifier metrics as aggregations: confusion counts, ROC-AUC, average precision, profit by threshold, fold summary.

Ranking metrics first reduce the rows to one row per distinct score, so ties and hot scores are handled before any
ordering, and write that table once. The ordering then runs inside score buckets of about BUCKET_ROWS distinct scores,
as many as that takes; what lies above a bucket comes from a table with one row per bucket. A NULL group is a group.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.functions.risk import CHURN_THRESHOLD
from ebbtide.session import cut_lineage
from ebbtide.sources.schema import LABEL

BUCKET_ROWS = 100_000
DIGITS = 4


def confusion(df: DataFrame, score: str, label: str = LABEL, by: list[str] = ()) -> DataFrame:
    predicted, actual = F.col(score) >= CHURN_THRESHOLD, F.col(label) == 1
    return df.groupBy(*by).agg(
        F.count_if(predicted & actual).alias("tp"),
        F.count_if(predicted & ~actual).alias("fp"),
        F.count_if(~predicted & actual).alias("fn"),
        F.count_if(~predicted & ~actual).alias("tn"),
    )


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def _at_threshold(counts: DataFrame, by: list[str]) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        *by,
        _share(tp, tp + fp).alias("precision"),
        _share(tp, tp + fn).alias("recall"),
        _share(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def threshold_metrics(df: DataFrame, score: str, label: str = LABEL, by: list[str] = ()) -> DataFrame:
    """Precision, recall and F1 at 0.5; 0 where a denominator is 0."""
    return _at_threshold(confusion(df, score, label, by), by)


def score_groups(df: DataFrame, score: str, label: str = LABEL, by: list[str] = ()) -> DataFrame:
    """Positives and negatives per distinct score."""
    return (
        df.filter(F.col(score).isNotNull())
        .groupBy(*by, F.col(score).alias("score"))
        .agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    )


def _same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys where NULL equals NULL; the keys of the left side stay."""
    renamed = right.withColumnsRenamed({name: f"_{name}" for name in keys})
    same = [F.col(name).eqNullSafe(F.col(f"_{name}")) for name in keys]
    return left.join(renamed, same).drop(*[f"_{name}" for name in keys])


def cumulative_counts(groups: DataFrame, by: list[str] = (), bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Score groups with the positives and negatives that score strictly higher, and the totals.

    Reads ``groups`` several times: pass a written table.
    """
    buckets = max(1, math.ceil(groups.count() / bucket_rows))
    edges = []
    if buckets > 1:
        shares = [i / buckets for i in range(1, buckets)]
        edges = sorted(set(groups.approxQuantile("score", shares, 1 / (4 * buckets))))
    splits = [-math.inf, *edges, math.inf]
    bucketed = Bucketizer(splits=splits, inputCol="score", outputCol="bucket").transform(groups) if edges else (
        groups.withColumn("bucket", F.lit(0.0))
    )
    keys = [*by, "bucket"]
    higher = Window.partitionBy(*by).orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(*by)
    totals = bucketed.groupBy(*keys).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    offsets = totals.select(
        *keys,
        F.coalesce(F.sum("p").over(higher), F.lit(0)).alias("p_before"),
        F.coalesce(F.sum("n").over(higher), F.lit(0)).alias("n_before"),
        F.sum("p").over(everything).alias("total_pos"),
        F.sum("n").over(everything).alias("total_neg"),
    )
    inside = Window.partitionBy(*keys).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    ranked = bucketed.withColumns(
        {
            "p_inside": F.coalesce(F.sum("pos").over(inside), F.lit(0)),
            "n_inside": F.coalesce(F.sum("neg").over(inside), F.lit(0)),
        }
    )
    return _same_keys(ranked, offsets, keys).select(
        *by, "score", "pos", "neg", "total_pos", "total_neg",
        (F.col("p_before") + F.col("p_inside")).alias("pos_above"),
        (F.col("n_before") + F.col("n_inside")).alias("neg_above"),
    )


def _ranking(groups: DataFrame, by: list[str], bucket_rows: int) -> DataFrame:
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    beaten = neg * (F.col("pos_above") + pos / 2)
    caught = F.col("pos_above") + F.col("pos")
    flagged = caught + F.col("neg_above") + F.col("neg")
    sums = cumulative_counts(groups, by, bucket_rows).groupBy(*by).agg(
        F.sum(beaten).alias("beaten"),
        F.sum(pos * caught / flagged).alias("precision_sum"),
        F.max("total_pos").cast("double").alias("p"),
        F.max("total_neg").cast("double").alias("n"),
    )
    both = (F.col("p") > 0) & (F.col("n") > 0)
    return sums.select(
        *by,
        F.when(both, F.col("beaten") / (F.col("p") * F.col("n"))).alias("roc_auc"),
        F.when(both, F.col("precision_sum") / F.col("p")).alias("pr_auc"),
    )


def ranking_metrics(
    df: DataFrame, score: str, label: str = LABEL, by: list[str] = (), bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """Tie-corrected ROC-AUC and step-wise average precision; NULL without both classes."""
    return _ranking(cut_lineage(score_groups(df, score, label, by)), list(by), bucket_rows)


def all_metrics(df: DataFrame, score: str, label: str = LABEL, by: list[str] = ()) -> DataFrame:
    """ROC-AUC, average precision, precision, recall and F1, to 4 digits; one row per ``by`` group.

    The rows are read once: every metric comes from the written score groups.
    """
    by = list(by)
    keys = by or ["one"]
    groups = cut_lineage(score_groups(df, score, label, by))
    groups = groups if by else groups.withColumn("one", F.lit(1))
    above = F.col("score") >= CHURN_THRESHOLD
    counts = groups.groupBy(*keys).agg(
        F.sum(F.when(above, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(above, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(~above, F.col("pos")).otherwise(0)).alias("fn"),
    )
    joined = _same_keys(_ranking(groups, keys, BUCKET_ROWS), _at_threshold(counts, keys), keys)
    names = ["roc_auc", "pr_auc", "precision", "recall", "f1"]
    return joined.select(*by, *[F.bround(name, DIGITS).alias(name) for name in names])


def fold_summary(scores: DataFrame, score: str = "roc_auc", by: list[str] = ()) -> DataFrame:
    """Mean and population standard deviation of fold scores."""
    return scores.groupBy(*by).agg(F.avg(score).alias("cv_mean"), F.stddev_pop(score).alias("cv_std"))


def profit_curve(
    df: DataFrame, score: str, saved_value: float, contact_cost: float, label: str = LABEL
) -> DataFrame:
    """Profit of contacting everyone who scores at least as high, for every distinct score."""
    groups = cut_lineage(score_groups(df, score, label))
    contacted_pos = F.col("pos_above") + F.col("pos")
    contacted = contacted_pos + F.col("neg_above") + F.col("neg")
    profit = contacted_pos * F.lit(float(saved_value)) - contacted * F.lit(float(contact_cost))
    return cumulative_counts(groups).select(
        F.col("score").alias("threshold"),
        contacted.alias("contacted"),
        contacted_pos.alias("caught"),
        profit.alias("profit"),
    )


def best_threshold(curve: DataFrame) -> DataFrame:
    """The most profitable threshold; the higher one among equals."""
    return curve.orderBy(F.desc("profit"), F.desc("threshold")).limit(1)
