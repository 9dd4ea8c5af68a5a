"""Metrics on ties, one class, empty input, several buckets and groups."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbtide.operators import evaluate as E
from ebbtide.operators.gates import all_passed, failed_rules, model_gates


def frame(spark, pairs):
    return spark.createDataFrame([(float(p), int(y)) for p, y in pairs], "p double, churn int")


def areas(scores, labels):
    """Pairwise ROC-AUC and step-wise average precision."""
    s, y = np.array(scores), np.array(labels)
    diff = s[y == 1][:, None] - s[y == 0][None, :]
    auc = (np.sum(diff > 0) + 0.5 * np.sum(diff == 0)) / diff.size
    precision = sum(np.sum((s == t) & (y == 1)) * np.mean(y[s >= t]) for t in np.unique(s)) / y.sum()
    return auc, precision


def test_ties(spark):
    row = E.ranking_metrics(frame(spark, zip([0.1, 0.4, 0.4, 0.8], [0, 0, 1, 1])), "p").first()
    assert row["roc_auc"] == 0.875


def test_degenerate_inputs(spark):
    assert E.ranking_metrics(frame(spark, [(0.3, 0), (0.3, 1), (0.3, 1)]), "p").first()["roc_auc"] == 0.5
    assert E.ranking_metrics(frame(spark, [(0.3, 1), (0.4, 1)]), "p").first()["roc_auc"] is None
    assert E.ranking_metrics(frame(spark, []), "p").first()["roc_auc"] is None
    row = E.threshold_metrics(frame(spark, [(0.3, 0), (0.4, 0)]), "p").first()
    assert (row["precision"], row["recall"], row["f1"]) == (0.0, 0.0, 0.0)
    empty = E.threshold_metrics(frame(spark, []), "p").first()
    assert (empty["precision"], empty["f1"]) == (0.0, 0.0)


@pytest.mark.parametrize("bucket_rows", [3, 50, 100_000])
def test_buckets_do_not_change_the_result(spark, bucket_rows):
    rng = random.Random(7)
    pairs = [(0.5 if i % 3 == 0 else round(rng.random(), 2), int(rng.random() < 0.4)) for i in range(900)]
    want = areas(*zip(*pairs))
    row = E.ranking_metrics(frame(spark, pairs), "p", bucket_rows=bucket_rows).first()
    assert (row["roc_auc"], row["pr_auc"]) == pytest.approx(want)


def test_by_group(spark):
    rng = random.Random(8)
    pairs = [(round(rng.random(), 2), int(rng.random() < 0.4)) for i in range(600)]
    df = frame(spark, pairs).withColumn("fold", F.when(F.col("p") > 0.6, 1).otherwise(0))
    for row in E.ranking_metrics(df, "p", by=["fold"], bucket_rows=9).collect():
        part = [(p, y) for p, y in pairs if (p > 0.6) == (row["fold"] == 1)]
        assert (row["roc_auc"], row["pr_auc"]) == pytest.approx(areas(*zip(*part)))


def test_all_metrics_in_one_row(spark):
    pairs = [(0.9, 1), (0.8, 0), (0.7, 1), (0.5, 1), (0.4, 1), (0.2, 0), (0.1, 0)]
    row = E.all_metrics(frame(spark, pairs), "p").first()
    auc, precision = areas(*zip(*pairs))
    assert (row["roc_auc"], row["pr_auc"]) == (round(auc, 4), round(precision, 4))
    assert (row["precision"], row["recall"], row["f1"]) == (0.75, 0.75, 0.75)


def test_fold_summary_uses_population_deviation(spark):
    scores = spark.createDataFrame([(0.8,), (0.9,)], "roc_auc double")
    row = E.fold_summary(scores).first()
    assert row["cv_mean"] == pytest.approx(0.85) and row["cv_std"] == pytest.approx(0.05)


def test_profit(spark):
    curve = E.profit_curve(frame(spark, [(0.9, 1), (0.5, 0), (0.5, 1), (0.1, 0)]), "p", 100, 40)
    rows = [tuple(r) for r in curve.orderBy(F.desc("threshold")).collect()]
    assert rows == [(0.9, 1, 1, 60.0), (0.5, 3, 2, 80.0), (0.1, 4, 2, 40.0)]
    assert E.best_threshold(curve).first()["threshold"] == 0.5


def test_model_gates(spark):
    metrics = spark.createDataFrame([("good", 0.8, 0.55), ("weak", 0.7999, 0.6), ("none", None, 0.6)], "run_id string, roc_auc double, pr_auc double")
    gates = model_gates(metrics, ["run_id"])
    assert all_passed(gates.filter("run_id = 'good'"))
    assert failed_rules(gates.filter("run_id = 'weak'")) == ["roc_auc"]
    assert failed_rules(gates.filter("run_id = 'none'")) == ["roc_auc"]
