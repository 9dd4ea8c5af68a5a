"""Split, folds, samples and medians: exact quotas, disjoint parts, hot keys and values."""

import random

import pytest
from pyspark.sql import functions as F

from ebbtide.operators import selection as S
from tests.conftest import plan_of


@pytest.fixture(scope="module")
def people(spark):
    rows = [(f"id{i}", int(i % 10 < 3)) for i in range(1003)]
    return spark.createDataFrame(rows, "customer_id string, churn int").repartition(5).persist()


def test_split_quotas(people):
    counts = {(r["split"], r["churn"]): r["count"] for r in S.stratified_split(people).groupBy("split", "churn").count().collect()}
    assert counts[("test", 0)] + counts[("test", 1)] == 201
    assert {c: counts[("test", c)] for c in (0, 1)} == S.test_quotas({0: 700, 1: 303}, 0.2)
    assert sum(counts.values()) == 1003


def test_quotas_by_largest_remainder():
    assert S.test_quotas({0: 700, 1: 303}, 0.2) == {0: 140, 1: 61}
    assert S.test_quotas({0: 5, 1: 5}, 0.25) == {0: 1, 1: 2}
    assert S.test_quotas({0: 1}, 0.2) == {0: 1}


def test_split_is_repeatable_and_seeded(people):
    first = S.stratified_split(people).filter("split = 'test'").select("customer_id")
    again = S.stratified_split(people.repartition(3)).filter("split = 'test'").select("customer_id")
    other = S.stratified_split(people, seed=7).filter("split = 'test'").select("customer_id")
    assert first.exceptAll(again).count() == 0
    assert 0 < first.exceptAll(other).count()


def test_membership_needs_no_exchange(people):
    assert "Exchange" not in plan_of(S.stratified_folds(S.stratified_split(people.sparkSession.range(100).select(
        F.col("id").cast("string").alias("customer_id"), (F.col("id") % 2).cast("int").alias("churn")))))


def test_folds(people):
    counts = {(r["fold"], r["churn"]): r["count"] for r in S.stratified_folds(people, 5).groupBy("fold", "churn").count().collect()}
    for c, n in ((0, 700), (1, 303)):
        sizes = [counts[(i, c)] for i in range(5)]
        assert sum(sizes) == n and max(sizes) - min(sizes) <= 1
    totals = [counts[(i, 0)] + counts[(i, 1)] for i in range(5)]
    assert max(totals) - min(totals) <= 1


def test_copies_of_a_hot_key_stay_together(spark):
    rows = [("hot", 0)] * 400 + [(f"id{i}", int(i % 2)) for i in range(800)]
    df = spark.createDataFrame(rows, "customer_id string, churn int")
    parts = S.stratified_split(df)
    assert parts.count() == 1200
    assert parts.filter("customer_id = 'hot'").select("split").distinct().count() == 1
    assert S.stratified_folds(df).filter("customer_id = 'hot'").select("fold").distinct().count() == 1
    tests = {r["churn"]: r["count"] for r in parts.filter("split = 'test'").groupBy("churn").count().collect()}
    assert tests[1] == 80


@pytest.mark.parametrize("n, hot", [(1, 0), (2, 0), (999, 0), (1000, 400)])
def test_exact_medians(spark, n, hot):
    rng = random.Random(n)
    values = [5.25] * hot + [rng.lognormvariate(0, 9) for _ in range(n - hot)]
    rows = [(v, None if i % 3 else float(i)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "a double, b double")
    got = S.exact_medians(df, ["a", "b"])
    want = df.select(F.median("a"), F.median("b")).first()
    assert got["a"] == want[0] and got["b"] == want[1]


def test_median_of_nothing(spark):
    assert S.exact_medians(spark.createDataFrame([(None,)], "a double"), ["a"]) == {"a": None}


def test_many_bins_are_narrowed_exactly(spark):
    df = spark.range(50_000).select((F.col("id") * 7919 % 50_000).alias("v"), F.lit("g").alias("g"))
    ranks = [0, 1, 24_999, 49_999]
    found = S.order_statistics(df, S.summaries(df), {"g": ranks})
    assert [found[("g", r)] for r in ranks] == ranks


def test_too_many_classes(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("customer_id"), F.col("id").alias("churn"))
    with pytest.raises(ValueError, match="classes"):
        S.stratified_split(df)


def test_missing_labels_are_refused(spark):
    df = spark.createDataFrame([("a", 1), ("b", 0), ("c", None)], "customer_id string, churn int")
    for dealt in (S.stratified_split, S.stratified_folds):
        with pytest.raises(ValueError, match="NULL"):
            dealt(df)


@pytest.mark.parametrize(
    "values",
    [
        [float("nan"), 1.0, 2.0, float("inf"), 3.0],
        [float("-inf")] * 3 + [float("inf")] * 4,
        [-1.7e308, 1.7e308, 0.0, 1.0, 5.0],
        [10.0**k for k in range(-100, 100)],
        [1.0] * 500 + [2.0] * 500,
    ],
)
def test_medians_take_few_passes_whatever_the_values(spark, values, monkeypatch):
    passes = []
    for name in ("summaries", "_counts", "_inside"):
        monkeypatch.setattr(S, name, lambda rows, *rest, f=getattr(S, name): passes.append(1) or f(rows, *rest))
    got = S.exact_medians(spark.createDataFrame([(v,) for v in values], "a double"), ["a"])["a"]
    real = sorted(v for v in values if v == v)
    want = (real[(len(real) - 1) // 2], real[len(real) // 2])
    assert got == (want[0] if len(real) % 2 else (want[0] + want[1]) / 2) and len(passes) <= 3


def test_search_goes_on_where_the_bracket_is_large(spark, monkeypatch):
    monkeypatch.setattr(S, "FINISH_VALUES", 50)
    df = spark.range(40_000).select((F.col("id") * 7919 % 40_000).cast("double").alias("v"), F.lit("g").alias("g"))
    ranks = [0, 17, 20_000, 39_998]
    found = S.order_statistics(df, S.summaries(df), {"g": ranks})
    assert [found[("g", r)] for r in ranks] == ranks


def test_sample(people):
    drawn = S.hashed_sample(people, 100)
    assert drawn.count() == 100 and drawn.select("customer_id").distinct().count() == 100
    assert drawn.exceptAll(S.hashed_sample(people.repartition(2), 100)).count() == 0
    assert S.hashed_sample(people, 5000).count() == 1003


def test_lowest_hashed(people):
    for quota in (0, 1, 500, 1003, 2000):
        assert people.filter(S.lowest_hashed(people, quota, "x")).count() == min(quota, 1003)
