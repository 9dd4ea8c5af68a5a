"""Exact neighbours and over-sampling against brute force, with copies and small blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbtide.operators.neighbour_descent import descended_neighbours, meetings
from ebbtide.operators.neighbours import distinct_points, leaving_out, nearest_neighbours, neighbours_by_fold, partitioned_neighbours, squared_distances
from ebbtide.operators.smote import oversample, synthetic_rows
from tests.conftest import plan_of


def frame(spark, ids, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in zip(ids, x)], "id string, vec array<double>")


def brute_force(ids, x, k):
    squared = squared_distances(x, x)
    return {
        own: [j for _, j in sorted((squared[i, m], j) for m, j in enumerate(ids) if j != own)][:k]
        for i, own in enumerate(ids)
    }


def check(spark, x, k=5, **sizes):
    ids = [f"p{i:04d}" for i in range(len(x))]
    found = nearest_neighbours(frame(spark, ids, x), k, **sizes).collect()
    assert {r["id"]: [n["id"] for n in r["near"]] for r in found} == brute_force(ids, x, k)
    position = {i: row for i, row in zip(ids, x)}
    for r in found:
        assert [n["d2"] for n in r["near"]] == sorted(n["d2"] for n in r["near"])
        assert all(list(n["vec"]) == list(position[n["id"]]) for n in r["near"])


def test_one_block(spark):
    check(spark, np.random.default_rng(1).normal(size=(300, 6)))


def test_many_small_blocks_and_chunks(spark):
    check(spark, np.random.default_rng(2).normal(size=(600, 3)) * [1, 50, 5], block_rows=20, chunk_points=7)


def test_a_third_are_copies(spark):
    x = np.random.default_rng(3).normal(size=(600, 4))
    x[::3] = x[0]
    check(spark, x, block_rows=30, chunk_points=10)


def test_ties_on_a_grid_and_constant_columns(spark):
    grid = np.array([[a, b, 1.0] for a in range(20) for b in range(20)], dtype=float)
    check(spark, grid, block_rows=25)


def test_widest_column_is_mostly_one_value(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 3))
    x[:, 0] = np.where(rng.random(500) < 0.9, 1000.0, 0.0)
    check(spark, x, block_rows=25)


def test_clusters_and_outliers(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(400, 2)) * 0.001, rng.normal(size=(100, 2)) + 1000, [[1e6, -1e6]]])
    check(spark, x, block_rows=16)


def test_fewer_points_than_neighbours(spark):
    found = nearest_neighbours(frame(spark, ["a", "b"], np.array([[0.0], [1.0]])), 5).collect()
    assert {r["id"]: [n["id"] for n in r["near"]] for r in found} == {"a": ["b"], "b": ["a"]}


def test_copies_are_limited_before_the_exchange(spark):
    plan = plan_of(distinct_points(frame(spark, ["a"], np.array([[1.0]])), 5))
    assert plan.count("WindowGroupLimit") == 2


def test_no_pairing_without_a_key(spark):
    plan = plan_of(nearest_neighbours(frame(spark, [str(i) for i in range(200)], np.arange(200.0)[:, None]), 3, block_rows=10))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def recall(spark, x, search=partitioned_neighbours, **sizes):
    ids = [f"p{i:05d}" for i in range(len(x))]
    found = {r["id"]: [n["id"] for n in r["near"]] for r in search(frame(spark, ids, x), 5, **sizes).collect()}
    assert set(found) == set(ids) and all(len(f) == 5 and i not in f for i, f in found.items())
    asked = range(0, len(x), 50)
    squared = squared_distances(x[::50], x)
    hits = 0
    for row, i in zip(squared, asked, strict=True):
        row[i] = np.inf
        hits += len({ids[j] for j in np.argsort(row, kind="stable")[:5]} & set(found[ids[i]]))
    return hits / (5 * len(asked))


def test_partitioned_search_has_a_stated_recall(spark):
    """Five columns that hang together, as churn features do: at least 0.9; 18 independent ones: at least 0.3."""
    rng = np.random.default_rng(8)
    assert recall(spark, (rng.normal(size=(4000, 2)) @ rng.normal(size=(2, 5))) + 0.01 * rng.normal(size=(4000, 5)), block_rows=500) >= 0.9
    assert recall(spark, rng.normal(size=(4000, 18)), block_rows=500) >= 0.3


def test_partitioned_search_with_copies_and_few_points(spark):
    x = np.random.default_rng(9).normal(size=(600, 4))
    x[::3] = x[0]
    assert recall(spark, x, block_rows=100, trees=3) > 0.5
    found = partitioned_neighbours(frame(spark, ["a", "b"], np.array([[0.0], [1.0]])), 5).collect()
    assert {r["id"]: [n["id"] for n in r["near"]] for r in found} == {"a": ["b"], "b": ["a"]}


def test_descent_finds_nine_in_ten(spark):
    """The same two kinds of columns as above: at least 0.9 on both, with blocks far smaller than the table."""
    rng = np.random.default_rng(8)
    hanging = (rng.normal(size=(3000, 2)) @ rng.normal(size=(2, 5))) + 0.01 * rng.normal(size=(3000, 5))
    assert recall(spark, hanging, descended_neighbours, block_rows=256) >= 0.9
    assert recall(spark, rng.normal(size=(3000, 18)), descended_neighbours, block_rows=256) >= 0.9


def test_descent_meets_a_bounded_number_of_points_at_any_size(spark):
    """Distances of a round per point do not grow with the table, also with a point that everybody lists."""
    rng, pool, most = np.random.default_rng(3), 6, []
    for n in (400, 1600):
        x = rng.normal(size=(n, 128))
        x /= np.linalg.norm(x, axis=1)[:, None]
        x[0] = 0  # nearer to all than they are to each other
        ids = [f"p{i:05d}" for i in range(n)]
        points = distinct_points(frame(spark, ids, x), pool).withColumn("point", F.col("first_id"))
        exact = nearest_neighbours(frame(spark, ids, x), pool).select(F.col("id").alias("point"), F.explode("near").alias("n"))
        graph = exact.select("point", F.col("n.id").alias("other"), F.col("n.d2").alias("d2")).cache()
        assert graph.groupBy("other").count().agg(F.max("count")).first()[0] > 0.6 * n
        sizes = [r["n"] for r in meetings(graph, points, pool).select(F.size("met").alias("n")).collect()]
        most.append((max(sizes), np.mean(np.square(sizes))))
        assert len(sizes) == n and max(sizes) <= 2 * pool + 1
    assert most[1][1] < 1.2 * most[0][1]


def test_descent_with_copies_few_points_and_ties(spark):
    x = np.random.default_rng(9).normal(size=(600, 4))
    x[::3] = x[0]
    assert recall(spark, x, descended_neighbours, block_rows=100) > 0.9
    found = descended_neighbours(frame(spark, ["a", "b"], np.array([[0.0], [1.0]])), 5).collect()
    assert {r["id"]: [n["id"] for n in r["near"]] for r in found} == {"a": ["b"], "b": ["a"]}
    with pytest.raises(ValueError, match="no rows"):
        descended_neighbours(frame(spark, ["a"], np.array([[0.0]])).limit(0))


def test_descent_keeps_the_distances_and_order_of_the_exact_search(spark):
    x = np.random.default_rng(12).normal(size=(500, 3))
    ids = [f"p{i:05d}" for i in range(500)]
    exact = {r["id"]: r["near"] for r in nearest_neighbours(frame(spark, ids, x), 4).collect()}
    found = {r["id"]: r["near"] for r in descended_neighbours(frame(spark, ids, x), 4, rounds=5, block_rows=100).collect()}
    assert sum(found[i] == exact[i] for i in ids) >= 480


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(5)
    rows = [(f"c{i}", float(a), float(b), int(i < 60)) for i, (a, b) in enumerate(rng.normal(size=(200, 2)) * [1, 100])]
    return spark.createDataFrame(rows, "customer_id string, a double, `b c` double, churn int").persist()


def test_oversampling_balances_and_interpolates(spark, labelled):
    made = synthetic_rows(labelled, ["a", "b c"]).collect()
    assert len(made) == 80 and len({r["customer_id"] for r in made}) == 80
    uses = np.unique([r["seed_id"] for r in made], return_counts=True)[1]
    assert len(uses) == 60 and set(uses) <= {1, 2}
    points = {r["customer_id"]: np.array([r["a"], r["b c"]]) for r in labelled.filter("churn = 1").collect()}
    ids, x = list(points), np.array(list(points.values()))
    near = brute_force(ids, x, 5)
    for r in made:
        assert r["neighbour_id"] in near[r["seed_id"]] and 0 <= r["gap"] < 1
        seed, other = points[r["seed_id"]], points[r["neighbour_id"]]
        assert np.allclose([r["a"], r["b c"]], seed + r["gap"] * (other - seed))
    more = oversample(labelled, ["a", "b c"])
    assert {r["churn"]: r["count"] for r in more.groupBy("churn").count().collect()} == {0: 140, 1: 140}
    assert more.filter(~F.col("customer_id").startswith("syn-")).count() == 200


def test_oversampling_limits(spark, labelled):
    few = labelled.filter("churn = 0").unionByName(labelled.filter("churn = 1").limit(5))
    with pytest.raises(ValueError, match="too few"):
        oversample(few, ["a", "b c"])
    with pytest.raises(ValueError, match="two classes"):
        oversample(labelled.filter("churn = 0"), ["a", "b c"])
    assert oversample(labelled, ["a", "b c"], search=partitioned_neighbours).count() == 280
    assert oversample(labelled, ["a", "b c"], search=descended_neighbours).count() == 280
    even = labelled.filter("churn = 1").unionByName(labelled.filter("churn = 0").limit(60))
    assert oversample(even, ["a", "b c"]).count() == 120


def test_copies_of_one_churner(spark, labelled):
    copies = labelled.filter("customer_id = 'c0'").crossJoin(spark.range(30)).select(
        F.concat("customer_id", F.lit("-"), "id").alias("customer_id"), "a", "b c", "churn"
    )
    more = oversample(labelled.unionByName(copies), ["a", "b c"])
    assert {r["churn"]: r["count"] for r in more.groupBy("churn").count().collect()} == {0: 140, 1: 140}


def test_one_search_serves_every_left_out_fold(spark):
    """As if each fold had been searched by itself, with copies across folds, ties, a row without a fold, small blocks and chunks."""
    rng = np.random.default_rng(14)
    x = np.round(rng.normal(size=(400, 3)) * [1, 20, 3])
    x[::4] = x[0]
    folds = [int(f) for f in rng.integers(0, 3, 400)]
    folds[7] = None
    rows = spark.createDataFrame([(f"p{i:04d}", [float(v) for v in r], f) for i, (r, f) in enumerate(zip(x, folds, strict=True))], "id string, vec array<double>, fold int")
    for block_rows in (30, 2048):
        lists = neighbours_by_fold(rows, 3, 4, block_rows=block_rows, chunk_points=9)
        for fold in (0, 1, 2, None):
            inside = rows if fold is None else rows.filter(F.col("fold") != fold)
            alone = {r["id"]: r["near"] for r in nearest_neighbours(inside.select("id", "vec"), 4).collect()}
            assert {r["id"]: r["near"] for r in leaving_out(lists, fold, 4).collect()} == alone
            keep = [i for i, f in enumerate(folds) if fold is None or f not in (fold, None)]
            ids = [f"p{i:04d}" for i in keep]
            assert {i: [n["id"] for n in near] for i, near in alone.items()} == brute_force(ids, x[keep], 4)


def test_distances_far_from_the_origin_stay_exact(spark):
    """Products alone would round these gaps away."""
    check(spark, 1e8 + np.random.default_rng(15).integers(0, 40, size=(300, 3)), block_rows=40)
    check(spark, np.random.default_rng(16).normal(size=(60, 2)) * 1e150, block_rows=2048)
