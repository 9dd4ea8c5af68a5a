"""Trees grown together against a tree grown by hand, their objective, their sampling, and the six variants as a whole."""

import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbtide.operators import newton
from ebbtide.operators import node_rows as R
from ebbtide.operators import tree_growing as G
from ebbtide.operators import tree_models as T
from ebbtide.operators.classifiers import FitTables, build_variant, fit_many
from ebbtide.operators.tree_models import load_ensemble, probability_column, save_ensemble
from ebbtide.plans import training
from checks.derived import training_table
from tests.conftest import plan_of

FEATURES = ["a b", "c", "d", "e"]


@pytest.fixture(scope="module")
def table(spark):
    """600 rows of three fits: fit 2 is all rows, the others leave a half out; one feature is constant, one has few values."""
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.normal(size=600), rng.integers(0, 4, 600), np.full(600, 7.0), rng.uniform(0, 9, 600)])
    y = (rng.random(600) < 1 / (1 + np.exp(-(x[:, 0] * 2 + (x[:, 1] == 2) * 2 - 1)))).astype(int)
    rows = [(f"k{i}", *map(float, x[i]), int(y[i])) for i in range(600)]
    df = spark.createDataFrame(rows, "id string, `a b` double, c double, d double, e double, churn int")
    fits = F.array(F.lit(2), F.when(F.xxhash64("id") % 2 == 0, 0).otherwise(1))
    return df.withColumn("fit", F.explode(fits)).cache()


@pytest.fixture(scope="module")
def binned(table):
    return G.bin_rows(table, FEATURES, G.cut_points(table, FEATURES), "id", "churn")


def rows_of(binned, fit):
    rows = binned.table.where(f"fit = {fit}").toPandas()
    return rows["key"].to_numpy(), rows["label"].to_numpy().astype(float), np.array([list(b) for b in rows["bins"]])


def best_by_hand(bins, first, second, gain_of, allowed):
    """(gain, feature, cut) of the best split of some rows, by trying all of them."""
    best = (1e-9, None, None)
    whole = (first.sum(), second.sum())
    for feature in range(bins.shape[1]):
        for cut in range(bins[:, feature].max()):
            go = bins[:, feature] <= cut
            left, right = (first[go].sum(), second[go].sum()), (first[~go].sum(), second[~go].sum())
            if allowed(left) and allowed(right):
                gain = gain_of(left) + gain_of(right) - gain_of(whole)
                if gain > best[0] + 1e-9:
                    best = (gain, feature, cut)
    return best


def check_tree(ensemble, tree, cuts, bins, first, second, depth, gain_of, allowed, leaf, enough=lambda s: True):
    """Walks a grown tree and repeats every decision."""
    nodes = [(int(ensemble.roots[tree]), np.ones(len(bins), bool), 0)]
    seen = 0
    for node, inside, level in nodes:
        stats = (first[inside].sum(), second[inside].sum())
        gain, feature, cut = best_by_hand(bins[inside], first[inside], second[inside], gain_of, allowed)
        if level == depth or feature is None or not enough(stats):
            assert ensemble.feature[node] == -1 and ensemble.value[node] == pytest.approx(leaf(stats), abs=1e-9)
            seen += 1
            continue
        assert ensemble.gain[node] == pytest.approx(gain, rel=1e-6)
        f, threshold = int(ensemble.feature[node]), ensemble.threshold[node]
        go = bins[:, f] <= int(np.searchsorted(cuts[f], threshold))
        left = int(ensemble.left[node])
        nodes += [(left, inside & go, level + 1), (left + 1, inside & ~go, level + 1)]
    return seen


@pytest.mark.parametrize("fit", [0, 2])
def test_forest_trees_equal_trees_grown_by_hand(binned, fit):
    spec = G.Spec(fit, False, 3, 4, seed=5, min_samples_leaf=6, min_samples_split=20, max_features="all")
    forest = G.grow_forests(binned, [spec])[0]
    keys, labels, bins = rows_of(binned, fit)
    w0, w1 = binned.class_weights(fit)

    def gini(s):
        a, b = w0 * s[0], w1 * s[1]
        return (a * a + b * b) / (a + b) if a + b else 0.0

    for tree in range(3):
        bag = G.bag_counts(keys, 5, tree)
        leaves = check_tree(
            forest, tree, binned.cuts, bins, bag * (1 - labels), bag * labels, 4, gini, lambda s: sum(s) >= 6,
            lambda s: w1 * s[1] / (w0 * s[0] + w1 * s[1]), lambda s: sum(s) >= 20,
        )
        assert leaves > 4


@pytest.mark.parametrize("alpha,lam,child", [(0.0, 1.0, 1.0), (0.7, 3.0, 4.0), (0.0, 0.0, 0.0)])
def test_first_boosted_tree_equals_the_closed_form(binned, alpha, lam, child):
    spec = G.Spec(2, True, 1, 3, learning_rate=0.3, reg_alpha=alpha, reg_lambda=lam, min_child_weight=child)
    boosted = G.grow_boosted(binned, [spec])[0]
    _, labels, bins = rows_of(binned, 2)
    p = labels.mean()
    assert boosted.base == pytest.approx(math.log(p / (1 - p)))

    def shrunk(g):
        return math.copysign(max(abs(g) - alpha, 0), g)

    check_tree(
        boosted, 0, binned.cuts, bins, p - labels, np.full(len(labels), p * (1 - p)), 3, lambda s: shrunk(s[0]) ** 2 / (s[1] + lam) / 2,
        lambda s: s[1] >= child - 1e-9 and s[1] > 0, lambda s: -0.3 * shrunk(s[0]) / (s[1] + lam),
    )


def losses(binned, spec, rounds):
    _, labels, bins = rows_of(binned, spec.fit)
    found = []

    def watch(_, made):
        margin = math.log(labels.mean() / (1 - labels.mean())) + sum(
            G.leaf_values(spec, stats, np.ones(2))[0][G._places(bins, 0, spec.max_depth, feature, cut, left)] for feature, cut, left, _, stats in made[0]
        )
        found.append(np.mean(np.logaddexp(0, margin) - labels * margin))

    return G.grow_boosted(binned, [spec], watch)[0], found


def test_boosting_lowers_the_loss_every_round(binned, monkeypatch):
    monkeypatch.setattr(G, "ROUNDS_KEPT", 4)
    boosted, found = losses(binned, G.Spec(2, True, 14, 3, learning_rate=0.3), 14)
    assert len(found) == 14 and all(b < a for a, b in zip(found, found[1:]))
    assert len(boosted.roots) == 14


def test_written_margins_change_nothing(binned, monkeypatch):
    spec = G.Spec(1, True, 7, 3, learning_rate=0.3, subsample=0.7, colsample=0.6)
    whole = G.grow_boosted(binned, [spec])[0]
    monkeypatch.setattr(G, "ROUNDS_KEPT", 2)
    again = G.grow_boosted(binned, [spec])[0]
    assert np.array_equal(whole.feature, again.feature) and np.allclose(whole.value, again.value, atol=1e-12)


def test_gamma_takes_back_what_wins_less(binned):
    free, held = (G.grow_boosted(binned, [G.Spec(2, True, 1, 4, gamma=g, reg_lambda=1.0)])[0] for g in (0.0, 1.0))
    assert 1 < len(held.feature) < len(free.feature)
    last = [n for n in np.flatnonzero(held.feature >= 0) if held.feature[held.left[n]] < 0 and held.feature[held.left[n] + 1] < 0]
    assert last and all(held.gain[n] >= 1.0 for n in last)


def test_fits_grown_together_equal_fits_grown_alone(binned):
    specs = [G.Spec(0, False, 4, 5), G.Spec(2, False, 3, 3, seed=1, max_features=0.5), G.Spec(2, False, 2, 7, max_features="log2")]
    for made, alone in zip(G.grow_forests(binned, specs), [G.grow_forests(binned, [s])[0] for s in specs], strict=True):
        assert np.array_equal(made.feature, alone.feature) and np.array_equal(made.value, alone.value)
    boosting = [G.Spec(0, True, 3, 3), G.Spec(2, True, 5, 2, learning_rate=0.2), G.Spec(2, True, 2, 4, reg_lambda=5.0)]
    for made, alone in zip(G.grow_boosted(binned, boosting), [G.grow_boosted(binned, [s])[0] for s in boosting], strict=True):
        assert np.array_equal(made.feature, alone.feature) and np.allclose(made.value, alone.value, atol=1e-12)


def test_blocks_change_nothing(table, binned, monkeypatch):
    monkeypatch.setattr(G, "BLOCK_ROWS", 50)
    monkeypatch.setattr(G, "CHUNK", 4)
    many = G.bin_rows(table, FEATURES, binned.cuts, "id", "churn")
    assert many.table.rdd.getNumPartitions() > 3
    spec = G.Spec(2, False, 4, 6)
    a, b = G.grow_forests(binned, [spec])[0], G.grow_forests(many, [spec])[0]
    assert np.array_equal(a.feature, b.feature) and np.array_equal(a.threshold, b.threshold) and np.array_equal(a.value, b.value)


def test_fits_of_one_block_grow_in_one_job_like_fits_of_many(table, binned, monkeypatch):
    forests = [G.Spec(0, False, 4, 6, min_samples_leaf=3), G.Spec(2, False, 3, 4, seed=1, max_features=0.5)]
    boosting = [G.Spec(1, True, 6, 4, learning_rate=0.3, subsample=0.7, colsample=0.6, gamma=0.4, reg_alpha=0.2), G.Spec(2, True, 3, 2)]

    def by_jobs(*_):
        raise AssertionError("a job per level")

    with monkeypatch.context() as alone:
        alone.setattr(G, "_by_jobs", by_jobs)
        here = G.grow_forests(binned, forests) + G.grow_boosted(binned, boosting)
    monkeypatch.setattr(G, "BLOCK_ROWS", 400)  # fits 0 and 1 stay one block, fit 2 does not
    many = G.bin_rows(table, FEATURES, binned.cuts, "id", "churn")
    mixed = G.grow_forests(many, forests) + G.grow_boosted(many, boosting)
    monkeypatch.setattr(G, "BLOCK_ROWS", 50)
    far = G.grow_forests(many, forests) + G.grow_boosted(many, boosting)
    for a, b, c in zip(here, mixed, far, strict=True):
        for other in (b, c):
            assert np.array_equal(a.feature, other.feature) and np.array_equal(a.threshold, other.threshold) and np.array_equal(a.roots, other.roots)
            assert np.allclose(a.value, other.value, atol=1e-12) and np.allclose(a.cover, other.cover) and np.allclose(a.gain, other.gain)


def test_both_classes_are_summed_in_one_pass(monkeypatch):
    """Every row of a forest counts for one class, so a candidate takes one pass over the rows, and the sums stay those of two."""
    r = np.random.default_rng(5)
    rows, place = r.integers(0, 9, (400, 6)).astype(np.uint8), r.integers(0, 7, 400)
    candidates = np.stack([np.sort(r.choice(6, 3, replace=False)) for _ in range(7)])
    bag, label = r.integers(1, 4, 400), r.integers(0, 2, 400)
    first, second = bag * (1 - label), bag * label
    expected, passes, count = G._cell_sums(rows, place, candidates, 9, first, second, False), [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda *a, **k: (passes.append(1), count(*a, **k))[1])
    found = G._cell_sums(rows, place, candidates, 9, first, second, True)
    assert (found == expected).all() and found.sum() == 3 * bag.sum() and len(passes) == 3


def test_sums_of_picked_rows_and_of_rows_at_rest():
    """Rows can be picked without copying them, and rows past the last node of a boosted tree count nowhere."""
    r = np.random.default_rng(6)
    rows, place = r.integers(0, 9, (400, 6)).astype(np.uint8), r.integers(0, 8, 400)
    candidates = np.stack([np.sort(r.choice(6, 3, replace=False)) for _ in range(7)])
    live, weight, label = np.flatnonzero(place < 7), r.integers(1, 4, 400).astype(float), r.integers(0, 2, 400)
    expected = G._cell_sums(rows[live], place[live], candidates, 9, (weight * (1 - label))[live], (weight * label)[live], False)
    picked = G._cell_sums(rows, place[live], candidates, 9, (weight * (1 - label))[live], (weight * label)[live], True, live * 6)
    assert (picked == expected).all()
    shared = np.tile(candidates[:1], (7, 1))  # as in boosting: rows may lie feature by feature
    by_feature = G._cell_sums(np.asfortranarray(rows), place, shared, 9, weight * (1 - label), weight * label, False)
    assert (by_feature == G._cell_sums(rows[live], place[live], shared, 9, (weight * (1 - label))[live], (weight * label)[live], False)).all()


def test_models_fitted_beside_each_other_write_their_table_once(monkeypatch):
    from concurrent.futures import ThreadPoolExecutor
    from time import sleep

    from ebbtide.operators.classifiers import FitTables

    made = []
    monkeypatch.setattr(G, "cut_points", lambda *a: sleep(0.2))
    monkeypatch.setattr(G, "bin_rows", lambda *a: made.append(1) or sleep(0.2))
    tables = FitTables(None, ["a"])
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda _: tables.binned, range(2)))
    assert made == [1]


def test_nodes_stand_breadth_first_with_and_without_those_taken_back():
    feature, left = np.array([2, 0, 1, -1, -1, -1, -1]), np.array([1, 3, 5, -1, -1, -1, -1])
    assert G._breadth_first(feature, left).tolist() == [0, 1, 2, 3, 4, 5, 6]
    assert G._breadth_first(np.array([2, -1, 1, -1, -1, -1, -1]), left).tolist() == [0, 1, 2, 5, 6]


def test_bags_are_poisson_and_differ_by_tree():
    keys = np.random.default_rng(1).integers(-(2**62), 2**62, 40_000)
    some, other = G.bag_counts(keys, 1, 0), G.bag_counts(keys, 1, 1)
    assert abs(some.mean() - 1) < 0.02 and abs(some.var() - 1) < 0.03 and abs(np.corrcoef(some, other)[0, 1]) < 0.02
    assert np.array_equal(some, G.bag_counts(keys, 1, 0)) and abs(np.mean(G.unit_draws(keys, 2, 3) < 0.8) - 0.8) < 0.01


def test_saved_trees_score_alike(spark, table, binned, tmp_path):
    for k, made in enumerate((G.grow_forests(binned, [G.Spec(2, False, 3, 4)])[0], G.grow_boosted(binned, [G.Spec(2, True, 3, 3)])[0])):
        save_ensemble(spark, made, str(tmp_path / str(k)))
        loaded = load_ensemble(spark, str(tmp_path / str(k)))
        rows = table.where("fit = 2").select(probability_column(table, made, FEATURES).alias("p"), probability_column(table, loaded, FEATURES).alias("q")).collect()
        assert all(r["p"] == r["q"] and 0 < r["p"] < 1 for r in rows) and made.importances().sum() == pytest.approx(1)


def test_odd_tables_are_refused_or_grow_one_leaf(spark, table, binned):
    with pytest.raises(ValueError, match="binary"):
        G.bin_rows(table.withColumn("churn", F.lit(None).cast("int")), FEATURES, binned.cuts, "id", "churn")
    single = G.bin_rows(table.where("churn = 1"), FEATURES, binned.cuts, "id", "churn")
    forest = G.grow_forests(single, [G.Spec(0, False, 2, 4)])[0]
    assert len(forest.feature) == 2 and set(forest.value) == {1.0}
    with pytest.raises(ValueError, match="both classes"):
        G.grow_boosted(single, [G.Spec(0, True, 2, 4)])


def newton_by_hand(x, y, c):
    scale = x.std(axis=0)
    design = np.hstack([(x - x.mean(axis=0)) / np.where(scale > 0, scale, 1), np.ones((len(x), 1))])
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    beta, penalty = np.zeros(design.shape[1]), np.diag([1.0] * x.shape[1] + [0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-design @ beta))
        step = np.linalg.solve(c * (design * (w * p * (1 - p))[:, None]).T @ design + penalty, c * design.T @ (w * (p - y)) + penalty @ beta)
        beta -= step
    return beta


def test_newton_steps_of_all_fits_and_penalties_at_once(table, monkeypatch):
    passes = []
    plain = newton._pass
    monkeypatch.setattr(newton, "_pass", lambda *args: (passes.append(1), plain(*args))[1])
    rows = newton.fit_rows(table, FEATURES, "churn")
    specs = [newton.LogisticSpec(fit, c) for fit in (0, 1, 2) for c in (1e-3, 1.0, 100.0)]
    models = newton.fit_logistic(rows, specs)
    together = len(passes)
    for spec, model in zip(specs, models, strict=True):
        some = table.where(f"fit = {spec.fit}").select("`a b`", "c", "d", "e", "churn").toPandas().to_numpy()
        assert np.allclose([*model.coefficients, model.intercept], newton_by_hand(some[:, :-1], some[:, -1], spec.C), atol=1e-8)
    passes.clear()
    newton.fit_logistic(rows, specs[-1:])
    assert together <= len(passes) + 1 <= 14


def test_more_penalties_take_no_more_fits(table):
    tables = FitTables(table, FEATURES, key="id")
    found = fit_many(tables, [(2, build_variant("logistic_regression", False, C=c)) for c in (0.01, 1.0)] + [(0, build_variant("random_forest", False, n_estimators=2))])
    assert [f.variant.model for f in found] == ["logistic_regression", "logistic_regression", "random_forest"]
    assert np.abs(found[0].linear.coefficients).sum() < np.abs(found[1].linear.coefficients).sum()


def test_six_variants_cross_validated(spark, sf_dir):
    sets = training.prepare(training_table(spark, "/root/testdata/sf0.01"), folds=3)
    small = {"random_forest": {"n_estimators": 12}, "gradient_boosting": {"n_estimators": 12, "learning_rate": 0.3}}
    runs = training.train_all(sets, training.six_variants(overrides=small))
    assert [r.variant.run_id for r in runs] == [f"{m}_{s}" for m in ("logistic_regression", "random_forest", "gradient_boosting") for s in ("no_smote", "smote")]
    for run in runs:
        assert len(run.fold_scores) == 3 and run.cv_roc_auc == pytest.approx(np.mean(run.fold_scores)) and run.cv_roc_auc_std == pytest.approx(np.std(run.fold_scores))
        assert run.test["roc_auc"] >= 0.80 and run.cv_roc_auc > 0.78
        assert run.fit_rows[0] == run.fit_rows[1] if run.variant.smote else run.fit_rows[0] > run.fit_rows[1]
    frame = training.runs_frame(spark, runs)
    assert frame.where("cv_roc_auc IS NULL").count() == 0 and frame.count() == 6


def small_steps(monkeypatch):
    """Rows in the order of their nodes from the first row on, a few at a time, groups summed jointly from eight rows on."""
    for module, name, value in ((G, "SORTED_ROWS", 0), (G, "STEP", 64), (R, "STEP", 64), (R, "JOINT_ROWS", 8), (G, "TREES_A_TASK", 1)):
        monkeypatch.setattr(module, name, value)


def test_rows_in_order_of_their_nodes_grow_the_same_trees(binned, monkeypatch):
    forests = [G.Spec(0, False, 4, 6, min_samples_leaf=3), G.Spec(2, False, 7, 8, seed=1, max_features=0.5), G.Spec(2, False, 3, 0)]
    boosting = [
        G.Spec(1, True, 6, 4, learning_rate=0.3, subsample=0.7, colsample=0.6, gamma=0.4, reg_alpha=0.2), G.Spec(2, True, 5, 5, min_child_weight=3.0),
        G.Spec(2, True, 4, 3, gamma=5.0, learning_rate=0.4),
    ]
    plain = G.grow_forests(binned, forests) + G.grow_boosted(binned, boosting)
    small_steps(monkeypatch)
    monkeypatch.setattr(G, "_by_jobs", None)
    monkeypatch.setattr(G, "_tree_here", None)  # nothing is grown the other ways
    found = G.grow_forests(binned, forests) + G.grow_boosted(binned, boosting)
    for k, (a, b) in enumerate(zip(plain, found, strict=True)):
        same = np.array_equal if k < len(forests) else lambda x, y: np.allclose(x, y, rtol=1e-9, atol=1e-9)
        assert [name for name in ("roots", "feature", "left", "threshold") if not np.array_equal(getattr(a, name), getattr(b, name))] == [], k
        assert [name for name in ("value", "cover", "gain") if not same(getattr(a, name), getattr(b, name))] == [], k


def test_sums_do_not_depend_on_the_order_of_rows():
    """Sums of a boosted tree are exact: the same rows in another order grow the same trees to the last bit."""
    r = np.random.default_rng(9)
    bins, keys, labels = r.integers(0, 30, (900, 5)).astype(np.uint8), r.integers(-(2**62), 2**62, 900), r.integers(0, 2, 900).astype(float)
    layout, spec, grown = R.Layout.of([30] * 5), G.Spec(0, True, 5, 4, subsample=0.8, colsample=0.8), []
    for order in (np.arange(900), r.permutation(900)):
        trees = G._sorted_boosted(spec, keys[order], labels[order], layout.packed(bins[order]), layout, 0.1, 30)
        grown.append([np.concatenate([g.stats.ravel(), g.gain, g.feature, g.cut]) for g in trees])
    assert all(np.array_equal(a, b) for a, b in zip(*grown, strict=True))


def test_features_of_any_width_have_their_place_in_the_words():
    sizes = [64, 1, 2, 256, 3, 64, 64, 17, 64, 5, 64, 200, 64, 64, 64, 2]
    layout, r = R.Layout.of(sizes), np.random.default_rng(2)
    bins = np.stack([r.integers(0, size, 300) for size in sizes], axis=1).astype(np.uint8)
    words = layout.packed(bins)
    assert layout.words == 2 and sorted(f for group in layout.groups for f in group[3]) == list(range(len(sizes)))
    for f, (word, shift, bits) in enumerate(layout.features):
        assert np.array_equal((words[word] >> shift) & ((1 << bits) - 1), bins[:, f])


def test_fits_of_several_million_rows_are_one_block(monkeypatch):
    """At 6 GB every fit has three to seven million rows: one job grows them, not one per level and round."""
    rows = G.BinnedRows(None, [np.arange(3.0)], {0: (3_400_000, 1_500_000), 1: (3_000_000, 3_000_000), 2: (6_000_000, 6_000_000)})
    assert rows.one_block(0) and rows.one_block(1) and not rows.one_block(2)


def test_trees_of_few_large_forests_go_to_more_tasks(binned, monkeypatch):
    forest, boosted = G.Spec(0, False, 60, 3), G.Spec(2, True, 60, 3)
    assert G._copies(binned, [forest], [0, 2]) == 1  # small fits are not sent twice
    monkeypatch.setattr(G, "SORTED_ROWS", 200)
    assert G._copies(binned, [forest], [0]) == 2 and G._copies(binned, [boosted], [2]) == 1
    assert G._copies(binned, [G.Spec(0, False, 10, 3), forest], [0]) == 1


def test_walks_by_codes_end_where_thresholds_lead(table, binned, monkeypatch):
    """Trees of few leaves are looked up, others walked; values that are not finite go where a comparison sends them."""
    x = np.array(table.where("fit = 2").select("`a b`", "c", "d", "e").collect(), float)
    x[3, 0], x[4, 1], x[5, 3], x[6] = np.nan, np.inf, -np.inf, np.nan
    forest, boosted = G.grow_forests(binned, [G.Spec(2, False, 5, 9)])[0], G.grow_boosted(binned, [G.Spec(2, True, 6, 4)])[0]
    for trees in (forest, boosted):
        expected = np.zeros(len(x))
        for root in trees.roots:
            for i, row in enumerate(x):
                node = root
                while trees.feature[node] >= 0:
                    node = trees.left[node] + int(row[trees.feature[node]] > trees.threshold[node])
                expected[i] += trees.value[node]
        for leaves, rows in ((64, 4096), (0, 100), (6, 7)):
            monkeypatch.setattr(T, "LEAVES_IN_MASK", leaves)
            monkeypatch.setattr(T, "ROWS_AT_ONCE", rows)
            again = replace(trees)
            assert np.array_equal(again.sums(x), expected) and again.steps.cuts[2].size == 0
            assert leaves or not any(again.steps.masks)
    monkeypatch.undo()
    assert all(T.steps_of(boosted).masks)


def test_rows_are_binned_where_they_are_and_dealt_without_ranges(table, binned, monkeypatch):
    """No second pass that looks for ranges: the place of a row is its fit and block, and values travel as bytes."""
    parts = []
    monkeypatch.setattr(G, "cut_lineage", lambda df: parts.append(plan_of(df)) or df)
    monkeypatch.setattr(G, "PART_ROWS", 200)
    again = G.bin_rows(table, FEATURES, binned.cuts, "id", "churn")
    assert "rangepartitioning" not in parts[0] and parts[0].index("Exchange") < parts[0].index("MapInArrow")
    rows = again.table.select("fit", "key", "label", "bins", F.spark_partition_id().alias("part")).collect()
    assert {tuple(r[:4]) for r in rows} == {tuple(r) for r in binned.table.select("fit", "key", "label", "bins").collect()} and len(rows) == 1200
    assert len({(r["fit"], r["key"] % 3, r["part"]) for r in rows}) == len({r["part"] for r in rows}) == 9


def test_joint_sums_are_those_of_single_features(monkeypatch):
    r = np.random.default_rng(4)
    sizes, n = [30, 2, 17, 64, 5, 1], 500
    bins, weights = np.stack([r.integers(0, s, n) for s in sizes], axis=1).astype(np.uint8), r.integers(-9, 9, (2, n)).astype(float)
    monkeypatch.setattr(R, "STEP", 64)
    held = R.NodeRows(R.Layout.of(sizes), [float, float], n)
    for array, some in zip(held.sides[0], [*held.layout.packed(bins), *weights], strict=True):
        array[:] = some
    words, wanted, found = held.layout.words, np.array([0, 1, 3, 5]), []
    for least in (1, n + 1):
        monkeypatch.setattr(R, "JOINT_ROWS", least)
        found.append(held.sums((0, 20, 480), wanted, 64, [words, words + 1]))
    by_hand = np.stack([[np.bincount(bins[20:480, f], w[20:480], 64) for w in weights] for f in wanted]).transpose(0, 2, 1)
    assert np.array_equal(found[0], by_hand) and np.array_equal(found[1], by_hand)
