"""Fitted models: the linear objective, explanations, the whole job, search, persistence, batch independence."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks import fixed_model
from ebbtide.operators import classifiers as C
from ebbtide.operators import tree_contributions as TC
from ebbtide.operators.linear import fit_scaler
from ebbtide.operators.weights import class_weight_table
from ebbtide.plans import scoring, search, training
from ebbtide.sources import registry, sinks
from checks.derived import training_table
from ebbtide.sources.tables import customers_from_records


@pytest.fixture(scope="module")
def sets(spark):
    return training.prepare(training_table(spark, "/root/testdata/sf0.01"), folds=2)


@pytest.fixture(scope="module")
def boosted(sets):
    return C.fit_classifier(sets.train, sets.features, C.build_variant("xgboost", False, n_estimators=4))


@pytest.fixture(scope="module")
def forest(sets):
    variant = C.build_variant("random_forest", False, n_estimators=5, max_depth=6)
    return C.fit_classifier(sets.train, sets.features, variant)


def newton(x, y, w, c=1.0, steps=50):
    """Minimum of C * weighted log loss + |b|^2 / 2, intercept not penalised."""
    design = np.hstack([np.ones((len(x), 1)), x])
    beta, penalty = np.zeros(design.shape[1]), np.diag([0.0] + [1.0] * x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-design @ beta))
        gradient = c * design.T @ (w * (p - y)) + penalty @ beta
        hessian = c * (design * (w * p * (1 - p))[:, None]).T @ design + penalty
        beta -= np.linalg.solve(hessian, gradient)
    return beta


def test_logistic_regression_minimises_the_stated_objective(sets):
    fitted = C.fit_classifier(sets.train, sets.features, C.build_variant("logistic_regression", False))
    rows = sets.train.select(*[f"`{f}`" for f in sets.features], "churn").toPandas().to_numpy()
    x, y = rows[:, :-1], rows[:, -1]
    scale = x.std(axis=0)
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    beta = newton((x - x.mean(axis=0)) / np.where(scale > 0, scale, 1), y, w)
    assert np.allclose([fitted.linear.intercept, *fitted.linear.coefficients], beta, atol=1e-8)
    assert fitted.variant.steps == ["scaler", "classifier"]


def test_linear_contributions_sum_to_the_margin(sets):
    fitted = C.fit_classifier(sets.train, sets.features, C.build_variant("logistic_regression", False))
    linear = training.scorer_of(sets, fitted).classifier.linear
    base = sets.train.select(linear.margin().alias("m")).agg(F.avg("m")).first()[0]
    total = sum(linear.contributions()[1:], linear.contributions()[0])
    worst = sets.test.select(F.max(F.abs(linear.margin() - F.lit(base) - total))).first()[0]
    assert worst < 1e-9


def test_constant_feature_has_scale_one(spark):
    state = fit_scaler(spark.createDataFrame([(1.0, 2.0), (1.0, 4.0)], "a double, b double"), ["a", "b"])
    assert state.mean == [1.0, 3.0] and state.scale == [1.0, 1.0]


def test_class_weights_balance(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2, "churn int")
    rows = {r["churn"]: r["weight"] * r["rows"] for r in class_weight_table(df).collect()}
    assert rows == {0: 4.0, 1: 4.0}


@pytest.mark.parametrize("kind", ["boosted", "forest"])
def test_tree_contributions_add_up(spark, sets, kind, request):
    fitted = request.getfixturevalue(kind)
    rows = TC.with_tree_contributions(fitted.transform(sets.test), fitted).select("churn_probability", "contributions").collect()
    total = np.array([sum(r["contributions"]) for r in rows]) + TC.base_value(fitted)
    p = np.array([r["churn_probability"] for r in rows])
    assert np.allclose(1 / (1 + np.exp(-total)) if kind == "boosted" else total, p, atol=1e-9)


def test_leaves_sent_in_parts_explain_alike(sets, forest, monkeypatch):
    whole = {r["customer_id"]: r["contributions"] for r in TC.with_tree_contributions(sets.test, forest).collect()}
    cells = sum(g[0].size for g in TC.leaves(forest.trees).groups)
    monkeypatch.setattr(TC, "CELLS_SENT", cells // 3)
    parts = TC.parts_of(TC.leaves(forest.trees).groups)
    assert len(parts) in (3, 4, 5) and sum(g[0].size for p in parts for g in p) == cells
    assert all(sum(g[0].size for g in p) <= cells // 3 for p in parts)
    for row in TC.with_tree_contributions(sets.test, forest).collect():
        assert np.allclose(row["contributions"], whole[row["customer_id"]], atol=1e-12)


def shapley_by_subsets(ensemble, x):
    """The definition: average marginal effect over all subsets of features."""
    from itertools import combinations
    from math import factorial

    def known(subset):
        total = 0.0
        for feature, low, high, share, value in ensemble.groups:
            inside = (x[feature] > low) & (x[feature] <= high)
            total += np.sum(value * np.where(np.isin(feature, subset), inside, share).prod(axis=1))
        return total

    used = sorted({int(f) for group in ensemble.groups for f in np.unique(group[0])})
    m, phi = len(used), np.zeros(ensemble.width)
    for j in used:
        others = [f for f in used if f != j]
        for size in range(m):
            for subset in combinations(others, size):
                weight = factorial(size) * factorial(m - size - 1) / factorial(m)
                phi[j] += weight * (known([*subset, j]) - known(list(subset)))
    return phi


def test_tree_contributions_follow_the_definition(spark, sets):
    variant = C.build_variant("random_forest", False, n_estimators=2, max_depth=3)
    fitted = C.fit_classifier(sets.train, sets.features, variant)
    ensemble = TC.leaves(fitted.trees)
    x = np.array(sets.test.select(*[f"`{f}`" for f in sets.features]).limit(3).collect(), dtype=float)
    got = TC.contributions(ensemble.groups, ensemble.width, x)
    for i, row in enumerate(x):
        assert np.allclose(got[i], shapley_by_subsets(ensemble, row))


def test_rows_look_up_what_leaves_would_be_integrated_to(sets, forest, monkeypatch):
    """Trees of depth 4 go into tables whole; rows that are not finite, and leaves of many places, are integrated as before."""
    columns = [f"`{f}`" for f in sets.features]
    x = np.array(sets.train.select(*columns).collect(), dtype=float)
    x[0, 0], x[1, 1], x[2, 2] = np.nan, -np.inf, np.inf
    boosted = C.fit_classifier(sets.train, sets.features, C.build_variant("gradient_boosting", False, n_estimators=12, max_depth=4))
    for trees, patterns in ((boosted.trees, TC.PATTERNS), (forest.trees, 8)):
        monkeypatch.setattr(TC, "PATTERNS", patterns)
        ensemble, sent = TC.leaves(trees), TC.tables_and_leaves(trees)
        assert sum(len(g[0]) for part in sent[1:] for g in part) == sum(len(g[0]) for g in ensemble.groups)
        assert sent[0] and all(t.values.shape[1] <= patterns for t in sent[0]) and bool(sent[2]) == (patterns == 8)
        expected = TC.contributions(ensemble.groups, ensemble.width, x)
        assert np.allclose(TC.explained(*sent, ensemble.width, x), expected, atol=1e-12)
        if not sent[2]:
            with monkeypatch.context() as patch:
                patch.setattr(TC, "_integrated", None)  # no row of finite values is integrated
                assert np.allclose(TC.explained(*sent, ensemble.width, x[3:]), expected[3:], atol=1e-12)


def test_variants(spark):
    assert [v.run_id for v in training.six_variants()] == [
        f"{m}_{s}" for m in ("logistic_regression", "random_forest", "gradient_boosting") for s in ("no_smote", "smote")
    ]
    assert C.build_variant("xgboost", True).steps == ["smote", "classifier"]
    with pytest.raises(ValueError, match="unknown model"):
        C.build_variant("svm", False)
    with pytest.raises(ValueError, match="no parameter"):
        C.build_variant("random_forest", False, learning_rate=1)


def test_folds_are_over_sampled_on_their_own_rows(sets):
    rows = sets.rows(True, 0)
    counts = {r["churn"]: r["count"] for r in rows.groupBy("churn").count().collect()}
    assert counts[0] == counts[1]
    held = sets.held_out(0).select("customer_id")
    real = rows.filter(~F.col("customer_id").startswith("syn-")).select("customer_id")
    assert real.join(held, "customer_id").count() == 0
    seeds = rows.filter(F.col("customer_id").startswith("syn-")).select(F.regexp_extract("customer_id", "syn-(.*)-", 1).alias("customer_id"))
    assert seeds.join(held, "customer_id").count() == 0


def test_whole_job_from_csv(spark, tmp_path):
    data, out = str(tmp_path / "data"), str(tmp_path / "out")
    training_table(spark, "/root/testdata/sf0.01").write.option("header", True).csv(data)
    variants = [
        C.build_variant("logistic_regression", False), C.build_variant("logistic_regression", True),
        C.build_variant("random_forest", False, n_estimators=3),
    ]
    runs = training.run_training(spark, data, out, folds=2, variants=variants)
    best = training.best_of(runs)
    assert best.test["roc_auc"] >= 0.80 and best.test["pr_auc"] >= 0.55
    assert 0.8 < best.cv_roc_auc < 0.95 and 0 <= best.cv_roc_auc_std < 0.1

    metadata = registry.read_metadata(spark, f"{out}/model_metadata")
    read = registry.runs_from_metadata(metadata).orderBy("run_order").collect()
    assert [r["run_id"] for r in read] == [v.run_id for v in variants]
    record = registry.best_model_record(metadata).first()
    assert record["run_id"] == best.variant.run_id and record["n_features"] == 18 and record["test_f1"] == best.test["f1"]
    importances = registry.read_importances(spark, f"{out}/feature_importance").collect()
    sizes = [r["importance"] for r in importances]
    assert len(sizes) == 18 and sizes == sorted(sizes, reverse=True)

    scorer = scoring.ChurnScorer.load(spark, f"{out}/best_model")
    raw = training_table(spark, "/root/testdata/sf0.01").drop("churn")
    scored = scorer.score(raw, reasons="contributions")
    assert scored.count() == 1500
    sinks.write_results_csv(scored, f"{out}/results")
    flat = spark.read.option("header", True).csv(f"{out}/results")
    assert flat.count() == 1500 and " | " in flat.agg(F.max("top_reasons")).first()[0]


def test_tree_scorer_survives_saving(spark, sets, forest, tmp_path):
    scorer = training.scorer_of(sets, forest)
    scorer.save(spark, str(tmp_path / "m"))
    loaded = scoring.ChurnScorer.load(spark, str(tmp_path / "m"))
    raw = training_table(spark, "/root/testdata/sf0.001").drop("churn")
    a, b = scorer.score(raw, "contributions"), loaded.score(raw, "contributions")
    assert a.exceptAll(b).count() == 0 and a.count() == 150
    assert loaded.classifier.variant.params["max_depth"] == 6
    assert sum(forest.importances().values()) == pytest.approx(1)


def test_reads_a_pretty_printed_document(spark, tmp_path):
    run = {"run_id": "a_smote", "model_name": "a", "smote": True, "cv_roc_auc": 0.8, "cv_roc_auc_std": 0.01, "test_roc_auc": 0.81,
           "test_precision": 0.7, "test_recall": 0.6, "test_f1": 0.65}
    document = {"trained_at": "t", "random_state": 42, "cv_folds": 5, "best_model": run, "feature_names": ["x", "y"],
                "all_runs": [run, {**run, "run_id": "b_smote", "test_roc_auc": 0.79}]}
    path = tmp_path / "meta.json"
    path.write_text(json.dumps(document, indent=2))
    metadata = registry.read_metadata(spark, str(path))
    assert [r["run_id"] for r in registry.runs_from_metadata(metadata).orderBy("run_order").collect()] == ["a_smote", "b_smote"]
    assert registry.best_model_record(metadata).first()["n_features"] == 2


def test_search(spark, sets, tmp_path):
    space = {"C": ("log", 1e-3, 100.0), "max_iter": ("int", 20, 40, 10)}
    result = search.optimise(sets, "logistic_regression", n_trials=2, smote=True, space=space)
    assert len(result.trials) == 2 and result.best_cv[0] == max(t.mean for t in result.trials)
    assert search.trials_frame(spark, result).where("state = 'complete' AND size(fold_scores) = 2").count() == 2
    assert result.improvement == round(result.test["roc_auc"] - result.baseline_test_auc, 4)
    search.save_search(spark, sets, result, str(tmp_path / "s"))
    row = registry.read_tuned_metadata(spark, str(tmp_path / "s/optimized_metadata")).first()
    assert row["n_trials"] == 2 and float(row["best_params"]["C"]) == result.variant.params["C"]
    assert scoring.ChurnScorer.load(spark, str(tmp_path / "s/optimized_model")).state == sets.matrices.state
    assert search.comparison_frame(spark, result).count() == 4
    with pytest.raises(TimeoutError):
        search.optimise(sets, "logistic_regression", n_trials=1, smote=False, space=space, timeout_seconds=-1)


def test_scores_do_not_depend_on_the_batch(spark, sf_dir):
    raw = training_table(spark, sf_dir).drop("churn")
    scorer = fixed_model.scorer()
    whole = scorer.score(raw)
    alone = scorer.score(raw.filter("customer_id = 'CUST-00007'"))
    assert alone.first() == whole.filter("customer_id = 'CUST-00007'").first()


def test_single_record(spark):
    record = {"customer_id": "", "tenure": 4, "monthly_charges": 980.0, "support_calls": 8, "contract_type": "Month-to-Month",
              "internet_service": "Fiber Optic", "payment_method": "Electronic Check"}
    row = fixed_model.scorer().score_strict(customers_from_records(spark, [record])).first()
    assert row["customer_id"] is None and row["churn_label"] == 1 and row["risk_segment"] == "Critical"
    assert row["expected_revenue_loss"] == round(row["churn_probability"] * 980.0 * 6, 2)
    assert len(row["retention_strategy"]) == 4 and len(row["top_reasons"]) == 3
    with pytest.raises(ValueError, match="reasons"):
        fixed_model.scorer().score(customers_from_records(spark, [record]), reasons="magic")
