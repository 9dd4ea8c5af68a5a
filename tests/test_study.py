"""Suggestions beat random draws, trials are pruned and marked, a stopped search goes on."""

import numpy as np
import pytest

from ebbtide.operators.classifiers import build_variant
from ebbtide.plans import search, study, training
from checks.derived import training_table

SPACE = {"x": ("real", -5.0, 5.0), "rate": ("log", 1e-3, 10.0), "n": ("int", 100, 500, 50), "kind": ("choice", ("p", "q", "r"))}


def objective(params):
    near = (params["x"] - 2) ** 2 / 10 + np.log10(params["rate"] / 0.1) ** 2 + ((params["n"] - 300) / 200) ** 2
    return float(-near - (params["kind"] != "q"))


def searched(seed, n=50, **sampler):
    trials = study.Study(study.ParzenSampler(SPACE, seed, **sampler), study.MedianPruner(startup=10**9), 1, batch=1)
    trials.run(n, lambda fold, candidates: [objective(p) for p in candidates])
    return trials.best().mean


def test_adaptive_search_beats_random_draws_at_equal_trials():
    adaptive = [searched(seed) for seed in range(12)]
    random = [searched(seed, startup=10**9) for seed in range(12)]
    assert np.median(adaptive) > np.median(random) and sum(a > r for a, r in zip(adaptive, random, strict=True)) >= 9


@pytest.mark.parametrize("space", [SPACE, *search.SEARCH_SPACES.values()])
def test_suggestions_stay_in_range_and_repeat(space):
    sampler, past = study.ParzenSampler(space, 1, startup=3), []
    for number in range(25):
        params = sampler.suggest(number, past)
        assert params == sampler.suggest(number, past) and list(params) == list(space)
        for name, (kind, *args) in space.items():
            assert params[name] in args[0] if kind == "choice" else args[0] <= params[name] <= args[1]
            if kind == "int":
                assert (params[name] - args[0]) % args[2] == 0
        past.append(study.Trial(number, params, (float(np.sin(number)),)))


def test_every_space_builds_its_model():
    for model, space in search.SEARCH_SPACES.items():
        for number in range(10):
            build_variant(model, True, **study.ParzenSampler(space, 7).suggest(number, []))


def test_density_is_one_over_its_range():
    density = study.Density([0.1, 0.2, 0.9], 0.0, 1.0)
    grid = np.linspace(0, 1, 4001)
    assert np.trapezoid([density(x) for x in grid], grid) == pytest.approx(1, abs=1e-3)


def test_trials_below_the_median_are_pruned_and_never_best():
    asked = []

    def score(fold, candidates):
        asked.append((fold, len(candidates)))
        return [p["x"] + (100 if fold == 4 else 0) for p in candidates]

    trials = study.Study(study.ParzenSampler({"x": ("real", 0.0, 1.0)}, 3, startup=10**9), study.MedianPruner(5, 1), 5, batch=4)
    trials.run(24, score)
    states = [t.state for t in trials.trials]
    assert len(states) == 24 and states[:4] == [study.COMPLETE] * 4 and states.count(study.PRUNED) >= 5
    assert all(len(t.scores) == (5 if t.state == study.COMPLETE else len(t.scores)) for t in trials.trials)
    assert all(len(t.scores) < 5 for t in trials.trials if t.state == study.PRUNED)
    assert trials.best().state == study.COMPLETE and sum(n for _, n in asked) < 24 * 5


def test_a_stopped_search_goes_on(spark, tmp_path):
    path, scored = str(tmp_path / "log"), []

    def score(fold, candidates):
        scored.extend(candidates if fold == 0 else [])
        return [objective(p) + fold for p in candidates]

    def at(path):
        return study.Study(study.ParzenSampler(SPACE, 9, startup=4), study.MedianPruner(), 2, 3, study.TrialLog(spark, path, SPACE) if path else None)

    first = at(path)
    first.run(6, score)
    first.log.append(first.trials[3:])  # written twice, as by a driver that was lost after writing
    scored.clear()
    again = at(path)
    assert again.trials == first.trials
    again.run(12, score)
    assert len(scored) == 6 and [t.number for t in again.trials] == list(range(12))
    whole = at(None)
    whole.run(12, score)
    assert whole.trials == again.trials
    assert spark.read.parquet(path).count() == 15 and len(at(path).trials) == 12


def test_log_with_a_gap_counts_up_to_it(spark, tmp_path):
    log = study.TrialLog(spark, str(tmp_path / "log"), SPACE)
    assert log.read() == []
    log.append([study.Trial(k, {"x": 0.1, "rate": 1e-3, "n": 150, "kind": "r"}, (0.5, 0.25), study.PRUNED) for k in (0, 2)])
    assert log.read() == [study.Trial(0, {"x": 0.1, "rate": 1e-3, "n": 150, "kind": "r"}, (0.5, 0.25), study.PRUNED)]


@pytest.mark.parametrize("model", ["logistic_regression", "random_forest", "gradient_boosting"])
def test_search_over_each_space_resumes(spark, sf_dir, tmp_path, model, monkeypatch):
    sets = training.prepare(training_table(spark, "/root/testdata/sf0.01"), folds=2)
    space = dict(search.SEARCH_SPACES[model])
    if model != "logistic_regression":
        space |= {"n_estimators": ("int", 3, 6, 1), "max_depth": ("int", 2, 4, 1)}
    few = {} if model == "logistic_regression" else {"n_estimators": 4}
    path = str(tmp_path / "log")
    result = search.optimise(sets, model, 3, True, space=space, baseline=few, batch=3, log_path=path)
    fits = []
    plain = search.fit_many
    monkeypatch.setattr(search, "fit_many", lambda tables, wanted: (fits.append(len(wanted)), plain(tables, wanted))[1])
    again = search.optimise(sets, model, 3, True, space=space, baseline=few, batch=3, log_path=path)
    assert again.trials == result.trials and fits == [2] and again.test == result.test
    assert result.best_cv[0] == max(t.mean for t in result.trials if t.state == study.COMPLETE)
