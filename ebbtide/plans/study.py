"""Trials of a parameter search: adaptive suggestions, median pruning, and a log that a stopped search goes on from.

Suggestions follow the tree-structured Parzen estimator (Bergstra et al., 2011): past trials are divided into the best few
and the rest, each parameter gets a density for either group (normals around the tried values, cut at the range, plus a
flat part), and of a number of draws from the density of the good ones the draw with the largest ratio of the two is taken.
Draws depend on the seed, the trial's number and the trials before it, so a search that is stopped and started again goes on
as it would have.

A trial is pruned after a fold if its mean so far is below the median of the earlier trials' means after as many folds.
The log is an append-only Parquet table with a row per finished trial; a trial that was written twice counts once.
"""

from __future__ import annotations

import math
import statistics
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession

TRIAL_SCHEMA = "trial int, params map<string,string>, fold_scores array<double>, state string"
COMPLETE, PRUNED = "complete", "pruned"


@dataclass(frozen=True)
class Trial:
    number: int
    params: dict
    scores: tuple[float, ...] = ()
    state: str = COMPLETE

    @property
    def mean(self) -> float:
        return statistics.fmean(self.scores)

    @property
    def std(self) -> float:
        return statistics.pstdev(self.scores)


def _typed(rule: tuple, text: str):
    if rule[0] == "choice":
        return next(value for value in rule[1] if str(value) == text)
    return int(text) if rule[0] == "int" else float(text)


@dataclass(frozen=True)
class TrialLog:
    """Finished trials under a path of the shared storage; without a path nothing is kept."""

    spark: SparkSession
    path: str | None
    space: dict

    def read(self) -> list[Trial]:
        """Trials 0, 1, ... as far as they are all there, in order."""
        if self.path is None:
            return []
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        if not where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return []
        rows = self.spark.read.schema(TRIAL_SCHEMA).parquet(self.path).dropDuplicates(["trial"]).orderBy("trial").collect()
        found = []
        for row in rows:
            if row["trial"] == len(found):
                params = {name: _typed(rule, row["params"][name]) for name, rule in self.space.items()}
                found.append(Trial(row["trial"], params, tuple(row["fold_scores"]), row["state"]))
        return found

    def append(self, trials: list[Trial]) -> None:
        if self.path is not None and trials:
            trials_frame(self.spark, trials).select("trial", "params", "fold_scores", "state").coalesce(1).write.mode("append").parquet(self.path)


def trials_frame(spark: SparkSession, trials: list[Trial]) -> DataFrame:
    rows = [(t.number, {k: str(v) for k, v in t.params.items()}, list(t.scores), t.state, t.mean, t.std) for t in trials]
    return spark.createDataFrame(rows, f"{TRIAL_SCHEMA}, cv_roc_auc double, cv_roc_auc_std double")


# Suggestions -------------------------------------------------------------------------------------------------------------


def random_draw(rng: np.random.Generator, rule: tuple):
    """One value of a rule: ("choice", values), ("int", low, high, step), ("log" or "real", low, high)."""
    if rule[0] == "choice":
        return rule[1][int(rng.integers(len(rule[1])))]
    low, high = _range(rule)
    return _value(rule, rng.uniform(low, high))


def _range(rule: tuple) -> tuple[float, float]:
    """The range on the scale on which a rule is searched; whole numbers get half a step on both sides."""
    kind, low, high = rule[:3]
    if kind == "log":
        return math.log(low), math.log(high)
    half = rule[3] / 2 if kind == "int" else 0
    return low - half, high + half


def _value(rule: tuple, x: float):
    kind, low, high = rule[:3]
    if kind == "log":
        return min(high, max(low, math.exp(x)))
    if kind == "int":
        return int(min(high, max(low, low + rule[3] * round((x - low) / rule[3]))))
    return float(min(high, max(low, x)))


def _scaled(rule: tuple, value) -> float:
    return math.log(value) if rule[0] == "log" else float(value)


class Density:
    """Mixture over a range: a normal around each point, as wide as its neighbours are away, and a flat part."""

    def __init__(self, points: list[float], low: float, high: float):
        self.low, self.high = low, high
        self.points = np.sort(np.array(points, float))
        edges = np.concatenate([[low], self.points, [high]])
        gaps = np.maximum(np.diff(edges)[:-1], np.diff(edges)[1:])
        self.widths = np.clip(gaps, (high - low) / min(100, len(points) + 2), high - low)

    def draw(self, rng: np.random.Generator) -> float:
        k = int(rng.integers(len(self.points) + 1))
        if k == len(self.points):
            return rng.uniform(self.low, self.high)
        for _ in range(100):
            x = rng.normal(self.points[k], self.widths[k])
            if self.low <= x <= self.high:
                return x
        return float(np.clip(self.points[k], self.low, self.high))

    def __call__(self, x: float) -> float:
        flat = 1 / (self.high - self.low)
        if not len(self.points):
            return flat
        inside = [0.5 * (math.erf((self.high - p) / (w * math.sqrt(2))) - math.erf((self.low - p) / (w * math.sqrt(2)))) for p, w in zip(self.points, self.widths, strict=True)]
        normal = np.exp(-0.5 * ((x - self.points) / self.widths) ** 2) / (self.widths * math.sqrt(2 * math.pi) * np.array(inside))
        return float((normal.sum() + flat) / (len(self.points) + 1))


@dataclass(frozen=True)
class ParzenSampler:
    """Random for the first ``startup`` trials, then the Parzen estimator; the best tenth (at most 25) are the good ones."""

    space: dict
    seed: int = 42
    startup: int = 10
    draws: int = 24

    def suggest(self, number: int, past: list[Trial]) -> dict:
        rng = np.random.default_rng([self.seed, number])
        if len(past) < self.startup:
            return {name: random_draw(rng, rule) for name, rule in self.space.items()}
        # A pruned trial stands behind all complete ones, with more folds before fewer.
        ranked = sorted(past, key=lambda t: (t.state != COMPLETE, -len(t.scores), -t.mean, t.number))
        few = min(25, math.ceil(0.1 * len(ranked)))
        return {name: self._pick(rng, rule, [t.params[name] for t in ranked[:few]], [t.params[name] for t in ranked[few:]]) for name, rule in self.space.items()}

    def _pick(self, rng: np.random.Generator, rule: tuple, good: list, rest: list):
        if rule[0] == "choice":
            values = list(rule[1])
            counts = [np.array([1 + sum(v == x for x in some) for v in values], float) for some in (good, rest)]
            shares = [c / c.sum() for c in counts]
            drawn = rng.choice(len(values), self.draws, p=shares[0])
            return values[int(max(drawn, key=lambda k: shares[0][k] / shares[1][k]))]
        low, high = _range(rule)
        near, far = (Density([_scaled(rule, v) for v in some], low, high) for some in (good, rest))
        drawn = [near.draw(rng) for _ in range(self.draws)]
        return _value(rule, max(drawn, key=lambda x: near(x) / far(x)))


@dataclass(frozen=True)
class MedianPruner:
    """After a fold, a trial whose mean so far is below the median of the earlier ones' is pruned.

    The first ``startup`` trials and the first ``warmup`` folds of any trial are let through.
    """

    startup: int = 5
    warmup: int = 1

    def pruned(self, scores: tuple[float, ...], past: list[Trial]) -> bool:
        n = len(scores)
        means = [statistics.fmean(t.scores[:n]) for t in past if len(t.scores) >= n]
        return len(past) >= self.startup and n >= self.warmup and bool(means) and statistics.fmean(scores) < statistics.median(means)


@dataclass
class Study:
    """Trials in batches: ``score`` takes (fold, list of params) and gives a score for each; it is asked fold by fold.

    The trials of a batch are suggested from the same past and share their jobs.
    """

    sampler: ParzenSampler
    pruner: MedianPruner
    folds: int
    batch: int = 5
    log: TrialLog | None = None
    trials: list[Trial] = field(default_factory=list)

    def __post_init__(self):
        self.trials = self.log.read() if self.log else []

    def run(self, n_trials: int, score, go_on=lambda: True) -> list[Trial]:
        """Go on until there are ``n_trials``, or ``go_on`` says no."""
        while len(self.trials) < n_trials and go_on():
            numbers = range(len(self.trials), min(n_trials, len(self.trials) + self.batch))
            past = list(self.trials)
            params = {k: self.sampler.suggest(k, past) for k in numbers}
            scores, live, state = {k: () for k in numbers}, list(numbers), dict.fromkeys(numbers, COMPLETE)
            for fold in range(self.folds):
                for k, value in zip(live, score(fold, [params[k] for k in live]), strict=True):
                    scores[k] += (value,)
                if fold + 1 < self.folds:
                    lost = [k for k in live if self.pruner.pruned(scores[k], past)]
                    state |= dict.fromkeys(lost, PRUNED)
                    live = [k for k in live if k not in lost]
                if not live:
                    break
            made = [Trial(k, params[k], scores[k], state[k]) for k in numbers]
            if self.log:
                self.log.append(made)
            self.trials += made
        return self.trials

    def best(self) -> Trial:
        """The complete trial with the highest mean; the earlier one among equals."""
        complete = [t for t in self.trials if t.state == COMPLETE]
        if not complete:
            raise TimeoutError("no trial was completed")
        return max(complete, key=lambda t: t.mean)
