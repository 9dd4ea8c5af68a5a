"""Forests and boosted trees of many fits grown together: most fits where their rows lie, the largest with one aggregate per level.

A fit is one set of training rows (the rows without a fold, over-sampled or not, or all of them). The rows of all fits are
binned and written once, one byte per feature. The rows of a fit that is one block (at most BLOCK_ROWS rows) meet in one task,
which grows all its trees and rounds: one job for all such fits. From SORTED_ROWS rows on the task keeps them in the order of
their nodes (`node_rows`), and the trees of a forest may be shared out to a few tasks that each get the rows. For larger fits, each level is one pass over the table that
lets every row walk the trees of its fit and adds it up by (node, candidate feature, bin); tasks send one partial sum per node
chunk, the chunks are added up and the best split of each node is chosen where they meet. So the number of jobs is the depth
(times the rounds of boosting), whatever the number of folds, variants, candidates and trees; nothing is sorted or shuffled
by row. Both ways add up the same cells and choose with the same function.

What the driver holds are the nodes, whose number follows the parameters (specs, trees, depth). Row and column sampling are
hash draws of the row's id, so that a task that is run again gives the same sums, and partial sums are added in the
order of the table's blocks.

Forests choose by weighted Gini impurity (counts stay whole numbers). Boosting uses first and second derivatives of the
logistic loss: the gain of a split is half of T(GL)^2/(HL+lambda) + T(GR)^2/(HR+lambda) - T(G)^2/(H+lambda), a leaf is
-T(G)/(H+lambda) times the learning rate, where T draws G towards 0 by alpha; after a tree has its depth, splits that
win less than gamma are taken back from the leaves upwards (Chen and Guestrin, 2016).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.operators.arrow_bytes import as_binary, binary_bytes
from ebbtide.operators.node_rows import STEP, Layout, NodeRows
from ebbtide.operators.tree_models import TreeEnsemble
from ebbtide.session import cut_lineage

#: Cut points per feature at most; the accuracy of the quantile sketch they come from.
CUTS, SKETCH_ERROR = 63, 0.0005
#: Rows of a fit that one task grows alone (up to 150 bytes each), and from which on it keeps them in the order of their nodes.
BLOCK_ROWS, SORTED_ROWS = 8_000_000, 250_000
#: Trees of a forest at least that are worth sending a large fit's rows to one more task.
TREES_A_TASK = 25
#: Rows of a written part of a fit, nodes of a chunk, and rounds of boosting until margins are written again.
PART_ROWS, CHUNK, ROUNDS_KEPT = 2_000_000, 32, 25
ROWS_SCHEMA = "fit int, key long, label int, bins binary, margins binary"
PARTIAL_SCHEMA = "part int, block int, cells binary, sums binary"
TREE_SCHEMA = "spec int, tree int, node int, feature int, cut int, left int, gain double, stat0 double, stat1 double"
FOUND_SCHEMA = "active int, feature int, cut int, gain double, left0 double, left1 double, right0 double, right1 double"


@dataclass(frozen=True)
class Spec:
    """One ensemble to grow on the rows of a fit."""

    fit: int
    boosting: bool
    n_estimators: int
    max_depth: int
    seed: int = 42
    min_samples_leaf: int = 1
    min_samples_split: int = 2
    max_features: str | float = "sqrt"
    learning_rate: float = 0.05
    subsample: float = 1.0
    colsample: float = 1.0
    gamma: float = 0.0
    reg_alpha: float = 0.0
    reg_lambda: float = 1.0
    min_child_weight: float = 1.0

    def candidates(self, width: int) -> int:
        """Features looked at: of a node in a forest, of a tree in boosting."""
        if self.boosting:
            return max(1, math.floor(self.colsample * width))
        named = {"sqrt": math.sqrt(width), "log2": math.log2(width)}
        share = named.get(self.max_features) or (width if self.max_features in ("all", None) else float(self.max_features) * width)
        return min(width, max(1, int(share)))


# Binned rows -----------------------------------------------------------------------------------------------------------


def cut_points(df: DataFrame, features: list[str]) -> list[np.ndarray]:
    """At most CUTS ascending cut points per feature, from quantiles of the given rows; the largest value is none."""
    shares = [i / (CUTS + 1) for i in range(1, CUTS + 1)] + [1.0]
    found = df.approxQuantile([f"`{name}`" for name in features], shares, SKETCH_ERROR)
    return [np.unique(np.array(q[:-1]))[np.unique(np.array(q[:-1])) < q[-1]] if q else np.empty(0) for q in found]


@dataclass(frozen=True)
class BinnedRows:
    """The written rows of all fits. ``weights`` holds the class weights and ``rows`` the class counts of each fit."""

    table: DataFrame
    cuts: list[np.ndarray]
    rows: dict[int, tuple[int, int]]

    @property
    def width(self) -> int:
        return len(self.cuts)

    @property
    def bins(self) -> int:
        return max([len(c) for c in self.cuts], default=0) + 1

    def class_weights(self, fit: int) -> tuple[float, float]:
        """n / (2 n_class); a class without rows weighs nothing."""
        negatives, positives = self.rows[fit]
        return tuple((negatives + positives) / (2 * n) if n else 0.0 for n in (negatives, positives))

    def one_block(self, fit: int) -> bool:
        """Whether all rows of a fit go through one task, which can then grow its trees alone."""
        return sum(self.rows[fit]) <= BLOCK_ROWS


def bin_rows(df: DataFrame, features: list[str], cuts: list[np.ndarray], key: str, label: str, fit: str = "fit") -> BinnedRows:
    """Rows with a fit number as one byte per feature, written block by block.

    A label other than 0 and 1 is refused. Values that are NULL or NaN go to the last bin.
    """
    counts = {(r["fit"], r["label"]): r["count"] for r in df.groupBy(F.col(fit).alias("fit"), F.col(label).alias("label")).count().collect()}
    if any(value not in (0, 1) for _, value in counts):
        raise ValueError(f"{label} must be binary and not NULL")
    rows = {f: (counts.get((f, 0), 0), counts.get((f, 1), 0)) for f, _ in counts}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i + 3).to_numpy(zero_copy_only=False).astype(float) for i in range(len(cuts))]
            bins = np.stack([np.searchsorted(c, x) for c, x in zip(cuts, columns, strict=True)], axis=1).astype(np.uint8)
            cells = [as_binary(x, len(bins)) for x in (bins, np.empty(0))]
            yield pa.RecordBatch.from_arrays([batch["fit"], batch["key"], batch["label"], *cells], ["fit", "key", "label", "bins", "margins"])

    picked = df.select(
        F.col(fit).cast("int").alias("fit"), F.xxhash64(key).alias("key"), F.col(label).cast("int").alias("label"),
        *[F.col(f"`{name}`").cast("double").alias(f"x{i}") for i, name in enumerate(features)],
    )
    total, largest = sum(map(sum, rows.values())), max(map(sum, rows.values()), default=0)
    blocks = max(1, math.ceil(largest / min(BLOCK_ROWS, PART_ROWS)))
    # A place for every block of every fit, so that nothing is read twice to find ranges; rows travel as bytes.
    place = (F.array_position(F.array(*[F.lit(f) for f in sorted(rows)]).cast("array<int>"), F.col("fit")).cast("int") - 1) * blocks + F.pmod("key", F.lit(blocks)).cast("int")
    parts = max(1, min(len(rows) * blocks, total))
    dealt = picked.mapInArrow(run, ROWS_SCHEMA).repartitionById(parts, F.pmod(place, F.lit(parts)))
    return BinnedRows(cut_lineage(dealt), cuts, rows)


# Trees in the making -----------------------------------------------------------------------------------------------------


@dataclass
class Growing:
    """Node arrays of trees that are being grown, one list entry per level, all trees together."""

    spec_of_tree: np.ndarray
    number: np.ndarray  # of the tree inside its ensemble
    tree: np.ndarray = None
    feature: np.ndarray = None
    cut: np.ndarray = None
    left: np.ndarray = None
    gain: np.ndarray = None
    stats: np.ndarray = None

    def __post_init__(self):
        n = len(self.spec_of_tree)
        self.tree, self.feature, self.cut = np.arange(n), np.full(n, -1), np.zeros(n, np.int64)
        self.left, self.gain, self.stats = np.full(n, -1), np.zeros(n), np.zeros((n, 2))

    def split(self, nodes: np.ndarray, feature: np.ndarray, cut: np.ndarray, gain: np.ndarray, sides: np.ndarray) -> np.ndarray:
        """Give nodes two children each, with their sums; returns the children, pair by pair."""
        first, n = len(self.tree), len(nodes)
        self.feature[nodes], self.cut[nodes], self.gain[nodes], self.left[nodes] = feature, cut, gain, first + 2 * np.arange(n)
        grown = {"tree": np.repeat(self.tree[nodes], 2), "feature": np.full(2 * n, -1), "cut": np.zeros(2 * n, np.int64), "left": np.full(2 * n, -1), "gain": np.zeros(2 * n), "stats": sides.reshape(-1, 2)}
        for name, more in grown.items():
            setattr(self, name, np.concatenate([getattr(self, name), more]))
        return np.arange(first, first + 2 * n)


@dataclass
class Level:
    """What a pass needs: the trees so far, the nodes to split, their candidate features and their rules. Sent to the tasks."""

    specs: list[Spec]
    fits: dict[int, list[int]]  # trees by fit
    spec_of_tree: np.ndarray
    number: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    active: np.ndarray  # by node: place among the nodes to split, or -1
    depth: int
    candidates: np.ndarray  # by node to split: features, -1 for none
    rules: np.ndarray  # by node to split: its spec
    weights: np.ndarray  # by spec: class weights
    bins: int
    boosters: dict = field(default_factory=dict)  # by fit: its boosting specs in the order of the margins
    pending: list = field(default_factory=list)  # by margin: trees whose values are not in the written margins yet
    base: np.ndarray = None


def _mix(keys: np.ndarray) -> np.ndarray:
    keys = (keys ^ (keys >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    keys = (keys ^ (keys >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return keys ^ (keys >> np.uint64(31))


def unit_draws(keys: np.ndarray, seed: int, number: int) -> np.ndarray:
    """A number in [0, 1) for every row key, the same in every run; another one for every tree."""
    with np.errstate(over="ignore"):
        salt = _mix(np.array([seed * 1_000_003 + number + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return (_mix(keys.view(np.uint64) ^ salt) >> np.uint64(11)) / float(1 << 53)


#: Shares of a Poisson variable with mean 1 up to each count: how often a row is in a tree's bootstrap sample.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])


def bag_counts(keys: np.ndarray, seed: int, number: int) -> np.ndarray:
    counts = np.zeros(len(keys), np.int64)
    for a in range(0, len(keys), STEP):
        draws, some = unit_draws(keys[a : a + STEP], seed, number), np.zeros(min(STEP, len(keys) - a), np.int8)
        for share in _POISSON[:4]:
            some += draws >= share
        rare = np.flatnonzero(some == 4)
        some[rare] = np.searchsorted(_POISSON, draws[rare], side="right")
        counts[a : a + STEP] = some
    return counts


def _places(bins: np.ndarray, root: int | np.ndarray, depth: int, feature: np.ndarray, cut: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The node every row has reached after `depth` steps from the root, or from its own node."""
    flat, offsets, place = bins.ravel(), np.arange(len(bins)) * bins.shape[1], np.full(len(bins), root)
    for _ in range(depth):
        at = feature[place]
        inner = at >= 0
        if not inner.any():
            break
        place = np.where(inner, left[place] + (flat[offsets + np.maximum(at, 0)] > cut[place]), place)
    return place


def _margins(level: Level, fit: int, bins: np.ndarray, written: np.ndarray) -> dict[int, np.ndarray]:
    """Log-odds of the rows of a fit under each of its boosting specs: what is written and the trees since."""
    found = {}
    for k, spec in enumerate(level.boosters.get(fit, ())):
        margin = written[:, k] if written.size else np.full(len(bins), level.base[spec])
        for feature, cut, left, value, depth in level.pending[spec]:
            margin = margin + value[_places(bins, 0, depth, feature, cut, left)]
        found[spec] = margin
    return found


def _fits(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple]:
    """The rows of a task by fit, as arrays. A task holds one block: its size is that of the written partition."""
    parts: dict[int, list] = {}
    for batch in batches:
        fits = batch["fit"].to_numpy()
        for fit in np.unique(fits).tolist():
            parts.setdefault(fit, []).append(batch.filter(pa.array(fits == fit)))
    for fit in sorted(parts):
        table = pa.Table.from_batches(parts.pop(fit))
        bins = np.concatenate([binary_bytes(c) for c in table["bins"].chunks]).reshape(-1, width)
        written = np.concatenate([binary_bytes(c) for c in table["margins"].chunks]).view(float).reshape(len(bins), -1) if len(table["margins"][0].as_py()) else np.empty((len(bins), 0))
        keys, labels = table["key"].to_numpy(), table["label"].to_numpy().astype(float)
        del table  # not held while the trees grow
        yield fit, keys, labels, bins, written


def _sums(level: Level, tree: int, keys: np.ndarray, labels: np.ndarray, bins: np.ndarray, margins: dict) -> tuple[np.ndarray, np.ndarray] | None:
    """(cells, two sums per cell) of one tree over the rows of a task; cells ascend and are not empty."""
    which = level.spec_of_tree[tree]
    spec, number = level.specs[which], int(level.number[tree])
    if spec.boosting:
        chosen = np.flatnonzero(unit_draws(keys, spec.seed, number) < spec.subsample)
        p = 1 / (1 + np.exp(-margins[which][chosen]))
        first, second = p - labels[chosen], p * (1 - p)
    else:
        bag = bag_counts(keys, spec.seed, number)
        chosen = np.flatnonzero(bag)
        second = bag[chosen] * labels[chosen]
        first = bag[chosen] - second
    place = level.active[_places(bins[chosen], tree, level.depth, level.feature, level.cut, level.left)]
    live = np.flatnonzero(place >= 0)
    if not len(live):
        return None
    place, low, high = place[live], place[live].min(), place[live].max() + 1
    sums = _cell_sums(bins[chosen[live]], place - low, level.candidates[low:high], level.bins, first[live], second[live], not spec.boosting).reshape(-1, 2)
    there = np.flatnonzero(sums.any(axis=1))
    return there + low * level.candidates.shape[1] * level.bins, sums[there]


def _cell_sums(
    rows: np.ndarray, place: np.ndarray, candidates: np.ndarray, bins: int, first: np.ndarray, second: np.ndarray, by_class: bool,
    starts: np.ndarray | None = None,
) -> np.ndarray:
    """Two sums by (node, candidate, bin) over binned rows of one tree; ``place`` counts its nodes from 0.

    ``by_class``: every row counts for one of the two sums only, so both are taken in one pass. ``starts`` picks rows by the
    place of their first byte. Where all nodes look at the same features, a place past the last node counts nowhere (not with ``by_class``).
    """
    nodes, m = candidates.shape
    sums = np.zeros((2, nodes, m, bins))
    base, apart = place * bins, (candidates != candidates[0]).any()
    if by_class or apart:
        flat, starts = rows.ravel(), np.arange(len(rows)) * rows.shape[1] if starts is None else starts
    if by_class:
        base, whole = base + (second > 0) * (nodes * bins), first + second
    for j in range(m):
        features = candidates[:, j]
        if features[0] < 0:  # all nodes of a tree have equally many candidates
            break
        if by_class:
            cells = base + flat[starts + (features[place] if apart else features[0])]
            sums[:, :, j] = np.bincount(cells, whole, 2 * nodes * bins).reshape(2, nodes, bins)
            continue
        cells = base + (flat[starts + features[place]] if apart else rows[:, features[0]])
        for k, weight in enumerate((first, second)):
            sums[k, :, j] = np.bincount(cells, weight, (nodes + 1) * bins)[: nodes * bins].reshape(nodes, bins)
    return np.moveaxis(sums, 0, -1)


def _partials(table: DataFrame, shared, width: int) -> DataFrame:
    """One row per task and chunk of nodes: cells and their sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, block = shared.value, TaskContext.get().partitionId()
        chunk = CHUNK * level.candidates.shape[1] * level.bins
        for fit, keys, labels, bins, written in _fits(batches, width):
            margins = _margins(level, fit, bins, written)
            out, weight = [], 0
            for tree in level.fits.get(fit, ()):
                found = _sums(level, tree, keys, labels, bins, margins)
                if found is None:
                    continue
                cells, sums = found
                parts = cells // chunk
                edges = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(cells)]
                for a, b in zip(edges, edges[1:]):
                    out.append((int(parts[a]), block, (cells[a:b] - parts[a] * chunk).astype(np.int32).tobytes(), sums[a:b].tobytes()))
                    weight += 20 * (b - a)
                if weight > 1 << 23:
                    yield _record(out)
                    out, weight = [], 0
            if out:
                yield _record(out)

    return table.mapInArrow(run, PARTIAL_SCHEMA)


def _record(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], ["part", "block", "cells", "sums"])


def _shrunk(g: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0)


def _scored(a: np.ndarray, b: np.ndarray, boosting: np.ndarray, rules: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Score of the rows with sums ``a`` and ``b``, and their size: rows in a forest, curvature in boosting."""
    if not boosting.any():
        # Rows are counted in whole numbers.
        size, a, b = a + b, a * weights[:, None, None, 0], b * weights[:, None, None, 1]
        total = a + b
        a *= a
        b *= b
        a += b
        return np.divide(a, total, out=np.zeros_like(a), where=size > 0), size
    if boosting.all():
        score = np.abs(a)
        score -= rules[:, None, None, 0]
        np.maximum(score, 0, out=score)
        score *= score
        score /= b + rules[:, None, None, 1]
        score /= 2
        return score, b
    kinds = [_scored(a, b, np.full(len(boosting), kind), rules, weights) for kind in (True, False)]
    return tuple(np.where(boosting[:, None, None], x, y) for x, y in zip(*kinds, strict=True))


def best_splits(sums: np.ndarray, boosting: np.ndarray, rules: np.ndarray, weights: np.ndarray, offered: np.ndarray) -> tuple:
    """Best (candidate, cut, gain, left sums, right sums) of every node from sums by (node, candidate, bin, 2).

    Ties go to the first candidate and the lowest cut; a gain of at most 0 is none (candidate -1). Without a split the left
    sums are the node's whole sums and the right ones 0.
    """
    left = [sums[..., k].cumsum(axis=2) for k in (0, 1)]
    whole = [x[:, :, -1:] for x in left]
    right = [w - x for w, x in zip(whole, left, strict=True)]
    # 1e-9 only absorbs the rounding of subtractions; a side holds something in any case.
    least = np.maximum(rules[:, None, None, 2] - 1e-9, np.finfo(float).smallest_subnormal)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain, size = _scored(*left, boosting, rules, weights)
        fits = size >= least
        score, size = _scored(*right, boosting, rules, weights)
        fits &= size >= least
        gain += score
        score = _scored(*whole, boosting, rules, weights)[0]
        gain -= score
        fits &= gain > 1e-10 * np.abs(score) + 1e-12
    enough = boosting[:, None, None] | (whole[0] + whole[1] >= rules[:, None, None, 3])
    fits &= enough & offered[:, :, None]
    gain[~fits] = -np.inf
    flat = gain.reshape(len(gain), -1)
    best = flat.argmax(axis=1)
    nodes, (candidate, cut) = np.arange(len(gain)), np.divmod(best, gain.shape[2])
    won = flat[nodes, best]
    found = np.isfinite(won)
    lefts, rights = (np.stack([x[nodes, candidate, cut] for x in side], axis=1) for side in (left, right))
    lefts = np.where(found[:, None], lefts, np.stack([w[:, 0, 0] for w in whole], axis=1))
    rights = np.where(found[:, None], rights, 0)
    return np.where(found, candidate, -1), cut, np.where(found, won, 0), lefts, rights


def _found(level: Level, nodes: np.ndarray, sums: np.ndarray) -> dict[str, np.ndarray]:
    """The columns of FOUND_SCHEMA for some of the nodes to split, from their sums."""
    boosting = np.array([s.boosting for s in level.specs])
    rules = np.array([(s.reg_alpha, s.reg_lambda, s.min_child_weight, 0) if s.boosting else (0, 0, s.min_samples_leaf, s.min_samples_split) for s in level.specs], float)
    spec, candidates = level.rules[nodes], level.candidates[nodes]
    j, cut, gain, left, right = best_splits(sums, boosting[spec], rules[spec], level.weights[spec], candidates >= 0)
    feature = np.where(j >= 0, candidates[np.arange(len(nodes)), np.maximum(j, 0)], -1)
    return {
        "active": nodes.astype(np.int32), "feature": feature.astype(np.int32), "cut": cut.astype(np.int32), "gain": gain,
        "left0": left[:, 0], "left1": left[:, 1], "right0": right[:, 0], "right1": right[:, 1],
    }


def _chosen(partials: DataFrame, shared, parts: int) -> DataFrame:
    """The best split of every node to split; partial sums of a chunk meet in one place, in the order of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, at, sums = shared.value, None, None
        m, bins = level.candidates.shape[1], level.bins

        def done() -> pa.RecordBatch:
            nodes = np.arange(at * CHUNK, min((at + 1) * CHUNK, len(level.candidates)))
            found = _found(level, nodes, sums.reshape(CHUNK, m, bins, 2)[: len(nodes)])
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in found.values()], list(found))

        for batch in batches:
            for part, cells, some in zip(batch["part"].to_pylist(), batch["cells"].to_pylist(), batch["sums"].to_pylist(), strict=True):
                if part != at:
                    if at is not None:
                        yield done()
                    at, sums = part, np.zeros((CHUNK * m * bins, 2))
                sums[np.frombuffer(cells, np.int32)] += np.frombuffer(some, float).reshape(-1, 2)
        if at is not None:
            yield done()

    return partials.repartition(parts, "part").sortWithinPartitions("part", "block").mapInArrow(run, FOUND_SCHEMA)


def _draw_candidates(specs: list[Spec], spec_of: np.ndarray, tree_number: np.ndarray, tree: np.ndarray, width: int, depth: int) -> np.ndarray:
    """Candidate features of each node to split: per node in a forest, per tree in boosting; ascending."""
    most = max(specs[k].candidates(width) for k in np.unique(spec_of))
    out = np.full((len(spec_of), most), -1, np.int64)
    # Nodes stand tree by tree: one generator per tree, so that trees do not depend on what else is grown.
    edges = [0, *(np.flatnonzero(np.diff(tree)) + 1).tolist(), len(tree)]
    for a, b in zip(edges, edges[1:]):
        spec = specs[spec_of[a]]
        m = spec.candidates(width)
        rng = np.random.default_rng([spec.seed, int(tree_number[a]), 0 if spec.boosting else depth + 1])
        draws = rng.random((1 if spec.boosting else b - a, width))
        out[a:b, :m] = np.sort(np.argsort(draws, axis=1, kind="stable")[:, :m], axis=1)
    return out


def _grow(specs: list[Spec], growing: Growing, weights: np.ndarray, width: int, bins: int, find: Callable[[Level], dict], more: dict | None = None) -> None:
    """Grow all trees to their depth; ``find`` gives the columns of FOUND_SCHEMA for the nodes of a level, in their order."""
    depths = np.array([s.max_depth for s in specs])
    fits: dict[int, list[int]] = {}
    for tree, spec in enumerate(growing.spec_of_tree.tolist()):
        fits.setdefault(specs[spec].fit, []).append(tree)
    nodes = np.arange(len(growing.spec_of_tree))
    for depth in range(int(depths.max(initial=0))):
        nodes = nodes[depth < depths[growing.spec_of_tree[growing.tree[nodes]]]]
        nodes = nodes[np.argsort(growing.tree[nodes], kind="stable")]
        if not len(nodes):
            return
        tree = growing.tree[nodes]
        spec_of = growing.spec_of_tree[tree]
        active = np.full(len(growing.tree), -1)
        active[nodes] = np.arange(len(nodes))
        candidates = _draw_candidates(specs, spec_of, growing.number[tree], tree, width, depth)
        column = find(Level(specs, fits, growing.spec_of_tree, growing.number, growing.feature, growing.cut, growing.left, active, depth, candidates, spec_of, weights, bins, **(more or {})))
        at = nodes[column["active"]]
        sides = np.stack([np.stack([column[f"{side}0"], column[f"{side}1"]], axis=1) for side in ("left", "right")], axis=1)
        if depth == 0:
            growing.stats[at] = sides.sum(axis=1)
        won = column["feature"] >= 0
        nodes = growing.split(at[won], column["feature"][won], column["cut"][won], column["gain"][won], sides[won])


def _by_jobs(rows: BinnedRows) -> Callable[[Level], dict]:
    """Best splits of a level from one job over all rows."""
    spark = rows.table.sparkSession

    def find(level: Level) -> dict:
        shared = spark.sparkContext.broadcast(level)
        chunks = -(-len(level.candidates) // CHUNK)
        parts = max(1, min(chunks, int(spark.conf.get("spark.sql.shuffle.partitions"))))
        found = _chosen(_partials(rows.table, shared, rows.width), shared, parts).toArrow().sort_by("active")
        shared.unpersist()
        return {name: found[name].to_numpy() for name in found.column_names}

    return find


# Fits of one block -------------------------------------------------------------------------------------------------------


def _tree_here(spec: Spec, number: int, rows: np.ndarray, counted: np.ndarray | None, first: np.ndarray, second: np.ndarray, weights: np.ndarray, bins: int) -> tuple[Growing, np.ndarray]:
    """One tree grown on the rows at hand, and the node every row ends in.

    In boosting the counted rows (all if None) have a say; the two sums of each of them are given in their order.
    """
    growing, place = Growing(np.zeros(1, np.int64), np.array([number])), np.zeros(len(rows), np.int64)
    # Feature by feature: all nodes of a boosted tree look at the same ones.
    columns = np.asfortranarray(rows if counted is None else rows.take(counted, axis=0)) if spec.boosting else rows

    def step() -> np.ndarray:
        return _places(rows, place, 1, growing.feature, growing.cut, growing.left)

    def find(level: Level) -> dict:
        nonlocal place
        if level.depth:
            place = step()
        at = level.active[place]
        if spec.boosting:  # few rows of its short trees have come to rest: they are counted nowhere
            at = at if counted is None else at[counted]
            at[at < 0] = len(level.candidates)
            sums = _cell_sums(columns, at, level.candidates, bins, first, second, False)
        else:
            live = np.flatnonzero(at >= 0)
            sums = _cell_sums(rows, at[live], level.candidates, bins, first[live], second[live], True, live * rows.shape[1])
        return _found(level, np.arange(len(level.candidates)), sums)

    _grow([spec], growing, weights[None], rows.shape[1], bins, find)
    return growing, step()


def _forest_here(spec: Spec, keys: np.ndarray, labels: np.ndarray, rows: np.ndarray, weights: np.ndarray, bins: int, numbers: range | None = None) -> Iterator[Growing]:
    for number in numbers or range(spec.n_estimators):
        bag = bag_counts(keys, spec.seed, number)
        chosen = np.flatnonzero(bag)
        second = bag[chosen] * labels[chosen]
        yield _tree_here(spec, number, rows.take(chosen, axis=0), None, bag[chosen] - second, second, weights, bins)[0]


def _boosted_here(spec: Spec, keys: np.ndarray, labels: np.ndarray, rows: np.ndarray, base: float, bins: int) -> Iterator[Growing]:
    margin, weights = np.full(len(rows), base), np.ones(2)
    for number in range(spec.n_estimators):
        p = 1 / (1 + np.exp(-margin))
        counted = np.flatnonzero(unit_draws(keys, spec.seed, number) < spec.subsample)
        drawn = p[counted]
        growing, place = _tree_here(spec, number, rows, counted, drawn - labels[counted], drawn * (1 - drawn), weights, bins)
        kept = np.arange(len(growing.tree))
        if spec.gamma > 0:
            _taken_back(growing, kept, spec.gamma)
            for node in np.flatnonzero(growing.left >= 0).tolist():  # parents come before their children
                if growing.feature[node] < 0 or kept[node] != node:
                    kept[growing.left[node] : growing.left[node] + 2] = kept[node]
        margin = margin + leaf_values(spec, growing.stats, weights)[0][kept[place]]
        yield growing


# A forest's row counts for both its sums in one number: its count, and that times _POSITIVE if its label is 1.
_POSITIVE = float(1 << 26)


def _sorted_tree(spec: Spec, number: int, held: NodeRows, place: dict, arrays: list[int], sums_of: Callable, weights: np.ndarray, width: int, bins: int) -> Growing:
    """One tree grown on rows kept in the order of their nodes; ``place`` has its root and gets its leaves."""
    growing, before = Growing(np.zeros(1, np.int64), np.array([number])), np.empty((0, 0, 0, 2))
    nodes = np.zeros(1, np.int64)

    def find(level: Level) -> dict:
        nonlocal before, nodes
        parents = np.flatnonzero(growing.feature[nodes] >= 0) if level.depth else []
        for node in nodes[parents].tolist():
            held.split(place, node, int(growing.feature[node]), int(growing.cut[node]), int(growing.left[node]), arrays)
        nodes = np.flatnonzero(level.active >= 0)
        sums = np.empty((len(nodes), level.candidates.shape[1], bins, 2))
        if spec.boosting and level.depth:
            # All nodes of a boosted tree look at the same features: the larger child has what the smaller one leaves.
            for pair, parent in enumerate(parents):
                small, large = sorted((2 * pair, 2 * pair + 1), key=lambda k: place[int(nodes[k])][2] - place[int(nodes[k])][1])
                sums[small] = sums_of(place[int(nodes[small])], level.candidates[small])
                sums[large] = before[parent] - sums[small]
        else:
            for k, node in enumerate(nodes.tolist()):
                sums[k] = sums_of(place[node], level.candidates[k])
        before = sums if spec.boosting else before
        return _found(level, np.arange(len(nodes)), sums)

    _grow([spec], growing, weights[None], width, bins, find)
    return growing


def _sorted_forest(
    spec: Spec, keys: np.ndarray, labels: np.ndarray, words: list[np.ndarray], layout: Layout, weights: np.ndarray, bins: int, numbers: range | None = None
) -> Iterator[Growing]:
    held, count = NodeRows(layout, [float], len(keys)), len(words)
    unit = 1 + labels * _POSITIVE

    def sums_of(place: tuple, candidates: np.ndarray) -> np.ndarray:
        both = held.sums(place, candidates, bins, [count])[..., 0]
        positive = np.floor(both / _POSITIVE)
        return np.stack([both - positive * _POSITIVE - positive, positive], axis=-1)

    for number in numbers or range(spec.n_estimators):
        end = 0
        for a in range(0, len(keys), STEP):
            bag = bag_counts(keys[a : a + STEP], spec.seed, number)
            chosen = np.flatnonzero(bag)
            some = slice(end, end := end + len(chosen))
            for array, word in zip(held.sides[0], words):
                array[some] = word[a : a + STEP].take(chosen)
            held.sides[0][count][some] = bag.take(chosen) * unit[a : a + STEP].take(chosen)
        yield _sorted_tree(spec, number, held, {0: (0, 0, end)}, list(range(count + 1)), sums_of, weights, len(layout.features), bins)


def _sorted_boosted(spec: Spec, keys: np.ndarray, labels: np.ndarray, words: list[np.ndarray], layout: Layout, base: float, bins: int) -> Iterator[Growing]:
    """Derivatives are rounded to a multiple of a power of two, fine enough for 53 bits, at which all their sums are exact."""
    held, count, n = NodeRows(layout, [float, float, np.int64], len(keys)), len(words), len(keys)
    margin, weights, unit = np.full(n, base), np.ones(2), 2.0 ** (52 - n.bit_length())
    arrays = list(range(count + 3))

    def sums_of(place: tuple, candidates: np.ndarray) -> np.ndarray:
        return held.sums(place, candidates, bins, [count, count + 1]) / unit

    for number in range(spec.n_estimators):
        start, end = 0, n  # rows that have a say stand first, the others last
        for a in range(0, n, STEP):
            b = min(a + STEP, n)
            drawn = unit_draws(keys[a:b], spec.seed, number) < spec.subsample
            counted, others = np.flatnonzero(drawn), np.flatnonzero(~drawn)
            p = 1 / (1 + np.exp(-margin[a:b].take(counted)))
            some, rest = slice(start, start := start + len(counted)), slice(end - len(others), end)
            end -= len(others)
            side = held.sides[0]
            for array, word in zip(side, words):
                array[some], array[rest] = word[a:b].take(counted), word[a:b].take(others)
            np.rint((p - labels[a:b].take(counted)) * unit, out=side[count][some])
            np.rint(p * (1 - p) * unit, out=side[count + 1][some])
            side[count + 2][some], side[count + 2][rest] = counted + a, others + a
        place, aside = {0: (0, 0, start)}, {0: (0, start, n)}
        growing = _sorted_tree(spec, number, held, place, arrays, sums_of, weights, len(layout.features), bins)
        if spec.gamma > 0:
            _taken_back(growing, np.arange(len(growing.tree)), spec.gamma)
        value = leaf_values(spec, growing.stats, weights)[0]
        for node in np.flatnonzero(growing.left >= 0).tolist():  # parents come before their children
            if growing.feature[node] < 0:
                value[growing.left[node] : growing.left[node] + 2] = value[node]
                continue
            for rows, along in ((place, arrays[-1:]), (aside, [*arrays[:count], arrays[-1]])):
                if node in rows:
                    held.split(rows, node, int(growing.feature[node]), int(growing.cut[node]), int(growing.left[node]), along)
        for rows in (place, aside):
            for node, (side, a, b) in rows.items():
                margin[held.sides[side][-1][a:b]] += value[node]
        yield growing


def _copies(rows: BinnedRows, specs: list[Spec], fits: list[int]) -> int:
    """Tasks that grow a fit: the trees of forests do not wait for each other, so those of few large fits go to more tasks."""
    if any(s.boosting for s in specs) or min(sum(rows.rows[fit]) for fit in fits) < SORTED_ROWS:
        return 1
    wanted = -(-3 * rows.table.sparkSession.sparkContext.defaultParallelism // len(fits))
    return max(1, min(wanted, min(s.n_estimators for s in specs) // TREES_A_TASK))


def _grown_here(rows: BinnedRows, specs: list[Spec], weights: np.ndarray, base: np.ndarray) -> list[list[tuple]]:
    """The trees of every spec whose fit is one block: its rows meet in one task, or in a few, and one job grows them all."""
    if not specs:
        return []
    # The largest fits start first, so that none is left over at the end.
    fits, width, bins = sorted({s.fit for s in specs}, key=lambda fit: (-sum(rows.rows[fit]), fit)), rows.width, rows.bins
    copies = _copies(rows, specs, fits)
    kinds, layout = [pa.int32()] * 6 + [pa.float64()] * 3, Layout.of([len(c) + 1 for c in rows.cuts])
    names = [name.split()[0] for name in TREE_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for task, keys, labels, cells, _ in _fits(batches, width):
            fit, copy = divmod(task, copies)
            if by_node := len(keys) >= SORTED_ROWS:
                cells = layout.packed(cells)
            else:
                order = np.lexsort((labels, keys))  # sums do not depend on the order of arrival
                keys, labels, cells = keys[order], labels[order], np.ascontiguousarray(cells[order])
            for k, spec in enumerate(specs):
                if spec.fit != fit:
                    continue
                numbers = range(copy, spec.n_estimators, copies)
                if spec.boosting:
                    some = _sorted_boosted(spec, keys, labels, cells, layout, base[k], bins) if by_node else _boosted_here(spec, keys, labels, cells, base[k], bins)
                elif by_node:
                    some = _sorted_forest(spec, keys, labels, cells, layout, weights[k], bins, numbers)
                else:
                    some = _forest_here(spec, keys, labels, cells, weights[k], bins, numbers)
                for number, g in zip(numbers, some, strict=True):
                    n = len(g.tree)
                    columns = (np.full(n, k), np.full(n, number), np.arange(n), g.feature, g.cut, g.left, g.gain, g.stats[:, 0], g.stats[:, 1])
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)).cast(t) for c, t in zip(columns, kinds, strict=True)], names)

    table = rows.table.where(F.col("fit").isin(fits))
    if copies > 1:
        table = table.withColumn("copy", F.explode(F.array(*[F.lit(c) for c in range(copies)])))
    copy = F.col("copy") if copies > 1 else F.lit(0)
    place = (F.array_position(F.array(*[F.lit(f) for f in fits]), F.col("fit")).cast("int") - 1) * copies + copy
    dealt = table.repartitionById(len(fits) * copies, place).withColumn("fit", F.col("fit") * copies + copy).drop("copy")
    found = dealt.mapInArrow(run, TREE_SCHEMA).toArrow().sort_by([("spec", "ascending"), ("tree", "ascending"), ("node", "ascending")])
    column = {name: found[name].to_numpy() for name in names}
    roots = [*np.flatnonzero(column["node"] == 0).tolist(), len(found)]
    trees: list[list[tuple]] = [[] for _ in specs]
    for a, b in zip(roots, roots[1:]):
        stats = np.stack([column["stat0"][a:b], column["stat1"][a:b]], axis=1)
        trees[column["spec"][a]].append((column["feature"][a:b], column["cut"][a:b], column["left"][a:b], column["gain"][a:b], stats))
    return trees


def _taken_back(growing: Growing, tree_nodes: np.ndarray, gamma: float) -> None:
    """Undo splits into two leaves that win less than gamma, again and again (children come after their parents)."""
    for node in tree_nodes[::-1].tolist():
        if growing.feature[node] >= 0 and growing.gain[node] < gamma:
            left = growing.left[node]
            if growing.feature[left] < 0 and growing.feature[left + 1] < 0:
                growing.feature[node] = -1


def _breadth_first(feature: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The nodes that are reached from the root, level by level: as they were grown, if none was taken back."""
    lefts = left[feature >= 0]
    if len(feature) == 2 * len(lefts) + 1 and (lefts == 1 + 2 * np.arange(len(lefts))).all():
        return np.arange(len(feature))
    order = [0]
    for node in order:  # grows while it is read
        if feature[node] >= 0:
            order += [int(left[node]), int(left[node]) + 1]
    return np.array(order)


def _ensemble(spec: Spec, trees: list[tuple], base: float, cuts: list[np.ndarray], weights: np.ndarray) -> TreeEnsemble:
    """One ensemble from (feature, cut, left, gain, stats) per tree; nodes that were taken back go."""
    parts, roots, first = [], [], 0
    at_cut = np.zeros((len(cuts), max([1, *map(len, cuts)])))
    for f, some in enumerate(cuts):
        at_cut[f, : len(some)] = some
    for feature, cut, left, gain, stats in trees:
        kept, order = np.zeros(len(feature), np.int64), _breadth_first(feature, left)
        kept[order] = np.arange(len(order))
        inner = feature[order] >= 0
        threshold = np.where(inner, at_cut[np.maximum(feature[order], 0), np.where(inner, cut[order], 0)], 0.0)
        value, cover = leaf_values(spec, stats[order], weights)
        parts.append((feature[order], threshold, np.where(inner, kept[left[order]] + first, -1), value, cover, np.where(inner, gain[order], 0)))
        roots.append(first)
        first += len(order)
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.empty(0, np.int64)] * 6
    return TreeEnsemble(spec.boosting, base, len(cuts), np.array(roots, np.int64), *columns)


def leaf_values(spec: Spec, stats: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Value and cover of nodes from their two sums."""
    if spec.boosting:
        return -spec.learning_rate * _shrunk(stats[:, 0], spec.reg_alpha) / np.maximum(stats[:, 1] + spec.reg_lambda, 1e-300), stats[:, 1]
    weighted = stats * weights
    cover = weighted.sum(axis=1)
    return np.divide(weighted[:, 1], cover, out=np.zeros(len(cover)), where=cover > 0), cover


def _parts_by_tree(growing: Growing) -> list[tuple]:
    """(feature, cut, left, gain, stats) of each tree, its root first, places counted inside the tree."""
    order = np.argsort(growing.tree, kind="stable")
    ends = np.cumsum(np.bincount(growing.tree, minlength=len(growing.spec_of_tree)))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order)) - np.repeat(ends - np.diff(ends, prepend=0), np.diff(ends, prepend=0))
    out = []
    for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
        some = order[a:b]
        left = growing.left[some]
        out.append((growing.feature[some], growing.cut[some], np.where(left >= 0, place[left], -1), growing.gain[some], growing.stats[some]))
    return out


def grow_forests(rows: BinnedRows, specs: list[Spec], balanced: bool = True) -> list[TreeEnsemble]:
    """One forest per spec; fits of one block in one job, the others in as many jobs as the deepest has levels."""
    weights = np.array([rows.class_weights(s.fit) if balanced else (1.0, 1.0) for s in specs])
    here = [k for k, s in enumerate(specs) if rows.one_block(s.fit)]
    trees = dict(zip(here, _grown_here(rows, [specs[k] for k in here], weights[here], np.zeros(len(here))), strict=True))
    if far := [k for k in range(len(specs)) if k not in trees]:
        some = [specs[k] for k in far]
        spec_of_tree = np.repeat(np.arange(len(some)), [s.n_estimators for s in some])
        growing = Growing(spec_of_tree, np.concatenate([np.arange(s.n_estimators) for s in some]))
        _grow(some, growing, weights[far], rows.width, rows.bins, _by_jobs(rows))
        trees |= {k: [] for k in far}
        for tree, spec in zip(_parts_by_tree(growing), spec_of_tree.tolist(), strict=True):
            trees[far[spec]].append(tree)
    return [_ensemble(spec, trees[k], 0.0, rows.cuts, weights[k]) for k, spec in enumerate(specs)]


def grow_boosted(rows: BinnedRows, specs: list[Spec], on_round=None) -> list[TreeEnsemble]:
    """One boosted ensemble per spec; fits of one block in one job, the others round by round together: rounds times depth jobs.

    The log-odds start at those of the fit's classes. They are written with the rows every ROUNDS_KEPT rounds; in between a
    row walks the few trees made since, so the work of a round does not grow with the rounds before it.
    ``on_round`` is called with the round and the trees so far, for watching a fit; all fits then go round by round.
    """
    base = np.array([_log_odds(*rows.rows[s.fit]) for s in specs])
    here = [] if on_round else [k for k, s in enumerate(specs) if rows.one_block(s.fit)]
    if here:
        trees = _grown_here(rows, [specs[k] for k in here], np.ones((len(here), 2)), base[here])
        found = {k: _ensemble(specs[k], t, float(base[k]), rows.cuts, np.ones(2)) for k, t in zip(here, trees, strict=True)}
        far = [k for k in range(len(specs)) if k not in found]
        found |= dict(zip(far, grow_boosted(rows, [specs[k] for k in far]), strict=True))
        return [found[k] for k in range(len(specs))]
    weights, boosters = np.ones((len(specs), 2)), {}
    for k, spec in enumerate(specs):
        boosters.setdefault(spec.fit, []).append(k)
    made: list[list[tuple]] = [[] for _ in specs]
    pending: list[list[tuple]] = [[] for _ in specs]
    for number in range(max((s.n_estimators for s in specs), default=0)):
        if number and number % ROUNDS_KEPT == 0:
            rows = _with_margins(rows, specs, boosters, pending, base)
            pending = [[] for _ in specs]
        on = np.array([k for k, s in enumerate(specs) if number < s.n_estimators])
        growing = Growing(on, np.full(len(on), number))
        _grow(specs, growing, weights, rows.width, rows.bins, _by_jobs(rows), {"boosters": boosters, "pending": pending, "base": base})
        for tree, k in enumerate(on.tolist()):
            if specs[k].gamma > 0:
                _taken_back(growing, np.flatnonzero(growing.tree == tree), specs[k].gamma)
        for k, tree in zip(on.tolist(), _parts_by_tree(growing), strict=True):
            feature, cut, left, _, stats = tree
            made[k].append(tree)
            pending[k].append((feature, cut, left, leaf_values(specs[k], stats, weights[k])[0], specs[k].max_depth))
        if on_round:
            on_round(number, made)
    return [_ensemble(spec, made[k], float(base[k]), rows.cuts, weights[k]) for k, spec in enumerate(specs)]


def _log_odds(negatives: int, positives: int) -> float:
    if not negatives or not positives:
        raise ValueError("boosting needs rows of both classes")
    return math.log(positives / negatives)


def _with_margins(rows: BinnedRows, specs: list[Spec], boosters: dict, pending: list, base: np.ndarray) -> BinnedRows:
    """The rows written again, with the log-odds of all rounds so far."""
    nothing = np.empty(0, np.int64)
    level = Level(specs, {}, nothing, nothing, nothing, nothing, nothing, nothing, 0, np.empty((0, 1)), nothing, nothing, rows.bins, boosters, pending, base)
    shared, width = rows.table.sparkSession.sparkContext.broadcast(level), rows.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fit, keys, labels, bins, written in _fits(batches, width):
            margins = np.stack(list(_margins(shared.value, fit, bins, written).values()) or [np.zeros(len(bins))], axis=1)
            cells = [as_binary(c, len(bins)) for c in (bins, margins)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bins), fit, np.int32)), pa.array(keys), pa.array(labels.astype(np.int32)), *cells], ["fit", "key", "label", "bins", "margins"])

    return BinnedRows(cut_lineage(rows.table.mapInArrow(run, ROWS_SCHEMA)), rows.cuts, rows.rows)
