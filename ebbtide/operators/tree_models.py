"""Fitted tree ensembles: flat node arrays, probabilities by vectorised walks, importances, and a table to keep them in.

The size of an ensemble follows its parameters (trees and depth), never the rows it was fitted on, so it can be sent to
the tasks. A node table has one row per node and is what other engines would read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODE_SCHEMA = "tree int, node int, feature int, threshold double, left int, value double, cover double, gain double"
#: Rows walked through the trees at a time, and leaves of a tree that is looked up instead.
ROWS_AT_ONCE, LEAVES_IN_MASK = 1 << 14, 64


@dataclass(frozen=True)
class TreeEnsemble:
    """Nodes of all trees one after the other; ``left`` is the place of the left child, the right one follows it.

    A row goes left where its feature is at most the threshold. ``feature`` is -1 in a leaf. A forest's value is the
    weighted share of class 1 in the leaf, and the mean over trees is the probability; boosting adds up log-odds.
    ``cover`` is the weight (forest) or curvature (boosting) of the training rows in a node, ``gain`` what its split won.
    """

    boosting: bool
    base: float
    width: int
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    gain: np.ndarray

    @cached_property
    def steps(self) -> Steps:
        return steps_of(self)

    def sums(self, x: np.ndarray) -> np.ndarray:
        """Sum of the leaf values of every row, one row of features each."""
        total, steps = np.zeros(len(x)), self.steps
        for at in range(0, len(x), ROWS_AT_ONCE):
            part, some = np.asarray(x[at : at + ROWS_AT_ONCE], float), total[at : at + ROWS_AT_ONCE]
            codes = codes_of(steps.cuts, part)
            flat, offsets = codes.ravel(), np.arange(len(part)) * codes.shape[1]
            columns = [np.ascontiguousarray(codes[:, f], dtype=np.intp) for f in range(codes.shape[1])]
            for root, depth, masks, leaves in zip(self.roots.tolist(), steps.depth, steps.masks, steps.leaves, strict=True):
                if masks:
                    left = np.full(len(part), ~np.uint64(0))
                    for f, mask in masks:
                        left &= mask.take(columns[f])
                    some += leaves.take(np.bitwise_count((left & (~left + np.uint64(1))) - np.uint64(1)))
                    continue
                place = np.full(len(part), root)
                for _ in range(depth):
                    right = flat.take(offsets + steps.feature.take(place)) > steps.cut.take(place)
                    place = steps.left.take(place) + right
                some += self.value.take(place)
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.base - self.sums(x))) if self.boosting else self.sums(x) / max(1, len(self.roots))

    def importances(self) -> np.ndarray:
        """Per feature, summing to 1: the mean over trees of each tree's shares of gain (forest), the mean gain of a split (boosting)."""
        split = self.feature >= 0
        if self.boosting:
            gain = np.bincount(self.feature[split], self.gain[split], self.width)
            mean = gain / np.maximum(np.bincount(self.feature[split], minlength=self.width), 1)
        else:
            tree = np.searchsorted(self.roots, np.flatnonzero(split), side="right") - 1
            by_tree = np.bincount(tree * self.width + self.feature[split], self.gain[split], len(self.roots) * self.width).reshape(-1, self.width)
            whole = by_tree.sum(axis=1, keepdims=True)
            mean = np.divide(by_tree, whole, out=np.zeros_like(by_tree), where=whole > 0).mean(axis=0) if len(by_tree) else np.zeros(self.width)
        return mean / mean.sum() if mean.sum() > 0 else np.full(self.width, 1 / self.width)

    def nodes(self) -> pa.Table:
        ends = np.append(self.roots[1:], len(self.feature))
        sizes = ends - self.roots
        start = np.repeat(self.roots, sizes)
        columns = {
            "tree": np.repeat(np.arange(len(self.roots)), sizes).astype(np.int32),
            "node": (np.arange(len(self.feature)) - start).astype(np.int32),
            "feature": self.feature.astype(np.int32), "threshold": self.threshold,
            "left": np.where(self.feature >= 0, self.left - start, -1).astype(np.int32),
            "value": self.value, "cover": self.cover, "gain": self.gain,
        }
        return pa.table(columns)


@dataclass(frozen=True)
class Steps:
    """An ensemble made ready for walking by ``codes_of``: a row goes right where its code is above the ``cut`` of a node.

    Leaves lead to themselves. A tree of at most LEAVES_IN_MASK leaves is not walked: ``masks`` holds, by feature and code,
    the leaves that stay possible (a bit each, from left to right), and a row ends in the first one that no feature excludes.
    """

    cuts: list[np.ndarray]
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    depth: list[int]
    masks: list[list[tuple[int, np.ndarray]]]
    leaves: list[np.ndarray | None]


def codes_of(cuts: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    """For every value, how many of its feature's ascending cuts are below it; none for NaN, which is above nothing."""
    codes = np.zeros(x.shape, np.min_scalar_type(max(map(len, cuts), default=0) + 1))
    for f, some in enumerate(cuts):
        if len(some):
            codes[:, f] = np.where(np.isnan(x[:, f]), 0, np.searchsorted(some, x[:, f]))
    return codes


def steps_of(trees: TreeEnsemble) -> Steps:
    inner = trees.feature >= 0
    cuts = [np.unique(trees.threshold[trees.feature == f]) for f in range(trees.width)]
    cut = np.full(len(inner), max(map(len, cuts), default=0) + 1, np.min_scalar_type(max(map(len, cuts), default=0) + 1))
    for f, some in enumerate(cuts):
        cut[trees.feature == f] = np.searchsorted(some, trees.threshold[trees.feature == f])
    left = np.where(inner, trees.left, np.arange(len(inner)))
    depths, masks, leaves = [], [], []
    for root, end in zip(trees.roots.tolist(), [*trees.roots[1:].tolist(), len(inner)]):
        level, depth = [root], 0
        while below := [child for node in level if inner[node] for child in (int(left[node]), int(left[node]) + 1)]:
            level, depth = below, depth + 1
        small = 1 < (~inner[root:end]).sum() <= LEAVES_IN_MASK
        depths.append(depth)
        masks.append(_masks(trees.feature, cut, left, root, [len(some) for some in cuts]) if small else [])
        leaves.append(trees.value[_leaves(trees.feature, left, root)] if small else None)
    return Steps(cuts, np.maximum(trees.feature, 0), cut, left, depths, masks, leaves)


def _leaves(feature: np.ndarray, left: np.ndarray, node: int) -> list[int]:
    """The leaves below a node from left to right."""
    return [node] if feature[node] < 0 else [leaf for child in (int(left[node]), int(left[node]) + 1) for leaf in _leaves(feature, left, child)]


def _masks(feature: np.ndarray, cut: np.ndarray, left: np.ndarray, root: int, sizes: list[int]) -> list[tuple[int, np.ndarray]]:
    """The possible leaves by feature and code: a row above a node's cut ends in no leaf of its left side."""
    found: dict[int, np.ndarray] = {}

    def below(node: int, first: int) -> int:
        """Number of leaves below a node whose leftmost leaf is the given one."""
        f = int(feature[node])
        if f < 0:
            return 1
        lefts = below(int(left[node]), first)
        mask = found.setdefault(f, np.full(sizes[f] + 1, ~np.uint64(0)))
        mask[int(cut[node]) + 1 :] &= ~np.uint64(((1 << lefts) - 1) << first)
        return lefts + below(int(left[node]) + 1, first + lefts)

    below(root, 0)
    return list(found.items())


def probability_column(df: DataFrame, ensemble: TreeEnsemble, features: list[str]) -> Column:
    """Class-1 probability of the feature columns; a narrow expression in Arrow batches."""
    held = df.sparkSession.sparkContext.broadcast(ensemble)

    @F.pandas_udf("double")
    def scored(*columns: pd.Series) -> pd.Series:
        return pd.Series(held.value.probability(np.column_stack([c.to_numpy(dtype=float) for c in columns])))

    return scored(*[F.col(f"`{name}`").cast("double") for name in features])


def save_ensemble(spark: SparkSession, ensemble: TreeEnsemble, path: str) -> None:
    head = spark.createDataFrame([(ensemble.boosting, ensemble.base, ensemble.width)], "boosting boolean, base double, width int")
    head.coalesce(1).write.mode("overwrite").parquet(f"{path}/ensemble")
    spark.createDataFrame(ensemble.nodes()).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")


def load_ensemble(spark: SparkSession, path: str) -> TreeEnsemble:
    head = spark.read.parquet(f"{path}/ensemble").first()
    nodes = spark.read.schema(NODE_SCHEMA).parquet(f"{path}/nodes").toArrow().sort_by([("tree", "ascending"), ("node", "ascending")])
    column = {name: nodes[name].to_numpy() for name in nodes.column_names}
    roots = np.flatnonzero(column["node"] == 0)
    feature, place = column["feature"].astype(np.int64), np.repeat(roots, np.diff(np.append(roots, len(nodes))))
    left = np.where(feature >= 0, column["left"] + place, -1)
    return TreeEnsemble(head["boosting"], head["base"], head["width"], roots, feature, column["threshold"], left, column["value"], column["cover"], column["gain"])
