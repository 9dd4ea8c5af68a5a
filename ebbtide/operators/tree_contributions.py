"""Additive per-feature contributions of tree ensembles (path-dependent Shapley values).

A leaf adds ``value * prod_j g_j`` to the prediction, where ``g_j`` is 1 or 0 for a feature on its path that is known
(inside the leaf's interval or not) and the share of training weight that takes the same branches if it is unknown. The
Shapley average over the orders in which features become known is the integral over t in [0, 1] of the product with
``g_j = z_j (1 - t) + o_j t``; a Gauss-Legendre rule with half as many points as features gives it exactly.

To the leaves below a node a row is only a place between the cuts of each of their features. Where there are at most
``PATTERNS`` combinations of such places, the contributions of these leaves are integrated once for each of them, and a
row looks them up; leaves with more are integrated for every row. Rows with a value that is not finite lie in no leaf's
interval of that feature and are always integrated.

The ensemble is a driver object from its fit on; its size follows its parameters (trees and depth), not the data. Its
leaves and tables are sent to the tasks in parts of a bounded number of cells, the contributions of a part are added to
those of the parts before, and the rows are written in between, so that no task holds more than one part. Rows are
explained where they are, in Arrow batches.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product, zip_longest

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.operators.classifiers import FittedClassifier
from ebbtide.operators.tree_models import TreeEnsemble
from ebbtide.session import cut_lineage

#: Combinations of places in a table at most, and rows that look up at a time.
PATTERNS, ROWS_LOOKED_UP = 64, 4096
ROWS_AT_ONCE = 64
CELLS_AT_ONCE = 1 << 20
#: Cells (leaves times features on their paths) sent to the tasks at a time: 32 bytes each.
CELLS_SENT = 2_000_000


@dataclass(frozen=True)
class Ensemble:
    """``groups`` holds, per number of path features, arrays over leaves: feature, low, high, share, leaf value.

    Plain arrays, because they are broadcast to tasks.
    """

    base: float
    width: int
    groups: list[tuple]


def _paths(trees: TreeEnsemble, node: int, path: dict):
    """(features on the way with their interval and share of cover, leaf) of every leaf below a node."""
    f = int(trees.feature[node])
    if f < 0:
        yield path, node
        return
    cut, left = trees.threshold[node], int(trees.left[node])
    low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
    for child, bounds in ((left, (low, min(high, cut))), (left + 1, (max(low, cut), high))):
        yield from _paths(trees, child, {**path, f: (*bounds, share * trees.cover[child] / trees.cover[node])})


def _values(trees: TreeEnsemble) -> np.ndarray:
    """What a node adds to the prediction; a forest's leaf counts for one tree of them all."""
    return trees.value if trees.boosting else trees.value / len(trees.roots)


def _grouped(found: list[tuple[dict, float]]) -> list[tuple]:
    """Leaves, given as path and value, as arrays by the number of path features."""
    by_size = defaultdict(list)
    for path, value in found:
        by_size[len(path)].append((path, value))
    groups = []
    for _, some in sorted(by_size.items()):
        items = [list(path.items()) for path, _ in some]
        columns = [np.array([[b[k] for _, b in item] for item in items]) for k in range(3)]
        groups.append((np.array([[f for f, _ in item] for item in items]), *columns, np.array([v for _, v in some])))
    return groups


def leaves(trees: TreeEnsemble) -> Ensemble:
    """The leaves of all trees with their paths."""
    value, base, found = _values(trees), trees.base, []
    for root in trees.roots.tolist():
        for path, leaf in _paths(trees, root, {}):
            base += value[leaf] * trees.cover[leaf] / trees.cover[root]
            if path:
                found.append((path, value[leaf]))
    return Ensemble(base, trees.width, _grouped(found))


@dataclass(frozen=True)
class Table:
    """Contributions of some leaves by the place of a row: the sum of the steps of the cuts that it exceeds."""

    cuts: list[tuple[int, float, int]]  # feature, cut, step
    features: list[int]
    values: np.ndarray  # by feature, by place


def _units(trees: TreeEnsemble, node: int, path: dict) -> tuple[list[tuple], list[list[tuple]]]:
    """The leaves below a node: those that can still share a table with others, and the tables' worth of leaves so far."""
    f = int(trees.feature[node])
    if f < 0:
        return [(path, node)], []
    cut, left = trees.threshold[node], int(trees.left[node])
    low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
    sides, done = [], []
    for child, bounds in ((left, (low, min(high, cut))), (left + 1, (max(low, cut), high))):
        open_leaves, made = _units(trees, child, {**path, f: (*bounds, share * trees.cover[child] / trees.cover[node])})
        sides.append(open_leaves)
        done += made
    if all(sides) and _places(sides[0] + sides[1]) <= PATTERNS:
        return sides[0] + sides[1], done
    return [], done + [side for side in sides if side]


def _cuts(found: list[tuple]) -> dict[int, list[float]]:
    """The ascending finite bounds of every feature on the leaves' paths."""
    bounds = defaultdict(set)
    for path, _ in found:
        for f, (low, high, _) in path.items():
            bounds[f] |= {float(b) for b in (low, high) if np.isfinite(b)}
    return {f: sorted(b) for f, b in sorted(bounds.items())}


def _places(found: list[tuple]) -> int:
    places = 1
    for cuts in _cuts(found).values():
        places *= len(cuts) + 1
    return places


def _table(found: list[tuple], value: np.ndarray) -> Table:
    """The contributions of some leaves to a row of every combination of places; shorter paths are filled up with a
    feature whose every value is inside, which changes nothing."""
    by_feature = _cuts(found)
    features, steps, step = list(by_feature), [], 1
    for f in reversed(features):
        steps += [(f, cut, step) for cut in by_feature[f]]
        step *= len(by_feature[f]) + 1
    # One row for each place: the upper end of the interval of each feature.
    x = np.array(list(product(*[[*by_feature[f], np.inf] for f in features])))
    width = max(len(path) for path, _ in found)
    rows = [[(features.index(f), *b) for f, b in path.items()] + [(0, -np.inf, np.inf, 1.0)] * (width - len(path)) for path, _ in found]
    at, low, high, share = (np.array([[cell[k] for cell in row] for row in rows]) for k in range(4))
    seen = x[:, at.astype(int)]
    to_feature = np.zeros((at.size, len(features)))
    to_feature[np.arange(at.size), at.astype(int).ravel()] = 1.0
    leaf_value = np.array([value[leaf] for _, leaf in found])
    parts = _integrated(((seen > low) & (seen <= high)).astype(float), share, leaf_value)
    return Table(steps, features, np.ascontiguousarray((parts.reshape(len(x), -1) @ to_feature).T))


def tables_and_leaves(trees: TreeEnsemble) -> tuple[list[Table], list[tuple], list[tuple]]:
    """Tables, the leaves they stand for, and the leaves that have too many places for one."""
    value, tables, tabled, others = _values(trees), [], [], []
    for root in trees.roots.tolist():
        some, units = _units(trees, root, {})
        for unit in [*units, *([some] if some else [])]:
            unit = [(path, leaf) for path, leaf in unit if path]
            if not unit:
                continue
            if small := _places(unit) <= PATTERNS:
                tables.append(_table(unit, value))
            (tabled if small else others).extend((path, value[leaf]) for path, leaf in unit)
    return tables, _grouped(tabled), _grouped(others)


def looked_up(tables: list[Table], width: int, x: np.ndarray) -> np.ndarray:
    """Contribution of every feature (columns) for every row of finite values."""
    total = np.zeros((width, len(x)))
    for start in range(0, len(x), ROWS_LOOKED_UP):
        part, column = total[:, start : start + ROWS_LOOKED_UP], np.ascontiguousarray(x[start : start + ROWS_LOOKED_UP].T)
        for table in tables:
            place = np.zeros(part.shape[1], np.int64)
            for f, cut, step in table.cuts:
                place += (column[f] > cut) * step
            for f, values in zip(table.features, table.values, strict=True):
                part[f] += values.take(place)
    return total.T


def _integrated(inside: np.ndarray, share: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Contributions by (row, leaf, path feature), from whether the row is inside the leaf's interval of the feature."""
    points, weights = np.polynomial.legendre.leggauss((share.shape[1] + 1) // 2)
    average = np.zeros_like(inside)
    for t, w in zip((points + 1) / 2, weights / 2):
        factor = share * (1 - t) + inside * t
        average += w * factor.prod(axis=2, keepdims=True) / factor
    return value[None, :, None] * (inside - share) * average


def contributions(groups: list[tuple], width: int, x: np.ndarray) -> np.ndarray:
    """Contribution of every feature (columns) for every row."""
    total = np.zeros((len(x), width))
    for leaves in groups:
        m = leaves[0].shape[1]
        step = max(1, CELLS_AT_ONCE // (m * ROWS_AT_ONCE))
        for start in range(0, len(leaves[0]), step):
            feature, low, high, share, value = (array[start : start + step] for array in leaves)
            to_feature = np.zeros((feature.size, width))
            to_feature[np.arange(feature.size), feature.ravel()] = 1.0
            for i in range(0, len(x), ROWS_AT_ONCE):
                seen = x[i : i + ROWS_AT_ONCE][:, feature]
                parts = _integrated(((seen > low) & (seen <= high)).astype(float), share, value)
                total[i : i + ROWS_AT_ONCE] += parts.reshape(len(parts), -1) @ to_feature
    return total


def parts_of(groups: list[tuple]) -> list[list[tuple]]:
    """The leaves cut into parts of at most CELLS_SENT cells."""
    parts, room = [[]], CELLS_SENT
    for leaves_of_size in groups:
        n, m = leaves_of_size[0].shape
        start = 0
        while start < n:
            if room < m and parts[-1]:
                parts.append([])
                room = CELLS_SENT
            end = min(n, start + max(1, room // m))
            parts[-1].append(tuple(array[start:end] for array in leaves_of_size))
            room -= (end - start) * m
            start = end
    return parts


def table_parts(tables: list[Table]) -> Iterator[list[Table]]:
    """The tables cut into parts as large as those of the leaves; one of their values is a quarter of a cell."""
    part, room = [], 4 * CELLS_SENT
    for table in tables:
        if table.values.size > room and part:
            yield part
            part, room = [], 4 * CELLS_SENT
        part.append(table)
        room -= table.values.size
    yield part


def with_tree_contributions(df: DataFrame, fitted: FittedClassifier, output: str = "contributions") -> DataFrame:
    """Adds an array with one contribution per feature; they sum to the margin minus the base value.

    Only the features reach Python.
    """
    features, context = fitted.features, df.sparkSession.sparkContext
    tables, tabled, others = tables_and_leaves(fitted.trees)
    parts = list(zip_longest(table_parts(tables), parts_of(tabled), parts_of(others), fillvalue=[]))
    for number, part in enumerate(parts):
        made = _explained(context.broadcast(part), features)
        if number:
            made = F.zip_with(output, made, lambda a, b: a + b)
        df = df.withColumn(output, made)
        df = cut_lineage(df) if number + 1 < len(parts) else df
    return df


def explained(tables: list[Table], tabled: list[tuple], others: list[tuple], width: int, x: np.ndarray) -> np.ndarray:
    """Contribution of every feature (columns) for every row, from the tables where they hold."""
    total, finite = contributions(others, width, x), np.isfinite(x).all(axis=1)
    total[finite] += looked_up(tables, width, x[finite])
    total[~finite] += contributions(tabled, width, x[~finite])
    return total


def _explained(held, features: list[str]) -> Column:
    @F.pandas_udf("array<double>")
    def explain(*columns: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(dtype=float) for c in columns])
        return pd.Series(list(explained(*held.value, len(features), x)))

    return explain(*[F.col(f"`{name}`").cast("double") for name in features])


def base_value(fitted: FittedClassifier) -> float:
    """What the ensemble predicts when no feature is known."""
    return leaves(fitted.trees).base
