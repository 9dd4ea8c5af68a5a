"""Regularised logistic regressions of many fits and many penalties at once, by Newton steps from one aggregate each.

A fit is one set of training rows; a spec asks for one penalty C on it. Every pass over the written rows sums the loss, the
gradient and the curvature of all specs; the driver, which holds (features + 1)^2 numbers per spec, solves for the next
point. The objective is C * sum of weighted log losses + |coefficients|^2 / 2, the intercept is free, features are scaled
by the mean and population deviation of their own fit. Folds and candidates cost memory, not passes: the search over C takes
as many jobs as one fit. A step that does not lower the objective is halved, so the result does not depend on the start.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.operators.arrow_bytes import binary_bytes
from ebbtide.operators.linear import LinearModel, ScalerState
from ebbtide.session import cut_lineage

#: Largest gradient per unit of weight at which a spec counts as solved; rows of a block.
TOLERANCE, BLOCK_ROWS = 1e-12, 250_000
ROWS_SCHEMA = "fit int, label int, x binary"


@dataclass(frozen=True)
class LogisticSpec:
    fit: int
    C: float = 1.0
    max_iter: int = 1000


@dataclass(frozen=True)
class FitRows:
    """The written rows of all fits, with each fit's class counts and scaling."""

    table: DataFrame
    features: list[str]
    counts: dict[int, tuple[int, int]]
    scalers: dict[int, ScalerState]

    def class_weights(self, fit: int) -> tuple[float, float]:
        total = sum(self.counts[fit])
        return tuple(total / (2 * n) if n else 0.0 for n in self.counts[fit])


def fit_rows(df: DataFrame, features: list[str], label: str, fit: str = "fit") -> FitRows:
    """Write the rows of all fits block by block; class counts and scaling come from one aggregate."""
    columns = [F.col(f"`{name}`").cast("double") for name in features]
    found = df.groupBy(F.col(fit).alias("fit")).agg(
        F.count_if(F.col(label) == 0).alias("negatives"), F.count_if(F.col(label) == 1).alias("positives"), F.count("*").alias("n"),
        *[F.avg(x).alias(f"m{i}") for i, x in enumerate(columns)], *[F.stddev_pop(x).alias(f"s{i}") for i, x in enumerate(columns)],
    ).collect()
    if any(r["negatives"] + r["positives"] != r["n"] for r in found):
        raise ValueError(f"{label} must be binary and not NULL")
    width = range(len(features))
    scalers = {r["fit"]: ScalerState([r[f"m{i}"] for i in width], [r[f"s{i}"] if r[f"s{i}"] > 0 else 1.0 for i in width]) for r in found}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(i + 2).to_numpy(zero_copy_only=False).astype(float) for i in width])
            yield pa.RecordBatch.from_arrays([batch["fit"], batch["label"], pa.array([row.tobytes() for row in x], pa.binary())], ["fit", "label", "x"])

    blocks = max(1, math.ceil(max((r["n"] for r in found), default=0) / BLOCK_ROWS))
    named = [x.alias(f"x{i}") for i, x in enumerate(columns)]
    picked = df.select(F.col(fit).cast("int").alias("fit"), F.col(label).cast("int").alias("label"), *named)
    dealt = picked.repartitionByRange(max(1, len(found) * blocks), "fit", F.pmod(F.xxhash64(*[f"x{i}" for i in width]), F.lit(blocks)))
    return FitRows(cut_lineage(dealt.mapInArrow(run, ROWS_SCHEMA)), features, {r["fit"]: (r["negatives"], r["positives"]) for r in found}, scalers)


def _pass(rows: FitRows, specs: list[LogisticSpec], points: dict[int, np.ndarray], weights: np.ndarray) -> dict[int, np.ndarray]:
    """Loss, gradient and curvature of the weighted log loss at the given points, by spec, as one array each."""
    width = len(rows.features)
    scaling = {fit: (np.array(s.mean), np.array(s.scale)) for fit, s in rows.scalers.items()}
    of_fit: dict[int, list[int]] = {}
    for k in points:
        of_fit.setdefault(specs[k].fit, []).append(k)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            fits, labels = batch["fit"].to_numpy(), batch["label"].to_numpy()
            x = binary_bytes(batch["x"]).view(float).reshape(-1, width)
            for fit in np.unique(fits).tolist():
                if fit not in of_fit:
                    continue
                some = fits == fit
                mean, scale = scaling[fit]
                design, y = np.column_stack([(x[some] - mean) / scale, np.ones(some.sum())]), labels[some]
                for k in of_fit[fit]:
                    margin, weight = design @ points[k], weights[k][y]
                    p = 1 / (1 + np.exp(-margin))
                    loss = weight @ (np.logaddexp(0, margin) - y * margin)
                    curvature = (design * (weight * p * (1 - p))[:, None]).T @ design
                    made = np.concatenate([[loss], design.T @ (weight * (p - y)), curvature.ravel()])
                    sums[k] = sums[k] + made if k in sums else made
        if sums:
            block = TaskContext.get().partitionId()
            columns = [pa.array(list(sums), pa.int32()), pa.array([block] * len(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["spec", "block", "sums"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sums = None, None
        for batch in batches:
            for spec, some in zip(batch["spec"].to_pylist(), batch["sums"].to_pylist(), strict=True):
                if spec != at:
                    if at is not None:
                        yield _total(at, sums)
                    at, sums = spec, np.zeros(len(some) // 8)
                sums = sums + np.frombuffer(some, float)
        if at is not None:
            yield _total(at, sums)

    partials = rows.table.mapInArrow(partial, "spec int, block int, sums binary")
    parts = min(len(points), int(rows.table.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    summed = partials.repartition(parts, "spec").sortWithinPartitions("spec", "block").mapInArrow(total, "spec int, sums binary")
    return {r["spec"]: np.frombuffer(r["sums"], float) for r in summed.collect()}


def _total(spec: int, sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([spec], pa.int32()), pa.array([sums.tobytes()], pa.binary())], ["spec", "sums"])


def fit_logistic(rows: FitRows, specs: list[LogisticSpec]) -> list[LinearModel]:
    """One linear model per spec; ``max_iter`` limits the passes, of which a handful is enough."""
    size = len(rows.features) + 1
    weights = np.array([rows.class_weights(s.fit) for s in specs])
    penalty = np.append(np.ones(size - 1), 0.0)
    solved = {k: np.zeros(size) for k in range(len(specs))}
    steps = {k: np.zeros(size) for k in range(len(specs))}
    best = {k: math.inf for k in range(len(specs))}
    going, trials = set(solved), dict(solved)
    for number in range(max((s.max_iter for s in specs), default=0)):
        going = {k for k in going if number < specs[k].max_iter}
        if not going:
            break
        for k, sums in _pass(rows, specs, {k: trials[k] for k in going}, weights).items():
            c, point = specs[k].C, trials[k]
            value = c * sums[0] + (penalty * point) @ point / 2
            if value > best[k] + 1e-12 * abs(best[k]) and np.abs(steps[k]).max() > 1e-12:
                steps[k] = steps[k] / 2
                trials[k] = solved[k] + steps[k]
                continue
            best[k], solved[k] = min(value, best[k]), point
            gradient = c * sums[1 : size + 1] + penalty * point
            if np.abs(gradient).max() <= TOLERANCE * c * sum(rows.counts[specs[k].fit]):
                going.discard(k)
                continue
            curvature = c * sums[size + 1 :].reshape(size, size) + np.diag(penalty)
            steps[k] = -np.linalg.lstsq(curvature, gradient, rcond=None)[0]
            trials[k] = point + steps[k]
            if np.abs(steps[k]).max() < 1e-13:
                going.discard(k)
    return [LinearModel(rows.features, rows.scalers[s.fit], solved[k][:-1].tolist(), float(solved[k][-1])) for k, s in enumerate(specs)]
