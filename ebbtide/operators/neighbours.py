"""Exact k nearest neighbours of every row among all rows, without a cross join.

1. Equal vectors collapse to one point (with its first k+1 ids), so a large group of copies costs one row.
2. A k-d tree over a bounded sample gives at most ``MAX_CELLS`` cells; the rows of a cell are cut into blocks of at most
   ``BLOCK_ROWS``, so no task ever holds an unbounded group.
3. The k-th distance inside the own block bounds the search. A point visits only the blocks whose bounding box is
   within that bound: first the cells (their boxes fit in a closure of known size), then the blocks of those cells
   (an equi-join on the cell).
4. Points that visit a block meet its rows in chunks. One matrix product gives all distances to within rounding; those that
   can be within the bound are taken again, exactly. Each chunk returns k rows per point, and a ranked merge keeps k.

``neighbours_by_fold`` finds, from one such search, the neighbours that every row has when any one fold is left out.
``partitioned_neighbours`` is the other method to choose from: it bounds the visits instead and says what it misses.

Distance is plain Euclidean over the given columns; ties go to the smaller id.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.session import cut_lineage

BLOCK_ROWS = 2048
MAX_CELLS = 4096
CHUNK_POINTS = 8192
SAMPLE_POINTS = 50_000
PROBE_POINTS = 1024
#: Pairs per point within its reach from which a block's own k-th distances are taken as well; the fold of a row without one.
MANY, NO_FOLD = 64, -1
SLACK = 1e-9
TREES = 8


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All squared distances, summed column by column in order, so that every engine gets the same bits."""
    total = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        gap = a[:, i][:, None] - b[:, i][None, :]
        total += gap * gap
    return total


def _products(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All squared distances by one matrix product, and how far each row of them may be from ``squared_distances``."""
    with np.errstate(all="ignore"):
        middle = y.mean(axis=0)
        x0, y0 = x - middle, y - middle
        xx, yy = (x0 * x0).sum(axis=1), (y0 * y0).sum(axis=1)
        slack = 8 * (x.shape[1] + 8) * np.finfo(float).eps * (np.sqrt(xx) + np.sqrt(yy.max())) ** 2
    if not np.isfinite(slack).all():
        return squared_distances(x, y), np.zeros(len(x))
    return xx[:, None] + yy[None, :] - 2 * (x0 @ y0.T), slack


def distinct_points(rows: DataFrame, k: int, *by: str) -> DataFrame:
    """One row per distinct ``vec`` (and ``by``): a point key, its k+1 smallest ids, the smallest of them as tie-break.

    The rank limit is applied on both sides of the exchange, so copies do not travel.
    """
    order = Window.partitionBy("vec", *by).orderBy("id")
    first = rows.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1)
    points = first.groupBy("vec", *by).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    key = F.md5(F.concat_ws(",", F.col("vec").cast("array<string>"), *by))
    return points.select(key.alias("point"), "vec", *by, "ids", F.element_at("ids", 1).alias("first_id"))


def _sample_tree(points: DataFrame, n: int, block_rows: int) -> tuple[np.ndarray, np.ndarray, int, tuple[np.ndarray, np.ndarray]]:
    """Median splits on the widest column, in heap order, and probe points with their folds, from a bounded repeatable sample."""
    if n <= block_rows:
        return np.zeros(0, int), np.zeros(0), 0, (np.zeros((0, 0)), np.zeros(0, int))
    depth = min(int(math.log2(MAX_CELLS)), math.ceil(math.log2(2 * n / block_rows)))
    drawn = F.pmod(F.xxhash64("vec"), F.lit(1_000_000)) < F.lit(math.ceil(1e6 * min(1.0, SAMPLE_POINTS / n)))
    fold = F.col("fold") if "fold" in points.columns else F.lit(NO_FOLD)
    drawn_rows = points.filter(drawn).select("vec", fold).limit(2 * SAMPLE_POINTS).collect()
    sample, folds = np.array([row[0] for row in drawn_rows]), np.array([row[1] for row in drawn_rows], dtype=int)
    dims, values = np.zeros(2**depth - 1, int), np.full(2**depth - 1, np.inf)
    held = {0: sample}
    for node in range(2**depth - 1):
        part = held.pop(node)
        spread = part.max(axis=0) - part.min(axis=0) if len(part) else np.zeros(1)
        if spread.max() > 0:
            dims[node] = int(np.argmax(spread))
            along = part[:, dims[node]]
            # Below the largest value, so that a value shared by most points still splits off.
            values[node] = min(float(np.median(along)), float(along[along < along.max()].max()))
        right = part[:, dims[node]] > values[node] if len(part) else np.zeros(0, bool)
        held[2 * node + 1], held[2 * node + 2] = part[~right], part[right]
    return dims, values, depth, (sample[:PROBE_POINTS], folds[:PROBE_POINTS])


def _cells(points: DataFrame, tree) -> DataFrame:
    """Adds the leaf cell of each point, and the coordinate along which the cell is next widest."""
    dims, values, depth, _ = tree
    if depth == 0:
        return points.withColumns({"cell": F.lit(0), "along": F.element_at("vec", 1)})

    @F.pandas_udf("struct<cell:int,along:double>")
    def leaf(vec: pd.Series) -> pd.DataFrame:
        x = np.stack(vec.to_numpy())
        node, rows = np.zeros(len(x), int), np.arange(len(x))
        for _ in range(depth):
            last = dims[node]
            node = 2 * node + 1 + (x[rows, last] > values[node])
        return pd.DataFrame({"cell": node - (2**depth - 1), "along": x[rows, last]})

    return points.withColumn("leaf", leaf("vec")).select(*points.columns, "leaf.cell", "leaf.along")


def _blocks(points: DataFrame, tree, block_rows: int) -> DataFrame:
    """Cuts every cell into stretches of equal length, none longer than ``block_rows``."""
    place = F.row_number().over(Window.partitionBy("cell").orderBy("along", "point")) - 1
    size = F.count("*").over(Window.partitionBy("cell"))
    number = F.floor(place * F.ceil(size / F.lit(block_rows)) / size).cast("int")
    return _cells(points, tree).withColumn("block", number).drop("along")


def _boxes(blocks: DataFrame, width: int) -> DataFrame:
    """Smallest and largest coordinates of every block."""
    lows = F.array(*[F.min(F.element_at("vec", i + 1)) for i in range(width)])
    highs = F.array(*[F.max(F.element_at("vec", i + 1)) for i in range(width)])
    return blocks.groupBy("cell", "block").agg(lows.alias("lows"), highs.alias("highs"))


def _kth(squared: np.ndarray, k: int) -> np.ndarray:
    if squared.shape[1] <= k:
        return np.full(len(squared), np.inf)
    return np.partition(squared, k, axis=1)[:, k]


def _kth_by_fold(squared: np.ndarray, own: np.ndarray, other: np.ndarray, k: int, folds: tuple[int, ...]) -> np.ndarray:
    """The k-th distance of each row, the largest of those with no fold and with any one other fold left out."""
    found = _kth(squared, k)
    for fold in folds:
        asking, counted = (own != fold) & (own != NO_FOLD), (other != fold) & (other != NO_FOLD)
        found[asking] = np.maximum(found[asking], _kth(squared[np.ix_(asking, counted)], k))
    return found


def _folds_of(rows: pd.DataFrame) -> np.ndarray:
    return rows["fold"].to_numpy() if "fold" in rows else np.full(len(rows), NO_FOLD)


def _with_reach(blocks: DataFrame, k: int, probes: tuple[np.ndarray, np.ndarray], folds: tuple[int, ...] = ()) -> DataFrame:
    """Upper bound of the k-th distance of each point, from its own block, or from the probes if that is too small."""

    def bound(block: pd.DataFrame) -> pd.DataFrame:
        x, own = np.stack(block["vec"].to_numpy()), _folds_of(block)
        enough = len(x) > k and all(((own != fold) & (own != NO_FOLD)).sum() > k for fold in folds)
        near, other = (x, own) if enough else probes
        reach = np.empty(len(x))
        for i in range(0, len(x), 256):
            squared, slack = _products(x[i : i + 256], near)
            reach[i : i + 256] = np.maximum(_kth_by_fold(squared, own[i : i + 256], other, k, folds) + slack, 0)
        return block[["point", "vec", *kept, "cell"]].assign(reach=reach)

    kept = ["fold"] if folds else []
    inputs = blocks.select("point", "vec", *kept, "cell", "block")
    return inputs.groupBy("cell", "block").applyInPandas(
        bound, f"point string, vec array<double>,{' fold int,' if folds else ''} cell int, reach double"
    )


def _visits(searchers: DataFrame, block_boxes: DataFrame, width: int) -> DataFrame:
    """(point, vec, fold if there is one, reach, cell, block) for every block whose box is within reach of the point."""
    cells = (
        block_boxes.groupBy("cell")
        .agg(
            F.array(*[F.min(F.element_at("lows", i + 1)) for i in range(width)]).alias("lows"),
            F.array(*[F.max(F.element_at("highs", i + 1)) for i in range(width)]).alias("highs"),
        )
        .collect()
    )
    names = np.array([row["cell"] for row in cells], dtype=np.int32)
    lows, highs = np.array([row["lows"] for row in cells]), np.array([row["highs"] for row in cells])

    @F.pandas_udf("array<int>")
    def cells_in_reach(vec: pd.Series, reach: pd.Series) -> pd.Series:
        x, limit = np.stack(vec.to_numpy()), reach.to_numpy() * (1 + SLACK)
        found = []
        for i in range(0, len(x), 256):
            part = x[i : i + 256]
            away = np.zeros((len(part), len(names)))
            for d in range(part.shape[1]):
                gap = np.maximum(np.maximum(lows[None, :, d] - part[:, d, None], part[:, d, None] - highs[None, :, d]), 0)
                away += gap * gap
            found += [names[row <= bound] for row, bound in zip(away, limit[i : i + 256])]
        return pd.Series(found)

    away = F.lit(0.0)
    for i in range(1, width + 1):
        x, low, high = F.element_at("vec", i), F.element_at("lows", i), F.element_at("highs", i)
        gap = F.greatest(low - x, x - high, F.lit(0.0))
        away = away + gap * gap
    kept = [name for name in ("point", "vec", "fold", "reach") if name in searchers.columns]
    routed = searchers.select(*kept, F.explode(cells_in_reach("vec", "reach")).alias("cell"))
    joined = routed.join(block_boxes, "cell").filter(away <= F.col("reach") * F.lit(1 + SLACK))
    return joined.select(*kept, "cell", "block")


def _nearest_pairs(squared: np.ndarray, at: np.ndarray, other_folds: np.ndarray, k: int, folds: tuple[int, ...]) -> np.ndarray:
    """Which of the pairs, in order of row ``at`` and distance, are among the k nearest with no or any one fold left out."""
    first = np.searchsorted(at, at)
    place = np.arange(len(at)) - first
    keep = (place < k) & np.isfinite(squared)
    for fold in folds:
        out = (other_folds == fold) | (other_folds == NO_FOLD)
        before = np.concatenate([[0], np.cumsum(out)])
        keep |= ~out & (place - (before[:-1] - before[first]) < k) & np.isfinite(squared)
    return keep


def _search(visits: DataFrame, blocks: DataFrame, k: int, chunk_points: int, folds: tuple[int, ...] = ()) -> DataFrame:
    """The k nearest points of every visit; a busy block is copied once per chunk of its visitors.

    With ``folds``, the k nearest with no fold and with any one fold left out. Visits with a ``reach`` need nothing beyond it.
    """
    busy = visits.groupBy("cell", "block").agg(F.ceil(F.count("*") / F.lit(chunk_points)).cast("int").alias("chunks"))
    kept = ["fold"] if folds else []
    reach = [F.col("reach") if "reach" in visits.columns else F.lit(math.inf).alias("reach")]
    guests = visits.join(busy, ["cell", "block"]).select(
        "point", "vec", *kept, *reach, "cell", "block", F.pmod(F.xxhash64("point"), F.col("chunks")).cast("int").alias("chunk")
    )
    hosts = blocks.join(busy, ["cell", "block"]).select(
        "point", "vec", *kept, "first_id", "ids", "cell", "block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")
    )

    def nearest(guest: pd.DataFrame, host: pd.DataFrame) -> pd.DataFrame:
        if guest.empty or host.empty:
            return pd.DataFrame({name: [] for name in ("point", "d2", "first_id", "near_ids", "near_vec", *near_fold)})
        host = host.sort_values("first_id", kind="stable")
        x, y = np.stack(guest["vec"].to_numpy()), np.stack(host["vec"].to_numpy())
        names, others = guest["point"].to_numpy(), host["point"].to_numpy()
        own, other, limits = _folds_of(guest), _folds_of(host), guest["reach"].to_numpy() * (1 + SLACK)
        itself = pd.Index(others).get_indexer(names)
        found = []
        for i in range(0, len(x), 256):
            some = slice(i, i + 256)
            rough, slack = _products(x[some], y)
            possible = rough <= (limits[some] + slack)[:, None]
            if possible.sum() > MANY * len(rough):
                possible &= rough <= (_kth_by_fold(rough, own[some], other, k, folds) + 2 * slack)[:, None]
            at, near = np.nonzero(possible)
            strange = near != itself[some][at]
            at, near = at[strange], near[strange]
            squared = np.zeros(len(at))
            for column in range(x.shape[1]):
                gap = x[some][at, column] - y[near, column]
                squared += gap * gap
            order = np.lexsort((near, squared, at))
            at, near, squared = at[order], near[order], squared[order]
            keep = _nearest_pairs(squared, at, other[near], k, folds)
            at, near, squared = at[keep], near[keep], squared[keep]
            columns = {
                "point": names[some][at], "d2": squared, "first_id": host["first_id"].to_numpy()[near],
                "near_ids": host["ids"].to_numpy()[near], "near_vec": host["vec"].to_numpy()[near],
            }
            found.append(pd.DataFrame(columns | {name: other[near] for name in near_fold}))
        return pd.concat(found)

    near_fold = ["near_fold"] if folds else []
    keys = ["cell", "block", "chunk"]
    schema = "point string, d2 double, first_id string, near_ids array<string>, near_vec array<double>"
    schema += ", near_fold int" if folds else ""
    return guests.groupBy(*keys).cogroup(hosts.groupBy(*keys)).applyInPandas(nearest, schema)


def nearest_neighbours(
    rows: DataFrame,
    k: int = 5,
    block_rows: int = BLOCK_ROWS,
    chunk_points: int = CHUNK_POINTS,
) -> DataFrame:
    """Neighbours of each row of ``rows`` (``id`` string, ``vec`` array<double>).

    Result: ``id``, ``vec`` and ``near``, an array of k structs (``d2``, ``id``, ``vec``), nearest first, self left out.
    """
    blocks, found = _found(distinct_points(rows, k), k, block_rows, chunk_points)
    return _lists(rows, blocks, found, k)


def _found(points: DataFrame, k: int, block_rows: int, chunk_points: int, folds: tuple[int, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The points in their blocks, and what each found in the blocks within its reach."""
    points = points.persist()
    head = points.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("width")).first()
    n, width = head["n"], head["width"]
    if not n:
        raise ValueError("no rows to search")
    tree = _sample_tree(points, n, block_rows)
    blocks = cut_lineage(_blocks(points, tree, block_rows))
    points.unpersist()
    if n <= block_rows:
        names = [name for name in ("point", "vec", "fold", "cell", "block") if name in blocks.columns]
        visits = blocks.select(*names).toDF(*names)
    else:
        boxes = cut_lineage(_boxes(blocks, width))
        visits = cut_lineage(_visits(_with_reach(blocks, k, tree[3], folds), boxes, width))
    return blocks, _search(visits, blocks, k, chunk_points, folds)


def neighbours_by_fold(
    rows: DataFrame, folds: int, k: int = 5, block_rows: int = BLOCK_ROWS, chunk_points: int = CHUNK_POINTS
) -> DataFrame:
    """What ``leaving_out`` needs to give each row's neighbours without any one fold, from one search of all rows.

    ``rows`` are ``id`` string, ``vec`` array<double> and ``fold`` int (0 to ``folds`` - 1; a row without a fold counts only
    where none is left out). A point is a vector in a fold, and keeps who is among its k nearest with some fold left out.
    """
    numbers = tuple(range(folds))
    numbered = rows.select("id", "vec", F.coalesce("fold", F.lit(NO_FOLD)).cast("int").alias("fold"))
    blocks, found = _found(distinct_points(numbered, k, "fold"), k, block_rows, chunk_points, numbers)
    order = Window.partitionBy("point").orderBy("d2", "first_id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    nearer = F.row_number().over(order) - 1
    keep = nearer < k
    for fold in numbers:
        out = F.col("near_fold").isin(fold, NO_FOLD)
        keep = keep | (~out & (nearer - F.count_if(out).over(before) < k))
    spread = F.transform("near_ids", lambda i: F.struct("d2", i.alias("id"), F.col("near_vec").alias("vec"), F.col("near_fold").alias("fold")))
    others = found.withColumn("keep", keep).filter("keep").groupBy("point").agg(F.flatten(F.collect_list(spread)).alias("others"))
    own = F.transform("ids", lambda i: F.struct(F.lit(0.0).alias("d2"), i.alias("id"), F.col("vec").alias("vec"), F.col("fold")))
    candidates = F.array_sort(F.concat(own, F.coalesce(F.col("others"), F.array().cast(_NEAR_IN_FOLD))))
    lists = blocks.join(others, "point", "left").select("vec", "fold", candidates.alias("candidates"))
    return cut_lineage(numbered.join(lists, ["vec", "fold"]).select("id", "vec", "fold", "candidates"))


def leaving_out(lists: DataFrame, fold: int | None, k: int = 5) -> DataFrame:
    """``nearest_neighbours`` of the rows outside a fold, or of all rows, from what ``neighbours_by_fold`` found."""
    inside = F.lit(True) if fold is None else ~F.col("fold").isin(fold, NO_FOLD)
    left = F.col("candidates") if fold is None else F.filter("candidates", lambda c: ~c["fold"].isin(fold, NO_FOLD))
    others = F.slice(F.filter(F.slice(left, 1, k + 1), lambda c: c["id"] != F.col("id")), 1, k)
    near = F.transform(others, lambda c: F.struct(c["d2"].alias("d2"), c["id"].alias("id"), c["vec"].alias("vec")))
    return lists.filter(inside).select("id", "vec", near.alias("near"))


def partitioned_neighbours(
    rows: DataFrame, k: int = 5, trees: int = TREES, block_rows: int = BLOCK_ROWS, seed: int = 42
) -> DataFrame:
    """Approximate neighbours at linear cost, whatever the columns: the same result columns as ``nearest_neighbours``.

    Each of ``trees`` turns the space by a random rotation and cuts it into blocks as the exact search does. A point meets
    the points of its own block in each tree and nothing else, so its work is ``trees * block_rows`` distances; the k
    best of all trees are kept. Distances are those of the columns as given. What is missed depends on the data: the
    tests state the share of true neighbours found.
    """
    points = cut_lineage(distinct_points(rows, k))
    head = points.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("width")).first()
    n, width = head["n"], head["width"]
    if not n:
        raise ValueError("no rows to search")
    random, found = np.random.default_rng(seed), []
    for _ in range(trees if n > block_rows else 1):
        turned = _turned(points, np.linalg.qr(random.normal(size=(width, width)))[0])
        blocks = _blocks(turned, _sample_tree(turned, n, block_rows), block_rows).drop("vec").withColumnRenamed("own", "vec")
        blocks = cut_lineage(blocks)
        visits = blocks.select("point", "vec", "cell", "block").toDF("point", "vec", "cell", "block")
        found.append(_search(visits, blocks, k, CHUNK_POINTS))
    together = reduce(DataFrame.unionByName, found).dropDuplicates(["point", "first_id"])
    return _lists(rows, points, together, k)


def _turned(points: DataFrame, rotation: np.ndarray) -> DataFrame:
    """The points with ``vec`` rotated and the vector as given in ``own``."""

    @F.pandas_udf("array<double>")
    def rotate(vec: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(vec.to_numpy()) @ rotation))

    return points.withColumn("own", F.col("vec")).withColumn("vec", rotate("own"))


def _lists(rows: DataFrame, points: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """The k nearest of each row from the (point, d2, first_id, near_ids, near_vec) found for its point."""
    nearest = Window.partitionBy("point").orderBy("d2", "first_id")
    ranked = found.withColumn("r", F.row_number().over(nearest))
    spread = F.transform("near_ids", lambda i: F.struct(F.col("d2"), i.alias("id"), F.col("near_vec").alias("vec")))
    others = ranked.filter(F.col("r") <= k).groupBy("point").agg(F.flatten(F.collect_list(spread)).alias("others"))
    own = F.transform("ids", lambda i: F.struct(F.lit(0.0).alias("d2"), i.alias("id"), F.col("vec").alias("vec")))
    candidates = F.array_sort(F.concat(own, F.coalesce(F.col("others"), F.array().cast(_NEAR))))
    lists = points.join(others, "point", "left").select("vec", F.slice(candidates, 1, k + 1).alias("candidates"))
    near = F.slice(F.filter("candidates", lambda c: c["id"] != F.col("id")), 1, k)
    return rows.join(lists, "vec").select("id", "vec", near.alias("near"))


_NEAR = "array<struct<d2:double,id:string,vec:array<double>>>"
_NEAR_IN_FOLD = "array<struct<d2:double,id:string,vec:array<double>,fold:int>>"
