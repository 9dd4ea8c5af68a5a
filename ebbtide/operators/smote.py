"""Minority over-sampling by interpolation between a row and one of its nearest minority neighbours.

Every minority row seeds the same number of synthetic rows, give or take one; which rows seed one more, which neighbour
is taken and how far the new row lies towards it are hash draws. Generation is narrow: no draw table, no skewed join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.functions.hashing import order_hash, unit_hash
from ebbtide.operators.neighbours import nearest_neighbours
from ebbtide.operators.selection import lowest_hashed
from ebbtide.sources.schema import ID, LABEL

NEIGHBOURS = 5


def minority_plan(df: DataFrame, label: str = LABEL) -> tuple[int, int, int]:
    """(minority class, its rows, synthetic rows needed to match the majority)."""
    counts = sorted(df.groupBy(label).count().limit(3).collect(), key=lambda row: (row["count"], row[label]))
    if len(counts) != 2:
        raise ValueError("over-sampling needs exactly two classes")
    small, large = counts
    return small[label], small["count"], large["count"] - small["count"]


def class_points(df: DataFrame, features: list[str], wanted: int, key: str = ID, label: str = LABEL) -> DataFrame:
    """``id`` and ``vec`` of the rows of a class, and their ``fold`` if they have one."""
    vec = F.array(*[F.col(f"`{name}`").cast("double") for name in features]).alias("vec")
    return df.filter(F.col(label) == wanted).select(F.col(key).alias("id"), vec, *(["fold"] if "fold" in df.columns else []))


def synthetic_rows(
    df: DataFrame,
    features: list[str],
    k: int = NEIGHBOURS,
    seed=42,
    key: str = ID,
    label: str = LABEL,
    plan: tuple[int, int, int] | None = None,
    search: Callable[[DataFrame, int], DataFrame] = nearest_neighbours,
) -> DataFrame:
    """``key`` (``syn-<id>-<j>``), the seed and neighbour ids, the gap, the features and the label.

    ``search`` is ``nearest_neighbours`` (exact) or ``partitioned_neighbours`` (linear cost, approximate).
    """
    minority, n_min, n_syn = plan or minority_plan(df, label)
    if n_min <= k:
        raise ValueError(f"{n_min} minority rows are too few for {k} neighbours")
    rows = class_points(df, features, minority, key, label).select("id", "vec")
    base, extra = divmod(n_syn, n_min)
    seeds = F.lit(base) + lowest_hashed(rows, extra, f"extra-{seed}", "id").cast("int")
    near = search(rows, k)
    drawn = (
        near.withColumn("seeds", seeds)
        .filter(F.col("seeds") > 0)
        .select("id", "vec", "near", F.explode(F.sequence(F.lit(1), F.col("seeds"))).alias("j"))
        .withColumn(key, F.concat(F.lit("syn-"), F.col("id"), F.lit("-"), F.col("j")))
        .withColumn("gap", unit_hash(F.col(key), f"gap-{seed}"))
        .withColumn("picked", F.element_at("near", (order_hash(F.col(key), f"pick-{seed}") % k).cast("int") + 1))
    )
    made = [
        (F.element_at("vec", i) + F.col("gap") * (F.element_at("picked.vec", i) - F.element_at("vec", i))).alias(name)
        for i, name in enumerate(features, 1)
    ]
    return drawn.select(
        key, F.col("id").alias("seed_id"), F.col("picked.id").alias("neighbour_id"), "gap", *made,
        F.lit(minority).alias(label),
    )


def oversample(
    df: DataFrame,
    features: list[str],
    k: int = NEIGHBOURS,
    seed=42,
    key: str = ID,
    label: str = LABEL,
    search: Callable[[DataFrame, int], DataFrame] = nearest_neighbours,
    plan: tuple[int, int, int] | None = None,
) -> DataFrame:
    """The given rows and the synthetic ones: both classes are equally large afterwards."""
    columns = [key, *features, label]
    original = df.select(*[F.col(f"`{name}`") for name in columns])
    plan = plan or minority_plan(df, label)
    if plan[2] == 0:
        return original
    new = synthetic_rows(df, features, k, seed, key, label, plan, search).select(*[F.col(f"`{name}`") for name in columns])
    return original.unionByName(new)
