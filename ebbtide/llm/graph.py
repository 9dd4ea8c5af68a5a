"""Connected components of a link table, by repeated joins; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.session import cut_lineage


#: The order in which ids win changes from pass to pass, so that no chain of ids stays long.
MASKS = (0x2545F4914F6CDD1D, 0x5851F42D4C957F2D, 0x14057B7EF767814F)


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in `links` (a long, b long); component is the smallest id that can be reached.

    Each pass merges every id into the first of itself and its neighbours, in an order of the ids that changes from pass
    to pass, and goes on with the links between what is left, so the links shrink fast. Neighbours are summed up map-side;
    a hub's links never meet in one task. Each pass is written to the shared folder. No links give no rows.
    """
    edges = cut_lineage(links.select("a", "b").where("a <> b").distinct())
    roots, turn = cut_lineage(edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct().select("id", F.col("id").alias("root"))), 0
    while not edges.isEmpty():
        mask, turn = MASKS[turn % len(MASKS)] + turn, turn + 1
        both = edges.union(edges.select("b", "a"))
        first = F.least(F.col("a").bitwiseXOR(mask), F.min(F.col("b").bitwiseXOR(mask))).bitwiseXOR(mask)
        merged = cut_lineage(both.groupBy("a").agg(first.alias("into")))
        at_a, at_b = merged.toDF("a", "into_a"), merged.toDF("b", "into_b")
        moved = edges.join(at_a, "a").join(at_b, "b").select(F.least("into_a", "into_b").alias("a"), F.greatest("into_a", "into_b").alias("b"))
        edges = cut_lineage(moved.where("a <> b").distinct())
        roots = cut_lineage(roots.join(merged.toDF("root", "into"), "root", "left").select("id", F.coalesce("into", "root").alias("root")))
    least = roots.groupBy("root").agg(F.min("id").alias("component"))
    return cut_lineage(roots.join(least, "root").select("id", "component"))
