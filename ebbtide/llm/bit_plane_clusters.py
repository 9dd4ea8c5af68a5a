"""Centroid clustering on bit planes: exact integer k-means by AND and popcount.

A vector is 64 integers, floor(scale * x). Shifted so that the least value of the table is 0, it is kept as bit planes:
plane j is one unsigned 64-bit word with bit j of all 64 components. The dot product of two vectors is the sum over
their planes of 2^(i+j) * popcount(plane_i AND plane_j), so squared distances, which the shift leaves alone, are exact
integers. The sums that move a centroid are counts of set bits, plane by plane. The planes are the only copy of the
vectors, as many as the range of the table needs (11 words of 8 bytes for values of -1024 to 1023).

The planes are written once to the shared folder. A round is one narrow pass over them that leaves one row per task and
cluster, summed by Spark; centroids (`clusters` rows of 64 numbers) are all that reaches the driver. Nothing is shuffled by
vector, so a vector that occurs in a third of the rows is no hot key.

Defined results: vectors that are NULL, have another length, or hold a NULL, NaN or infinite component are left out. Of
vectors with the same id each row is a vector of its own; equal ids are put in the order of their planes where the start
needs one, and a NULL id is hashed as no digits. With fewer vectors than clusters every vector starts one; a centroid that
loses all vectors stays. Ties go to the smaller number. An empty table gives no rows. Values that need more than 27 planes,
past which a squared distance would not fit 64 bits, are refused with an error. Further columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.session import cut_lineage

#: Components of a vector: the bits of a plane.
WIDTH = 64
MOST_PLANES = 27
#: Vectors worked on at a time.
SLICE_ROWS = 4096
PACKED = "vec_id long, planes binary, square long"


def pack(values: np.ndarray, planes: int) -> np.ndarray:
    """Rows of 64 non-negative integers as rows of `planes` 64-bit words."""
    words = [np.packbits(((values >> j) & 1).astype(np.uint8), axis=1, bitorder="little").view("<u8")[:, 0] for j in range(planes)]
    return np.stack(words, axis=1)


def dots(packed: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Dot product of every packed row with one packed centroid."""
    counts = np.zeros(packed.shape, np.int64)
    for j, plane in enumerate(centroid):
        if plane:
            counts += np.bitwise_count(packed & plane).astype(np.int64) << j
    return (counts << np.arange(packed.shape[1])).sum(axis=1)


def bit_sums(packed: np.ndarray) -> np.ndarray:
    """Sum of the rows by component, from the number of set bits of each plane."""
    bits = np.unpackbits(packed.view(np.uint8).reshape(*packed.shape, 8), axis=2, bitorder="little")
    return (bits.sum(axis=0, dtype=np.int64) << np.arange(packed.shape[1])[:, None]).sum(axis=0)


class Centroids:
    """Centroids as integers (shifted), planes and squared lengths."""

    def __init__(self, values: np.ndarray, planes: int):
        self.values, self.planes = values, pack(values, planes)
        self.squares = (values * values).sum(axis=1)

    def nearest(self, packed: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid, the smaller one of equals, and the squared distance."""
        far = np.stack([squares + s - 2 * dots(packed, c) for s, c in zip(self.squares, self.planes, strict=True)], axis=1)
        best = far.argmin(axis=1)
        return best, far[np.arange(len(far)), best]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a packed table with their planes and squared lengths as arrays."""
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(start, SLICE_ROWS)
            words = np.frombuffer(b"".join(part["planes"].to_pylist()), "<u8").reshape(part.num_rows, -1)
            yield part, words, part["square"].to_numpy()


def whole_vectors(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """vec_id and vector (array<double>) of the rows with 64 finite components."""
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))  # NaN is larger than infinity
    return rows.where((F.size("vector") == WIDTH) & finite)


def _packed(rows: DataFrame, scale: int, low: int, planes: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                values = np.floor(part["vector"].flatten().to_numpy() * scale).astype(np.int64).reshape(-1, WIDTH) - low
                words = pa.array([row.tobytes() for row in pack(values, planes)], pa.binary())
                yield pa.RecordBatch.from_arrays([part["vec_id"], words, pa.array((values * values).sum(axis=1))], ["vec_id", "planes", "square"])

    return rows.mapInArrow(run, PACKED)


def _moved(packed: DataFrame, centroids: Centroids) -> np.ndarray:
    """The centroids after one round: floor of the mean of each one's vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(len(centroids.values), np.int64), np.zeros((len(centroids.values), WIDTH), np.int64)
        for _, words, squares in _slices(batches):
            best, _ = centroids.nearest(words, squares)
            n += np.bincount(best, minlength=len(n))
            for k in np.unique(best):
                sums[k] += bit_sums(words[best == k])
        found = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(n[found]), pa.array(list(sums[found]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    partial = packed.mapInArrow(run, "cluster int, n long, sums array<long>")
    totals = partial.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(WIDTH)]).alias("sums"))
    values = centroids.values.copy()
    for row in totals.collect():
        values[row["cluster"]] = [s // row["n"] for s in row["sums"]]
    return values


def _assigned(packed: DataFrame, centroids: Centroids) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words, squares in _slices(batches):
            best, distance = centroids.nearest(words, squares)
            yield pa.RecordBatch.from_arrays([part["vec_id"], pa.array(best.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return packed.mapInArrow(run, "vec_id long, cluster int, distance long")


def start_order(vec_id: str, seed: int) -> Column:
    """Lowercase hex sha256 of `seed:vec_id`."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(vec_id).cast("string"), F.lit(""))).cast("binary"), 256)


def cluster(df: DataFrame, clusters: int, rounds: int, seed: int, scale: int = 1024, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every whole vector."""
    spark = df.sparkSession
    rows = whole_vectors(df, vec_id, vector)
    low, high = rows.agg(F.min(F.array_min("vector")), F.max(F.array_max("vector"))).first()
    if low is None:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    low, high = math.floor(scale * low), math.floor(scale * high)
    planes = max(1, (high - low).bit_length())
    if planes > MOST_PLANES or max(abs(low), abs(high)) >= 1 << 62:
        raise ValueError(f"components from {low} to {high} need {planes} planes; squared distances fit 64 bits up to {MOST_PLANES}")
    packed = cut_lineage(_packed(rows, scale, low, planes))
    first = packed.orderBy(start_order("vec_id", seed), "planes").limit(clusters).collect()
    words = np.frombuffer(b"".join(r["planes"] for r in first), "<u8").reshape(-1, planes)
    centroids = Centroids(np.array([bit_sums(w[None]) for w in words]), planes)
    for _ in range(rounds):
        centroids = Centroids(_moved(packed, centroids), planes)
    assigned = cut_lineage(_assigned(packed, centroids))
    inertia = {r["cluster"]: r["inertia"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    digests = [hashlib.sha256(",".join(str(x + low) for x in c.tolist()).encode()).hexdigest() for c in centroids.values]
    told = [(k, inertia.get(k, 0), sum(inertia.values()), digest) for k, digest in enumerate(digests)]
    about = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # As many rows as clusters.
    return assigned.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
