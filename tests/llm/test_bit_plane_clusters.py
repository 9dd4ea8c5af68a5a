"""Bit planes give exact integers; clusters equal plain k-means."""

import hashlib
import math

import numpy as np
import pytest

from ebbtide.llm import bit_plane_clusters
from tests.llm.cases import by_id


def table(spark, rows):
    extra = ("cluster", "planes", "square", "vector", "n", "sums", "inertia")
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", *[f"'x' AS `{name}`" for name in extra])


def vectors(n, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    centre = rng.normal(0, spread, (4, 64))
    return (centre[rng.integers(0, 4, n)] + rng.normal(0, 0.3, (n, 64))).astype(np.float32)


def plain_kmeans(rows, clusters, rounds, seed):
    """{row number: (cluster, distance)} and final centroids, with Python integers."""
    whole = [[math.floor(1024 * float(x)) for x in v] for _, v, _ in rows]
    digits = ["" if k is None else str(k) for k, _, _ in rows]
    first = sorted(range(len(rows)), key=lambda r: hashlib.sha256(f"{seed}:{digits[r]}".encode()).hexdigest())[:clusters]
    centres = [whole[r] for r in first]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centres))

    for _ in range(rounds):
        found = [nearest(v)[1] for v in whole]
        for k in set(found):
            mine = [v for v, f in zip(whole, found, strict=True) if f == k]
            centres[k] = [sum(column) // len(mine) for column in zip(*mine, strict=True)]
    return [nearest(v)[::-1] for v in whole], centres


@pytest.mark.parametrize("planes", [1, 3, 11, 27])
def test_planes_give_exact_products_and_sums(planes):
    rng = np.random.default_rng(planes)
    values, other = rng.integers(0, 1 << planes, (50, 64)), rng.integers(0, 1 << planes, 64)
    packed = bit_plane_clusters.pack(values, planes)
    assert packed.dtype == np.uint64 and packed.shape == (50, planes)
    exact = [sum(int(a) * int(b) for a, b in zip(v, other, strict=True)) for v in values]
    assert bit_plane_clusters.dots(packed, bit_plane_clusters.pack(other[None], planes)[0]).tolist() == exact
    assert bit_plane_clusters.bit_sums(packed).tolist() == values.sum(axis=0).tolist()


@pytest.mark.parametrize("spread", [0.2, 40.0])
def test_clusters_equal_plain_kmeans(spark, spread):
    rows = [(k, v.tolist(), 0) for k, v in enumerate(vectors(120, 5, spread))]
    found = by_id(bit_plane_clusters.cluster(table(spark, rows), 6, 4, 3).withColumnRenamed("vec_id", "doc_id"))
    expected, centres = plain_kmeans(rows, 6, 4, 3)
    inertia = sum(d for _, d in expected)
    for k, (cluster, distance) in enumerate(expected):
        row = found[k]
        assert (row["cluster"], row["distance"], row["inertia"]) == (cluster, distance, inertia)
        assert row["cluster_inertia"] == sum(d for c, d in expected if c == cluster)
        assert row["centroid_sha256"] == hashlib.sha256(",".join(map(str, centres[cluster])).encode()).hexdigest()


def test_odd_vectors_are_left_out_and_repeats_stay(spark):
    good = vectors(3, 2)
    rows = [(k, v.tolist(), 0) for k, v in enumerate(good)] * 2 + [(None, good[0].tolist(), None)]
    odd = [None, [], [0.5] * 63, [0.5] * 65, [0.5] * 63 + [None], [0.5] * 63 + [float("nan")], [float("inf")] + [0.5] * 63, [float("-inf")] * 64]
    found = bit_plane_clusters.cluster(table(spark, rows + [(100 + k, v, 0) for k, v in enumerate(odd)]), 8, 10, 3).collect()
    assert sorted(r["vec_id"] for r in found if r["vec_id"] is not None) == [0, 0, 1, 1, 2, 2] and len(found) == 7
    assert all(r["distance"] == 0 and r["inertia"] == 0 for r in found)
    same = [r["cluster"] for r in found if r["vec_id"] in (0, None)]
    assert len(set(same)) == 1  # equal distances go to the smaller number


def test_fewer_vectors_than_clusters_and_none(spark):
    rows = [(k, v.tolist(), 0) for k, v in enumerate(vectors(3, 9))]
    assert len({r["cluster"] for r in bit_plane_clusters.cluster(table(spark, rows), 8, 2, 3).collect()}) == 3
    empty = bit_plane_clusters.cluster(table(spark, [(1, None, 0)]), 8, 2, 3)
    assert empty.count() == 0 and empty.columns == bit_plane_clusters.cluster(table(spark, rows), 8, 0, 3).columns


def test_values_that_do_not_fit_are_refused(spark):
    with pytest.raises(ValueError):
        bit_plane_clusters.cluster(table(spark, [(1, [1e9] + [0.0] * 63, 0)]), 8, 2, 3)


def test_a_third_of_equal_vectors(spark):
    some = vectors(90, 4)
    rows = [(k, (some[0] if k % 3 == 0 else some[k]).tolist(), 0) for k in range(90)]
    expected, _ = plain_kmeans(rows, 5, 3, 3)
    found = by_id(bit_plane_clusters.cluster(table(spark, rows), 5, 3, 3).withColumnRenamed("vec_id", "doc_id"))
    assert [(found[k]["cluster"], found[k]["distance"]) for k in range(90)] == expected
