"""Near-duplicate documents by min-max hashing, confirmed on whole shingle sets.

Signatures. A document is the set of its distinct `words`-word shingles (64-bit keys). Under each of 80 random
permutations both the smallest and the largest value are kept: 160 signature values for 80 hash evaluations. A minimum
and a maximum each agree between two sets with probability equal to their Jaccard similarity, and the two are
negatively correlated, so the mixed signature is unbiased with a smaller variance than 160 separate minima. Bands of 5
values (32 of them): two documents at similarity 0.8 share no band with probability (1 - 0.8^5)^32 = 3e-6, at 0.9 7e-13.

Steps, all of them joins and sums over tables:

1. Equal sets are one class, named by its smallest doc_id; only the class goes on, so copies cost one row each.
2. A band's bucket has up to four pivots: the members with the smallest and the largest class id, and two that come
   first when the ids' bits are mixed. Every member is compared with the pivots only, on the full sets, and confirmed
   links give components. A group of any size thus costs a few pairs a member.
3. What is left in buckets that still hold several components is decided exactly. Among the documents in them a shingle
   is rare if at most 64 of them have it. Two of them share no more than the rare shingles they are found together under
   and the lesser number of common ones, which bounds their similarity. Of the pairs in different components that can
   still be linked, those with a rare shingle in common are found under it, the others under the rarest of their common
   shingles (prefix filtering; any order of the shingles is valid, the one used comes from a table of counts of fixed
   size). Texts that merely share a frequent passage do not meet this way, nor do much-edited copies, whose own words
   tell that they are too far from any other.

No pair that shares a band and could still change a component is left out.

Link: 100 * |A and B| >= similarity * |A or B| on the full sets.

Defined results: a NULL or wordless text has no shingles, is linked with nothing and is its own component. Rows that
share a doc_id are one document, linked by any of its texts. A row without doc_id cannot be named in a link: it has a
NULL component and is kept. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.graph import components
from ebbtide.llm.texts import WordKeys, map_rows, shingle_set, small_batches
from ebbtide.session import cut_lineage

PERMUTATIONS = 80
BAND = 5
BANDS = 2 * PERMUTATIONS // BAND
#: Shingles hashed at a time, so that the work stays in the processor's cache.
SLICE = 4096
#: A pivot is the member with the smallest id after its bits are flipped by one of these: some member, the same in every bucket.
MASKS = (0x2545F4914F6CDD1D, 0x5851F42D4C957F2D)
#: A shingle is rare if so many of the documents left over have it at most.
RARE = 64
#: Entries of the table in which the rarity of shingles is counted.
RARITY_BITS = 18
RARITY = 1 << RARITY_BITS

_random = np.random.default_rng(20240229)
MULTIPLIERS = _random.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _random.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2)


def min_max_signature(keys: np.ndarray) -> np.ndarray:
    """Minimum and maximum of the keys under each permutation, in turn: min 0, max 0, min 1, max 1, ..."""
    low = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(PERMUTATIONS, np.uint64)
    for start in range(0, len(keys), SLICE):
        part = keys[start : start + SLICE]
        values = np.empty_like(part)
        for k in range(PERMUTATIONS):
            np.multiply(part, MULTIPLIERS[k], out=values)
            values += OFFSETS[k]
            low[k] = min(low[k], values.min())
            high[k] = max(high[k], values.max())
    return np.stack([low, high], axis=1).ravel()


def band_keys(signature: np.ndarray) -> list[int]:
    """One signed 64-bit key per band; the band's number is part of it."""
    bands = signature.reshape(BANDS, BAND).astype("<u8")
    return [xxhash.xxh64_intdigest(row.tobytes(), seed) - (1 << 63) for seed, row in enumerate(bands)]


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, bands): the 128-bit key of the set, and its band keys."""

    keys = WordKeys()

    def rows(ids: list, texts: list) -> Iterator[tuple]:
        for doc_id, text in zip(ids, texts, strict=True):
            found = shingle_set(text, words, keys)
            if not len(found):
                yield doc_id, 0, None, None, None
                continue
            whole = xxhash.xxh128_intdigest(found.tobytes())
            yield doc_id, len(found), (whole >> 64) - (1 << 63), (whole & (2**64 - 1)) - (1 << 63), band_keys(min_max_signature(found))

    return map_rows(docs.select("doc_id", "text"), rows, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>")


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """(id, keys): the sorted distinct shingle keys of a document as packed 64-bit integers."""

    keys = WordKeys()

    def rows(ids: list, texts: list) -> Iterator[tuple]:
        for doc_id, text in zip(ids, texts, strict=True):
            yield doc_id, shingle_set(text, words, keys).tobytes()

    return map_rows(docs.select("doc_id", "text"), rows, "id long, keys binary")


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """(a, b, linked) for each pair, by the full sets. `similarity` is in hundredths."""

    def rows(left: list, right: list, left_keys: list, right_keys: list) -> Iterator[tuple]:
        for a, b, x, y in zip(left, right, left_keys, right_keys, strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            small, large = sorted((len(x), len(y)))
            linked = 100 * small >= similarity * large
            if linked:
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked = 100 * both >= similarity * (small + large - both)
            yield a, b, linked

    joined = pairs.join(sets.select(F.col("id").alias("a"), F.col("keys").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("keys").alias("y")), "b")
    return map_rows(joined.select("a", "b", "x", "y"), rows, "a long, b long, linked boolean")


def _pairs(rows: DataFrame, one: str, other: str) -> DataFrame:
    """Distinct unordered pairs of different ids."""
    return rows.where(F.col(one) != F.col(other)).select(F.least(one, other).alias("a"), F.greatest(one, other).alias("b")).distinct()


def _mixed(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `buckets` (bucket, id, ...) in buckets of several components, with the component of each id."""
    labelled = buckets.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    several = labelled.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("bucket")
    return labelled.join(several, "bucket")


def _place(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - RARITY_BITS)).astype(np.int64)


def _rarity(sets: DataFrame) -> np.ndarray:
    """Occurrences of shingles in `sets` by the top bits of their keys; the table has RARITY entries."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(RARITY, np.int64)
        for batch in batches:
            for keys in batch["keys"].to_pylist():
                np.add.at(counts, _place(np.frombuffer(keys, np.uint64)), 1)
        places = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(counts[places])], ["place", "n"])

    counts = np.zeros(RARITY, np.int64)
    for row in sets.select("keys").mapInArrow(rows, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():
        counts[row["place"]] = row["n"]
    return counts


def _prefixes(sets: DataFrame, similarity: int) -> DataFrame:
    """(bucket, id, place): each of `sets` (id, keys, rare) under the rarest of its common shingles, in their order.

    Linked documents share at least `similarity` hundredths of either. If they share no rare shingle, all of that is
    common, and of the common ones in one order the first n_common - needed + 1 of each have a shingle together.
    """
    rarity = sets.sparkSession.sparkContext.broadcast(_rarity(sets))

    def rows(ids: list, packed: list, rare: list) -> Iterator[tuple]:
        for key, keys, seldom in zip(ids, packed, rare, strict=True):
            shingles = np.frombuffer(keys, np.uint64)
            needed = -(-similarity * len(shingles) // 100)
            shingles = np.setdiff1d(shingles, np.array(seldom or [], np.int64).view(np.uint64), assume_unique=True)
            order = np.lexsort((shingles, rarity.value[_place(shingles)]))
            for place, shingle in enumerate(shingles[order[: max(0, len(shingles) - needed + 1)]].view(np.int64).tolist()):
                yield shingle, key, place

    return map_rows(sets.select("id", "keys", "rare"), rows, "bucket long, id long, place int")


def _rare_shingles(sets: DataFrame) -> DataFrame:
    """(id, shingle, times) for the shingles that at most RARE documents of `sets` have."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                keys = [np.frombuffer(k, np.int64) for k in part["keys"].to_pylist()]
                ids = np.repeat(np.array(part["id"].to_pylist(), np.int64), [len(k) for k in keys])
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate(keys))], ["id", "shingle"])

    each = sets.select("id", "keys").mapInArrow(rows, "id long, shingle long")
    times = each.groupBy("shingle").agg(F.count("*").alias("times")).where(F.col("times") <= RARE)
    return each.join(times, "shingle").select("id", "shingle", "times")


def _may_link(shared: Column, similarity: int) -> Column:
    """Whether two documents of n and other_n shingles that share at most so many can be linked."""
    return F.coalesce(100 * shared >= similarity * (F.col("n") + F.col("other_n") - shared), F.lit(True))


def _left_over(sets: DataFrame, labels: DataFrame, similarity: int) -> DataFrame:
    """(id, other): pairs of `sets` in different components that can be linked, by bounds that hold for every pair.

    Pairs that share a rare shingle are found under it, and the number of those they share is known. Others share
    common shingles only; they are found under the first they share in the order of the prefixes, if both have enough
    common ones from there on.
    """
    rare = cut_lineage(_rare_shingles(sets))
    split = cut_lineage(sets.join(rare.groupBy("id").agg(F.collect_list("shingle").alias("rare")), "id", "left"))
    number, seldom = F.length("keys") / 8, F.coalesce(F.array_size("rare"), F.lit(0))
    lengths = split.groupBy("id").agg(F.max(number).cast("long").alias("n"), F.max(number - seldom).cast("long").alias("common"), F.count("*").alias("texts"))
    bounded = [F.when(F.col("texts") == 1, F.col(c)).alias(c) for c in ("n", "common")]  # several texts of an id: no bound
    sizes = cut_lineage(lengths.join(labels, "id", "left").select("id", *bounded, F.coalesce("component", "id").alias("component")))
    others = sizes.select(F.col("id").alias("other"), F.col("n").alias("other_n"), F.col("common").alias("other_common"), F.col("component").alias("facing"))

    known = rare.where("times > 1").select("shingle", "id").join(sizes.select("id", "component"), "id")
    facing = known.select("shingle", F.col("id").alias("other"), F.col("component").alias("facing"))
    met = known.join(facing, "shingle").where("id < other AND component <> facing").groupBy("id", "other").agg(F.count("*").alias("shared"))
    by_rare = met.join(sizes.drop("component"), "id").join(others.drop("facing"), "other").where(_may_link(F.least("common", "other_common") + F.col("shared"), similarity))

    labelled = cut_lineage(_mixed(_prefixes(split, similarity), labels))
    sums = labelled.groupBy("bucket", "component").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.max(F.struct("n", "component"))["component"].alias("largest"))
    strangers = labelled.join(sums, "bucket").where("component <> largest").select("bucket", "id", "place")
    facing = labelled.select("bucket", F.col("id").alias("other"), F.col("place").alias("other_place")).join(others, "other")
    ahead = F.least(F.col("common") - F.col("place"), F.col("other_common") - F.col("other_place"))
    by_common = strangers.join(sizes, "id").join(facing, "bucket").where((F.col("component") != F.col("facing")) & _may_link(ahead, similarity))
    return by_rare.select("id", "other").union(by_common.select("id", "other"))


def _same_document(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b, linked): the classes of one doc_id with several texts, each linked to the smallest of them."""
    named = signed.select("doc_id", "set_a", "set_b").join(classes, ["set_a", "set_b"]).where("doc_id IS NOT NULL").select("doc_id", "id")
    least = named.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("doc_id", "a")
    return named.join(least, "doc_id").where("id <> a").select("a", F.col("id").alias("b"), F.lit(True).alias("linked")).distinct()


def near_duplicates(docs: DataFrame, words: int = 5, similarity: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of `docs` (doc_id, text and any further columns)."""
    with small_batches(docs.sparkSession):
        return _near_duplicates(docs, words, similarity)


def _near_duplicates(docs: DataFrame, words: int, similarity: int) -> DataFrame:
    signed = cut_lineage(signatures(docs, words))
    classes = cut_lineage(signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("id")))

    banded = signed.join(classes.withColumnRenamed("id", "doc_id"), ["set_a", "set_b", "doc_id"]).select(F.explode("bands").alias("band"), F.col("doc_id").alias("id"))
    mixed = [F.min(F.col("id").bitwiseXOR(mask)).bitwiseXOR(mask).alias(f"mixed_{k}") for k, mask in enumerate(MASKS)]
    pivots = banded.groupBy("band").agg(F.min("id").alias("low"), F.max("id").alias("high"), *mixed)
    members = cut_lineage(banded.join(pivots.where("low <> high"), "band"))

    texts = docs.select("doc_id", "text").join(members.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    sets = cut_lineage(shingle_sets(texts, words))
    to_pivots = members.select("id", F.explode(F.array("low", "high", "mixed_0", "mixed_1")).alias("pivot"))
    tried = cut_lineage(confirmed(_pairs(to_pivots, "id", "pivot"), sets, similarity).unionByName(_same_document(signed, classes)))
    labels = components(tried.where("linked"))

    left = _mixed(members.select(F.col("band").alias("bucket"), "id"), labels).select("id").distinct()
    met = _left_over(cut_lineage(sets.join(left, "id", "left_semi")), labels, similarity)
    fresh = cut_lineage(confirmed(_pairs(met, "id", "other").join(tried, ["a", "b"], "left_anti"), sets, similarity))
    if not fresh.where("linked").isEmpty():
        labels = components(tried.union(fresh).where("linked"))

    named = signed.select("doc_id", "n_shingles", "set_a", "set_b").join(classes, ["set_a", "set_b"], "left").join(labels, "id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "id", "doc_id"))
    judged = named.select("doc_id", "n_shingles", component.alias("component_id"))
    return judged.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
