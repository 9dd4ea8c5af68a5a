"""Importance resampling towards a target: hashed n-gram weights and Gumbel top-k draws, features by batch concatenation.

Features are the runs of 1 to `longest` consecutive words of a text, joined by a space; a feature's bucket is the crc32 of
its bytes modulo `buckets`. A batch's texts are joined with a sentinel between them, one regular expression finds all
words and sentinels of the batch, and the sentinels' places, searched for each word, tell its document: runs that start
and end in different documents are masked before anything is counted.

Each text is read once: its buckets (two bytes a feature up to 65,536 buckets) are written to the shared folder. From
there the counts of all documents are summed (a row per task and bucket, so nothing grows with a frequent word), the
gains, one integer per bucket, are computed on the driver, and a second narrow pass gives every document the floored mean
gain of its features. The draw is deterministic: the score adds a Gumbel variate made from a hash of the id.

Ranks need no global sort. Scores are integers within about +-70,000 (a gain is below 1000 ln 2^63, a variate between
-3,131 and 22,874), so the histogram of the eligible scores is small; it gives the least drawn score and how many documents
stand before each score. Only the drawn tail is ordered, score by score. Variates spread the documents of one weight over
thousands of scores, so a large group of copies is spread too.

Defined results: NULL and empty texts have no words, no features and weight 0; they are never drawn unless
`least_words` is 0. A NULL id is hashed as no digits and comes last among ties; of repeated rows with one id each is
ranked, the one with fewer features first. An empty table gives no rows; without target texts every gain is the
smoothed ratio against none. Words are made of ASCII letters (A-Z lower-cased), digits and all characters beyond ASCII; a NUL
character separates words like any other. Further columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.session import cut_lineage

SENTINEL = b"\x00"
#: Words of lower-cased bytes, or one sentinel.
WORDS = re.compile(rb"[0-9a-z\x80-\xff]+|\x00")
#: Bytes of text joined at a time; words whose bucket a worker remembers.
BATCH_BYTES, KEPT = 1 << 21, 400_000
FEATURES = "doc_id long, n_words long, n_features long, buckets binary"


class Buckets(dict):
    """Bucket of each word; -1 stands for the sentinel."""

    def __init__(self, buckets: int):
        super().__init__({SENTINEL: -1})
        self.buckets = buckets

    def __missing__(self, word: bytes) -> int:
        bucket = self[word] = zlib.crc32(word) % self.buckets
        return bucket

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > KEPT:
            self.clear()
            self[SENTINEL] = -1
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def batch_features(texts: list[bytes | None], longest: int, words_of: Buckets) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words per text, features per text, buckets of all features in the order of texts)."""
    texts = [t or b"" for t in texts]
    joined = SENTINEL.join(texts)
    if joined.count(SENTINEL) >= len(texts):
        joined = SENTINEL.join([t.replace(SENTINEL, b" ") for t in texts])
    words = WORDS.findall(joined.lower())
    found = words_of.of(words)
    real = found >= 0
    # Words before each sentinel: where the next document begins.
    begins = np.flatnonzero(~real) - np.arange(len(found) - real.sum())
    found = found[real]
    doc = np.searchsorted(begins, np.arange(len(found)), side="right")
    n_words = np.bincount(doc, minlength=len(texts))
    if longest == 1:
        return n_words, n_words, found
    words = list(compress(words, real))
    docs, parts = [doc], [found]
    for size in range(2, longest + 1):
        inside = doc[: len(doc) - size + 1] == doc[size - 1 :]
        runs = compress(zip(*(words[k:] for k in range(size))), inside)
        parts.append(np.array([zlib.crc32(b" ".join(run)) % words_of.buckets for run in runs], np.int64))
        docs.append(doc[: len(inside)][inside])
    doc = np.concatenate(docs)
    return n_words, np.bincount(doc, minlength=len(texts)), np.concatenate(parts)[np.argsort(doc, kind="stable")]


def _batches(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Slices of about BATCH_BYTES in a binary column, one row at least."""
    for batch in batches:
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch[column]), 0)).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + BATCH_BYTES)))
            yield batch.slice(start, end - start)
            start = end


def _kind(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def features(df: DataFrame, buckets: int, longest: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_features and the packed buckets of every text."""
    kind = _kind(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = Buckets(buckets)
        for part in _batches(batches, "text"):
            n_words, n_features, found = batch_features(part["text"].to_pylist(), longest, words_of)
            packed, ends = found.astype(kind).tobytes(), np.cumsum(n_features) * int(kind[-1])
            cells = [packed[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(n_words), pa.array(n_features), pa.array(cells, pa.binary())], ["doc_id", "n_words", "n_features", "buckets"])

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(run, FEATURES)


def totals(found: DataFrame, buckets: int) -> np.ndarray:
    """Features of all rows by bucket."""
    kind = _kind(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for part in _batches(batches, "buckets"):
            n += np.bincount(np.frombuffer(b"".join(part["buckets"].to_pylist()), kind), minlength=buckets)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["bucket", "n"])

    # As many rows as buckets.
    summed = found.select("buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(buckets, np.int64)
    n[summed["bucket"].to_numpy()] = summed["n"].to_numpy()
    return n


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandfold log ratio of the smoothed target and source rates, by bucket."""
    s_all, t_all = float(source.sum() + len(source)), float(target.sum() + len(target))
    ratios = [(t + 1.0) * s_all / ((s + 1.0) * t_all) for s, t in zip(source.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


def _weighted(found: DataFrame, by_bucket: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight: the floored mean gain of a document's features."""
    kind = _kind(len(by_bucket))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _batches(batches, "buckets"):
            n = part["n_features"].to_numpy()
            sums = np.concatenate([[0], np.cumsum(by_bucket[np.frombuffer(b"".join(part["buckets"].to_pylist()), kind)])])
            ends = np.cumsum(n)
            weight = (sums[ends] - sums[ends - n]) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([part["doc_id"], part["n_words"], part["n_features"], pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return found.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: str, seed: int) -> Column:
    """floor(-1000 ln(-ln u)) of a hash of the id, u strictly between 0 and 1."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long")


def draw(scores: DataFrame, percent: int, least_words: int) -> DataFrame:
    """doc_id, n_features, weight, score and rank (NULL where not drawn) of written scores."""
    spark = scores.sparkSession
    eligible = F.col("n_words") >= least_words
    # One row per integer score: bounded by the range of scores, see above.
    found = scores.where(eligible).groupBy("score").count().toArrow().sort_by([("score", "descending")])
    n = found["count"].to_numpy()
    quota, ends = percent * int(n.sum()) // 100, np.cumsum(n)
    columns = ["doc_id", "n_features", "weight", "score"]
    if not quota:
        return scores.select(*columns, F.lit(None).cast("long").alias("rank"))
    last = int(np.searchsorted(ends, quota))
    least = found["score"][last].as_py()
    before = spark.createDataFrame(pa.table({"score": found["score"][: last + 1], "before": pa.array((ends - n)[: last + 1])}))
    order = Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"), "n_features")
    tail = scores.where(eligible & (F.col("score") >= least)).join(F.broadcast(before), "score")
    rank = F.col("before") + F.row_number().over(order)
    drawn = tail.select(*columns, rank.alias("rank")).withColumn("rank", F.when(F.col("rank") <= quota, F.col("rank")))
    rest = scores.where(~eligible | (F.col("score") < least)).select(*columns, F.lit(None).cast("long").alias("rank"))
    return drawn.unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, percent: int, seed: int, buckets: int = 10_000, longest: int = 1, least_words: int = 20) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of `docs` (doc_id, text), drawn towards `target` (text)."""
    found = cut_lineage(features(docs, buckets, longest))
    wanted = features(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), buckets, longest)
    weighted = _weighted(found, gains(totals(found, buckets), totals(wanted, buckets)))
    return draw(cut_lineage(weighted.withColumn("score", F.col("weight") + gumbel("doc_id", seed))), percent, least_words)
