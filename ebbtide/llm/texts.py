"""Small helpers shared by the document operators: Arrow passes over a table, word keys, bounded term counting."""

from __future__ import annotations

import gc
import re
from collections import Counter
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of letters; digits and the underscore separate.
LETTER_RUNS = re.compile(r"[^\W\d_]+")
#: A partial count goes out when it holds this many terms, so that a task's memory does not grow with its input.
FLUSH_TERMS = 150_000
#: Word keys kept by a worker; the store is emptied when full, which costs time only.
KEPT_WORDS = 150_000
#: Rows of an Arrow batch turned into Python objects at a time.
SLICE_ROWS = 2048


def map_rows(df: DataFrame, rows: Callable[..., Iterator[tuple]], schema: str) -> DataFrame:
    """One narrow Arrow pass: `rows` gets the columns of a batch as lists and yields result rows.

    Only the columns of `df` reach Python, a batch at a time (Spark bounds its bytes); results go out in
    chunks of at most 4,096 rows or about 16 MB.
    """
    arrow = _arrow_schema(df, schema)
    names = arrow.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, weight = [], 0
        for part in _slices(batches):
            for row in rows(*(column.to_pylist() for column in part.columns)):
                chunk.append(row)
                weight += 64 + sum(len(x) for x in row if isinstance(x, (str, bytes, list)))
                if len(chunk) >= 4096 or weight >= 1 << 24:
                    yield _batch(chunk, arrow, names)
                    chunk, weight = [], 0
        if chunk:
            yield _batch(chunk, arrow, names)
        release()

    return df.mapInArrow(run, schema)


def release() -> None:
    """Give what a finished pass held back to the system: a worker goes on with other stages and would keep it."""
    gc.collect()
    pa.default_memory_pool().release_unused()


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(start, SLICE_ROWS)


def _batch(chunk: list[tuple], arrow: pa.Schema, names: list[str]) -> pa.RecordBatch:
    columns = zip(*chunk, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], names)


def _arrow_schema(df: DataFrame, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1024, size: str = "8m") -> Iterator[None]:
    """Jobs run inside exchange smaller Arrow batches with Python: packed sets of whole texts are large rows, and both the
    executor's direct memory and the workers hold a batch several times over. The session's settings are put back."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {name: spark.conf.get(name, None) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


class WordKeys(dict):
    """64-bit key of each word given as bytes; holds at most KEPT_WORDS of them between texts."""

    def __missing__(self, word: bytes) -> int:
        key = self[word] = xxhash.xxh64_intdigest(word, 7)
        return key

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > KEPT_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(keys: np.ndarray) -> np.ndarray:
    """Spread 64-bit keys over the whole range (the finaliser of a multiply-xorshift hash)."""
    keys = keys ^ (keys >> np.uint64(31))
    keys = keys * np.uint64(0x9E3779B97F4A7C15)
    keys = keys ^ (keys >> np.uint64(29))
    keys = keys * np.uint64(0xBF58476D1CE4E5B9)
    return keys ^ (keys >> np.uint64(32))


def windows(keys: np.ndarray, size: int) -> np.ndarray:
    """Key of every run of `size` words, from the word keys; order of words matters."""
    n = len(keys) - size + 1
    if n < 1:
        return np.empty(0, np.uint64)
    run = keys[:n].copy()
    for k in range(1, size):
        run = mix(run) + keys[k : n + k] * np.uint64(2 * k + 1)
    return mix(run)


def shingle_set(text: str | None, size: int, keys: WordKeys) -> np.ndarray:
    """Sorted distinct 64-bit keys of the `size`-word shingles of a text.

    Words are separated by ASCII white space and A-Z is lower-cased. A text with fewer words is one shingle;
    a text without words, or no text, has none.
    """
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    run = keys.of(words)
    if len(words) < size:
        return mix(np.array([xxhash.xxh64_intdigest(run.tobytes(), len(words))], np.uint64))
    return np.unique(windows(run, size))


def counted(batches: Iterator[pa.RecordBatch], terms: Callable[..., Iterator[tuple[tuple, int]]], arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Partial sums of (key columns, n): a map-side combine whose store is bounded by FLUSH_TERMS."""
    store: Counter = Counter()

    def out() -> pa.RecordBatch:
        columns = [*zip(*store, strict=True), list(store.values())]
        batch = pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], arrow.names)
        store.clear()
        return batch

    for part in _slices(batches):
        for key, n in terms(*(column.to_pylist() for column in part.columns)):
            store[key] += n
            if len(store) >= FLUSH_TERMS:
                yield out()
    if store:
        yield out()
    release()


def sum_terms(df: DataFrame, terms: Callable[..., Iterator[tuple[tuple, int]]], keys: str) -> DataFrame:
    """Sum `n` per key over all rows of `df`; `terms` yields ((key, ...), n) for the columns of a batch."""
    schema = f"{keys}, n long"
    arrow = _arrow_schema(df, schema)
    partial = df.mapInArrow(lambda batches: counted(batches, terms, arrow), schema)
    return partial.groupBy(*arrow.names[:-1]).agg(F.sum("n").alias("n"))


def fold_of(doc_id: Column | str, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; NULL for a NULL id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id.cast("string").cast("binary")) % folds


def read_table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
