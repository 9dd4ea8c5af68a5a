"""Token ids in Arrow stream files of fixed-size lists, for zero-copy random access.

Layout of a dataset folder:

    shard-00000.arrow, ...   Arrow IPC files in ascending document order. A row is one sequence: `ids`, a fixed-size list
                             of `length` ids (unsigned 16 or 32 bit, by the vocabulary), and `mask`, as many booleans,
                             false where the end of a shard is padded. All batches of a shard but the last hold the
                             same number of rows, so a token's place in the stream gives its batch, row and position.
    index/                   Parquet: doc_id, shard, start_in_shard, n_tokens

Texts are dealt out by ranges of (doc_id, hash of the text), sorted inside a range, encoded and written in the same
task: one shuffle of the texts, nothing else. A very frequent doc_id is split by the text's hash. A shard is written
under a name of the attempt and moved to its own name when complete, so a task that is run again replaces it whole.

Defined results: NULL text is encoded like an empty one; every document ends with the end id. NULL ids come first;
rows that share a doc_id stand side by side, ordered by the hash of their text. An empty table gives no files and no
rows. Further columns are not read.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Ids in a sequence, and sequences in a record batch.
LENGTH, ROWS = 2048, 128
#: Words remembered by a worker before it forgets those seen in one slice only; bytes of text encoded at a time, a slice.
KEPT, SLICE_BYTES = 700_000, 1 << 23

#: White space followed by a space: there, words cannot be encoded one by one.
_UNEVEN = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}] "


class WordEncoder:
    """Ids of texts by the tokenizers library, asked once per distinct word.

    The library's split never joins a space to what stands before it, unless that is white space too. So a text without
    white space before a space is the concatenation of its words, each with the space before it; others go through the
    library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.line_end = int(self.whole("\n")[0])
        self.start()

    def start(self) -> None:
        self.rows: dict[str, int] = {}
        self.starts, self.sizes = np.zeros(1024, np.int64), np.zeros(1024, np.int32)
        self.seen = np.zeros(1024, np.int32)
        self.flat, self.used = np.zeros(1 << 16, self.dtype), 0

    def _forget(self) -> None:
        """Keep the words seen in two slices or more since the last time, at most half of KEPT; they must be seen again."""
        seen = self.seen[: len(self.rows)]
        often = np.flatnonzero(seen >= 2)
        often = np.sort(often[np.argsort(-seen[often], kind="stable")[: KEPT // 2]])
        kept = np.zeros(len(seen), bool)
        kept[often] = True
        words, sizes = list(compress(self.rows, kept.tolist())), self.sizes[often]
        ids = self._gather(self.starts[often], sizes)
        self.start()
        self._keep(words, sizes, ids)

    def _gather(self, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The ids of some words, one word after the other."""
        ends = np.cumsum(sizes)
        return self.flat[np.repeat((starts - ends + sizes).astype(np.int32), sizes) + np.arange(sizes.sum(), dtype=np.int32)]

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)

    def _learn(self, words: list[str]) -> None:
        """Ask for many words in one text, a line each: a line end alone is a token of its own, which parts them again.

        Words that hold line ends go along if each of these stands alone, and are known by their number.
        """
        even = [bool(w) and "\n".join(w.split()) == w for w in words]
        plain = list(compress(words, even))
        lines = np.fromiter((w.count("\n") + 1 for w in plain), np.int64, len(plain))
        ids = self.whole("\n".join([" " + w for w in plain]))
        ends = np.append(np.flatnonzero(ids == self.line_end), len(ids))
        if len(ends) == lines.sum():
            ends = ends[np.cumsum(lines) - 1]
            self._keep(plain, np.diff(ends, prepend=-1) - 1, np.delete(ids, ends[:-1]))
            words = list(compress(words, [not e for e in even]))
        found = [x.ids for x in self.tokenizer.encode_batch_fast([" " + w for w in words], add_special_tokens=False)]
        self._keep(words, np.array([len(f) for f in found], np.int64), np.fromiter(chain.from_iterable(found), self.dtype))

    def _keep(self, words: list[str], sizes: np.ndarray, ids: np.ndarray) -> None:
        first, used = len(self.rows), self.used
        self.used += len(ids)
        self.flat = _room(self.flat, self.used)
        self.flat[used : self.used] = ids
        self.starts, self.sizes = _room(self.starts, first + len(words)), _room(self.sizes, first + len(words))
        self.seen = _room(self.seen, first + len(words))
        self.seen[first : first + len(words)] = 0
        self.sizes[first : first + len(words)] = sizes
        self.starts[first : first + len(words)] = used + np.cumsum(sizes) - sizes
        self.rows.update(zip(words, range(first, first + len(words)), strict=True))

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text, in order."""
        sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
        start = 0
        while start < len(texts):
            end = start + max(1, int(np.searchsorted(np.cumsum(sizes[start:]), SLICE_BYTES)))
            yield from self._encode(texts[start:end])
            start = end

    def _encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        if len(self.rows) > KEPT:
            self._forget()
        plain = pc.fill_null(texts, "").cast(pa.large_string())
        uneven = pc.match_substring_regex(plain, _UNEVEN)
        words = pc.split_pattern(pc.if_else(uneven, "", plain), " ")
        offsets, coded = np.asarray(words.offsets) - words.offsets[0].as_py(), words.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        known = np.fromiter(map(self.rows.get, distinct, repeat(-1)), np.int32, len(distinct))
        missing = np.flatnonzero(known < 0)
        if unseen := [distinct[k] for k in missing.tolist()]:
            self._learn(unseen)
            known[missing] = np.fromiter(map(self.rows.__getitem__, unseen), np.int32, len(unseen))
        self.seen[known] += 1
        rows = known[np.asarray(coded.indices)]
        # A text's first word has no space before it and is asked for by itself.
        sizes = self.sizes[rows]
        sizes[offsets[:-1]] = 0
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = self._gather(self.starts[rows], sizes)
        firsts = self.tokenizer.encode_batch_fast(coded.dictionary.take(coded.indices.take(pa.array(offsets[:-1]))).to_pylist(), add_special_tokens=False)
        for k, whole in enumerate(uneven.to_pylist()):
            if whole:
                yield self.whole(plain[k].as_py())
            else:
                rest = ids[ends[offsets[k]] : ends[offsets[k + 1]]]
                yield np.concatenate([np.array(firsts[k].ids, self.dtype), rest])


def _room(array: np.ndarray, needed: int) -> np.ndarray:
    """The array, made longer if it has fewer places than needed."""
    return array if needed <= len(array) else np.concatenate([array, np.zeros(max(needed - len(array), len(array) // 2), array.dtype)])


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def sequence_schema(dtype: np.dtype, length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))])


class ShardWriter:
    """Writes one shard: a run of ids, cut into sequences; the last one is padded with id 0 and a false mask."""

    def __init__(self, folder: str, shard: int, dtype: np.dtype, length: int, rows: int):
        self.fs, root = pafs.FileSystem.from_uri(folder)
        self.final, self.temporary = f"{root}/shard-{shard:05d}.arrow", f"{root}/.{uuid.uuid4().hex}.arrow"
        self.length, self.block, self.written = length, length * rows, 0
        self.schema, self.rest = sequence_schema(dtype, length), np.empty(0, dtype)
        self.file = self.fs.open_output_stream(self.temporary)
        self.writer = pa.ipc.new_file(self.file, self.schema)

    def _batch(self, ids: np.ndarray) -> None:
        padded = -(-len(ids) // self.length) * self.length
        real = np.arange(padded) < len(ids)
        values = np.concatenate([ids, np.zeros(padded - len(ids), ids.dtype)])
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(c), self.length) for c in (values, real)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def add(self, runs: list[np.ndarray]) -> None:
        ids = np.concatenate([self.rest, *runs])
        whole = len(ids) // self.block * self.block
        for at in range(0, whole, self.block):
            self._batch(ids[at : at + self.block])
        self.rest = ids[whole:]

    def close(self) -> None:
        if len(self.rest):
            self._batch(self.rest)
        self.writer.close()
        self.file.close()
        self.fs.move(self.temporary, self.final)


class ShardReader:
    """Random access to the ids of one shard; a local file is mapped, not read."""

    def __init__(self, folder: str, shard: int):
        fs, root = pafs.FileSystem.from_uri(folder)
        path = f"{root}/shard-{shard:05d}.arrow"
        self.file = pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)
        self.reader = pa.ipc.open_file(self.file)
        self.block = len(self.reader.get_batch(0)) * self.reader.schema.field("ids").type.list_size if self.reader.num_record_batches else 1
        self.at, self.values = -1, np.empty(0)

    def _values(self, batch: int) -> np.ndarray:
        if batch != self.at:
            found = self.reader.get_batch(batch)
            if not all(np.asarray(found["mask"].flatten())) and batch + 1 < self.reader.num_record_batches:
                raise ValueError("padding inside a shard")
            self.at, self.values = batch, found["ids"].flatten().to_numpy(zero_copy_only=True)
        return self.values

    def ids(self, start: int, n: int) -> np.ndarray:
        parts, end = [], start + n
        while start < end:
            batch, place = divmod(start, self.block)
            parts.append(self._values(batch)[place : place + end - start])
            start += len(parts[-1])
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    def close(self) -> None:
        self.values = np.empty(0)
        self.file.close()


def write(docs: DataFrame, folder: str, path: str, end_id: int, length: int = LENGTH, rows: int = ROWS) -> None:
    """Encode `docs` (doc_id, text) with the tokenizer file `path` and write the dataset into `folder` (shared, new)."""
    pafs.FileSystem.from_uri(folder)[0].create_dir(pafs.FileSystem.from_uri(folder)[1], recursive=True)
    index = pa.schema([("doc_id", pa.int64()), ("shard", pa.int32()), ("start_in_shard", pa.int64()), ("n_tokens", pa.int64())])

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, writer, at = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            encoder = word_encoder(path)
            writer = writer or ShardWriter(folder, shard, encoder.dtype, length, rows)
            sizes, waiting, weight = [], [], 0
            for ids in encoder.encode(batch["text"]):
                waiting += [ids, np.array([end_id], encoder.dtype)]
                sizes.append(len(ids) + 1)
                weight += sizes[-1]
                if weight >= writer.block:
                    writer.add(waiting)
                    waiting, weight = [], 0
            writer.add(waiting)
            ends = at + np.cumsum(sizes)
            columns = [batch["doc_id"], pa.array(np.full(len(sizes), shard, np.int32)), pa.array(ends - sizes), pa.array(np.array(sizes, np.int64))]
            at = int(ends[-1])
            yield pa.RecordBatch.from_arrays(columns, schema=index)
        if writer:
            writer.close()

    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("salt", F.xxhash64("text"))
    ordered = ranged.repartitionByRange("doc_id", "salt").sortWithinPartitions("doc_id", "salt").select("doc_id", "text")
    ordered.mapInArrow(written, "doc_id long, shard int, start_in_shard long, n_tokens long").write.parquet(f"{folder}/index")


def index(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, shard, start_in_shard, n_tokens and start (ids of all documents before it)."""
    found = spark.read.parquet(f"{folder}/index")
    # One row per shard: a running sum over them is as small as the list of files.
    sizes = found.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = sizes.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    return found.join(before, "shard").withColumn("start", F.col("before") + F.col("start_in_shard")).drop("before")


def read_back(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32, with the ids taken from the files."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, opened = None, None
        for batch in batches:
            sums = []
            for shard, start, n in zip(*(batch[c].to_pylist() for c in ("shard", "start_in_shard", "n_tokens")), strict=True):
                if shard != opened:
                    if reader:
                        reader.close()
                    reader, opened = ShardReader(folder, shard), shard
                sums.append(zlib.crc32(reader.ids(start, n).astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["start"], batch["n_tokens"], pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
        if reader:
            reader.close()

    places = index(spark, folder).select("doc_id", "shard", "start_in_shard", "start", "n_tokens")
    return places.mapInArrow(rows, "doc_id long, start long, n_tokens long, ids_crc32 long")
