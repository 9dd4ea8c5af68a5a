"""Token counts of whole texts, huge ones by overlapping chunks that are spliced where both sides provably agree.

A text of up to `chunk` characters is counted at once. A longer one is cut into chunks that overlap; each is encoded with
offsets, a few chunks a call, so that memory follows the chunk and not the text. Two neighbours are spliced at a position
that starts a word (a piece of the tokenizer's split) in both.

Why that position is safe. The split runs left to right without looking back, so from the start of a piece on it depends on
the text from there on alone, and a piece is encoded by itself. A left chunk that begins at a piece start of the whole text
therefore has the whole text's pieces up to where its own end can matter: the longest string the split or the special
tokens must see beyond a piece, `margin` characters. A piece start of the left chunk before that margin is one of the whole
text; if the right chunk has it too, the right chunk's pieces from there on are the whole text's as well, however badly its
first piece was cut. So ids to the left are taken from the left chunk, those to the right from the right one, and the right
chunk becomes the next left chunk.

If no position fits (one run of letters or of white space fills the overlap), the right chunk is encoded again with an
overlap twice as wide to the left and reaching as much further to the right, until it begins at the last safe position, where
the two agree by construction. The widths double, so the work stays in proportion to the text.

The argument holds for byte-level tokenizers with their own split, no normaliser and special tokens that take no white
space; other vocabularies (also sentencepiece models) are encoded whole. For the former, texts without white space before a
space are counted word by word, each distinct word asked for once (see `token_files.WordEncoder` for why that is exact).

Defined results: a NULL text counts like an empty one, 0 tokens. Special tokens inside a text count as the library counts
them by default. Rows and their order stay as they are; repeated rows are counted alike; further columns are not read.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import batched

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ebbtide.llm.token_files import KEPT, SLICE_BYTES, _UNEVEN, WordEncoder

#: Characters of a chunk and of an overlap, and chunks encoded in one call.
CHUNK, OVERLAP, GROUP = 1 << 15, 256, 16
#: Characters the split may look at beyond a piece: a quote and two letters of a contraction.
LOOKAHEAD = 3


@dataclass
class Chunk:
    """An encoded stretch of a text: where pieces start, the tokens before each start, and all tokens."""

    begin: int
    end: int
    starts: np.ndarray
    before: np.ndarray
    tokens: int

    def tokens_at(self, position: int) -> int:
        """Tokens before a piece start."""
        return int(self.before[np.searchsorted(self.starts, position)])


def common_start(left: Chunk, right: Chunk, least: int, margin: int) -> int | None:
    """First position from `least` on that starts a piece in both chunks and lies before the margin of the left one."""
    ours = left.starts[(left.starts >= max(least, right.begin)) & (left.starts <= left.end - margin)]
    shared = ours[np.isin(ours, right.starts)]
    return int(shared[0]) if len(shared) else None


class Resynchroniser:
    """Counts the tokens of a long text by `encode`, which gives (begin, text) stretches as chunks."""

    def __init__(self, encode: Callable[[list[tuple[int, str]]], list[Chunk]], chunk: int, overlap: int, margin: int):
        if not 0 < overlap < chunk or chunk <= margin:
            raise ValueError(f"chunk {chunk} must be larger than overlap {overlap} and margin {margin}")
        self.encode, self.chunk, self.overlap, self.margin = encode, chunk, overlap, margin
        self.widened = 0

    def _grid(self, text: str) -> Iterator[Chunk]:
        begins = range(0, max(1, len(text) - self.overlap), self.chunk - self.overlap)
        for group in batched(begins, GROUP):
            yield from self.encode([(b, text[b : b + self.chunk]) for b in group])

    def count(self, text: str) -> int:
        grid = self._grid(text)
        left, safe, total, width = next(grid), 0, 0, self.overlap
        for right in grid:
            if right.end <= left.end:
                continue  # inside a chunk that was widened
            place = common_start(left, right, safe, self.margin)
            width = self.overlap if place is not None else width
            while place is None:
                width *= 2
                begin, end = max(safe, left.end - width), min(len(text), max(right.end, left.end + width))
                right = self.encode([(begin, text[begin:end])])[0]
                self.widened += 1
                place = common_start(left, right, safe, self.margin)
            total += left.tokens_at(place) - left.tokens_at(safe)
            left, safe = right, place
        return total + left.tokens - left.tokens_at(safe)


class WordCounter(WordEncoder):
    """Tokens of texts, by distinct words; ids are not kept."""

    def _keep(self, words: list[str], sizes: np.ndarray, ids: np.ndarray) -> None:
        super()._keep(words, sizes, ids[:0])

    def count(self, plain: pa.Array) -> np.ndarray:
        """Tokens of texts none of which has white space before a space."""
        words = pc.split_pattern(plain, " ")
        offsets, coded = np.asarray(words.offsets) - words.offsets[0].as_py(), words.flatten().dictionary_encode()
        distinct, codes = coded.dictionary.to_pylist(), np.asarray(coded.indices)
        if unseen := [w for w in distinct if w not in self.rows]:
            self._learn(unseen)
        sizes = self.sizes[np.fromiter(map(self.rows.__getitem__, distinct), np.int32, len(distinct))][codes].astype(np.int64)
        # A text's first word has no space before it and is asked for by itself.
        sizes[offsets[:-1]] = 0
        firsts = self.tokenizer.encode_batch_fast([distinct[k] for k in codes[offsets[:-1]].tolist()], add_special_tokens=False)
        return np.add.reduceat(sizes, offsets[:-1]) + [len(f) for f in firsts]


class Counter:
    """Token counts by one vocabulary file: a tokenizers .json or a sentencepiece .model."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.words, self.long = None, None
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.whole = lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
            return
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.whole = lambda texts: [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        about = json.loads(self.tokenizer.to_str())
        if _splits_left_to_right(about):
            margin = max([LOOKAHEAD, *(len(t["content"]) for t in about["added_tokens"])])
            self.words, self.long = WordCounter(path), Resynchroniser(self._chunks, chunk, overlap, margin)

    def _chunks(self, stretches: list[tuple[int, str]]) -> list[Chunk]:
        found = []
        for (begin, text), e in zip(stretches, self.tokenizer.encode_batch([t for _, t in stretches], add_special_tokens=False), strict=True):
            words = np.array(e.word_ids)
            first = np.flatnonzero(np.diff(words, prepend=-1))
            starts = np.array([at for at, _ in e.offsets], np.int64)[first] + begin
            found.append(Chunk(begin, begin + len(text), starts, first, len(words)))
        return found

    def count(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text."""
        plain = pc.fill_null(texts, "")
        if not self.long:
            return np.array(self.whole(plain.to_pylist()), np.int64)
        counts = np.zeros(len(plain), np.int64)
        long = np.asarray(pc.greater(pc.utf8_length(plain), self.long.chunk))
        uneven = ~long & np.asarray(pc.match_substring_regex(plain, _UNEVEN))
        short = ~long & ~uneven
        for k in np.flatnonzero(long).tolist():
            counts[k] = self.long.count(plain[k].as_py())
        counts[uneven] = self.whole(plain.filter(pa.array(uneven)).to_pylist())
        if short.any():
            if len(self.words.rows) > KEPT:
                self.words.start()
            counts[short] = self.words.count(plain.filter(pa.array(short)).cast(pa.large_string()))
        return counts


def _splits_left_to_right(about: dict) -> bool:
    """Whether the proof above holds for a tokenizer."""
    split = about["pre_tokenizer"] or {}
    byte_level = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in about["added_tokens"])
    return bool(byte_level and plain and about["normalizer"] is None and about["post_processor"] is None)


@lru_cache(maxsize=4)
def counter(path: str, chunk: int, overlap: int) -> Counter:
    """One counter per worker and file."""
    return Counter(path, chunk, overlap)


def count(text: Column | str, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Column:
    """Number of tokens of a text column; a narrow expression."""

    @F.arrow_udf("long")
    def counted(texts: pa.Array) -> pa.Array:
        made, parts, start = counter(path, chunk, overlap), [], 0
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64))
        while start < len(texts):
            end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + SLICE_BYTES)))
            parts.append(made.count(texts[start:end]))
            start = end
        return pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64())

    return counted(text)
