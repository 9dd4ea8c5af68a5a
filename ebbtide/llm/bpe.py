"""Byte-level BPE: encoding by a priority queue of merge ranks, decoding by concatenating vocabulary strings.

A text is cut at the special tokens, then into pieces by the tokenizer's split pattern; a piece becomes a doubly
linked list of byte symbols, and the queue holds the adjacent pairs that have a merge rank. The lowest rank (leftmost
first) is merged; entries whose symbols have changed meanwhile are stale and skipped. That is O(n log n) in the piece,
so a piece of a million characters is no special case. Pieces of ordinary length are remembered per worker, up to a
bounded number.

Both functions are narrow column expressions: no shuffle, rows and their order stay as they are. A NULL text encodes
and decodes like an empty one (no ids, empty text). A special token's string in a text is that token.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from heapq import heapify, heappop, heappush
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pieces longer than this are encoded anew each time.
KEPT_LENGTH = 48
#: Bits of a queue entry that hold the place; the rank is above them.
PLACE_BITS = 40
PLACES = (1 << PLACE_BITS) - 1
#: Pieces remembered by a worker before the store is emptied.
KEPT_PIECES = 600_000

# The split pattern of the byte-level tokenizer, and the same for texts of ASCII characters only.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)


def _byte_characters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary: itself, or the next one from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class Codec:
    """Encoder and decoder of one vocabulary file (JSON with `model.vocab`, `model.merges`, `added_tokens`)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            description = json.load(file)
        model = description["model"]
        vocab: dict[str, int] = model["vocab"]
        characters = _byte_characters()
        byte_of = {c: b for b, c in enumerate(characters)}
        self.specials = {t["content"]: t["id"] for t in description.get("added_tokens", [])}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.symbols = [vocab[c] for c in characters]
        size = 1 + max([*vocab.values(), *self.specials.values()])
        self.base = size
        self.merges: dict[int, int] = {}  # by left * base + right: rank, moved up to leave room for a place
        self.merged: list[tuple[int, int]] = []  # by rank: the pair that merges, the symbol it makes
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            pair = vocab[left] * size + vocab[right]
            self.merges[pair] = rank << PLACE_BITS
            self.merged.append((pair, vocab[left + right]))
        self.strings = [b""] * size
        for token, k in vocab.items():
            self.strings[k] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        for token, k in self.specials.items():
            self.strings[k] = token.encode()
        self.kept: dict[str, bytes] = {}

    def merge(self, piece: str) -> list[int]:
        """Ids of one piece."""
        symbols = [*map(self.symbols.__getitem__, piece.encode("utf-8", "replace"))]
        n, base, merges, merged = len(symbols), self.base, self.merges.get, self.merged
        queue = []
        for at in range(n - 1):
            found = merges(symbols[at] * base + symbols[at + 1])
            if found is not None:
                queue.append(found + at)
        if not queue:
            return symbols
        heapify(queue)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        while queue:
            entry = heappop(queue)
            at = entry & PLACES
            other = after[at]
            pair, made = merged[entry >> PLACE_BITS]
            if other >= n or symbols[at] * base + symbols[other] != pair:
                continue  # stale: one of the two has been merged away or into something else
            symbols[at], symbols[other] = made, -1
            follower = after[at] = after[other]
            if follower < n:
                before[follower] = at
                found = merges(made * base + symbols[follower])
                if found is not None:
                    heappush(queue, found + at)
            leader = before[at]
            if leader >= 0:
                found = merges(symbols[leader] * base + made)
                if found is not None:
                    heappush(queue, found + leader)
        return [s for s in symbols if s >= 0]

    def pieces(self, text: str) -> list[str]:
        return (ASCII_PIECES if text.isascii() else PIECES).findall(text)

    def _packed(self, piece: str) -> bytes:
        ids = self.merge(piece)
        packed = pack(f"<{len(ids)}I", *ids)
        if len(piece) <= KEPT_LENGTH:
            if len(self.kept) >= KEPT_PIECES:
                self.kept.clear()
            self.kept[piece] = packed
        return packed

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        out: list[bytes] = []
        get, packed = self.kept.get, self._packed
        for k, part in enumerate(self.cut.split(text) if self.cut else [text]):
            if k % 2:
                out.append(pack("<I", self.specials[part]))
            else:
                out.extend([get(p) or packed(p) for p in self.pieces(part)])
        return b"".join(out)

    def decode(self, ids: bytes | None) -> str:
        """The text of packed ids; bytes that are not UTF-8 become U+FFFD."""
        strings = self.strings
        return b"".join(map(strings.__getitem__, np.frombuffer(ids or b"", "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """One codec per worker and file."""
    return Codec(path)


def encode(text: Column | str, path: str) -> Column:
    """Binary column of ids, little-endian unsigned 32-bit, of a text column."""

    @F.arrow_udf("binary")
    def ids(texts: pa.Array) -> pa.Array:
        return pa.array(map(codec(path).encode, texts.to_pylist()), pa.binary())

    return ids(text)


def decode(ids: Column | str, path: str) -> Column:
    """Text column of a binary column of ids."""

    @F.arrow_udf("string")
    def text(packed: pa.Array) -> pa.Array:
        return pa.array(map(codec(path).decode, packed.to_pylist()), pa.string())

    return text(ids)


def id_array(ids: Column | str) -> Column:
    """The packed ids as array<int>."""

    @F.arrow_udf("array<int>")
    def unpacked(packed: pa.Array) -> pa.Array:
        return pa.array([np.frombuffer(b or b"", "<u4").astype("int32") for b in packed.to_pylist()], pa.list_(pa.int32()))

    return unpacked(ids)
