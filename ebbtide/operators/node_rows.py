"""Binned rows of one fit kept in order of the node that they are in, for growing trees on many rows in one task.

The bins of a row are a few bits each of one or more 64-bit words. Features stand in groups of at most GROUP_BITS bits, so a
sum per bin of all features of a group is one pass over the rows: it goes by their joint value and is added up by
feature afterwards. A node's rows are one stretch of the arrays; a split writes the stretch again, left rows first, into a second set of
arrays of the same size, so a task holds two copies of what it sorts and little else.

Weights must be numbers whose sums are exact, whole numbers below 2^53: then neither the order of the rows nor taking a sum
from another one's difference changes a result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Bits of a group and of a word at most, rows handled at a time, and rows from which on groups are summed jointly.
GROUP_BITS, WORD_BITS, STEP, JOINT_ROWS = 12, 63, 1 << 15, 1 << 12


@dataclass(frozen=True)
class Layout:
    """Where the features stand: by feature (word, shift, bits); by group (word, shift, bits, features from the lowest bits up)."""

    features: list[tuple[int, int, int]]
    groups: list[tuple[int, int, int, list[int]]]
    words: int

    @classmethod
    def of(cls, sizes: list[int]) -> Layout:
        """``sizes``: bins of each feature."""
        bits = [max(1, (size - 1).bit_length()) for size in sizes]
        held: list[list[int]] = []
        for f in sorted(range(len(bits)), key=lambda f: (-bits[f], f)):
            room = next((some for some in held if sum(bits[g] for g in some) + bits[f] <= GROUP_BITS), None)
            if room is None:
                held.append(room := [])
            room.append(f)
        places, groups, word, shift = [None] * len(bits), [], 0, 0
        for some in held:
            size = sum(bits[f] for f in some)
            if shift + size > WORD_BITS:
                word, shift = word + 1, 0
            groups.append((word, shift, size, some))
            for f in some:
                places[f] = (word, shift, bits[f])
                shift += bits[f]
        return cls(places, groups, word + 1)

    def packed(self, bins: np.ndarray) -> list[np.ndarray]:
        """The words of rows of bins."""
        out = [np.zeros(len(bins), np.int64) for _ in range(self.words)]
        for a in range(0, len(bins), STEP):
            for f, (word, shift, _) in enumerate(self.features):
                out[word][a : a + STEP] |= bins[a : a + STEP, f].astype(np.int64) << shift
        return out


class NodeRows:
    """Rows in order of their nodes. ``arrays`` are the words and whatever goes with a row; the first rows, as many as
    ``room`` says, are those of the roots named in ``place``: node to (side, first row, row after the last)."""

    def __init__(self, layout: Layout, kinds: list, room: int):
        self.layout, self.sides = layout, tuple([np.empty(room, kind) for kind in [np.int64] * layout.words + kinds] for _ in range(2))
        self.codes, self.go = np.empty(STEP, np.int64), np.empty(room, bool)

    def split(self, place: dict, node: int, feature: int, cut: int, left: int, arrays: list[int]) -> None:
        """Write a node's rows as those of its children, at ``left`` and the number after it; ``arrays`` go along."""
        side, a, b = place.pop(node)
        word, shift, bits = self.layout.features[feature]
        held, after = self.sides[side], self.sides[1 - side]
        mask, most, go = ((1 << bits) - 1) << shift, cut << shift, self.go[a:b]
        for i in range(a, b, STEP):
            some = held[word][i : min(i + STEP, b)]
            codes = np.bitwise_and(some, mask, out=self.codes[: len(some)])
            np.less_equal(codes, most, out=go[i - a : i - a + len(some)])
        at = [a, a + int(np.count_nonzero(go))]
        place[left], place[left + 1] = (1 - side, a, at[1]), (1 - side, at[1], b)
        for i in range(a, b, STEP):
            end = min(i + STEP, b)
            for k, way in enumerate((go[i - a : end - a], ~go[i - a : end - a])):
                rows = np.flatnonzero(way)
                for n in arrays:
                    held[n][i:end].take(rows, out=after[n][at[k] : at[k] + len(rows)], mode="clip")
                at[k] += len(rows)

    def sums(self, place: tuple[int, int, int], features: np.ndarray, bins: int, weights: list[int]) -> np.ndarray:
        """Sums by (feature, bin, weight) of a node's rows; ``weights`` are the numbers of their arrays."""
        side, a, b = place
        held, out = self.sides[side], np.zeros((len(features), bins, len(weights)))
        order = {f: j for j, f in enumerate(features.tolist())}
        if b - a >= JOINT_ROWS:
            groups = [group for group in self.layout.groups if any(f in order for f in group[3])]
        else:
            groups = [(*self.layout.features[f], [f]) for f in order]
        joint = [np.zeros((len(weights), 1 << group[2])) for group in groups]
        for i in range(a, b, STEP):  # so few rows that they stay near while all groups are summed
            end = min(i + STEP, b)
            codes = self.codes[: end - i]
            for (word, shift, bits, _), total in zip(groups, joint, strict=True):
                np.bitwise_and(np.right_shift(held[word][i:end], shift, out=codes), (1 << bits) - 1, out=codes)
                for k, n in enumerate(weights):
                    total[k] += np.bincount(codes, held[n][i:end], 1 << bits)
        for (_, _, _, members), total in zip(groups, joint, strict=True):
            low = 0
            for f in members:
                size = 1 << self.layout.features[f][2]
                if f in order:
                    found = total if len(members) == 1 else total.reshape(len(weights), -1, size, 1 << low).sum(axis=(1, 3))
                    most = min(size, bins)
                    out[order[f], :most] = found[:, :most].T
                low += self.layout.features[f][2]
        return out
