"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of 64 words; only the document has a label. Every passage of the whole text is encoded
by what it is written with (rates of adjacent character-class pairs, word length, share of distinct and of repeated
words), goes through a hidden layer, and gets a gated attention weight; the attention-weighted sum of the hidden
passages is classified:

    h_i = tanh(W x_i + b)      a_i = softmax_i( w . (tanh(V h_i) * sigmoid(U h_i)) )      p = sigmoid( c . sum_i a_i h_i + c_0 )

The network is fitted by Adam on a bounded sample of the labelled rows: of each class the `per_class` rows with the
smallest hash, weighted so that the classes keep their true shares (the scores are probabilities). In the fit alone, a
text of more than `BAG` passages has neighbouring passages averaged into BAG groups, so that the sample's size is
bounded in memory too; scoring takes every passage as it is.

Defined results: a NULL, empty or wordless text is one passage without words. Rows with a NULL label or an unknown id
teach nothing; of several labels of an id the lowest counts. With labels of one class only, or none, every score is the
share of label 1 (a half without labels). Repeated rows are scored alike. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.texts import map_rows
from ebbtide.session import cut_lineage

WORDS = 64
PER_CLASS = 1536
BAG = 64
HIDDEN, GATES = 24, 16
EPOCHS, BATCH, RATE, DECAY = 30, 64, 3e-3, 1e-4

# Character classes of a byte.
_CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\x0b\x0c\r", b"\n", b".,;:?", b"!", b"#*$%&|<>", b"()[]{}\"'`", bytes(range(128, 256))]
_OTHER = len(_CLASSES)
_KINDS = _OTHER + 1
_CLASS_OF = np.full(256, _OTHER, np.int64)
for _number, _members in enumerate(_CLASSES):
    _CLASS_OF[list(_members)] = _number
_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\n\x0b\x0c\r")] = True
FEATURES = _KINDS * _KINDS + 3


def passages(text: str | None) -> np.ndarray:
    """One row of features per passage of the whole text; a text without words is one row of zeros."""
    data = (text or "").encode("utf-8", "replace")
    words = data.split()
    if not words:
        return np.zeros((1, FEATURES), np.float32)
    codes = np.frombuffer(data, np.uint8)
    blank = _BLANK[codes]
    starts = ~blank
    starts[1:] &= blank[:-1]
    firsts = np.flatnonzero(starts)[::WORDS]
    n = len(firsts)
    firsts[0] = 0
    passage = np.zeros(len(codes), np.int64)
    passage[firsts[1:]] = 1
    kinds = _CLASS_OF[codes]
    pairs = np.cumsum(passage) * (_KINDS * _KINDS) + kinds * _KINDS
    pairs[:-1] += kinds[1:]
    pairs[-1] += _CLASS_OF[10]
    out = np.empty((n, FEATURES), np.float32)
    counts = np.bincount(pairs, minlength=n * _KINDS * _KINDS).reshape(n, _KINDS * _KINDS)
    out[:, :-3] = counts / counts.sum(axis=1, keepdims=True)
    for k in range(n):
        part = words[k * WORDS : (k + 1) * WORDS]
        out[k, -3] = sum(map(len, part)) / len(part) / 10
        out[k, -2] = len(set(part)) / len(part)
        out[k, -1] = sum(map(bytes.__eq__, part, part[1:])) / len(part)
    return out


def _grouped(rows: np.ndarray) -> np.ndarray:
    """At most BAG rows: means of neighbouring passages."""
    if len(rows) <= BAG:
        return rows
    edges = np.arange(BAG) * len(rows) // BAG
    return np.add.reduceat(rows, edges, axis=0) / np.diff([*edges, len(rows)])[:, None]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Network:
    """Parameters, with the means and scales of the features."""

    mean: np.ndarray
    scale: np.ndarray
    theta: list[np.ndarray]

    @staticmethod
    def start(rows: np.ndarray, seed: int = 0) -> Network:
        random = np.random.default_rng(seed)
        shapes = [(FEATURES, HIDDEN), (HIDDEN,), (HIDDEN, GATES), (HIDDEN, GATES), (GATES,), (HIDDEN,), (1,)]
        theta = [random.normal(0, 1 / np.sqrt(s[0]), s) if len(s) == 2 or s == (GATES,) else np.zeros(s) for s in shapes]
        theta[5] = random.normal(0, 0.1, HIDDEN)
        return Network(rows.mean(axis=0), rows.std(axis=0) + 1e-3, theta)

    def forward(self, rows: np.ndarray, starts: np.ndarray) -> tuple:
        """Probability of each bag, attention of each row, and what the gradient needs; bags begin at `starts`."""
        w, b, v, u, gate, c, c0 = self.theta
        bag = np.zeros(len(rows), np.int64)
        bag[starts[1:]] = 1
        bag = np.cumsum(bag)
        x = np.clip((rows - self.mean) / self.scale, -10, 10)
        h = np.tanh(x @ w + b)
        t, s = np.tanh(h @ v), _sigmoid(h @ u)
        energy = (t * s) @ gate
        weight = np.exp(energy - np.maximum.reduceat(energy, starts)[bag])
        a = weight / np.add.reduceat(weight, starts)[bag]
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return _sigmoid(z @ c + c0), a, (bag, x, h, t, s, z)

    def gradient(self, rows: np.ndarray, starts: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
        """Of the weighted mean log loss."""
        _, _, v, u, gate, c, _ = self.theta
        p, a, (bag, x, h, t, s, z) = self.forward(rows, starts)
        out = weights * (p - labels) / weights.sum()
        to_z = (out[:, None] * c)[bag]
        to_a = (to_z * h).sum(axis=1)
        energy = a * (to_a - np.add.reduceat(a * to_a, starts)[bag])
        to_t, to_s = energy[:, None] * gate * s * (1 - t * t), energy[:, None] * gate * t * s * (1 - s)
        to_h = (a[:, None] * to_z + to_t @ v.T + to_s @ u.T) * (1 - h * h)
        return [x.T @ to_h, to_h.sum(axis=0), h.T @ to_t, h.T @ to_s, (t * s).T @ energy, z.T @ out, np.array([out.sum()])]

    def score(self, text: str | None) -> tuple[float, int, int]:
        """Probability of label 1, number of passages, and the passage with the largest attention."""
        rows = passages(text)
        p, a, _ = self.forward(rows, np.zeros(1, np.int64))
        return float(p[0]), len(rows), int(a.argmax())


@dataclass
class Constant:
    """What is left to say without labels of both classes."""

    share: float

    def score(self, text: str | None) -> tuple[float, int, int]:
        return self.share, len(passages(text)), 0


def fit(bags: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, seed: int = 0) -> Network:
    """Adam over shuffled batches of bags."""
    network = Network.start(np.concatenate(bags), seed)
    random = np.random.default_rng(seed + 1)
    first, second = [np.zeros_like(p) for p in network.theta], [np.zeros_like(p) for p in network.theta]
    step, weights = 0, weights / weights.mean()
    for epoch in range(EPOCHS):
        order = random.permutation(len(bags))
        rate = RATE * min(1.0, 2 * (1 - epoch / EPOCHS))
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            sizes = [len(bags[k]) for k in chosen]
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            slopes = network.gradient(np.concatenate([bags[k] for k in chosen]), starts, labels[chosen], weights[chosen])
            step += 1
            for k, slope in enumerate(slopes):
                first[k] = 0.9 * first[k] + 0.1 * slope
                second[k] = 0.999 * second[k] + 0.001 * slope * slope
                change = (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                network.theta[k] = network.theta[k] - rate * (change + DECAY * network.theta[k])
    return network


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Network | Constant:
    """Network from `labels` (doc_id, quality: the rows that may teach) and the texts of `docs` (doc_id, text)."""
    known = cut_lineage(labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality")))
    sizes = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    parts = [known.where(F.col("quality") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    share = sizes.get(1, 0) / sum(sizes.values()) if sizes else 0.5
    if not (sizes.get(0) and sizes.get(1)):
        return Constant(share)

    def rows(ids: list, texts: list, quality: list) -> Iterator[tuple]:
        for doc_id, text, label in zip(ids, texts, quality, strict=True):
            yield doc_id, label, _grouped(passages(text)).astype("<f4").tobytes()

    # At most 2 * per_class rows of two numbers: small whatever the corpus. Their passages are at most BAG rows each.
    chosen = docs.select("doc_id", "text").join(F.broadcast(parts[0].union(parts[1])), "doc_id").select("doc_id", "text", "quality")
    taught = map_rows(chosen, rows, "doc_id long, quality int, bag binary").orderBy("doc_id", "bag").collect()
    if len({r["quality"] for r in taught}) < 2:
        return Constant(share)
    bags = [np.frombuffer(r["bag"], "<f4").reshape(-1, FEATURES) for r in taught]
    quality = np.array([r["quality"] for r in taught])
    weights = np.array([sizes[k] / (quality == k).sum() for k in quality])
    return fit(bags, quality.astype(float), weights)


def score(df: DataFrame, model: Network | Constant, text: Column | str = "text") -> Column:
    """struct<score double, n_passages int, top_passage int> of a text column; a narrow expression."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("score double, n_passages int, top_passage int")
    def scored(texts: pa.Array) -> pa.Array:
        found = [shared.value.score(t) for t in texts.to_pylist()]
        columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.float64(), pa.int32(), pa.int32()))]
        return pa.StructArray.from_arrays(columns, ["score", "n_passages", "top_passage"])

    return scored(text)
