"""Toxicity by the nearest labelled examples: exact cosine over an inverted index of all their terms.

Examples are a bounded sample of the labelled rows: of each class the `per_class` rows with the smallest hash. Terms are
lower-cased runs of letters. The vocabulary holds every term of the examples, so a vector is the text's whole TF-IDF
vector, each term also weighted by its relevance frequency, log2(2 + rate in toxic / rate in other examples) (Lan et al.,
tf.rf): it moves the cosine towards words that tell the classes apart and leaves none out. The inverse document frequency
is over all documents. The number of examples bounds vocabulary and index, which is what makes them fit for a broadcast.

Search. Texts go through the index some at a time. Their cosines with every example are first summed in single
precision: the terms of a sixteenth of the examples or more (at most DENSE) as one product of matrices, the others by
their lists. The bound on the rounding of these sums leaves a few examples that can be among the k nearest; their cosines
are summed in double precision over all terms, so the k nearest are exact; ties go to the example that comes first.
(Bounds by block maxima skip next to nothing when vectors hold the everyday words; they are kept as `maxima`, but the
search does not depend on them.) Votes of the k
nearest are weighted by cosine and by how thinly their class was sampled, and a logistic curve fitted to the examples'
own leave-one-out votes turns them into scores. A text that shares no term with any example gets the rate of toxic rows
among such examples.

Defined results: NULL and empty texts share no term. Rows with a NULL label or an unknown id teach nothing; an id with
several labels counts as toxic if one of them is. Without examples of both classes every score is the rate of toxic
labels, 0 if there are none. Repeated rows are scored alike. Further columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cached_property
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.texts import LETTER_RUNS, SLICE_ROWS, release, sum_terms
from ebbtide.session import cut_lineage

PER_CLASS = 4096
NEAREST = 15
BLOCK = 64
#: Frequent terms that stand in a matrix, at most; texts that go through the index together.
DENSE, TEXTS_AT_ONCE = 512, 64
#: Everything but letters to a space, for texts of ASCII characters only: there the same as LETTER_RUNS.
_SPACED = {k: " " for k in range(128) if not chr(k).isalpha()}


def terms_of(text: str | None) -> list[str]:
    """The lower-cased runs of letters of a text."""
    lower = (text or "").lower()
    return lower.translate(_SPACED).split() if lower.isascii() else LETTER_RUNS.findall(lower)


def term_counts(text: str | None, vocabulary: dict[str, int]) -> dict[int, int]:
    """Occurrences of vocabulary terms by their number."""
    get = vocabulary.get
    return {k: n for w, n in Counter(terms_of(text)).items() if (k := get(w)) is not None}


class Maxima:
    """Largest weight of a term in each block of examples, made for the terms asked for."""

    def __init__(self, index: Index):
        self.index = index

    def __getitem__(self, terms: list[int]) -> np.ndarray:
        found = np.zeros((len(terms), -(-len(self.index.labels) // BLOCK)))
        for row, term in zip(found, terms, strict=True):
            inside = slice(self.index.starts[term], self.index.starts[term + 1])
            np.maximum.at(row, self.index.examples[inside] // BLOCK, self.index.values[inside])
        return found


class Index:
    """Unit vectors of the examples as postings by term; `idf` holds the weight of each term."""

    def __init__(self, vocabulary: list[str], idf: np.ndarray, counts: Iterable[dict[int, int]], labels: np.ndarray, weights: np.ndarray):
        self.vocabulary = {t: k for k, t in enumerate(vocabulary)}
        self.idf = idf
        self.labels, self.weights = labels, weights
        vectors = [self.vector(c) for c in counts]
        terms = np.concatenate([t for t, _ in vectors]) if vectors else np.empty(0, np.int64)
        order = np.argsort(terms, kind="stable")
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(terms, minlength=len(vocabulary)))])
        self.examples = np.repeat(np.arange(len(vectors), dtype=np.int32), [len(t) for t, _ in vectors])[order]
        self.values = np.concatenate([v for _, v in vectors])[order] if vectors else np.empty(0)

    @property
    def maxima(self) -> Maxima:
        return Maxima(self)

    def __getstate__(self) -> dict:
        """What the lists can be turned into is made again where it is needed."""
        return {name: part for name, part in self.__dict__.items() if name not in ("frequent", "by_example", "packed")}

    @cached_property
    def frequent(self) -> tuple[np.ndarray, np.ndarray]:
        """The place of each term in the matrix, -1 if it has none, and the matrix of weights by place and example."""
        sizes = np.diff(self.starts)
        terms = np.argsort(-sizes, kind="stable")[:DENSE]
        terms = terms[sizes[terms] >= max(1, len(self.labels) / 16)]
        place, matrix = np.full(len(sizes), -1), np.zeros((len(terms), len(self.labels)), np.float32)
        place[terms] = np.arange(len(terms))
        for row, term in zip(matrix, terms.tolist(), strict=True):
            inside = slice(self.starts[term], self.starts[term + 1])
            row[self.examples[inside]] = self.values[inside]
        return place, matrix

    @cached_property
    def packed(self) -> np.ndarray:
        """Example and weight, in single precision, of each posting side by side, so that one access fetches both."""
        pairs = np.empty((len(self.examples), 2), np.int32)
        pairs[:, 0], pairs[:, 1] = self.examples, self.values.astype(np.float32).view(np.int32)
        return pairs.view(np.int64).ravel()

    @cached_property
    def by_example(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ascending terms and weights of the examples' vectors."""
        order = np.argsort(self.examples, kind="stable")
        starts = np.concatenate([[0], np.cumsum(np.bincount(self.examples, minlength=len(self.labels)))])
        return starts, np.repeat(np.arange(len(self.starts) - 1, dtype=np.int32), np.diff(self.starts))[order], self.values[order]

    def vector(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Terms and weights (1 + log tf) * weight of the term, scaled to length 1."""
        terms, n = np.fromiter(counts, np.int64, len(counts)), np.fromiter(counts.values(), np.int64, len(counts))
        order = np.argsort(terms)
        terms = terms[order]
        values = (1 + np.log(n[order])) * self.idf[terms]
        return terms, values / np.linalg.norm(values) if len(values) else values

    def nearest(self, counts: dict[int, int], k: int = NEAREST, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples with the largest positive cosine and the cosines, largest first; `without` is left out."""
        return self.nearest_of([counts], k, [without])[0]

    def nearest_of(self, texts: list[dict[int, int]], k: int, without: Iterable[int]) -> list[tuple[np.ndarray, np.ndarray]]:
        """`nearest` of several texts."""
        vectors = [self.vector(counts) for counts in texts]
        sums, found = self._rounded(vectors), []
        # Weights are positive and vectors have length 1: what rounding can do to a sum, for both sides of a comparison.
        margin = 2 * (len(self.frequent[1]) + 8) * np.finfo(np.float32).eps
        weight = np.zeros(len(self.starts) - 1)
        for (terms, values), row, left_out in zip(vectors, sums, without):
            if left_out >= 0:
                row[left_out] = 0
            least = np.partition(row, -k)[-k] - margin if len(row) > k else 0.0
            some = np.flatnonzero((row >= least) & (row > 0))
            weight[terms] = values
            cosines = self._cosines(some, weight)
            weight[terms] = 0
            # Ties are found among cosines rounded to 12 places.
            order = np.lexsort((some, -np.round(cosines, 12)))[:k]
            found.append((some[order], cosines[order]))
        return found

    def _rounded(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Cosines by text and example, in single precision."""
        place, matrix = self.frequent
        query, rest = np.zeros((len(vectors), len(matrix)), np.float32), np.zeros((len(vectors), len(self.labels)), np.float32)
        for (terms, values), wanted, sums in zip(vectors, query, rest):
            at = place[terms]
            inside = at >= 0
            wanted[at[inside]] = values[inside]
            terms, values = terms[~inside], values[~inside]
            starts, sizes = self.starts[terms], self.starts[terms + 1] - self.starts[terms]
            ends = np.cumsum(sizes)
            lists = np.repeat(starts - ends + sizes, sizes)
            lists += np.arange(len(lists))
            pairs = self.packed[lists].view(np.int32)
            weights = pairs.view(np.float32)[1::2] * np.repeat(values.astype(np.float32), sizes)
            sums[:] = np.bincount(pairs[::2], weights, len(sums))
        return query @ matrix + rest

    def _cosines(self, examples: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Cosines of some examples with a text given by the weight of every term, summed in the order of the terms."""
        starts, terms, values = self.by_example
        if not len(examples):
            return np.empty(0)
        first, last = starts[examples], starts[examples + 1]
        inside = [slice(a, b) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
        products = np.concatenate([values[x] for x in inside]) * weight[np.concatenate([terms[x] for x in inside])]
        return np.bincount(np.repeat(np.arange(len(examples)), last - first), products, len(examples))

    def votes(self, texts: Iterable[dict[int, int]], without: Iterable[int] = repeat(-1)) -> Iterator[float | None]:
        """Of each text the share of toxic neighbours by cosine and sampling weight; None without a neighbour."""
        texts, without = iter(texts), iter(without)
        while some := list(islice(texts, TEXTS_AT_ONCE)):
            for found, cosines in self.nearest_of(some, NEAREST, list(islice(without, len(some)))):
                weight = cosines * self.weights[found]
                total = weight.sum()
                yield float((weight * self.labels[found]).sum() / total) if total > 0 else None


def _logistic(votes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the weighted logistic curve, by Newton's method with a weak ridge."""
    theta = np.array([4.0, -2.0])
    x = np.stack([votes, np.ones_like(votes)], axis=1)
    weights = weights / weights.mean()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        gradient = x.T @ (weights * (p - labels)) + 1e-1 * theta
        hessian = (x * (weights * p * (1 - p))[:, None]).T @ x + 1e-1 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        theta -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(theta[0]), float(theta[1])


class Model:
    """Index and calibration."""

    def __init__(self, index: Index | None, rate: float, counts: Iterable[dict[int, int]]):
        self.index, self.none, self.curve = index, rate, (0.0, 0.0)
        if index is None:
            return
        votes = list(index.votes(counts, range(len(index.labels))))
        near = np.array([v is not None for v in votes], bool)
        labels, weights = index.labels, index.weights
        if near.any():
            self.curve = _logistic(np.array([v for v in votes if v is not None]), labels[near], weights[near])
        if (~near).any():
            self.none = float((labels * weights)[~near].sum() / weights[~near].sum())

    def score(self, text: str | None) -> float:
        return next(self.scores([text]))

    def scores(self, texts: Iterable[str | None]) -> Iterator[float]:
        if self.index is None:
            yield from (self.none for _ in texts)
            return
        for vote in self.index.votes(term_counts(text, self.index.vocabulary) for text in texts):
            yield self.none if vote is None else 1 / (1 + math.exp(-(self.curve[0] * vote + self.curve[1])))


def sample(labels: DataFrame, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, toxic) of at most `per_class` labelled ids of each class, and the number of labelled ids per class."""
    known = cut_lineage(labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    parts = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    return parts[0].union(parts[1]), sizes


def _vocabulary(examples: DataFrame) -> tuple[list[str], np.ndarray]:
    """Every term of the examples and its relevance frequency."""

    def rows(texts: list, labels: list) -> Iterator[tuple[tuple, int]]:
        for text, label in zip(texts, labels, strict=True):
            for term in set(terms_of(text)):
                yield (term, label), 1

    sizes = {r["toxic"]: r["count"] for r in examples.groupBy("toxic").count().collect()}
    clean, toxic = max(sizes.get(0, 0), 1), max(sizes.get(1, 0), 1)
    counts = sum_terms(examples.select("text", "toxic"), rows, "term string, toxic int")
    a, b = (F.sum(F.when(F.col("toxic") == k, F.col("n")).otherwise(0)).alias(name) for k, name in ((1, "a"), (0, "b")))
    # Bounded: terms of the examples.
    found = counts.groupBy("term").agg(a, b).toArrow().sort_by("term")
    a, b = (found[name].to_numpy().astype(np.float64) for name in ("a", "b"))
    return found["term"].to_pylist(), np.log2(2 + (a / toxic) / (np.maximum(b, 1) / clean))


def _document_frequency(texts: DataFrame, vocabulary: list[str]) -> tuple[np.ndarray, int]:
    """Over all rows: documents with each vocabulary term, and documents."""
    numbers = texts.sparkSession.sparkContext.broadcast({t: k for k, t in enumerate(vocabulary)})

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One number per term of the vocabulary, and that of the documents: a task's memory does not follow its rows.
        found, get = np.zeros(len(numbers.value) + 1, np.int64), numbers.value.get
        for batch in batches:
            found[-1] += batch.num_rows
            for start in range(0, batch.num_rows, SLICE_ROWS):
                for text in batch.column(0).slice(start, SLICE_ROWS).to_pylist():
                    found[[k for w in set(terms_of(text)) if (k := get(w)) is not None]] += 1
        terms = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(terms.astype(np.int32)), pa.array(found[terms])], ["term", "n"])
        release()

    partial = texts.mapInArrow(counted, "term int, n long")
    # Bounded: one row per term of the vocabulary.
    found = partial.groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    frequency = np.zeros(len(vocabulary) + 1, np.int64)
    frequency[found["term"].to_numpy()] = found["n"].to_numpy()
    return frequency[:-1], int(frequency[-1])


class Counts:
    """The examples' term counts, packed; made into dicts one by one."""

    def __init__(self, packed: list[bytes]):
        self.packed = packed

    def __iter__(self) -> Iterator[dict[int, int]]:
        for terms, counts in (np.frombuffer(x, np.int32).reshape(2, -1).tolist() for x in self.packed):
            yield dict(zip(terms, counts, strict=True))


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Model from `labels` (doc_id, toxic: the rows that may teach) and the texts of `docs` (doc_id, text)."""
    chosen, sizes = sample(labels, per_class)
    known = sum(sizes.values())
    rate = sizes.get(1, 0) / known if known else 0.0
    # At most 2 * per_class rows of two numbers: small whatever the corpus.
    examples = cut_lineage(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic"))
    vocabulary, relevance = _vocabulary(examples) if sizes.get(0) and sizes.get(1) else ([], None)
    if not vocabulary:
        return Model(None, rate, [])
    frequency, total = _document_frequency(docs.select("text"), vocabulary)
    idf = (np.log((1 + total) / (1 + frequency)) + 1) * relevance
    numbers = examples.sparkSession.sparkContext.broadcast({t: k for k, t in enumerate(vocabulary)})

    @F.udf("binary", useArrow=True)
    def counted(text: str | None) -> bytes:
        found = term_counts(text, numbers.value)
        return np.array([list(found), list(found.values())], np.int32).tobytes()

    # Bounded: the examples' term counts, not their texts.
    rows = examples.select("doc_id", "toxic", counted("text").alias("counts")).orderBy("doc_id", F.xxhash64("text")).collect()
    present = Counter(r["toxic"] for r in rows)
    weights = np.array([sizes[r["toxic"]] / present[r["toxic"]] for r in rows])
    counts = Counts([r["counts"] for r in rows])
    return Model(Index(vocabulary, idf, counts, np.array([float(r["toxic"]) for r in rows]), weights), rate, counts)


def score(df: DataFrame, model: Model, text: Column | str = "text") -> Column:
    """Score column of a text column; a narrow expression."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        slices = (texts.slice(at, SLICE_ROWS).to_pylist() for at in range(0, len(texts), SLICE_ROWS))
        return pa.array(shared.value.scores(text for part in slices for text in part), pa.float64())

    return scored(text)
