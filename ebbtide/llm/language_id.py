"""Language identification, word first with back-off.

A known word is scored by its log frequency in each language. An unknown word is scored by its character n-grams with
word boundaries: at each position the longest n-gram the model knows (4, then 3, 2, 1 characters), each step back at a
fixed discount. Scores add up over the words of the whole text; the largest wins, ties go to the first name in order.

Learning counts words over every learning row (one narrow pass with bounded partial sums, one shuffle of counts) and
takes the n-gram counts from the distinct words (unseen words resemble rare ones, so every word counts once), never from
the texts again. The model that is broadcast holds at most
`max_words` words and `max_grams` n-grams, the most frequent ones, so its size does not grow with the corpus; what is
beyond is scored by shorter n-grams.

Defined results: NULL text, or one without a letter: `und`, score 0. Nothing to learn from: `und`, score 0, everywhere.
Rows with a NULL text or language teach nothing. Repeated rows count as often as they occur. Other columns of the
table are neither read nor touched.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.texts import LETTER_RUNS, SLICE_ROWS, sum_terms
from ebbtide.session import cut_lineage

UNDETERMINED = "und"
MAX_WORDS = 60_000
MAX_GRAMS = 60_000
LONGEST = 4
#: Counts above this share a place with others within a ten-thousandth in the histogram that finds the least count of a known term.
HIGHEST = 1_000_000
STEP_BACK = math.log(0.4)
#: Scores of words kept by a worker.
KEPT = 200_000
#: N-grams of a word from which on it is summed by itself.
LONG_RUN = 48
#: Characters of texts scored together.
CHARACTERS = 1 << 20


def _words(texts: list, langs: list) -> Iterator[tuple[tuple, int]]:
    counts: dict[str, Counter] = defaultdict(Counter)
    for text, lang in zip(texts, langs, strict=True):
        counts[lang].update(LETTER_RUNS.findall(text.lower()))
    for lang, found in counts.items():
        for word, n in found.items():
            yield (lang, word), n


def _grams(langs: list, words: list) -> Iterator[tuple[tuple, int]]:
    counts: dict[str, Counter] = defaultdict(Counter)
    for lang, word in zip(langs, words, strict=True):
        bounded = f"^{word}$"
        for size in range(1, LONGEST + 1):
            counts[lang].update([bounded[at : at + size] for at in range(len(bounded) - size + 1)])
    for lang, found in counts.items():
        for gram, n in found.items():
            yield (lang, gram), n


def _most_frequent(counts: DataFrame, term: str, most: int) -> dict[str, dict[str, int]]:
    """Counts by language of the most frequent terms, at most `most` of them; terms tied at the limit are left out.

    The least count comes from a histogram of the counts, so that no more than the kept terms reach the driver.
    """
    by_term = counts.groupBy(term).agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by_lang"))
    place = F.least("total", F.lit(HIGHEST)) + F.floor(10_000 * F.log(F.greatest("total", F.lit(HIGHEST)) / HIGHEST)).cast("long")
    places = counts.groupBy(term).agg(F.sum("n").alias("total")).groupBy(place.alias("place")).count().collect()
    least, kept = 1, 0
    for found, terms in sorted(((r["place"], r["count"]) for r in places), reverse=True):
        kept += terms
        if kept > most:
            least = found + 1
            break
    return {row[term]: row["by_lang"] for row in by_term.where(place >= least).select(term, "by_lang").collect()}


class Model:
    """Log frequencies per language of words and n-grams."""

    def __init__(self, langs: list[str], words: dict, totals: dict, grams: dict, gram_totals: dict):
        self.langs = langs
        self.words = {w: self._logs(by, totals, len(words)) for w, by in words.items()}
        self.grams = {g: k for k, g in enumerate(grams)}
        logs = [self._logs(by, gram_totals[len(g)], len(grams)) + STEP_BACK * (LONGEST - len(g)) for g, by in grams.items()]
        self.gram_logs = np.array(logs, np.float32).reshape(len(grams), len(langs))

    def _logs(self, by_lang: dict, totals: dict, kinds: int) -> np.ndarray:
        return np.array([math.log((by_lang.get(lang, 0) + 0.5) / (totals.get(lang, 0) + 0.5 * kinds + 1)) for lang in self.langs], np.float32)

    def word(self, word: str) -> np.ndarray:
        """Score of one lower-cased word per language."""
        known = self.words.get(word)
        if known is not None:
            return known
        bounded, grams, rows = f"^{word}$", self.grams, []
        end = len(bounded)
        for at in range(end - 1):
            for size in range(min(LONGEST, end - at), 0, -1):
                found = grams.get(bounded[at : at + size])
                if found is not None:
                    rows.append(found)
                    break
        return self.gram_logs[rows].sum(axis=0) / max(len(rows), 1)

    def scores(self, words: list[str]) -> np.ndarray:
        """`word` of many lower-cased words, one row each: the n-grams of all unknown ones are summed together."""
        out = np.zeros((len(words), len(self.langs)), np.float32)
        get, rows, sizes, unknown = self.grams.get, [], [], []
        for k, word in enumerate(words):
            known = self.words.get(word)
            if known is not None:
                out[k] = known
                continue
            bounded, before = f"^{word}$", len(rows)
            for at in range(len(bounded) - 1):
                found = get(bounded[at : at + 4])
                if found is None and (found := get(bounded[at : at + 3])) is None and (found := get(bounded[at : at + 2])) is None:
                    found = get(bounded[at])
                if found is not None:
                    rows.append(found)
            if len(rows) > before:
                unknown.append(k)
                sizes.append(len(rows) - before)
        if unknown:
            count = np.array(sizes)
            out[unknown] = _sums(self.gram_logs, np.array(rows), count) / count[:, None].astype(np.float32)
        return out


def _sums(logs: np.ndarray, rows: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sum of the rows of each run, one after the other as for a single run: a run's sum does not depend on its neighbours."""
    starts = np.cumsum(count) - count
    order = np.argsort(-count, kind="stable")
    long = int(np.searchsorted(-count[order], -LONG_RUN))
    out = np.zeros((len(count), logs.shape[1]), logs.dtype)
    for k in order[:long].tolist():
        out[k] = logs[rows[starts[k] : starts[k] + count[k]]].sum(axis=0)
    order = order[long:]
    for step in range(int(count[order].max(initial=0))):
        order = order[: np.searchsorted(-count[order], -step)]  # the runs that have so many rows
        out[order] += logs[rows[starts[order] + step]]
    return out


class Scorer:
    """Scores texts, many together; remembers the scores of a bounded number of words."""

    def __init__(self, model: Model):
        self.model = model
        self.start()

    def start(self) -> None:
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.model.langs) + 1))

    def _add(self, words: list[str]) -> None:
        first, end = len(self.rows), len(self.rows) + len(words)
        if end > len(self.table):
            more = np.zeros((max(end - len(self.table), len(self.table) // 2), self.table.shape[1]))
            self.table = np.concatenate([self.table, more])
        # The last place tells whether the run holds a letter; runs may be made of other numerals only, which score nothing.
        letters = np.array([w.isalpha() or any(map(str.isalpha, w)) for w in words], float)
        self.table[first:end, :-1] = self.model.scores(words) * letters[:, None]
        self.table[first:end, -1] = letters
        self.rows.update(zip(words, range(first, end), strict=True))

    def __call__(self, text: str | None) -> tuple[str, float]:
        langs, scores = self.all([text])
        return langs[0], scores[0]

    def all(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text."""
        langs, scores, start, weight = [], [], 0, 0
        for k, text in enumerate(texts):
            weight += len(text or "")
            if weight >= CHARACTERS or k + 1 == len(texts):
                self._some(texts[start : k + 1], langs, scores)
                start, weight = k + 1, 0
        return langs, scores

    def _some(self, texts: list[str | None], langs: list[str], scores: list[float]) -> None:
        runs = [LETTER_RUNS.findall(text.lower()) if text and self.model.langs else [] for text in texts]
        sizes = np.fromiter(map(len, runs), np.int64, len(runs))
        words = list(chain.from_iterable(runs))
        if len(self.rows) > KEPT:
            self.start()
        at = np.fromiter(map(self.rows.get, words, repeat(-1)), np.int64, len(words))
        if len(missing := np.flatnonzero(at < 0)):
            unseen = [words[k] for k in missing.tolist()]
            self._add(list(dict.fromkeys(unseen)))
            at[missing] = np.fromiter(map(self.rows.__getitem__, unseen), np.int64, len(unseen))
        sums = np.zeros((len(runs), self.table.shape[1]))
        found, ends = self.table.take(at, axis=0), np.cumsum(sizes).tolist()
        for k, (a, b) in enumerate(zip([0, *ends], ends)):
            found[a:b].sum(axis=0, out=sums[k])
        total, n = sums[:, :-1], sums[:, -1]
        if not total.shape[1]:
            langs += [UNDETERMINED] * len(runs)
            scores += [0.0] * len(runs)
            return
        best = total.argmax(axis=1)
        odds = np.exp((total - total[np.arange(len(runs)), best][:, None]) / np.sqrt(np.maximum(n, 1))[:, None])
        langs += [self.model.langs[k] if letters else UNDETERMINED for k, letters in zip(best.tolist(), n.tolist(), strict=True)]
        scores += np.where(n > 0, 1.0 / odds.sum(axis=1), 0.0).tolist()


def learn(df: DataFrame, text: str = "text", lang: str = "lang", max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS) -> Model:
    """Learn from the rows of `df` that have a text and a language."""
    rows = df.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    # Written, so that the passes below survive lost executors and nothing stays in their memory.
    words = cut_lineage(sum_terms(rows, _words, "lang string, word string"))
    totals = {r["lang"]: r["n"] for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    grams = cut_lineage(sum_terms(words.select("lang", "word"), _grams, "lang string, gram string"))
    by_size: dict = defaultdict(dict)
    for r in grams.groupBy(F.length("gram").alias("size"), "lang").agg(F.sum("n").alias("n")).collect():
        by_size[r["size"]][r["lang"]] = r["n"]
    return Model(sorted(totals), _most_frequent(words, "word", max_words), totals, _most_frequent(grams, "gram", max_grams), by_size)


def identify(df: DataFrame, model: Model, text: Column | str = "text") -> Column:
    """struct<lang_pred string, score double> of a text column; a narrow expression."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    made: dict = {}

    @F.arrow_udf("lang_pred string, score double")
    def scored(texts: pa.Array) -> pa.Array:
        scorer = made.get("scorer") or made.setdefault("scorer", Scorer(shared.value))
        found = [scorer.all(texts[start : start + SLICE_ROWS].to_pylist()) for start in range(0, len(texts), SLICE_ROWS)]
        columns = [list(chain.from_iterable(column)) for column in (zip(*found, strict=True) if found else ([], []))]
        return pa.StructArray.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.float64())], ["lang_pred", "score"])

    return scored(text)
