"""Quality rules learned as a decision list, from text statistics and labels; DataFrame and SQL functions only.

Statistics of a text come from one narrow pass of built-in functions. Rules are learned by sequential covering on
labelled statistics: grow a conjunction of threshold conditions by FOIL's information gain on two thirds of the labelled
rows, prune its last conditions where that improves (p - n) / (p + n) on the other third, accept it while its precision
there is high enough, take the rows it covers out, and go on. Thresholds lie on fixed grids, so labelled rows first sum
up to one row per combination of grid cells; each step is one aggregate over that table, and only its (feature, cell)
sums reach the driver. Labelled rows are never sampled.

The result is an ordered list of conditional expressions, `F.when(...).when(...)`: the first rule that holds names the
reason a document is dropped.

Defined results: a NULL or empty text has no words, so it fails the base test (fewer than 50 words). A NULL label, or a
label of an unknown document, teaches nothing; repeated labels count as often as they occur. Without labels of both
classes there are no rules and the base test alone decides. Further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.session import cut_lineage

SPACES = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
SYMBOL_RUN = r"[#*$%&|<>]+"

#: Rules and conditions per rule stop here at the latest; least rows of the dropped class a rule must cover when pruned.
MAX_RULES, MAX_CONDITIONS, LEAST_COVERED = 8, 4, 5
#: A rule must be right this often on the pruning rows.
PRECISION = 0.85

_SHARES = [0.005, 0.01, 0.02, 0.03, 0.05, 0.075, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95]
#: Inputs of the rules: share or ratio of the statistics, and the grid of its thresholds.
FEATURES: dict[str, tuple[Column | str, list[float]]] = {
    "symbol_share": ("n_symbols / greatest(word_chars, 1)", _SHARES),
    "upper_share": ("n_upper / greatest(word_chars, 1)", _SHARES),
    "repeat_share": ("n_repeat_words / greatest(n_words, 1)", _SHARES),
    "duplicate_line_share": ("n_dup_lines / greatest(n_lines, 1)", _SHARES),
    "distinct_share": ("n_distinct_words / greatest(n_words, 1)", _SHARES),
    "mean_word_length": ("word_chars / greatest(n_words, 1)", [2.0, 2.5, 3.0, 3.5, 4.0, 4.5, 5.0, 5.5, 6.0, 7.0, 8.0, 10.0, 12.0, 16.0]),
    "words": ("double(n_words)", [50.0, 75.0, 100.0, 150.0, 200.0, 300.0, 500.0, 1000.0, 2000.0, 5000.0]),
}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(triples: Column) -> Column:
    """Number of words in 3-word windows that occur at least twice, from the keys of all windows in order."""

    def of_sorted(found: Column) -> Column:
        def twice(k: Column) -> Column:
            key = F.get(found, k)["key"]
            return key.eqNullSafe(F.get(found, k - 1)["key"]) | key.eqNullSafe(F.get(found, k + 1)["key"])

        places = F.transform(F.filter(F.sequence(F.lit(0), F.size(found) - 1), twice), lambda k: F.get(found, k)["place"])
        return _let(places, lambda p: F.size(F.array_union(F.array_union(p, F.transform(p, lambda x: x + 1)), F.transform(p, lambda x: x + 2))))

    ordered = F.sort_array(F.transform(triples, lambda key, place: F.struct(key.alias("key"), place.alias("place"))))
    return F.when(F.size(F.array_distinct(triples)) < F.size(triples), _let(ordered, of_sorted)).otherwise(0)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each text in `docs` (doc_id, text); windows are compared by 64-bit keys."""
    text = F.coalesce("text", F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACES))
    words = docs.select("doc_id", text.alias("text"), F.when(F.length(trimmed) > 0, F.split(trimmed, SPACE_RUN)).otherwise(F.array().cast("array<string>")).alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda line: F.length(F.btrim(line, F.lit(SPACES))) > 0)
    keyed = words.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", SYMBOL_RUN, ""))).cast("long").alias("n_symbols"),
        (F.length("text") - F.length(F.regexp_replace("text", "[A-Z]+", ""))).cast("long").alias("n_upper"),
        lines.alias("lines"),
        F.transform("words", lambda word: F.xxhash64(word)).alias("keys"),
    )
    window = F.sequence(F.lit(1), F.size("keys") - 2)
    triples = F.transform(window, lambda k: F.xxhash64(F.element_at("keys", k), F.element_at("keys", k + 1), F.element_at("keys", k + 2)))
    counted = keyed.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_upper",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct("keys")).cast("long").alias("n_distinct_words"),
        F.when(F.size("keys") >= 3, triples).otherwise(F.array().cast("array<bigint>")).alias("triples"),
    )
    return counted.withColumn("n_repeat_words", _covered(F.col("triples")).cast("long")).drop("triples")


def base_failed() -> Column:
    return F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")


@dataclass(frozen=True)
class Condition:
    """`feature` at least, or below, a threshold of its grid."""

    feature: str
    place: int
    at_least: bool

    @property
    def threshold(self) -> float:
        return FEATURES[self.feature][1][self.place - 1]

    def on_cells(self) -> Column:
        cell = F.col(self.feature)
        return cell >= self.place if self.at_least else cell < self.place

    def on_statistics(self) -> Column:
        value = F.expr(FEATURES[self.feature][0])
        return value >= self.threshold if self.at_least else value < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold:g}"


Rule = tuple[Condition, ...]


def _holds(rule: Rule, on: Callable[[Condition], Column]) -> Column:
    return reduce(Column.__and__, [on(c) for c in rule], F.lit(True))


def _gain(bad: int, good: int, bad_before: int, good_before: int) -> float:
    """FOIL's information gain of narrowing (bad_before, good_before) to (bad, good)."""
    if bad == 0:
        return 0.0
    return bad * (math.log2(bad / (bad + good)) - math.log2(bad_before / (bad_before + good_before)))


def _grow(cells: DataFrame) -> Rule:
    """Conditions in the order in which they were added."""
    rule: Rule = ()
    while len(rule) < MAX_CONDITIONS:
        inside = cells.where(_holds(rule, Condition.on_cells))
        pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("cell")) for f in FEATURES]))
        sums = inside.select(pairs.alias("at"), "bad", "good").groupBy("at.feature", "at.cell").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).collect()
        by_feature = {f: {r["cell"]: (r["bad"], r["good"]) for r in sums if r["feature"] == f} for f in FEATURES}
        first = next(iter(by_feature.values()))
        bad, good = (sum(x[k] for x in first.values()) for k in (0, 1))
        if bad == 0 or good == 0:
            break
        best, most = None, 1e-9
        for feature, found in by_feature.items():
            below = [0, 0]
            for place in range(1, len(FEATURES[feature][1]) + 1):
                for k in (0, 1):
                    below[k] += found.get(place - 1, (0, 0))[k]
                for at_least, (b, g) in ((True, (bad - below[0], good - below[1])), (False, tuple(below))):
                    if (gain := _gain(b, g, bad, good)) > most:
                        best, most = Condition(feature, place, at_least), gain
        if best is None:
            break
        rule += (best,)
    return rule


def _prune(rule: Rule, cells: DataFrame) -> tuple[Rule, int, int]:
    """The prefix of `rule` with the best (p - n) / (p + n) on the pruning cells, the shorter at a tie; with its p and n."""
    prefixes = [rule[:k] for k in range(1, len(rule) + 1)]
    sums = [F.sum(F.when(_holds(p, Condition.on_cells), F.col(c)).otherwise(0)) for p in prefixes for c in ("bad", "good")]
    row = [x or 0 for x in cells.agg(*sums).first()]
    worth = [((row[2 * k] - row[2 * k + 1]) / max(row[2 * k] + row[2 * k + 1], 1), -k) for k in range(len(prefixes))]
    k = -max(worth)[1]
    return prefixes[k], row[2 * k], row[2 * k + 1]


def learn(labelled: DataFrame, bad: str = "bad") -> list[Rule]:
    """Ordered rules for the rows of `labelled` (doc_id, statistics, boolean column `bad`)."""
    cells = [reduce(Column.__add__, [(F.expr(e) >= edge).cast("int") for edge in edges]).alias(f) for f, (e, edges) in FEATURES.items()]
    rows = labelled.where(F.col(bad).isNotNull() & ~base_failed()).select(
        *cells, (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("pruning"), F.col(bad).cast("int").alias("bad")
    )
    table = cut_lineage(rows.groupBy("pruning", *FEATURES).agg(F.sum("bad").alias("bad"), F.sum(1 - F.col("bad")).alias("good")))
    rules: list[Rule] = []
    while len(rules) < MAX_RULES:
        left = table.where(~reduce(Column.__or__, [_holds(r, Condition.on_cells) for r in rules], F.lit(False)))
        grown = _grow(left.where("NOT pruning"))
        if not grown:
            break
        rule, hits, misses = _prune(grown, left.where("pruning"))
        if hits < LEAST_COVERED or hits < PRECISION * (hits + misses):
            break
        rules.append(rule)
    return rules


def verdict(rules: list[Rule]) -> Column:
    """Text of the first rule that holds, NULL if none does: the decision list as one conditional expression."""
    listed = F.lit(None).cast("string")
    for rule in reversed(rules):
        listed = F.when(_holds(rule, Condition.on_statistics), F.lit(" and ".join(map(str, rule)))).otherwise(listed)
    return listed


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics, base_failed, rule and kept for every row of `docs`; `labels` has (doc_id, quality 0/1)."""
    measured = cut_lineage(statistics(docs))
    known = labels.where("quality IS NOT NULL").select("doc_id", (F.col("quality") == 0).alias("bad"))
    rules = learn(measured.join(known, "doc_id"))
    rule = F.when(~base_failed(), verdict(rules))
    return measured.withColumns({"base_failed": base_failed(), "rule": rule}).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
