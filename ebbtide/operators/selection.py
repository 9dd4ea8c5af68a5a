"""Exact order statistics, and the stratified split and folds built on them, without sorting the table.

Three passes over the data, whatever its values: a quantile sketch per group gives a bracket around each wanted rank, one
exact count tells how many rows lie below and at the bracket's ends, and the rows inside (about a hundredth) are written;
the search ends on that copy. Membership in a split or fold is then a comparison of each row's own hash with literals.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.functions.hashing import order_hash
from ebbtide.session import cut_lineage
from ebbtide.sources.schema import ID, LABEL

#: Steps of the sketch's grid, its accuracy, and the number of distinct values that may end a search on the driver.
STEPS = 128
ACCURACY = 10_000
FINISH_VALUES = 20_000


@dataclass(frozen=True)
class Summary:
    """Rows of a group, and its approximate quantiles at 0, 1 / STEPS, ..., 1 between the exact ends."""

    n: int
    grid: list

    def bracket(self, rank: int) -> tuple:
        """Values that are very likely to enclose the one at the 0-based rank."""
        share, slack = rank / max(self.n - 1, 1), 2 / ACCURACY
        low = max(0, math.floor((share - slack) * STEPS))
        return self.grid[low], self.grid[min(STEPS, math.ceil((share + slack) * STEPS))]


def _grouped_values(df: DataFrame, value: Column, group: Column) -> DataFrame:
    return df.select(group.alias("g"), value.alias("v")).filter(F.col("v").isNotNull())


def summaries(rows: DataFrame, most_groups: int | None = None) -> dict:
    """Summary per group ``g`` of the values ``v``, in one pass; groups in order, a NULL group last."""
    shares = F.array(*[F.lit(i / STEPS) for i in range(STEPS + 1)])
    grid = F.percentile_approx("v", shares, ACCURACY).alias("grid")
    found = rows.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), grid)
    found = found.limit(most_groups + 1) if most_groups else found
    ordered = sorted(found.collect(), key=lambda row: (row["g"] is None, row["g"]))
    return {row["g"]: Summary(row["n"], [row["low"], *row["grid"][1:-1], row["high"]]) for row in ordered}


def group_sizes(found: dict) -> dict:
    return {g: summary.n for g, summary in found.items()}


def _counts(rows: DataFrame, spans: list[tuple]) -> list[tuple[int, int, int, int]]:
    """For each (group, low, high): rows below low, at low, strictly between, and at high; one pass."""
    sums = []
    for g, low, high in spans:
        mine, v = F.col("g") == g, F.col("v")
        sums += [F.count_if(mine & (v < low)), F.count_if(mine & (v == low)), F.count_if(mine & (v > low) & (v < high)), F.count_if(mine & (v == high))]
    row = rows.agg(*[c.alias(f"c{i}") for i, c in enumerate(sums)]).first()
    return [tuple(row[4 * i : 4 * i + 4]) for i in range(len(spans))]


def _inside(rows: DataFrame, spans: list[tuple]) -> DataFrame:
    """The rows strictly inside each span, with the span's number as their group; written once."""
    numbers = [F.when((F.col("g") == g) & (F.col("v") > low) & (F.col("v") < high), F.lit(i)) for i, (g, low, high) in enumerate(spans)]
    return cut_lineage(rows.select(F.explode(F.array_compact(F.array(*numbers))).alias("g"), "v"))


def order_statistics(rows: DataFrame, found: dict, ranks: dict) -> dict:
    """Exact values at 0-based ranks.

    ``rows`` has a group ``g`` and a value ``v`` (not NULL, not NaN), ``found`` its summaries; ``ranks`` maps a group to
    the ranks wanted in it, and the result maps (group, rank) to the value. Ranks count every row, copies included.
    """
    answers = {}
    wanted = [(g, rank, *found[g].bracket(rank)) for g, some in ranks.items() for rank in some]
    spans = sorted({(g, low, high) for g, _, low, high in wanted})
    if not spans:
        return {}
    counts = dict(zip(spans, _counts(rows, spans), strict=True))
    left = defaultdict(list)
    for g, rank, low, high in wanted:
        below, at_low, between, at_high = counts[(g, low, high)]
        place = rank - below
        if 0 <= place < at_low:
            answers[(g, rank)] = low
        elif 0 <= place - at_low < between:
            left[(g, low, high)].append((rank, place - at_low, between))
        elif 0 <= place - at_low - between < at_high:
            answers[(g, rank)] = high
        else:  # the sketch was off: the whole group is inside, its ends are exact
            low, high = found[g].grid[0], found[g].grid[-1]
            _, at_low, between, _ = _counts(rows, [(g, low, high)])[0]
            left[(g, low, high)].append((rank, rank - at_low, between))
    if not left:
        return answers
    spans = sorted(left)
    inside = _inside(rows, spans)
    values = inside.groupBy("g", "v").agg(F.count("*").alias("n"))
    small = values.limit(FINISH_VALUES + 1).collect()
    if len(small) <= FINISH_VALUES:
        places = defaultdict(list)
        for row in sorted(small, key=lambda row: (row["g"], row["v"])):
            places[row["g"]].append((row["v"], row["n"]))
        for i, span in enumerate(spans):
            for rank, place, _ in left[span]:
                answers[(span[0], rank)] = _at(places[i], place)
        return answers
    deeper = order_statistics(inside, summaries(inside), {i: sorted({place for _, place, _ in left[span]}) for i, span in enumerate(spans)})
    for i, span in enumerate(spans):
        for rank, place, _ in left[span]:
            answers[(span[0], rank)] = deeper[(i, place)]
    return answers


def _at(values: list[tuple], place: int):
    for value, n in values:
        if place < n:
            return value
        place -= n
    raise ValueError("rank is outside its group")


def exact_medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """Medians of several columns from the same passes, with the mean of the two middle values; NULL and NaN left out."""
    number = [F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in columns]
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("g"), v.alias("v")) for c, v in zip(columns, number, strict=True)]))
    rows = df.select(pairs.alias("pair")).select("pair.*").filter("v IS NOT NULL")
    found = summaries(rows)
    middle = {c: sorted({(n - 1) // 2, n // 2}) for c, n in group_sizes(found).items()}
    exact = order_statistics(rows, found, middle)
    medians = {c: _middle(exact[(c, ranks[0])], exact[(c, ranks[-1])]) for c, ranks in middle.items()}
    return {c: medians.get(c) for c in columns}


def _middle(low: float, high: float) -> float:
    """Mean of two values, also where their sum is out of range."""
    mean = (low + high) / 2
    return low / 2 + high / 2 if math.isinf(mean) and not (math.isinf(low) or math.isinf(high)) else mean


def test_quotas(counts: dict, test_size: float) -> dict:
    """Test rows per class: the total is rounded up, the training part is shared out by largest remainder."""
    total = sum(counts.values())
    n_train = total - math.ceil(total * test_size)
    exact = {c: n_train * n / total for c, n in counts.items()}
    train = {c: int(share) for c, share in exact.items()}
    left = n_train - sum(train.values())
    for c in sorted(counts, key=lambda c: (train[c] - exact[c], c))[:left]:
        train[c] += 1
    return {c: counts[c] - train[c] for c in counts}


def fold_sizes(counts: dict, k: int) -> dict:
    """Rows per class and fold when the classes are dealt out one after the other, like cards."""
    sizes, start = {}, 0
    for c, n in counts.items():
        sizes[c] = [len(range((i - start) % k, n, k)) for i in range(k)]
        start += n
    return sizes


def _cut_points(df: DataFrame, hashed: Column, label: str, plan) -> dict:
    """For each class, the hash value found at each cumulative row count (None: past the last row).

    ``plan`` turns the class counts into the cumulative counts to cut at.
    """
    rows = _grouped_values(df, hashed, F.col(label))
    classes = summaries(rows, most_groups=2)
    if None in classes:
        raise ValueError(f"{label} is NULL in some rows; label them or leave them out")
    if len(classes) > 2:
        raise ValueError(f"{label} must be binary; it has more than two classes")
    counts = group_sizes(classes)
    cuts = plan(counts)
    found = order_statistics(rows, classes, {c: sorted({r for r in cuts[c] if r < counts[c]}) for c in cuts})
    return {c: [found.get((c, r)) for r in cuts[c]] for c in cuts}


def stratified_split(df: DataFrame, test_size: float = 0.2, seed=42, key: str = ID, label: str = LABEL) -> DataFrame:
    """Adds ``split`` (train or test) to rows with a binary, non-NULL label: in each class the rows that come first in hash order are the test rows.

    Quotas are exact for distinct keys. Rows with the same key always land on the same side, so no key is in both.
    """
    hashed = order_hash(F.col(key), seed)
    cuts = _cut_points(df, hashed, label, lambda counts: {c: [n] for c, n in test_quotas(counts, test_size).items()})
    is_test = F.lit(False)
    for c, (cut,) in cuts.items():
        below = F.lit(True) if cut is None else hashed < F.lit(cut)
        is_test = F.when(F.col(label) == c, below).otherwise(is_test)
    return df.withColumn("split", F.when(is_test, "test").otherwise("train"))


def stratified_folds(df: DataFrame, k: int = 5, seed=42, key: str = ID, label: str = LABEL) -> DataFrame:
    """Adds ``fold`` (0 to k-1) to rows with a binary, non-NULL label: consecutive stretches of each class in hash order, sizes equal to within one row."""
    hashed = order_hash(F.col(key), f"fold-{seed}")
    points = _cut_points(
        df,
        hashed,
        label,
        lambda counts: {c: [sum(n[: i + 1]) for i in range(k - 1)] for c, n in fold_sizes(counts, k).items()},
    )
    fold = F.lit(None).cast("int")
    for c, edges in points.items():
        passed = F.lit(0)
        for edge in edges:
            if edge is not None:
                passed = passed + (hashed >= F.lit(edge)).cast("int")
        fold = F.when(F.col(label) == c, passed).otherwise(fold)
    return df.withColumn("fold", fold)


def lowest_hashed(df: DataFrame, quota: int, seed, key: str = ID) -> Column:
    """True for the ``quota`` rows that come first in hash order."""
    if quota <= 0:
        return F.lit(False)
    hashed = order_hash(F.col(key), seed)
    rows = _grouped_values(df, hashed, F.lit(0))
    found = summaries(rows)
    if quota >= sum(group_sizes(found).values()):
        return F.lit(True)
    return hashed < F.lit(order_statistics(rows, found, {0: [quota]})[(0, quota)])


def hashed_sample(df: DataFrame, n: int, seed=42, key: str = ID) -> DataFrame:
    """A repeatable sample of at most ``n`` rows without replacement: a top-n by hash, never a full sort."""
    return df.orderBy(order_hash(F.col(key), seed), key).limit(n)
