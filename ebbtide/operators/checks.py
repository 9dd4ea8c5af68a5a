"""Row rules: counts, offenders, violation codes, strict and lenient handling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.sources.schema import CATEGORIES, ID, RANGES, REQUIRED, ValueRuleError

# The two rules of the feature step, on rows that have a value.
VALUE_RULES = {
    "negative_tenure": ("tenure", lambda: F.col("tenure") < 0),
    "charges_not_positive": ("monthly_charges", lambda: F.col("monthly_charges") <= 0),
}
OFFENDERS_SHOWN = 10


def value_rule_counts(df: DataFrame) -> DataFrame:
    """Rows that break each rule, in one pass."""
    return df.agg(*[F.count_if(broken()).alias(rule) for rule, (_, broken) in VALUE_RULES.items()])


def value_rule_offenders(df: DataFrame, rule: str, key: str = ID) -> DataFrame:
    """The first offending keys, for an error message."""
    column, broken = VALUE_RULES[rule]
    return df.filter(broken()).select(key, column).orderBy(key).limit(OFFENDERS_SHOWN)


def require_valid_values(df: DataFrame, key: str | None = ID, *more: Column) -> list:
    """Fail with counts and first offenders if any row breaks a value rule; ``key`` None names no offenders.

    ``more`` are aggregates taken in the same pass; their values are returned.
    """
    counted = df.agg(*[F.count_if(broken()).alias(rule) for rule, (_, broken) in VALUE_RULES.items()], *more).first()
    messages = []
    for rule, count in zip(VALUE_RULES, counted, strict=False):
        if count:
            shown = [row[key] for row in value_rule_offenders(df, rule, key).collect()] if key else []
            messages.append(f"{rule}: {count} row(s)" + f", first {key}: {shown}" * bool(key))
    if messages:
        raise ValueRuleError("; ".join(messages))
    return list(counted[len(VALUE_RULES) :])


def violations(malformed: str | None = None) -> Column:
    """Codes of every record rule a row breaks: ``missing:``, ``range:``, ``category:`` or ``malformed:`` + column.

    ``malformed`` names the column that lists cells whose text is not a number.
    """
    faults = [(F.col(name).isNull(), f"missing:{name}") for name in REQUIRED]
    for name, rule in RANGES.items():
        column = F.col(name)
        bad = column < rule.low if rule.low_is_allowed else column <= rule.low
        if rule.high is not None:
            bad = bad | (column > rule.high)
        faults.append((F.coalesce(bad, F.lit(False)), f"range:{name}"))
    for name, allowed in CATEGORIES.items():
        faults.append((F.coalesce(~F.col(name).isin(*allowed), F.lit(False)), f"category:{name}"))
    # Only rows with a fault pay for building the list.
    any_fault = reduce(lambda a, b: a | b, [bad for bad, _ in faults])
    listed = F.array_compact(F.array(*[F.when(bad, F.lit(code)) for bad, code in faults]))
    found = F.when(any_fault, listed).otherwise(F.array().cast("array<string>"))
    if malformed:
        found = F.concat(found, F.transform(F.col(malformed), lambda name: F.concat(F.lit("malformed:"), name)))
    return found


def with_violations(df: DataFrame) -> DataFrame:
    malformed = "malformed_columns" if "malformed_columns" in df.columns else None
    return df.withColumn("violations", violations(malformed))


def split_rejects(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lenient mode: rows that pass, and rows that do not with their codes."""
    checked = with_violations(df)
    good = F.size("violations") == 0
    return checked.filter(good).drop("violations"), checked.filter(~good)


def require_clean(df: DataFrame) -> DataFrame:
    """Strict mode: one bad row fails the whole batch."""
    bad = with_violations(df).agg(F.count_if(F.size("violations") > 0).alias("bad")).first()["bad"]
    if bad:
        raise ValueRuleError(f"{bad} row(s) break record rules; use split_rejects to see them")
    return df


def clean_or_fail(df: DataFrame) -> DataFrame:
    """Strict mode inside one lazy plan: the job itself fails on the first bad row (streams, single pass)."""
    checked = with_violations(df)
    guard = F.assert_true(F.size("violations") == 0, F.concat(F.lit("bad row: "), F.concat_ws(",", "violations")))
    return checked.filter(guard.isNull()).drop("violations")


def shared_keys(left: DataFrame, right: DataFrame, key: str = ID) -> DataFrame:
    """Keys found on both sides (train and test must share none).

    Both sides are reduced to distinct keys first, so copies of one key meet as one row.
    """
    return left.select(key).distinct().join(right.select(key).distinct(), key, "left_semi")
