"""Engineered feature columns over imputed customer columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ebbtide.functions.rounding import round_even
from ebbtide.sources.schema import TENURE_GROUPS


def lifetime_value() -> Column:
    return round_even(F.col("tenure") * F.col("monthly_charges"), 2)


def engagement_score(max_logins, max_usage) -> Column:
    """Mean of logins and usage, each as a share of its maximum (fitted or of the frame)."""
    logins = F.col("number_of_logins") / F.lit(max_logins)
    usage = F.col("usage_hours") / F.lit(max_usage)
    return round_even((logins + usage) / F.lit(2.0), 4)


def support_interaction_ratio() -> Column:
    return round_even(F.col("support_calls") / (F.col("tenure") + 1), 4)


def charge_ratio() -> Column:
    return round_even(F.try_divide(F.col("monthly_charges"), F.col("total_charges") + 1), 6)


def tenure_group(tenure: Column | None = None) -> Column:
    """Right-closed bands; a missing or negative tenure is the text ``nan``."""
    tenure = F.col("tenure") if tenure is None else tenure
    new, developing, established, loyal = TENURE_GROUPS
    return (
        F.when(tenure.isNull() | (tenure < 0), "nan")
        .when(tenure <= 12, new)
        .when(tenure <= 36, developing)
        .when(tenure <= 60, established)
        .otherwise(loyal)
    )


def tenure_group_position(group: Column | None = None) -> Column:
    """Ordinal code of the band; anything unknown is 0."""
    group = F.col("tenure_group") if group is None else group
    code = F.when(group == TENURE_GROUPS[1], 1).when(group == TENURE_GROUPS[2], 2).when(group == TENURE_GROUPS[3], 3)
    return code.otherwise(0)


def tenure_bucket() -> Column:
    """Report bands; they end at 72 months and leave the rest without a band."""
    tenure = F.col("tenure")
    return (
        F.when((tenure >= 0) & (tenure <= 12), "0–12 mo")
        .when((tenure > 12) & (tenure <= 36), "13–36 mo")
        .when((tenure > 36) & (tenure <= 60), "37–60 mo")
        .when((tenure > 60) & (tenure <= 72), "61–72 mo")
    )
