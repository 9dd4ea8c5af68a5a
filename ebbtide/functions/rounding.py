"""The two rounding rules of the data contract, and fixed-point text.

Feature columns scale, round half to even and unscale. Scores and money round the exact binary value half to even;
``format_number`` is the built-in that does so, hence the detour through text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_even(value: Column, digits: int) -> Column:
    scale = F.lit(float(10**digits))
    return F.rint(value * scale) / scale


def fixed_text(value: Column, digits: int) -> Column:
    return F.replace(F.format_number(value, digits), F.lit(","), F.lit(""))


def round_exact(value: Column, digits: int) -> Column:
    return fixed_text(value, digits).cast("double")
