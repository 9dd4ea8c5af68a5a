"""Reproducible draws: md5 of a key and a seed gives the same number in every run, engine and partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _digits(key: Column, seed, length: int) -> Column:
    digest = F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, length), 16, 10).cast("bigint")


def unit_hash(key: Column, seed) -> Column:
    """A number in [0, 1) with 32 random bits."""
    return _digits(key, seed, 8) / F.lit(4294967296.0)


def order_hash(key: Column, seed) -> Column:
    """A 60-bit whole number that puts the keys in a random but repeatable order."""
    return _digits(key, seed, 15)
