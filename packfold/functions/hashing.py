"""Repeatable pseudo-random numbers computed from keys, the same on every run and cluster."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def md5_number(text: Column) -> Column:
    """First 32 bits of the md5 of ``text`` as a non-negative bigint."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on ``seed`` and ``key`` only."""
    return md5_number(F.concat(F.lit(f"{seed}:"), key.cast("string"))) / F.lit(TWO_32)


def shuffle_key(key: Column, seed: int) -> Column:
    """Sort key of a seeded shuffle."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
