"""Keeping costly expressions from being copied."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later filters and projections read instead of recomputing.

    A filter on a plain projected column is pushed below the projection together with a copy
    of its expression. One-row ``inline`` ends in a generator, which such rewrites do not cross.
    """
    packed = F.struct(*[expr.alias(name) for name, expr in columns.items()])
    return df.select("*", F.inline(F.array(packed)))
