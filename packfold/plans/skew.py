"""Joining a big, skewed table to a table with one row per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_KEYS = 10_000


def lookup_skewed(
    rows: DataFrame,
    table: DataFrame,
    key: str,
    weight: str,
    scatter: Column,
) -> DataFrame:
    """Left join of ``rows`` with ``table`` (unique ``key``) that no hot key can slow down.

    ``weight`` is the number of ``rows`` that carry the key. A key is hot when it holds at least
    1/HOT_KEYS of the summed weight, so at most HOT_KEYS keys are hot and that part may be
    broadcast whatever the size of the data. Rows with a hot key are answered from the
    broadcast and sent through the shuffle under ``scatter`` instead of their key.
    ``table`` should be materialized: it is read three times.
    """
    total = table.agg(F.sum(weight)).first()[0] or 0
    # below one broadcast batch's worth of rows nothing is hot
    floor = max(total / HOT_KEYS, 1_000)
    values = [c for c in table.columns if c not in (key, weight)]
    hot = table.filter(F.col(weight) >= floor).select(
        F.col(key).alias("_hot_key"), F.struct(*values).alias("_hot")
    )
    cold = table.filter(F.col(weight) < floor).select(
        F.col(key).alias("_cold_key"), F.struct(*values).alias("_cold")
    )
    routed = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left").withColumn(
        "_route", F.when(F.col("_hot_key").isNotNull(), scatter).otherwise(F.col(key))
    )
    found = F.when(F.col("_hot_key").isNotNull(), F.col("_hot")).otherwise(F.col("_cold"))
    return routed.join(cold, F.col("_route") == F.col("_cold_key"), "left").select(
        *rows.columns, *[found[v].alias(v) for v in values]
    )
