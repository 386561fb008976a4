"""Perplexity over a table of training-log records."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packfold.plans.ordinals import previous_value

# Fixed value: log of the perplexity above which nothing is reported.
MIN_LOG_PPL = 3.0


def reported(df: DataFrame, previous: str = "_previous", min_ppl: float = MIN_LOG_PPL) -> DataFrame:
    """Replace the raw ``_ppl`` and its predecessor by ``perplexity`` and ``delta_ppl``, both null
    unless the value is below the limit. The first delta counts from 0."""
    below = F.col("_ppl") < F.lit(math.exp(min_ppl))
    delta = F.coalesce(F.col(previous), F.lit(0.0)) - F.col("_ppl")
    return df.withColumns(
        {"perplexity": F.when(below, F.col("_ppl")), "delta_ppl": F.when(below, delta)}
    ).drop("_ppl", previous)


def perplexity_series(
    df: DataFrame,
    *,
    run: str = "run_id",
    step: str = "step",
    loss: str = "loss",
    min_ppl: float = MIN_LOG_PPL,
    partitions: int | None = None,
) -> DataFrame:
    """``perplexity`` and its drop since the run's previous step; rows without loss are skipped."""
    logged = df.filter(F.col(loss).isNotNull()).select(run, step, loss, F.exp(loss).alias("_ppl"))
    return reported(previous_value(logged, run, step, "_ppl", "_previous", partitions), min_ppl=min_ppl)
