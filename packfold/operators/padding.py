"""Batches of consecutive rows padded to one length."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packfold.functions.arrays import IGNORED, pad_right, repeated, round_up, token_count
from packfold.plans.ordinals import join_back, names, ordinals
from packfold.session import materialize


def assign_batches(
    df: DataFrame, order_by: str | Sequence[str], batch_size: int, *, ids: str | None = None, name: str = "batch_id"
) -> DataFrame:
    """Batch number of every row; with ``ids`` also size and longest row of its batch.

    All of it is computed from row lengths and joined to the rows once.
    """
    keys = names(order_by)
    numbered, rows = _batches(df, keys, batch_size, ids, name)
    return join_back(df, numbered, keys, rows)


def _batches(df, keys, batch_size, ids, name):
    carry = {"_len": token_count(ids)} if ids else {}
    numbered, rows, _ = ordinals(df, keys, carry=carry)
    numbered = numbered.withColumn(name, F.floor(F.col("ordinal") / batch_size).cast("long")).drop("ordinal")
    if ids:
        batch = Window.partitionBy(name)
        numbered = numbered.select(
            *keys, name, F.max("_len").over(batch).alias("_longest"), F.count("*").over(batch).alias("_batch_rows")
        )
    return numbered, rows


def pad_with_labels(
    df: DataFrame,
    order_by: str | Sequence[str],
    pad_id: int,
    *,
    batch_size: int = 8,
    multiple: int | None = 64,
    ids: str = "input_ids",
    label: str = "label",
    drop_last: bool = False,
) -> DataFrame:
    """Right-pad ids with ``pad_id`` and labels with the ignored label, to the longest row of the
    batch rounded up to ``multiple``; add ``attention_mask``."""
    keys = names(order_by)
    # what made the rows (a tokenizer, a template) runs once
    df = materialize(df, "unpadded")
    numbered, rows = _batches(df, keys, batch_size, ids, "batch_id")
    if drop_last:
        numbered = numbered.filter(F.col("_batch_rows") == batch_size)
    length = round_up(F.col("_longest"), multiple) if multiple else F.col("_longest")
    others = [c for c in df.columns if c not in (ids, label)]
    return join_back(df, numbered.withColumn("_to", length), keys, rows).select(
        *others,
        "batch_id",
        pad_right(ids, F.col("_to"), pad_id).alias("input_ids"),
        pad_right(repeated(1, F.size(ids)), F.col("_to"), 0).alias("attention_mask"),
        pad_right(label, F.col("_to"), IGNORED).alias("labels"),
    )


def pad_for_lm(
    df: DataFrame,
    order_by: str | Sequence[str],
    pad_id: int,
    *,
    batch_size: int = 8,
    multiple: int = 16,
    ids: str = "input_ids",
    drop_last: bool = True,
) -> DataFrame:
    """Padding for plain language modelling: labels are the ids, ignored wherever they are the
    padding id; a short last batch is dropped."""
    # the ids are their own labels, so one array moves
    padded = pad_with_labels(df, order_by, pad_id, batch_size=batch_size, multiple=multiple, ids=ids, label=ids, drop_last=drop_last)
    masked = F.transform("labels", lambda x: F.when(x == pad_id, F.lit(IGNORED)).otherwise(x))
    return padded.withColumn("labels", F.when(F.array_contains("labels", pad_id), masked).otherwise(F.col("labels")))
