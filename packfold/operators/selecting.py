"""Heads, previews, samples, splits and guards."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packfold.functions.hashing import uniform
from packfold.plans.ordinals import join_back, names, ordinals

ROLES = ("user", "assistant", "system")


def require_columns(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"dataset has no column {', '.join(missing)}; found {df.columns}")


def require_new_columns(df: DataFrame, *columns: str) -> None:
    for column in columns:
        if column in df.columns:
            raise ValueError(f"dataset already contains column {column}")


def forbid_columns(df: DataFrame, *columns: str) -> None:
    """Guard of training input, which must not carry raw text."""
    found = [c for c in columns if c in df.columns]
    if found:
        raise ValueError(f"dataset must not contain column {', '.join(found)}")


def warn_missing(df: DataFrame, column: str) -> None:
    if column not in df.columns:
        warnings.warn(f"{column} not found in {df.columns}", stacklevel=2)


def head(df: DataFrame, count: int | None, order_by: str | Sequence[str] | None = None) -> DataFrame:
    """The first ``count`` rows in ``order_by``; all rows when ``count`` is empty or larger.

    A table has no order of its own, so a count needs ``order_by``, which must be unique: a tie
    stops the job, at any count. Heads are cut by row number on the keys alone, so they never
    gather in one task, and only the chosen keys meet the rows.
    """
    if not count:
        return df
    if order_by is None:
        raise ValueError("the first rows need an order: give order_by")
    keys = names(order_by)
    numbered, _, _ = ordinals(df, keys)
    first = numbered.filter(F.col("ordinal") < count).select(*keys)
    return join_back(df, first, keys, count)


def preview(df: DataFrame, order_by: str | Sequence[str], count: int = 5, split: str = "train") -> DataFrame:
    """A few rows to look at; from the ``train`` split when the table has splits."""
    if "split" in df.columns:
        df = df.filter(F.col("split") == split)
    return head(df, count, order_by)


def sample_rows(df: DataFrame, key: Column | str, fraction: float, seed: int = 42) -> DataFrame:
    """Each row with probability ``fraction``; which rows depends on key and seed alone."""
    key = F.col(key) if isinstance(key, str) else key
    return df.filter(uniform(key, seed) <= fraction)


def rename_splits(df: DataFrame, mapping: Mapping[str, str], split: str = "split") -> DataFrame:
    """Keep the splits named in ``mapping`` under their new names."""
    renamed = F.lit(None).cast("string")
    for old, new in mapping.items():
        renamed = F.when(F.col(split) == old, F.lit(new)).otherwise(renamed)
    return df.filter(F.col(split).isin(*mapping)).withColumn(split, renamed)


def unwrap_single_split(df: DataFrame, split: str = "split") -> DataFrame:
    """Drop the split column when the table has one split only."""
    if split not in df.columns:
        return df
    found = df.select(split).distinct().limit(2).collect()
    return df.drop(split) if len(found) <= 1 else df


def roles_checked(role: Column) -> Column:
    """``role`` itself; a role outside the known ones stops the job."""
    message = F.concat(F.lit("role "), F.coalesce(role, F.lit("null")), F.lit(" is not implemented"))
    return F.when(role.isin(*ROLES), role).otherwise(F.raise_error(message))


def split_by_role(df: DataFrame, role: str = "role") -> tuple[DataFrame, DataFrame]:
    """Rows with a known role, and the rejected rest."""
    known = F.coalesce(F.col(role).isin(*ROLES), F.lit(False))
    return df.filter(known), df.filter(~known)
