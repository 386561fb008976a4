"""Small column helpers on token arrays and lengths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IGNORED = -100


def token_count(ids: Column | str) -> Column:
    """Number of tokens; 0 for null."""
    return F.coalesce(F.size(ids), F.lit(0))


def with_prefix(ids: Column | str, token: int) -> Column:
    return F.concat(F.array(F.lit(token)), ids)


def repeated(value: int, times: Column) -> Column:
    return F.array_repeat(F.lit(value), times.cast("int"))


def pad_right(ids: Column | str, length: Column, value: int) -> Column:
    return F.concat(ids, repeated(value, length - F.size(ids)))


def round_up(length: Column, multiple: int) -> Column:
    """Smallest multiple of ``multiple`` that is at least ``length``."""
    return (F.ceil(length / F.lit(multiple)) * multiple).cast("int")


def truncated(ids: Column | str, max_length: int) -> Column:
    return F.slice(ids, 1, max_length)


def as_text(ids: Column | str) -> Column:
    """Comma-separated form of a token array, for exports and comparisons."""
    return F.array_join(ids, ",")
