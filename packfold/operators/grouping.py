"""Groups, hash buckets and counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packfold.functions.hashing import md5_number
from packfold.plans.ordinals import join_keyed, names, ordinals
from packfold.plans.skew import lookup_skewed
from packfold.session import fresh_path, materialize

NULL_GROUP = "__NULL__"


def group_key(df: DataFrame, key: str, drop_null: bool = False) -> DataFrame:
    """``df`` with ``group_id``: the key as text, null keys in a group of their own."""
    if drop_null:
        df = df.filter(F.col(key).isNotNull())
    return df.withColumn("group_id", F.coalesce(F.col(key).cast("string"), F.lit(NULL_GROUP)))


def distinct_keys(df: DataFrame, key: str) -> DataFrame:
    return df.select(key).distinct()


def group_summary(df: DataFrame, key: str, order_by: str, drop_null: bool = False) -> DataFrame:
    """Rows per group and the first row of each group, which gives the order of first appearance."""
    grouped = group_key(df, key, drop_null).groupBy("group_id")
    return grouped.agg(F.count(F.lit(1)).alias("rows"), F.min(order_by).alias("first_row"))


def groups(df: DataFrame, key: str, values: Sequence) -> dict:
    """A lazy view per key value. To split a whole table use ``save_groups``, which reads it once."""
    return {value: df.filter(F.col(key) == F.lit(value)) for value in values}


class Groups:
    """The tables of a split table, one a key, in the order in which keys first appear.

    ``index`` has group_id, rows, first_row and group_no; ``rows`` is the whole table with group_id
    and group_no. A table of one key is read from its own folder.
    """

    def __init__(self, index: DataFrame, rows: DataFrame):
        self.index, self.rows = index, rows

    def keys(self) -> list[str]:
        """Keys in order of first appearance. They are names of tables, which a caller goes
        through one by one, so the driver needs them."""
        return [row.group_id for row in self.index.orderBy("group_no").select("group_id").collect()]

    def table(self, number: int) -> DataFrame:
        """Rows of the key that appears as number ``number``."""
        return self.rows.filter(F.col("group_no") == number).drop("group_id", "group_no")

    def __getitem__(self, key: str) -> DataFrame:
        found = self.index.filter(F.col("group_id") == key).select("group_no").first()
        if found is None:
            raise KeyError(key)
        return self.table(found.group_no)


def group_by(df: DataFrame, key: str, order_by: str, *, path: str | None = None, drop_null: bool = False) -> Groups:
    """Split a table by key without being told the keys; null keys form a group of their own.

    ``order_by`` is unique and gives the order of rows. One pass finds each key's first row; keys
    are numbered by it, and rows are written into one folder a number, which reading prunes.
    """
    keyed = group_key(df, key, drop_null)
    summary = group_summary(df, key, order_by, drop_null)
    numbered = ordinals(summary, "first_row", carry={c: F.col(c) for c in ("group_id", "rows")}, name="group_no").frame
    index = materialize(numbered.select("group_id", "rows", "first_row", "group_no"), "group-index")
    scatter = F.concat(F.lit("\0"), F.xxhash64(order_by).cast("string"))
    placed = lookup_skewed(keyed, index.drop("first_row"), "group_id", "rows", scatter)
    schema = placed.schema
    # folders hold about as many rows each as adaptive execution sees fit
    target = path or fresh_path(df.sparkSession, "groups")
    placed.hint("rebalance", F.col("group_no")).write.partitionBy("group_no").parquet(target)
    return Groups(index, df.sparkSession.read.schema(schema).parquet(target).select(*df.columns, "group_id", "group_no"))


def bucket_of(key: Column, data_type: str, count: int) -> Column:
    """Bucket number as text: the value itself modulo ``count`` for integers, a hash otherwise."""
    number = key.cast("long") if data_type in ("tinyint", "smallint", "int", "bigint") else md5_number(key.cast("string"))
    return F.pmod(number, F.lit(count)).cast("string")


def bucket_by(df: DataFrame, key: str, count: int, name: str = "bucket_id") -> DataFrame:
    """Add the bucket of every row; stable across runs and machines."""
    kind = df.schema[key].dataType.simpleString()
    return df.withColumn(name, bucket_of(F.col(key), kind, count))


def row_counts(df: DataFrame, split: str | Sequence[str]) -> DataFrame:
    return df.groupBy(*names(split)).agg(F.count(F.lit(1)).alias("rows"))


def longest_in(
    df: DataFrame, batch: str | Sequence[str], ids: str = "input_ids", name: str = "longest", length: str | None = None
) -> DataFrame:
    """Length of the longest row of each batch, on every row. Lengths alone are compared; where
    batches are few, the token arrays do not move at all. A table without token arrays tells the
    column of their ``length``."""
    keys = names(batch)
    longest = df.groupBy(*keys).agg(F.max(F.col(length) if length else F.size(ids)).alias(name))
    return join_keyed(df, longest, keys)
