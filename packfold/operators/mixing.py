"""Concatenating, interleaving, sharding, repeating and shuffling tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packfold.functions.hashing import shuffle_key, uniform
from packfold.functions.tokenizers import Tokenizer
from packfold.operators.packing import pack_aligned, pack_fixed
from packfold.plans.ordinals import join_back, names, ordinals

SOURCE = "_source"
# Draws numbered by one task.
DRAWS_PER_PIECE = 1 << 20


def concatenate(tables: Sequence[DataFrame], source: str = "src_ord") -> DataFrame:
    """All rows of all tables; ``source`` numbers the table, so (source, own order) is the order."""
    if not tables:
        raise ValueError("no tables to concatenate")
    numbered = [t.withColumn(source, F.lit(i)) for i, t in enumerate(tables)]
    return reduce(DataFrame.unionByName, numbered)


def draws(spark, total: int, probabilities: Sequence[float], seed: int) -> DataFrame:
    """``draw`` 0..total-1 and the source each one picks, from seeded hashes."""
    pick: Column = F.lit(len(probabilities) - 1)
    for i in reversed(range(len(probabilities) - 1)):
        pick = F.when(F.col("u") < F.lit(sum(probabilities[: i + 1])), F.lit(i)).otherwise(pick)
    numbered = spark.range(total).withColumnRenamed("id", "draw")
    return numbered.withColumn("u", uniform(F.col("draw"), seed)).select("draw", pick.alias(SOURCE))


def interleave(
    tables: Sequence[DataFrame],
    probabilities: Sequence[float],
    order_by: str | Sequence[str],
    *,
    seed: int = 42,
    name: str = "draw",
) -> DataFrame:
    """Rows of several tables in a random weighted order, each table in its own order.

    Every place of the result picks a table by a seeded draw; the result ends when a draw asks
    for a row its table no longer has. Draws and rows meet as narrow tables on
    (source, row number); the rows themselves are joined once, on their keys.
    """
    if len(tables) != len(probabilities):
        raise ValueError("one probability per table is needed")
    if abs(sum(probabilities) - 1.0) > 1e-9:
        raise ValueError("probabilities must add up to 1")
    keys = names(order_by)
    rows = concatenate(tables, SOURCE)
    numbered, total, _ = ordinals(rows, keys, group=SOURCE)
    sizes = dict.fromkeys(range(len(tables)), 0)
    # one row per source table
    sizes.update({r[SOURCE]: r["rows"] for r in numbered.groupBy(SOURCE).agg(F.count("*").alias("rows")).collect()})

    size_of = F.element_at(F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair]), F.col(SOURCE))
    picks, _, _ = ordinals(
        draws(rows.sparkSession, total, probabilities, seed),
        "draw",
        group=SOURCE,
        piece=F.floor(F.col("draw") / DRAWS_PER_PIECE),
    )
    stop = picks.filter(F.col("ordinal") >= size_of).agg(F.min("draw")).first()[0]
    if stop is not None:
        picks = picks.filter(F.col("draw") < stop)
    placed = numbered.join(picks.withColumnRenamed("draw", name), [SOURCE, "ordinal"]).drop("ordinal")
    return join_back(rows, placed, [SOURCE, *keys], total).drop(SOURCE)


def assign_shards(
    df: DataFrame, order_by: str | Sequence[str], shards: int, name: str = "shard_id"
) -> DataFrame:
    """Contiguous shards whose sizes differ by at most one, longer shards first."""
    keys = names(order_by)
    numbered, total, _ = ordinals(df, keys)
    size, longer = divmod(total, shards)
    edge = longer * (size + 1)
    row = F.col("ordinal")
    shard = F.when(row < edge, F.floor(row / (size + 1))).otherwise(longer + F.floor((row - edge) / max(size, 1)))
    return join_back(df, numbered.select(*keys, shard.cast("long").alias(name)), keys, total)


def repeat_epochs(df: DataFrame, epochs: int, name: str = "epoch") -> DataFrame:
    """The table ``epochs`` times over; (epoch, own order) is the order."""
    if epochs < 1:
        raise ValueError(f"epochs must be at least 1, found {epochs}")
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))


def training_mix(
    first: DataFrame,
    second: DataFrame,
    order_by: str,
    *,
    probabilities: Sequence[float] = (0.8, 0.2),
    seed: int = 42,
    split: str = "split",
) -> DataFrame:
    """``train`` interleaves the train rows of both tables; the other splits come from ``first``.

    ``draw`` orders the train rows and is null elsewhere.
    """
    train = [t.filter(F.col(split) == "train") for t in (first, second)]
    mixed = interleave(train, probabilities, order_by, seed=seed)
    held_out = first.filter(F.col(split).isin("validation", "test"))
    return mixed.unionByName(held_out, allowMissingColumns=True)


def tokenize_shuffle_pack(
    df: DataFrame,
    tokenizer: Tokenizer,
    key: str,
    *,
    column: str = "text",
    seq_length: int = 2048,
    seed: int = 42,
) -> DataFrame:
    """Tokenize, put all rows in a seeded global order, cut into rows of ``seq_length`` tokens."""
    mixed = df.select(key, column, shuffle_key(F.col(key), seed).alias("_mix"))
    return pack_fixed(mixed, ["_mix", key], seq_length=seq_length, ids=column, encode=tokenizer.array_encoder())


def pack_splits(
    data: DataFrame | Mapping[str, DataFrame],
    order_by: str,
    tokenizer: Tokenizer,
    *,
    seq_length: int | None = None,
    split: str = "split",
    **options,
) -> DataFrame:
    """Pack every split on its own, or leave the rows as they are without ``seq_length``."""
    if isinstance(data, Mapping):
        data = reduce(DataFrame.unionByName, [df.withColumn(split, F.lit(k)) for k, df in data.items()])
    if seq_length is None:
        return data
    return pack_aligned(
        data, order_by, bos=tokenizer.bos_id, eos=tokenizer.eos_id, seq_length=seq_length, group=split, **options
    )
