"""Row numbers and prefix sums over a global order, without a single-task window.

Rows are cut into contiguous *pieces* by a range shuffle on the order keys, numbered where they
lie, in one walk along each sorted piece, and shifted by the totals of the pieces before it. A
group that holds most of the rows is cut into as many pieces as its size asks for, so no task
sees a whole group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packfold.session import materialize

PIECE = "_piece"


def names(columns: str | Sequence[str] | None) -> list[str]:
    if columns is None:
        return []
    return [columns] if isinstance(columns, str) else list(columns)


def join_keyed(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", hint: str | None = None
) -> DataFrame:
    """Equi-join that matches null keys too and keeps one copy of the key columns."""
    right = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(right[f"_r_{key}"])
    if hint:
        right = right.hint(hint)
    return left.join(right, condition, how).drop(*[f"_r_{key}" for key in keys])


# Rows of a piece, unless the session's shuffles have more partitions than that asks for.
PIECE_ROWS = 1 << 20
# A narrow side of up to this many rows (tens of MB) may be broadcast to the wide side.
BROADCAST_ROWS = 200_000


class Numbered(NamedTuple):
    """A numbered narrow table, its row count and the totals of its prefix sums, where known."""

    frame: DataFrame
    rows: int | None
    totals: dict[str, int]


def piece_count(spark: SparkSession, rows: int, piece_rows: int | None = None) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // (piece_rows or PIECE_ROWS) + 1)


def cut_into_pieces(narrow: DataFrame, sort_keys: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Add ``_piece``, a number that grows with the order and splits it into balanced ranges.

    The narrow table is written first, so what produced it (a tokenizer, say) runs once although
    range bounds need a sampling pass; it is written again after the range shuffle, because
    sampled bounds could change on recomputation.
    """
    narrow = materialize(narrow, "narrow")
    count = partitions or piece_count(narrow.sparkSession, narrow.count())
    ranged = narrow.repartitionByRange(count, *sort_keys).withColumn(PIECE, F.spark_partition_id())
    return materialize(ranged, "pieces")


def join_back(wide: DataFrame, narrow: DataFrame, keys: Sequence[str], narrow_rows: int | None) -> DataFrame:
    """Join a table with what was computed from its keys.

    A narrow side of known small size is broadcast. Beyond that both sides are shuffled and
    merged; the hint keeps a badly estimated wide side from being broadcast instead.
    """
    small = narrow_rows is not None and narrow_rows <= BROADCAST_ROWS
    return join_keyed(wide, narrow, keys, hint="broadcast" if small else "merge")


def ordinals(
    df: DataFrame,
    order_by: str | Sequence[str],
    *,
    group: str | Sequence[str] | None = None,
    carry: Mapping[str, Column] | None = None,
    sums: Mapping[str, Column] | None = None,
    piece: Column | None = None,
    partitions: int | None = None,
    name: str = "ordinal",
) -> Numbered:
    """Narrow frame of ``group``, ``order_by`` and ``carry`` columns plus the row number.

    Numbers start at 0 in each group. Every entry of ``sums`` becomes the sum of that
    expression over all earlier rows of the group. ``order_by`` must be unique per group;
    a tie stops the job, since the order would be arbitrary. A caller whose order is a plain
    sequence passes ``piece``, an expression that grows with it; that saves the writes and the
    range shuffle.
    """
    keys, groups = names(order_by), names(group)
    carry, sums = dict(carry or {}), dict(sums or {})
    narrow = df.select(
        *groups,
        *[k for k in keys if k not in groups],
        *[expr.alias(col) for col, expr in carry.items()],
        *[F.coalesce(expr.cast("long"), F.lit(0)).alias(f"_add_{col}") for col, expr in sums.items()],
    )
    if piece is not None:
        cut, rows, totals = narrow.withColumn(PIECE, piece), None, {}
        numbered = _numbered_by_window(cut, groups, keys, list(sums))
    else:
        narrow = materialize(narrow, "narrow")
        rows, totals = _totals(narrow, list(sums))
        cut = numbered = _numbered_in_place(narrow, groups, keys, list(sums), partitions or piece_count(df.sparkSession, rows))
    # without groups there is one row a piece
    hint = None if groups or piece is not None else "broadcast"
    placed = join_keyed(numbered, _piece_offsets(cut, groups, list(sums)), groups + [PIECE], hint=hint)
    kept = [c for c in narrow.columns if not c.startswith("_add_")]
    result = placed.select(
        *kept,
        (F.col("_at") + F.col("_before_rows")).alias(name),
        *[(F.col(f"_run_{c}") + F.col(f"_before_{c}")).alias(c) for c in sums],
    )
    return Numbered(result, rows, totals)


def _numbered_by_window(cut: DataFrame, groups: list[str], keys: list[str], sums: list[str]) -> DataFrame:
    inside = Window.partitionBy(*groups, PIECE).orderBy(*keys)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    tie = F.lag(F.struct(*keys)).over(inside) == F.struct(*keys)
    return cut.select(
        *[c for c in cut.columns if not c.startswith("_add_")],
        F.when(tie, F.raise_error(f"order keys {keys} are not unique").cast("long"))
        .otherwise(F.row_number().over(inside).cast("long") - 1)
        .alias("_at"),
        *[F.coalesce(F.sum(f"_add_{c}").over(earlier), F.lit(0)).alias(f"_run_{c}") for c in sums],
    )


def _numbered_in_place(narrow: DataFrame, groups: list[str], keys: list[str], sums: list[str], count: int) -> DataFrame:
    """``narrow`` plus its piece, the number of each row in piece and group, and running sums.

    One exchange puts rows in order; they are numbered along the sorted batches of a partition."""
    order = [*groups, *[k for k in keys if k not in groups]]
    ordered = narrow.repartitionByRange(count, *order).sortWithinPartitions(*order)
    added = [(PIECE, T.IntegerType()), ("_at", T.LongType()), *[(f"_run_{c}", T.LongType()) for c in sums]]
    schema = T.StructType([*narrow.schema.fields, *[T.StructField(n, t) for n, t in added]])
    return materialize(ordered.mapInArrow(_numbering(groups, keys, sums), schema), "pieces")


def same_as_before(columns: list, last: list | None):
    """Whether each row of some Arrow arrays has the values of the row before it (null being a
    value); ``last`` are the values before the first row, None if there is none."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    count = len(columns[0]) if columns else 0
    same = np.ones(count, np.bool_)
    for column, value in zip(columns, last or [None] * len(columns)):
        if pa.types.is_nested(column.type):
            values = [value, *column.to_pylist()]
            same &= np.array([a == b for a, b in zip(values, values[1:])], np.bool_)
            continue
        shifted = pa.concat_arrays([pa.array([value], column.type), column.slice(0, count - 1)])
        equal = pc.fill_null(pc.equal(column, shifted), False)
        same &= pc.or_(equal, pc.and_(pc.is_null(column), pc.is_null(shifted))).to_numpy(zero_copy_only=False)
    if last is None and count:
        same[0] = False
    return same


def since_change(values, same, carried: int):
    """Running sums before each row, begun anew where ``same`` is false, and what they have come to
    after the last; ``carried`` is that of the rows before."""
    import numpy as np

    after = np.cumsum(values)
    before = after - values + carried
    begins = np.flatnonzero(~same)
    base = np.concatenate([[0], before[begins]])[np.cumsum(~same)]
    return before - base, int(after[-1] + carried - base[-1])


def _numbering(groups: list[str], keys: list[str], sums: list[str]):
    def number(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        piece, last, runs = TaskContext.get().partitionId(), None, [0] * (1 + len(sums))
        for batch in batches:
            if not batch.num_rows:
                continue
            own = [batch.column(g) for g in groups]
            others = [batch.column(k) for k in keys if k not in groups]
            same = same_as_before(own, last and last[: len(own)]) if own else np.ones(batch.num_rows, np.bool_)
            if not own and last is None:
                same[0] = False
            if (same & same_as_before(others, last and last[len(own) :]) if others else same).any():
                raise ValueError(f"order keys {keys} are not unique")
            last = [c[batch.num_rows - 1].as_py() for c in [*own, *others]]
            added = [np.ones(batch.num_rows, np.int64), *[batch.column(f"_add_{c}").to_numpy() for c in sums]]
            made = []
            for i, values in enumerate(added):
                before, runs[i] = since_change(values, same, runs[i])
                made.append(pa.array(before, pa.int64()))
            pieces = pa.array(np.full(batch.num_rows, piece, np.int32))
            names = [*batch.schema.names, "_piece", "_at", *[f"_run_{c}" for c in sums]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pieces, *made], names=names)

    return number


def _totals(narrow: DataFrame, sums: list[str]) -> tuple[int, dict[str, int]]:
    row = narrow.agg(F.count(F.lit(1)).alias("_rows"), *[F.sum(f"_add_{c}").alias(c) for c in sums]).first()
    return row["_rows"], {c: row[c] or 0 for c in sums}


def _piece_offsets(cut: DataFrame, groups: list[str], sums: list[str]) -> DataFrame:
    """Per piece, the totals of the pieces before it: one row per piece and group."""
    totals = cut.groupBy(*groups, PIECE).agg(
        F.count(F.lit(1)).alias("_rows"), *[F.sum(f"_add_{c}").alias(f"_total_{c}") for c in sums]
    )
    before = Window.partitionBy(*groups).orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        *groups,
        PIECE,
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before_rows"),
        *[F.coalesce(F.sum(f"_total_{c}").over(before), F.lit(0)).alias(f"_before_{c}") for c in sums],
    )


def with_ordinal(
    df: DataFrame,
    order_by: str | Sequence[str],
    *,
    group: str | Sequence[str] | None = None,
    name: str = "ordinal",
    **options,
) -> DataFrame:
    """``df`` plus its row number. Wide rows are shuffled once, by the join on the order keys;
    the range shuffle and its written copy carry the keys only."""
    keys = list(dict.fromkeys(names(group) + names(order_by)))
    numbers, rows, _ = ordinals(df, order_by, group=group, name=name, **options)
    if set(df.columns) == set(keys):
        return numbers
    return join_back(df, numbers, keys, rows)


def previous_value(
    df: DataFrame,
    group: str,
    order_by: str,
    value: str,
    name: str,
    partitions: int | None = None,
) -> DataFrame:
    """``lag(value)`` per group, exact also when one group holds most rows.

    Inside a piece it is an ordinary ``lag``; the first row of a piece takes the last value
    of the group's piece before it. Two rows of a group with equal ``order_by`` have no order;
    they stop the job.
    """
    cut = cut_into_pieces(df, [group, order_by], partitions)
    inside = Window.partitionBy(group, PIECE).orderBy(order_by)
    tie = F.raise_error(f"values of {order_by} are not unique in a {group}").cast(df.schema[value].dataType)
    before = F.when(F.lag(order_by).over(inside) == F.col(order_by), tie).otherwise(F.lag(value).over(inside))
    last = cut.groupBy(group, PIECE).agg(F.max_by(value, order_by).alias("_last"))
    carried = last.select(
        group, PIECE, F.lag("_last").over(Window.partitionBy(group).orderBy(PIECE)).alias("_carried")
    )
    lagged = cut.select(
        "*", before.alias("_lag"), F.row_number().over(inside).alias("_at")
    )
    return join_keyed(lagged, carried, [group, PIECE]).select(
        *df.columns, F.when(F.col("_at") == 1, F.col("_carried")).otherwise(F.col("_lag")).alias(name)
    )
