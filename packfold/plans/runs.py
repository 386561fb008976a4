"""Token streams in order: written once, then read as runs whose places are known.

Rows are range-partitioned and sorted, turned into tokens (if they are not yet) and written, each
with its piece and the tokens before it in the piece. What the pieces before a piece hold is one
number per piece and group, so a row's place in the whole stream is known wherever it is read,
and what lies next to each other in a file is next to each other in the stream.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packfold.plans.ordinals import BROADCAST_ROWS, PIECE, join_keyed, piece_count, same_as_before, since_change
from packfold.session import materialize

# Rows of a piece, unless the session asks for more pieces.
PIECE_ROWS = 1 << 17

IDS = T.ArrayType(T.IntegerType())


class Stream(NamedTuple):
    """Rows of the groups, ``ids`` and ``start``, the tokens before them in their group."""

    rows: DataFrame
    groups: list[str]


def token_stream(
    df: DataFrame, keys: Sequence[str], groups: Sequence[str], source: str, encode: Callable | None = None, partitions: int | None = None
) -> Stream:
    """The tokens of ``source`` in the order of ``keys`` (unique per group), one stream a group.

    With ``encode``, a function between Arrow arrays, ``source`` is text and becomes tokens on
    its way, after the shuffle, which then moves text. Without it the column is written first:
    range bounds are sampled, and what made the tokens should run once.
    """
    groups, keys = list(groups), [k for k in keys if k not in groups]
    plain = df.select(*groups, *keys, F.col(source).alias("_source"))
    if encode is None:
        plain = materialize(plain, "tokens")
    count = partitions or piece_count(df.sparkSession, plain.count(), PIECE_ROWS)
    ordered = plain.repartitionByRange(count, *groups, *keys).sortWithinPartitions(*groups, *keys)
    kept = [plain.schema[g] for g in groups]
    added = [T.StructField(PIECE, T.IntegerType()), T.StructField("_run", T.LongType()), T.StructField("ids", IDS)]
    written = materialize(ordered.mapInArrow(_numbering(groups, keys, encode), T.StructType([*kept, *added])), "ordered-tokens")

    held = written.groupBy(*groups, PIECE).agg(F.sum(F.size("ids")).cast("long").alias("_held"))
    earlier = Window.partitionBy(*groups).orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)
    before = materialize(
        held.select(*groups, PIECE, F.coalesce(F.sum("_held").over(earlier), F.lit(0)).alias("_before")), "piece-starts"
    )
    # one row a piece and group
    hint = "broadcast" if before.count() <= BROADCAST_ROWS else "merge"
    placed = join_keyed(written, before, [*groups, PIECE], hint=hint)
    return Stream(placed.select(*groups, "ids", (F.col("_run") + F.col("_before")).alias("start")), groups)


def _numbering(groups: list[str], keys: list[str], encode: Callable | None):
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        piece, run, last = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = batch.columns[:-1]
            source = batch.column(batch.num_columns - 1)
            ids = source if encode is None else encode(source)
            ids = pa.ListArray.from_arrays(ids.offsets, ids.values) if ids.null_count == 0 else pa.array([i or [] for i in ids.to_pylist()], ids.type)
            own, others = columns[: len(groups)], columns[len(groups) :]
            same = same_as_before(own, last and last[: len(own)]) if own else np.ones(batch.num_rows, np.bool_)
            if not own and last is None:
                same[0] = False
            if (same & same_as_before(others, last and last[len(own) :]) if others else same).any():
                raise ValueError(f"order keys {keys} are not unique")
            last = [c[batch.num_rows - 1].as_py() for c in columns]
            # tokens before each row, counted from where its group begins in this piece
            at, run = since_change(np.diff(ids.offsets.to_numpy()).astype(np.int64), same, run)
            made = [*columns[: len(groups)], pa.array(np.full(len(at), piece, np.int32)), pa.array(at), ids.cast(pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(made, names=[*groups, "_piece", "_run", "ids"])

    return _untyped(number)


def _untyped(fn):
    """Annotations name Arrow types that only tasks import."""
    fn.__annotations__ = {}
    return fn


def cut_stream(stream: Stream, length: int) -> DataFrame:
    """The groups, ``chunk`` and ``input_ids``: each stream cut every ``length`` tokens, its
    incomplete end dropped.

    Rows that follow each other in a file are cut in place. Only chunks that reach beyond
    what a task reads in one go, two for each such stretch, are put together by a shuffle.
    """
    kept = [stream.rows.schema[g] for g in stream.groups]
    added = [T.StructField(n, T.LongType()) for n in ("chunk", "at")] + [T.StructField("ids", IDS)]
    parts = materialize(stream.rows.mapInArrow(_cutting(stream.groups, length), T.StructType([*kept, *added])), "chunks")
    whole = parts.filter(F.size("ids") == length).select(*stream.groups, "chunk", F.col("ids").alias("input_ids"))
    cut = parts.filter(F.size("ids") < length).groupBy(*stream.groups, "chunk")
    joined = cut.agg(F.flatten(F.sort_array(F.collect_list(F.struct("at", "ids")))["ids"]).alias("input_ids"))
    return whole.union(joined.filter(F.size("input_ids") == length))


def _cutting(groups: list[str], length: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        names = [*groups, "chunk", "at", "ids"]
        kind = pa.list_(pa.int32())

        def part(group, at, tokens, size):
            """Pieces of ``size`` tokens that follow each other from place ``at``."""
            count = len(tokens) // size
            places = at + np.arange(count, dtype=np.int64) * size
            ids = pa.ListArray.from_arrays(pa.array(np.arange(count + 1, dtype=np.int32) * size), pa.array(tokens, pa.int32()))
            owner = [pa.repeat(value, count) for value in group]
            return pa.RecordBatch.from_arrays([*owner, pa.array(places // length), pa.array(places), ids], names=names)

        def chunks(group, at, tokens, ends):
            """What can be cut of a stretch from place ``at``, and the rest of it."""
            head = min(-at % length, len(tokens))
            if head:
                yield part(group, at, tokens[:head], head)
            whole = (len(tokens) - head) // length * length
            if whole:
                yield part(group, at + head, tokens[head : head + whole], length)
            rest = tokens[head + whole :]
            if ends and len(rest):
                yield part(group, at + head + whole, rest, len(rest))

        owner, at, rest = None, 0, np.empty(0, np.int32)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(batch.num_columns - 2).cast(kind)
            start = batch.column(batch.num_columns - 1).to_numpy()
            offsets = ids.offsets.to_numpy()
            tokens = ids.values.to_numpy()
            follows = np.zeros(batch.num_rows, np.bool_)
            follows[1:] = start[1:] == start[:-1] + np.diff(offsets)[:-1]
            own = batch.columns[: len(groups)]
            follows &= same_as_before(own, None) if groups else True
            edges = [*np.flatnonzero(~follows).tolist(), batch.num_rows]
            for low, high in zip(edges[:-1], edges[1:]):
                group = [column[low] for column in own]
                stretch = tokens[offsets[low] : offsets[high]]
                if owner is not None and [g.as_py() for g in group] == [g.as_py() for g in owner] and int(start[low]) == at + len(rest):
                    stretch = np.concatenate([rest, stretch])
                else:
                    if owner is not None:
                        yield from chunks(owner, at, rest, True)
                    owner, at = group, int(start[low])
                yield from chunks(owner, at, stretch, False)
                done = min(-at % length, len(stretch))
                done += (len(stretch) - done) // length * length
                at, rest = at + done, stretch[done:]
        if owner is not None:
            yield from chunks(owner, at, rest, True)

    return _untyped(cut)
