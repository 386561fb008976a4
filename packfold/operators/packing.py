"""Cutting token arrays into training rows of one length.

Cutting at fixed places needs one shuffle, which puts rows in order. Aligned packing moves tokens
twice: once to meet their cut plan, once to meet the other parts of their chunk; everything
sequential there happens on row lengths only, in tasks of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packfold.functions.hashing import shuffle_key
from packfold.operators.buffers import number_buffers
from packfold.plans.ordinals import join_back, names, ordinals
from packfold.plans.runs import cut_stream, token_stream
from packfold.session import materialize

# Rows and chunks one task looks at while it numbers buffers.
SHARD_CHUNKS = 1 << 20
# Buffers one task cuts.
BUFFERS_PER_TASK = 64


def _buffered(
    df: DataFrame,
    order_by: list[str],
    group: list[str],
    ids: str,
    seq_length: int,
    num_sequences: int,
    bos: int | None = None,
    shuffle_seed: int | None = None,
    shard_chunks: int = SHARD_CHUNKS,
) -> tuple[DataFrame, int]:
    """Narrow table of row order, length, buffer, shuffle key and the places of ``bos``; and a
    bound on the number of cuts.

    A shard ends once its rows, each counted as at least one chunk, fill ``shard_chunks``
    chunks. That bounds its rows as well as its chunks, for short and for long rows.
    """
    size = F.coalesce(F.size(ids), F.lit(0))
    carry = {"_len": size}
    if bos is not None:
        places = F.filter(F.transform(ids, lambda x, i: F.when(x == bos, i)), lambda i: i.isNotNull())
        none = F.array().cast("array<int>")
        carry["_bos_at"] = F.when(F.array_contains(ids, bos), places).otherwise(none)
    if shuffle_seed is not None:
        carry["_mix"] = shuffle_key(F.concat_ws("/", *[F.col(k) for k in order_by]), shuffle_seed)
    sums = {"_weight": F.greatest(size, F.lit(seq_length))}
    numbered, rows, totals = ordinals(df, order_by, group=group, carry=carry, sums=sums)
    shard_weight = seq_length * shard_chunks
    shard = F.floor(F.col("_weight") / shard_weight).cast("long")
    lengths = numbered.withColumn("shard", shard).drop("_weight")
    shards = totals["_weight"] // shard_weight + 1
    # a row has at most one cut more than the chunks it could fill
    cuts = rows + totals["_weight"] // max(seq_length - 1, 1)
    return number_buffers(lengths, group, seq_length * num_sequences, shards), cuts


def assign_buffers(
    df: DataFrame,
    order_by: str | Sequence[str],
    *,
    seq_length: int = 2048,
    num_sequences: int = 1024,
    group: str | Sequence[str] | None = None,
    ids: str = "input_ids",
    **options,
) -> DataFrame:
    """Order keys of every row with its ``buffer`` and ``token_count``."""
    keys, groups = names(order_by), names(group)
    buffered, _ = _buffered(df, keys, groups, ids, seq_length, num_sequences, **options)
    return buffered.select(*dict.fromkeys(groups + keys), "buffer", F.col("_len").alias("token_count"))


def pack_aligned(
    df: DataFrame,
    order_by: str | Sequence[str],
    *,
    bos: int,
    eos: int,
    seq_length: int = 2048,
    num_sequences: int = 1024,
    group: str | Sequence[str] | None = None,
    ids: str = "input_ids",
    shuffle_seed: int | None = None,
    **options,
) -> DataFrame:
    """Rows of exactly ``seq_length`` tokens, each starting with ``bos``.

    Rows are taken in order into buffers of ``seq_length * num_sequences`` tokens. A buffer is
    the concatenation of its rows, each followed by ``eos, bos``, cut from left to right; a cut
    that does not fall on ``bos`` gets one inserted. What is left at the end of a buffer is
    dropped. ``shuffle_seed`` shuffles the rows of a buffer before and its chunks after the cut.
    The cuts are planned from lengths alone, for BUFFERS_PER_TASK neighbouring buffers at a time.
    """
    if seq_length < 2:
        raise ValueError("seq_length must be at least 2")
    keys, groups = names(order_by), names(group)
    # what made the tokens runs once; lengths and tokens are both read from here
    df = materialize(df.select(*dict.fromkeys(groups + keys), ids), "tokens")
    buffered, most_cuts = _buffered(
        df, keys, groups, ids, seq_length, num_sequences, bos=bos, shuffle_seed=shuffle_seed, **options
    )
    row_keys = list(dict.fromkeys(groups + keys))
    cut = T.StructType(
        [T.StructField(n, T.LongType()) for n in ("buffer", "chunk", "position")]
        + [T.StructField(n, T.IntegerType()) for n in ("lo", "hi", "at")]
    )
    schema = T.StructType([buffered.schema[k] for k in row_keys] + [T.StructField("_cuts", T.ArrayType(cut))])
    plan = _aligned_plan(seq_length, row_keys, shuffle_seed)
    task = F.floor(F.col("buffer") / BUFFERS_PER_TASK).alias("_task")
    cuts = buffered.groupBy(*groups, task).applyInArrow(plan, schema)

    # tokens are moved in two bytes each where they all fit
    least, most = df.agg(F.min(F.array_min(ids)), F.max(F.array_max(ids))).first()
    short = min(least or 0, bos, eos) >= -(1 << 15) and max(most or 0, bos, eos) < 1 << 15
    kind = "array<smallint>" if short else "array<int>"
    stream = df.select(
        *row_keys,
        F.concat(F.coalesce(F.col(ids), F.array().cast("array<int>")), F.array(F.lit(eos), F.lit(bos))).cast(kind).alias("_stream"),
    )
    pieces = join_back(stream, cuts, row_keys, most_cuts).select(
        *groups, F.explode("_cuts").alias("_cut"), "_stream"
    )
    part = F.struct(
        F.col("_cut.at").alias("at"),
        F.slice("_stream", F.col("_cut.lo") + 1, F.col("_cut.hi") - F.col("_cut.lo")).alias("ids"),
    )
    chunk_key = [*groups, "buffer", "chunk"]
    shuffled = [] if shuffle_seed is None else ["position"]
    packed = (
        pieces.select(*groups, "_cut.buffer", "_cut.chunk", *[f"_cut.{c}" for c in shuffled], part.alias("_part"))
        .groupBy(*chunk_key, *shuffled)
        .agg(F.sort_array(F.collect_list("_part")).alias("_parts"))
    )
    whole = F.flatten(F.col("_parts.ids")).cast("array<int>")
    inserted = F.col("_parts")[0]["at"] == 1
    packed = packed.select(
        *chunk_key, *shuffled, F.when(inserted, F.concat(F.array(F.lit(bos)), whole)).otherwise(whole).alias("input_ids")
    )
    return packed.withColumn("labels", F.col("input_ids"))


def _aligned_plan(seq_length: int, kept: list[str], shuffle_seed: int | None):
    """The function that turns the rows of some buffers into cuts of those rows."""

    def chunk_spans(size, bos_at):
        """Start offsets of the chunks of one buffer and whether each starts on a bos."""
        starts, on_bos, at = [], [], 0
        while True:
            hit = at in bos_at
            take = seq_length if hit else seq_length - 1
            if at + take > size:
                return starts, on_bos
            starts.append(at)
            on_bos.append(hit)
            at += take

    def buffer_cuts(lens, bos_lists):
        """Cuts of one buffer as arrays (row, chunk, lo, hi, at), rows numbered from 0."""
        import numpy as np

        ends = np.cumsum(lens + 2)
        begins = ends - lens - 2
        bos_at = set((ends - 1).tolist())
        for begin, places in zip(begins.tolist(), bos_lists):
            bos_at.update(begin + p for p in places or ())
        starts, on_bos = chunk_spans(int(ends[-1]), bos_at)
        starts = np.asarray(starts, np.int64)
        lead = 1 - np.asarray(on_bos, np.int64)
        stops = starts + seq_length - lead
        first = np.searchsorted(ends, starts, side="right")
        last = np.searchsorted(begins, stops, side="left") - 1
        spans = last - first + 1
        chunk = np.repeat(np.arange(len(starts)), spans)
        row = np.repeat(first, spans) + np.arange(len(chunk)) - np.repeat(np.cumsum(spans) - spans, spans)
        lo = np.maximum(starts[chunk], begins[row])
        hi = np.minimum(stops[chunk], ends[row])
        return row, chunk, lo - begins[row], hi - begins[row], lo - starts[chunk] + lead[chunk]

    def mixed_places(buffer, chunks):
        """Place of each of a buffer's chunks once they are shuffled, by the same key as rows are."""
        import hashlib

        import numpy as np

        if shuffle_seed is None:
            return np.zeros(chunks, np.int64)
        key = [hashlib.md5(f"{shuffle_seed}:{buffer}/{chunk}".encode()).hexdigest() for chunk in range(chunks)]
        out = np.empty(chunks, np.int64)
        out[sorted(range(chunks), key=key.__getitem__)] = np.arange(chunks)
        return out

    def plan(table):
        import numpy as np
        import pyarrow as pa

        table = table.sort_by([("buffer", "ascending"), ("ordinal" if shuffle_seed is None else "_mix", "ascending")])
        buffers = table["buffer"].to_numpy()
        lens = table["_len"].to_numpy().astype(np.int64)
        has_bos = np.diff(table["_bos_at"].combine_chunks().offsets.to_numpy()) > 0
        found = []
        edges = np.flatnonzero(np.diff(buffers, prepend=-1, append=buffers[-1] + 1))
        for start, stop in zip(edges[:-1].tolist(), edges[1:].tolist()):
            span = slice(start, stop)
            inner = has_bos[span].any()
            places = table["_bos_at"].slice(start, stop - start).to_pylist() if inner else ()
            row, chunk, lo, hi, at = buffer_cuts(lens[span], places)
            place = mixed_places(buffers[start], int(chunk[-1]) + 1 if len(chunk) else 0)
            found.append((row + start, np.full(len(row), buffers[start]), chunk, place[chunk], lo, hi, at))
        row, buffer, chunk, place, lo, hi, at = (np.concatenate(part) for part in zip(*found))
        order = np.argsort(row, kind="stable")
        counts = np.bincount(row, minlength=len(lens))
        cuts = pa.StructArray.from_arrays(
            [
                pa.array(buffer[order], pa.int64()),
                pa.array(chunk[order], pa.int64()),
                pa.array(place[order], pa.int64()),
                pa.array(lo[order], pa.int32()),
                pa.array(hi[order], pa.int32()),
                pa.array(at[order], pa.int32()),
            ],
            names=["buffer", "chunk", "position", "lo", "hi", "at"],
        )
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        return table.select(kept).append_column("_cuts", pa.ListArray.from_arrays(pa.array(offsets), cuts))

    return plan


def pack_fixed(
    df: DataFrame,
    order_by: str | Sequence[str],
    *,
    seq_length: int = 2048,
    group: str | Sequence[str] | None = None,
    ids: str = "input_ids",
    encode: Callable | None = None,
) -> DataFrame:
    """All rows concatenated in order and cut every ``seq_length`` tokens, per group.

    No separator is added and the incomplete last chunk of a group is dropped. Tokens are written
    once, in order, and cut where they lie (``plans/runs.py``). With ``encode``, a function between
    Arrow arrays, ``ids`` names a text column that becomes tokens after the shuffle.
    """
    stream = token_stream(df, names(order_by), names(group), ids, encode)
    return cut_stream(stream, seq_length).withColumn("labels", F.col("input_ids"))


def shuffle_in_buffers(
    df: DataFrame, buffer: str | Sequence[str], key: str, seed: int = 42, name: str = "position"
) -> DataFrame:
    """Place of every row in a seeded shuffle of its buffer.

    Buffers come from ``assign_buffers`` or a packer, which bound their size.
    """
    place = Window.partitionBy(*names(buffer)).orderBy(shuffle_key(F.col(key), seed), key)
    return df.withColumn(name, F.row_number().over(place).cast("long") - 1)
