"""Whole texts of an Arrow batch as flat byte arrays, and what numpy can count in them at once.

Operators that run Python see a batch of rows at a time. The bytes of its texts lie in one
buffer; work goes on over blocks of whole texts of about ``BLOCK`` bytes, so that the helper
arrays stay small however large a batch is. One text longer than that is a block of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 1 << 20
# Rows that ``map_texts`` works on at a time, so that results stay small beside their batch.
ROWS = 2_000

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
STEP = U64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all bits (a bijection)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def mix_one(x: int) -> int:
    return int(mix(np.array([x & (2**64 - 1)], U64))[0])


_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and its inverse modulo 2**64 for i < n; kept for the next block."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            factors = np.full(max(n, BLOCK + 1), base, U64)
            factors[0] = 1
            _powers[k] = np.multiply.accumulate(factors)
    return _powers[0][:n], _powers[1][:n]


class Block(NamedTuple):
    """Texts ``first`` to ``first + len(starts) - 1`` of a batch: text i is data[starts[i]:ends[i]]."""

    first: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def blocks(column: pa.Array | pa.ChunkedArray, size: int = BLOCK) -> Iterator[Block]:
    """Blocks of whole texts; a null text is an empty one."""
    first = 0
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        large = pa.types.is_large_string(chunk.type) or pa.types.is_large_binary(chunk.type)
        buffers, n = chunk.buffers(), len(chunk)
        if n == 0:
            continue
        offsets = np.frombuffer(buffers[1], np.int64 if large else np.int32)
        offsets = offsets[chunk.offset : chunk.offset + n + 1].astype(np.int64)
        data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
        starts, ends = offsets[:-1], offsets[1:]
        if chunk.null_count:
            ends = np.where(np.asarray(chunk.is_valid()), ends, starts)
        i = 0
        while i < n:
            j = max(int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1, i + 1)
            low = offsets[i]
            yield Block(first + i, data[low : offsets[j]], starts[i:j] - low, ends[i:j] - low)
            i = j
        first += n


def text_numbers(block: Block) -> np.ndarray:
    """For every byte of the block, the index of its text."""
    return np.repeat(np.arange(len(block.starts), dtype=np.int32), np.diff(np.append(block.starts, len(block.data))))


class Runs(NamedTuple):
    """Maximal runs of member bytes: the text each is in, and its start and end in the block."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray


def runs(block: Block, member: np.ndarray) -> Runs:
    """Words: maximal runs of bytes b with ``member[b]``, never across texts."""
    n = len(block.data)
    inside = np.zeros(n + 2, np.bool_)
    inside[1:-1] = member[block.data]
    change = inside[1:] != inside[:-1]
    starts_here = change & inside[1:]
    ends_here = change & inside[:-1]
    # a text's first byte begins a run of its own, though the text before ends in one
    cuts = block.starts[(block.starts > 0) & (block.starts < n)]
    cuts = cuts[inside[cuts] & inside[cuts + 1]]
    starts_here[cuts] = True
    ends_here[cuts] = True
    start, end = np.flatnonzero(starts_here), np.flatnonzero(ends_here)
    return Runs(np.searchsorted(block.starts, start, side="right") - 1, start, end)


def prefix_hash(data: np.ndarray, fold: np.ndarray | None = None) -> np.ndarray:
    """Running sums whose differences are the polynomial hashes of substrings."""
    power, _ = powers(len(data) + 1)
    if fold is not None:
        values = fold[data]
    else:
        values = data.astype(U64)
        values += U64(1)
    values *= power[:-1]
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(values, out=out[1:])
    return out


def slice_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], equal for equal bytes wherever they lie."""
    _, inverse = powers(len(sums))
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(U64) * STEP)


def ngrams(hashes: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n words in a row and the index of their first word, inside texts only."""
    if len(hashes) < n:
        return np.empty(0, U64), np.empty(0, np.int64)
    last = len(hashes) - n + 1
    total = np.zeros(last, U64)
    for k in range(n):
        total = total * STEP + hashes[k : k + last]
    first = np.flatnonzero(text[:last] == text[n - 1 :])
    return mix(total[first]), first


def byte_table(members: str | bytes = b"", *, high: bool = False) -> np.ndarray:
    table = np.zeros(256, np.bool_)
    table[list(members.encode() if isinstance(members, str) else members)] = True
    table[128:] = high
    return table


# Words between the six ASCII white space characters; all other bytes belong to words.
SPACED = ~byte_table(b" \t\n\x0b\x0c\r")
# Letters, digits and every byte of a non-ASCII character.
ALNUM = byte_table(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", high=True)


def _lower_case() -> np.ndarray:
    values = np.arange(256)
    values[65:91] += 32
    return values.astype(U64) + U64(1)


LOWER = _lower_case()


def characters(block: Block) -> np.ndarray:
    """Running count of code points: all bytes but the later ones of a character."""
    out = np.zeros(len(block.data) + 1, np.int64)
    np.cumsum((block.data & 0xC0) != 0x80, out=out[1:])
    return out


def per_text(block: Block, text: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(text, weights, len(block.starts))


def map_texts(
    df: DataFrame,
    keep: Sequence[str],
    text: str,
    fields: Sequence[tuple[str, T.DataType]],
    work: Callable[[pa.RecordBatch], dict[str, np.ndarray | pa.Array | list]],
) -> DataFrame:
    """One row out for each row in: the ``keep`` columns and what ``work`` makes of a batch.

    ``work`` gets a batch whose column ``_text`` is the text, beside the kept columns under
    the names ``_k0``, ``_k1``...; only these columns leave the table, whatever else it has.
    """
    inner = [f"_k{i}" for i in range(len(keep))]
    named = [F.col(f"`{c}`").alias(k) for c, k in zip(keep, inner)]
    # a text that is kept as well goes to Python once
    own = list(keep).index(text) if text in keep else None
    chosen = df.select(*named, *([] if own is not None else [F.col(f"`{text}`").alias("_text")]))
    types = [df.schema[c].dataType for c in keep]
    schema = T.StructType(
        [T.StructField(k, t) for k, t in zip(inner, types)] + [T.StructField(f"_r{i}", t) for i, (_, t) in enumerate(fields)]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, max(whole.num_rows, 1), ROWS)):
            made = work(batch if own is None else batch.append_column("_text", batch.column(own)))
            arrays = [batch.column(batch.schema.get_field_index(k)) for k in inner]
            arrays += [pa.array(made[name]) if not isinstance(made[name], pa.Array) else made[name] for name, _ in fields]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema.fields])
        # a worker that waits for its next task holds no more than it needs
        pa.default_memory_pool().release_unused()

    out = chosen.mapInArrow(run, schema)
    return out.select(
        *[F.col(k).alias(c) for k, c in zip(inner, keep)],
        *[F.col(f"_r{i}").alias(name) for i, (name, _) in enumerate(fields)],
    )


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000) -> Iterator[None]:
    """Plans made inside hand Python this many rows at a time, for wide rows. They must also
    run inside; the session's own setting comes back at the end."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(rows))
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def gather(parts: Sequence[dict[str, np.ndarray]], names: Sequence[str]) -> dict[str, np.ndarray]:
    """The blocks' results as those of the batch."""
    return {n: np.concatenate([p[n] for p in parts]) if parts else np.empty(0) for n in names}
