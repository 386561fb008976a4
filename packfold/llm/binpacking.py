"""Sharding by best-fit-decreasing packing of indivisible groups.

Rows of one text stay together. Groups enter shards from the largest to the smallest, each into
the shard with the least room that still holds it; a balanced tree of the shards, ordered by room,
finds it. What a group's place depends on is its size only, so the packing sees a histogram: sizes
and how many groups have each. Equal groups go into the tightest shard until it has no room for
one more, then into the next, which a division tells. The histogram has at most sqrt(2 * bytes)
entries, since that many different sizes add up to all the bytes (14 million for 100 TB; real text
has far fewer); the groups themselves never meet in one task.

The tables that follow from it are narrow: a group's number among those of its size selects its
shard, and the place of a row in its shard is a running count over shard, group and key.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packfold.plans.ordinals import ordinals
from packfold.plans.skew import lookup_skewed
from packfold.session import materialize


class _Node:
    __slots__ = ("key", "left", "right", "level")

    def __init__(self, key: tuple[int, int]):
        self.key, self.left, self.right, self.level = key, None, None, 1


def _skew(t: _Node | None) -> _Node | None:
    if t and t.left and t.left.level == t.level:
        left = t.left
        t.left, left.right = left.right, t
        return left
    return t


def _split(t: _Node | None) -> _Node | None:
    if t and t.right and t.right.right and t.level == t.right.right.level:
        right = t.right
        t.right, right.left = right.left, t
        right.level += 1
        return right
    return t


class Rooms:
    """Shards by (room left, number): a balanced binary tree (each level of nodes holds no more
    than two in a row, so depth grows with the logarithm of the shards)."""

    def __init__(self):
        self._root: _Node | None = None

    def add(self, room: int, shard: int) -> None:
        self._root = self._add(self._root, (room, shard))

    def _add(self, t: _Node | None, key: tuple[int, int]) -> _Node:
        if t is None:
            return _Node(key)
        if key < t.key:
            t.left = self._add(t.left, key)
        else:
            t.right = self._add(t.right, key)
        return _split(_skew(t))

    def tightest(self, size: int) -> tuple[int, int] | None:
        """The shard with the least room of at least ``size``; the first of equal ones."""
        best, t = None, self._root
        while t is not None:
            if t.key >= (size, -1):
                best, t = t.key, t.left
            else:
                t = t.right
        return best

    def remove(self, room: int, shard: int) -> None:
        self._root = self._remove(self._root, (room, shard))

    def _remove(self, t: _Node | None, key: tuple[int, int]) -> _Node | None:
        if t is None:
            return None
        if key < t.key:
            t.left = self._remove(t.left, key)
        elif key > t.key:
            t.right = self._remove(t.right, key)
        elif t.left is None and t.right is None:
            return None
        elif t.left is None:
            after = t.right
            while after.left:
                after = after.left
            t.key = after.key
            t.right = self._remove(t.right, after.key)
        else:
            before = t.left
            while before.right:
                before = before.right
            t.key = before.key
            t.left = self._remove(t.left, before.key)
        # levels go down where a child is missing, and rows of three are split again
        lowest = min(t.left.level if t.left else 0, t.right.level if t.right else 0) + 1
        if lowest < t.level:
            t.level = lowest
            if t.right and lowest < t.right.level:
                t.right.level = lowest
        t = _skew(t)
        t.right = _skew(t.right)
        if t.right:
            t.right.right = _skew(t.right.right)
        t = _split(t)
        t.right = _split(t.right)
        return t


class Run(NamedTuple):
    """Groups of one size, up to number ``upto`` (exclusive) among them, that go into a shard."""

    size: int
    upto: int
    shard: int


def best_fit(histogram: Sequence[tuple[int, int]], capacity: int, most: int | None = None, first: int = 0) -> list[Run] | None:
    """Runs for (size, number of groups), largest size first, in shards of one capacity.

    A shard is opened when no open one has room, so there are as few as best fit finds. A group
    beyond the capacity has a shard to itself. With ``most``, None if more shards are needed.
    """
    rooms, opened, runs = Rooms(), 0, []
    for size, count in histogram:
        done = 0
        while done < count:
            found = rooms.tightest(size)
            if found is None:
                if most is not None and opened == most:
                    return None
                room, shard = max(capacity, size), first + opened
                opened += 1
            else:
                room, shard = found
                rooms.remove(room, shard)
            # the shard stays the tightest one while it holds more of the same size
            fits = min(room // size, count - done)
            done += fits
            rooms.add(room - fits * size, shard)
            runs.append(Run(size, done, shard))
    return runs


def balanced(histogram: Sequence[tuple[int, int]], shards: int) -> list[Run]:
    """Runs for exactly ``shards`` shards of about one size: the least capacity found for which
    best fit needs no more of them.

    A group larger than the mean of what is left has a shard to itself; the others are
    packed into the rest, so that one huge group does not leave them uneven.
    """
    total, left = sum(size * count for size, count in histogram), shards
    rest, alone, taken = list(histogram), [], 0
    while rest and left > 1 and rest[0][0] * left > total:
        size, count = rest[0]
        taken += 1
        alone.append(Run(size, taken, len(alone)))
        total, left = total - size, left - 1
        if taken == count:
            rest, taken = rest[1:], 0
    if not rest:
        return alone
    size, count = rest[0]
    rest[0] = (size, count - taken)
    # double the distance from a capacity that cannot do until one does, then halve it
    low, step, found = max(-(-total // left), size) - 1, 1, None
    while found is None:
        high = low + step
        found = best_fit(rest, high, left, len(alone))
        if found is None:
            low, step = high, step * 2
    while high - low > 1:
        middle = (low + high) // 2
        tried = best_fit(rest, middle, left, len(alone))
        if tried is None:
            low = middle
        else:
            high, found = middle, tried
    return alone + [r._replace(upto=r.upto + taken) if r.size == size else r for r in found]


def _runs(groups: DataFrame, shards: int | None, capacity: int | None) -> DataFrame:
    """_total (a group's size), _weight (groups of that size) and _runs, (upto, shard) in order."""
    histogram = groups.groupBy("_total").agg(F.count(F.lit(1)).alias("_weight"))

    kind = pa.list_(pa.struct([("upto", pa.int64()), ("shard", pa.int32())]))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = sorted((row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns])), reverse=True)
        runs = balanced(entries, shards) if shards else best_fit(entries, capacity)
        by_size: dict[int, list[dict]] = {}
        for run in sorted(runs):
            by_size.setdefault(run.size, []).append({"upto": run.upto, "shard": run.shard})
        columns = [[s for s, _ in entries], [n for _, n in entries], [by_size[s] for s, _ in entries]]
        arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), kind))]
        yield pa.RecordBatch.from_arrays(arrays, names=["_total", "_weight", "_runs"])

    schema = "_total long, _weight long, _runs array<struct<upto:long,shard:int>>"
    return materialize(histogram.repartition(1).mapInArrow(pack, schema), "shard-runs")


def shard_groups(
    df: DataFrame, key: str = "doc_id", text: str = "text", *, shards: int | None = None, capacity: int | None = None, overhead: int = 8
) -> DataFrame:
    """Each row's key, size, group (a hash of its text), shard and slot.

    Give ``shards`` for that many shards of about one size, or ``capacity`` for as few of that
    many bytes as best fit needs. A row's size is the UTF-8 bytes of its text plus ``overhead``;
    rows of equal texts are never parted, a null text counting as an empty one. (Texts of one 64-bit
    hash and nothing else in common would share a shard as well.) Slots number the rows of a
    shard from 0 without gaps, by group and key (null first); rows equal in both are equal rows of
    the result. An empty table gives no row; with fewer groups than shards some stay empty.
    """
    if (shards is None) == (capacity is None):
        raise ValueError("give either shards or capacity")
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    sized = df.select(
        F.col(f"`{key}`").alias("_key"),
        (F.octet_length(words) + overhead).cast("long").alias("_size"),
        F.crc32(words.cast("binary")).alias("_crc"),
        F.xxhash64(words).alias("_group"),
    )
    rows = materialize(sized, "shard-sizes")
    groups = rows.groupBy("_group").agg(F.count(F.lit(1)).alias("_rows"), F.sum("_size").alias("_total"))
    groups = materialize(groups, "shard-groups")
    numbered = ordinals(groups, "_group", group="_total", carry={"_rows": F.col("_rows")}, partitions=partitions).frame
    scatter = F.monotonically_increasing_id()
    # keys made up for scattering lie below all sizes, hashes are told apart by their rows
    placed = lookup_skewed(numbered, _runs(groups, shards, capacity), "_total", "_weight", -scatter - 1)
    run = F.filter("_runs", lambda r: r["upto"] > F.col("ordinal"))
    chosen = materialize(placed.select("_group", "_rows", F.get(run, 0)["shard"].alias("_shard")), "shard-chosen")
    found = lookup_skewed(rows, chosen, "_group", "_rows", scatter)
    slots = ordinals(
        found.withColumn("_row", scatter), ["_group", "_key", "_row"], group="_shard",
        carry={"_size": F.col("_size"), "_crc": F.col("_crc")}, partitions=partitions,
    ).frame
    return slots.select(
        F.col("_key").alias(key),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.col("_group").alias("text_group"),
        F.col("_shard").alias("shard"),
        F.col("ordinal").alias("slot"),
    )
