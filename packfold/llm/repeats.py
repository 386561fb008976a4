"""Suffix-array dedup: remove every byte of a long string that starts anywhere else as well.

A string of LENGTH bytes is told by its anchor, a place near its start that equal strings share,
and by the STEM bytes from there on. Stems found once cannot lie in a repeated string. For the
others, the bytes around the stem (its context) decide. Contexts found twice repeat in full;
different contexts of one stem are sorted together as suffixes, by Lyndon groups, and strings
next to each other that agree on LENGTH bytes are repeated. Equal bytes are told by 64-bit
hashes; otherwise the result is exact, for all bytes of all texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packfold.llm import texts
from packfold.llm.lyndon import suffix_array
from packfold.llm.texts import U64, Block
from packfold.plans.ordinals import join_keyed, ordinals
from packfold.plans.skew import lookup_skewed
from packfold.session import materialize

LENGTH = 400
# A string's anchor is at most REACH bytes behind its start; it stands for the bytes after it.
REACH = 48
STEM = LENGTH - REACH
GRAM = 32
# Bytes whose anchors are looked for together.
WINDOW = 1 << 24
# Starts of strings rated together; with REACH more, their places have _PLACE's bits.
STARTS = (1 << 16) - REACH
_PLACE = U64((1 << 16) - 1)
_PLACES = np.arange(1 << 16, dtype=U64)
# An odd factor that spreads hashes over the high bits, by which places are rated.
_SPREAD = U64(0x94D049BB133111EB)
# Bits of the filters that spare unrepeated stems the shuffle; 8 MB at any size of the table.
FILTER_BITS = 1 << 26
# Contexts that one task sorts together at most; a stem with more is split by longer stems.
TOGETHER = 2_000
FINER = 6
# Contexts of a stem from which on it is dealt to a task in turn.
DEALT_SIZE = 50


def anchors(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, place and stem hash of the anchors of all strings of LENGTH bytes.

    The anchor of the string at p is the place in p..p+REACH whose GRAM bytes hash least, the
    first of equal ones: equal strings have their anchors at the same distance. A long block is
    looked at in windows that overlap by a string, so every string lies in one of them."""
    n = len(block.data)
    if n <= WINDOW:
        return _anchors(block)
    found = []
    for low in range(0, n - LENGTH + 1, WINDOW - LENGTH + 1):
        high = min(low + WINDOW, n)
        first = int(np.searchsorted(block.starts, low, side="right")) - 1
        last = int(np.searchsorted(block.starts, high, side="left"))
        own = slice(first, last)
        part = Block(0, block.data[low:high], np.maximum(block.starts[own] - low, 0), np.clip(block.ends[own] - low, 0, high - low))
        text, place, stem = _anchors(part)
        found.append((text + first, place + low, stem))
    text, place, stem = map(np.concatenate, zip(*found))
    # strings of two windows may share an anchor
    place, at = np.unique(place, return_index=True)
    return text[at], place, stem[at]


def _anchors(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(block.data)
    long = np.flatnonzero(block.ends - block.starts >= LENGTH)
    if not len(long):
        empty = np.empty(0, np.int64)
        return empty, empty, np.empty(0, U64)
    sums = texts.prefix_hash(block.data)
    _, inverse = texts.powers(n + 1)
    begins, anchor = [], []
    # few starts at a time, so that the arrays stay in the processor's cache
    for low in range(0, n - LENGTH + 1, STARTS):
        places = min(STARTS, n - LENGTH + 1 - low) + REACH
        rated = sums[low + GRAM : low + GRAM + places] - sums[low : low + places]
        rated *= inverse[low : low + places]
        rated *= _SPREAD
        rated &= ~_PLACE
        rated |= _PLACES[:places]
        # least of 32 places in a row by doubling, then of REACH + 1 by two overlapping runs
        for width in (1, 2, 4, 8, 16):
            rated = np.minimum(rated[:-width], rated[width:])
        rest = REACH + 1 - 32
        least = np.minimum(rated[:-rest], rated[rest:])
        change = np.flatnonzero(least[1:] != least[:-1]) + 1
        begin = np.concatenate([[0], change])
        begins.append(begin + low)
        anchor.append((least[begin] & _PLACE).astype(np.int64) + low)
    begin, place = np.concatenate(begins), np.concatenate(anchor)
    # starts from one place of begin to the next have one anchor; a text must hold one of the strings
    starts, ends = block.starts[long], block.ends[long]
    stop = np.append(begin[1:], n - LENGTH + 1)
    at = np.searchsorted(starts, begin, side="right") - 1
    inside = (at >= 0) & (begin <= ends[at] - LENGTH)
    inside |= np.append(starts, n)[at + 1] < stop
    place = place[inside]
    # the anchor of the last start of one stretch may be that of the next one's first
    place = place[np.flatnonzero(np.diff(place, prepend=-1))]
    text = long[np.searchsorted(starts, place, side="right") - 1]
    return text, place, texts.slice_hash(sums, place, place + STEM)


def contexts(block: Block, text: np.ndarray, place: np.ndarray, stem: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Name of each anchor's context, and how many bytes it has on the left and on the right."""
    left = np.minimum(place - block.starts[text], REACH)
    right = np.minimum(block.ends[text] - place - STEM, REACH)
    sums = texts.prefix_hash(block.data)
    around = texts.slice_hash(sums, place - left, place + STEM + right)
    return texts.mix(around ^ texts.mix(stem + left.astype(U64))), left, right


def _bit(names: np.ndarray) -> np.ndarray:
    return (names & U64(FILTER_BITS - 1)).astype(np.int64)


def passing(table: DataFrame, column: str) -> np.ndarray:
    """Which values of the low bits of a name occur, packed; at most FILTER_BITS / 64 rows come
    to the driver."""
    word = F.shiftright(F.col(column).bitwiseAND(F.lit(FILTER_BITS - 1)), 6).alias("word")
    bit = F.expr(f"shiftleft(1L, cast({column} & 63 as int))").alias("bit")
    got = table.select(word, bit).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(FILTER_BITS // 64, np.int64)
    words[np.asarray(got.column("word"))] = np.asarray(got.column("bits"))
    return words.view(np.uint8)


def _passes(bits: np.ndarray, names: np.ndarray) -> np.ndarray:
    at = _bit(names)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 != 0


def _stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [anchors(b)[2] for b in texts.blocks(batch.column(0))]
        stem, n = np.unique(np.concatenate(found) if found else np.empty(0, U64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(stem.view(np.int64)), pa.array(n)], names=["stem", "n"])


OCCURRENCE = T.ArrayType(
    T.StructType(
        [
            T.StructField("at", T.IntegerType()),
            T.StructField("stem", T.LongType()),
            T.StructField("context", T.LongType()),
            T.StructField("left", T.IntegerType()),
            T.StructField("right", T.IntegerType()),
        ]
    )
)


def _occurrences(column: pa.Array, bits: np.ndarray) -> pa.Array:
    """Per text the anchors whose stems pass."""
    parts, counts = [], [np.empty(0, np.int64)]
    for block in texts.blocks(column):
        text, place, stem = anchors(block)
        go = _passes(bits, stem)
        text, place, stem = text[go], place[go], stem[go]
        name, left, right = contexts(block, text, place, stem)
        parts.append((place - block.starts[text], stem, name, left, right))
        counts.append(np.bincount(text, minlength=len(block.starts)))
    at, stem, name, left, right = (np.concatenate(x) for x in zip(*parts)) if parts else [np.empty(0, np.int64)] * 5
    values = [at.astype(np.int32), stem.astype(U64).view(np.int64), name.astype(U64).view(np.int64), left.astype(np.int32), right.astype(np.int32)]
    flat = pa.StructArray.from_arrays([pa.array(x) for x in values], names=["at", "stem", "context", "left", "right"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int32)), flat)


def _context_bytes(bits: np.ndarray):
    """Distinct contexts of a batch whose names pass: stem, name and the bytes on both sides."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: dict[int, tuple[int, bytes, bytes]] = {}
            for block in texts.blocks(batch.column(0)):
                text, place, stem = anchors(block)
                name, left, right = contexts(block, text, place, stem)
                data = block.data.tobytes()
                for i in np.flatnonzero(_passes(bits, name)).tolist():
                    p, after = int(place[i]), int(place[i]) + STEM
                    made.setdefault(int(name[i].view(np.int64)), (int(stem[i].view(np.int64)), data[p - left[i] : p], data[after : after + right[i]]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(made), pa.int64()),
                    pa.array([s for s, _, _ in made.values()], pa.int64()),
                    pa.array([x for _, x, _ in made.values()], pa.binary()),
                    pa.array([x for _, _, x in made.values()], pa.binary()),
                ],
                names=["context", "stem", "left", "right"],
            )

    return work


def repeated_starts(groups: list[list[tuple[bytes, bytes]]], reach: int) -> list[list[int]]:
    """For each group of contexts (left, right) around one stem and each context in it, the set
    of distances d, as bits, for which another context has the same d bytes on the left and
    reach - d on the right.

    The stem is one symbol of its own, so that reach + 1 symbols are compared."""
    flat = [(g, left, right) for g, group in enumerate(groups) for left, right in group]
    size = np.array([len(x) + len(y) + 2 for _, x, y in flat])
    end = np.cumsum(size)
    begin = end - size
    middle = begin + [len(x) for _, x, _ in flat]
    symbols = np.zeros(int(end[-1]) if len(end) else 0, np.int64)
    inner = np.ones(len(symbols), np.bool_)
    inner[middle] = inner[end - 1] = False
    symbols[inner] = np.frombuffer(b"".join(part for _, x, y in flat for part in (x, y)), np.uint8) + np.int64(len(flat))
    symbols[end - 1] = np.arange(len(flat))[::-1]
    symbols[middle] = len(flat) + 256 + np.array([g for g, _, _ in flat], np.int64)
    order = suffix_array(symbols)

    owner = np.repeat(np.arange(len(flat)), size)
    whole = order[(order <= middle[owner[order]]) & (order >= middle[owner[order]] - reach) & (order + reach + 1 < end[owner[order]])]
    power, _ = texts.powers(len(symbols) + 1)
    sums = np.concatenate([np.zeros(1, U64), np.cumsum((symbols + 1).astype(U64) * power[:-1])])
    hashes = texts.slice_hash(sums, whole, whole + reach + 1)
    same = hashes[1:] == hashes[:-1]
    repeated = np.zeros(len(whole), np.bool_)
    repeated[1:] |= same
    repeated[:-1] |= same
    found = whole[repeated]
    bits = np.zeros(len(flat), np.int64)
    np.bitwise_or.at(bits, owner[found], np.int64(1) << (middle[owner[found]] - found))
    out, at = [], 0
    for group in groups:
        out.append(bits[at : at + len(group)].tolist())
        at += len(group)
    return out


def _sorted_groups(reach: int):
    """Rows sorted by group: (group, context, base, left, right) give (context, starts)."""

    def flush(groups: list[list[tuple[int, int, bytes, bytes]]]) -> pa.RecordBatch:
        made = repeated_starts([[(x, y) for _, _, x, y in g] for g in groups], reach) if groups else []
        rows = [(c, bits << base) for g, found in zip(groups, made) for (c, base, _, _), bits in zip(g, found) if bits]
        return pa.RecordBatch.from_arrays(
            [pa.array([c for c, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.int64())], names=["context", "starts"]
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: list[list[tuple[int, int, bytes, bytes]]] = []
        last, held = None, 0
        for batch in batches:
            for group, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if group != last:
                    if held >= TOGETHER:
                        yield flush(groups)
                        groups, held = [], 0
                    groups.append([])
                    last = group
                groups[-1].append(tuple(row))
                held += 1
        yield flush(groups)

    return work


def _split(reach: int, finer: int):
    """Contexts by longer stems: one row for each range of finer + 1 distances."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for group, context, base, left, right in zip(*(c.to_pylist() for c in batch.columns)):
                for near in range(0, reach + 1, finer + 1):
                    far = reach - near - finer
                    if len(left) >= near and len(right) >= far:
                        stem = (group, near, left[len(left) - near :], right[:far])
                        name = texts.mix_one(hash_bytes(b"%d:%d:" % stem[:2] + stem[2] + b"|" + stem[3]))
                        name -= (name >> 63) << 64
                        rows.append((name, context, base + near, left[max(len(left) - near - finer, 0) : len(left) - near], right[far : far + finer]))
            columns = list(zip(*rows)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["group", "context", "base", "left", "right"])

    return work


def hash_bytes(data: bytes) -> int:
    sums = texts.prefix_hash(np.frombuffer(data, np.uint8))
    return int(texts.slice_hash(sums, np.zeros(1, np.int64), np.array([len(data)]))[0])


ROW = "group long, context long, base int, left binary, right binary"


def _dealt(sizes: DataFrame, tasks: int) -> DataFrame:
    """``task`` of each group (group, size): the large ones in turn, from the largest down, so that
    no task gets many of them, the others by hash."""
    large = sizes.filter(F.col("size") >= DEALT_SIZE).select("group", (-F.col("size")).alias("order"))
    turns = ordinals(large, ["order", "group"]).frame.select("group", (F.col("ordinal") % tasks).cast("int").alias("turn"))
    task = F.coalesce("turn", F.pmod(F.hash("group"), F.lit(tasks)))
    return sizes.join(turns, "group", "left").select("group", task.alias("task"))


def starts_of(rows: DataFrame) -> DataFrame:
    """(context, starts) for contexts that share a part of LENGTH bytes with another of their
    stem; bit d of ``starts`` is the string that begins d bytes before the anchor.

    No task gets more than TOGETHER contexts of a stem: those of larger groups go on under
    longer stems, and where even these are shared by more, under all LENGTH bytes."""
    reach, found = REACH, None
    while True:
        sizes = rows.groupBy("group").agg(F.count(F.lit(1)).alias("size"))
        sizes = materialize(sizes.filter(F.col("size") > 1), "group-sizes")
        if reach == 0:
            done = rows.join(sizes, "group").select("context", F.expr("shiftleft(1L, base)").alias("starts"))
        else:
            tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            dealt = _dealt(sizes.filter(F.col("size") <= TOGETHER), tasks)
            small = rows.join(dealt, "group").select("group", "context", "base", "left", "right", "task")
            # few bytes are much work here, so adaptive execution must not put them into few tasks
            together = small.repartitionById(tasks, F.col("task")).sortWithinPartitions("group").drop("task")
            done = together.mapInArrow(_sorted_groups(reach), "context long, starts long")
        found = done if found is None else found.union(done)
        large = sizes.filter(F.col("size") > TOGETHER).select("group")
        if reach == 0 or large.isEmpty():
            return found.groupBy("context").agg(F.bit_or("starts").alias("starts"))
        finer = FINER if reach > FINER else 0
        crowded = rows.join(large, "group").select("group", "context", "base", "left", "right")
        rows = materialize(crowded.mapInArrow(_split(reach, finer), ROW), "split-groups")
        reach = finer


def cut(text: bytes, at: np.ndarray, left: np.ndarray, right: np.ndarray, times: np.ndarray, starts: np.ndarray) -> tuple[bytes, list[tuple[int, int]]]:
    """The bytes that stay, and the maximal runs (start, end) that go, by the anchors found.

    All strings around an anchor go if its context is found twice, else those in ``starts``."""
    if not len(at):
        return text, []
    edge = np.zeros(len(text) + 1, np.int64)
    low = np.maximum(REACH - right, 0)
    whole = (times > 1) & (left >= low)
    np.add.at(edge, at[whole] - left[whole], 1)
    np.add.at(edge, at[whole] - low[whole] + LENGTH, -1)
    for place, bits in zip(at[~whole].tolist(), starts[~whole].tolist()):
        while bits:
            near = (bits & -bits).bit_length() - 1
            run = bits >> near
            size = ((run + 1) & ~run).bit_length() - 1
            bits &= ~(((1 << size) - 1) << near)
            # strings that begin near + size - 1 down to near bytes before the anchor
            edge[place - near - size + 1] += 1
            edge[place - near + LENGTH] -= 1
    gone = np.cumsum(edge[:-1]) > 0
    change = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), list(zip(change[::2].tolist(), change[1::2].tolist()))


CUT = [
    ("n_bytes", T.LongType()),
    ("kept", T.BinaryType()),
    ("removed", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
]


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row: key, n_bytes, kept (the bytes that stay) and removed (start, end).

    Texts are UTF-8 bytes, null ones empty; strings do not cross texts and are judged on the
    input, overlaps and both occurrences included. Rows that repeat a key and its text are
    occurrences of their own and lose what they share. Other columns are ignored.
    """
    own = F.xxhash64(F.col(f"`{text}`"))
    docs = df.select(F.col(f"`{key}`").alias("key"), own.alias("hash"), F.col(f"`{text}`").alias("text"))
    stems = docs.select("text").mapInArrow(_stems, "stem long, n long").groupBy("stem").agg(F.sum("n").alias("n"))
    first = passing(stems.filter(F.col("n") > 1), "stem")

    def find(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        return {"found": _occurrences(batch.column(2), first)}

    found = texts.map_texts(docs, ["key", "hash"], "text", [("found", OCCURRENCE)], find)
    found = materialize(found.select("key", "hash", F.inline("found")), "occurrences")
    counted = materialize(
        found.groupBy("stem", "context").agg(F.count(F.lit(1)).alias("times")), "contexts"
    )
    shared = counted.groupBy("stem").agg(F.count(F.lit(1)).alias("kinds")).filter(F.col("kinds") > 1)
    mixed = materialize(counted.join(shared.select("stem"), "stem").select("stem", "context"), "mixed-contexts")
    second = passing(mixed, "context")
    raw = docs.select("text").mapInArrow(_context_bytes(second), "context long, stem long, left binary, right binary")
    raw = raw.groupBy("stem", "context").agg(F.first("left").alias("left"), F.first("right").alias("right"))
    rows = raw.join(mixed, ["stem", "context"]).select(
        F.col("stem").alias("group"), "context", F.lit(0).alias("base"), "left", "right"
    )
    starts = materialize(starts_of(materialize(rows, "context-bytes")), "starts")

    verdicts = counted.groupBy("context").agg(F.sum("times").alias("times")).join(starts, "context", "left")
    verdicts = materialize(verdicts.filter((F.col("times") > 1) | F.col("starts").isNotNull()), "verdicts")
    # the count that weighs a context is kept beside the one that lookup uses up
    verdicts = verdicts.withColumn("weight", F.col("times"))
    placed = lookup_skewed(found, verdicts, "context", "weight", F.xxhash64("key", "hash", "at"))
    hits = placed.filter(F.col("times").isNotNull())
    per_text = hits.groupBy("key", "hash").agg(F.collect_set(F.struct("at", "left", "right", "times", "starts")).alias("hits"))
    joined = join_keyed(docs, per_text, ["key", "hash"], "left")

    def apply(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        whole = [x.encode() if x else b"" for x in batch.column(2).to_pylist()]
        hits = batch.column(1).fill_null([]) if batch.column(1).null_count else batch.column(1)
        flat = hits.flatten()
        fields = [np.asarray(flat.field(i).fill_null(0)) for i in range(5)]
        edges = np.concatenate([[0], np.cumsum(np.asarray(hits.value_lengths()))]).tolist()
        made = [cut(x, *[f[a:b] for f in fields]) for x, a, b in zip(whole, edges[:-1], edges[1:])]
        spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return {
            "n_bytes": pa.array([len(x) for x in whole], pa.int64()),
            "kept": pa.array([x for x, _ in made], pa.binary()),
            "removed": pa.array([[{"start": a, "end": b} for a, b in r] for _, r in made], spans),
        }

    return texts.map_texts(joined, ["key", "hits"], "text", CUT, apply).select(
        F.col("key").alias(key), *[name for name, _ in CUT]
    )
