"""Packers against plain walks over the concatenated stream."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from packfold.operators import buffers, packing
from packfold.operators.packing import assign_buffers, pack_aligned, pack_fixed
from packfold.plans import ordinals as plans

BOS, EOS = 1, 2


def frame(spark, docs, partitions=3, seed=0):
    rows = list(enumerate(docs))
    random.Random(seed).shuffle(rows)
    return spark.createDataFrame(rows, "doc int, input_ids array<int>").repartition(partitions)


def buffers_of(docs, limit):
    out, buffer, size = [], [], 0
    for doc in docs:
        if size >= limit:
            out.append(buffer)
            buffer, size = [], 0
        buffer.append(doc)
        size += len(doc)
    return out + [buffer] if buffer else out


def walk(docs, length, limit):
    chunks = []
    for buffer in buffers_of(docs, limit):
        stream = [t for doc in buffer for t in doc + [EOS, BOS]]
        while stream:
            chunk = stream[:length] if stream[0] == BOS else [BOS] + stream[: length - 1]
            stream = stream[length:] if stream[0] == BOS else stream[length - 1 :]
            if len(chunk) == length:
                chunks.append(chunk)
    return chunks


def packed_rows(df):
    return [r.input_ids for r in df.orderBy("buffer", "chunk").collect()]


def test_known_sequence(spark):
    docs = spark.createDataFrame(
        [(0, [100, 101, 102, 103, 104]), (1, [200, 201, 202, 203]), (2, [300, 301, 302])], "doc int, input_ids array<int>"
    )
    packed = pack_aligned(docs, "doc", bos=2, eos=3, seq_length=4)
    assert packed_rows(packed) == [
        [2, 100, 101, 102], [2, 103, 104, 3], [2, 200, 201, 202], [2, 203, 3, 2], [2, 300, 301, 302]
    ]
    assert packed.filter(F.col("labels") != F.col("input_ids")).count() == 0


def random_docs(seed, count, longest, bos_share):
    rng = random.Random(seed)
    token = lambda: BOS if rng.random() < bos_share else rng.randint(3, 99)
    return [[token() for _ in range(rng.choice([0, 1, 3, longest]))] for _ in range(count)]


@pytest.mark.parametrize("seed,length,sequences,bos_share", [(1, 4, 3, 0.0), (2, 7, 2, 0.2), (3, 16, 4, 0.05), (4, 2, 5, 0.3), (5, 64, 1, 0.0)])
def test_aligned_equals_walk(spark, seed, length, sequences, bos_share):
    docs = random_docs(seed, 60, 90, bos_share)
    got = packed_rows(pack_aligned(frame(spark, docs), "doc", bos=BOS, eos=EOS, seq_length=length, num_sequences=sequences))
    assert got == walk(docs, length, length * sequences)


@pytest.mark.parametrize("seed,sequences,entries", [(9, 2, 10**6), (10, 9, 0), (12, 40, 0), (13, 3, 0)])
def test_buffers_run_across_shards(spark, monkeypatch, seed, sequences, entries):
    """Shards far smaller than a buffer, or a little larger; maps walked at once or composed in
    blocks of two first."""
    monkeypatch.setattr(buffers, "BLOCK", 2)
    monkeypatch.setattr(buffers, "TOP_ENTRIES", entries)
    docs = random_docs(seed, 45, 30, 0.1)
    packed = pack_aligned(
        frame(spark, docs), "doc", bos=BOS, eos=EOS, seq_length=8, num_sequences=sequences, shard_chunks=7
    )
    assert packed_rows(packed) == walk(docs, 8, 8 * sequences)


def test_buffers_across_shards_by_group(spark, monkeypatch):
    monkeypatch.setattr(buffers, "BLOCK", 2)
    monkeypatch.setattr(buffers, "TOP_ENTRIES", 0)
    docs = random_docs(21, 60, 12, 0.1)
    rows = [("hot" if i % 4 else None, i, d) for i, d in enumerate(docs)]
    df = spark.createDataFrame(rows, "g string, doc int, input_ids array<int>")
    packed = pack_aligned(df, "doc", bos=BOS, eos=EOS, seq_length=4, num_sequences=5, shard_chunks=5, group="g")
    for name in ("hot", None):
        want = walk([d for g, _, d in rows if g == name], 4, 20)
        assert packed_rows(packed.filter(F.col("g").eqNullSafe(F.lit(name)))) == want


@pytest.mark.parametrize("seed", range(40))
def test_maps_of_shards_compose(seed):
    """Any cut of a table into shards gives the state a plain walk reaches at each shard."""
    rng = random.Random(seed)
    limit = rng.randint(1, 40)
    lens = [rng.choice([0, 0, 1, 2, rng.randint(0, 60)]) for _ in range(rng.randint(1, 60))]
    shards, i = [], 0
    while i < len(lens):
        j = i + rng.randint(1, 9)
        shards.append(lens[i:j])
        i = j
    build, look_up, compose = buffers._map_tools(limit)
    maps = [build(np.array(s, np.int64)) for s in shards]
    whole = maps[0]
    for found in maps[1:]:
        whole = compose(whole, found)
    for start in range(1, limit + 1):
        need, done = start, 0
        for n in lens:
            need -= n
            if need <= 0:
                need, done = limit, done + 1
        at, filled = start, 0
        for found in maps:
            after, count = look_up(found, np.array([at]))
            at, filled = int(after[0]), filled + int(count[0])
        assert (at, filled) == (need, done)
        after, count = look_up(whole, np.array([start]))
        assert (int(after[0]), int(count[0])) == (need, done)


def test_aligned_does_not_depend_on_partitions(spark, monkeypatch):
    docs = random_docs(11, 80, 40, 0.1)
    one = packed_rows(pack_aligned(frame(spark, docs, 1, seed=1), "doc", bos=BOS, eos=EOS, seq_length=8, num_sequences=4))
    # forces range pieces and the shuffled join, as for tables of any size
    monkeypatch.setattr(plans, "PIECE_ROWS", 10)
    monkeypatch.setattr(plans, "BROADCAST_ROWS", 0)
    many = packed_rows(pack_aligned(frame(spark, docs, 7, seed=2), "doc", bos=BOS, eos=EOS, seq_length=8, num_sequences=4))
    assert one == many == walk(docs, 8, 32)


def test_shuffled_packing_keeps_the_tokens_of_each_buffer(spark):
    docs = [[10 * i + 3 + j for j in range(5)] for i in range(40)]
    options = {"bos": BOS, "eos": EOS, "seq_length": 8, "num_sequences": 8}
    plain = pack_aligned(frame(spark, docs), "doc", **options)
    mixed = pack_aligned(frame(spark, docs), "doc", shuffle_seed=3, **options)
    again = pack_aligned(frame(spark, docs, 5, seed=4), "doc", shuffle_seed=3, **options)
    key = ["buffer", "chunk", "position"]
    assert mixed.orderBy(*key).select(*key, "input_ids").collect() == again.orderBy(*key).select(*key, "input_ids").collect()
    count = lambda df: {r.buffer: r["count"] for r in df.groupBy("buffer").count().collect()}
    assert count(plain) == count(mixed)
    assert packed_rows(plain) != packed_rows(mixed)
    assert {r.position for r in mixed.filter("buffer = 0").collect()} == set(range(count(mixed)[0]))


def test_buffers_take_the_crossing_row(spark):
    docs = [[5] * n for n in (3, 3, 1, 9, 2, 2, 2)]
    found = assign_buffers(frame(spark, docs), "doc", seq_length=3, num_sequences=2).orderBy("doc").collect()
    assert [r.buffer for r in found] == [0, 0, 1, 1, 2, 2, 2]


def test_row_longer_than_a_buffer(spark):
    docs = [[7] * 3, [8] * 100, [9] * 5]
    got = packed_rows(pack_aligned(frame(spark, docs), "doc", bos=BOS, eos=EOS, seq_length=10, num_sequences=2))
    assert got == walk(docs, 10, 20)


def test_packing_of_nothing(spark):
    empty = spark.createDataFrame([], "doc int, input_ids array<int>")
    assert packed_rows(pack_aligned(empty, "doc", bos=BOS, eos=EOS, seq_length=4)) == []
    assert pack_fixed(empty, "doc", seq_length=4).count() == 0


@pytest.mark.parametrize("seed,length", [(1, 5), (2, 1), (3, 33)])
def test_fixed_equals_plain_cut(spark, seed, length):
    docs = random_docs(seed, 50, 70, 0.1)
    stream = [t for doc in docs for t in doc]
    want = [stream[i : i + length] for i in range(0, len(stream) - length + 1, length)]
    got = pack_fixed(frame(spark, docs, 6), "doc", seq_length=length).orderBy("chunk").collect()
    assert [r.input_ids for r in got] == want
    assert [r.chunk for r in got] == list(range(len(want)))


def test_fixed_by_group_with_one_hot_group(spark, monkeypatch):
    monkeypatch.setattr(plans, "PIECE_ROWS", 8)
    monkeypatch.setattr(plans, "BROADCAST_ROWS", 0)
    docs = random_docs(5, 90, 20, 0.0)
    group = lambda i: "hot" if i % 3 else f"g{i % 2}"
    rows = [(group(i), i, d) for i, d in enumerate(docs)]
    df = spark.createDataFrame(rows, "g string, doc int, input_ids array<int>")
    got = {}
    for r in pack_fixed(df, "doc", seq_length=6, group="g").orderBy("g", "chunk").collect():
        got.setdefault(r.g, []).append(r.input_ids)
    for name in ("hot", "g0", "g1"):
        stream = [t for g, _, d in rows if g == name for t in d]
        assert got[name] == [stream[i : i + 6] for i in range(0, len(stream) - 5, 6)]


def test_rejects_length_one(spark):
    with pytest.raises(ValueError):
        pack_aligned(frame(spark, [[1]]), "doc", bos=1, eos=2, seq_length=1)


@pytest.mark.parametrize("most, kind", [(32_767, "smallint"), (32_768, "int"), (2**31 - 1, "int")])
def test_tokens_that_fit_two_bytes_are_moved_in_two(spark, monkeypatch, most, kind):
    rows = [(i, [3, most, None, 7][: i % 5] * 3) for i in range(40)] + [(40, None)]
    df = spark.createDataFrame(rows, "k long, input_ids array<int>")
    moved = []
    real = packing.join_back
    monkeypatch.setattr(packing, "join_back", lambda wide, *rest: moved.append(dict(wide.dtypes)["_stream"]) or real(wide, *rest))
    got = packing.pack_aligned(df, "k", bos=1, eos=2, seq_length=8, num_sequences=100)
    assert moved == [f"array<{kind}>"] and dict(got.dtypes)["input_ids"] == "array<int>"
    stream, at, expected = [t for _, ids in rows for t in [*(ids or []), 2, 1]], 0, []
    while at + (take := 8 - (stream[at : at + 1] != [1])) <= len(stream):
        expected.append([1] * (8 - take) + stream[at : at + take])
        at += take
    assert [r.input_ids for r in got.orderBy("chunk").collect()] == expected
