"""Best fit against a plain one, and the shards' laws."""

import random
import zlib
from collections import Counter, defaultdict

import pytest

from packfold.llm import binpacking, queries

SCHEMA = "doc_id long, text string, shard string, slot long, _total int"


def plain_best_fit(sizes, capacity):
    """Shard of each size, taken one by one, and the room left in each."""
    room, where = [], []
    for size in sizes:
        fits = [(r, i) for i, r in enumerate(room) if r >= size]
        if fits:
            _, i = min(fits)
        else:
            i = len(room)
            room.append(max(capacity, size))
        room[i] -= size
        where.append((size, i))
    return where, room


def test_runs_equal_best_fit_one_by_one():
    rnd = random.Random(2)
    for _ in range(300):
        sizes = sorted((rnd.randint(1, rnd.choice([5, 50, 400])) for _ in range(rnd.randint(0, 120))), reverse=True)
        capacity = rnd.randint(1, 500)
        where, room = plain_best_fit(sizes, capacity)
        runs = binpacking.best_fit(sorted(Counter(sizes).items(), reverse=True), capacity)
        last, expanded = defaultdict(int), []
        for run in runs:
            expanded += [(run.size, run.shard)] * (run.upto - last[run.size])
            last[run.size] = run.upto
        assert Counter(expanded) == Counter(where) and len({s for _, s in expanded}) == len(room)
        assert binpacking.best_fit(sorted(Counter(sizes).items(), reverse=True), capacity, len(room) - 1) is None or not sizes


def test_tree_equals_sorted_list():
    rnd, rooms, known = random.Random(3), binpacking.Rooms(), []
    for step in range(4000):
        if known and rnd.random() < 0.45:
            entry = known.pop(rnd.randrange(len(known)))
            rooms.remove(*entry)
        else:
            entry = (rnd.randint(0, 300), step)
            known.append(entry)
            rooms.add(*entry)
        size = rnd.randint(0, 320)
        assert rooms.tightest(size) == min((e for e in known if e[0] >= size), default=None)

    def depth(t):
        return 0 if t is None else 1 + max(depth(t.left), depth(t.right))

    assert depth(rooms._root) <= 2 * len(known).bit_length()


def test_balanced_with_huge_groups():
    runs = binpacking.balanced([(10_000, 2), (50, 1), (10, 100), (1, 900)], 5)
    load, last = Counter(), Counter()
    for run in runs:
        load[run.shard] += run.size * (run.upto - last[run.size])
        last[run.size] = run.upto
    assert last == {10_000: 2, 50: 1, 10: 100, 1: 900}
    assert sorted(load.values())[3:] == [10_000, 10_000] and max(sorted(load.values())[:3]) <= 652
    assert binpacking.balanced([], 3) == [] and [r.shard for r in binpacking.balanced([(5, 1)], 1)] == [0]


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(4)
    texts = [f"Täxt {i} " * rnd.randint(1, 60) for i in range(600)] + ["", None, "x" * 9000]
    rows = [(i if rnd.random() < 0.97 else None, rnd.choice(texts), "s", 1, 2) for i in range(1500)]
    return rows + rows[:30] + [(9, "hot copy", "s", 1, 2)] * 700


def test_query_keeps_its_laws(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).repartition(6).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op11_bin_packing"](spark, str(tmp_path)).collect()
    size = lambda t: len((t or "").encode()) + 8
    crc = lambda t: zlib.crc32((t or "").encode())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r[0], size(r[1]), crc(r[1])) for r in rows)
    shards = defaultdict(list)
    for r in got:
        shards[r.shard].append(r)
        assert r.law == "bytes" and r.grown_shard is None
    assert set(shards) == set(range(24))
    homes = defaultdict(set)
    for r in got:
        homes[r.text_crc32].add(r.shard)
    assert all(len(h) == 1 for h in homes.values())
    for held in shards.values():
        assert sorted(r.slot for r in held) == list(range(len(held)))
    loads = [sum(r.size for r in held) for held in shards.values()]
    assert max(loads) - min(loads) <= max(Counter({k: sum(r.size for r in got if r.text_crc32 == k) for k in homes}).values())


def test_capacity_and_empty(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    made = binpacking.shard_groups(df, capacity=60_000)
    loads = {r[0]: r[1] for r in made.groupBy("shard").sum("size").collect()}
    groups = Counter()
    for row in rows:
        groups[row[1] or ""] += len((row[1] or "").encode()) + 8
    _, room = plain_best_fit(sorted(groups.values(), reverse=True), 60_000)
    assert len(loads) == len(room) and max(loads.values()) <= 60_000
    empty = spark.createDataFrame([], SCHEMA)
    assert binpacking.shard_groups(empty, shards=24).count() == 0
    with pytest.raises(ValueError):
        binpacking.shard_groups(df)
