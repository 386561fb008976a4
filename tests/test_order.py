"""Ordinals, prefix sums, previous values and the skewed lookup."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from packfold.plans import ordinals as plans
from packfold.plans import skew
from packfold.plans.ordinals import ordinals, previous_value, with_ordinal


@pytest.mark.parametrize("partitions", [None, 1, 7])
def test_ordinals_and_prefix_sums(spark, partitions):
    keys = random.Random(1).sample(range(1000), 300)
    df = spark.createDataFrame([(k, k % 5) for k in keys], "k int, v int").repartition(4)
    frame, rows, totals = ordinals(df, "k", sums={"before": F.col("v")}, partitions=partitions)
    total, want = 0, []
    for i, k in enumerate(sorted(keys)):
        want.append((k, i, total))
        total += k % 5
    assert rows == 300 and totals == {"before": total}
    assert [tuple(r) for r in frame.orderBy("k").select("k", "ordinal", "before").collect()] == want


def test_ordinals_per_group_with_null_group(spark):
    rows = [("a" if i % 3 else None, i) for i in range(40)]
    df = spark.createDataFrame(rows, "g string, k int")
    frame, _, _ = ordinals(df, "k", group="g", partitions=6)
    for name in ("a", None):
        picked = frame.filter(F.col("g").eqNullSafe(F.lit(name))).orderBy("k").collect()
        assert [r.ordinal for r in picked] == list(range(len([1 for g, _ in rows if g == name])))


def test_tied_keys_stop_the_job(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    with pytest.raises(PySparkException, match="not unique"):
        ordinals(df, "k")[0].collect()


def test_with_ordinal_keeps_null_keys(spark):
    df = spark.createDataFrame([(None, "x"), (3, "y"), (1, "z")], "k int, v string")
    got = {r.v: r.ordinal for r in with_ordinal(df, "k").collect()}
    assert got == {"x": 0, "z": 1, "y": 2}


@pytest.mark.parametrize("partitions", [1, 8])
def test_previous_value_with_a_hot_group(spark, partitions):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.7 else f"r{rng.randint(0, 3)}", i, float(rng.randint(0, 9))) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, k int, v double").repartition(5)
    got = {r.k: r.p for r in previous_value(df, "g", "k", "v", "p", partitions).collect()}
    last = {}
    for g, k, v in rows:
        assert got[k] == last.get(g)
        last[g] = v


def test_skewed_lookup_finds_hot_and_cold_keys(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_KEYS", 3)
    rows = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50 + 100).alias("key"))
    table = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("first")).filter("key != 120")
    got = skew.lookup_skewed(rows, table, "key", "n", F.xxhash64("id"))
    assert got.count() == 6000
    want = rows.join(table.drop("n"), "key", "left")
    assert got.select("id", "key", "first").exceptAll(want.select("id", "key", "first")).count() == 0
    assert got.filter("first is null and key != 120").count() == 0


def test_pieces_are_balanced_when_one_group_is_hot(spark):
    df = spark.range(4000).select(F.when(F.col("id") < 3500, "hot").otherwise("cold").alias("g"), F.col("id").alias("k"))
    cut = plans.cut_into_pieces(df, ["g", "k"], partitions=8)
    sizes = [r["count"] for r in cut.groupBy(plans.PIECE).count().collect()]
    assert max(sizes) < 1200 and sum(sizes) == 4000


def test_numbering_is_one_exchange_and_walks_sorted_pieces(spark):
    rows = [(f"g{i % 3}" if i % 5 else None, i * 7 % 1009, i % 4) for i in range(1000)]
    df = spark.createDataFrame(rows, "g string, k int, w int").repartition(6)
    numbered, count, totals = plans.ordinals(df, "k", group="g", carry={"c": F.col("w") + 1}, sums={"run": F.col("w")}, partitions=5)
    assert (count, totals) == (1000, {"run": sum(w for _, _, w in rows)})
    want, runs = {}, {}
    for g, k, w in sorted(rows, key=lambda r: r[1]):
        at, run = runs.get(g, (0, 0))
        want[g, k] = (w + 1, at, run)
        runs[g] = (at + 1, run + w)
    assert {(r.g, r.k): (r.c, r.ordinal, r.run) for r in numbered.collect()} == want
    with pytest.raises(Exception, match="not unique"):
        plans.ordinals(df.union(df.limit(1)), "k", group="g", partitions=5).frame.count()
    with pytest.raises(Exception, match="not unique"):
        plans.ordinals(df, "g", group="g").frame.count()
    nested = df.select(F.struct("g", "k").alias("s"))
    assert sorted(r.ordinal for r in plans.ordinals(nested, "s", partitions=3).frame.collect()) == list(range(1000))


def test_numbering_many_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(500).select(F.pmod("id", F.lit(3)).alias("g"), "id")
        got = {(r.g, r.id): (r.ordinal, r.s) for r in plans.ordinals(df, "id", group="g", sums={"s": F.col("id")}, partitions=3).frame.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {(i % 3, i): (i // 3, sum(range(i % 3, i, 3))) for i in range(500)}
