"""N-gram removal against a plain scan in document order."""

import random

import pytest
from pyspark.sql import functions as F

from packfold.operators import dedup
from packfold.session import materialize
from packfold.plans import skew


def corpus(seed=3, count=60):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 400)}"
    stock = [" ".join(word() for _ in range(rng.randint(1, 30))) for _ in range(15)]
    lines = lambda: [rng.choice(stock) if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randint(1, 25))) for _ in range(rng.randint(1, 6))]
    return [(i, "\n".join(lines())) for i in range(count)]


def grams(line, low, high):
    words = line.lower().split()
    if len(words) < low:
        return []
    if len(words) <= high:
        return [tuple(words)]
    return [tuple(words[i : i + high]) for i in range(len(words) - high + 1)]


def expected(docs, threshold=0.8, low=5, high=5, shard=lambda d: 0):
    first, out = {}, {}
    for d, text in docs:
        for p, line in enumerate(text.split("\n")):
            for g in grams(line, low, high):
                first.setdefault((shard(d), g), (d, p))
    for d, text in docs:
        paras, seen_all, all_ = [], 0, 0
        for p, line in enumerate(text.split("\n")):
            found = grams(line, low, high)
            seen = sum(first[(shard(d), g)] < (d, p) for g in found)
            paras.append((line, bool(found) and seen / len(found) >= threshold))
            seen_all, all_ = seen_all + seen, all_ + len(found)
        out[d] = (paras, bool(all_) and seen_all / all_ >= threshold)
    return out


@pytest.mark.parametrize("mode", dedup.MODES)
@pytest.mark.parametrize("low,high", [(5, 5), (3, 6)])
def test_modes_equal_plain_scan(spark, mode, low, high):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id int, text string").repartition(5)
    got = {r.doc_id: r.text for r in dedup.remove_seen(df, mode=mode, min_size=low, max_size=high).collect()}
    want = {}
    for d, (paras, drop) in expected(docs, low=low, high=high).items():
        if mode != "paragraph" and drop:
            continue
        want[d] = "\n".join(t for t, dup in paras if mode == "document" or not dup)
    assert got == want
    assert 0 < len("".join(got.values())) < sum(len(t) for _, t in docs)


def test_shards_do_not_see_each_other(spark):
    docs = corpus(5)
    df = spark.createDataFrame(docs, "doc_id int, text string")
    marked = dedup.annotate(df, min_size=5, max_size=5, shard=dedup.shard_of("doc_id", 3)).collect()
    want = expected(docs, shard=lambda d: d % 3)
    for r in marked:
        assert [(p.text, p.is_dup) for p in r.paragraphs] == want[r.doc_id][0]
        assert r.doc_dup == want[r.doc_id][1]


@pytest.mark.parametrize("ids", [lambda i: f"name-{i:04d}", lambda i: i * 10**14 - 10**15])
def test_ids_that_cannot_be_packed(spark, ids):
    docs = corpus(7, 30)
    named = spark.createDataFrame([(ids(d), t) for d, t in docs])
    named = named.toDF("doc_id", "text")
    got = {r.doc_id: [p.is_dup for p in r.paragraphs] for r in dedup.annotate(named, min_size=5, max_size=5).collect()}
    for d, (paras, _) in expected(docs).items():
        assert got[ids(d)] == [dup for _, dup in paras]


def test_boilerplate_in_most_documents(spark, monkeypatch):
    """An n-gram that most documents hold takes the broadcast route and still counts everywhere."""
    monkeypatch.setattr(skew, "HOT_KEYS", 2)
    notice = " ".join(f"n{i}" for i in range(14))
    df = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.concat_ws("\n", F.lit(notice), F.concat(F.lit("own "), F.col("id"))).alias("text")
    )
    left = dedup.remove_seen(df, mode="paragraph")
    assert left.filter(F.startswith("text", F.lit("n0"))).count() == 1
    assert left.count() == 3000


def test_empty_and_short_texts_stay(spark):
    df = spark.createDataFrame([(1, ""), (2, None), (3, "a b"), (4, "a b")], "doc_id int, text string")
    assert {r.doc_id: r.text for r in dedup.remove_seen(df).collect()} == {1: "", 2: None, 3: "a b", 4: "a b"}


def test_statistics(spark):
    df = spark.createDataFrame([(1, "a b c d\nx"), (2, "a b c")], "doc_id int, text string")
    row = dedup.ngram_stats(df, exact=True, min_size=2, max_size=2).first()
    assert (row.ngrams, row.distinct_ngrams) == (5, 3)
    assert row.filter_bits == 29


def test_an_id_met_twice_stops_the_job(spark):
    twice = spark.createDataFrame([(1, "a b c"), (1, "a b c")], "doc_id long, text string")
    with pytest.raises(ValueError, match="not unique"):
        dedup.remove_seen(twice, "doc_id", min_size=2, max_size=2)


def executed(df):
    plan = df._jdf.queryExecution().executedPlan()
    return plan.toString()


def test_words_are_matched_once_for_statistics(spark):
    df = spark.createDataFrame([(1, "a b c d\nx")], "doc_id int, text string")
    assert executed(dedup.ngram_stats(df)).count("regexp_extract_all") == 1


def test_ngrams_move_once(spark, monkeypatch):
    """Nothing is joined by n-gram: what one shuffle finds comes back as counts by position."""
    written = []

    def noted(df, label):
        written.append((label, df.columns))
        return materialize(df, label)

    monkeypatch.setattr(dedup, "materialize", noted)
    df = spark.createDataFrame([(1, "a b c"), (2, "a b c\nz b c")], "doc_id long, text string")
    verdicts = dedup.paragraph_verdicts(df, min_size=2, max_size=2)
    assert [label for label, _ in written] == ["grams", "seen"]
    found = {r.doc_id: [tuple(x) for x in r._counted] for r in verdicts.collect()}
    assert found == {1: [(0, 2, 0)], 2: [(0, 2, 2), (1, 2, 1)]}


@pytest.mark.parametrize("pieces", [1, 3, 16])
def test_an_ngram_cut_into_pieces(spark, monkeypatch, pieces):
    """Most rows hold one n-gram, so pieces begin and end inside it."""
    monkeypatch.setattr(dedup, "piece_count", lambda spark, rows: pieces)
    texts = [(i, "a b\na b a b" if i % 7 else f"x{i % 3} y") for i in range(200)] + [(None, "a b"), (None, "x0 y")]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    firsts, wanted = {}, {}
    for i, text in texts:
        for para, line in enumerate(text.split("\n")):
            words = line.split()
            grams = list(zip(words, words[1:]))
            seen = 0 if i is None else sum(firsts.setdefault(g, (i, para)) < (i, para) for g in grams)
            old = wanted.setdefault(i, {}).get(para, (0, 0))
            wanted[i][para] = (old[0] + len(grams), old[1] + seen)
    verdicts = dedup.paragraph_verdicts(df, min_size=2, max_size=2).collect()
    assert {r.doc_id: {x.para: (x.ngrams, x.seen) for x in r._counted} for r in verdicts} == wanted
