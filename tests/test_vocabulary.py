"""Word ids from a table of all words."""

import random
import re
from collections import Counter

import pytest

from packfold.operators import vocabulary

ROWS = [(i, " ".join(random.Random(i).choices([f"w{k}" for k in range(40)] + ["the", "Ärger", "don't"], k=i % 17))) for i in range(120)]
ROWS += [(500, "the " * 3000 + "once"), (501, ""), (502, None), (503, " ... !")]


def words_of(text):
    return re.findall(r"[\w']+", text or "")


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(ROWS, "k long, text string").repartition(4)


@pytest.mark.parametrize("head", [0, 3, 1000])
def test_ids_of_all_words(spark, texts, head):
    learned = vocabulary.learn_vocabulary(texts)
    counted = Counter(w for _, t in ROWS for w in words_of(t))
    order = sorted(counted, key=lambda w: (-counted[w], w.encode()))
    assert [(r.word, r.id, r.n) for r in learned.orderBy("id").collect()] == [(w, i + 4, counted[w]) for i, w in enumerate(order)]
    number = {w: i + 4 for i, w in enumerate(order)}
    tokens = vocabulary.encode_words(texts, learned, "k", head_words=head)
    got = {r.k: r.input_ids for r in tokens.collect()}
    assert got == {k: None if t is None else [number[w] for w in words_of(t)] for k, t in ROWS}
    back = {r.k: r.text for r in vocabulary.decode_words(tokens, learned, "k").collect()}
    assert back == {k: None if t is None else " ".join(words_of(t)) for k, t in ROWS}


def test_unknown_words_shared_keys_and_empty_tables(spark, texts):
    learned = vocabulary.learn_vocabulary(texts, min_count=50)
    known = {r.word: r.id for r in learned.collect()}
    got = {r.k: r.input_ids for r in vocabulary.encode_words(texts, learned, "k", head_words=1).collect()}
    assert got == {k: None if t is None else [known.get(w, 3) for w in words_of(t)] for k, t in ROWS}
    shared = spark.createDataFrame([(1, "new words"), (1, "other ones")], "k long, text string")
    with pytest.raises(Exception, match="share a key"):
        vocabulary.encode_words(shared, learned, "k").collect()
    empty = spark.createDataFrame([], "k long, text string")
    none = vocabulary.learn_vocabulary(empty)
    assert none.count() == 0 and vocabulary.encode_words(empty, none, "k").count() == 0
    assert {tuple(r.input_ids) for r in vocabulary.encode_words(shared.limit(1), none, "k").collect()} == {(3, 3)}


def test_few_texts_at_once_have_their_words_in_python(spark, monkeypatch):
    setting, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", {}
    before, real = spark.conf.get(setting), vocabulary.materialize
    monkeypatch.setattr(vocabulary, "materialize", lambda df, label: seen.update({label: spark.conf.get(setting)}) or real(df, label))
    rows = spark.createDataFrame([(1, "a b a"), (2, None)], "doc_id long, text string")
    tokens = vocabulary.encode_words(rows, vocabulary.learn_vocabulary(rows), "doc_id")
    assert int(seen["words"]) <= 500 and spark.conf.get(setting) == before
    assert {r.doc_id: r.input_ids for r in tokens.collect()} == {1: [4, 5, 4], 2: None}


@pytest.mark.parametrize("head", [0, 3, 32_000])
def test_only_rare_ids_are_looked_up_by_a_join(spark, texts, head, monkeypatch):
    """Rows are told apart by themselves: keys may repeat or be null, ids may be null or unknown."""
    learned = vocabulary.learn_vocabulary(texts)
    word = {r.id: r.word for r in learned.collect()}
    known = sorted(word)
    ids = [known[:9], known[::-1], None, [], [0, 3, known[0], None, 10**6, known[-1], known[0]], known[:9]]
    rows = list(zip([1, 1, 2, None, None, 3], ids))
    df = spark.createDataFrame(rows, "k long, input_ids array<int>")
    joined = []
    real = vocabulary.lookup_skewed
    monkeypatch.setattr(vocabulary, "lookup_skewed", lambda rows, *rest: joined.append(rows.count()) or real(rows, *rest))
    got = vocabulary.decode_words(df, learned, "k", head_words=head).collect()
    expected = [(k, None if own is None else " ".join(word[i] for i in own if i in word)) for k, own in rows]
    order = lambda found: sorted(found, key=str)
    assert order(tuple(r) for r in got) == order(expected)
    assert joined == [sum(i is not None and (i in word and i >= 4 + head or i == 10**6) for _, own in rows for i in own or ())]
