"""Tokenizers, chats, padding, mixing, grouping and embedding on small known inputs."""

import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from packfold.functions import text as tx
from packfold.functions.arrays import round_up
from packfold.functions.encoders import HashEncoder, ModelEncoder
from packfold.functions.tokenizers import ByteTokenizer, FileTokenizer, WordTokenizer
from packfold.operators import chat, embedding, grouping, mixing, padding, perplexity, selecting, tokenizing

TOKENIZER = ByteTokenizer()
TEXTS = ["plain words", "naïve çà 漢字 🎉", "", "\n tabs\t", "x" * 5000]


def texts_frame(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)) + [(99, None)], "k int, text string")


@pytest.fixture(scope="module")
def tokenizer_file(tmp_path_factory):
    from tokenizers import Tokenizer, decoders, models, pre_tokenizers, processors, trainers

    native = Tokenizer(models.BPE())
    native.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    native.decoder = decoders.ByteLevel()
    trainer = trainers.BpeTrainer(vocab_size=400, special_tokens=["<s>", "</s>"], initial_alphabet=pre_tokenizers.ByteLevel.alphabet())
    native.train_from_iterator(TEXTS * 3, trainer)
    native.post_processor = processors.TemplateProcessing(single="<s> $A", special_tokens=[("<s>", 0)])
    path = str(tmp_path_factory.mktemp("tok") / "tokenizer.json")
    native.save(path)
    return path


@pytest.mark.parametrize("specials", [False, True])
def test_byte_round_trip(spark, specials):
    tokens = tokenizing.tokenize(texts_frame(spark), TOKENIZER, add_special_tokens=specials)
    back = tokenizing.decode(tokens, TOKENIZER, output_column="back").collect()
    for r in back:
        assert r.back == r.text
        want = None if r.text is None else [1] * specials + [b + 3 for b in r.text.encode()]
        assert r.input_ids == want and r.token_count == len(want or [])


@pytest.mark.parametrize("specials", [False, True])
def test_file_tokenizer_round_trip(spark, tokenizer_file, specials):
    tokenizer = FileTokenizer(tokenizer_file)
    tokens = tokenizing.tokenize(texts_frame(spark).repartition(2), tokenizer, add_special_tokens=specials)
    for r in tokenizing.decode(tokens, tokenizer, output_column="back").collect():
        assert r.back == r.text
        if r.text and specials:
            assert r.input_ids[0] == tokenizer.bos_id
    assert tokenizer.pad_id == tokenizer.eos_id
    each = spark.createDataFrame([(["a b", "", "ç"],), ([],), (None,)], "t array<string>")
    got = [r.ids for r in each.select(tokenizer.encode_each("t").alias("ids")).collect()]
    assert [len(x) if x is not None else None for x in got] == [3, 0, None]


def test_word_tokenizer(spark):
    df = spark.createDataFrame([("a b a c",), ("b a. zzz",)], "text string")
    tokenizer = WordTokenizer.learn(df, "text", 2)
    assert tokenizer.vocabulary == ["a", "b"]
    rows = df.select(tokenizer.encode("text").alias("i"), tokenizer.decode(tokenizer.encode("text")).alias("t")).collect()
    assert [r.i for r in rows] == [[4, 5, 4, 3], [5, 4, 3]]
    assert rows[0].t == "a b a"
    assert df.select(tokenizer.encode_each(F.array("text")).alias("i")).first().i == [[4, 5, 4, 3]]


def test_output_names_and_guards(spark):
    df = texts_frame(spark)
    assert "text_input_ids" in tokenizing.tokenize(df, TOKENIZER, output_column=None).columns
    with pytest.raises(ValueError, match="dataset already contains column k"):
        tokenizing.tokenize(df, TOKENIZER, output_column="k")
    with pytest.raises(ValueError, match="dataset already contains column k"):
        tokenizing.tokenize(df, TOKENIZER, counts_column="k")
    with pytest.raises(ValueError):
        tokenizing.tokenize(df, TOKENIZER, column="absent")
    with pytest.raises(ValueError):
        selecting.forbid_columns(df, "text")
    with pytest.warns(UserWarning):
        selecting.warn_missing(df, "absent")
    assert "token_count" not in tokenizing.tokenize(df, TOKENIZER, counts_column=None).columns
    assert tokenizing.total_tokens(df, None).first().tokens == -1


def test_cap_runs_before_the_tokenizer(spark):
    capped = tokenizing.tokenize(texts_frame(spark), TOKENIZER, max_records=2, order_by="k")
    plan = capped._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("Join")
    with pytest.raises(ValueError, match="order"):
        tokenizing.tokenize(texts_frame(spark), TOKENIZER, max_records=2)
    assert [r.k for r in capped.orderBy("k").collect()] == [0, 1]


def test_heads(spark):
    df = spark.range(50).withColumnRenamed("id", "k").repartition(3)
    assert selecting.head(df, None, "k").count() == selecting.head(df, 500, "k").count() == 50
    assert sorted(r.k for r in selecting.head(df, 12, "k").collect()) == list(range(12))
    for count in (2, 90):
        with pytest.raises(Exception, match="not unique"):
            selecting.head(df.union(df), count, "k").collect()


def test_unwrap_splits(spark):
    one = spark.createDataFrame([(1, "train"), (2, "train")], "k int, split string")
    two = spark.createDataFrame([(1, "train"), (2, "test")], "k int, split string")
    assert selecting.unwrap_single_split(one).columns == ["k"]
    assert selecting.unwrap_single_split(two).columns == ["k", "split"]


CHAT = [("user", "Hi"), ("assistant", "hello")]
SMOL_TEXT = (
    "<|im_start|>system\nYou are a helpful AI assistant named SmolLM, trained by Hugging Face<|im_end|>\n"
    "<|im_start|>user\nHi<|im_end|>\n<|im_start|>assistant\nhello<|im_end|>\n"
)
LLAMA_TEXT = (
    "<s><|start_header_id|>system<|end_header_id|>\n\nCutting Knowledge Date: December 2023\nToday Date: 04 Nov 2024\n\n"
    "<|eot_id|><|start_header_id|>user<|end_header_id|>\n\nHi<|eot_id|>"
    "<|start_header_id|>assistant<|end_header_id|>\n\nhello<|eot_id|>"
)


def chats(spark, *rows):
    return spark.createDataFrame([(list(r),) for r in rows], f"messages {chat.MESSAGES}")


@pytest.mark.parametrize("template,text", [(chat.SMOL, SMOL_TEXT), (chat.LLAMA, LLAMA_TEXT)])
def test_chat_text_and_mask(spark, template, text):
    row = chat.render_chats(chats(spark, CHAT), template, TOKENIZER).first()
    assert row.text == text
    body = text.removeprefix("<s>")
    ids = [b + 3 for b in body.encode()]
    assert row.input_ids == [1] * template.add_bos + ids
    kept = [x for x in row.label if x != -100]
    last = "<|im_start|>assistant" if template is chat.SMOL else "<|start_header_id|>assistant"
    assert kept == [b + 3 for b in body[body.rindex(last) :].encode()]
    assert len(row.label) == len(row.input_ids)


def test_chat_that_starts_with_system(spark):
    row = chat.render_chats(chats(spark, [("system", "S"), *CHAT]), chat.SMOL, TOKENIZER).first()
    assert row.text.startswith("<|im_start|>system\nS<|im_end|>\n") and "SmolLM" not in row.text


def test_unknown_role_and_missing_default(spark):
    with pytest.raises(PySparkException, match="role tool is not implemented"):
        chat.render_chats(chats(spark, [("tool", "x")]), chat.SMOL, TOKENIZER).collect()
    bare = chat.ChatTemplate(chat.render_smol, None, False)
    with pytest.raises(PySparkException, match="no default system"):
        chat.render_chats(chats(spark, CHAT), bare, TOKENIZER).collect()
    known, rejected = selecting.split_by_role(spark.createDataFrame([("user",), ("tool",), (None,)], "role string"))
    assert (known.count(), rejected.count()) == (1, 2)


def test_pairs(spark):
    df = spark.createDataFrame([("p", "c")], "prompt string, completion string")
    text = chat.render_pairs(df, chat.SMOL, TOKENIZER, system_prompt="be kind").first().text
    assert text.count("<|im_start|>system") == 1
    assert "<|im_start|>user\nbe kind<|im_end|>\n<|im_start|>user\np<|im_end|>\n<|im_start|>assistant\nc" in text
    own = chat.render_pairs(df, chat.SMOL, TOKENIZER, system_prompt="be kind", system_role="system").first().text
    assert own.startswith("<|im_start|>system\nbe kind")


def test_conformance_reports_a_difference(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id int, turn int, role string, text string")
    assert chat.conformance(turns, chat.LLAMA, TOKENIZER, fraction=1.0).count() == 0

    class Broken(ByteTokenizer):
        def encode_each(self, texts):
            return F.transform(super().encode_each(texts), lambda ids: F.concat(ids, F.array(F.lit(2))))

    assert chat.conformance(turns, chat.SMOL, Broken(), fraction=1.0).count() == 1


def test_padding_of_a_batch(spark):
    rows = [(0, [1, 2, 3], [1, 2, -100]), (1, [21, 22, 23, 24, 25, 26], [21, 22, 23, -24, -100, -100]), (2, [31, 32], [31, 32])]
    df = spark.createDataFrame(rows, "k int, input_ids array<int>, label array<int>")
    got = padding.pad_with_labels(df, "k", 2, multiple=None).orderBy("k").collect()
    assert [r.input_ids for r in got] == [[1, 2, 3, 2, 2, 2], [21, 22, 23, 24, 25, 26], [31, 32, 2, 2, 2, 2]]
    assert [r.attention_mask for r in got] == [[1, 1, 1, 0, 0, 0], [1] * 6, [1, 1, 0, 0, 0, 0]]
    assert [r.labels for r in got] == [[1, 2, -100, -100, -100, -100], [21, 22, 23, -24, -100, -100], [31, 32] + [-100] * 4]
    wide = padding.pad_with_labels(df, "k", 2, batch_size=2).collect()
    assert {len(r.input_ids) for r in wide} == {64}


def test_lm_padding_masks_every_pad_and_drops_the_last_batch(spark):
    df = spark.createDataFrame([(i, [5, 0, i + 1]) for i in range(5)], "k int, input_ids array<int>")
    got = padding.pad_for_lm(df, "k", 0, batch_size=2).orderBy("k").collect()
    assert [r.k for r in got] == [0, 1, 2, 3]
    assert got[1].labels == [5, -100, 2] + [-100] * 13


def test_interleave_stops_at_the_first_exhausted_source(spark):
    a = spark.range(30).select(F.col("id").alias("k"), F.lit("a").alias("s"))
    b = spark.range(100, 400).select(F.col("id").alias("k"), F.lit("b").alias("s"))
    got = mixing.interleave([a, b], [0.5, 0.5], "k").orderBy("draw").collect()
    assert [r.draw for r in got] == list(range(len(got)))
    assert [r.k for r in got if r.s == "a"] == list(range(30))
    assert [r.k for r in got if r.s == "b"] == list(range(100, 100 + len(got) - 30))
    with pytest.raises(ValueError):
        mixing.interleave([a, b], [0.5, 0.6], "k")


def test_shards_and_epochs(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    sizes = {r.shard_id: r["count"] for r in mixing.assign_shards(df, "k", 4).groupBy("shard_id").count().collect()}
    assert sizes == {0: 3, 1: 3, 2: 2, 3: 2}
    assert mixing.assign_shards(df, "k", 50).select("shard_id").distinct().count() == 10
    assert mixing.repeat_epochs(df, 3).groupBy("epoch").count().count() == 3


def test_groups_and_buckets(spark):
    df = spark.createDataFrame([("A", 1), ("B", 2), ("A", 3), ("C", 4), ("B", 5), (None, 6)], "category string, value bigint")
    summary = grouping.group_summary(df, "category", "value").orderBy("first_row").collect()
    assert [(r.group_id, r["rows"]) for r in summary] == [("A", 2), ("B", 2), ("C", 1), ("__NULL__", 1)]
    assert grouping.group_summary(df, "category", "value", drop_null=True).count() == 3
    views = grouping.groups(df, "category", ["A", "B", "C"])
    assert [views[k].count() for k in "ABC"] == [2, 2, 1]
    bucketed = grouping.bucket_by(df, "category", 2).filter("category is not null")
    assert bucketed.count() == 5 and bucketed.select("bucket_id").distinct().count() <= 2
    ids = spark.createDataFrame([(i, i * 10) for i in (1, 2, 3, 4)], "id int, value int")
    rows = {r.bucket_id: r["count"] for r in grouping.bucket_by(ids, "id", 2).groupBy("bucket_id").count().collect()}
    assert rows == {"0": 2, "1": 2}


def test_human_readable(spark):
    expected = {
        0.0: "0.00e+00", 0.5: "500.00m", -0.5: "-500.00m", 1.0: "1000.00m", 7.0: "7.00", 1000.0: "1000.00", 1001.0: "1.00K",
        -2675.0: "-2.67K", 123456.0: "123.46K", 1e6: "1000.00K", 2.5e9: "2.50G", 7.25e12: "7.25T", 1e18: "1000.00P",
        2.675: "2.67", 5e-7: "5.00e-07", 2e-6: "2.00u", 1e-6: "1.00e-06",
    }
    df = spark.createDataFrame([(n,) for n in expected], "n double")
    assert {r.n: r.s for r in df.select("n", tx.human_readable(F.col("n")).alias("s")).collect()} == expected


def test_scalars(spark):
    row = spark.range(1).select(
        tx.tsv_safe(F.lit("a\tb\nc")).alias("tsv"),
        tx.file_url(F.lit("datasets/o/g/socratic/t.parquet"), "datasets/o/g").alias("url"),
        tx.file_url(F.lit("other/t.parquet"), "datasets/o/g").alias("kept"),
        tx.numbered_path("f-{i}.txt", F.lit(3)).alias("path"),
        tx.numbered_path("a{i:05d}b{i:2d}", F.lit(123)).alias("padded"),
        tx.stripped(F.lit(" \t x \r\n")).alias("strip"),
        round_up(F.lit(65), 64).alias("up"),
        tx.json_line(F.struct(F.lit(None).cast("int").alias("a"), F.lit("é").alias("b"))).alias("json"),
    ).first()
    assert row.tsv == "a    b<br>c" and row.path == "f-3.txt" and row.padded == "a00123b123" and row.strip == "x" and row.up == 128
    assert row.url == "https://huggingface.co/datasets/o/g/resolve/main/socratic/t.parquet" and row.kept == "other/t.parquet"
    assert row.json == '{"a":null,"b":"é"}'


def test_embedding(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None)], "k int, text string")
    rows = {r.k: r.embedding for r in embedding.embed(df, HashEncoder(8)).collect()}
    assert math.isclose(sum(x * x for x in rows[1]), 1.0, rel_tol=1e-6)
    assert rows[2] == [0.0] * 8 and rows[3] is None

    def load():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    model = {r.k: r.embedding for r in embedding.embed(df.filter("text is not null"), ModelEncoder(load, 1)).collect()}
    assert model[2] == [0.0, 1.0] and math.isclose(model[1][0], 5 / math.sqrt(26), rel_tol=1e-6)


def test_epochs_and_ties(spark):
    with pytest.raises(ValueError):
        mixing.repeat_epochs(spark.range(2), 0)
    assert mixing.repeat_epochs(spark.range(2), 3).count() == 6
    tied = spark.createDataFrame([("r", 1, 1.0), ("r", 1, 2.0)], "run_id string, step int, loss double")
    with pytest.raises(Exception, match="not unique"):
        perplexity.perplexity_series(tied).collect()


def test_models_are_loaded_once_a_worker(spark, tmp_path):
    folder = str(tmp_path)

    def load():
        import os
        import uuid

        open(os.path.join(folder, f"{os.getpid()}-{uuid.uuid4().hex}"), "w").close()
        return lambda texts: np.ones((len(texts), 2))

    rows = spark.range(40).selectExpr("id", "string(id) AS text").repartition(12)
    assert embedding.embed(rows, ModelEncoder(load)).select("embedding").collect()
    loads = [f.name.split("-")[0] for f in tmp_path.iterdir()]
    assert loads and len(loads) == len(set(loads))


def test_perplexity_limits(spark):
    log = [("r", 1, 1.0), ("r", 2, None), ("r", 3, 5.0), ("r", 4, 2.0)]
    got = perplexity.perplexity_series(spark.createDataFrame(log, "run_id string, step int, loss double")).orderBy("step").collect()
    assert [r.step for r in got] == [1, 3, 4]
    assert math.isclose(got[0].delta_ppl, -math.e) and got[1].perplexity is None
    assert math.isclose(got[2].delta_ppl, math.exp(5) - math.exp(2))


def test_groups_in_order_of_first_appearance(spark):
    rows = [(1, "b"), (2, None), (3, "a"), (4, "b"), (5, ""), (6, "7"), (7, "a/b=c"), (8, None)] + [(i, "hot") for i in range(10, 2500)]
    df = spark.createDataFrame(rows, "k long, name string").repartition(4)
    split = grouping.group_by(df, "name", "k")
    assert split.keys() == ["b", "__NULL__", "a", "", "7", "a/b=c", "hot"]
    assert {key: sorted(r.k for r in split[key].collect())[:2] for key in split.keys()} == {
        "b": [1, 4], "__NULL__": [2, 8], "a": [3], "": [5], "7": [6], "a/b=c": [7], "hot": [10, 11],
    }
    assert split["hot"].columns == ["k", "name"] and split["hot"].count() == 2490 and split.rows.count() == len(rows)
    assert "group_no=3" in split[""].inputFiles()[0] or "PartitionFilters: [isnotnull(group_no" in split[""]._jdf.queryExecution().toString()
    with pytest.raises(KeyError):
        split["none"]
    assert grouping.group_by(df, "name", "k", drop_null=True).keys()[:2] == ["b", "a"]


def test_functions_get_rows_in_batches(spark, tmp_path):
    from packfold.plans import jobs

    class Counting(ByteTokenizer):
        def _encoder(self, add_special_tokens):
            encode = super()._encoder(add_special_tokens)

            def checked(texts):
                assert len(texts) <= 7
                return encode(texts)

            return checked

    spark.range(100).selectExpr("cast(id as string) AS text").coalesce(1).write.parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert jobs.tokenize_table(spark, Counting(), str(tmp_path / "in"), str(tmp_path / "out"), batch_size=7) == 190
    with pytest.raises(PySparkException):
        jobs.tokenize_table(spark, Counting(), str(tmp_path / "in"), str(tmp_path / "more"), batch_size=8)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_padding_for_lm_moves_one_array(spark, monkeypatch):
    written = []
    real = padding.materialize
    monkeypatch.setattr(padding, "materialize", lambda df, label: written.append(df.columns) or real(df, label))
    rows = spark.createDataFrame([(i, [5] * (i + 1)) for i in range(4)], "k int, input_ids array<int>")
    padded = padding.pad_for_lm(rows, "k", 0, batch_size=4, multiple=4)
    assert written == [["k", "input_ids"]]
    assert {r.k: r["labels"] for r in padded.collect()} == {i: [5] * (i + 1) + [-100] * (3 - i) for i in range(4)}


def test_longest_row_from_lengths(spark):
    rows = spark.createDataFrame([(1, 0, 3), (2, 0, 9), (3, 1, None)], "k int, b int, n int")
    assert {r.k: r.longest for r in grouping.longest_in(rows, "b", length="n").collect()} == {1: 9, 2: 9, 3: None}
