"""Scans, sinks, manifests, whole jobs and streams."""

import os

import pytest
from pyspark.sql import functions as F

from packfold.functions.tokenizers import ByteTokenizer
from packfold.plans import jobs
from packfold.sources import manifests, readers, writers
from packfold.streaming import jobs as streams

TOKENIZER = ByteTokenizer()


def strings(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "k int, value string").repartition(2)


@pytest.mark.parametrize(
    "fmt,content,want",
    [
        ("list:json", "/p/a.json\n/p/b.json", (["/p/a.json", "/p/b.json"], "json")),
        ("list:", "/p/a.txt\n/p/b.txt", (["/p/a.txt", "/p/b.txt"], "")),
        ("list:csv", "", ([], "csv")),
        ("csv", None, None),
    ],
)
def test_manifest_parsing(spark, tmp_path, fmt, content, want):
    path = tmp_path / "m.txt"
    if content is not None:
        path.write_text(content)
    assert manifests.load_file_list(spark, str(path), fmt) == want


def test_manifest_errors(spark, tmp_path):
    with pytest.raises(ValueError, match="expected format list:<format>, found list:json:extra"):
        manifests.load_file_list(spark, "x", "list:json:extra")
    with pytest.raises(FileNotFoundError):
        manifests.load_file_list(spark, str(tmp_path / "nonexistent.txt"), "list:json")


def test_catalogue_prefix_recursion_and_manifest(spark, tmp_path):
    for name in ("a/x.parquet", "a/b/y.parquet", "a/b/z.json", "c/w.parquet"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("content is not read")
    found = lambda **options: sorted(
        r.path.rsplit("/", 1)[1] for r in manifests.catalogue(spark, str(tmp_path), **options).collect()
    )
    assert found(recursive=True) == ["w.parquet", "x.parquet", "y.parquet"]
    assert found(prefix="a") == ["x.parquet"]
    assert found(prefix="a/b", fmt="json") == ["z.json"]
    out = writers.catalogue_to_manifest(spark, str(tmp_path), str(tmp_path / "m"), recursive=True, prefix="a")
    assert len(manifests.read_manifest(spark, out)) == 2
    plan = manifests.catalogue(spark, str(tmp_path), prefix="a")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]


def test_catalogue_of_all_folders_is_listed_by_tasks(spark, tmp_path):
    names = ["a/x y.txt", "a/b/%41é.txt", "a/b/empty.txt", "a/_hidden.txt", "a/.b/z.txt", "a/_c/z.txt", "a/_d=1/z.txt", "a/other.csv", "a/dir.txt/w.txt"]
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("" if "empty" in name else name)
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true")
    expected = reader.load(f"{tmp_path}/a").select("path", "length", "modificationTime")
    got = manifests.catalogue(spark, str(tmp_path), fmt="txt", prefix="a", recursive=True)
    assert got.schema.names == expected.schema.names and got.dtypes == expected.dtypes
    assert sorted(got.collect()) == sorted(expected.collect()) and got.count() == 4
    # Spark's own scan opens a split for every few files
    assert "binaryFile" not in got._jdf.queryExecution().toString()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        manifests.catalogue(spark, str(tmp_path), prefix="none", recursive=True)


def test_scan_pushes_filter_and_columns(spark, small):
    df = readers.load(spark, f"{small}/documents.parquet").filter("n_chars > 100").select("doc_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(n_chars,100)" in plan and "ReadSchema: struct<doc_id:bigint,n_chars:bigint>" in plan


def test_filter_goes_below_the_tokenizer_and_unused_tokens_are_not_made(spark, small):
    from packfold.operators.tokenizing import tokenize

    tokens = tokenize(readers.load(spark, f"{small}/documents.parquet"), TOKENIZER)
    plan = tokens.filter("lang = 'en'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,en)" in plan
    unused = tokens.select("doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in unused and "text" not in unused.split("ReadSchema")[1]


def test_tokenize_job_over_a_manifest(spark, tmp_path):
    prompts = [f"This is sentence number {i}." for i in range(20)]
    paths = []
    for name, part in (("a", prompts[:12]), ("b", prompts[12:])):
        path = str(tmp_path / name)
        spark.createDataFrame([(p,) for p in part], "prompt string").coalesce(1).write.parquet(path)
        paths += [r.path for r in manifests.catalogue(spark, path).collect()]
    listing = tmp_path / "list.txt"
    listing.write_text("\n".join(paths) + "\n\n")
    out = str(tmp_path / "out")
    total = jobs.tokenize_table(
        spark, TOKENIZER, str(listing), out, input_format="list:parquet", column="prompt", output_column="", add_special_tokens=True
    )
    saved = spark.read.parquet(out)
    assert set(saved.columns) == {"prompt", "prompt_input_ids", "token_count"}
    assert total == sum(len(p) + 1 for p in prompts)
    decoded = saved.select(TOKENIZER.decode("prompt_input_ids").alias("t"))
    assert sorted(r.t for r in decoded.collect()) == sorted(prompts)
    with pytest.raises(FileExistsError):
        jobs.tokenize_table(spark, TOKENIZER, str(listing), out, input_format="list:parquet", column="prompt")
    ordered = readers.in_file_order(paths, spark).orderBy("file_no", "row_no").collect()
    assert [r.prompt for r in ordered] == prompts


def test_listed_files_of_every_kind(spark, tmp_path):
    """Plain paths, a space in a name, a folder, a glob, a file listed twice, formats by ending."""
    for name, rows in (("a b", [1, 2]), ("dir/x", [3]), ("dir/y", [4])):
        spark.createDataFrame([(r,) for r in rows], "v long").coalesce(1).write.parquet(str(tmp_path / name))
    (tmp_path / "z.jsonl").write_text('{"v": 9}\n')
    listed = [str(tmp_path / "a b"), str(tmp_path / "dir" / "*"), str(tmp_path / "a b")]
    df = readers.load_many(spark, listed, "parquet", ordinal="place")
    assert sorted((r.place, r.v) for r in df.collect()) == [(0, 1), (0, 2), (1, 3), (1, 4), (2, 1), (2, 2)]
    assert readers.load_many(spark, listed, "parquet").count() == 6
    ordered = readers.in_file_order([str(tmp_path / "dir" / "y"), str(tmp_path / "a b")], spark).orderBy("file_no", "row_no")
    assert [r.v for r in ordered.collect()] == [4, 1, 2]
    (tmp_path / "t.txt").write_text("line\n")
    mixed = readers.load_many(spark, [str(tmp_path / "t.txt"), str(tmp_path / "z.jsonl")], ordinal="place")
    assert {(r.place, r.value, r.v) for r in mixed.collect()} == {(0, "line", None), (1, None, 9)}
    with pytest.raises(FileNotFoundError):
        readers.in_file_order([str(tmp_path / "dir"), str(tmp_path / "no*.parquet")], spark)


def test_save_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "b")], "k int, v string")
    path = str(tmp_path / "d")
    writers.save(df, path, "json")
    assert spark.read.text(path).filter("value like '%null%'").count() == 1
    with pytest.raises(FileExistsError):
        writers.save(df, path, "json")
    writers.save(df, path, "json", overwrite=True)
    with pytest.raises(ValueError, match="unsupported"):
        writers.save(df, path, "avro")
    assert readers.load(spark, path, "json", schema="k int, v string").count() == 2


def test_splits_and_single_split(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "test")], "k int, split string")
    both, one = str(tmp_path / "both"), str(tmp_path / "one")
    writers.save_splits(df, both)
    writers.save_splits(df.filter("split = 'train'"), one)
    assert sorted(os.listdir(both))[-2:] == ["split=test", "split=train"]
    assert readers.load(spark, both, "splits").columns == ["k", "split"]
    assert readers.load(spark, one, "splits").columns == ["k"]
    assert readers.load(spark, one, "splits", unwrap=False).columns == ["k", "split"]


LETTERS = ["é", "two\nlines", ""]


@pytest.mark.parametrize("numbers,first", [(3, 0), (range(7, 10), 7), ((4, 99), 4)])
def test_numbered_files_hold_one_row_each(spark, tmp_path, numbers, first):
    writers.write_many(strings(spark, LETTERS), "k", numbers, str(tmp_path / "part-{i}"))
    assert {f: (tmp_path / f).read_text() for f in os.listdir(tmp_path)} == {f"part-{first + i}": x for i, x in enumerate(LETTERS)}


def test_rows_and_numbers_end_together(spark, tmp_path):
    writers.write_many(strings(spark, LETTERS), "k", [11, 5], str(tmp_path / "{i}.x"))
    assert (tmp_path / "11.x").read_text() == LETTERS[0] and sorted(os.listdir(tmp_path)) == ["11.x", "5.x"]
    for wrong, kind in ((("n", "{i}"), TypeError), ((2, "same"), ValueError)):
        with pytest.raises(kind):
            writers.write_many(strings(spark, LETTERS), "k", wrong[0], str(tmp_path / wrong[1]))
    assert len(os.listdir(tmp_path)) == 2


def test_own_writer_gets_value_and_path(spark, tmp_path):
    def shout(value, output_file, ending):
        with open(output_file, "w") as out:
            out.write(value.upper() + ending)

    writers.write_many(strings(spark, ["ab"]), "k", 1, str(tmp_path / "{i}"), writer=shout, ending="!")
    writers.write_many(spark.createDataFrame([], "k int, value string"), "k", 4, str(tmp_path / "none{i}"))
    assert {f: (tmp_path / f).read_text() for f in os.listdir(tmp_path)} == {"0": "AB!"}


def test_many_numbered_files(spark, tmp_path):
    writers.write_many(spark.range(600).selectExpr("id AS k", "hex(id) AS value"), "k", 600, str(tmp_path / "{i}"))
    assert all((tmp_path / str(i)).read_text() == f"{i:X}" for i in range(0, 600, 37)) and len(os.listdir(tmp_path)) == 600


def test_lines(spark, tmp_path):
    path = str(tmp_path / "lines")
    writers.write_lines(strings(spark, ["b", "a"]), path)
    assert sorted(r.value for r in readers.read_lines(spark, path).collect()) == ["a", "b"]
    (tmp_path / "one.txt").write_text("  first \nsecond\n")
    first = readers.read_lines(spark, str(tmp_path / "one.txt"), split_lines=False).collect()
    assert [r.value for r in first] == ["first"]
    raw = readers.read_lines(spark, str(tmp_path / "one.txt"), strip=False).first().value
    assert raw == "  first "


def test_vector_export(spark, tmp_path):
    df = spark.createDataFrame([(i, [float(i), 0.5], f"l\t{i}") for i in range(4)], "k int, embedding array<float>, name string")
    out = str(tmp_path / "v")
    writers.export_vectors(df, out, labels=["k", "name"], order_by="k")
    with pytest.raises(FileExistsError):
        writers.export_vectors(df, out, labels=["k"])
    lines = sorted(r.value for r in spark.read.text(f"{out}/vectors").collect())
    assert lines[1] == "1.0\t0.5"
    meta = spark.read.option("sep", "\t").option("header", True).csv(f"{out}/metadata")
    assert sorted(r.name for r in meta.collect())[0] == "l    0"


def test_make_constant_by_split(spark, tmp_path):
    rows = [(i, "train" if i % 4 else "test", "abcdefgh") for i in range(20)]
    df = spark.createDataFrame(rows, "k int, split string, text string")
    packed = jobs.make_constant(df, TOKENIZER, "k", seq_length=9)
    assert {r.split: r["count"] for r in packed.groupBy("split").count().collect()} == {"train": 15, "test": 5}
    assert packed.filter(F.get("input_ids", F.lit(0)) != 1).count() == 0
    capped = jobs.make_constant(df, TOKENIZER, "k", seq_length=9, max_records=2, output_dir=str(tmp_path / "p"))
    assert spark.read.parquet(capped).groupBy("split").count().filter("count = 2").count() == 2


def drop(df, folder, name):
    df.coalesce(1).write.mode("append").parquet(folder)


def test_streaming_perplexity_carries_over_and_restarts(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "run_id string, step int, loss double"
    drop(spark.createDataFrame([("a", 1, 1.0), ("b", 1, 2.0)], schema), source, "0")
    run = lambda: streams.stream_perplexity(readers.read_stream(spark, source, schema, max_files=1), out).awaitTermination()
    run()
    drop(spark.createDataFrame([("a", 2, 0.5), ("c", 1, 1.0)], schema), source, "1")
    run()
    import math

    got = {(r.run_id, r.step): r.delta_ppl for r in spark.read.parquet(f"{out}/data").collect()}
    assert len(got) == 4
    assert math.isclose(got["a", 2], math.e - math.exp(0.5)) and math.isclose(got["c", 1], -math.e)


@pytest.mark.parametrize("at_once", [1, 2, 100])
def test_streaming_pack_equals_packing_all(spark, tmp_path, at_once):
    from packfold.operators.packing import pack_aligned

    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    parts = [spark.createDataFrame([(10 * b + i, [5 + i] * (7 + i)) for i in range(6)], "k int, input_ids array<int>") for b in range(4)]
    for i, part in enumerate(parts):
        drop(part, source, str(i))
    options = {"bos": 1, "eos": 2, "seq_length": 8, "num_sequences": 2}
    stream = readers.read_stream(spark, source, parts[0].schema, max_files=at_once)
    streams.stream_packed(stream, "k", out, **options).awaitTermination()
    streams.close_packed(spark, "k", out, parts[0].schema, **options)
    whole = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    rows = lambda df: sorted((r.buffer, r.chunk, list(r.input_ids)) for r in df.collect())
    assert rows(spark.read.parquet(f"{out}/data")) == rows(pack_aligned(whole, "k", **options))


def test_streaming_pack_parts_rows_without_a_join(spark, tmp_path, monkeypatch):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "a int, b string, input_ids array<int>"
    keys = [(None, None), (None, "x"), (1, None), (1, "x"), (1, "y"), (2, None), (3, "z")]
    drop(spark.createDataFrame([(a, b, [5] * 9) for a, b in keys], schema), source, "0")
    seen, real = [], streams.pack_aligned

    def pack(df, *rest, **options):
        seen.append((df._jdf.queryExecution().optimizedPlan().toString(), sorted(map(str, df.select("a", "b").collect()))))
        return real(df, *rest, **options)

    monkeypatch.setattr(streams, "pack_aligned", pack)
    options = {"bos": 1, "eos": 2, "seq_length": 8, "num_sequences": 2}
    stream = readers.read_stream(spark, source, schema, max_files=1)
    streams.stream_packed(stream, ["a", "b"], out, **options).awaitTermination()
    ((plan, full),) = seen
    # two rows fill a buffer, and the last one stays open
    assert "Join" not in plan and len(full) == 6 and "Row(a=3, b='z')" not in full
    assert [(r.a, r.b, r._buffer) for r in spark.read.parquet(f"{out}/open").collect()] == [(3, "z", 3)]


def test_streaming_perplexity_of_a_run_without_a_name(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "run_id string, step int, loss double"
    drop(spark.createDataFrame([(None, 1, 1.0)], schema), source, "0")
    drop(spark.createDataFrame([(None, 2, 0.5)], schema), source, "1")
    streams.stream_perplexity(readers.read_stream(spark, source, schema, max_files=1), out).awaitTermination()
    import math

    got = {r.step: r.delta_ppl for r in spark.read.parquet(f"{out}/data").collect()}
    assert math.isclose(got[2], math.e - math.exp(0.5))


def test_quoted_lines_in_csv(spark, tmp_path):
    (tmp_path / "q.csv").write_text('k,v\n1,"line one\nline ""two"""\n2,plain\n3,""\n4,\n')
    df = readers.load(spark, str(tmp_path / "q.csv"), schema="k int, v string")
    assert [tuple(r) for r in df.orderBy("k").collect()] == [(1, 'line one\nline "two"'), (2, "plain"), (3, None), (4, None)]


@pytest.mark.parametrize("fmt", ["text", "json", "csv"])
def test_list_order_of_lines_in_many_blocks(spark, tmp_path, fmt):
    """Large files are read in blocks; rows come back as reading file after file gives them."""
    import json

    lists = {"b.x": range(0, 3000), "a.x": range(3000, 3010), "dir/2.x": range(5000, 5500), "dir/1.x": range(4000, 5000)}
    (tmp_path / "dir").mkdir()
    for name, numbers in lists.items():
        lines = [json.dumps({"v": f"row {n}"}) if fmt == "json" else f"row {n}" for n in numbers]
        (tmp_path / name).write_text("\n".join((["v"] if fmt == "csv" else []) + lines) + "\n")
    listed = [str(tmp_path / n) for n in ("b.x", "dir", "a.x", "b.x")]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        options = {} if fmt == "text" else {"schema": "v string"}
        if fmt == "csv":
            options["multiLine"] = False
        got = readers.in_list_order(spark, listed, fmt, **options)
        rows = [tuple(r) for r in got.select("file_no", "row_no", got.columns[0]).orderBy("file_no", "row_no").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    order = [lists["b.x"], [*lists["dir/1.x"], *lists["dir/2.x"]], lists["a.x"], lists["b.x"]]
    assert rows == [(f, i, f"row {n}") for f, numbers in enumerate(order) for i, n in enumerate(numbers)]
    manifest = tmp_path / "list.txt"
    manifest.write_text("\n".join(listed))
    first = readers.load(spark, str(manifest), f"list:{fmt}", max_records=3001, **options)
    assert sorted(r[0] for r in first.collect()) == sorted([f"row {n}" for n in range(3000)] + ["row 4000"])


def test_numbered_files_appear_together_or_not_at_all(spark, tmp_path):
    from pyspark.sql import Row

    from packfold.sources.numbered import NumberedWriter

    pattern = str(tmp_path / "part-{i}")
    (tmp_path / "part-1").write_text("old")
    with pytest.raises(FileExistsError):
        writers.write_many(strings(spark, LETTERS), "k", 3, pattern)
    assert os.listdir(tmp_path) == ["part-1"] and (tmp_path / "part-1").read_text() == "old"
    writers.write_many(strings(spark, LETTERS), "k", 3, pattern, overwrite=True)
    assert sorted(os.listdir(tmp_path)) == ["part-0", "part-1", "part-2"] and (tmp_path / "part-1").read_text() == LETTERS[1]

    # an attempt that dies half-way leaves nothing, and the attempt that follows all of it
    folder = tmp_path / "retried"
    folder.mkdir()
    rows = [Row(value=f"v{i}", output_file=str(folder / "deep" / f"{i}")) for i in range(5)]

    def dying():
        yield from rows[:3]
        raise OSError("lost")

    sink = NumberedWriter(str(folder), False)
    with pytest.raises(OSError):
        sink.write(dying())
    sink.commit([sink.write(iter(rows)), sink.write(iter(())), None])
    assert [p.name for p in folder.iterdir()] == ["deep"]
    assert {p.name: p.read_text() for p in (folder / "deep").iterdir()} == {f"{i}": f"v{i}" for i in range(5)}
    gone = NumberedWriter(str(folder), False)
    gone.write(iter(rows))
    gone.abort([])
    assert [p.name for p in folder.iterdir()] == ["deep"]


def test_numbers_from_a_table(spark, tmp_path):
    numbers = spark.createDataFrame([(2, 30), (1, 10), (3, 20)], "place int, number int")
    writers.write_many(strings(spark, ["a", "b"]), "k", numbers, str(tmp_path / "x{i:03d}"), to_json=True)
    assert {f: (tmp_path / f).read_text() for f in os.listdir(tmp_path)} == {"x010": '"a"', "x030": '"b"'}


def test_late_steps_are_told_apart(spark, tmp_path):
    import math

    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "run_id string, step int, loss double"
    batches = [
        [("a", 3, 1.0), ("a", 1, 2.0), ("b", 7, 0.5), ("a", 2, None)],
        [("a", 2, 1.5), ("a", 3, 0.1), ("a", 5, 0.4), ("a", 4, 4.0), ("a", 4, 4.5), ("a", None, 1.0), ("b", 8, 0.25)],
        [("a", 6, 0.2), ("a", 4, 0.3)],
    ]
    for i, rows in enumerate(batches):
        drop(spark.createDataFrame(rows, schema), source, str(i))
    streams.stream_perplexity(readers.read_stream(spark, source, schema, max_files=1), out).awaitTermination()
    got = {(r.run_id, r.step, r.loss): (r.perplexity, r.delta_ppl, r.late) for r in spark.read.parquet(f"{out}/data").collect()}
    e, late = math.exp, lambda x: (math.exp(x), None, True)
    want = {
        ("a", 1, 2.0): (e(2), -e(2), False), ("a", 3, 1.0): (e(1), e(2) - e(1), False), ("b", 7, 0.5): (e(0.5), -e(0.5), False),
        ("a", 2, 1.5): late(1.5), ("a", 3, 0.1): late(0.1), ("a", 4, 4.0): (None, None, False), ("a", 4, 4.5): (None, None, True),
        ("a", 5, 0.4): (e(0.4), e(4) - e(0.4), False), ("a", None, 1.0): late(1.0), ("b", 8, 0.25): (e(0.25), e(0.5) - e(0.25), False),
        ("a", 6, 0.2): (e(0.2), e(0.4) - e(0.2), False), ("a", 4, 0.3): late(0.3),
    }
    assert got.keys() == want.keys()
    for key, values in want.items():
        assert got[key][2] == values[2] and all((g is None) == (w is None) and (w is None or math.isclose(g, w)) for g, w in zip(got[key][:2], values[:2])), (key, got[key])


def test_restart_in_the_middle_of_a_batch(spark, tmp_path):
    """A job that dies while it rates a batch goes on from the state before that batch."""
    import math

    source, out, flag = str(tmp_path / "in"), str(tmp_path / "out"), tmp_path / "died"
    schema = "run_id string, step int, loss double"
    for i in range(3):
        drop(spark.createDataFrame([(f"r{r}", 2 * i + s, 0.1 * r + 0.01 * (2 * i + s)) for r in range(9) for s in range(2)], schema), source, str(i))

    @F.udf("double")
    def fails_once(step, loss):
        if step == 3 and not flag.exists():
            flag.write_text("x")
            raise RuntimeError("lost power")
        return loss

    def run():
        stream = readers.read_stream(spark, source, schema, max_files=1)
        streams.stream_perplexity(stream.withColumn("loss", fails_once("step", "loss")), out).awaitTermination()

    with pytest.raises(Exception, match="lost power"):
        run()
    assert spark.read.parquet(f"{out}/data").count() == 18
    run()
    rows = spark.read.parquet(f"{out}/data").collect()
    assert len(rows) == 54 and not any(r.late for r in rows)
    value = lambda run_id, step: math.exp(0.1 * int(run_id[1:]) + 0.01 * step)
    for r in rows:
        before = value(r.run_id, r.step - 1) if r.step else 0.0
        assert math.isclose(r.delta_ppl, before - value(r.run_id, r.step), abs_tol=1e-12)


def test_streaming_pack_tells_late_rows_apart(spark, tmp_path):
    from packfold.operators.packing import pack_aligned

    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "k int, input_ids array<int>"
    batches = [[(i, [5] * (i + 3)) for i in (1, 2, 3)], [(4, [6] * 9), (2, [7]), (5, [8] * 4)], [(6, [9] * 12), (5, [1])]]
    for i, rows in enumerate(batches):
        drop(spark.createDataFrame(rows, schema), source, str(i))
    options = {"bos": 1, "eos": 2, "seq_length": 6, "num_sequences": 2}
    stream = readers.read_stream(spark, source, schema, max_files=1)
    streams.stream_packed(stream, "k", out, **options).awaitTermination()
    streams.close_packed(spark, "k", out, stream.schema, **options)
    assert sorted((r.k, r.batch) for r in spark.read.parquet(f"{out}/late").collect()) == [(2, 1), (5, 2)]
    kept = spark.createDataFrame([r for rows in batches for r in rows if r not in ((2, [7]), (5, [1]))], schema)
    rows = lambda df: sorted((r.buffer, r.chunk, list(r.input_ids)) for r in df.collect())
    assert rows(spark.read.parquet(f"{out}/data")) == rows(pack_aligned(kept, "k", **options))


def test_listed_paths_of_all_kinds(spark, tmp_path):
    for name in ("deep/a/1.txt", "deep/2.txt", "odd % name/3.txt", "x+y=é/4.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    (tmp_path / "empty").mkdir()
    near = os.path.relpath(tmp_path, os.getcwd())
    listed = [f"file://{tmp_path}/deep", f"{near}/deep/a/1.txt", f"{tmp_path}/odd % name/", f"file:{tmp_path}/x+y=é/4.txt", f"{tmp_path}/deep/*.txt", f"{tmp_path}//deep/a"]
    got = {(r.place, r.value) for r in readers.load_many(spark, listed, "text", ordinal="place").collect()}
    assert got == {
        (0, "deep/a/1.txt"), (0, "deep/2.txt"), (1, "deep/a/1.txt"), (2, "odd % name/3.txt"), (3, "x+y=é/4.txt"), (4, "deep/2.txt"), (5, "deep/a/1.txt"),
    }
    for missing in (["deep", "empty"], ["none"], ["deep/*.none"]):
        with pytest.raises(FileNotFoundError):
            readers.load_many(spark, [f"{tmp_path}/{name}" for name in missing], "text")


def test_listed_files_grow_in_number(spark, tmp_path, monkeypatch):
    from checks import scans

    spark.range(2000).selectExpr("id AS doc_id", "'en' AS lang", "repeat('a', 100) AS text").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(scans, "LISTED_BYTES", 10_000)
    paths, _ = scans.listed(spark, str(tmp_path), "csv", "doc_id", "lang", "text")
    found = [[f for f in os.listdir(path) if f.startswith("part-")] for path in paths]
    assert [len(files) for files in found] == [3, 16, 3]


def test_many_small_files_are_read_by_few_tasks(spark, tmp_path):
    folder = str(tmp_path / "many")
    texts = {f"f{i}.txt": "é\r\n" * (i % 3) for i in range(300)}
    os.makedirs(folder + "/below")
    for name, text in {**texts, "_hidden": "x", ".dot": "x"}.items():
        with open(f"{folder}/{name}", "w", encoding="utf-8", newline="") as out:
            out.write(text)
    read = readers.whole_files(spark, folder)
    assert read.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert {r.file: r.text for r in read.collect()} == {name: text for name, text in texts.items() if text}
