"""Scans, sinks, manifests and scalar functions."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from checks.registry import draw, query, split_of, table
from packfold.functions import text as tx
from packfold.functions.arrays import round_up
from packfold.operators import grouping, selecting
from packfold.session import fresh_path
from packfold.sources import manifests, readers, writers

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
DOCS_SQL = "SELECT doc_id, lang, source, n_chars, text FROM documents"


def with_split(df, key="doc_id"):
    return df.withColumn("split", F.expr(split_of(key)))


def docs(spark, sf):
    return table(spark, sf, "documents")


@query("scan_parquet", "SELECT doc_id, lang, n_chars FROM documents")
def scan_parquet(spark, sf):
    return readers.load(spark, f"{sf}/documents.parquet", "parquet").select("doc_id", "lang", "n_chars")


@query("scan_json", DOCS_SQL)
def scan_json(spark, sf):
    path = writers.save(docs(spark, sf), fresh_path(spark, "json"), "json")
    return readers.load(spark, path, "json", schema=DOC_SCHEMA).select("doc_id", "lang", "source", "n_chars", "text")


@query("scan_json_gzip", DOCS_SQL)
def scan_json_gzip(spark, sf):
    path = fresh_path(spark, "json-gz")
    docs(spark, sf).write.option("compression", "gzip").json(path)
    return readers.load(spark, f"{path}/*.json.gz", schema=DOC_SCHEMA).select("doc_id", "lang", "source", "n_chars", "text")


@query("scan_json_zstd", DOCS_SQL)
def scan_json_zstd(spark, sf):
    """Lines of JSON under zstd, each file a stream of its own."""
    folder = fresh_path(spark, "json-zst")
    os.makedirs(folder)

    def compress(rows):
        import zstandard
        from pyspark import TaskContext

        with open(f"{folder}/part-{TaskContext.get().partitionId():05d}.json.zst", "wb") as out:
            with zstandard.ZstdCompressor().stream_writer(out) as lines:
                for row in rows:
                    lines.write(row.value.encode() + b"\n")

    docs(spark, sf).repartition(4).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).foreachPartition(compress)
    return readers.load(spark, f"{folder}/*.json.zst", schema=DOC_SCHEMA).select("doc_id", "lang", "source", "n_chars", "text")


@query("scan_csv", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def scan_csv(spark, sf):
    path = fresh_path(spark, "csv")
    kept = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    kept.write.option("header", True).csv(path)
    schema = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double"
    return readers.load(spark, path, "csv", schema=schema)


@query("scan_csv_text", DOCS_SQL)
def scan_csv_text(spark, sf):
    """Whole texts in quoted fields, with line ends and doubled quotes."""
    path = fresh_path(spark, "csv-text")
    docs(spark, sf).write.option("header", True).option("escape", '"').csv(path)
    return readers.load(spark, path, "csv", schema=DOC_SCHEMA).select("doc_id", "lang", "source", "n_chars", "text")


@query("scan_text_lines", r"SELECT trim(line, E' \t\n\r\x0b\x0c') AS value FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)")
def scan_text_lines(spark, sf):
    path = writers.write_lines(docs(spark, sf), fresh_path(spark, "lines"), column="text")
    return readers.read_lines(spark, path)


@query("first_line", "SELECT trim(string_split(text, chr(10))[1]) AS value FROM documents ORDER BY doc_id LIMIT 1")
def first_line(spark, sf):
    ordered = docs(spark, sf).select("doc_id", "text").orderBy("doc_id").select("text").limit(1)
    path = writers.write_lines(ordered, fresh_path(spark, "one-file"), column="text")
    return readers.read_lines(spark, path, split_lines=False)


@query("scan_glob", DOCS_SQL)
def scan_glob(spark, sf):
    path = fresh_path(spark, "many")
    docs(spark, sf).repartition(5, "doc_id").write.parquet(path)
    return readers.load(spark, f"{path}/part-*.parquet").select("doc_id", "lang", "source", "n_chars", "text")


@query("scan_splits", f"SELECT doc_id, {split_of('doc_id')} AS split, n_chars, text FROM documents")
def scan_splits(spark, sf):
    path = writers.save_splits(with_split(docs(spark, sf)), fresh_path(spark, "splits"))
    return readers.load(spark, path, "splits").select("doc_id", "split", "n_chars", "text")


SPLITS = ("test", "train", "validation")
PLACE_SQL = f"CASE {split_of('doc_id')} WHEN 'test' THEN 0 WHEN 'train' THEN 1 ELSE 2 END"
LISTED_SQL = f"""SELECT file_no::INTEGER AS file_no, row_number() OVER (PARTITION BY file_no ORDER BY doc_id) - 1 AS row_no, doc_id, lang, text
    FROM (SELECT *, {PLACE_SQL} AS file_no FROM documents)"""


# Fixed value: bytes of text that one file of a list holds.
LISTED_BYTES = 32 << 20


def listed(spark, sf, fmt, *columns):
    """Documents in one folder a split, each of several files in order, and a manifest of the folders."""
    rows, root = with_split(docs(spark, sf)), fresh_path(spark, "listed")
    size = F.sum(F.octet_length("text").cast("long"))
    held = {row.split: row.size or 0 for row in rows.groupBy("split").agg(size.alias("size")).collect()}
    for split in SPLITS:
        # quoted lines are not split, so a file is what one task reads
        files = max(3, -(-held.get(split, 0) // LISTED_BYTES))
        one = rows.filter(F.col("split") == split).repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id")
        one.select(*columns).write.format(fmt).options(**({"header": True, "escape": '"'} if fmt == "csv" else {})).save(f"{root}/{split}")
    paths = spark.createDataFrame([(f"{root}/{split}",) for split in SPLITS], "path string").coalesce(1)
    manifest = writers.write_manifest(paths, fresh_path(spark, "manifest"))
    return manifests.load_file_list(spark, manifest, f"list:{fmt}")


@query("scan_manifest", LISTED_SQL)
def scan_manifest(spark, sf):
    """Folders listed in a manifest, read back in list order."""
    paths, fmt = listed(spark, sf, "parquet", "doc_id", "lang", "text")
    return readers.in_list_order(spark, paths, fmt).select("file_no", "row_no", "doc_id", "lang", "text")


@query("scan_manifest_json", LISTED_SQL)
def scan_manifest_json(spark, sf):
    """The same from lines of JSON, which do not say where they lie."""
    paths, fmt = listed(spark, sf, "json", "doc_id", "lang", "text")
    read = readers.in_list_order(spark, paths, fmt, schema="doc_id bigint, lang string, text string")
    return read.select("file_no", "row_no", "doc_id", "lang", "text")


@query("scan_manifest_csv", LISTED_SQL)
def scan_manifest_csv(spark, sf):
    """The same from CSV, texts with line ends and quotes inside."""
    paths, fmt = listed(spark, sf, "csv", "doc_id", "lang", "text")
    read = readers.in_list_order(spark, paths, fmt, schema="doc_id bigint, lang string, text string")
    return read.select("file_no", "row_no", "doc_id", "lang", "text")


@query(
    "scan_manifest_text",
    f"""SELECT file_no::INTEGER AS file_no, row_number() OVER (PARTITION BY file_no ORDER BY doc_id, place) - 1 AS row_no, value
    FROM (SELECT doc_id, {PLACE_SQL} AS file_no, unnest(string_split(text, chr(10))) AS value,
        unnest(range(len(string_split(text, chr(10))))) AS place FROM documents)""",
)
def scan_manifest_text(spark, sf):
    """Lines of text files in list order."""
    paths, fmt = listed(spark, sf, "text", "text")
    return readers.in_list_order(spark, paths, fmt).select("file_no", "row_no", "value")


@query("load_manifest_head", f"SELECT doc_id, lang FROM (SELECT *, {PLACE_SQL} AS file_no FROM documents) ORDER BY file_no, doc_id LIMIT 150")
def load_manifest_head(spark, sf):
    """The first records of a list are those of its first files."""
    paths, fmt = listed(spark, sf, "json", "doc_id", "lang", "text")
    manifest = writers.write_manifest(spark.createDataFrame([(p,) for p in paths], "path string").coalesce(1), fresh_path(spark, "manifest"))
    first = readers.load(spark, manifest, f"list:{fmt}", schema="doc_id bigint, lang string, text string", max_records=150)
    return first.select("doc_id", "lang")


@query(
    "manifest_lines",
    "SELECT DISTINCT source || '.jsonl' AS path FROM documents",
)
def manifest_lines(spark, sf):
    names = docs(spark, sf).select(F.concat("source", F.lit(".jsonl")).alias("path")).distinct()
    return manifests.manifest_lines(spark, writers.write_manifest(names, fresh_path(spark, "manifest")))


@query("file_catalogue", "SELECT doc_id || '.txt' AS file, octet_length(encode(text)) AS length FROM documents")
def file_catalogue(spark, sf):
    """Names and sizes of the files below a folder that have an ending, none of them opened."""
    root, rows = fresh_path(spark, "catalogue"), docs(spark, sf)
    writers.write_many(rows, "doc_id", rows.select("doc_id"), f"{root}/texts/deep/{{i}}.txt", column="text")
    writers.write_many(rows.select("doc_id", "lang"), "doc_id", 3, f"{root}/texts/{{i}}.other", column="lang")
    found = manifests.catalogue(spark, root, fmt="txt", prefix="texts", recursive=True)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("file"), "length")


@query(
    "rename_splits",
    f"""SELECT doc_id, CASE split WHEN 'test' THEN 'validation' ELSE split END AS split
    FROM (SELECT doc_id, {split_of('doc_id')} AS split FROM documents) WHERE split IN ('train', 'test')""",
)
def rename_splits(spark, sf):
    rows = with_split(docs(spark, sf)).select("doc_id", "split")
    return selecting.rename_splits(rows, {"train": "train", "test": "validation"})


@query("unwrap_single_split", "SELECT doc_id, lang FROM documents")
def unwrap_single_split(spark, sf):
    one = docs(spark, sf).select("doc_id", "lang").withColumn("split", F.lit("train"))
    return selecting.unwrap_single_split(one)


@query("save_parquet", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def save_parquet(spark, sf):
    kept = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return readers.load(spark, writers.save(kept, fresh_path(spark, "saved")), "parquet")


@query(
    "json_lines",
    """SELECT json_object('doc_id', doc_id, 'lang', lang, 'source', source, 'text', text)::VARCHAR AS value FROM documents""",
)
def json_lines(spark, sf):
    rows = docs(spark, sf).select("doc_id", "lang", "source", "text")
    return spark.read.text(writers.write_lines(rows, fresh_path(spark, "jsonl"), to_json=True))


@query(
    "shard_write_plan",
    """SELECT doc_id, text, 3 + row_number() OVER (ORDER BY doc_id) - 1 AS shard_id,
    'out/part-' || (2 + row_number() OVER (ORDER BY doc_id)) || '.txt' AS output_file
    FROM documents""",
)
def shard_write_plan(spark, sf):
    rows = docs(spark, sf).select("doc_id", "text")
    return writers.plan_files(rows, "doc_id", (3, 2**63 - 1), "out/part-{i}.txt").select("doc_id", "text", "shard_id", "output_file")


NUMBERED_SQL = "SELECT 'part-' || lpad((7 + row_number() OVER (ORDER BY doc_id))::VARCHAR, 6, '0') || '.txt' AS file, text FROM documents"


def numbered_back(spark, folder):
    """Files by name, each with its whole text."""
    return readers.whole_files(spark, folder)


@query("write_numbered", NUMBERED_SQL)
def write_numbered(spark, sf):
    """One file for each document, by exact name, committed together."""
    folder = fresh_path(spark, "numbered")
    writers.write_many(docs(spark, sf), "doc_id", (8, 2**62), folder + "/part-{i:06d}.txt", column="text")
    return numbered_back(spark, folder)


@query("write_numbered_listed", "SELECT 'n' || ((doc_id * 7) % 1000003) || '.json' AS file, to_json(text)::VARCHAR AS text FROM documents")
def write_numbered_listed(spark, sf):
    """Numbers from a table, each row as JSON."""
    folder = fresh_path(spark, "numbered")
    numbers = docs(spark, sf).select("doc_id", F.expr("(doc_id * 7) % 1000003").alias("number"))
    writers.write_many(docs(spark, sf), "doc_id", numbers, folder + "/n{i}.json", column="text", to_json=True)
    return numbered_back(spark, folder)


@query("write_numbered_own", "SELECT ('d' || doc_id) AS file, upper(lang) || ':' || text AS text FROM documents")
def write_numbered_own(spark, sf):
    """A writer of the caller's own."""
    folder = fresh_path(spark, "numbered")
    os.makedirs(folder)

    def labelled(value, output_file, mark):
        with open(output_file, "w", encoding="utf-8", newline="") as out:
            out.write(mark.join(value.split("\n", 1)))

    rows = docs(spark, sf).select("doc_id", F.concat_ws("\n", F.upper("lang"), "text").alias("value"))
    numbers = docs(spark, sf).select("doc_id")
    writers.write_many(rows, "doc_id", numbers, folder + "/d{i}", writer=labelled, mark=":")
    return numbered_back(spark, folder)


@query("write_shards", "SELECT (doc_id % 7)::INTEGER AS shard_id, doc_id, text FROM documents")
def write_shards(spark, sf):
    rows = docs(spark, sf).withColumn("shard_id", F.pmod("doc_id", F.lit(7)).cast("int"))
    path = writers.write_shards(rows, fresh_path(spark, "shards"))
    return readers.load(spark, path, "parquet").select("shard_id", "doc_id", "text")


@query(
    "tsv_metadata",
    r"""SELECT doc_id::VARCHAR AS doc_id, lang, replace(replace(text, E'\t', '    '), E'\n', '<br>') AS text FROM documents""",
)
def tsv_metadata(spark, sf):
    """Labels exported next to vectors and read back as TSV."""
    path = fresh_path(spark, "vectors")
    rows = docs(spark, sf).withColumn("embedding", F.array(F.col("n_chars").cast("float"), F.lit(1.0).cast("float")))
    writers.export_vectors(rows, path, labels=["doc_id", "lang", "text"])
    schema = "doc_id string, lang string, text string"
    return spark.read.schema(schema).option("sep", "\t").option("header", True).option("quote", "").csv(f"{path}/metadata")


@query(
    "tsv_vectors",
    """SELECT vec_id::VARCHAR AS vec_id, label::VARCHAR AS label, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total, len(embedding) AS width
    FROM embeddings""",
)
def tsv_vectors(spark, sf):
    """Vectors and labels exported in many parts, read back and joined line by line."""
    path = fresh_path(spark, "vectors")
    writers.export_vectors(table(spark, sf, "embeddings").repartition(5), path, labels=["vec_id", "label"])
    vectors = readers.in_list_order(spark, [f"{path}/vectors"], "text").withColumnRenamed("value", "line")
    options = {"schema": "vec_id string, label string", "sep": "\t", "quote": ""}
    labels = readers.in_list_order(spark, [f"{path}/metadata"], "csv", **options)
    numbers = F.transform(F.split("line", "\t"), lambda x: x.cast("double"))
    total = F.aggregate(numbers, F.lit(0.0), lambda t, x: t + x)
    return vectors.join(labels, "row_no").select("vec_id", "label", F.round(total, 4).alias("total"), F.size(numbers).cast("long").alias("width"))


@query(
    "tsv_vectors_head",
    """SELECT vec_id::VARCHAR AS vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total
    FROM embeddings ORDER BY embeddings.vec_id LIMIT 70""",
)
def tsv_vectors_head(spark, sf):
    """The first records only."""
    path = fresh_path(spark, "vectors")
    writers.export_vectors(table(spark, sf, "embeddings"), path, labels=["vec_id"], order_by="vec_id", max_records=70)
    vectors = readers.in_list_order(spark, [f"{path}/vectors"], "text")
    labels = readers.in_list_order(spark, [f"{path}/metadata"], "csv", schema="vec_id string", sep="\t")
    total = F.aggregate(F.split("value", "\t"), F.lit(0.0), lambda t, x: t + x.cast("double"))
    return vectors.join(labels, "row_no").select("vec_id", F.round(total, 4).alias("total"))


@query("head_rows", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 137")
def head_rows(spark, sf):
    return selecting.head(docs(spark, sf).select("doc_id", "lang"), 137, "doc_id")


@query("head_rows_large", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice LIMIT 20000")
def head_rows_large(spark, sf):
    """A head too large for one task, cut by row number."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
    cut = selecting.head(table(spark, sf, "lineitem"), 20_000, keys)
    return cut.select("l_orderkey", "l_linenumber", "l_quantity")


@query("preview_rows", f"SELECT doc_id, split FROM (SELECT doc_id, {split_of('doc_id')} AS split FROM documents) WHERE split = 'train' ORDER BY doc_id LIMIT 5")
def preview_rows(spark, sf):
    return selecting.preview(with_split(docs(spark, sf)).select("doc_id", "split"), "doc_id")


@query("role_filter", "SELECT conv_id, turn, role FROM conversations WHERE role IN ('user', 'assistant', 'system')")
def role_filter(spark, sf):
    known, _ = selecting.split_by_role(table(spark, sf, "conversations"))
    return known.select("conv_id", "turn", "role")


@query("hash_sample", f"SELECT doc_id, lang FROM documents WHERE {draw('doc_id', 7)} <= 0.05")
def hash_sample(spark, sf):
    return selecting.sample_rows(docs(spark, sf), "doc_id", 0.05, seed=7).select("doc_id", "lang")


@query("group_counts", "SELECT source AS group_id, count(*) AS row_count, min(doc_id) AS first_row FROM documents GROUP BY 1")
def group_counts(spark, sf):
    summary = grouping.group_summary(docs(spark, sf), "source", "doc_id")
    return summary.withColumnRenamed("rows", "row_count")


@query("group_tables", "SELECT lang, doc_id, n_chars, text FROM documents")
def group_tables(spark, sf):
    """The table written as one folder per key and read back."""
    rows = docs(spark, sf).select("lang", "doc_id", "n_chars", "text")
    return readers.load(spark, writers.save_groups(rows, fresh_path(spark, "groups"), "lang"), "parquet")


FIRST_SQL = "(SELECT source, row_number() OVER (ORDER BY min(doc_id)) - 1 AS group_no FROM documents GROUP BY 1)"


@query("group_views", f"SELECT group_no, source AS group_id, doc_id, lang, text FROM documents JOIN {FIRST_SQL} USING (source)")
def group_views(spark, sf):
    """A table split by key, keys unknown before, numbered as they first appear."""
    split = grouping.group_by(docs(spark, sf), "source", "doc_id")
    return split.rows.select(F.col("group_no").cast("long").alias("group_no"), "group_id", "doc_id", "lang", "text")


@query("group_view_first", f"SELECT doc_id, text FROM documents JOIN {FIRST_SQL} USING (source) WHERE group_no = 3")
def group_view_first(spark, sf):
    """The table of one key, from its own folder."""
    split = grouping.group_by(docs(spark, sf), "source", "doc_id")
    return split[split.keys()[3]].select("doc_id", "text")


@query("group_rows", "SELECT lang, doc_id, text FROM documents WHERE lang IN ('en', 'fr')")
def group_rows(spark, sf):
    """The rows of keys that the caller names."""
    views = grouping.groups(docs(spark, sf), "lang", ["en", "fr"])
    return views["en"].union(views["fr"]).select("lang", "doc_id", "text")


@query("guarded_columns", "SELECT doc_id, lang, octet_length(encode(text)) AS text_bytes FROM documents")
def guarded_columns(spark, sf):
    """Guards that let a table pass, and stop it when a column is missing, in the way or forbidden."""
    rows = docs(spark, sf)
    selecting.require_columns(rows, "doc_id", "text")
    selecting.require_new_columns(rows, "text_bytes")
    for guard, columns in ((selecting.require_columns, ["none"]), (selecting.require_new_columns, ["lang"]), (selecting.forbid_columns, ["text"])):
        try:
            guard(rows, *columns)
        except ValueError:
            continue
        raise AssertionError(f"{guard.__name__} let {columns} pass")
    made = rows.select("doc_id", "lang", F.octet_length("text").cast("long").alias("text_bytes"))
    selecting.forbid_columns(made, "text")
    return made


@query("bucket_int", "SELECT o_orderkey, (o_custkey % 16)::VARCHAR AS bucket_id FROM orders")
def bucket_int(spark, sf):
    return grouping.bucket_by(table(spark, sf, "orders"), "o_custkey", 16).select("o_orderkey", "bucket_id")


@query(
    "bucket_text",
    "SELECT doc_id, (('0x' || substr(md5(text), 1, 8))::BIGINT % 16)::VARCHAR AS bucket_id, text FROM documents",
)
def bucket_text(spark, sf):
    return grouping.bucket_by(docs(spark, sf), "text", 16).select("doc_id", "bucket_id", "text")


@query("distinct_keys", "SELECT DISTINCT source FROM documents")
def distinct_keys(spark, sf):
    return grouping.distinct_keys(docs(spark, sf), "source")


@query("split_counts", f"SELECT {split_of('doc_id')} AS split, count(*) AS row_count FROM documents GROUP BY 1")
def split_counts(spark, sf):
    return grouping.row_counts(with_split(docs(spark, sf)), "split").withColumnRenamed("rows", "row_count")


@query("tsv_safe", r"SELECT doc_id, replace(replace(text, E'\t', '    '), E'\n', '<br>') AS safe FROM documents")
def tsv_safe(spark, sf):
    return docs(spark, sf).select("doc_id", tx.tsv_safe(F.col("text")).alias("safe"))


# Steps of a readable number, written out apart from the code under test.
READABLE = ((1e15, "P"), (1e12, "T"), (1e9, "G"), (1e6, "M"), (1e3, "K"), (1.0, ""), (1e-3, "m"), (1e-6, "u"))


def _readable_sql(x):
    units = "".join(
        f" WHEN abs({x}) > {base!r} THEN format('{{:.2f}}', {x} / {base!r}::DOUBLE) || '{unit}'" for base, unit in READABLE
    )
    return f"CASE{units} ELSE format('{{:.2e}}', {x}) END"


@query(
    "human_readable",
    f"""SELECT n_chars, {_readable_sql('n')} AS readable FROM (SELECT n_chars, n_chars::DOUBLE * n_chars AS n FROM documents)
    UNION ALL SELECT event_id, {_readable_sql('n')} FROM (SELECT event_id, value / 1000 AS n FROM events)""",
)
def human_readable(spark, sf):
    chars = F.col("n_chars").cast("double")
    big = docs(spark, sf).select("n_chars", tx.human_readable(chars * chars).alias("readable"))
    small = table(spark, sf, "events").select("event_id", tx.human_readable(F.col("value") / 1000).alias("readable"))
    return big.union(small)


@query(
    "file_urls",
    """SELECT doc_id, CASE WHEN starts_with(path, 'datasets/src1/')
    THEN 'https://huggingface.co/datasets/src1/resolve/main/' || substr(path, 15) ELSE path END AS url
    FROM (SELECT doc_id, 'datasets/' || source || '/' || doc_id || '.parquet' AS path FROM documents)""",
)
def file_urls(spark, sf):
    path = F.concat(F.lit("datasets/"), "source", F.lit("/"), "doc_id", F.lit(".parquet"))
    return docs(spark, sf).select("doc_id", tx.file_url(path, "datasets/src1").alias("url"))


@query("numbered_paths", "SELECT doc_id, 'data/' || doc_id || '.json' AS path FROM documents")
def numbered_paths(spark, sf):
    return docs(spark, sf).select("doc_id", tx.numbered_path("data/{i}.json", F.col("doc_id")).alias("path"))


@query("stripped_text", r"SELECT doc_id, trim(text, E' \t\n\r\x0b\x0c') AS text FROM documents")
def stripped_text(spark, sf):
    return docs(spark, sf).select("doc_id", tx.stripped("text").alias("text"))


@query("round_up_lengths", "SELECT doc_id, (ceil(n_chars / 64.0) * 64)::INTEGER AS padded FROM documents")
def round_up_lengths(spark, sf):
    return docs(spark, sf).select("doc_id", round_up(F.col("n_chars"), 64).alias("padded"))
