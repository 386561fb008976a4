"""From raw documents to token ids: five stages, each over all rows that the one before kept.

A stage sees the columns of its input under names of their own (``in_...``), so that no column
of a table can clash with what an operator adds, and gives them back as they were.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packfold.llm import bagminhash, bpe, decontaminate, secrets, toxicity
from packfold.plans.ordinals import BROADCAST_ROWS
from packfold.session import materialize

KEY, TEXT = "in_doc_id", "in_text"


def _apart(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.col(f"`{c}`").alias(f"in_{c}") for c in docs.columns])


def _back(found: DataFrame, docs: DataFrame) -> DataFrame:
    return found.select(*[F.col(f"`in_{c}`").alias(c) for c in docs.columns])


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold. Labels only train the model."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias(KEY), "toxic")
    rows = _apart(docs)
    model = toxicity.train(rows, labels, ~toxicity.held_out(KEY), KEY, TEXT, "toxic")
    scored = toxicity.scored(rows, model, KEY, TEXT, tuple(c for c in rows.columns if c != KEY))
    return _back(scored.filter(F.col("predicted") == 0), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return _back(bagminhash.one_of_each(_apart(docs), KEY, TEXT), docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with the benchmark.

    What a document shares hangs on its text alone, so verdicts are kept by a hash of the text
    (128 bits), and only hashes of texts that go meet the documents: by a broadcast if they are
    few, which is counted, else by a shuffle."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    name = F.md5(F.coalesce(F.col(TEXT), F.lit("")))
    rows = _apart(docs)
    found = decontaminate.contamination(rows.select(name.alias("name"), TEXT), benchmark, ["name"], TEXT)
    gone = materialize(found.filter("contaminated").select("name").distinct(), "contaminated")
    hint = "broadcast" if gone.count() <= BROADCAST_ROWS else "merge"
    return _back(rows.join(gone.hint(hint), name == F.col("name"), "left_anti"), docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of every secret; n_chars follows the text."""
    rows = _apart(docs)
    found = secrets.secrets(rows, rows.columns, TEXT)
    clean = found.withColumn(TEXT, secrets.redacted(F.col(TEXT), F.col("spans")))
    if "n_chars" in docs.columns:
        changed = F.when(F.size("spans") > 0, F.length(TEXT).cast("long")).otherwise(F.col("in_n_chars"))
        clean = clean.withColumn("in_n_chars", changed)
    return _back(clean, docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, packed as little-endian unsigned 32-bit integers, and whether they decode back."""
    made = bpe.checked(docs, public_tokenizers.path("byte_bpe_50k.json"), ["doc_id", "lang", "source"])
    n_tokens = F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens")
    return made.select("doc_id", "lang", "source", n_tokens, "ids", "decodes_back")


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminated),
    ("secrets", redact_secrets),
    ("bpe", encode),
]

# Signatures, a trained model and merging by rank have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
