"""Streaming jobs run to the end of what has arrived, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import SQL, byte_count, byte_ids, query, table
from checks.tokens import TOKENIZER, aligned_sql, training_log
from packfold.functions import arrays
from packfold.session import fresh_path
from packfold.sources.readers import read_stream
from packfold.streaming import jobs


# Files of each part that arrives.
FILES = 3


def arriving(spark, df, order, parts):
    """``df`` written in parts of several files that arrive one part after the other, in ``order``;
    a micro-batch takes one part."""
    folder = fresh_path(spark, "arriving")
    low, high = df.agg(F.min(order), F.max(order)).first()
    part = F.floor((F.col(order) - low) * parts / (high - low + 1))
    for i in range(parts):
        df.filter(part == i).repartition(FILES).write.mode("append").parquet(folder)
    return read_stream(spark, folder, df.schema, max_files=FILES)


@query("stream_tokenize", f"SELECT doc_id, {byte_count('text')}::INTEGER AS token_count FROM documents")
def stream_tokenize(spark, sf):
    documents = table(spark, sf, "documents").select("doc_id", "text")
    folder = fresh_path(spark, "stream-tokens")
    jobs.stream_tokens(arriving(spark, documents, "doc_id", 3), TOKENIZER, folder).awaitTermination()
    return spark.read.parquet(f"{folder}/data").select("doc_id", "token_count")


@query("stream_pack", f"SELECT buffer, chunk, input_ids FROM ({aligned_sql(256, 64, byte_ids('text'))})")
def stream_pack(spark, sf):
    """The same rows as packing the whole table, whatever arrives together."""
    documents = table(spark, sf, "documents").select("doc_id", TOKENIZER.encode("text").alias("input_ids"))
    folder = fresh_path(spark, "stream-packed")
    stream = arriving(spark, documents, "doc_id", 3)
    options = {"bos": 1, "eos": 2, "seq_length": 256, "num_sequences": 64}
    jobs.stream_packed(stream, "doc_id", folder, **options).awaitTermination()
    jobs.close_packed(spark, "doc_id", folder, documents.schema, **options)
    packed = spark.read.parquet(f"{folder}/data")
    return packed.select("buffer", "chunk", arrays.as_text("input_ids").alias("input_ids"))


@query("stream_perplexity", SQL["perplexity_series"])
def stream_perplexity(spark, sf):
    folder = fresh_path(spark, "stream-perplexity")
    stream = arriving(spark, training_log(spark, sf), "step", 3)
    jobs.stream_perplexity(stream, folder).awaitTermination()
    rated = spark.read.parquet(f"{folder}/data")
    return rated.select("run_id", "step", F.round("perplexity", 6).alias("perplexity"), F.round("delta_ppl", 6).alias("delta_ppl"))
