"""Whole jobs from an input path to a saved table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packfold.functions.tokenizers import Tokenizer
from packfold.operators.packing import pack_fixed
from packfold.operators.tokenizing import output_name, tokenize
from packfold.plans.ordinals import with_ordinal
from packfold.session import arrow_rows
from packfold.sources.readers import load
from packfold.sources.writers import save, save_splits


def tokenize_table(
    spark: SparkSession,
    tokenizer: Tokenizer,
    input_path: str,
    output_path: str,
    *,
    input_format: str = "parquet",
    output_format: str = "parquet",
    column: str = "text",
    output_column: str | None = "input_ids",
    counts_column: str | None = "token_count",
    add_special_tokens: bool = False,
    max_records: int | None = None,
    order_by: str | Sequence[str] | None = None,
    overwrite: bool = False,
    batch_size: int | None = None,
) -> int:
    """Load, tokenize, save; returns the token total, or -1 without counts.

    The total is read from the saved column, so text is tokenized once. The tokenizer gets
    ``batch_size`` rows at a time, or as many as the session is set to.
    """
    df = load(spark, input_path, input_format)
    tokens = tokenize(
        df,
        tokenizer,
        column=column,
        output_column=output_name(column, output_column),
        counts_column=counts_column,
        add_special_tokens=add_special_tokens,
        max_records=max_records,
        order_by=order_by,
    )
    with arrow_rows(spark, batch_size):
        save(tokens, output_path, output_format, overwrite=overwrite)
    if not counts_column:
        return -1
    saved = spark.read.schema(tokens.schema).format(output_format).load(output_path)
    return saved.agg(F.sum(counts_column)).first()[0] or 0


def make_constant(
    data: DataFrame,
    tokenizer: Tokenizer,
    order_by: str,
    *,
    output_dir: str | None = None,
    seq_length: int = 2048,
    column: str = "text",
    max_records: int | None = None,
    add_special_tokens: bool = True,
    overwrite: bool = False,
) -> DataFrame | str:
    """Tokenize and cut into rows of ``seq_length`` tokens, split by split; save if asked.

    ``max_records`` caps every split.
    """
    split = "split" if "split" in data.columns else None
    if max_records:
        data = _capped(data, order_by, max_records, split)
    encode = tokenizer.array_encoder(add_special_tokens)
    packed = pack_fixed(data, order_by, seq_length=seq_length, group=split, ids=column, encode=encode)
    if output_dir is None:
        return packed
    return save_splits(packed, output_dir, overwrite=overwrite) if split else save(packed, output_dir, overwrite=overwrite)


def _capped(data: DataFrame, order_by: str, max_records: int, split: str | None) -> DataFrame:
    numbered = with_ordinal(data, order_by, group=split, name="_row")
    return numbered.filter(F.col("_row") < max_records).drop("_row")
