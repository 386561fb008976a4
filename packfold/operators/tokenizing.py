"""Adding token arrays to a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packfold.functions import arrays
from packfold.functions.tokenizers import Tokenizer
from packfold.operators.selecting import head, require_columns, require_new_columns


def output_name(column: str, output_column: str | None) -> str:
    return output_column or f"{column}_input_ids"


def tokenize(
    df: DataFrame,
    tokenizer: Tokenizer,
    *,
    column: str = "text",
    output_column: str | None = "input_ids",
    counts_column: str | None = "token_count",
    add_special_tokens: bool = False,
    max_records: int | None = None,
    order_by: str | Sequence[str] | None = None,
) -> DataFrame:
    """``df`` plus a token array and, unless ``counts_column`` is empty, its length.

    ``max_records`` caps the rows before any text is tokenized.
    """
    output = output_name(column, output_column)
    require_columns(df, column)
    require_new_columns(df, output, *([counts_column] if counts_column else []))
    df = head(df, max_records, order_by)
    df = df.withColumn(output, tokenizer.encode(column, add_special_tokens))
    if counts_column:
        df = df.withColumn(counts_column, arrays.token_count(output))
    return df


def tokenize_truncated(df: DataFrame, tokenizer: Tokenizer, *, column: str = "text", max_length: int = 256) -> DataFrame:
    """Only the first ``max_length`` ids of every row and their attention mask."""
    ids = df.select(tokenizer.encode(column, add_special_tokens=True).alias("ids"))
    return ids.select(arrays.truncated("ids", max_length).alias("input_ids")).withColumn(
        "attention_mask", arrays.repeated(1, F.size("input_ids"))
    )


def decode(df: DataFrame, tokenizer: Tokenizer, *, column: str = "input_ids", output_column: str = "text") -> DataFrame:
    require_new_columns(df, output_column)
    return df.withColumn(output_column, tokenizer.decode(column))


def total_tokens(df: DataFrame, counts_column: str | None = "token_count") -> DataFrame:
    """One row with the token total; -1 when counts are switched off."""
    if not counts_column:
        return df.sparkSession.range(1).select(F.lit(-1).cast("long").alias("tokens"))
    return df.agg(F.coalesce(F.sum(counts_column), F.lit(0)).cast("long").alias("tokens"))
