"""Adding vectors to a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packfold.functions.encoders import Encoder
from packfold.operators.selecting import head, warn_missing
from packfold.session import arrow_rows
from packfold.sources.writers import export_vectors, save


def normalized(vector: Column | str) -> Column:
    """The vector at unit length; a zero vector stays as it is."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    squares = F.aggregate(vector, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    return F.transform(
        F.zip_with(vector, F.array_repeat(F.sqrt(squares), F.size(vector)), lambda x, n: F.struct(x.alias("x"), n.alias("n"))),
        lambda p: F.when(p["n"] > 0, p["x"] / p["n"]).otherwise(p["x"].cast("double")).cast("float"),
    )


def embed(
    df: DataFrame,
    encoder: Encoder,
    *,
    column: str = "text",
    output_column: str = "embedding",
    max_records: int | None = None,
    order_by: str | Sequence[str] | None = None,
) -> DataFrame:
    """``df`` plus a unit-length vector of ``column``."""
    warn_missing(df, column)
    df = head(df, max_records, order_by)
    encoded = df.withColumn(output_column, encoder.encode(column))
    return encoded.withColumn(output_column, normalized(output_column))


def embed_table(
    df: DataFrame,
    encoder: Encoder,
    path: str | None = None,
    *,
    fmt: str = "parquet",
    overwrite: bool = False,
    vectors_path: str | None = None,
    labels: Sequence[str] = (),
    output_column: str = "embedding",
    batch_size: int | None = None,
    **options,
) -> DataFrame:
    """Embed and save; exports read the saved table, so no text is encoded twice. The encoder gets
    ``batch_size`` rows at a time while the table is saved, or as many as the session is set to."""
    embedded = embed(df, encoder, output_column=output_column, **options)
    if path:
        with arrow_rows(df.sparkSession, batch_size):
            save(embedded, path, fmt, overwrite=overwrite)
        embedded = df.sparkSession.read.schema(embedded.schema).format(fmt).load(path)
    if vectors_path:
        export_vectors(embedded, vectors_path, column=output_column, labels=labels, overwrite=overwrite)
    return embedded
