"""Mapping a batch function over a table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from packfold.functions.tokenizers import array_function
from packfold.operators.selecting import require_columns, require_new_columns


def map_batches(
    df: DataFrame,
    fn: Callable[..., dict],
    schema: StructType | str,
    *,
    columns: Sequence[str],
    only_output: bool = False,
) -> DataFrame:
    """Add the columns of ``schema``, computed batch by batch.

    ``fn(*columns)`` gets the input columns as Arrow arrays and returns a dict of arrays or
    lists of the same length. Only ``columns`` travel to Python; the other columns stay in the
    JVM. ``spark.sql.execution.arrow.maxRecordsPerBatch`` sets the batch size.
    """
    require_columns(df, *columns)
    outputs = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if not only_output:
        require_new_columns(df, *outputs.names)
    produced, count = outputs.names, len(columns)

    def run(batch):
        import pyarrow as pa

        result = fn(*[batch.field(i) for i in range(count)])
        arrays = [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x) for x in map(result.get, produced)]
        return pa.StructArray.from_arrays(arrays, names=produced)

    mapped = array_function(run, outputs.simpleString())(F.struct(*columns))
    kept = [] if only_output else df.columns
    return df.withColumn("_out", mapped).select(*kept, "_out.*")


def map_records(df: DataFrame, only_output: bool = False, **outputs) -> DataFrame:
    """Add columns given as expressions; with ``only_output`` keep nothing else."""
    kept = [] if only_output else df.columns
    require_new_columns(df.select(*kept), *outputs)
    return df.select(*kept, *[expr.alias(name) for name, expr in outputs.items()])
