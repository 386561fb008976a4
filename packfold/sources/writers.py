"""Sinks: tables, split folders, text lines, numbered shards and TSV exports."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packfold.functions.text import NUMBER_PLACE, json_line, json_value, numbered_path, tsv_safe
from packfold.operators.selecting import head
from packfold.plans.ordinals import join_back, names, ordinals
from packfold.sources.manifests import catalogue
from packfold.sources.numbered import FORMAT, NumberedFiles

WRITABLE = ("parquet", "json")


def _save(writer, path: str) -> str:
    try:
        writer(path)
    except AnalysisException as error:
        if "PATH_ALREADY_EXISTS" in str(error):
            raise FileExistsError(f"{path} exists; pass overwrite=True to replace it") from error
        raise
    return path


def _mode(overwrite: bool) -> str:
    return "overwrite" if overwrite else "errorifexists"


def save(df: DataFrame, path: str, fmt: str = "parquet", *, overwrite: bool = False, partition_by: Sequence[str] = ()) -> str:
    """Write Parquet or JSON lines; an existing target is refused unless ``overwrite``."""
    if fmt not in WRITABLE:
        raise ValueError(f"unsupported output format: {fmt}")
    writer = df.write.mode(_mode(overwrite)).partitionBy(*partition_by)
    # nulls stay visible in JSON lines
    if fmt == "json":
        writer = writer.option("ignoreNullFields", "false")
    return _save(getattr(writer, fmt), path)


def save_splits(df: DataFrame, path: str, fmt: str = "parquet", *, split: str = "split", overwrite: bool = False) -> str:
    """One sub-folder per split."""
    return save(df, path, fmt, overwrite=overwrite, partition_by=[split])


def save_groups(df: DataFrame, path: str, key: str | Sequence[str], fmt: str = "parquet", *, overwrite: bool = False) -> str:
    """One sub-folder per key value.

    Rows are rebalanced by key first, so small groups end up in few files; adaptive execution
    splits the groups that are too big for one task.
    """
    keys = names(key)
    return save(df.hint("rebalance", *[F.col(k) for k in keys]), path, fmt, overwrite=overwrite, partition_by=keys)


def write_lines(df: DataFrame, path: str, *, column: str | None = None, to_json: bool = False, overwrite: bool = False) -> str:
    """One text line per row: a string column, or the row as JSON."""
    if to_json:
        line: Column = json_line(F.col(column) if column else F.struct("*"))
    else:
        line = F.col(column or "value")
    return _save(df.select(line.alias("value")).write.mode(_mode(overwrite)).text, path)


def write_manifest(df: DataFrame, path: str, *, overwrite: bool = False) -> str:
    """The paths of a catalogue, one per line."""
    return write_lines(df, path, column="path", overwrite=overwrite)


def catalogue_to_manifest(spark, root: str, path: str, *, overwrite: bool = False, **options) -> str:
    return write_manifest(catalogue(spark, root, **options), path, overwrite=overwrite)


def _numbers(spark: SparkSession, numbers: int | tuple[int, int] | Iterable[int] | DataFrame) -> range | DataFrame:
    """File numbers as a range, or as a table of (ordinal, shard_id).

    A count stands for 0, 1, ...; a pair for start and stop; anything else is taken as listed. A
    table gives numbers in the order of its first column, the number being the last.
    """
    match numbers:
        case int():
            return range(numbers)
        case (int(start), int(stop)) if isinstance(numbers, tuple):
            return range(start, stop)
        case range():
            return numbers
        case str() | bytes():
            raise TypeError(f"file numbers cannot be text: {numbers!r}")
        case DataFrame():
            order, number = numbers.columns[0], numbers.columns[-1]
            placed = ordinals(numbers, order, carry={"shard_id": F.col(number).cast("long")}).frame
            return placed.select("ordinal", "shard_id")
        case _:
            return spark.createDataFrame([(i, int(n)) for i, n in enumerate(numbers)], "ordinal long, shard_id long")


def plan_files(df: DataFrame, order_by: str | Sequence[str], numbers, pattern: str) -> DataFrame:
    """Rows paired with file numbers in order, until the shorter of the two ends.

    Adds ``shard_id`` and ``output_file``. Rows past the last number are left out, as pairing asks.
    ``numbers`` may be a table; listed numbers are joined to the rows as one.
    """
    if not NUMBER_PLACE.search(pattern):
        raise ValueError(f"pattern {pattern} has no {{i}}: all rows would share one file")
    keys = names(order_by)
    given = _numbers(df.sparkSession, numbers)
    numbered, rows, _ = ordinals(df, keys)
    if isinstance(given, range):
        inside = numbered.filter(F.col("ordinal") < len(given))
        planned = inside.withColumn("shard_id", (given.start + F.col("ordinal") * given.step).cast("long"))
    else:
        planned = numbered.join(given, "ordinal")
    planned = planned.select(*keys, "shard_id", numbered_path(pattern, F.col("shard_id")).alias("output_file"))
    return join_back(df, planned, keys, rows)


def write_many(
    df: DataFrame,
    order_by: str | Sequence[str],
    numbers,
    pattern: str,
    *,
    column: str = "value",
    to_json: bool = False,
    writer: Callable | None = None,
    overwrite: bool = False,
    **options,
) -> None:
    """One numbered file per row of ``column``, as text or as JSON.

    The files appear together when all are written (``sources/numbered.py``); an existing one is
    refused, and then none appears, unless ``overwrite``. A null is an empty file.
    ``writer(value, output_file=..., **options)`` replaces this: executors call it for each row,
    and again for a task that is tried again, so what it does must bear repetition.
    """
    planned = plan_files(df, order_by, numbers, pattern).select(
        (json_value(F.col(column)) if to_json else F.col(column)).alias("value"), "output_file"
    )
    if writer is not None:

        def write_rows(rows):
            for row in rows:
                writer(row.value, output_file=row.output_file, **options)

        planned.foreachPartition(write_rows)
        return
    spark = df.sparkSession
    spark.dataSource.register(NumberedFiles)
    sink = planned.write.format(FORMAT).mode("append").option("root", NUMBER_PLACE.split(pattern)[0].rpartition("/")[0] or ".")
    try:
        sink.option("replace", str(overwrite).lower()).save()
    except Exception as error:
        if "FileExistsError" in str(error):
            raise FileExistsError(f"files of {pattern} exist; pass overwrite=True to replace them") from error
        raise


def write_shards(df: DataFrame, path: str, shard: str = "shard_id", fmt: str = "parquet", *, overwrite: bool = False) -> str:
    """One sub-folder per shard number."""
    return save_groups(df, path, shard, fmt, overwrite=overwrite)


def vectors_tsv(column: str = "embedding") -> Column:
    """A vector as tab-separated numbers."""
    return F.array_join(F.transform(column, lambda x: x.cast("string")), "\t")


def export_vectors(
    df: DataFrame,
    path: str,
    *,
    column: str = "embedding",
    labels: Sequence[str] = (),
    order_by: str | Sequence[str] | None = None,
    max_records: int | None = None,
    overwrite: bool = False,
) -> None:
    """``path/vectors`` with one vector per line and ``path/metadata`` with the labels, TSV.

    Both come from one pass and have parts of the same numbers, so that line i of a part of one
    belongs to line i of that part of the other, beside the header that each metadata part
    begins with. ``order_by`` sorts all lines; ``max_records`` keeps the first of them.
    """
    spark, keys = df.sparkSession, names(order_by)
    if max_records:
        df = head(df, max_records, keys or None)
    ordered = df.sort(*keys) if keys else df
    numbered = ordered.select(
        vectors_tsv(column).alias("_vector"),
        F.concat_ws("\t", *[F.coalesce(tsv_safe(F.col(c).cast("string")), F.lit("")) for c in labels]).alias("_labels"),
        F.monotonically_increasing_id().alias("_line"),
    )
    entry = lambda kind, line, text: F.struct(F.lit(kind).alias("kind"), line.alias("line"), text.alias("value"))
    entries = F.array(entry("vectors", F.col("_line"), F.col("_vector")))
    if labels:
        told = F.array(entry("metadata", F.col("_line"), F.col("_labels")))
        first = F.col("_line").bitwiseAND((1 << 33) - 1) == 0
        title = F.array(entry("metadata", F.col("_line") - 1, F.lit("\t".join(labels))))
        entries = F.concat(entries, F.when(first, F.concat(title, told)).otherwise(told))
    lines = numbered.select(F.inline(entries)).sortWithinPartitions("kind", "line").select("kind", "value")
    kinds = ["vectors", "metadata"] if labels else ["vectors"]
    _publish(spark, lines.write.partitionBy("kind"), path.rstrip("/"), {f"kind={kind}": kind for kind in kinds}, overwrite)


def _publish(spark: SparkSession, writer, path: str, names: dict[str, str], overwrite: bool) -> None:
    """Write lines beside their places below ``path`` and rename the folders, all or none where a
    name is taken."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    system = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    targets = {made: hadoop.Path(f"{path}/{name}") for made, name in names.items()}
    for target in targets.values():
        if system.exists(target) and not overwrite:
            raise FileExistsError(f"{target.toString()} exists; pass overwrite=True to replace it")
    staging = f"{path}/_export-{uuid.uuid4().hex}"
    try:
        writer.text(staging)
        for made, target in targets.items():
            source = hadoop.Path(f"{staging}/{made}")
            system.delete(target, True)
            # no row, no part
            done = system.rename(source, target) if system.exists(source) else system.mkdirs(target)
            if not done:
                raise OSError(f"cannot move {source.toString()} to {target.toString()}")
    finally:
        system.delete(hadoop.Path(staging), True)
