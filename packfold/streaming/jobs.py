"""The tokenizing, packing and perplexity jobs over files that keep arriving.

Every job writes under a folder and can be restarted: the checkpoint remembers finished
micro-batches and the state after them, and a batch that runs twice overwrites its own output.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from packfold.functions.tokenizers import Tokenizer
from packfold.operators.packing import assign_buffers, pack_aligned
from packfold.operators.perplexity import MIN_LOG_PPL
from packfold.operators.tokenizing import tokenize
from packfold.plans.ordinals import names
from packfold.session import materialize

BATCH = "batch"


def _start(writer, folder: str, available_now: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", f"{folder}/_checkpoint")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stream_tokens(
    stream: DataFrame, tokenizer: Tokenizer, folder: str, *, available_now: bool = True, **options
) -> StreamingQuery:
    """Tokenize rows as they arrive and append them to ``folder/data``. Keeps no state."""
    tokens = tokenize(stream, tokenizer, **options)
    writer = tokens.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/data")
    return _start(writer, folder, available_now)


def _after(spark: SparkSession, folder: str, batch_id: int, schema: T.StructType) -> DataFrame:
    """State left by the batch before; empty for the first."""
    if batch_id == 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{folder}/{BATCH}={batch_id - 1}")


def stream_packed(
    stream: DataFrame,
    order_by: str | Sequence[str],
    folder: str,
    *,
    bos: int,
    eos: int,
    ids: str = "input_ids",
    available_now: bool = True,
    **options,
) -> StreamingQuery:
    """Pack rows as they arrive into ``folder/data/batch=<id>``, as ``pack_aligned`` would pack
    them all at once; rows must arrive in ``order_by``.

    ``folder/open/batch=<id>`` holds the rows of the buffer that was still open after a batch,
    with its number. The next batch goes on filling it, so nothing depends on where a
    micro-batch ends. ``close_packed`` packs what is open when the stream has ended. A row that is
    not beyond all rows of earlier batches has missed its place; such rows are not packed but
    written to ``folder/late/batch=<id>``.
    """
    keys = names(order_by)
    state = T.StructType([stream.schema[k] for k in keys] + [stream.schema[ids], T.StructField("_buffer", T.LongType())])

    def pack(batch: DataFrame, batch_id: int) -> None:
        waiting = _after(batch.sparkSession, f"{folder}/open", batch_id, state)
        # the open buffer holds the last row so far, whose keys tell what comes too late
        base, newest = waiting.agg(F.max("_buffer"), F.max(F.struct(*keys))).first()
        base = base or 0
        if newest is not None:
            beyond = F.struct(*keys) > F.struct(*[F.lit(v).cast(stream.schema[k].dataType) for k, v in zip(keys, newest)])
            batch.filter(~beyond).write.mode("overwrite").parquet(f"{folder}/late/{BATCH}={batch_id}")
            batch = batch.filter(beyond)
        rows = materialize(waiting.select(*keys, ids).union(batch.select(*keys, ids)), "stream-rows")
        placed = materialize(assign_buffers(rows, keys, ids=ids, **options).select(*keys, "buffer"), "stream-buffers")
        # buffers follow the order, so the first row of the open one parts the rows and none is moved
        back, *opened = placed.agg(F.min(F.struct((-F.col("buffer")).alias("_back"), *keys))).first()[0] or [0] + [None] * len(keys)
        last, first = -back, F.struct(*[F.lit(v).cast(stream.schema[k].dataType) for k, v in zip(keys, opened)])
        still = rows.filter(F.struct(*keys) >= first).select(*keys, ids, F.lit(base + last).cast("long").alias("_buffer"))
        still.write.mode("overwrite").parquet(f"{folder}/open/{BATCH}={batch_id}")
        full = rows.filter(F.struct(*keys) < first)
        packed = pack_aligned(full, keys, bos=bos, eos=eos, ids=ids, **options)
        numbered = packed.withColumn("buffer", F.col("buffer") + F.lit(base))
        numbered.write.mode("overwrite").parquet(f"{folder}/data/{BATCH}={batch_id}")

    return _start(stream.writeStream.foreachBatch(pack), folder, available_now)


def close_packed(
    spark: SparkSession, order_by: str | Sequence[str], folder: str, schema: T.StructType, *, bos: int, eos: int, ids: str = "input_ids", **options
) -> None:
    """Pack the buffer that an ended ``stream_packed`` left open into ``folder/data/batch=-1``;
    its incomplete last row is dropped, as at the end of any table. ``schema`` is the stream's."""
    keys = names(order_by)
    state = T.StructType([schema[k] for k in keys] + [schema[ids], T.StructField("_buffer", T.LongType()), T.StructField(BATCH, T.IntegerType())])
    left = spark.read.schema(state).parquet(f"{folder}/open")
    newest = left.agg(F.max(BATCH)).first()[0]
    rows = left.filter(F.col(BATCH) == newest)
    base = rows.agg(F.max("_buffer")).first()[0] or 0
    packed = pack_aligned(rows.select(*keys, ids), keys, bos=bos, eos=eos, ids=ids, **options)
    packed.withColumn("buffer", F.col("buffer") + F.lit(base)).write.mode("overwrite").parquet(f"{folder}/data/{BATCH}=-1")


def stream_perplexity(
    stream: DataFrame,
    folder: str,
    *,
    run: str = "run_id",
    step: str = "step",
    loss: str = "loss",
    min_ppl: float = MIN_LOG_PPL,
    available_now: bool = True,
) -> StreamingQuery:
    """Perplexity series of runs that go on logging, appended to ``folder/data``.

    Spark's state store keeps the last step and value of every run, so a micro-batch touches the
    state of the runs it holds and no other. Steps that arrive together may come in any order. A
    step that is not beyond the run's last one is late (so is a repeated step, and one without a
    number): its successor has been rated already, so it is told apart by ``late``, gets no
    ``delta_ppl`` and changes nothing that follows. Rows without loss are skipped. The rows of one
    run in one micro-batch meet in one task; ``read_stream``'s ``max_files`` bounds them.
    """
    kinds = {name: stream.schema[name].dataType.simpleString() for name in (run, step)}
    out = f"{run} {kinds[run]}, {step} {kinds[step]}, {loss} double, perplexity double, delta_ppl double, late boolean"
    logged = stream.filter(F.col(loss).isNotNull()).select(run, step, F.col(loss).cast("double").alias(loss))
    rate = _rating(run, step, loss, math.exp(min_ppl), kinds[step] in ("tinyint", "smallint", "int", "bigint"))
    rated = logged.groupBy(run).applyInPandasWithState(rate, out, f"step {kinds[step]}, ppl double", "append", "NoTimeout")
    writer = rated.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/data")
    return _start(writer, folder, available_now)


def _rating(run: str, step: str, loss: str, limit: float, whole: bool):
    """The function that rates the new rows of one run and moves its state on."""

    def rate(key, frames, state):
        import numpy as np
        import pandas as pd

        rows = pd.concat(list(frames), ignore_index=True).sort_values([step, loss], kind="stable", ignore_index=True)
        steps, ppl = rows[step], np.exp(rows[loss].to_numpy())
        last_step, last_ppl = state.get if state.exists else (None, 0.0)
        late = steps.isna().to_numpy() | steps.duplicated().to_numpy()
        if last_step is not None:
            late |= (steps <= last_step).to_numpy()
        series = ppl[~late]
        delta = np.full(len(rows), np.nan)
        delta[~late] = np.concatenate([[last_ppl], series[:-1]])[: len(series)] - series
        if len(series):
            newest = steps[~late].iloc[-1]
            # a missing step makes a column of whole numbers one of floats
            state.update((int(newest) if whole else newest, float(series[-1])))
        below = ppl < limit
        yield pd.DataFrame(
            {
                run: [key[0]] * len(rows),
                step: steps,
                loss: rows[loss],
                "perplexity": _with_nulls(ppl, below),
                "delta_ppl": _with_nulls(delta, below & ~late),
                "late": late,
            }
        )

    def _with_nulls(values, known):
        import pandas as pd

        return pd.array([float(v) if k else None for v, k in zip(values, known)], dtype="Float64")

    return rate
