"""Importance resampling: keep the rows whose hashed n-grams look most like a target's.

Two bags-of-n-grams models over hashed words and word pairs, one of target text and one of all
raw text, give each row a log importance weight, the sum of its n-grams' log ratios. Adding
Gumbel noise and keeping the k largest sums draws k rows without replacement in proportion to
the weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packfold.functions.hashing import uniform
from packfold.llm import texts
from packfold.llm.texts import U64, Block
from packfold.session import materialize

BUCKETS = 1 << 18
# Target n-grams added to both sides of a ratio: what is rare says little.
SMOOTHING = 2.0
SEED = 42

FIELDS = [("n_ngrams", T.LongType()), ("log_weight", T.DoubleType()), ("gumbel_key", T.DoubleType()), ("_order", T.LongType())]


def ngram_buckets(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of every word and every pair of neighbouring words."""
    found = texts.runs(block, texts.ALNUM)
    words = texts.slice_hash(texts.prefix_hash(block.data, texts.LOWER), found.start, found.end)
    pairs, first = texts.ngrams(words, found.text, 2)
    low = U64(BUCKETS - 1)
    return (
        np.concatenate([texts.mix(words) & low, pairs & low]).astype(np.int64),
        np.concatenate([found.text, found.text[first]]),
    )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a whole partition, one row a bucket."""
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        chosen = np.asarray(batch.column(1).fill_null(False)).astype(np.bool_)
        for block in texts.blocks(batch.column(0)):
            bucket, text = ngram_buckets(block)
            raw += np.bincount(bucket, minlength=BUCKETS)
            own = chosen[block.first + text]
            target += np.bincount(bucket[own], minlength=BUCKETS)
    used = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays(
        [pa.array(used.astype(np.int32)), pa.array(raw[used]), pa.array(target[used])], names=["bucket", "raw", "target"]
    )


def log_ratios(df: DataFrame, text: str, is_target: str) -> np.ndarray:
    """log of target share over raw share for every bucket; BUCKETS rows reach the driver.

    Shares are smoothed towards each other: the ratio is (target + a) / (expected + a), where
    the raw text's share gives the count expected in as much text as the target has."""
    rows = df.select(F.col(f"`{text}`").alias("text"), F.col(f"`{is_target}`").alias("target"))
    counted = rows.mapInArrow(_count, "bucket int, raw long, target long")
    got = counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    at = np.asarray(got.column("bucket"))
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[at], target[at] = np.asarray(got.column("raw")), np.asarray(got.column("target"))
    expected = raw * (target.sum() / max(raw.sum(), 1))
    return np.log((target + SMOOTHING) / (expected + SMOOTHING))


def sortable(values: np.ndarray) -> np.ndarray:
    """Integers in the order of the doubles."""
    bits = np.asarray(values, np.float64).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


def kth_largest(df: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest value of a long column, exactly, by four counts over 16 bits each.

    Every count gives at most 65,536 rows, however long the table is. ``df`` should be written.
    None if there are fewer than k values.
    """
    rows, prefix = df.filter(F.col(column).isNotNull()).select(F.col(column).alias("v")), None
    for shift in (48, 32, 16, 0):
        if prefix is not None:
            rows = rows.filter(F.shiftright("v", shift + 16) == prefix)
        counts = {r.d: r.n for r in rows.groupBy(F.shiftright("v", shift).alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
        for digit in sorted(counts, reverse=True):
            if k <= counts[digit]:
                prefix = digit
                break
            k -= counts[digit]
        else:
            return None
    return prefix


def resample(
    df: DataFrame, is_target: str, share: float, key: str = "doc_id", text: str = "text", seed: int = SEED
) -> DataFrame:
    """One row for each row: key, n_ngrams, log_weight, gumbel_key and kept.

    ``is_target`` is a boolean column (null: false) that marks target rows; the raw model
    counts all rows. ``share`` of the rows with an n-gram are kept, rounded up. Texts without
    a word, null ones included, have no weight (null) and are not kept. Noise depends on seed
    and key only, so rows with one key and text share a sum and are kept or left together;
    such a tie at the border keeps all of it. Other columns are ignored.
    """
    ratios = log_ratios(df, text, is_target)

    def work(batch: pa.RecordBatch) -> dict[str, np.ndarray | pa.Array]:
        noise = np.asarray(batch.column(1))
        n, total = [np.empty(0, np.int64)], [np.empty(0)]
        for block in texts.blocks(batch.column(2)):
            bucket, owner = ngram_buckets(block)
            n.append(np.bincount(owner, minlength=len(block.starts)))
            total.append(np.bincount(owner, ratios[bucket], len(block.starts)))
        n, total = np.concatenate(n), np.concatenate(total)
        empty = n == 0
        keys = total - np.log(-np.log(noise))
        return {
            "n_ngrams": n,
            "log_weight": pa.array(total, mask=empty),
            "gumbel_key": pa.array(keys, mask=empty),
            "_order": pa.array(sortable(keys), mask=empty),
        }

    noise = uniform(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null")), seed) + F.lit(0.5 / 4294967296.0)
    narrow = df.select(F.col(f"`{key}`").alias("key"), noise.alias("noise"), F.col(f"`{text}`").alias("text"))
    weighed = materialize(texts.map_texts(narrow, ["key", "noise"], "text", FIELDS, work), "weights")
    rows = weighed.filter(F.col("_order").isNotNull()).count()
    least = kth_largest(weighed, "_order", max(int(np.ceil(share * rows)), 1)) if rows else None
    kept = F.coalesce(F.col("_order") >= F.lit(least), F.lit(False)) if least is not None else F.lit(False)
    return weighed.select(F.col("key").alias(key), "n_ngrams", "log_weight", "gumbel_key", kept.alias("kept"))


def bounded_sample(labels: DataFrame, key: str, rows: int) -> DataFrame:
    """About ``rows`` rows at most, chosen by a hash of the key; all if there are fewer."""
    step = -(-labels.count() // rows) or 1
    return labels.filter(F.pmod(F.xxhash64(F.col(key)), F.lit(step)) == 0)


def target_marks(df: DataFrame, labels: DataFrame, label: Column, rows: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and text of ``df`` and _target: whether a bounded sample of labelled rows marks the key.

    The sample is about ``rows`` keys, so it may be broadcast at any size of the table.
    """
    marked = labels.filter(label & F.col(key).isNotNull()).select(F.col(key).alias("_marked")).distinct()
    marked = bounded_sample(marked, "_marked", rows)
    narrow = df.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias(text))
    joined = narrow.join(F.broadcast(marked), F.col(key) == F.col("_marked"), "left")
    return joined.select(key, text, F.col("_marked").isNotNull().alias("_target"))
