"""Toxicity score: subword-bag embeddings averaged into a linear softmax.

A text is the bag of its lower-case words and of their character n-grams (with word borders),
each hashed to a row of one embedding table. The rows are averaged over the bag and a linear
softmax reads the average; table and softmax are trained together in numpy. A misspelling
never seen in training shares most of its character n-grams with the word it stands for.

Training uses a bounded, documented sample of labelled rows (``TRAINING_ROWS``); scoring covers
every row and every word. Since softmax of an average is linear in the rows, a trained model
is one number per row: the difference of the two classes' logits.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packfold.llm import texts
from packfold.llm.resampling import kth_largest
from packfold.llm.texts import U64, Block
from packfold.session import materialize

# So many labelled keys of class 0 and of class 1 at most are used for training, the last by hash.
TRAINING_ROWS = (3_000, 1_500)
BUCKETS = 1 << 17
SIZES = (3, 4, 5)
DIMENSIONS = 4
# Bytes of text at a time; every byte stands in several n-grams.
BLOCK = 1 << 19
EPOCHS = 12
THRESHOLD = 0.7


class Bag(NamedTuple):
    """Words of a block with their text, and the features of the distinct ones.

    Distinct word w has the features feature[offset[w]:offset[w + 1]]."""

    text: np.ndarray
    word: np.ndarray
    feature: np.ndarray
    offset: np.ndarray


def bag(block: Block) -> Bag:
    found = texts.runs(block, texts.ALNUM)
    sums = texts.prefix_hash(block.data, texts.LOWER)
    hashes = texts.slice_hash(sums, found.start, found.end)
    kinds, first, word = np.unique(hashes, return_index=True, return_inverse=True)
    start, length = found.start[first], (found.end - found.start)[first]
    # the distinct words one after the other, as <word>
    offset = np.zeros(len(kinds) + 1, np.int64)
    np.cumsum(length + 2, out=offset[1:])
    flat = np.empty(offset[-1], np.uint8)
    inner = np.repeat(start - offset[:-1] - 1, length + 2) + np.arange(offset[-1])
    flat[:] = block.data[np.clip(inner, 0, max(len(block.data) - 1, 0))] if len(block.data) else 0
    flat[offset[:-1]] = ord("<")
    flat[offset[1:] - 1] = ord(">")
    upper = (flat >= 65) & (flat <= 90)
    flat[upper] += 32
    begins = np.flatnonzero((flat & 0xC0) != 0x80)
    edges = np.append(begins, len(flat))
    owner = np.repeat(np.arange(len(kinds)), length + 2)[begins]
    flat_sums = texts.prefix_hash(flat)
    feature, owners = [texts.mix(kinds)], [np.arange(len(kinds))]
    for n in SIZES:
        if len(begins) >= n:
            whole = np.flatnonzero(owner[: len(begins) - n + 1] == owner[n - 1 :])
            feature.append(texts.slice_hash(flat_sums, edges[whole], edges[whole + n]))
            owners.append(owner[whole])
    all_owners = np.concatenate(owners)
    order = np.argsort(all_owners, kind="stable")
    counts = np.bincount(all_owners, minlength=len(kinds))
    feature_offset = np.zeros(len(kinds) + 1, np.int64)
    np.cumsum(counts, out=feature_offset[1:])
    buckets = (np.concatenate(feature)[order] & U64(BUCKETS - 1)).astype(np.int32)
    return Bag(found.text, word, buckets, feature_offset)


class Model(NamedTuple):
    """Logit difference of every row of the embedding table, and of the empty text."""

    rows: np.ndarray
    bias: float


def logits(block: Block, model: Model) -> np.ndarray:
    made = bag(block)
    sums = np.concatenate([[0.0], np.cumsum(model.rows[made.feature])])
    per_word = sums[made.offset[1:]] - sums[made.offset[:-1]]
    sizes = np.diff(made.offset)
    total = texts.per_text(block, made.text, per_word[made.word])
    count = texts.per_text(block, made.text, sizes[made.word].astype(float))
    return model.bias + total / np.maximum(count, 1)


def fit(size: np.ndarray, bucket: Callable[[int], np.ndarray], weight: Callable[[int], np.ndarray], label: np.ndarray, seed: int = 7) -> Model:
    """Train on bags: bag i has size[i] features bucket(i), each with its share weight(i).

    Mini-batches with Adagrad steps; every batch updates the table and the softmax together.
    """
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    soft = rng.normal(0, 1.0, (DIMENSIONS, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    seen_table = np.full(BUCKETS, 1e-8, np.float32)
    seen_soft, seen_bias = np.full(soft.shape, 1e-8, np.float32), np.full(2, 1e-8, np.float32)
    together = 64
    for epoch in range(EPOCHS):
        rate = 1.0 * (1 - epoch / EPOCHS)
        order = rng.permutation(len(label))
        for at in range(0, len(order), together):
            chosen = order[at : at + together]
            rows = np.concatenate([bucket(i) for i in chosen])
            share = np.concatenate([weight(i) for i in chosen])
            row_text = np.repeat(np.arange(len(chosen)), size[chosen])
            ids, back = np.unique(rows, return_inverse=True)
            own = table[ids]
            average = np.stack(
                [np.bincount(row_text, own[back, d] * share, len(chosen)) for d in range(DIMENSIONS)], axis=1
            ).astype(np.float32)
            scores = average @ soft + bias
            scores -= scores.max(axis=1, keepdims=True)
            likely = np.exp(scores)
            likely /= likely.sum(axis=1, keepdims=True)
            likely[np.arange(len(chosen)), label[chosen]] -= 1
            error = likely / len(chosen)
            to_soft, to_bias, to_average = average.T @ error, error.sum(axis=0), error @ soft.T
            pulled = np.stack(
                [np.bincount(back, to_average[row_text, d] * share, len(ids)) for d in range(DIMENSIONS)], axis=1
            ).astype(np.float32)
            seen_table[ids] += (pulled**2).mean(axis=1)
            table[ids] -= rate * pulled / np.sqrt(seen_table[ids])[:, None]
            seen_soft += to_soft**2
            soft -= 0.1 * rate * to_soft / np.sqrt(seen_soft)
            seen_bias += to_bias**2
            bias -= 0.1 * rate * to_bias / np.sqrt(seen_bias)
    return Model((table @ (soft[:, 1] - soft[:, 0])).astype(np.float64), float(bias[1] - bias[0]))


def counts(block: Block) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text of the block, the distinct features of its bag, ascending, and how often each is in it."""
    made = bag(block)
    sizes = np.diff(made.offset)[made.word]
    before = np.cumsum(sizes) - sizes
    at = np.repeat(made.offset[:-1][made.word] - before, sizes) + np.arange(sizes.sum())
    key, n = np.unique(
        np.repeat(made.text, sizes).astype(np.int64) * BUCKETS + made.feature[at], return_counts=True
    )
    edges = np.searchsorted(key, np.arange(len(block.starts) + 1) * BUCKETS)
    return [((key[a:b] % BUCKETS).astype(np.int32), n[a:b]) for a, b in zip(edges[:-1], edges[1:])]


# A bag as it travels: the low 16 bits of its features, how many are below 2 ** 16, and their
# counts, in one byte each if all fit. With BUCKETS rows a feature has one bit more.
PACKED = [("low", T.BinaryType()), ("below", T.IntegerType()), ("count", T.BinaryType())]


def _bags(batch: pa.RecordBatch) -> dict[str, pa.Array]:
    made = [pair for block in texts.blocks(batch.column(2), BLOCK) for pair in counts(block)]
    kinds = [np.uint8 if not len(n) or n.max() < 256 else np.uint32 for _, n in made]
    return {
        "low": pa.array([b.astype(np.uint16).tobytes() for b, _ in made], pa.binary()),
        "below": pa.array([int(np.searchsorted(b, 1 << 16)) for b, _ in made], pa.int32()),
        "count": pa.array([n.astype(kind).tobytes() for (_, n), kind in zip(made, kinds)], pa.binary()),
    }


class Bags:
    """Packed bags in the order ``order`` of their rows; one is unpacked when it is asked for."""

    def __init__(self, table: pa.Table, order: np.ndarray):
        self.order, self.below = order, np.asarray(table.column("below"))
        self.low, self.count = (table.column(name).combine_chunks() for name in ("low", "count"))
        self.size = np.asarray(pc.binary_length(self.low))[order] // 2

    def bucket(self, i: int) -> np.ndarray:
        made = np.frombuffer(self.low[self.order[i]].as_buffer(), np.uint16).astype(np.int32)
        made[self.below[self.order[i]] :] += 1 << 16
        return made

    def share(self, i: int) -> np.ndarray:
        data = self.count[self.order[i]].as_buffer()
        n = np.frombuffer(data, np.uint8 if data.size == self.size[i] else np.uint32).astype(np.int64)
        return (n / max(n.sum(), 1)).astype(np.float32)


def train(df: DataFrame, labels: DataFrame, trainable: Column, key: str, text: str, label: str) -> Model:
    """Fit on a bounded sample of the labelled rows for which ``trainable`` holds.

    The bags are made by Spark tasks; those of at most ``sum(TRAINING_ROWS)`` keys reach the
    driver, which fits the table. A key labelled twice counts as 1 if any label is 1. Classes
    sampled at different rates shift the odds by the ratio of the rates; the bias takes that
    back, so scores stand for the labels' own share of class 1 at every size of the table.
    Without rows of both classes every text scores the share of class 1.
    """
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & trainable)
    known = known.groupBy(key).agg(F.max(F.col(label)).cast("int").alias("_label"))
    known = materialize(known.select(F.col(key).alias("_labelled"), "_label", F.xxhash64(key).alias("_hash")), "labelled")
    sample, log_rates = None, []
    for value, rows in enumerate(TRAINING_ROWS):
        part = known.filter(F.col("_label") == value)
        count = part.count()
        if count > rows:
            part = part.filter(F.col("_hash") >= F.lit(kth_largest(part, "_hash", rows)))
        log_rates.append(np.log(min(rows, count) / count) if count else 0.0)
        sample = part if sample is None else sample.union(part)
    sample = sample.select("_labelled", "_label")
    chosen = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).join(
        F.broadcast(sample), F.col("key") == F.col("_labelled")
    )
    with texts.small_batches(df.sparkSession):
        got = texts.map_texts(chosen, ["key", "_label"], "text", PACKED, _bags).toArrow()
    target = np.asarray(got.column("_label")).astype(np.int64)
    if len(set(target.tolist())) < 2:
        rate = (target.sum() + 1) / (len(target) + 2)
        return Model(np.zeros(BUCKETS), float(np.log(rate / (1 - rate))))
    order = np.asarray(pc.sort_indices(got.column("key")))
    bags = Bags(got, order)
    del got
    model = fit(bags.size, bags.bucket, bags.share, target[order])
    return model._replace(bias=model.bias - float(log_rates[1] - log_rates[0]))


def scored(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``key`` and ``keep`` columns, score (0 to 1) and predicted (1 from THRESHOLD on)."""

    def work(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        column = batch.column(batch.num_columns - 1)
        parts = [np.empty(0)] + [logits(b, model) for b in texts.blocks(column, BLOCK)]
        score = 1 / (1 + np.exp(-np.clip(np.concatenate(parts), -700, 700)))
        return {"score": score, "predicted": (score >= THRESHOLD).astype(np.int32)}

    return texts.map_texts(df, [key, *keep], text, [("score", T.DoubleType()), ("predicted", T.IntegerType())], work)


def held_out(key: str) -> Column:
    """Whether labels of this key are kept from training: crc32 of the key as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))


def toxicity(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """One row for each row: key, held_out, score, predicted.

    Only the text is an input of the score; a null text is an empty one and scores what the
    softmax's bias gives, as do texts without a letter or digit. Repeated rows score alike.
    Other columns, of whatever name, are ignored. Keys may be null; such rows have no label.
    """
    model = train(df, labels, ~held_out(key), key, text, label)
    return scored(df, model, key, text).select(key, held_out(key).alias("held_out"), "score", "predicted")
