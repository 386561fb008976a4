"""Benchmark decontamination by winnowing.

Every window of words is represented by one fingerprint, the least hash of the k-grams in it,
so a shared window always shares its fingerprint. Windows of documents whose fingerprint the
benchmark has are extended to the whole window and joined on both. What is found is exact, up
to equal 64-bit hashes: each shared span of WINDOW words or more is found from end to end.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packfold.llm import texts
from packfold.llm.texts import U64, Block
from packfold.session import materialize

# Words of a window, and of the k-grams that are fingerprints. A shorter item is one window.
WINDOW, GRAM = 10, 5
# Bits of the filter that spares most windows the join; 2 MB for a benchmark of any size.
FILTER_BITS = 1 << 24

CANDIDATE = T.ArrayType(
    T.StructType(
        [
            T.StructField("n", T.IntegerType()),
            T.StructField("mark", T.LongType()),
            T.StructField("window", T.LongType()),
            T.StructField("at", T.IntegerType()),
        ]
    )
)
FIELDS = [("n_words", T.LongType()), ("windows", CANDIDATE)]


def words_of(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of every word, A-Z as a-z."""
    found = texts.runs(block, texts.ALNUM)
    return texts.slice_hash(texts.prefix_hash(block.data, texts.LOWER), found.start, found.end), found.text


def _joined(words: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    total = np.zeros(len(at), U64)
    for k in range(n):
        total = total * texts.STEP + words[at + k]
    return texts.mix(total ^ U64(n))


def marks(words: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and fingerprint of every window of n words: the least k-gram hash in it."""
    if len(words) < n:
        return np.empty(0, np.int64), np.empty(0, U64)
    k = min(GRAM, n)
    grams = _joined(words, np.arange(len(words) - k + 1), k)
    last = len(words) - n + 1
    least = grams[:last].copy()
    for shift in range(1, n - k + 1):
        np.minimum(least, grams[shift : shift + last], out=least)
    first = np.flatnonzero(text[:last] == text[n - 1 :])
    return first, texts.mix(least[first] ^ U64(n))


def _filter_bit(mark: np.ndarray) -> np.ndarray:
    return (mark & U64(FILTER_BITS - 1)).astype(np.int64)


def find_windows(column: pa.Array, lengths: list[int] | None, passing: np.ndarray | None) -> dict[str, pa.Array]:
    """Per text its number of words and its windows.

    For items (``lengths`` None): all windows, of WINDOW words or of the whole item. For
    documents: windows of the given lengths whose fingerprint passes the filter.
    """
    n_words, counts, rows = [np.empty(0, np.int64)], [np.empty(0, np.int64)], []
    for block in texts.blocks(column):
        words, text = words_of(block)
        size = np.bincount(text, minlength=len(block.starts))
        first_word = np.cumsum(size) - size
        own, found = [], []
        for n in lengths if lengths is not None else range(1, WINDOW + 1):
            at, mark = marks(words, text, n)
            if lengths is None:
                chosen = np.flatnonzero(np.minimum(size, WINDOW)[text[at]] == n)
            else:
                chosen = np.flatnonzero(passing[_filter_bit(mark)])
            at = at[chosen]
            own.append(text[at])
            found.append((np.full(len(at), n), mark[chosen], _joined(words, at, n), at - first_word[text[at]]))
        own = np.concatenate(own) if own else np.empty(0, np.int64)
        order = np.argsort(own, kind="stable")
        rows.append([np.concatenate(x)[order] for x in zip(*found)] if found else [np.empty(0)] * 4)
        n_words.append(size)
        counts.append(np.bincount(own, minlength=len(block.starts)))
    n, mark, window, at = (np.concatenate(x) for x in zip(*rows)) if rows else [np.empty(0, U64)] * 4
    fields = [n.astype(np.int32), mark.astype(U64).view(np.int64), window.astype(U64).view(np.int64), at.astype(np.int32)]
    flat = pa.StructArray.from_arrays([pa.array(x) for x in fields], names=["n", "mark", "window", "at"])
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int32)
    return {"n_words": pa.array(np.concatenate(n_words)), "windows": pa.ListArray.from_arrays(pa.array(offsets), flat)}


def item_windows(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    """Distinct (n, mark, window, item) of a benchmark; items without a word have none."""
    made = texts.map_texts(benchmark, [item], text, FIELDS, lambda batch: find_windows(batch.column(1), None, None))
    name = F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item")
    return made.select(name, F.inline("windows")).select("n", "mark", "window", "item").distinct()


def _passing(marked: DataFrame) -> np.ndarray:
    """The filter: which values of a fingerprint's low bits occur. At most FILTER_BITS / 64 rows
    come to the driver."""
    low = F.col("mark").bitwiseAND(F.lit(FILTER_BITS - 1))
    word = F.shiftright(low, 6).alias("word")
    bit = F.expr("shiftleft(1L, cast(mark & 63 as int))").alias("bit")
    got = marked.select(word, bit).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(FILTER_BITS // 64, np.int64)
    words[np.asarray(got.column("word"))] = np.asarray(got.column("bits"))
    return np.unpackbits(words.view(np.uint8), bitorder="little").astype(np.bool_)


def covered(spans: Column) -> Column:
    """Number of positions inside any of the sorted spans (at, n)."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))

    def step(seen: Column, span: Column) -> Column:
        begin = F.greatest(seen["end"], span["at"].cast("long"))
        end = F.greatest(seen["end"], (span["at"] + span["n"]).cast("long"))
        return F.struct((seen["n"] + end - begin).alias("n"), end.alias("end"))

    return F.aggregate(F.sort_array(spans), start, step, lambda seen: seen["n"])


def contamination(
    df: DataFrame, benchmark: DataFrame, keep: Sequence[str], text: str = "text", item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """One row for each row: ``keep`` columns, n_words, n_hit, items (ids as strings, sorted)
    and contaminated.

    A word is hit if it lies inside any occurrence of an item's window. Null texts have no
    words. Repeated rows are judged one by one; repeated items count once, an item without an
    id as "". An empty benchmark hits nothing. Columns that are not kept are ignored. Whatever the
    benchmark's size, tasks hold a filter of FILTER_BITS bits; the windows that pass it are
    joined by Spark.
    """
    known = materialize(item_windows(benchmark, item, item_text), "item-windows")
    lengths = sorted(r[0] for r in known.select("n").distinct().collect())
    passing = _passing(known)
    inner = [f"_c{i}" for i in range(len(keep))]
    named = df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, inner)], F.col(f"`{text}`").alias("text"))

    def find(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        return find_windows(batch.column(batch.num_columns - 1), lengths, passing)

    found = texts.map_texts(named, inner, "text", FIELDS, find)
    rows = materialize(found.withColumn("row", F.monotonically_increasing_id()), "document-windows")

    places = rows.filter(F.size("windows") > 0).select("row", F.inline("windows"))
    hits = places.join(known.select("n", "mark", "window").distinct(), ["n", "mark", "window"])
    hits = materialize(hits.select("row", "n", "mark", "window", "at"), "hits")
    spans = hits.groupBy("row").agg(covered(F.collect_set(F.struct("at", "n"))).alias("n_hit"))
    items = (
        hits.select("row", "n", "mark", "window").distinct().join(known, ["n", "mark", "window"])
        .groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    )
    joined = rows.select("row", *inner, "n_words").join(spans, "row", "left").join(items, "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return joined.select(
        *[F.col(k).alias(c) for k, c in zip(inner, keep)],
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        (n_hit > 0).alias("contaminated"),
    )
