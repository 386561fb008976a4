"""Substring dedup by lines and paragraphs: repeated units stay where they come first, and go elsewhere.

Units are the runs of consecutive lines that just reach a number of words (a long line is one by
itself) and paragraphs, the lines between blank ones. They are normalised to their words and
hashed, digests grouped over the whole table, and the lines of every later occurrence removed;
what was removed is told by its offsets in the original text. A passage of short lines is thus
found like a long line is, and a paragraph wrapped in another way has the digest of its words.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packfold.llm import texts
from packfold.plans.ordinals import join_keyed
from packfold.plans.skew import lookup_skewed
from packfold.session import materialize

# Words of a unit, at least. Shorter lines that recur one by one do so by chance or by layout.
MIN_WORDS = 8

# Lines of a unit: the first and the last, and the digest of all its words.
UNIT = T.StructType(
    [T.StructField("unit", T.IntegerType()), T.StructField("last", T.IntegerType()), T.StructField("digest", T.BinaryType())]
)
FIELDS = [("n_units", T.LongType()), ("units", T.ArrayType(UNIT))]
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def digests(text: str | None, separator: str = "\n", min_words: int = MIN_WORDS) -> tuple[int, list[tuple[int, int, bytes]]]:
    """Number of lines that hold a word, and (first line, last line, digest) of the units.

    A unit is normalised to its words in lower case (A-Z), joined by single spaces. From every
    line with a word on there is one run, over blank lines if need be, unless the text ends
    before it has its words."""
    lines = [line.encode("utf-8", "replace").lower().split() for line in (text or "").split(separator)]
    filled = [i for i, words in enumerate(lines) if words]
    spans, end, held = set(), 0, 0
    for at, first in enumerate(filled):
        while end < len(filled) and held < min_words:
            held += len(lines[filled[end]])
            end += 1
        if held >= min_words:
            spans.add((first, filled[end - 1]))
        held -= len(lines[first])
    block: list[int] = []
    for i in [*filled, len(lines) + 1]:
        if block and i != block[-1] + 1:
            if sum(len(lines[k]) for k in block) >= min_words:
                spans.add((block[0], block[-1]))
            block = []
        block.append(i)
    digest = lambda a, b: hashlib.md5(b" ".join(w for words in lines[a : b + 1] for w in words)).digest()
    return len(filled), [(a, b, digest(a, b)) for a, b in sorted(spans)]


def _filled(line: str) -> bool:
    return bool(line.encode("utf-8", "replace").split())


def dedup_units(
    df: DataFrame, key: str = "doc_id", text: str = "text", *, separator: str = "\n", min_words: int = MIN_WORDS
) -> DataFrame:
    """One row for each row: key, n_units (lines with a word), removed and kept_text.

    Occurrences of a unit are ranked by key (null first), text hash and place; the first of a
    digest stays, the lines of all others go, but for blank ones. With ``min_words`` 1 every line
    is a unit. ``removed`` has (start, end) of the lines in code points of the original text,
    separators not counted; ``kept_text`` is the other lines joined by the separator. What goes
    is always found earlier, so every line's words stay somewhere. A null text is empty and
    stays null. Rows that repeat a key and its text are one document and get one result. Other
    columns are ignored. A digest that a third of all lines share is grouped map-side first
    and looked up without its rows meeting in one task. Texts are cut whole, however long.
    """
    own = F.xxhash64(F.col(f"`{text}`"))
    docs = df.select(F.col(f"`{key}`").alias("key"), own.alias("hash"), F.col(f"`{text}`").alias("text"))

    def find(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        n_units, ends, unit, last, digest = [], [0], [], [], []
        for one in batch.column(2):
            n, found = digests(one.as_py(), separator, min_words)
            n_units.append(n)
            for first, end, name in found:
                unit.append(first), last.append(end), digest.append(name)
            ends.append(len(unit))
        flat = pa.StructArray.from_arrays(
            [pa.array(unit, pa.int32()), pa.array(last, pa.int32()), pa.array(digest, pa.binary())], names=["unit", "last", "digest"]
        )
        return {"n_units": pa.array(n_units, pa.int64()), "units": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)}

    with texts.small_batches(df.sparkSession):
        found = materialize(texts.map_texts(docs, ["key", "hash"], "text", FIELDS, find), "units")
    units = found.select("key", "hash", F.inline("units"))
    rank = F.struct("key", "hash", "unit")
    firsts = units.groupBy("digest").agg(F.count(F.lit(1)).alias("times"), F.min(rank).alias("first"))
    firsts = materialize(firsts.filter(F.col("times") > 1), "first-units")
    scatter = F.unhex(F.md5(F.concat_ws(" ", F.col("key").cast("string"), F.col("hash"), F.col("unit"))))
    placed = lookup_skewed(units, firsts, "digest", "times", scatter)
    later = placed.filter(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(rank))
    removed = later.groupBy("key", "hash").agg(F.collect_set(F.struct("unit", "last")).alias("gone"))
    # all rows of a document have one count
    counts = found.groupBy("key", "hash").agg(F.max("n_units").alias("n_units"))
    verdicts = materialize(join_keyed(counts, removed, ["key", "hash"], "left"), "unit-verdicts")
    joined = join_keyed(docs, verdicts, ["key", "hash"], "left")

    def cut(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        kept, spans = [], []
        for gone, whole in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            own, drop = [], {i for u in gone or () for i in range(u["unit"], u["last"] + 1)}
            if drop:
                lines, at = whole.split(separator), 0
                for i, line in enumerate(lines):
                    if i in drop and _filled(line):
                        own.append((at, at + len(line)))
                    at += len(line) + len(separator)
                whole = separator.join(line for i, line in enumerate(lines) if i not in drop or not _filled(line))
            kept.append(whole)
            spans.append(own)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return {"removed": pa.array(spans, kind), "kept_text": pa.array(kept, pa.string())}

    made = texts.map_texts(joined, ["key", "n_units", "gone"], "text", [("removed", SPANS), ("kept_text", T.StringType())], cut)
    return made.select(F.col("key").alias(key), "n_units", "removed", "kept_text")
