"""Word ids from a vocabulary of any size.

The vocabulary is a table of its own: words by falling frequency, numbered without a driver. The
words at its head make up nearly all of a text and are few, so they travel with the tasks
and are looked up in place; only the places of rarer words are joined with the table and brought
back to their text, a small part of all words.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packfold.functions.tokenizers import WORD_PATTERN
from packfold.plans.ordinals import join_keyed, ordinals
from packfold.plans.skew import lookup_skewed
from packfold.session import arrow_rows, materialize

# Ids below stand for padding, begin, end and an unknown word.
UNKNOWN = 3
FIRST_ID = 4
# Words that travel with the tasks, and the longest of them in bytes.
HEAD_WORDS = 32_000
HEAD_BYTES = 64
# Texts whose words a Python function holds at once.
TEXTS_AT_ONCE = 500

IDS = "array<int>"
RARE = "array<struct<place:int,word:string>>"
FAR = "array<struct<place:int,id:bigint>>"


def learn_vocabulary(df: DataFrame, column: str = "text", *, min_count: int = 1, pattern: str = WORD_PATTERN) -> DataFrame:
    """Every word found ``min_count`` times: ``word``, ``id`` and ``n``. Ids rise from 4 as
    frequency falls, equal ones in word order. The table is written and can be saved."""
    word = F.explode(F.regexp_extract_all(column, F.lit(pattern), F.lit(0))).alias("word")
    counted = df.select(word).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)
    ranked = ordinals(counted.withColumn("_rank", -F.col("n")), ["_rank", "word"], carry={"n": F.col("n")}).frame
    return materialize(ranked.select("word", (F.col("ordinal") + FIRST_ID).alias("id"), "n"), "vocabulary")


def encode_words(
    df: DataFrame,
    vocabulary: DataFrame,
    key: str,
    *,
    column: str = "text",
    keep: Sequence[str] = (),
    output_column: str = "input_ids",
    head_words: int = HEAD_WORDS,
    pattern: str = WORD_PATTERN,
) -> DataFrame:
    """``key`` (unique), ``keep`` and the ids of all words; a word without an id is unknown (3).

    A null text has null ids. Texts are split once; words that are not at the head of the
    vocabulary are looked up in it by a shuffled join that no frequent word slows down.
    """
    kept = list(dict.fromkeys([key, *keep]))
    near = _near(head_words)
    head = {row.word: row.id for row in vocabulary.filter(near).select("word", "id").collect()}
    words = F.regexp_extract_all(column, F.lit(pattern), F.lit(0))
    looked = F.arrow_udf(_head_lookup(head), f"struct<ids:{IDS},rare:{RARE}>")(words).alias("_found")
    split = df.select(*[F.col(c) for c in kept], looked)
    with arrow_rows(df.sparkSession, TEXTS_AT_ONCE):
        split = materialize(split.select(*kept, "_found.ids", "_found.rare"), "words")

    rare = split.select(F.col(key).alias("_key"), F.inline("rare"))
    far = vocabulary.filter(~near).select("word", "id", "n")
    found = lookup_skewed(rare, far, "word", "n", F.concat(F.lit("\0"), F.xxhash64("_key", "place").cast("string")))
    filled = F.struct("place", F.coalesce("id", F.lit(UNKNOWN)).cast("int").alias("id"))
    per_text = found.groupBy("_key").agg(F.collect_list(filled).alias("_late")).withColumnRenamed("_key", key)
    joined = join_keyed(split, per_text, [key], "left")
    whole = F.arrow_udf(_fill(), IDS)("ids", "_late")
    return joined.select(*kept, whole.alias(output_column))


def _near(head_words: int) -> Column:
    """Whether a row of a vocabulary is at its head."""
    return (F.col("id") < FIRST_ID + head_words) & (F.octet_length("word") <= HEAD_BYTES)


def _head_lookup(head: dict[str, int]):
    """Ids of frequent words, -1 for others, and the places and words of those."""

    def look_up(lists: object) -> object:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        known = pa.array(list(head), pa.string())
        numbers = pa.array(list(head.values()), pa.int32())
        offsets = lists.offsets.to_numpy()
        words = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).cast(pa.string())
        ids = pc.fill_null(numbers.take(pc.index_in(words, value_set=known)), -1)
        starts = (offsets - offsets[0]).astype(np.int32)
        other = np.flatnonzero(ids.to_numpy() < 0)
        owner = np.searchsorted(starts, other, side="right") - 1
        places = pa.array((other - starts[owner]).astype(np.int32))
        rare = pa.StructArray.from_arrays([places, words.take(pa.array(other))], names=["place", "word"])
        cuts = pa.array(np.searchsorted(other, starts).astype(np.int32))
        missing = lists.is_null()
        found = [
            pa.ListArray.from_arrays(pa.array(starts), ids, mask=missing),
            pa.ListArray.from_arrays(cuts, rare, mask=missing),
        ]
        return pa.StructArray.from_arrays(found, names=["ids", "rare"])

    return _annotated(look_up)


def _fill():
    def fill(ids: object, late: object) -> object:
        import numpy as np
        import pyarrow as pa

        offsets = ids.offsets.to_numpy()
        values = ids.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].copy()
        starts = offsets - offsets[0]
        cuts = late.offsets.to_numpy()
        given = late.values.slice(cuts[0], cuts[-1] - cuts[0])
        rows = np.repeat(np.arange(len(ids)), np.diff(cuts))
        at = starts[rows] + given.field("place").to_numpy(zero_copy_only=False)
        if len(at) != np.count_nonzero(values < 0):
            raise ValueError("two rows share a key")
        values[at] = given.field("id").to_numpy(zero_copy_only=False)
        return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(values, pa.int32()), mask=ids.is_null())

    return _annotated(fill)


def _annotated(fn):
    """Spark takes the kind of function from its annotations, which must be types here."""
    import pyarrow as pa

    fn.__annotations__ = dict.fromkeys(fn.__annotations__, pa.Array)
    return fn


def decode_words(
    df: DataFrame,
    vocabulary: DataFrame,
    key: str,
    *,
    column: str = "input_ids",
    output_column: str = "text",
    head_words: int = HEAD_WORDS,
) -> DataFrame:
    """``key`` and the words of all ids, one space between them; ids below 4, and those that the
    vocabulary lacks, stand for no word. Null ids give null text.

    Ids are written once. Words at the head of the vocabulary are put in where the ids lie; only
    the places of others are looked up by a shuffled join and brought back to their row.
    """
    near = _near(head_words)
    head = {row.id: row.word for row in vocabulary.filter(near).select("word", "id").collect()}
    split = df.select(F.col(key), F.col(column).alias("_ids"), F.monotonically_increasing_id().alias("_row"))
    with arrow_rows(df.sparkSession, TEXTS_AT_ONCE):
        split = materialize(split.withColumn("_far", F.arrow_udf(_beyond_head(list(head)), FAR)("_ids")), "ids")

    places = split.select("_row", F.inline("_far"))
    scatter = -F.pmod(F.xxhash64("_row", "place"), F.lit(1 << 62)) - 1
    found = lookup_skewed(places, vocabulary.filter(~near).select("word", "id", "n"), "id", "n", scatter)
    late = found.filter(F.col("word").isNotNull()).groupBy("_row").agg(F.collect_list(F.struct("place", "word")).alias("_late"))
    joined = split.drop("_far").join(late, "_row", "left")
    return joined.select(key, F.arrow_udf(_words_of(head), "string")("_ids", "_late").alias(output_column))


def _beyond_head(head: list[int]):
    """Places and ids of words that are not among ``head``."""

    def beyond(ids: object) -> object:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        offsets = ids.offsets.to_numpy()
        values = pc.fill_null(ids.values.slice(offsets[0], offsets[-1] - offsets[0]), -1)
        known = pc.is_in(values, value_set=pa.array(head, pa.int32())).to_numpy(zero_copy_only=False)
        starts = (offsets - offsets[0]).astype(np.int32)
        at = np.flatnonzero(~known & (values.to_numpy() >= FIRST_ID))
        owner = np.searchsorted(starts, at, side="right") - 1
        fields = [pa.array((at - starts[owner]).astype(np.int32)), values.take(pa.array(at)).cast(pa.int64())]
        flat = pa.StructArray.from_arrays(fields, names=["place", "id"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(at, starts).astype(np.int32)), flat)

    return _annotated(beyond)


def _words_of(head: dict[int, str]):
    """The words of ids as one text: those of the head, and late ones at their places."""

    def words_of(ids: object, late: object) -> object:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        offsets = ids.offsets.to_numpy()
        starts = (offsets - offsets[0]).astype(np.int64)
        values = ids.values.slice(offsets[0], offsets[-1] - offsets[0])
        at = pc.fill_null(pc.index_in(values, value_set=pa.array(list(head), pa.int32())), -1).to_numpy().copy()
        at[pc.fill_null(values, -1).to_numpy() < FIRST_ID] = -1
        cuts = late.offsets.to_numpy()
        given = late.values.slice(cuts[0], cuts[-1] - cuts[0])
        rows = np.repeat(np.arange(len(ids)), np.diff(cuts))
        at[starts[rows] + given.field("place").to_numpy(zero_copy_only=False)] = len(head) + np.arange(len(given))
        words = pa.concat_arrays([pa.array(list(head.values()), pa.string()), given.field("word").cast(pa.string())])
        ends = np.concatenate([[0], np.cumsum(at >= 0)])[starts].astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), words.take(pa.array(at[at >= 0])), mask=ids.is_null())
        return pc.binary_join(lists, " ")

    return _annotated(words_of)
