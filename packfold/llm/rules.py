"""Quality rules: counts per text, and how far its histograms are from its language's.

Two histograms of a text (character classes, and the language's commonest words against all
others) are compared with references by Jensen-Shannon distance. The references are counted over all
rows of the table, one for each language that has enough text of its own, whatever else the table
holds. Short texts have histograms too noisy to judge, and a language of little text none that
anything could be held against, so each test passes below its minimum length.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packfold.llm import texts
from packfold.llm.texts import U64, Block
from packfold.plans.skew import lookup_skewed
from packfold.session import materialize

# Words that a language's reference names; all others share one bin.
COMMON_WORDS = 100
# Words that make a reference: below that a language's rows pass both tests.
MIN_REFERENCE_WORDS = 20_000
# References that travel with the tasks, those of most words first; any others meet their rows by
# a join.
NEAR_LANGUAGES = 1_000
MIN_CHARACTERS = 250
MIN_WORDS = 60
MAX_CLASS_DISTANCE = 0.25
MAX_WORD_DISTANCE = 0.55

SYMBOLS = texts.byte_table("#*$%&|<>")
NOT_NEWLINE = ~texts.byte_table("\n")
CLASSES = 9


def _classes() -> np.ndarray:
    """Class of a character by its first byte; later bytes of a character have none (CLASSES)."""
    table = np.full(256, 5)  # other ASCII
    table[list(b"abcdefghijklmnopqrstuvwxyz")] = 0
    table[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 1
    table[list(b"0123456789")] = 2
    table[list(b" \t\n\x0b\x0c\r")] = 3
    table[list(b".,;:!?'\"-()")] = 4
    table[list(b"#*$%&|<>@^_~=+/\\{}[]`")] = 6
    table[0x80:0xC0] = CLASSES
    table[0xC0:0xE0] = 7
    table[0xE0:] = 8
    return table


CLASS_OF = _classes()
# Kinds of rows in the reference counts.
CLASS, WORD, TOTAL = 0, 1, 2


def _groups(hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that brings equal hashes of a text together, group starts in it, group sizes."""
    key = texts.mix(hashes ^ texts.mix(text.astype(U64) + U64(1)))
    order = np.argsort(key)
    ordered = key[order]
    new = np.ones(len(key), np.bool_)
    new[1:] = ordered[1:] != ordered[:-1]
    starts = np.flatnonzero(new)
    return order, starts, np.diff(np.append(starts, len(key)))


class Words(NamedTuple):
    runs: texts.Runs
    hashes: np.ndarray


def words_of(block: Block) -> Words:
    found = texts.runs(block, texts.SPACED)
    return Words(found, texts.slice_hash(texts.prefix_hash(block.data), found.start, found.end))


def repeated_words(words: Words, n_texts: int, width: int = 5) -> np.ndarray:
    """Per text, words inside a window of ``width`` words that the text has more than once."""
    grams, first = texts.ngrams(words.hashes, words.runs.text, width)
    order, starts, sizes = _groups(grams, words.runs.text[first])
    again = order[np.repeat(sizes > 1, sizes)]
    edge = np.zeros(len(words.hashes) + 1, np.int64)
    np.add.at(edge, first[again], 1)
    np.add.at(edge, first[again] + width, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return np.bincount(words.runs.text[covered], minlength=n_texts)


def repeated_lines(block: Block, words: Words, sums: np.ndarray) -> np.ndarray:
    """Per text, lines that hold a word and equal an earlier line of the text."""
    lines = texts.runs(block, NOT_NEWLINE)
    filled = np.searchsorted(words.runs.start, lines.end) > np.searchsorted(words.runs.start, lines.start)
    text = lines.text[filled]
    order, starts, sizes = _groups(texts.slice_hash(sums, lines.start[filled], lines.end[filled]), text)
    return np.bincount(text[order[starts]], weights=sizes - 1, minlength=len(block.starts)).astype(np.int64)


def class_counts(block: Block) -> np.ndarray:
    cells = texts.text_numbers(block).astype(np.int64) * (CLASSES + 1) + CLASS_OF[block.data]
    return np.bincount(cells, minlength=len(block.starts) * (CLASSES + 1)).reshape(-1, CLASSES + 1)[:, :CLASSES]


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Square root of the Jensen-Shannon divergence in bits, row by row, of counts or shares."""
    p = p / np.maximum(p.sum(axis=1, keepdims=True), 1e-300)
    q = q / np.maximum(q.sum(axis=1, keepdims=True), 1e-300)
    middle = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / middle), 0).sum(axis=1)
        right = np.where(q > 0, q * np.log2(q / middle), 0).sum(axis=1)
    return np.sqrt(np.clip((left + right) / 2, 0, 1))


# -- references -------------------------------------------------------------------------------


class References(NamedTuple):
    """Row r of ``classes`` and ``words`` is the reference of the language with code r; code 0
    stands for all languages without one. ``keys`` (ascending) hold a common word mixed with its code,
    ``bins`` its bin; the last bin is for all other words."""

    codes: dict[str | None, int]
    classes: np.ndarray
    words: np.ndarray
    keys: np.ndarray
    bins: np.ndarray


def _word_key(hashes: np.ndarray, code: np.ndarray) -> np.ndarray:
    return texts.mix(hashes ^ texts.mix(code.astype(U64) + U64(77)))


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["lang", "kind", "item", "n"]
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        codes = np.asarray(langs.indices.fill_null(len(langs.dictionary)))
        labels = langs.dictionary.to_pylist() + [None]
        classes = np.zeros((len(labels), CLASSES), np.int64)
        # distinct words are counted block by block, then over the batch
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for block in texts.blocks(batch.column(1)):
            own = codes[block.first : block.first + len(block.starts)]
            np.add.at(classes, own, class_counts(block))
            words = words_of(block)
            by = own[words.runs.text]
            for code in np.unique(by):
                kinds, n = np.unique(words.hashes[by == code], return_counts=True)
                parts.append((np.full(len(kinds), code), kinds, n))
        if parts:
            code, kinds, n = map(np.concatenate, zip(*parts))
            order = np.lexsort((kinds, code))
            code, kinds, n = code[order], kinds[order], n[order]
            new = np.ones(len(code), np.bool_)
            new[1:] = (code[1:] != code[:-1]) | (kinds[1:] != kinds[:-1])
            starts = np.flatnonzero(new)
            code, kinds, n = code[starts], kinds[starts], np.add.reduceat(n, starts)
        else:
            code, kinds, n = np.empty(0, int), np.empty(0, U64), np.empty(0, int)
        total = np.bincount(code, n, len(labels)).astype(np.int64)
        c, k = np.nonzero(classes)
        t = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(labels, pa.string()).take(pa.array(np.concatenate([c, code, t]))),
                pa.array(np.repeat([CLASS, WORD, TOTAL], [len(c), len(code), len(t)]).astype(np.int32)),
                pa.array(np.concatenate([k, kinds.view(np.int64), np.zeros(len(t), np.int64)]).astype(np.int64)),
                pa.array(np.concatenate([classes[c, k], n, total[t]]).astype(np.int64)),
            ],
            names=names,
        )


def reference_table(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, total (words), classes (item, n) and words (rank, item, n) of every language that has
    MIN_REFERENCE_WORDS words, counted over all rows; written."""
    rows = df.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text"))
    counted = rows.filter(F.col("lang").isNotNull()).mapInArrow(_count_batches, "lang string, kind int, item long, n long")
    counts = materialize(counted.groupBy("lang", "kind", "item").agg(F.sum("n").alias("n")), "reference-counts")
    # a language has few classes and one total, and of its words the commonest stay
    rank = F.row_number().over(Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "item"))
    ranked = counts.withColumn("rank", rank).filter(F.col("rank") <= COMMON_WORDS)
    of = lambda kind, *columns: F.collect_list(F.when(F.col("kind") == kind, F.struct(*columns)))
    made = ranked.groupBy("lang").agg(
        F.sum(F.when(F.col("kind") == TOTAL, F.col("n"))).alias("total"),
        of(CLASS, "item", "n").alias("classes"),
        F.sort_array(of(WORD, "rank", "item", "n")).alias("words"),
    )
    return materialize(made.filter(F.col("total") >= MIN_REFERENCE_WORDS), "references")


def references(rows: list[dict]) -> References:
    """The arrays that texts are held against, from rows of a reference table."""
    size = len(rows) + 1
    classes, words = np.zeros((size, CLASSES)), np.zeros((size, COMMON_WORDS + 1))
    own, hashes, bins = [], [], []
    for code, row in enumerate(rows, 1):
        for c in row["classes"]:
            classes[code, c["item"]] = c["n"]
        for w in row["words"]:
            words[code, w["rank"] - 1] = w["n"]
            own.append(code), hashes.append(w["item"]), bins.append(w["rank"] - 1)
        words[code, COMMON_WORDS] = row["total"] - words[code, :COMMON_WORDS].sum()
    keys = _word_key(np.array(hashes, np.int64).view(U64), np.array(own, np.int64))
    order = np.argsort(keys)
    codes = {row["lang"]: code for code, row in enumerate(rows, 1)}
    return References(codes, classes, words, keys[order], np.array(bins, np.int64)[order])


# -- verdicts ---------------------------------------------------------------------------------

FIELDS = [
    ("n_words", T.LongType()),
    ("word_chars", T.LongType()),
    ("n_symbols", T.LongType()),
    ("n_dup_lines", T.LongType()),
    ("n_repeat_words", T.LongType()),
    ("base_failed", T.BooleanType()),
    ("kept", T.BooleanType()),
    ("class_distance", T.DoubleType()),
    ("word_distance", T.DoubleType()),
]


def judge(block: Block, code: np.ndarray, known: References) -> dict[str, np.ndarray]:
    n = len(block.starts)
    words, chars = words_of(block), texts.characters(block)
    text = words.runs.text
    n_words = np.bincount(text, minlength=n)
    repeats = repeated_words(words, n)
    failed = (n_words < 10) | (100 * repeats > 20 * n_words)

    classes = class_counts(block)
    key = _word_key(words.hashes, code[text])
    at = np.minimum(np.searchsorted(known.keys, key), max(len(known.keys) - 1, 0))
    bins = np.full(len(key), COMMON_WORDS)
    if len(known.keys):
        hit = known.keys[at] == key
        bins[hit] = known.bins[at[hit]]
    width = COMMON_WORDS + 1
    histogram = np.bincount(text * width + bins, minlength=n * width).reshape(n, width)
    class_distance = js_distance(classes, known.classes[code])
    word_distance = js_distance(histogram, known.words[code])
    n_chars = classes.sum(axis=1)
    class_distance[code == 0] = np.nan
    word_distance[code == 0] = np.nan
    # nothing is greater than what is not known
    odd = ((n_chars >= MIN_CHARACTERS) & (class_distance > MAX_CLASS_DISTANCE)) | (
        (n_words >= MIN_WORDS) & (word_distance > MAX_WORD_DISTANCE)
    )
    return {
        "n_words": n_words,
        "word_chars": np.bincount(text, chars[words.runs.end] - chars[words.runs.start], n).astype(np.int64),
        "n_symbols": np.bincount(texts.text_numbers(block)[SYMBOLS[block.data]], minlength=n),
        "n_dup_lines": repeated_lines(block, words, texts.prefix_hash(block.data)),
        "n_repeat_words": repeats,
        "base_failed": failed,
        "kept": ~failed & ~odd,
        "class_distance": class_distance,
        "word_distance": word_distance,
    }


def quality_rules(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row for each row: key, the counts, both distances and the verdict.

    A null text is empty; it has no words, so it fails. A row whose language is null, or has too
    little text in the table for a reference, has null distances and passes these tests. Repeated
    rows are judged alike. Other columns are ignored. Texts are judged whole, however long.
    """
    made = reference_table(df, text, lang)
    near = made.orderBy(F.desc("total"), "lang").limit(NEAR_LANGUAGES).collect()
    known = references([r.asDict(recursive=True) for r in near])
    narrow = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text"))
    if len(near) < NEAR_LANGUAGES:
        judged = _judged(narrow, ["key", "lang"], known)
    else:
        taken = F.array(*[F.lit(r.lang) for r in near])
        of_near = F.coalesce(F.array_contains(taken, F.col("lang")), F.lit(False))
        far = made.filter(~F.array_contains(taken, F.col("lang")))
        told = far.select("lang", "total", F.struct("lang", "total", "classes", "words").alias("reference"))
        rest = lookup_skewed(narrow.filter(~of_near), told, "lang", "total", F.concat(F.lit("\0"), F.xxhash64("key").cast("string")))
        judged = _judged(narrow.filter(of_near), ["key", "lang"], known).union(
            _judged(rest, ["key", "lang", "reference"], None).drop("reference")
        )
    return judged.drop("lang").withColumnRenamed("key", key)


def _judged(rows: DataFrame, keep: list[str], known: References | None) -> DataFrame:
    """Verdicts on rows of key, lang and text; without ``known`` the rows bring their references."""

    def work(batch: pa.RecordBatch) -> dict[str, np.ndarray | pa.Array]:
        labels = batch.column(1).dictionary_encode()
        own = known or references(list({r["lang"]: r for r in batch.column(2).to_pylist() if r is not None}.values()))
        of = np.array([own.codes.get(x, 0) for x in labels.dictionary.to_pylist()] + [0])
        code = of[np.asarray(labels.indices.fill_null(len(labels.dictionary)))]
        column = batch.column(batch.schema.get_field_index("_text"))
        parts = [judge(b, code[b.first : b.first + len(b.starts)], own) for b in texts.blocks(column)]
        made = texts.gather(parts, [name for name, _ in FIELDS])
        for name in ("class_distance", "word_distance"):
            made[name] = pa.array(made[name], pa.float64(), mask=np.isnan(made[name].astype(float)))
        return made

    return texts.map_texts(rows, keep, "text", FIELDS, work)
