"""Removing paragraphs and documents whose word n-grams were seen earlier.

An n-gram is *seen* where some occurrence has a smaller position. Positions are single
integers and n-grams 64-bit hashes, so the big shuffle moves two numbers an n-gram, once;
what comes back from it is counts by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packfold.functions.tokenizers import WORD_PATTERN
from packfold.plans.barrier import computed_once
from packfold.plans.ordinals import join_back, join_keyed, ordinals, piece_count
from packfold.session import materialize

# Defaults of the filter.
NGRAM_SIZE = 13
THRESHOLD = 0.8
FALSE_POSITIVES = 0.01

# Paragraph numbers need this many bits next to the document number.
PARAGRAPH_BITS = 24
MODES = ("paragraph", "document", "both")


def words_of(paragraph: Column) -> Column:
    return F.regexp_extract_all(F.lower(paragraph), F.lit(WORD_PATTERN), F.lit(0))


def ngram_count(words: Column, min_size: int = NGRAM_SIZE, max_size: int = NGRAM_SIZE) -> Column:
    """Number of n-grams among ``words`` words: none below ``min_size``, one up to ``max_size``."""
    return F.when(words < min_size, F.lit(0)).otherwise(F.greatest(words - (max_size - 1), F.lit(1)))


def paragraph_table(df: DataFrame, *columns: str, text: str = "text") -> DataFrame:
    """One row per line of text: ``columns``, ``para`` and ``paragraph``."""
    return df.select(*columns, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("para", "paragraph"))


def ngram_arrays(
    paragraphs: DataFrame,
    *columns: str,
    min_size: int = NGRAM_SIZE,
    max_size: int = NGRAM_SIZE,
    within: str | None = None,
) -> DataFrame:
    """``columns`` and ``grams``, the hashes of the n-grams of each paragraph in order.

    With ``within``, equal n-grams under different values of that column get different hashes.
    """
    scope = [within] if within else []
    # words become numbers first: an n-gram then hashes a few longs instead of strings
    numbers = F.transform(words_of(F.col("paragraph")), lambda w: F.xxhash64(w))
    # words are matched once, whatever is filtered by or taken from the n-grams later
    words = computed_once(paragraphs.select(*dict.fromkeys([*columns, *scope, "paragraph"])), _words=numbers)
    count = ngram_count(F.size("_words"), min_size, max_size)
    none = F.array().cast("array<int>")
    starts = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(none)
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice("_words", i, max_size), *scope))
    return words.select(*columns, hashes.alias("grams"))


def ngram_table(paragraphs: DataFrame, *columns: str, **options) -> DataFrame:
    """One row per n-gram occurrence: ``columns`` and the hash ``h``."""
    arrays = computed_once(ngram_arrays(paragraphs, *columns, **options), _grams=F.col("grams"))
    return arrays.select(*columns, F.explode("_grams").alias("h"))


def _document_positions(df: DataFrame, doc: str) -> DataFrame:
    """Add ``_base``, the position of a document's first paragraph: positions of all its
    paragraphs stay below the next document's.

    Integer ids in a limited range are shifted in place. Other ids are numbered first. Ids must
    be unique; an id met twice stops the job either way.
    """
    if df.schema[doc].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        low, high, rows, ids = df.agg(F.min(doc), F.max(doc), F.count(doc), F.count_distinct(doc)).first()
        if rows != ids:
            raise ValueError(f"values of {doc} are not unique")
        if low is None or (high - low).bit_length() + PARAGRAPH_BITS <= 62:
            return df.withColumn("_base", F.shiftleft(F.col(doc).cast("long") - F.lit(low or 0), PARAGRAPH_BITS))
    numbered, rows, _ = ordinals(df, doc)
    base = F.shiftleft("ordinal", PARAGRAPH_BITS).alias("_base")
    return join_back(df, numbered.select(doc, base), [doc], rows)


def _position() -> Column:
    too_long = F.raise_error(f"a document has more than 2^{PARAGRAPH_BITS} lines").cast("long")
    return F.when(F.col("para") < (1 << PARAGRAPH_BITS), F.col("_base") + F.col("para")).otherwise(too_long)


def paragraph_verdicts(
    df: DataFrame,
    doc: str = "doc_id",
    *,
    text: str = "text",
    shard: Column | None = None,
    min_size: int = NGRAM_SIZE,
    max_size: int = NGRAM_SIZE,
) -> DataFrame:
    """``doc`` and ``_counted``, (para, ngrams, seen) of its paragraphs that have n-grams, in order.

    Texts are matched once, into a written table of hashes that holds no text. The n-grams of a
    paragraph and which of them were seen both come from that.
    """
    shard = F.lit(0) if shard is None else shard
    placed = _document_positions(df.select(doc, text, shard.cast("long").alias("_shard")), doc)
    paragraphs = paragraph_table(placed, doc, "_base", "_shard", text=text).select(
        doc, "para", "_shard", "paragraph", _position().alias("pos")
    )
    arrays = ngram_arrays(paragraphs, doc, "para", "pos", min_size=min_size, max_size=max_size, within="_shard")
    arrays = materialize(arrays, "grams")
    seen = _seen_places(arrays.filter(F.col("pos").isNotNull()).select("pos", "grams"))
    own = arrays.select(doc, "para", "pos", F.size("grams").alias("_own")).filter(F.col("_own") > 0)
    counted = (
        own.join(seen, "pos", "left")
        .groupBy(doc, "para")
        .agg(F.sum("_own").alias("ngrams"), F.coalesce(F.sum("_seen"), F.lit(0)).cast("long").alias("seen"))
    )
    listed = F.sort_array(F.collect_list(F.struct("para", "ngrams", "seen")))
    return counted.groupBy(doc).agg(listed.alias("_counted"))


def _seen_places(arrays: DataFrame) -> DataFrame:
    """``pos`` and ``_seen``, how many n-grams there occur at a smaller position too.

    One range shuffle brings equal n-grams together in order of position, and one walk along each
    sorted piece finds those that are not first. A frequent n-gram is cut into many pieces: what a
    piece begins with may go on from the piece before, so its occurrences are kept apart with their
    hash until the first of them is known, which needs no more than a row or two a piece.
    """
    total = arrays.agg(F.sum(F.size("grams"))).first()[0] or 0
    grams = arrays.select(F.explode("grams").alias("h"), "pos")
    order = ["h", "pos"]
    ordered = grams.repartitionByRange(piece_count(arrays.sparkSession, total), *order).sortWithinPartitions(*order)
    # bounds of pieces are sampled, so what was found in them is written
    found = materialize(ordered.mapInArrow(_later_places, "h long, pos long, n long"), "seen")
    parted = found.filter(F.col("h").isNotNull())
    first = parted.groupBy("h").agg(F.min("pos").alias("_first"))
    later = parted.join(F.broadcast(first), "h").filter(F.col("pos") > F.col("_first"))
    whole = found.filter(F.col("h").isNull()).select("pos", "n").union(later.select("pos", "n"))
    return whole.groupBy("pos").agg(F.sum("n").alias("_seen"))


def _later_places(batches):
    """Positions of sorted (h, pos) rows beyond the first of their h, with counts. Rows of the h that
    a piece begins with come with it, and so does, with no count, the first of the one it ends with."""
    import numpy as np
    import pyarrow as pa

    def counted(places, h=None):
        places, counts = np.unique(places, return_counts=True)
        hashes = pa.nulls(len(places), pa.int64()) if h is None else pa.array(np.full(len(places), h, np.int64))
        return pa.RecordBatch.from_arrays([hashes, pa.array(places), pa.array(counts.astype(np.int64))], names=["h", "pos", "n"])

    begun = last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        h, pos = batch.column("h").to_numpy(), batch.column("pos").to_numpy()
        begun = h[0] if last is None else begun
        last = last or (h[0], pos[0])
        new = np.concatenate([[h[0] != last[0]], h[1:] != h[:-1]])
        first = np.concatenate([[last[1]], pos[new]])[np.cumsum(new)]
        last = h[-1], first[-1]
        unknown = h == begun
        if unknown.any():
            yield counted(pos[unknown], begun)
        yield counted(pos[~unknown & (pos > first)])
    if last is not None:
        yield pa.RecordBatch.from_pydict({"h": pa.array([last[0]]), "pos": pa.array([last[1]]), "n": pa.array([0], pa.int64())})


def annotate(
    df: DataFrame,
    doc: str = "doc_id",
    *,
    text: str = "text",
    threshold: float = THRESHOLD,
    shard: Column | None = None,
    min_size: int = NGRAM_SIZE,
    max_size: int = NGRAM_SIZE,
) -> DataFrame:
    """All rows, plus ``paragraphs`` (text, ngrams, seen, dup_ratio, is_dup per line),
    ``doc_ngrams``, ``doc_seen``, ``doc_ratio`` and ``doc_dup``. ``doc`` must be unique."""
    per_doc = paragraph_verdicts(df, doc, text=text, shard=shard, min_size=min_size, max_size=max_size)
    # one row of counts a document meets the texts, which are cut at line ends and not matched
    # again; whether the counts are small enough to broadcast is for Spark to see when they are there
    joined = join_keyed(df, per_doc, [doc], "left")
    joined = computed_once(joined, _lines=F.split(F.coalesce(text, F.lit("")), "\n"))
    ratio = lambda hit, all_: F.when(all_ > 0, hit / all_).otherwise(F.lit(0.0))
    rated = F.zip_with(
        "_lines",
        _dense(F.col("_counted"), F.size("_lines")),
        lambda line, n: F.struct(
            line.alias("text"),
            n["ngrams"].alias("ngrams"),
            n["seen"].alias("seen"),
            ratio(n["seen"], n["ngrams"]).alias("dup_ratio"),
            (ratio(n["seen"], n["ngrams"]) >= threshold).alias("is_dup"),
        ),
    )
    known = F.coalesce("_counted", F.array().cast(per_doc.schema["_counted"].dataType))
    total = lambda field: F.aggregate(known, F.lit(0).cast("long"), lambda t, x: t + x[field])
    joined = computed_once(joined, paragraphs=rated, doc_ngrams=total("ngrams"), doc_seen=total("seen"))
    return joined.withColumns(
        {"doc_ratio": ratio(F.col("doc_seen"), F.col("doc_ngrams"))}
    ).withColumn("doc_dup", F.col("doc_ratio") >= threshold).drop("_lines", "_counted")


def _dense(sparse: Column, size: Column) -> Column:
    """Counts for lines 0..size-1 from sorted (para, ngrams, seen): zeros fill the gaps, so the
    work is linear in the number of lines."""
    zero = F.lit(0).cast("long")
    nothing = F.struct(zero.alias("ngrams"), zero.alias("seen"))
    zeros = lambda n: F.array_repeat(nothing, n.cast("int"))
    before = lambda i: F.coalesce(F.get(sparse, i - 1)["para"], F.lit(-1))
    own = lambda s: F.array(F.struct(s["ngrams"].alias("ngrams"), s["seen"].alias("seen")))
    filled = F.flatten(F.transform(sparse, lambda s, i: F.concat(zeros(s["para"] - before(i) - 1), own(s))))
    tail = zeros(size - F.element_at(sparse, -1)["para"] - 1)
    return F.when(sparse.isNull(), zeros(size)).otherwise(F.concat(filled, tail))


def remove_seen(df: DataFrame, doc: str = "doc_id", *, mode: str = "both", text: str = "text", **options) -> DataFrame:
    """``df`` without seen paragraphs (``paragraph``), seen documents (``document``) or ``both``.

    A document that loses all its paragraphs stays, with empty text.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}; one of {', '.join(MODES)}")
    marked = annotate(df, doc, text=text, **options)
    if mode in ("document", "both"):
        marked = marked.filter(~F.col("doc_dup"))
    if mode in ("paragraph", "both"):
        kept = F.filter("paragraphs", lambda p: ~p["is_dup"])
        left = F.array_join(kept["text"], "\n")
        marked = marked.withColumn(text, F.when(F.col(text).isNotNull(), left))
    return marked.select(*df.columns)


def shard_of(doc: str, total_shards: int) -> Column:
    return F.pmod(F.col(doc), F.lit(total_shards))


def ngram_stats(
    df: DataFrame,
    *,
    text: str = "text",
    fp_rate: float = FALSE_POSITIVES,
    exact: bool = True,
    min_size: int = NGRAM_SIZE,
    max_size: int = NGRAM_SIZE,
) -> DataFrame:
    """One row: n-gram total, distinct n-grams and the bits a Bloom filter needs for them.

    Counting exactly shuffles every distinct n-gram; without ``exact`` the count is a sketch.
    """
    grams = ngram_table(paragraph_table(df, text=text), min_size=min_size, max_size=max_size)
    distinct = F.count_distinct("h") if exact else F.approx_count_distinct("h", 0.01)
    counted = grams.agg(F.count(F.lit(1)).alias("ngrams"), distinct.alias("distinct_ngrams"))
    bits = F.ceil(-F.col("distinct_ngrams") * F.log(F.lit(fp_rate)) / F.pow(F.log(F.lit(2.0)), F.lit(2.0)))
    return counted.withColumn("filter_bits", bits.cast("long"))
