"""Concatenating, interleaving, repeating; removal of seen text."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import WORD, draw, query, split_of
from checks.scans import docs, with_split
from packfold.operators import dedup, mixing
from packfold.sources.readers import spread


def by_language(spark, sf):
    """English and all other documents as two tables."""
    rows = docs(spark, sf).select("doc_id", "lang", "text")
    return [rows.filter(F.col("lang") == "en"), rows.filter(F.col("lang") != "en")]


@query("concat_sources", "SELECT (lang <> 'en')::INTEGER AS src_ord, doc_id, lang, text FROM documents")
def concat_sources(spark, sf):
    return mixing.concatenate(by_language(spark, sf))


def interleave_sql(rows: str) -> str:
    return f"""WITH src AS ({rows}),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id) - 1 AS ord FROM src),
    sizes AS (SELECT s, count(*) AS n FROM src GROUP BY 1),
    draws AS (SELECT k, CASE WHEN {draw('k')} < 0.8 THEN 0 ELSE 1 END AS s FROM range((SELECT count(*) FROM src)) t(k)),
    picks AS (SELECT k, s, row_number() OVER (PARTITION BY s ORDER BY k) - 1 AS ord FROM draws),
    stop AS (SELECT min(k) AS k FROM picks JOIN sizes USING (s) WHERE ord >= n)
    SELECT k AS draw, doc_id, text FROM picks JOIN numbered USING (s, ord) WHERE k < coalesce((SELECT k FROM stop), 9e18)"""


@query("interleave_80_20", interleave_sql("SELECT doc_id, text, CASE lang WHEN 'en' THEN 0 ELSE 1 END AS s FROM documents"))
def interleave_80_20(spark, sf):
    return mixing.interleave(by_language(spark, sf), [0.8, 0.2], "doc_id", seed=42).select("draw", "doc_id", "text")


@query(
    "training_mix",
    f"""SELECT 'train' AS split, draw, doc_id, text FROM ({interleave_sql(f"SELECT doc_id, text, CASE lang WHEN 'en' THEN 0 ELSE 1 END AS s FROM documents WHERE ({split_of('doc_id')}) = 'train'")})
    UNION ALL SELECT split, NULL, doc_id, text FROM (SELECT doc_id, lang, text, {split_of('doc_id')} AS split FROM documents)
    WHERE split <> 'train' AND lang = 'en'""",
)
def training_mix(spark, sf):
    first, second = [with_split(t) for t in by_language(spark, sf)]
    return mixing.training_mix(first, second, "doc_id").select("split", "draw", "doc_id", "text")


@query("epoch_repeat", "SELECT epoch::INTEGER AS epoch, doc_id, text FROM documents, range(3) t(epoch)")
def epoch_repeat(spark, sf):
    return mixing.repeat_epochs(docs(spark, sf).select("doc_id", "text"), 3)


def seen_sql(shard: str = "0") -> str:
    """Every paragraph with the n-grams it has and how many of them were seen at an earlier one."""
    words = f"regexp_extract_all(lower(paragraph), '{WORD}')"
    return f"""WITH paras AS (SELECT doc_id, {shard} AS shard, unnest(string_split(text, chr(10))) AS paragraph,
            unnest(range(len(string_split(text, chr(10))))) AS para FROM documents),
    worded AS (SELECT doc_id, shard, para, paragraph, {words} AS words FROM paras),
    grams AS (SELECT doc_id, shard, para, array_to_string(words[i + 1:i + 13], ' ') AS gram
        FROM (SELECT doc_id, shard, para, words, unnest(range(len(words) - 12)) AS i FROM worded WHERE len(words) >= 13)),
    firsts AS (SELECT shard, gram, min((doc_id, para)) AS first FROM grams GROUP BY 1, 2),
    hits AS (SELECT doc_id, para, count(*) AS seen FROM grams JOIN firsts USING (shard, gram)
        WHERE (doc_id, para) > first GROUP BY 1, 2),
    rated AS (SELECT doc_id, para, paragraph, greatest(len(words) - 12, 0) AS ngrams, coalesce(seen, 0) AS seen
        FROM worded LEFT JOIN hits USING (doc_id, para)),
    marked AS (SELECT *, CASE WHEN ngrams > 0 THEN seen / ngrams ELSE 0.0 END AS ratio,
        CASE WHEN sum(ngrams) OVER d > 0 THEN sum(seen) OVER d / sum(ngrams) OVER d ELSE 0.0 END AS doc_ratio
        FROM rated WINDOW d AS (PARTITION BY doc_id))"""


LINES_LEFT = "coalesce(string_agg(paragraph, chr(10) ORDER BY para) FILTER (WHERE ratio < 0.8), '')"


@query("dedup_paragraph", f"{seen_sql()} SELECT doc_id, {LINES_LEFT} AS text FROM marked GROUP BY doc_id")
def dedup_paragraph(spark, sf):
    return dedup.remove_seen(spread(docs(spark, sf)), mode="paragraph").select("doc_id", "text")


@query("dedup_document", f"{seen_sql()} SELECT DISTINCT doc_id FROM marked WHERE doc_ratio < 0.8")
def dedup_document(spark, sf):
    return dedup.remove_seen(spread(docs(spark, sf)), mode="document").select("doc_id")


@query("dedup_both", f"{seen_sql()} SELECT doc_id, {LINES_LEFT} AS text FROM marked WHERE doc_ratio < 0.8 GROUP BY doc_id")
def dedup_both(spark, sf):
    return dedup.remove_seen(spread(docs(spark, sf)), mode="both").select("doc_id", "text")


@query(
    "dedup_annotate",
    f"""{seen_sql()} SELECT doc_id, para::INTEGER AS para, ngrams::BIGINT AS ngrams, seen::BIGINT AS seen,
    round(ratio, 6) AS dup_ratio, ratio >= 0.8 AS is_dup, round(doc_ratio, 6) AS doc_ratio, doc_ratio >= 0.8 AS doc_dup FROM marked""",
)
def dedup_annotate(spark, sf):
    marked = dedup.annotate(spread(docs(spark, sf)))
    lines = marked.select("doc_id", "doc_ratio", "doc_dup", F.posexplode("paragraphs").alias("para", "p"))
    return lines.select(
        "doc_id", "para", "p.ngrams", "p.seen", F.round("p.dup_ratio", 6).alias("dup_ratio"), "p.is_dup",
        F.round("doc_ratio", 6).alias("doc_ratio"), "doc_dup",
    )


@query(
    "dedup_sharded",
    f"{seen_sql('doc_id % 4')} SELECT doc_id, {LINES_LEFT} AS text FROM marked WHERE doc_ratio < 0.8 GROUP BY doc_id",
)
def dedup_sharded(spark, sf):
    shard = dedup.shard_of("doc_id", 4)
    return dedup.remove_seen(spread(docs(spark, sf)), mode="both", shard=shard).select("doc_id", "text")


@query(
    "ngram_stats",
    f"""{seen_sql()} SELECT count(*) AS ngrams, count(DISTINCT gram) AS distinct_ngrams,
    ceil(-count(DISTINCT gram) * ln(0.01) / ln(2.0) ^ 2)::BIGINT AS filter_bits FROM grams""",
)
def ngram_stats(spark, sf):
    return dedup.ngram_stats(spread(docs(spark, sf)), exact=True)


@query(
    "word_segments",
    f"SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '{WORD}'), ' ') AS words FROM documents",
)
def word_segments(spark, sf):
    return docs(spark, sf).select("doc_id", F.array_join(dedup.words_of(F.col("text")), " ").alias("words"))
