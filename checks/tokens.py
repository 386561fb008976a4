"""Tokenizing, embedding, packing, padding, perplexity."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import SQL, WORD, byte_count, byte_ids, query, split_of, table
from checks.scans import docs, with_split
from packfold.functions import arrays
from packfold.functions.encoders import HashEncoder, ModelEncoder
from packfold.functions.text import stripped
from packfold.functions.tokenizers import ByteTokenizer, WordTokenizer
from packfold.operators import embedding, grouping, mapping, mixing, packing, padding, tokenizing, vocabulary
from packfold.operators.perplexity import perplexity_series as series
from packfold.plans import jobs
from packfold.plans.ordinals import with_ordinal
from packfold.session import fresh_path
from packfold.sources import readers
from packfold.sources.readers import spread

TOKENIZER = ByteTokenizer()


def byte_tokens(spark, sf, *columns, **options):
    tokens = tokenizing.tokenize(spread(docs(spark, sf)), TOKENIZER, **options)
    return tokens.select("doc_id", *columns, "input_ids", "token_count")


@query("token_counts", f"SELECT doc_id, {byte_count('text')}::INTEGER AS token_count, list_sum({byte_ids('text')})::BIGINT AS id_sum FROM documents")
def token_counts(spark, sf):
    total = F.aggregate("input_ids", F.lit(0).cast("long"), lambda t, x: t + x)
    return byte_tokens(spark, sf).select("doc_id", "token_count", total.alias("id_sum"))


@query("token_ids", f"SELECT doc_id, array_to_string({byte_ids('text')}, ',') AS input_ids FROM documents")
def token_ids(spark, sf):
    return byte_tokens(spark, sf).select("doc_id", arrays.as_text("input_ids").alias("input_ids"))


@query("token_totals_by_lang", f"SELECT lang, sum({byte_count('text')})::BIGINT AS tokens FROM documents GROUP BY 1")
def token_totals_by_lang(spark, sf):
    return byte_tokens(spark, sf, "lang").groupBy("lang").agg(F.sum("token_count").alias("tokens"))


@query("token_total", f"SELECT sum({byte_count('text')})::BIGINT AS tokens FROM documents")
def token_total(spark, sf):
    return tokenizing.total_tokens(byte_tokens(spark, sf))


@query(
    "token_counts_capped",
    f"SELECT doc_id, {byte_count('text')}::INTEGER AS token_count FROM documents ORDER BY doc_id LIMIT 100",
)
def token_counts_capped(spark, sf):
    """The row cap of the tokenizer, applied before any text is tokenized."""
    return byte_tokens(spark, sf, max_records=100, order_by="doc_id").select("doc_id", "token_count")


@query("tokens_named_by_column", f"SELECT doc_id, array_to_string({byte_ids('text')}, ',') AS text_input_ids FROM documents")
def tokens_named_by_column(spark, sf):
    tokens = tokenizing.tokenize(docs(spark, sf), TOKENIZER, column="text", output_column=None)
    return tokens.select("doc_id", arrays.as_text("text_input_ids").alias("text_input_ids"))


@query("tokens_with_bos", f"SELECT doc_id, {byte_count('text')}::INTEGER + 1 AS token_count, '1,' || array_to_string({byte_ids('text')}, ',') AS input_ids FROM documents")
def tokens_with_bos(spark, sf):
    tokens = byte_tokens(spark, sf, add_special_tokens=True)
    return tokens.select("doc_id", "token_count", arrays.as_text("input_ids").alias("input_ids"))


@query("prefix_bos", f"SELECT doc_id, '9,' || array_to_string({byte_ids('text')}, ',') AS input_ids FROM documents")
def prefix_bos(spark, sf):
    ids = docs(spark, sf).select("doc_id", TOKENIZER.encode("text").alias("ids"))
    return ids.select("doc_id", arrays.as_text(arrays.with_prefix("ids", 9)).alias("input_ids"))


@query("decode_round_trip", r"SELECT doc_id, trim(text, E' \t\n\r\x0b\x0c') AS text, TRUE AS same FROM documents")
def decode_round_trip(spark, sf):
    decoded = tokenizing.decode(byte_tokens(spark, sf, "text"), TOKENIZER, output_column="decoded")
    same = stripped("decoded") == stripped("text")
    return decoded.select("doc_id", stripped("decoded").alias("text"), same.alias("same"))


@query(
    "tokenize_truncated",
    f"""SELECT array_to_string(ids[1:256], ',') AS input_ids, rtrim(repeat('1,', len(ids[1:256])), ',') AS attention_mask
    FROM (SELECT list_concat([1], {byte_ids('text')}) AS ids FROM documents)""",
)
def tokenize_truncated(spark, sf):
    cut = tokenizing.tokenize_truncated(docs(spark, sf), TOKENIZER, max_length=256)
    return cut.select(*[arrays.as_text(c).alias(c) for c in cut.columns])


@query(
    "mapped_batches",
    "SELECT doc_id, length(text)::BIGINT AS letters, upper(lang) AS tag, n_chars - length(text) AS gap FROM documents",
)
def mapped_batches(spark, sf):
    """A user function over Arrow batches, then record-wise expressions on its output."""

    def measure(text, lang):
        import pyarrow.compute as pc

        return {"letters": pc.cast(pc.utf8_length(text), "int64"), "tag": pc.utf8_upper(lang)}

    mapped = mapping.map_batches(docs(spark, sf), measure, "letters bigint, tag string", columns=["text", "lang"])
    gap = F.col("n_chars") - F.col("letters")
    return mapping.map_records(mapped, gap=gap).select("doc_id", "letters", "tag", "gap")


VOCABULARY_SQL = f"""words AS (SELECT doc_id, unnest(regexp_extract_all(text, '{WORD}')) AS word,
        unnest(range(len(regexp_extract_all(text, '{WORD}')))) AS place FROM documents),
    vocabulary AS (SELECT word, row_number() OVER (ORDER BY n DESC, word) + 3 AS id, n
        FROM (SELECT word, count(*) AS n FROM words GROUP BY 1))"""


@query("word_vocabulary", f"WITH {VOCABULARY_SQL} SELECT word, id, n FROM vocabulary")
def word_vocabulary(spark, sf):
    """Every word of the texts, as a table."""
    return vocabulary.learn_vocabulary(spread(docs(spark, sf)))


@query(
    "word_tokens",
    f"""WITH {VOCABULARY_SQL}
    SELECT doc_id, count(word) AS token_count, coalesce(string_agg(id::VARCHAR, ',' ORDER BY place), '') AS input_ids
    FROM documents LEFT JOIN words USING (doc_id) LEFT JOIN vocabulary USING (word) GROUP BY doc_id""",
)
def word_tokens(spark, sf):
    """Ids of all words, the rare ones too."""
    rows = spread(docs(spark, sf))
    tokens = vocabulary.encode_words(rows, vocabulary.learn_vocabulary(rows), "doc_id", head_words=200)
    count = arrays.token_count("input_ids").cast("long")
    return tokens.select("doc_id", count.alias("token_count"), arrays.as_text("input_ids").alias("input_ids"))


@query("word_round_trip", f"SELECT doc_id, array_to_string(regexp_extract_all(text, '{WORD}'), ' ') AS text FROM documents")
def word_round_trip(spark, sf):
    """Ids give back every word."""
    rows = spread(docs(spark, sf))
    learned = vocabulary.learn_vocabulary(rows)
    return vocabulary.decode_words(vocabulary.encode_words(rows, learned, "doc_id"), learned, "doc_id")


@query(
    "word_tokens_bounded",
    f"""WITH {VOCABULARY_SQL}
    SELECT doc_id, coalesce(string_agg(CASE WHEN id < 1004 THEN id ELSE 3 END::VARCHAR, ',' ORDER BY place), '') AS input_ids,
        coalesce(string_agg(word, ' ' ORDER BY place) FILTER (id < 1004), '') AS text
    FROM documents LEFT JOIN words USING (doc_id) LEFT JOIN vocabulary USING (word) GROUP BY doc_id""",
)
def word_tokens_bounded(spark, sf):
    """A tokenizer of the most frequent words only, inside expressions."""
    rows = spread(docs(spark, sf))
    tokenizer = WordTokenizer.learn(rows, "text", 1000)
    tokens = tokenizing.tokenize(rows, tokenizer).select("doc_id", "input_ids")
    return tokens.select("doc_id", arrays.as_text("input_ids").alias("input_ids"), tokenizer.decode("input_ids").alias("text"))


@query("row_ordinals", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_tax, l_returnflag, ordinal FROM (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 AS ordinal FROM lineitem)")
def row_ordinals(spark, sf):
    """Numbers from the keys alone, joined to the whole rows."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
    numbered = with_ordinal(table(spark, sf, "lineitem"), keys, partitions=8)
    return numbered.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_tax", "l_returnflag", "ordinal")


@query("shard_assign", "SELECT doc_id, text, ntile(32) OVER (ORDER BY doc_id) - 1 AS shard_id FROM documents")
def shard_assign(spark, sf):
    return mixing.assign_shards(docs(spark, sf).select("doc_id", "text"), "doc_id", 32)


@query("batch_assign", "SELECT doc_id, text, (row_number() OVER (ORDER BY doc_id) - 1) // 8 AS batch_id FROM documents")
def batch_assign(spark, sf):
    return padding.assign_batches(docs(spark, sf).select("doc_id", "text"), "doc_id", 8)


LENGTHS_SQL = f"lens AS (SELECT doc_id, {byte_ids('text')} AS ids FROM documents)"


SHUFFLED = "md5('42:' || doc_id), doc_id"


def fixed_sql(length: int, order: str = "doc_id", group: str = "0") -> str:
    return f"""WITH {LENGTHS_SQL},
    placed AS (SELECT {group} AS grp, ids, sum(len(ids)) OVER (PARTITION BY {group} ORDER BY {order}) - len(ids) AS start FROM lens),
    flat AS (SELECT grp, start, unnest(ids) AS id, unnest(range(len(ids))) AS i FROM placed)
    SELECT grp, ((start + i) // {length})::BIGINT AS chunk, string_agg(id::VARCHAR, ',' ORDER BY start + i) AS input_ids
    FROM flat GROUP BY 1, 2 HAVING count(*) = {length}"""


@query("pack_fixed", f"SELECT chunk, input_ids FROM ({fixed_sql(256)})")
def pack_fixed(spark, sf):
    encode = TOKENIZER.array_encoder()
    packed = packing.pack_fixed(spread(docs(spark, sf)), "doc_id", seq_length=256, ids="text", encode=encode)
    return packed.select("chunk", arrays.as_text("input_ids").alias("input_ids"))


@query("pack_fixed_by_split", f"SELECT grp AS split, chunk, input_ids FROM ({fixed_sql(2048, group=split_of('doc_id'))})")
def pack_fixed_by_split(spark, sf):
    tokens = with_split(byte_tokens(spark, sf))
    packed = packing.pack_fixed(tokens, "doc_id", seq_length=2048, group="split")
    return packed.select("split", "chunk", arrays.as_text("input_ids").alias("input_ids"))


@query("save_packed", f"SELECT grp AS split, chunk, input_ids FROM ({fixed_sql(512, group=split_of('doc_id'))})")
def save_packed(spark, sf):
    """The whole job: texts to rows of one length, saved split by split."""
    path = fresh_path(spark, "packed")
    data = with_split(spread(docs(spark, sf))).select("doc_id", "split", "text")
    saved = jobs.make_constant(data, TOKENIZER, "doc_id", output_dir=path, seq_length=512, add_special_tokens=False)
    packed = readers.load(spark, saved, "splits")
    return packed.select("split", "chunk", arrays.as_text("input_ids").alias("input_ids"))


@query(
    "tokenize_job",
    f"""SELECT doc_id, text, {byte_count('text')}::INTEGER AS text_count, array_to_string({byte_ids('text')}, ',') AS text_input_ids,
    (SELECT sum({byte_count('text')}) FROM documents)::BIGINT AS total FROM documents""",
)
def tokenize_job(spark, sf):
    """The whole job: load, tokenize, save, and the sum of what was saved."""
    path = fresh_path(spark, "tokenized")
    options = {"output_column": None, "counts_column": "text_count", "batch_size": 64}
    total = jobs.tokenize_table(spark, TOKENIZER, f"{sf}/documents.parquet", path, **options)
    saved = readers.load(spark, path, "parquet")
    ids = arrays.as_text("text_input_ids").alias("text_input_ids")
    return saved.select("doc_id", "text", "text_count", ids, F.lit(total).cast("long").alias("total"))


@query(
    "pad_rule",
    f"""WITH cut AS (SELECT doc_id, {byte_ids('text')} AS ids, (row_number() OVER (ORDER BY doc_id) - 1) // 4 AS batch_id FROM documents),
    sized AS (SELECT *, (ceil(max(len(ids)) OVER (PARTITION BY batch_id) / 32.0) * 32)::INTEGER AS width FROM cut)
    SELECT doc_id, array_to_string(list_concat(ids, list_transform(range(width - len(ids)), lambda i: 2)), ',') AS input_ids FROM sized""",
)
def pad_rule(spark, sf):
    """A tokenizer without a padding token pads with its end token."""
    tokenizer = ByteTokenizer()
    tokenizer._pad_id = None
    rows = tokenizing.tokenize(spread(docs(spark, sf)), tokenizer, counts_column=None).select("doc_id", "input_ids")
    padded = padding.pad_for_lm(rows, "doc_id", tokenizer.pad_id, batch_size=4, multiple=32, drop_last=False)
    return padded.select("doc_id", arrays.as_text("input_ids").alias("input_ids"))


@query("tokenize_shuffle_pack", f"SELECT chunk, input_ids FROM ({fixed_sql(2048, order=SHUFFLED)})")
def tokenize_shuffle_pack(spark, sf):
    packed = mixing.tokenize_shuffle_pack(spread(docs(spark, sf)), TOKENIZER, "doc_id", seq_length=2048)
    return packed.select("chunk", arrays.as_text("input_ids").alias("input_ids"))


def buffers_sql(limit: int, ids: str, group: str = "0") -> str:
    """Greedy buffers: one recursion step per row of a group."""
    return f"""lens AS (SELECT doc_id, {group} AS grp, {ids} AS ids FROM documents),
    numbered AS (SELECT doc_id, grp, len(ids) AS n, row_number() OVER (PARTITION BY grp ORDER BY doc_id) - 1 AS o FROM lens),
    filling AS (
        SELECT doc_id, grp, o, n, n AS filled, 0::BIGINT AS buffer FROM numbered WHERE o = 0
        UNION ALL
        SELECT r.doc_id, r.grp, r.o, r.n, CASE WHEN f.filled >= {limit} THEN r.n ELSE f.filled + r.n END,
            CASE WHEN f.filled >= {limit} THEN f.buffer + 1 ELSE f.buffer END
        FROM filling f JOIN numbered r ON r.grp = f.grp AND r.o = f.o + 1)"""


def aligned_sql(length: int, sequences: int, ids: str, group: str = "0", order: str = "f.o") -> str:
    """The walk over each buffer: one recursion step per chunk."""
    return f"""WITH RECURSIVE {buffers_sql(length * sequences, ids, group)},
    docs_at AS (SELECT f.grp, f.buffer, list_concat(l.ids, [2, 1]) AS stream,
            sum(f.n + 2) OVER (PARTITION BY f.grp, f.buffer ORDER BY {order}) - (f.n + 2) AS start
        FROM filling f JOIN lens l USING (doc_id)),
    flat AS (SELECT grp, buffer, start + i AS pos, id FROM
        (SELECT grp, buffer, start, unnest(stream) AS id, unnest(range(len(stream))) AS i FROM docs_at)),
    sizes AS (SELECT grp, buffer, count(*) AS size FROM flat GROUP BY 1, 2),
    bos AS (SELECT grp, buffer, pos FROM flat WHERE id = 1),
    walk AS (
        SELECT s.grp, s.buffer, 0::BIGINT AS chunk, 0::BIGINT AS spot, (b.pos IS NOT NULL) AS hit, s.size
        FROM sizes s LEFT JOIN bos b ON b.grp = s.grp AND b.buffer = s.buffer AND b.pos = 0
        UNION ALL
        SELECT n.grp, n.buffer, n.chunk, n.spot, (b.pos IS NOT NULL), n.size
        FROM (SELECT grp, buffer, chunk + 1 AS chunk, spot + {length} - CASE WHEN hit THEN 0 ELSE 1 END AS spot, size FROM walk) n
        LEFT JOIN bos b ON b.grp = n.grp AND b.buffer = n.buffer AND b.pos = n.spot
        WHERE n.spot < n.size),
    whole AS (SELECT * FROM walk WHERE spot + {length} - CASE WHEN hit THEN 0 ELSE 1 END <= size),
    cut AS (SELECT w.grp, w.buffer, w.chunk, w.hit, f.pos, f.id FROM flat f ASOF JOIN whole w
            ON f.grp = w.grp AND f.buffer = w.buffer AND f.pos >= w.spot
        WHERE f.pos < w.spot + {length} - CASE WHEN w.hit THEN 0 ELSE 1 END)
    SELECT grp, buffer, chunk, CASE WHEN first(hit) THEN '' ELSE '1,' END || string_agg(id::VARCHAR, ',' ORDER BY pos) AS input_ids
    FROM cut GROUP BY 1, 2, 3"""


def packed_text(packed, *columns):
    return packed.select(*columns, "buffer", "chunk", arrays.as_text("input_ids").alias("input_ids"))


@query("pack_bos", f"SELECT buffer, chunk, input_ids FROM ({aligned_sql(256, 64, byte_ids('text'))})")
def pack_bos(spark, sf):
    tokens = byte_tokens(spark, sf)
    packed = packing.pack_aligned(tokens, "doc_id", bos=1, eos=2, seq_length=256, num_sequences=64)
    return packed_text(packed)


@query("pack_bos_default", f"SELECT buffer, chunk, input_ids FROM ({aligned_sql(2048, 1024, byte_ids('text'))})")
def pack_bos_default(spark, sf):
    return packed_text(packing.pack_aligned(byte_tokens(spark, sf), "doc_id", bos=1, eos=2))


@query(
    "pack_bos_shuffled",
    f"""SELECT buffer, chunk, row_number() OVER (PARTITION BY buffer ORDER BY md5('42:' || buffer || '/' || chunk)) - 1 AS position, input_ids
    FROM ({aligned_sql(256, 64, byte_ids('text'), order="md5('42:' || doc_id)")})""",
)
def pack_bos_shuffled(spark, sf):
    """Rows shuffled inside their buffer before the cut, chunks after it."""
    packed = packing.pack_aligned(
        byte_tokens(spark, sf), "doc_id", bos=1, eos=2, seq_length=256, num_sequences=64, shuffle_seed=42
    )
    return packed.select("buffer", "chunk", "position", arrays.as_text("input_ids").alias("input_ids"))


@query(
    "pack_by_split",
    f"""SELECT grp AS split, buffer, chunk, input_ids
    FROM ({aligned_sql(128, 64, 'list_concat([1], ' + byte_ids('text') + ')', split_of('doc_id'))})""",
)
def pack_by_split(spark, sf):
    """Each split on its own, over rows that already start with bos."""
    tokens = with_split(byte_tokens(spark, sf, add_special_tokens=True))
    return packed_text(mixing.pack_splits(tokens, "doc_id", TOKENIZER, seq_length=128, num_sequences=64), "split")


@query(
    "buffer_assign",
    f"WITH RECURSIVE {buffers_sql(64 * 1024, byte_ids('text'))} SELECT doc_id, buffer FROM filling",
)
def buffer_assign(spark, sf):
    return packing.assign_buffers(byte_tokens(spark, sf), "doc_id", seq_length=1024, num_sequences=64).select(
        "doc_id", "buffer"
    )


@query(
    "buffer_shuffle",
    f"""WITH RECURSIVE {buffers_sql(64 * 1024, byte_ids('text'))}
    SELECT doc_id, buffer, row_number() OVER (PARTITION BY buffer ORDER BY md5('42:' || doc_id), doc_id) - 1 AS position FROM filling""",
)
def buffer_shuffle(spark, sf):
    buffers = packing.assign_buffers(byte_tokens(spark, sf), "doc_id", seq_length=1024, num_sequences=64)
    return packing.shuffle_in_buffers(buffers, "buffer", "doc_id").select("doc_id", "buffer", "position")


@query(
    "longest_in_batch",
    f"""SELECT doc_id, max(n) OVER (PARTITION BY o // 8)::INTEGER AS longest
    FROM (SELECT doc_id, {byte_count('text')} AS n, row_number() OVER (ORDER BY doc_id) - 1 AS o FROM documents)""",
)
def longest_in_batch(spark, sf):
    # batches are told apart by lengths, so the arrays stay behind
    lengths = byte_tokens(spark, sf).select("doc_id", F.size("input_ids").alias("length"))
    batches = padding.assign_batches(lengths, "doc_id", 8)
    return grouping.longest_in(batches, "batch_id", length="length").select("doc_id", "longest")


@query(
    "pad_lm_16",
    f"""WITH cut AS (SELECT doc_id, list_concat([1], {byte_ids('text')}) AS ids, (row_number() OVER (ORDER BY doc_id) - 1) // 8 AS batch_id FROM documents),
    sized AS (SELECT *, (ceil(max(len(ids)) OVER (PARTITION BY batch_id) / 16.0) * 16)::INTEGER AS width, count(*) OVER (PARTITION BY batch_id) AS n FROM cut)
    SELECT doc_id, batch_id,
        array_to_string(list_concat(ids, list_transform(range(width - len(ids)), lambda i: 0)), ',') AS input_ids,
        array_to_string(list_concat(list_transform(ids, lambda i: 1), list_transform(range(width - len(ids)), lambda i: 0)), ',') AS attention_mask,
        array_to_string(list_concat(ids, list_transform(range(width - len(ids)), lambda i: -100)), ',') AS labels
    FROM sized WHERE n = 8""",
)
def pad_lm_16(spark, sf):
    tokens = byte_tokens(spark, sf, add_special_tokens=True).select("doc_id", "input_ids")
    padded = padding.pad_for_lm(tokens, "doc_id", TOKENIZER.pad_id, batch_size=8)
    return padded.select("doc_id", "batch_id", *[arrays.as_text(c).alias(c) for c in ("input_ids", "attention_mask", "labels")])


@query(
    "embed_hash",
    f"""WITH words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{WORD}')) AS word FROM documents),
    counts AS (SELECT doc_id, ('0x' || substr(md5(word), 1, 8))::BIGINT % 64 AS slot, count(*) AS n FROM words GROUP BY 1, 2)
    SELECT doc_id, slot::INTEGER AS slot, round((n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)))::FLOAT::DOUBLE, 5) AS value FROM counts""",
)
def embed_hash(spark, sf):
    """Vectors listed as their non-zero slots."""
    vectors = embedding.embed(spread(docs(spark, sf)), HashEncoder(64)).select(
        "doc_id", F.posexplode_outer("embedding").alias("slot", "value")
    )
    return vectors.filter(F.col("value") > 0).withColumn("value", F.round(F.col("value").cast("double"), 5))


EMBED_SQL = SQL["embed_hash"]


@query("embed_job", EMBED_SQL)
def embed_job(spark, sf):
    """The whole job: encode, save, export; vectors as read from the export, line by line."""
    path, lines = fresh_path(spark, "embedded"), fresh_path(spark, "embedded-tsv")
    rows = spread(docs(spark, sf)).select("doc_id", "lang", "text")
    embedding.embed_table(rows, HashEncoder(64), path, vectors_path=lines, labels=["doc_id", "lang"], batch_size=128)
    vectors = readers.in_list_order(spark, [f"{lines}/vectors"], "text")
    labels = readers.in_list_order(spark, [f"{lines}/metadata"], "csv", schema="doc_id bigint, lang string", sep="\t")
    numbers = F.transform(F.split("value", "\t"), lambda x: x.cast("float").cast("double"))
    slots = vectors.join(labels, "row_no").select("doc_id", F.posexplode(numbers).alias("slot", "value"))
    return slots.filter(F.col("value") > 0).withColumn("value", F.round("value", 5))


@query("embed_model", EMBED_SQL)
def embed_model(spark, sf):
    """A model that a function loads once per worker, here one that counts hashed words."""

    def load():
        import hashlib

        import numpy as np
        import regex

        def encode(texts):
            out = np.zeros((len(texts), 64), np.float32)
            for i, text in enumerate(texts):
                for word in regex.findall(WORD, text.lower()):
                    out[i, int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % 64] += 1
            return out

        return encode

    vectors = embedding.embed(spread(docs(spark, sf)).select("doc_id", "text"), ModelEncoder(load, 128))
    slots = vectors.select("doc_id", F.posexplode_outer("embedding").alias("slot", "value"))
    return slots.filter(F.col("value") > 0).withColumn("value", F.round(F.col("value").cast("double"), 5))


@query(
    "l2_normalize",
    """SELECT vec_id, round((x / norm)::FLOAT::DOUBLE, 5) AS value, place::INTEGER AS place FROM (
        SELECT vec_id, unnest(embedding)::DOUBLE * (1 + label) AS x, unnest(range(len(embedding))) AS place,
            sqrt(list_sum(list_transform(embedding, lambda v: (v::DOUBLE * (1 + label)) ^ 2))) AS norm FROM embeddings)""",
)
def l2_normalize(spark, sf):
    """Vectors stretched by their label, brought back to unit length."""
    stretched = table(spark, sf, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("label"))).alias("v")
    )
    unit = stretched.select("vec_id", F.posexplode(embedding.normalized("v")).alias("place", "value"))
    return unit.select("vec_id", "place", F.round(F.col("value").cast("double"), 5).alias("value"))


LOSS_SQL = "least(value, 100) / 20"


@query("perplexity_values", f"SELECT event_id, round(exp({LOSS_SQL}), 6) AS perplexity FROM events")
def perplexity_values(spark, sf):
    loss = F.least("value", F.lit(100.0)) / 20
    return table(spark, sf, "events").select("event_id", F.round(F.exp(loss), 6).alias("perplexity"))


@query(
    "perplexity_series",
    f"""WITH logs AS (SELECT user_id AS run_id, event_id AS step, exp({LOSS_SQL}) AS ppl FROM events),
    linked AS (SELECT *, coalesce(lag(ppl) OVER (PARTITION BY run_id ORDER BY step), 0) - ppl AS delta FROM logs)
    SELECT run_id, step, CASE WHEN ppl < exp(3.0) THEN round(ppl, 6) END AS perplexity,
        CASE WHEN ppl < exp(3.0) THEN round(delta, 6) END AS delta_ppl FROM linked""",
)
def perplexity_series(spark, sf):
    rated = series(training_log(spark, sf))
    return rated.select("run_id", "step", F.round("perplexity", 6).alias("perplexity"), F.round("delta_ppl", 6).alias("delta_ppl"))


def training_log(spark, sf):
    loss = F.least("value", F.lit(100.0)) / 20
    return table(spark, sf, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("step"), loss.alias("loss")
    )
