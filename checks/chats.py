"""Chat rendering, pairs, padding of chats."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import byte_count, byte_ids, draw, query, table
from checks.tokens import TOKENIZER
from packfold.functions import arrays
from packfold.operators import chat, padding
from packfold.operators.chat import LLAMA, SMOL


def turns(spark, sf):
    return table(spark, sf, "conversations")


def line_sql(template: str, role: str = "role", text: str = "text") -> str:
    if template == "llama":
        return f"'<|start_header_id|>' || {role} || '<|end_header_id|>' || chr(10) || chr(10) || {text} || '<|eot_id|>'"
    return f"'<|im_start|>' || {role} || chr(10) || {text} || '<|im_end|>' || chr(10)"


SYSTEM_SQL = {
    "llama": "'Cutting Knowledge Date: December 2023' || chr(10) || 'Today Date: 04 Nov 2024' || chr(10) || chr(10)",
    "smol": "'You are a helpful AI assistant named SmolLM, trained by Hugging Face'",
}


def lines_sql(template: str, source: str = "SELECT conv_id, turn, role, text FROM conversations") -> str:
    """All messages of all chats, the default system message as turn -1."""
    return f"""source_turns AS ({source}),
    openings AS (SELECT conv_id, -1 AS turn, 'system' AS role, {SYSTEM_SQL[template]} AS text FROM source_turns
        GROUP BY conv_id HAVING arg_min(role, turn) <> 'system'),
    lines AS (SELECT conv_id, turn, role, {line_sql(template)} AS line
        FROM (SELECT * FROM source_turns UNION ALL SELECT * FROM openings))"""


def chat_sql(template: str, source: str | None = None) -> str:
    lead = {"llama": ("'<s>' || ", "'1,' || ", "'-100,' || "), "smol": ("", "", "")}[template]
    masked = f"CASE role WHEN 'assistant' THEN array_to_string({byte_ids('line')}, ',') ELSE rtrim(repeat('-100,', {byte_count('line')}), ',') END"
    lines = lines_sql(template, source) if source else lines_sql(template)
    return f"""WITH {lines}
    SELECT conv_id, {lead[0]}string_agg(line, '' ORDER BY turn) AS text,
        {lead[1]}string_agg(array_to_string({byte_ids('line')}, ','), ',' ORDER BY turn) AS input_ids,
        {lead[2]}string_agg({masked}, ',' ORDER BY turn) AS label
    FROM lines GROUP BY conv_id"""


def rendered(df, template, *columns):
    out = chat.render_chats(df, template, TOKENIZER)
    return out.select(
        *columns, "text", arrays.as_text("input_ids").alias("input_ids"), arrays.as_text("label").alias("label")
    )


@query("chat_llama", chat_sql("llama"))
def chat_llama(spark, sf):
    return rendered(chat.nest_messages(turns(spark, sf)), LLAMA, "conv_id")


@query("chat_smol", chat_sql("smol"))
def chat_smol(spark, sf):
    return rendered(chat.nest_messages(turns(spark, sf)), SMOL, "conv_id")


@query("messages_llama", f"SELECT conv_id, turn, {line_sql('llama')} AS line FROM conversations")
def messages_llama(spark, sf):
    line = LLAMA.render(F.col("role"), F.col("text"))
    return turns(spark, sf).select("conv_id", "turn", line.alias("line"))


@query("messages_smol", f"SELECT conv_id, turn, {line_sql('smol')} AS line FROM conversations")
def messages_smol(spark, sf):
    line = SMOL.render(F.col("role"), F.col("text"))
    return turns(spark, sf).select("conv_id", "turn", line.alias("line"))


@query(
    "chat_default_system",
    """SELECT conv_id, count(*) + (arg_min(role, turn) <> 'system')::INTEGER AS messages, 'system' AS first_role
    FROM conversations GROUP BY conv_id""",
)
def chat_default_system(spark, sf):
    nested = chat.nest_messages(turns(spark, sf))
    full = nested.select("conv_id", chat.with_default_system(F.col("messages"), SMOL).alias("full"))
    return full.select("conv_id", F.size("full").cast("long").alias("messages"), F.get("full", F.lit(0))["role"].alias("first_role"))


@query(
    "chat_mask_stats",
    f"""WITH {lines_sql('llama')}
    SELECT conv_id, sum({byte_count('line')})::BIGINT + 1 AS tokens,
        sum(CASE role WHEN 'assistant' THEN {byte_count('line')} ELSE 0 END)::BIGINT AS kept
    FROM lines GROUP BY conv_id""",
)
def chat_mask_stats(spark, sf):
    out = chat.render_chats(chat.nest_messages(turns(spark, sf)), LLAMA, TOKENIZER, with_text=False)
    kept = F.size(F.filter("label", lambda x: x != arrays.IGNORED))
    return out.select("conv_id", F.size("input_ids").cast("long").alias("tokens"), kept.cast("long").alias("kept"))


@query("chat_long_form", f"WITH {lines_sql('smol')} SELECT conv_id, string_agg(line, '' ORDER BY turn) AS text FROM lines GROUP BY conv_id")
def chat_long_form(spark, sf):
    return chat.render_turns(turns(spark, sf), SMOL)


PAIRS_SQL = """SELECT q.conv_id * 1000 + q.turn AS conv_id, q.text AS prompt, a.text AS completion
    FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1
    WHERE q.role = 'user' AND a.role = 'assistant'"""


def pairs(spark, sf):
    said = turns(spark, sf)
    asked = said.filter(F.col("role") == "user").select(
        "conv_id", "turn", (F.col("turn") + 1).alias("next"), F.col("text").alias("prompt")
    )
    answered = said.filter(F.col("role") == "assistant").select(
        "conv_id", F.col("turn").alias("next"), F.col("text").alias("completion")
    )
    matched = asked.join(answered, ["conv_id", "next"])
    return matched.select((F.col("conv_id") * 1000 + F.col("turn")).alias("conv_id"), "prompt", "completion")


def pairs_sql(template: str, system: str | None = None, role: str = "user") -> str:
    extra = f"UNION ALL SELECT conv_id, 0, '{role}', '{system}' FROM pairs" if system else ""
    source = f"""WITH pairs AS ({PAIRS_SQL})
        SELECT conv_id, 1 AS turn, 'user' AS role, prompt AS text FROM pairs
        UNION ALL SELECT conv_id, 2, 'assistant', completion FROM pairs {extra}"""
    return chat_sql(template, source)


@query("pairs_smol", pairs_sql("smol"))
def pairs_smol(spark, sf):
    return rendered(chat.pair_messages(pairs(spark, sf)), SMOL, "conv_id")


@query("pairs_llama_prompted", pairs_sql("llama", "Answer briefly."))
def pairs_llama_prompted(spark, sf):
    return rendered(chat.pair_messages(pairs(spark, sf), system_prompt="Answer briefly."), LLAMA, "conv_id")


@query(
    "template_conformance",
    "SELECT conv_id, text, text AS expected FROM conversations WHERE FALSE",
)
def template_conformance(spark, sf):
    """Chats that differ between two renderings: none."""
    return chat.conformance(turns(spark, sf), SMOL, TOKENIZER, fraction=1.0)


class LongLinesGainAnId(type(TOKENIZER)):
    """A tokenizer that is wrong in nested messages of more than 200 bytes."""

    def encode_each(self, texts):
        longer = lambda ids: F.when(F.size(ids) > 200, F.concat(ids, F.array(F.lit(2)))).otherwise(ids)
        return F.transform(super().encode_each(texts), longer)


@query(
    "template_conformance_broken",
    f"WITH {lines_sql('smol')} SELECT conv_id FROM lines GROUP BY conv_id HAVING max({byte_count('line')}) > 200",
)
def template_conformance_broken(spark, sf):
    """Exactly the chats with a line that the broken tokenizer gets wrong."""
    return chat.conformance(turns(spark, sf), SMOL, LongLinesGainAnId(), fraction=1.0).select("conv_id")


@query("chat_sample", f"SELECT DISTINCT conv_id FROM conversations WHERE {draw('conv_id')} <= 0.05")
def chat_sample(spark, sf):
    from packfold.operators.selecting import sample_rows

    return sample_rows(turns(spark, sf), "conv_id", 0.05).select("conv_id").distinct()


SFT_SPLIT = "CASE conv_id % 10 WHEN 8 THEN 'test_sft' WHEN 9 THEN 'train_gen' ELSE 'train_sft' END"


@query(
    "chat_splits",
    f"""SELECT CASE split WHEN 'train_sft' THEN 'train' ELSE 'validation' END AS split, input_ids, label, text
    FROM (SELECT *, {SFT_SPLIT} AS split FROM ({chat_sql('smol')})) WHERE split <> 'train_gen'""",
)
def chat_splits(spark, sf):
    nested = chat.nest_messages(turns(spark, sf)).withColumn("split", F.expr(SFT_SPLIT))
    out = chat.everyday_chats(nested, SMOL, TOKENIZER, only_output=True)
    return out.select("split", "text", *[arrays.as_text(c).alias(c) for c in ("input_ids", "label")])


@query(
    "pad_labels_64",
    f"""WITH {lines_sql('smol')},
    flat AS (SELECT conv_id, turn, role, unnest({byte_ids('line')}) AS id, unnest(range({byte_count('line')})) AS i FROM lines),
    chats AS (SELECT conv_id, list(id ORDER BY turn, i) AS ids,
        list(CASE role WHEN 'assistant' THEN id ELSE -100 END ORDER BY turn, i) AS label FROM flat GROUP BY conv_id),
    placed AS (SELECT *, (row_number() OVER (ORDER BY conv_id) - 1) // 8 AS batch_id FROM chats),
    sized AS (SELECT *, (ceil(max(len(ids)) OVER (PARTITION BY batch_id) / 64.0) * 64)::INTEGER - len(ids) AS gap FROM placed)
    SELECT conv_id, batch_id,
        array_to_string(list_concat(ids, list_transform(range(gap), lambda i: 0)), ',') AS input_ids,
        array_to_string(list_concat(list_transform(ids, lambda i: 1), list_transform(range(gap), lambda i: 0)), ',') AS attention_mask,
        array_to_string(list_concat(label, list_transform(range(gap), lambda i: -100)), ',') AS labels
    FROM sized""",
)
def pad_labels_64(spark, sf):
    chats = chat.render_chats(chat.nest_messages(turns(spark, sf)), SMOL, TOKENIZER).select("conv_id", "input_ids", "label")
    padded = padding.pad_with_labels(chats, "conv_id", TOKENIZER.pad_id, batch_size=8)
    return padded.select("conv_id", "batch_id", *[arrays.as_text(c).alias(c) for c in ("input_ids", "attention_mask", "labels")])
