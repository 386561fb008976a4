"""Rendering chats through a template, with token ids and label masks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packfold.functions.arrays import IGNORED, repeated
from packfold.functions.tokenizers import Tokenizer
from packfold.operators.selecting import rename_splits, roles_checked, sample_rows

GENERATED_ROLE = "assistant"
MESSAGES = "array<struct<role:string,content:string>>"


@dataclass(frozen=True)
class ChatTemplate:
    """``render(role, content)`` returns a column expression, so custom templates stay native."""

    render: Callable[[Column, Column], Column]
    default_system: str | None
    add_bos: bool


# Message layouts and default system texts of the two chat formats.
def render_llama(role: Column, content: Column) -> Column:
    return F.concat(
        F.lit("<|start_header_id|>"), role, F.lit("<|end_header_id|>\n\n"), content, F.lit("<|eot_id|>")
    )


def render_smol(role: Column, content: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), content, F.lit("<|im_end|>\n"))


LLAMA = ChatTemplate(
    render=render_llama,
    default_system="Cutting Knowledge Date: December 2023\nToday Date: 04 Nov 2024\n\n",
    add_bos=True,
)
SMOL = ChatTemplate(
    render=render_smol,
    default_system="You are a helpful AI assistant named SmolLM, trained by Hugging Face",
    add_bos=False,
)


def message(role: str | Column, content: str | Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    content = F.lit(content) if isinstance(content, str) else content
    return F.struct(role.cast("string").alias("role"), content.cast("string").alias("content"))


def nest_messages(
    turns: DataFrame, *, chat: str = "conv_id", turn: str = "turn", role: str = "role", content: str = "text"
) -> DataFrame:
    """One row per chat with its messages in turn order. Moves raw text, before tokens exist."""
    said = F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(content).alias("content"))
    nested = turns.groupBy(chat).agg(F.sort_array(F.collect_list(said)).alias("_said"))
    messages = F.transform("_said", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return nested.select(chat, messages.alias("messages"))


def with_default_system(messages: Column, template: ChatTemplate) -> Column:
    """Messages with the template's system text in front, unless they start with one."""
    starts_with_system = F.coalesce(F.get(messages, F.lit(0))["role"] == "system", F.lit(False))
    if not template.default_system:
        missing = F.raise_error("the chat template defines no default system text").cast(MESSAGES)
        return F.when(starts_with_system, messages).otherwise(missing)
    return F.when(starts_with_system, messages).otherwise(
        F.concat(F.array(message("system", template.default_system)), messages)
    )


def _rendered(messages: Column, template: ChatTemplate) -> Column:
    return F.transform(messages, lambda m: template.render(roles_checked(m["role"]), F.coalesce(m["content"], F.lit(""))))


def render_chats(
    df: DataFrame,
    template: ChatTemplate,
    tokenizer: Tokenizer,
    *,
    messages: str = "messages",
    with_text: bool = True,
    only_output: bool = False,
) -> DataFrame:
    """Add ``input_ids``, ``label`` and ``text`` of the chat in ``messages``; no shuffle.

    Every message is tokenized on its own. Labels repeat the ids of assistant messages and
    ignore all others, and so does the leading ``bos`` of templates that have one.
    """
    lead_ids = [tokenizer.bos_id] if template.add_bos else []
    full = with_default_system(F.col(messages), template)
    parts = df.withColumn("_full", full).withColumn("_parts", _rendered(F.col("_full"), template))
    parts = parts.withColumn("_ids", tokenizer.encode_each("_parts"))
    masked = F.zip_with(
        "_full",
        "_ids",
        lambda m, ids: F.when(m["role"] == GENERATED_ROLE, ids).otherwise(repeated(IGNORED, F.size(ids))),
    )
    lead = lambda value: F.array(*[F.lit(value) for _ in lead_ids]).cast("array<int>")
    outputs = [
        F.concat(lead(tokenizer.bos_id), F.flatten("_ids")).alias("input_ids"),
        F.concat(lead(IGNORED), F.flatten(masked)).alias("label"),
    ]
    if with_text:
        opening = tokenizer.bos_token if template.add_bos else ""
        outputs.append(F.concat(F.lit(opening), F.array_join("_parts", "")).alias("text"))
    kept = [] if only_output else df.columns
    return parts.select(*kept, *outputs)


def pair_messages(
    df: DataFrame,
    *,
    prompt: str = "prompt",
    completion: str = "completion",
    system_prompt: str | None = None,
    system_role: str = "user",
) -> DataFrame:
    """Add ``messages`` made of a prompt and its completion.

    ``system_prompt`` comes first; by default it is put in as a user message, which leaves the
    template's own system text in place.
    """
    turns = [message("user", F.col(prompt)), message(GENERATED_ROLE, F.col(completion))]
    if system_prompt:
        turns.insert(0, message(system_role, system_prompt))
    return df.withColumn("messages", F.array(*turns))


def render_pairs(df: DataFrame, template: ChatTemplate, tokenizer: Tokenizer, **options) -> DataFrame:
    return render_chats(pair_messages(df, **options), template, tokenizer)


def everyday_chats(
    df: DataFrame,
    template: ChatTemplate | None,
    tokenizer: Tokenizer | None = None,
    *,
    splits=(("train_sft", "train"), ("test_sft", "validation")),
    only_output: bool = False,
) -> DataFrame:
    """Chats of the two fine-tuning splits under their usual names, rendered if a template is given."""
    chosen = rename_splits(df, dict(splits))
    if template is None:
        return chosen
    rendered = render_chats(chosen, template, tokenizer)
    return rendered.select("split", "input_ids", "label", "text") if only_output else rendered


def turn_lines(
    turns: DataFrame, template: ChatTemplate, *, chat: str = "conv_id", turn: str = "turn", role: str = "role", content: str = "text"
) -> DataFrame:
    """(chat, _turn, _role, _line) of the long form, with the default system line where a chat
    begins with another role."""
    opening = turns.groupBy(chat).agg(F.min_by(role, turn).alias("_first"))
    system = opening.filter(F.col("_first") != "system").select(
        chat,
        F.lit(-1).cast("long").alias("_turn"),
        F.lit("system").alias("_role"),
        template.render(F.lit("system"), F.lit(template.default_system)).alias("_line"),
    )
    said = turns.select(
        chat,
        F.col(turn).cast("long").alias("_turn"),
        F.col(role).alias("_role"),
        template.render(roles_checked(F.col(role)), F.coalesce(content, F.lit(""))).alias("_line"),
    )
    return said.unionByName(system)


def render_turns(
    turns: DataFrame, template: ChatTemplate, *, chat: str = "conv_id", turn: str = "turn", role: str = "role", content: str = "text"
) -> DataFrame:
    """Rendered text from the long form, by string aggregation: a second route to the same text."""
    lines = F.sort_array(F.collect_list(F.struct("_turn", "_line")))["_line"]
    rendered = turn_lines(turns, template, chat=chat, turn=turn, role=role, content=content)
    return rendered.groupBy(chat).agg(F.array_join(lines, "").alias("text"))


def conformance(
    turns: DataFrame,
    template: ChatTemplate,
    tokenizer: Tokenizer,
    *,
    fraction: float = 0.05,
    seed: int = 42,
    chat: str = "conv_id",
) -> DataFrame:
    """Sampled chats whose text, ids or labels differ between the two ways of rendering.

    One way renders and tokenizes nested messages, the other the rows of the long form, line by
    line. Chats that one way lacks differ as well; nulls equal nulls. Empty when all agree.
    """
    sampled = sample_rows(turns, chat, fraction, seed)
    nested = render_chats(nest_messages(sampled, chat=chat), template, tokenizer).select(chat, "text", "input_ids", "label")
    opening = tokenizer.bos_token if template.add_bos else ""
    lead = [tokenizer.bos_id] if template.add_bos else []
    lines = turn_lines(sampled, template, chat=chat)
    ids = tokenizer.encode("_line")
    tokens = lines.select(chat, "_turn", "_role", "_line", ids.alias("_ids"))
    masked = F.when(F.col("_role") == GENERATED_ROLE, F.col("_ids")).otherwise(repeated(IGNORED, F.size("_ids")))
    rows = F.sort_array(F.collect_list(F.struct("_turn", "_line", "_ids", masked.alias("_label"))))
    other = tokens.groupBy(chat).agg(rows.alias("_rows")).select(
        F.col(chat).alias("_chat"),
        F.concat(F.lit(opening), F.array_join("_rows._line", "")).alias("expected"),
        F.concat(F.array(*map(F.lit, lead)).cast("array<int>"), F.flatten("_rows._ids")).alias("_expected_ids"),
        F.concat(F.array(*[F.lit(IGNORED) for _ in lead]).cast("array<int>"), F.flatten("_rows._label")).alias("_expected_label"),
    )
    joined = nested.join(other, F.col(chat).eqNullSafe(F.col("_chat")), "full")
    same = (
        F.col("text").eqNullSafe(F.col("expected"))
        & F.col("input_ids").eqNullSafe(F.col("_expected_ids"))
        & F.col("label").eqNullSafe(F.col("_expected_label"))
    )
    return joined.filter(~same).select(F.coalesce(chat, "_chat").alias(chat), "text", "expected")
