"""Chat formatting by schema fingerprints, in native expressions only.

Rows of one table may hold conversations in different layouts, in columns of their own or merged
into one. The paths of the nested fields that a row fills are hashed, and the hash selects a
declarative mapping that gives canonical turns, an array of (role, text). Turns are written in one template whose control strings cannot occur
in a text, since texts are escaped reversibly; a loss mask marks what the assistant says.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from itertools import combinations
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packfold.plans.barrier import computed_once

TURNS = "array<struct<role:string,text:string>>"
START, END = "<|im_start|>", "<|im_end|>\n"


class Mapping(NamedTuple):
    """How one layout becomes turns.

    ``fixed`` lists (role, path of a text). ``turns`` is a list of messages with the names of
    its role and text fields. ``optional`` paths may be missing. ``roles`` renames roles."""

    name: str
    fixed: tuple[tuple[str, str], ...] = ()
    turns: tuple[str, str, str] | None = None
    optional: tuple[str, ...] = ()
    roles: tuple[tuple[str, str], ...] = ()

    def paths(self) -> list[str]:
        listed = [f"{self.turns[0]}[].{f}" for f in self.turns[1:]] if self.turns else []
        return [p for _, p in self.fixed] + listed


# Layouts in common use.
SPEAKERS = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))
MAPPINGS = (
    Mapping("messages", turns=("messages", "role", "content")),
    Mapping("message texts", turns=("messages", "role", "text")),
    Mapping("conversations", turns=("conversations", "from", "value"), roles=SPEAKERS),
    Mapping("system and conversations", (("system", "system"),), ("conversations", "from", "value"), roles=SPEAKERS),
    Mapping("prompt and completion", (("system", "system"), ("user", "prompt"), ("assistant", "completion")), optional=("system",)),
    Mapping("prompt and response", (("system", "system"), ("user", "prompt"), ("assistant", "response")), optional=("system",)),
    Mapping(
        "instruction", (("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")),
        optional=("system", "input"),
    ),
    Mapping("question and answer", (("user", "question"), ("assistant", "answer"))),
)


def fingerprint(paths: Sequence[str]) -> str:
    """Hash of a set of field paths."""
    return hashlib.md5("\n".join(sorted(set(paths))).encode()).hexdigest()


def fingerprints(mapping: Mapping) -> list[str]:
    """Those of all rows that the mapping reads: with or without optional paths, and, since any
    field of a message may be null in a whole conversation, with or without fields of messages."""
    must = [p for _, p in mapping.fixed if p not in mapping.optional]
    may = list(mapping.optional)
    if mapping.turns:
        must.append(f"{mapping.turns[0]}[]")
        may += [f"{mapping.turns[0]}[].{f}" for f in mapping.turns[1:]]
    return [fingerprint([*must, *some]) for n in range(len(may) + 1) for some in combinations(may, n)]


def field_paths(name: str, kind: T.DataType) -> list[str]:
    """Paths of the leaves of a column: a.b for fields, a[] for elements."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f"{name}.{f.name}", f.dataType)]
    if isinstance(kind, T.ArrayType):
        return field_paths(f"{name}[]", kind.elementType)
    return [name]


def filled_paths(value: Column, path: str, kind: T.DataType) -> list[tuple[str, Column]]:
    """Paths below a column, lists too, each with whether a row fills it: a list that is not null,
    and a leaf that is not null, in some element where it lies in lists."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in filled_paths(value[f.name], f"{path}.{f.name}", f.dataType)]
    if not isinstance(kind, T.ArrayType):
        return [(path, value.isNotNull())]
    found = [(f"{path}[]", value.isNotNull())]
    if isinstance(kind.elementType, (T.StructType, T.ArrayType)):
        # one look along the list for each leaf
        for n, (inner, _) in enumerate(filled_paths(value, f"{path}[]", kind.elementType)):
            found.append((inner, F.coalesce(F.exists(value, _fills(kind.elementType, n)), F.lit(False))))
    return found


def _fills(kind: T.DataType, n: int):
    """Whether an element fills the n-th path of its type."""
    return lambda element: F.coalesce(filled_paths(element, "", kind)[n][1], F.lit(False))


def row_fingerprint(schema: T.StructType) -> Column:
    """Fingerprint of the paths that a row fills."""
    paths = [p for f in schema.fields for p in filled_paths(F.col(f"`{f.name}`"), f.name, f.dataType)]
    present = [F.when(filled, F.lit(path)) for path, filled in sorted(paths, key=lambda p: p[0])]
    return F.md5(F.concat_ws("\n", *present))


def _turns(mapping: Mapping, schema: T.StructType) -> Column | None:
    """The mapping over columns of this schema; None if it asks for columns that are not there."""
    have = {p for f in schema.fields for p in field_paths(f.name, f.dataType)}
    if not {p for p in mapping.paths() if p not in mapping.optional} <= have:
        return None
    parts = []
    for role, path in mapping.fixed:
        if path in have:
            one = F.struct(F.lit(role).alias("role"), F.col(path).cast("string").alias("text"))
            # an optional text that is missing is no turn
            parts.append(F.when(F.col(path).isNotNull(), F.array(one)).otherwise(F.array().cast(TURNS)) if path in mapping.optional else F.array(one))
    if mapping.turns:
        column, role, text = mapping.turns
        renamed = F.create_map(*[F.lit(x) for pair in mapping.roles for x in pair]) if mapping.roles else None

        def turn(message: Column) -> Column:
            name = message[role].cast("string")
            if renamed is not None:
                name = F.coalesce(F.element_at(renamed, name), name)
            return F.struct(name.alias("role"), message[text].cast("string").alias("text"))

        parts.append(F.transform(F.col(column), turn))
    return F.concat(*[p.cast(TURNS) for p in parts])


def canonical_turns(df: DataFrame, keep: Sequence[str], mappings: Sequence[Mapping] = MAPPINGS) -> DataFrame:
    """``keep`` columns, layout (the mapping's name), fingerprint and turns.

    All columns that are not kept are part of the layout. Where several mappings have a row's
    fingerprint (its messages hold no text, say) the first of them reads it. A row whose fingerprint
    no mapping has keeps null layout and turns; ``split_layouts`` takes such rows apart.
    """
    schema = T.StructType([f for f in df.schema.fields if f.name not in keep])
    marked = df.withColumn("_fingerprint", row_fingerprint(schema))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for mapping in reversed(mappings):
        made = _turns(mapping, schema)
        if made is not None:
            chosen = F.col("_fingerprint").isin(fingerprints(mapping))
            layout, turns = F.when(chosen, F.lit(mapping.name)).otherwise(layout), F.when(chosen, made).otherwise(turns)
    return marked.select(*keep, layout.alias("layout"), F.col("_fingerprint").alias("fingerprint"), turns.alias("turns"))


def split_layouts(turned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a known layout, and the rejected rest, to be counted by fingerprint and looked at."""
    return turned.filter(F.col("layout").isNotNull()), turned.filter(F.col("layout").isNull())


def escape(text: Column) -> Column:
    """No control string is left: between < and | comes one backslash more than there was."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", "<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


SPANS = "array<struct<start:bigint,end:bigint>>"


def starts_of(sizes: Column) -> Column:
    """Running totals before each of an array of sizes.

    A total is taken over whole blocks of sizes first and inside a block then, so the work for n
    sizes grows with n times the square root of n, and no array is copied for each of them."""
    n = F.size(sizes)
    width = F.greatest(F.ceil(F.sqrt(n)).cast("int"), F.lit(1))
    blocks = F.transform(F.sequence(F.lit(0), F.ceil(n / width).cast("int") - 1), lambda b: F.slice(sizes, b * width + 1, width))
    total = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda t, x: t + x)
    sums = F.transform(blocks, total)
    placed = F.zip_with(blocks, F.transform(sums, lambda s, b: total(F.slice(sums, 1, b))), lambda block, at: F.struct(block.alias("block"), at.alias("at")))
    within = F.transform(placed, lambda p: F.transform(p["block"], lambda x, i: p["at"] + total(F.slice(p["block"], 1, i))))
    return F.when(n > 0, F.flatten(within)).otherwise(F.array().cast("array<bigint>"))


def formatted(df: DataFrame, keep: Sequence[str], turns: str = "turns") -> DataFrame:
    """``keep`` columns, formatted (the text of all turns) and loss_mask.

    The mask has (start, end) in code points of the formatted text, one span for each
    assistant text. Null roles and texts are empty; a conversation of no turns is empty text. Null
    turns, those of a layout that is not known, have null text and mask.
    """
    empty = F.lit("")
    pieces = F.transform(
        F.col(turns),
        lambda t: F.struct(
            F.concat(F.lit(START), escape_role(F.coalesce(t["role"], empty)), F.lit("\n")).alias("head"),
            escape(F.coalesce(t["text"], empty)).alias("body"),
            F.coalesce(t["role"] == "assistant", F.lit(False)).alias("loss"),
        ),
    )
    cut = computed_once(df.select(*keep, F.col(turns)), _pieces=pieces)
    sizes = F.transform("_pieces", lambda p: (F.length(p["head"]) + F.length(p["body"]) + len(END)).cast("long"))
    sized = computed_once(cut, _sizes=sizes)
    placed = F.zip_with("_pieces", starts_of(F.col("_sizes")), lambda p, at: F.struct(p.alias("piece"), (at + F.length(p["head"])).alias("at")))
    spans = F.transform(
        F.filter(placed, lambda p: p["piece"]["loss"]),
        lambda p: F.struct(p["at"].alias("start"), (p["at"] + F.length(p["piece"]["body"])).alias("end")),
    )
    text = F.array_join(F.transform("_pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    return sized.select(*keep, text.alias("formatted"), spans.cast(SPANS).alias("loss_mask"))


def read_turns(text: Column) -> Column:
    """The turns that a formatted text holds."""
    parts = F.slice(F.split(text, r"<\|im_start\|>", -1), 2, 1 << 30)

    def turn(part: Column) -> Column:
        head = F.substring_index(part, "\n", 1)
        size = F.length(part) - F.length(head) - F.lit(1 + len(END))
        return F.struct(
            unescape_role(head).alias("role"), unescape(F.substring(part, F.length(head) + 2, size)).alias("text")
        )

    return F.transform(parts, turn)


def read_loss(text: Column, mask: Column) -> Column:
    """All text under the mask, unescaped."""
    return F.array_join(F.transform(mask, lambda s: unescape(F.substring(text, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def gathered(rows: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows by turn as one row for each key with a list of messages (role, text).

    Turns come in order of ``turn`` (null first), equal ones by role and text; repeated rows
    stay. A conversation is one row of the result, so its turns meet in one task.
    """
    listed = F.sort_array(F.collect_list(F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))))
    grouped = rows.groupBy(key).agg(listed.alias("_rows"))
    return grouped.select(key, F.transform("_rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("messages"))
