"""Repair of conversation structure by Viterbi search with survivor coalescence.

A repaired conversation alternates: an optional system turn, then pairs of user and assistant.
Every row is kept, given another role, or deleted, and empty turns may be inserted; each edit has
a price. Four states say what was put out last. Rows are read in order, once, and each state
holds its cheapest way there, ties going to the least string of edits.

The ways form a tree of backpointers that counts its holders: a way that loses frees what only it
used, and as soon as all survivors descend from one node the edits up to it are put out. Only
strings that are still unresolved stay in memory. Two ways that reach one state at one price are
told apart by their complete unresolved strings: no survivor's string begins another's (both end
with the edit of the same row), so their order, once known, holds under any edits that follow, and
is carried from row to row as a rank.

What the search holds of a conversation is one character for each unresolved edit, so a
conversation of any length passes through a task row by row; it is never gathered. Rows must be
in one task and in order, as the digest of what comes out is one chain over the conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import cache
from itertools import chain, islice
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEEP, REROLE, DELETE, INSERT = "KRDI"
COSTS = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
TRUNCATED_COST = 5
OK, BLANK, DUPLICATE, TRUNCATED = range(4)
ROLES = {"u": "user", "a": "assistant"}
INITIALS = ("s", "u", "a")

# States: nothing put out yet, a system turn, a user turn, an assistant turn.
STATES = range(4)
NOTHING, SYSTEM, USER, ASSISTANT = STATES
FINAL = (NOTHING, ASSISTANT)
# What a state puts out next, and the state that leads to.
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
# The state that an inserted turn leads to; where a rerole leads is the same.
ADDED = (USER, USER, ASSISTANT, USER)
# BOUND[x][y]: whatever follows x can follow y for at most this much more. From a system turn
# the end asks for two insertions; a second system turn is deleted; other steps are insertions.
BOUND = (
    (0, 2 * COSTS[INSERT], COSTS[INSERT] + COSTS[DELETE], COSTS[DELETE]),
    (0, 0, COSTS[INSERT], 0),
    (COSTS[INSERT], COSTS[INSERT], 0, COSTS[INSERT]),
    (0, 2 * COSTS[INSERT], COSTS[INSERT], 0),
)


class Step(NamedTuple):
    """One way to take a row: ``edits`` are insertions before it and what happens to it."""

    begin: int
    end: int
    cost: int
    edits: str


@cache
def steps(initial: str, fault: int) -> tuple[Step, ...]:
    """The cheapest way of taking a row between any two states; all others lose to these."""
    best: dict[tuple[int, int], Step] = {}
    for begin in STATES:
        at, before = begin, ""
        for _ in range(3):
            price = COSTS[INSERT] * len(before)
            undeleted = TRUNCATED_COST if fault == TRUNCATED else 0
            # insertions before a deletion cost the same as after it, where they spell less
            ways = [] if before else [Step(begin, at, COSTS[DELETE], DELETE)]
            if fault not in (BLANK, DUPLICATE):
                if initial in NEXT[at]:
                    ways.append(Step(begin, NEXT[at][initial], price + undeleted, before + KEEP))
                ways.append(Step(begin, ADDED[at], price + undeleted + COSTS[REROLE], before + REROLE))
            for way in ways:
                known = best.get(way[:2])
                if known is None or way[2:] < known[2:]:
                    best[way[:2]] = way
            at, before = ADDED[at], before + INSERT
    return tuple(best.values())


class Node:
    """Edits that follow a parent's; ``holds`` counts the survivors that end here."""

    __slots__ = ("edits", "parent", "children", "holds")

    def __init__(self, edits: str, parent: Node | None):
        self.edits, self.parent = bytearray(edits.encode()), parent
        self.children: list[Node] = []
        self.holds = 0
        if parent is not None:
            parent.children.append(self)


class Survivor(NamedTuple):
    cost: int
    rank: int
    node: Node
    digest: object


class Search:
    """The search over one conversation; rows are given in order by ``row``."""

    def __init__(self):
        self.root = Node("", None)
        self.root.holds = 1
        self.alive: dict[int, Survivor] = {NOTHING: Survivor(0, 0, self.root, _Lines())}
        # edits that all survivors share
        self.audit = bytearray()

    def unresolved(self) -> int:
        """Edits held that are not put out yet."""
        total, open_nodes = 0, [self.root]
        while open_nodes:
            node = open_nodes.pop()
            total += len(node.edits)
            open_nodes += node.children
        return total

    def row(self, role: str, text: str, fault: int) -> None:
        chosen: dict[int, tuple] = {}
        for step in steps(role[:1] if role.startswith(INITIALS) else "", fault):
            before = self.alive.get(step.begin)
            if before is None:
                continue
            way = (before.cost + step.cost, before.rank, step.edits, step)
            known = chosen.get(step.end)
            # equal cost: the rank tells strings of different survivors apart, edits those of one
            if known is None or way[:3] < known[:3]:
                chosen[step.end] = way
        self._advance(_promising(chosen), role, text)

    def _advance(self, chosen: dict[int, tuple], role: str, text: str) -> None:
        order = sorted(chosen, key=lambda s: chosen[s][1:3])
        uses = [0] * len(STATES)
        for cost, _, _, step in chosen.values():
            uses[step.begin] += 1
        after = {}
        for rank, state in enumerate(order):
            cost, _, _, step = chosen[state]
            before = self.alive[step.begin]
            uses[step.begin] -= 1
            last = uses[step.begin] == 0
            digest = before.digest if last else before.digest.copy()
            digest.put(step, role, text)
            if last and before.node.holds == 1 and not before.node.children and before.node is not self.root:
                # the only way on from a node is written on
                node = before.node
                node.edits += step.edits.encode()
                node.holds += 1
            else:
                node = Node(step.edits, before.node)
                node.holds = 1
            after[state] = Survivor(cost, rank, node, digest)
        for survivor in self.alive.values():
            self._release(survivor.node)
        self.alive = after
        self._emit()

    def _release(self, node: Node) -> None:
        node.holds -= 1
        while node.holds == 0 and not node.children and node.parent is not None:
            node.parent.children.remove(node)
            node = node.parent

    def _emit(self) -> None:
        """Put out what all survivors share."""
        while self.root.holds == 0 and len(self.root.children) == 1:
            self.root = self.root.children[0]
            self.root.parent = None
            self.audit += self.root.edits
            self.root.edits = bytearray()

    def end(self) -> tuple[int, str, str]:
        """Cost, edits and digest of the cheapest repair."""
        ends = []
        for state, survivor in self.alive.items():
            at, added = state, ""
            while at not in FINAL:
                at, added = ADDED[at], added + INSERT
            ends.append((survivor.cost + COSTS[INSERT] * len(added), survivor.rank, added, state))
        cost, _, added, state = min(ends)
        survivor = self.alive[state]
        path, node = [], survivor.node
        while node is not None:
            path.append(bytes(node.edits))
            node = node.parent
        survivor.digest.insert(state, added)
        audit = bytes(self.audit) + b"".join(reversed(path)) + added.encode()
        return cost, audit.decode(), survivor.digest.hexdigest()


def _promising(chosen: dict[int, tuple]) -> dict[int, tuple]:
    """Without ways that some other is sure to beat, whatever rows follow."""
    return {x: way for x, way in chosen.items() if all(way[0] <= other[0] + BOUND[x][y] for y, other in chosen.items())}


class _Lines:
    """Running SHA-256 of the repaired turns, ``role:text`` joined by line feeds."""

    __slots__ = ("hash", "empty")

    def __init__(self):
        self.hash, self.empty = hashlib.sha256(), True

    def copy(self) -> _Lines:
        new = _Lines.__new__(_Lines)
        new.hash, new.empty = self.hash.copy(), self.empty
        return new

    def line(self, role: str, text: str) -> None:
        self.hash.update(f"{role}:{text}".encode() if self.empty else f"\n{role}:{text}".encode())
        self.empty = False

    def insert(self, state: int, edits: str) -> int:
        for _ in edits:
            self.line(_added_role(state), "")
            state = ADDED[state]
        return state

    def put(self, step: Step, role: str, text: str) -> None:
        at, edit = self.insert(step.begin, step.edits[:-1]), step.edits[-1]
        if edit != DELETE:
            self.line(role if edit == KEEP else _added_role(at), text)

    def hexdigest(self) -> str:
        return self.hash.hexdigest()


def _added_role(state: int) -> str:
    return ROLES["a" if ADDED[state] == ASSISTANT else "u"]


class _Conversation:
    """Counts and search over the rows of one conversation, in order."""

    GOOD_PAIRS = frozenset(("su", "ua", "au"))

    def __init__(self, key):
        self.key, self.search = key, Search()
        self.faults = [0, 0, 0, 0]
        self.illegal, self.turns = 0, 0
        self.first = self.last = self.initial = None

    def row(self, turn: int | None, role: str, text: str, fault: int) -> None:
        if turn is not None and turn != self.last:
            self.turns += 1
            self.first = turn if self.first is None else self.first
            self.last = turn
        if self.initial is not None and self.initial + role[:1] not in self.GOOD_PAIRS:
            self.illegal += 1
        self.initial = role[:1]
        self.faults[fault] += 1
        self.search.row(role, text, fault)

    def result(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return (self.key, min(gaps, 2**63 - 1), *self.faults[BLANK:], self.illegal, *self.search.end())


def conversations(rows: Iterable[tuple]) -> Iterator[tuple]:
    """Results of (key, turn, role, text, fault) rows that come conversation by conversation;
    a row without a fault number only names its conversation."""
    current = None
    for key, turn, role, text, fault in rows:
        if current is None or key != current.key:
            if current is not None:
                yield current.result()
            current = _Conversation(key)
        if fault is not None:
            current.row(turn, role, text, fault)
    if current is not None:
        yield current.result()


SPACE = r"\x20\x09-\x0D"
_ORDER = ("_turn", "_role", "_text", "_copy")


def faults(rows: DataFrame, keys: Sequence[str] = ("_key",)) -> DataFrame:
    """``_fault`` of each row: the first of blank, duplicate and truncated that it has.

    ``rows`` are spread by ``keys``; numbering equal rows needs no further shuffle."""
    equal = Window.partitionBy(*keys, "_here", "_role", "_text").orderBy("_turn", "_copy")
    last = F.regexp_extract("_text", f"([^{SPACE}])[{SPACE}]*\\z", 1)
    fault = (
        F.when(~F.col("_text").rlike(f"[^{SPACE}]"), BLANK)
        .when(F.row_number().over(equal) > 1, DUPLICATE)
        .when(~last.isin(".", "!", "?"), TRUNCATED)
        .otherwise(OK)
    )
    return rows.withColumn("_fault", F.when(F.col("_here"), fault))


def ordered(df: DataFrame, key: str, turn: str, role: str, text: str, here: Column, copies: Column) -> DataFrame:
    """Each conversation's rows in one task and in order, with their faults.

    Order: turn (null first), then role and text, so that it never depends on the table's."""
    named = df.select(
        F.col(f"`{key}`").alias("_key"),
        F.col(f"`{turn}`").cast("long").alias("_turn"),
        F.coalesce(F.col(f"`{role}`").cast("string"), F.lit(" ")).alias("_role"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(" ")).alias("_text"),
        here.alias("_here"),
        F.explode(F.sequence(F.lit(1), copies)).alias("_copy"),
    )
    marked = faults(named.repartition("_key"))
    return marked.sortWithinPartitions("_key", *_ORDER).select("_key", "_turn", "_role", "_text", "_fault")


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def audits(
    df: DataFrame,
    key: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    *,
    here: Column | None = None,
    copies: Column | None = None,
) -> DataFrame:
    """One row for each conversation: what is wrong with it and its cheapest repair.

    ``gaps`` are turn numbers missing between the least and the greatest; ``blank``, ``duplicate``
    and ``truncated`` count rows by their first fault; ``illegal`` counts neighbours whose roles
    may not follow each other. ``audit`` has a letter for each edit in order: K(eep), R(erole),
    D(elete), I(nsert); ``repaired_sha256`` is the digest of the repaired turns.

    Rows where ``here`` is false are not there but name their conversation; ``copies`` repeats a
    row in its place. A null role or text is one space, so the row is blank; a null key is a
    conversation of its own; rows of one turn come in order of role and text, equal rows next to
    each other. No rows: zeros, an empty audit, the digest of nothing. An empty table gives no row.
    """
    there = F.lit(True) if here is None else here
    rows = ordered(df, key, turn, role, text, there, F.lit(1) if copies is None else copies)

    return _streamed(rows, conversations, df.schema[key].dataType, RESULT).withColumnRenamed("_key", key)


def _streamed(rows: DataFrame, work: Callable[[Iterator[tuple]], Iterator[tuple]], key: T.DataType, fields: str) -> DataFrame:
    """What ``work`` makes of a partition's rows, one after the other; both begin with the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        kinds = [pa.string() if field.endswith(" string") else pa.int64() for field in fields.split(", ")]
        schema = pa.schema([("_key", first.schema.field(0).type), *zip([f.split()[0] for f in fields.split(", ")], kinds)])
        made = work(row for batch in chain([first], batches) for row in zip(*[c.to_pylist() for c in batch.columns]))
        while part := list(islice(made, 1_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)

    return rows.mapInArrow(run, f"_key {key.simpleString()}, {fields}")


def repaired(
    df: DataFrame,
    key: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    *,
    here: Column | None = None,
    copies: Column | None = None,
) -> DataFrame:
    """The turns of all repaired conversations: key, place (from 0), edit, turn, role, text.

    Inserted turns have a null ``turn`` and empty text. The audits are walked along the rows once
    more, so a conversation passes through in order and is never gathered.
    """
    there, times = F.lit(True) if here is None else here, F.lit(1) if copies is None else copies
    found = audits(df, key, turn, role, text, here=there, copies=times)
    named = df.select(
        F.col(f"`{key}`").alias("_key"),
        F.lit(1).alias("_kind"),
        F.col(f"`{turn}`").cast("long").alias("_turn"),
        F.coalesce(F.col(f"`{role}`").cast("string"), F.lit(" ")).alias("_role"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(" ")).alias("_text"),
        F.explode(F.when(there, F.sequence(F.lit(1), times))).alias("_copy"),
    )
    heads = found.select(
        F.col(f"`{key}`").alias("_key"),
        F.lit(0).alias("_kind"),
        F.lit(None).cast("long").alias("_turn"),
        F.lit("").alias("_role"),
        F.col("audit").alias("_text"),
        F.lit(0).alias("_copy"),
    )
    rows = heads.union(named).repartition("_key").sortWithinPartitions("_key", "_kind", *_ORDER)

    fields = "place long, edit string, turn long, role string, text string"
    return _streamed(rows, _replayed, df.schema[key].dataType, fields).withColumnRenamed("_key", key)


def _replayed(rows: Iterable[tuple]) -> Iterator[tuple]:
    """Turns that audits give, each audit coming before the rows of its conversation."""
    walk = None
    for key, kind, turn, role, text, _ in rows:
        if kind == 0:
            if walk is not None:
                yield from walk.rest()
            walk = _Walk(key, text)
        else:
            yield from walk.row(turn, role, text)
    if walk is not None:
        yield from walk.rest()


class _Walk:
    def __init__(self, key, audit: str):
        self.key, self.audit, self.at = key, audit, 0
        self.state, self.place = NOTHING, 0

    def _turn(self, edit: str, turn: int | None, role: str, text: str) -> tuple:
        self.place += 1
        return (self.key, self.place - 1, edit, turn, role, text)

    def rest(self) -> Iterator[tuple]:
        """Insertions from here on."""
        while self.at < len(self.audit) and self.audit[self.at] == INSERT:
            yield self._turn(INSERT, None, _added_role(self.state), "")
            self.state, self.at = ADDED[self.state], self.at + 1

    def row(self, turn: int | None, role: str, text: str) -> Iterator[tuple]:
        yield from self.rest()
        edit = self.audit[self.at]
        self.at += 1
        if edit == KEEP:
            self.state = NEXT[self.state][role[:1]]
            yield self._turn(KEEP, turn, role, text)
        elif edit == REROLE:
            yield self._turn(REROLE, turn, _added_role(self.state), text)
            self.state = ADDED[self.state]


def damage(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows as a careless export may leave them, by checksum of key and turn modulo 20: 0 loses
    a row, 1 its text, 2 its ends of sentences, 3 gives it twice, 4 makes it the user's.

    Adds ``here`` and ``copies``; nulls in what is summed are one space."""
    told = F.concat_ws(":", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")) for c in (key, turn)])
    harm = F.crc32(told.cast("binary")) % 20
    words = F.coalesce(F.col(f"`{text}`"), F.lit(" "))
    changed = F.when(harm == 1, F.lit("")).when(harm == 2, F.regexp_replace(words, "[.!?]", "")).otherwise(words)
    return rows.select(
        F.col(f"`{key}`").alias(key),
        F.col(f"`{turn}`").alias(turn),
        F.when(harm == 4, F.lit("user")).otherwise(F.coalesce(F.col(f"`{role}`"), F.lit(" "))).alias(role),
        changed.alias(text),
        (harm != 0).alias("here"),
        F.when(harm == 3, 2).otherwise(1).alias("copies"),
    )
