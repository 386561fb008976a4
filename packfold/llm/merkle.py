"""Merkle manifest of a table by bitmap ranks, in native expressions.

Every row is a leaf; the leaves of a group (a language, say) ascend by id, and eight neighbours at
a time are hashed until one digest is left; those of the groups, in their order, are reduced the
same way to one root. A leaf's place is found without sorting leaves: the ids of a group form a
bitmap of 64-bit words, of which only those that hold ids exist; words merge by OR, and a
directory has the number of rows before each word. A leaf's place is its word's number plus the
ids below its own in the word.

Places are keys: a node belongs to (group, place // 512) and has slot place % 512 in that group's
array, so one shuffle of nodes reduces three levels. On the way down each group of 512 adds
the siblings of its children to the path from above.

Rows that share an id, or have none, are told apart by their leaves: such rows, and only they, are
counted by (group, id, leaf) and placed by running totals. Equal leaves are equal rows and take
places next to each other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packfold.plans.barrier import computed_once
from packfold.plans.ordinals import ordinals
from packfold.plans.skew import lookup_skewed
from packfold.session import materialize

ARITY = 8
# Levels that one grouping reduces, and the nodes it takes together.
LEVELS = 3
SLOTS = ARITY**LEVELS
# Words (2 to this power) of a bitmap whose running count is taken in one window.
WORD_BITS = 10
# Equal leaves that one task lays out.
COPIES = 1 << 16

PATH = "array<struct<left:string,right:string>>"


def leaf(*values: Column) -> Column:
    """Digest of values, each as its byte length and text; nulls are marks of their own."""
    told = []
    for value in values:
        text = value.cast("string")
        told.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*told), 256)


def _group_name(column: Column) -> Column:
    """A group's name that is never null and sorts as the group does, null first."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("-"))


def _levels(nodes: Column) -> Column:
    """How many times so many nodes are reduced: digits of (nodes - 1) in base 8, none for 0."""
    return F.when(nodes <= 1, 0).otherwise(F.length(F.conv((nodes - 1).cast("string"), 10, ARITY)))


def places(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``_place`` of each leaf in its group and ``_depth``, how often the group is reduced; also
    the groups with their numbers of leaves.

    ``leaves`` is a written table with _group, _id and _leaf, and what else is to be carried.
    """
    partitions = _parts(leaves)
    # rows without an id come before all words
    word = F.coalesce(F.shiftright("_id", 6), F.lit(-(1 << 57) - 1))
    bit = F.coalesce(F.col("_id").bitwiseAND(63), F.lit(0)).cast("int")
    at = F.concat_ws("/", F.col("_word").cast("string"), "_group")
    rows = leaves.withColumns({"_word": word, "_bit": bit}).withColumn("_spot", at)

    merged = rows.groupBy("_group", "_word").agg(
        F.expr("bit_or(shiftleft(1L, _bit))").alias("_bits"), F.count(F.lit(1)).alias("_rows")
    )
    words = materialize(merged.withColumn("_part", F.shiftright("_word", WORD_BITS)), "merkle-words")
    parts = words.groupBy("_group", "_part").agg(F.sum("_rows").alias("_held"))
    groups = parts.groupBy("_group").agg(F.sum("_held").alias("_nodes"), F.count(F.lit(1)).alias("_parts"))
    groups = materialize(groups.withColumn("_depth", _levels(F.col("_nodes"))), "merkle-sizes")
    before = ordinals(parts, "_part", group="_group", sums={"_before": F.col("_held")}, partitions=partitions).frame
    before = lookup_skewed(before, groups, "_group", "_parts", _scattered()).drop("ordinal", "_nodes")

    inside = Window.partitionBy("_group", "_part").orderBy("_word").rowsBetween(Window.unboundedPreceding, -1)
    directory = materialize(
        words.join(before, ["_group", "_part"]).select(
            at.alias("_spot"),
            "_bits",
            "_rows",
            "_depth",
            (F.col("_before") + F.coalesce(F.sum("_rows").over(inside), F.lit(0))).alias("_before"),
            # a word that holds an id twice, or rows without ids, cannot tell its rows apart
            (F.col("_rows") > F.bit_count("_bits")).alias("_crowded"),
        ),
        "merkle-directory",
    )
    found = lookup_skewed(rows, directory.hint("shuffle_hash"), "_spot", "_rows", _scattered())
    below = F.bit_count(F.col("_bits").bitwiseAND(F.expr("~shiftleft(-1L, _bit)")))
    kept = [*leaves.columns, "_depth"]
    alone = found.filter(~F.col("_crowded")).select(*kept, (F.col("_before") + below).alias("_place"))
    if directory.filter("_crowded").isEmpty():
        return alone, groups

    counted = found.filter("_crowded").groupBy(*kept, "_spot", "_before").agg(F.count(F.lit(1)).alias("_n"))
    order = [c for c in leaves.columns if c != "_group"]
    # running totals inside each word, by id (none first) and leaf
    told = ordinals(
        counted, order, group=["_group", "_spot"], carry={c: F.col(c) for c in ("_n", "_before", "_depth")},
        sums={"_earlier": F.col("_n")}, partitions=partitions,
    ).frame
    chunk = F.explode(F.expr(f"sequence(0L, _n - 1, {COPIES}L)"))
    chunks = told.select(*kept, "_n", (F.col("_before") + F.col("_earlier")).alias("_base"), chunk.alias("_from"))
    copy = F.explode(F.expr(f"sequence(_from, least(_from + {COPIES - 1}L, _n - 1))"))
    copies = chunks.repartition("_group", "_base", "_from").select(*kept, "_base", copy.alias("_copy"))
    return alone.unionByName(copies.select(*kept, (F.col("_base") + F.col("_copy")).alias("_place"))), groups


def _up(digests: Column) -> Column:
    """Digests of runs of eight."""
    runs = F.sequence(F.lit(0), F.ceil(F.size(digests) / ARITY).cast("int") - 1)
    return F.transform(runs, lambda r: F.sha2(F.array_join(F.slice(digests, r * ARITY + 1, ARITY), ""), 256))


def _arrays(group: DataFrame) -> DataFrame:
    """Slot arrays of the levels of each group: _d0 holds its nodes, _d3 the one that is left."""
    for level in range(LEVELS):
        below = F.col(f"_d{level}")
        group = computed_once(group, **{f"_d{level + 1}": F.when(F.col("_levels") > level, _up(below)).otherwise(below)})
    return group


def _grouped(nodes: DataFrame, carried: Sequence[str]) -> DataFrame:
    """Nodes of _group, _place, _digest and carried columns in arrays by slot, written."""
    slot = F.col("_place").bitwiseAND(SLOTS - 1).alias("slot")
    entry = F.struct(slot, F.col("_digest").alias("digest"), *carried)
    held = nodes.groupBy("_group", F.shiftright("_place", 3 * LEVELS).alias("_at")).agg(
        F.collect_list(entry).alias("_entries"), F.first("_levels").alias("_levels")
    )
    # places have no gaps, so an entry's index in the sorted array is its slot
    arrays = held.withColumn("_entries", F.sort_array("_entries"))
    return materialize(arrays, "merkle-groups")


def _siblings(level: int, slot: Column) -> Column:
    """The other nodes of the run, at one level, that the node at ``slot`` is in: those left of
    it and those right of it."""
    at = F.shiftright(slot, 3 * level).cast("int")
    digests, begin = F.col(f"_d{level}"), F.shiftright(at, 3) * ARITY
    return F.struct(
        F.array_join(F.slice(digests, begin + 1, at - begin), "").alias("left"),
        F.array_join(F.slice(digests, at + 2, begin + ARITY - 1 - at), "").alias("right"),
    )


def _path(slot: Column) -> Column:
    """Siblings at the levels that the group reduces."""
    return F.slice(F.array(*[_siblings(level, slot) for level in range(LEVELS)]), 1, F.col("_levels"))


class Tree:
    """Nodes of several groups, reduced to one digest a group; ``rounds`` keeps each grouping.

    ``nodes`` has _group, _place, _digest, _depth (times the group is to be reduced) and what
    ``carried`` names.
    """

    def __init__(self, nodes: DataFrame, deepest: int, carried: Sequence[str]):
        self.rounds: list[DataFrame] = []
        self.carried = carried
        while not self.rounds or deepest > 0:
            levels = F.greatest(F.lit(0), F.least(F.lit(LEVELS), F.col("_depth") - LEVELS * len(self.rounds)))
            held = _grouped(nodes.withColumn("_levels", levels), [*(carried if not self.rounds else []), "_depth"])
            self.rounds.append(held)
            tops = _arrays(held.withColumn("_d0", F.transform("_entries", lambda e: e["digest"])))
            nodes = tops.select(
                "_group",
                F.col("_at").alias("_place"),
                F.element_at(f"_d{LEVELS}", 1).alias("_digest"),
                F.element_at("_entries", 1)["_depth"].alias("_depth"),
            )
            deepest -= LEVELS
        self.tops = materialize(nodes.select("_group", "_digest"), "merkle-tops")

    def descend(self, above: DataFrame, passed: Sequence[str], entry) -> DataFrame:
        """Paths from the groups' last digests down to the first nodes.

        ``above`` has _group, _path (what follows on from the group's digest) and ``passed``.
        ``entry(node, path)`` is the struct of what comes out for each first node, beside passed.
        """
        down = above.withColumn("_at", F.lit(0).cast("long"))
        for number in reversed(range(len(self.rounds))):
            held = self.rounds[number].join(down.hint("shuffle_hash"), ["_group", "_at"])
            levels = _arrays(held.withColumn("_d0", F.transform("_entries", lambda e: e["digest"])))

            nodes = F.transform(
                "_entries", lambda e: F.struct(e.alias("node"), F.concat(_path(e["slot"]), F.col("_path")).alias("path"))
            )
            if number:
                made = F.transform(nodes, lambda n: F.struct((F.col("_at") * SLOTS + n["node"]["slot"]).alias("_at"), n["path"].alias("_path")))
            else:
                made = F.transform(nodes, lambda n: entry(n["node"], n["path"]))
            down = levels.select("_group", *passed, F.inline(made))
        return down


def folded(digest: Column, path: Column) -> Column:
    """The root that a digest and its siblings give."""
    return F.aggregate(path, digest, lambda d, p: F.sha2(F.concat(p["left"], d, p["right"]), 256))


def proof(path: Column) -> Column:
    """Digest of all siblings, level by level and left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), ""), 256)


def manifest(df: DataFrame, key: str, group: str, made: Column, claimed: Column | None = None, *, paths: bool = False) -> DataFrame:
    """One row for each row: key, leaf, subroot of its group, root, proof_sha256, folded_root, verified.

    ``made`` is the digest of a row, ``claimed`` that of the row as someone hands it over (null: as
    it is); the claim and the siblings of the leaf are folded to a root, and the claim is verified if that is
    the manifest's. With ``paths`` the siblings are given too, one entry (left, right) a level.

    A null key comes before all others and a null group is a group before all others. Rows with
    one key, or none, come in order of their leaves and then claims; equal rows take places next
    to each other. A table of one row has its leaf as its root and no siblings; an empty one has
    no row. Texts are only hashed, whole, however long.
    """
    handed = F.lit(None).cast("string") if claimed is None else claimed
    named = _group_name(F.col(f"`{group}`")).alias("_group")
    rows = df.select(named, F.col(f"`{key}`").cast("long").alias("_id"), made.alias("_leaf"), handed.alias("_claim"))
    leaves = materialize(rows, "merkle-leaves")
    placed, groups = places(leaves)
    deepest, count = groups.agg(F.max("_depth"), F.count(F.lit(1))).first()
    tree = Tree(placed.withColumnRenamed("_leaf", "_digest"), deepest or 0, ["_id", "_claim"])

    # the groups' digests are the nodes of one more tree
    numbered = ordinals(tree.tops, "_group", carry={"_digest": F.col("_digest")}, partitions=_parts(df), name="_place").frame
    upper = len(f"{count - 1:o}") if count > 1 else 0
    crowns = numbered.select(
        F.lit("").alias("_group"), "_place", "_digest", F.lit(upper).alias("_depth"), F.col("_group").alias("_name")
    )
    crown = Tree(crowns, upper, ["_name"])
    top = crown.tops.select("_group", F.col("_digest").alias("_root"), F.array().cast(PATH).alias("_path"))
    named = crown.descend(
        top, ["_root"], lambda e, path: F.struct(e["_name"].alias("_name"), e["digest"].alias("_subroot"), path.alias("_path"))
    )
    above = named.select(F.col("_name").alias("_group"), "_root", "_subroot", "_path")

    def told(node: Column, path: Column) -> Column:
        more = [path.alias("path")] if paths else []
        return F.struct(
            node["_id"].alias("_id"), node["digest"].alias("leaf"), proof(path).alias("proof_sha256"),
            folded(F.coalesce(node["_claim"], node["digest"]), path).alias("folded_root"), *more,
        )

    out = tree.descend(above, ["_subroot", "_root"], told)
    return out.select(
        F.col("_id").alias(key),
        "leaf",
        F.col("_subroot").alias("subroot"),
        F.col("_root").alias("root"),
        "proof_sha256",
        "folded_root",
        (F.col("folded_root") == F.col("_root")).alias("verified"),
        *(["path"] if paths else []),
    )


def _scattered() -> Column:
    """A key of its own for each row of a written table; no other key begins like it."""
    return F.concat(F.lit("~"), F.monotonically_increasing_id().cast("string"))


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
