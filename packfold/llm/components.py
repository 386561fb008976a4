"""Connected components of an undirected graph, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packfold.session import materialize


def _around(edges: DataFrame) -> DataFrame:
    """For every node of ``edges`` (u, v) with u > v: the least node around it, itself included,
    and whether it is no end of a star: it has two smaller neighbours, or smaller and greater ones."""
    ends = edges.select(F.col("u").alias("node"), "v", F.lit(False).alias("above"))
    ends = ends.union(edges.select(F.col("v").alias("node"), "v", F.lit(True)))
    below = F.when(~F.col("above"), F.col("v"))
    found = ends.groupBy("node").agg(F.min("v").alias("root"), F.min(below).alias("low"), F.max(below).alias("high"), F.max("above").alias("above"))
    return found.select("node", "root", (F.col("low").isNotNull() & ((F.col("low") < F.col("high")) | F.col("above"))).alias("open"))


def _large_star(edges: DataFrame, around: DataFrame) -> DataFrame:
    """The greater neighbours of every node move to the least node around it."""
    return edges.join(around.select(F.col("node").alias("v"), "root"), "v").select("u", F.col("root").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """The smaller neighbours of every node move to the least of them, and it to that one."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    upper = F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v"))
    return edges.join(least, "u").select(upper.alias("u"), F.col("m").alias("v"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): root is the least node of its component.

    Nodes may be of any orderable type; both directions, loops and repeated edges are allowed.
    A node whose only edges are loops is left out. Minima combine before the shuffle; rows of a
    node with many edges are joined to its one minimum, which adaptive execution may split. Each
    step is written to the shared folder; the loop ends when all that is left are stars, which
    the first step of a round tells. Rounds grow with the logarithm of the size. An edge in is
    an edge out of every step, so copies that arise are left and never grow.
    """
    ordered = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = materialize(ordered.filter(F.col("u") != F.col("v")), "edges")
    while True:
        around = materialize(_around(now), "around")
        if around.filter("open").isEmpty():
            return around.select("node", "root")
        now = materialize(_small_star(materialize(_large_star(now, around), "large-star")), "small-star")
