"""The node tree: descendants, ancestors, closest ancestor of a type. Levels are joined one at a time, each checked for being empty."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import checkpoint_dir


#: Levels beyond which a tree is taken for one with a cycle.
DEEPEST = 1000


def descendants(nodes: DataFrame, roots: DataFrame, *, most: int = DEEPEST) -> DataFrame:
    """(id, root, depth) of all nodes below the roots (id), themselves at depth 0. nodes: id, parent_id.

    One equi-join a level, each checkpointed so that a level isn't computed again for the next. Nodes deeper than `most` levels, as in a cycle, are an error.
    """
    checkpoint_dir(nodes.sparkSession)
    edges = nodes.select(F.col("id").alias("child"), F.col("parent_id").alias("parent"))
    level = roots.select(F.col("id"), F.col("id").alias("root"), F.lit(0).alias("depth"))
    out = level
    for d in range(1, most + 1):
        level = level.join(edges, F.col("id") == F.col("parent")).select(F.col("child").alias("id"), "root", F.lit(d).alias("depth"))
        level = level.checkpoint()
        if level.isEmpty():
            return out
        out = out.unionByName(level)
    raise ValueError(f"the tree has nodes deeper than {most} levels, or a cycle")


def ancestors(nodes: DataFrame, start: DataFrame, *, most: int = DEEPEST) -> DataFrame:
    """(id, ancestor, depth) of the given nodes (id); themselves at depth 0. More than `most` levels, as in a cycle, are an error."""
    checkpoint_dir(nodes.sparkSession)
    edges = nodes.select(F.col("id").alias("child"), F.col("parent_id").alias("parent")).where("parent IS NOT NULL")
    level = start.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("depth"))
    out = level
    for d in range(1, most + 1):
        level = level.join(edges, F.col("ancestor") == F.col("child")).select("id", F.col("parent").alias("ancestor"), F.lit(d).alias("depth")).checkpoint()
        if level.isEmpty():
            return out
        out = out.unionByName(level)
    raise ValueError(f"the tree has nodes deeper than {most} levels, or a cycle")


def closest_of_type(nodes: DataFrame, start: DataFrame, typename: int, *, including_self: bool = False) -> DataFrame:
    """(id, closest): the nearest ancestor of a type."""
    up = ancestors(nodes, start).where(F.col("depth") >= (0 if including_self else 1))
    kinds = nodes.select(F.col("id").alias("ancestor"), "typename").where(F.col("typename") == typename)
    return up.join(kinds, "ancestor").groupBy("id").agg(F.min_by("ancestor", "depth").alias("closest"))


def counts_by_tree(nodes: DataFrame, counts: DataFrame) -> DataFrame:
    """(id, total): counts (id, n) of each node and all below it."""
    up = ancestors(nodes, counts.select("id"))
    return up.join(counts, "id").groupBy(F.col("ancestor").alias("id")).agg(F.sum("n").alias("total"))


def shared_trees(links: DataFrame, nodes: DataFrame, *, first_level: bool = False) -> DataFrame:
    """Subtrees that links (folder, node) share: (id, parent_id, depth) with the link's folder as the parent of the shared node."""
    below = descendants(nodes, links.select(F.col("node").alias("id")).distinct())
    below = below.where("depth <= 1") if first_level else below
    own = below.join(nodes.select("id", "parent_id"), "id")
    return own.join(links.select(F.col("node").alias("root"), "folder"), "root").select("id", F.when(F.col("depth") == 0, F.col("folder")).otherwise(F.col("parent_id")).alias("parent_id"), "depth")


def filter_by_name(nodes: DataFrame, part: str) -> DataFrame:
    return nodes.where(F.lower("name").contains(part.lower()))
