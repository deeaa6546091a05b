"""Connected components of a link table by repeated hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.session import stage_once


def _jump(parents: DataFrame) -> DataFrame:
    """Follow parents to their roots; every step halves the longest way."""
    while True:
        up = parents.select(F.col("node").alias("label"), F.col("label").alias("above"))
        nearer = stage_once(
            parents.join(up, "label", "left").select("node", "label", F.coalesce("above", "label").alias("above")), "jump",
        )
        moved = not nearer.filter("above <> label").isEmpty()
        parents = nearer.select("node", F.col("above").alias("label"))
        if not moved:
            return parents


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (columns ``a``, ``b``); the label is the least node reachable.

    Each round hooks every node to its least neighbour, follows these hooks to their ends and keeps only
    the links between different ends, so a star collapses in one round and the links left shrink fast.
    Tables of a round are written to the shared folder: lost executors never replay earlier rounds, and
    joins on a node with very many links can be split. No links give an empty result.
    """
    edges = stage_once(edges.filter("a <> b").select("a", "b"), "links")
    found = None
    while True:
        ends = edges.select(F.col("a").alias("node"), "b").unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("b")))
        hooks = stage_once(ends.groupBy("node").agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")), "hooks")
        roots = _jump(hooks)
        if found is None:
            found = roots
        else:
            above = roots.select(F.col("node").alias("label"), F.col("label").alias("above"))
            found = stage_once(found.join(above, "label", "left").select("node", F.coalesce("above", "label").alias("label")), "labels")
        to_a = roots.select(F.col("node").alias("a"), F.col("label").alias("root_a"))
        to_b = roots.select(F.col("node").alias("b"), F.col("label").alias("root_b"))
        edges = stage_once(
            edges.join(to_a, "a").join(to_b, "b").filter("root_a <> root_b")
            .select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).distinct(), "links",
        )
        if edges.isEmpty():
            return found
