"""Conversations as paths of a prefix forest, each prefix named by its least member and its depth."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.operators.scans import running
from eventloom.session import stage_once


def content_hashes() -> list[Column]:
    """Two 64-bit hashes, ``a`` and ``b``, of the non-null columns ``role`` and ``text``."""
    return [F.xxhash64(F.lit(1), "role", "text").alias("a"), F.xxhash64(F.lit(2), "text", "role").alias("b")]


def ordered_turns(conversations: DataFrame, carry: Mapping[str, Column]) -> DataFrame:
    """(conv_id, position from 1, a, b, carry...): turns in order, and two 64-bit hashes of role and text.

    A null role or text is empty. Rows are ordered by turn, null first; turns of equal number follow role, then the hash
    of the text, the same in every run; equal rows are turns of their own. ``carry`` may use ``role`` and ``text``.
    Only hashes are sorted and moved, not texts, and a conversation of any length is numbered by many tasks.
    """
    plain = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    hashed = plain.select(
        "conv_id", F.col("turn").alias("_turn"), F.col("role").alias("_role"), F.lit(1).cast("bigint").alias("_one"),
        *content_hashes(), *[c.alias(n) for n, c in carry.items()],
    )
    return running(hashed, ["conv_id"], ["_turn", "_role", "a", "b"], ["conv_id", "a", "b", *carry], {"position": "_one"})


def wholes(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every conversation as (conv_id, length, x, y), and of each distinct one (length, x, y, rep, n): least id and copies.

    ``turns`` holds (conv_id, depth from 1, a, b), ``convs`` all conv_ids, also those without turns. Conversations are
    equal if their lengths and the two XOR sums of 64-bit hashes of (turn, depth) are: 128 bits, not compared further.
    """
    digests = turns.groupBy("conv_id").agg(
        F.count("*").alias("length"), F.bit_xor(F.xxhash64("a", "depth")).alias("x"), F.bit_xor(F.xxhash64("b", "depth", F.lit(2))).alias("y"),
    )
    none = F.lit(0).cast("bigint")
    every = convs.join(digests, "conv_id", "left").select("conv_id", *[F.coalesce(c, none).alias(c) for c in ("length", "x", "y")])
    every = stage_once(every, "wholes")
    return every, stage_once(every.groupBy("length", "x", "y").agg(F.min("conv_id").alias("rep"), F.count("*").alias("n")), "distinct")


def prefix_paths(turns: DataFrame, distinct: DataFrame, root: int, carry: list[str], sums: Mapping[str, str] | None = None) -> DataFrame:
    """One row per turn of each distinct conversation: (conv_id, depth, owner, parent_owner, n_convs, carry..., sums...).

    The prefix that ends with the turn is the node (owner, depth); ``owner`` is the least conversation that starts with it,
    copies included, ``parent_owner`` that of the prefix before (``root`` for none), ``n_convs`` how many do. Each
    conversation owns the end of its path from some depth on, perhaps none of it. ``sums`` adds up columns along the path.
    Copies are joined before; a prefix that most conversations share is counted by partial sums.
    """
    kept = turns.join(distinct.filter("length > 0").select(F.col("rep").alias("conv_id"), "n"), "conv_id").select(
        "conv_id", "depth", "n", F.xxhash64("a", "depth").alias("_x"), F.xxhash64("b", "depth", F.lit(2)).alias("_y"), *carry,
    )
    sums = dict(sums or {})
    walked = running(kept, ["conv_id"], ["depth"], ["conv_id", "depth", "n", *carry], sums, {"x": "_x", "y": "_y"})
    # Written first, so that the join below can split a prefix that most conversations share.
    nodes = stage_once(walked.groupBy("depth", "x", "y").agg(F.min("conv_id").alias("owner"), F.sum("n").alias("n_convs")), "prefixes")
    named = stage_once(walked.join(nodes, ["depth", "x", "y"]).select("conv_id", "depth", "owner", "n_convs", *carry, *sums), "named")
    above = named.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("owner").alias("parent_owner"))
    out = named.join(above, ["conv_id", "depth"], "left").select(
        "conv_id", "depth", "owner", F.coalesce("parent_owner", F.lit(root).cast("bigint")).alias("parent_owner"), "n_convs", *carry, *sums,
    )
    return stage_once(out, "paths")
