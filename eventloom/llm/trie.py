"""Prefix trie of conversations, its subtree sums rolled up by centroid decomposition."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.prefixes import ordered_turns, prefix_paths, wholes
from eventloom.session import stage_once

#: Components of up to so many nodes are decomposed inside one task; larger ones are split by joins first.
LOCAL_NODES = 256
#: Conversation ids written out per piece of a list.
PIECE = 4096
#: Rows gathered before small components are decomposed together.
BLOCK = 1 << 16


class Trie(NamedTuple):
    """``nodes``: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens); ``ends``: (conv_id, depth, member)."""

    nodes: DataFrame
    ends: DataFrame


def with_shared_starts(turns: DataFrame, group: int = 5, starts: int = 9) -> tuple[DataFrame, DataFrame]:
    """(turns, convs): every conversation with its first h turns taken from the first of its group (c - c % group).

    h is crc32 of the decimal id, modulo ``starts``; fewer turns give all, an absent conversation none. Own turns after
    the first h follow. ``turns`` has (conv_id, position, ...), the result (conv_id, depth, ...).
    """
    own = turns.groupBy("conv_id").agg(F.max("position").alias("n"))
    convs = own.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), (F.crc32(F.col("conv_id").cast("string")) % starts).alias("h"))
    lengths = own.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = stage_once(convs.join(lengths, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0).cast("bigint")))), "convs")
    rest = [c for c in turns.columns if c not in ("conv_id", "position")]
    mine = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").filter("position > h").select(
        "conv_id", (F.col("position") - F.col("h") + F.col("taken")).alias("depth"), *rest,
    )
    first = turns.filter(F.col("position") < starts).withColumnRenamed("conv_id", "base").join(convs.select("conv_id", "base", "h"), "base")
    first = first.filter("position <= h").select("conv_id", F.col("position").alias("depth"), *rest)
    return stage_once(mine.unionByName(first), "rebuilt"), convs.select("conv_id")


def rollup_block(comp: np.ndarray, parent: np.ndarray, size: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Subtree sums of ``values`` within each component of a forest, by centroid decomposition.

    Rows of a component follow one another, its top first; ``parent`` is a row or -1, ``size`` the number of nodes
    below and at a node within its component. All components are split side by side: their centroids (the lowest node
    with at least half of the nodes below it) get the total of what lies below and hand it to every node on the way to
    their top; then the centroid goes and its children and the rest above are components of their own.
    """
    n = len(comp)
    at = np.arange(n)
    new = np.ones(n, bool)
    new[1:] = comp[1:] != comp[:-1]
    label = np.maximum.accumulate(np.where(new, at, 0))  # a component is named by the row of its top
    size, sums, live = size.astype(np.int64), np.zeros_like(values), at
    while len(live):
        half = live[size[live] * 2 >= size[label[live]]]
        half = half[np.lexsort((size[half], label[half]))]
        lead = np.ones(len(half), bool)
        lead[1:] = label[half[1:]] != label[half[:-1]]
        g = half[lead]
        is_g = np.zeros(n, bool)
        is_g[g] = True
        g_of = np.full(n, -1)
        g_of[label[g]] = g
        # Up to the component's top or a child of its centroid, doubling the steps.
        p = parent[live]
        up = at.copy()
        up[live] = np.where((p >= 0) & (label[p] == label[live]) & ~is_g[p], p, live)
        while True:
            further = up[up]
            if (further[live] == up[live]).all():
                break
            up = further
        above = parent[up[live]]
        below = (above >= 0) & is_g[above] & (label[above] == label[live])
        gain = np.zeros_like(values)
        inside = below | is_g[live]
        np.add.at(gain, g_of[label[live[inside]]], values[live[inside]])
        taken = size[g].copy()
        here, of = g, np.arange(len(g))
        while len(here):
            sums[here] += gain[g[of]]
            p = parent[here]
            on = (p >= 0) & (label[p] == label[here])
            here, of = p[on], of[on]
            size[here] -= taken[of]
        label[live[below]] = up[live[below]]
        label[g] = -1
        live = live[~is_g[live]]
    return sums


_NODE = ["conv_id", "depth", "parent_conv_id", "top_conv", "top_depth", "size", "leaf", "saved", "n_leaves", "saved_tokens"]


def _parents(conv: np.ndarray, depth: np.ndarray, parent_conv: np.ndarray, comp: np.ndarray) -> np.ndarray:
    """Row of each node's parent where it is in the same component, else -1."""
    convs, rank = np.unique(conv, return_inverse=True)
    width = int(depth.max()) + 2
    key = rank * width + depth
    order = np.argsort(key)
    there = np.minimum(np.searchsorted(convs, parent_conv), len(convs) - 1)
    wanted = there * width + depth - 1
    found = order[np.minimum(np.searchsorted(key[order], wanted), len(key) - 1)]
    ok = (convs[there] == parent_conv) & (key[found] == wanted) & (depth > 0) & (comp[found] == comp)
    return np.where(ok, found, -1)


def _roll_small(nodes: DataFrame) -> DataFrame:
    """Decompose components of at most LOCAL_NODES nodes; a task streams over many, some blocks of rows at a time."""
    out = "conv_id BIGINT, depth BIGINT, n_leaves BIGINT, saved_tokens BIGINT"

    def block(table: pa.Table) -> pa.RecordBatch:
        c = {name: table.column(name).combine_chunks().fill_null(-1).to_numpy(zero_copy_only=False) for name in _NODE}
        flips = np.ones(len(c["depth"]), bool)
        flips[1:] = (c["top_conv"][1:] != c["top_conv"][:-1]) | (c["top_depth"][1:] != c["top_depth"][:-1])
        comp = np.cumsum(flips)
        parent = _parents(c["conv_id"], c["depth"], c["parent_conv_id"], comp)
        sums = rollup_block(comp, parent, c["size"], np.stack([c["leaf"], c["saved"]], axis=1))
        return pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (c["conv_id"], c["depth"], c["n_leaves"] + sums[:, 0], c["saved_tokens"] + sums[:, 1])],
            names=["conv_id", "depth", "n_leaves", "saved_tokens"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            fresh = pa.Table.from_batches([batch])
            held = fresh if held is None else pa.concat_tables([held, fresh])
            if held.num_rows < BLOCK:
                continue
            conv, depth = (held.column(k).to_numpy() for k in ("top_conv", "top_depth"))
            inner = np.flatnonzero((conv == conv[-1]) & (depth == depth[-1]))[0]  # the last component may go on
            if inner:
                yield block(held.slice(0, inner))
                held = held.slice(inner)
        if held is not None and held.num_rows:
            yield block(held)

    keys = ["top_conv", "top_depth"]
    return nodes.select(*_NODE).repartition(*keys).sortWithinPartitions(*keys, "depth").mapInArrow(run, out)


def _split(active: DataFrame, large: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One level for the components in ``large``: (centroids with their sums done, the other nodes in their new components)."""
    top = ["top_conv", "top_depth"]
    active = active.join(large, top)
    half = active.filter(F.col("size") * 2 >= F.col("total"))  # a path from the top, so sizes differ
    centroids = stage_once(half.groupBy(*top).agg(
        F.min_by("conv_id", "size").alias("g_conv"), F.min_by("depth", "size").alias("g_depth"), F.min("size").alias("g_size"),
    ), "centroids")
    active = active.drop("total")
    # The path of a node's owner names the node one step below the centroid, and thereby whether the centroid is above.
    step = paths.select(F.col("conv_id"), F.col("depth").alias("step_depth"), F.col("owner").alias("child_conv"), F.col("parent_owner").alias("via_conv"))
    placed = active.join(centroids, top).withColumn("step_depth", F.col("g_depth") + 1).join(step, ["conv_id", "step_depth"], "left")
    is_g = (F.col("conv_id") == F.col("g_conv")) & (F.col("depth") == F.col("g_depth"))
    below = F.coalesce((F.col("depth") > F.col("g_depth")) & (F.col("via_conv") == F.col("g_conv")), F.lit(False))
    placed = stage_once(placed.withColumns({"is_g": is_g, "below": below}).drop("via_conv", "step_depth"), "placed")
    totals = placed.filter("below OR is_g").groupBy(*top, "g_conv", "g_depth", "g_size").agg(F.sum("leaf").alias("add_leaves"), F.sum("saved").alias("add_saved"))
    way = paths.select(F.col("conv_id").alias("g_conv"), F.col("depth").alias("way_depth"), F.col("owner").alias("way_conv"))
    way = totals.join(way, "g_conv").filter("way_depth >= top_depth AND way_depth <= g_depth").select(
        F.col("way_conv").alias("conv_id"), F.col("way_depth").alias("depth"), F.col("g_size").alias("taken"), "add_leaves", "add_saved",
    )
    zero = F.lit(0).cast("bigint")
    got = lambda c: F.coalesce(c, zero)
    moved = placed.drop("g_size").join(way, ["conv_id", "depth"], "left").select(
        "conv_id", "depth", "parent_conv_id", F.when(F.col("below"), F.col("child_conv")).otherwise(F.col("top_conv")).alias("top_conv"),
        F.when(F.col("below"), F.col("g_depth") + 1).otherwise(F.col("top_depth")).alias("top_depth"),
        (F.col("size") - got("taken")).alias("size"), "leaf", "saved",
        (F.col("n_leaves") + got("add_leaves")).alias("n_leaves"), (F.col("saved_tokens") + got("add_saved")).alias("saved_tokens"), "is_g",
    )
    moved = stage_once(moved, "split")
    return moved.filter("is_g").select("conv_id", "depth", "n_leaves", "saved_tokens"), moved.filter("NOT is_g").drop("is_g")


def centroid_rollup(nodes: DataFrame, paths: DataFrame, root: int, local: int = LOCAL_NODES) -> DataFrame:
    """(conv_id, depth, n_leaves, saved_tokens): sums of ``leaf`` and ``saved`` over the subtree of every node.

    ``nodes`` has (conv_id, depth, parent_conv_id, size, leaf, saved) and one tree whose top is (root, 0). Components are
    halved level by level: by joins while they hold more than ``local`` nodes (a logarithm of levels, over all large
    components at once), then within tasks that get whole small components.
    """
    zero = F.lit(0).cast("bigint")
    active = stage_once(nodes.select(
        "conv_id", "depth", "parent_conv_id", F.lit(root).cast("bigint").alias("top_conv"), zero.alias("top_depth"), "size", "leaf", "saved", zero.alias("n_leaves"), zero.alias("saved_tokens"),
    ), "whole")
    done, small, top = [], [], ["top_conv", "top_depth"]
    while True:
        large = stage_once(active.groupBy(*top).agg(F.max("size").alias("total")).filter(F.col("total") > local), "large")
        small.append(active.join(large, top, "left_anti"))
        if large.isEmpty():
            break
        centroids, active = _split(active, large, paths)
        done.append(centroids)
    rest = small[0]
    for more in small[1:]:
        rest = rest.unionByName(more)
    out = _roll_small(rest)
    for more in done:
        out = out.unionByName(more)
    return out


def conversation_trie(turns: DataFrame, convs: DataFrame, local: int = LOCAL_NODES) -> Trie:
    """Trie of all prefixes of conversations, each node named by its least member and its depth.

    ``turns`` holds (conv_id, depth from 1 without holes, a, b, weight): two 64-bit hashes of a turn's content and its
    tokens; ``convs`` all conversations, also those without turns (members of the root). Per node: the members, children
    and, over its subtree, the childless nodes and (members - 1) * weight. ``ends`` lists the conversations that end at a
    node. No conversation gives no node. Equal conversations are joined first, so copies cost one row each.
    """
    spark = turns.sparkSession
    every, distinct = wholes(turns, convs)
    least, members = every.agg(F.min("conv_id"), F.count("*")).first()
    if least is None:
        return Trie(
            spark.createDataFrame([], "conv_id BIGINT, depth BIGINT, parent_conv_id BIGINT, n_convs BIGINT, n_children BIGINT, n_leaves BIGINT, saved_tokens BIGINT"),
            spark.createDataFrame([], "conv_id BIGINT, depth BIGINT, member BIGINT"),
        )
    paths = prefix_paths(turns, distinct, least, ["weight"])
    zero, root = F.lit(0).cast("bigint"), F.lit(least).cast("bigint")
    start = spark.range(1).select(
        root.alias("conv_id"), zero.alias("depth"), F.lit(None).cast("bigint").alias("parent_conv_id"), F.lit(members).cast("bigint").alias("n_convs"), zero.alias("weight"),
    )
    plain = paths.filter("conv_id = owner")
    nodes = plain.select("conv_id", "depth", F.col("parent_owner").alias("parent_conv_id"), "n_convs", "weight").unionByName(start)
    children = nodes.filter("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    # Nodes below and at a node: what each of its members owns from there on.
    owned = plain.groupBy("conv_id").agg((F.min("depth") - 1).alias("from"), F.max("depth").alias("to"))
    sizes = paths.join(owned, "conv_id").groupBy(F.col("owner").alias("conv_id"), "depth").agg(F.sum(F.col("to") - F.greatest("from", F.col("depth") - 1)).alias("size"))
    whole = owned.agg(F.sum(F.col("to") - F.col("from"))).first()[0] or 0
    nodes = nodes.join(children, ["conv_id", "depth"], "left").join(sizes, ["conv_id", "depth"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"),
        F.when(F.col("depth") == 0, F.lit(whole + 1)).otherwise(F.col("size")).cast("bigint").alias("size"),
        F.col("n_children").isNull().cast("bigint").alias("leaf"), ((F.col("n_convs") - 1) * F.col("weight")).alias("saved"),
    )
    nodes = stage_once(nodes, "nodes")
    ways = paths.select("conv_id", "depth", "owner", "parent_owner").unionByName(
        distinct.select(F.col("rep").alias("conv_id"), zero.alias("depth"), root.alias("owner"), F.lit(None).cast("bigint").alias("parent_owner")),
    )
    rolled = centroid_rollup(nodes, stage_once(ways, "ways"), least, local)
    out = nodes.drop("size", "leaf", "saved").join(rolled, ["conv_id", "depth"])
    last = distinct.join(paths.select(F.col("conv_id").alias("rep"), F.col("depth").alias("length"), "owner"), ["rep", "length"], "left")
    last = last.select("length", "x", "y", F.coalesce("owner", root).alias("owner"))
    ends = every.join(last, ["length", "x", "y"]).select(F.col("owner").alias("conv_id"), F.col("length").alias("depth"), F.col("conv_id").alias("member"))
    return Trie(out, ends)


def list_digests(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256): SHA-256 of each node's ``member`` ids, ascending, in decimal, comma-joined.

    SHA-256 reads a list in order, so one task has to; it gets pieces of up to PIECE ids already sorted and written out
    by all tasks, and streams over them.
    """
    node = ["conv_id", "depth"]

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            conv, depth, member = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("conv_id", "depth", "member"))
            if not len(conv):
                continue
            cut = np.flatnonzero((conv[1:] != conv[:-1]) | (depth[1:] != depth[:-1])) + 1
            edges = [0, *cut.tolist(), len(conv)]
            starts = [s for lo, hi in zip(edges, edges[1:]) for s in range(lo, hi, PIECE)]
            stops = [*starts[1:], len(conv)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(conv[starts]), pa.array(depth[starts]), pa.array(member[starts]), pa.array([",".join(map(str, member[lo:hi].tolist())) for lo, hi in zip(starts, stops)], pa.string())],
                names=["conv_id", "depth", "first", "ids"],
            )

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, at, digest = ["conv_id", "depth", "ends_sha256"], None, None
        for batch in batches:
            out = []
            for conv, depth, ids in zip(batch.column("conv_id").to_pylist(), batch.column("depth").to_pylist(), batch.column("ids")):
                if at == (conv, depth):
                    digest.update(b",")
                else:
                    if at is not None:
                        out.append((*at, digest.hexdigest()))
                    at, digest = (conv, depth), hashlib.sha256()
                digest.update(ids.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else ([], [], []), (pa.int64(), pa.int64(), pa.string()))], names=names)
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at[0]]), pa.array([at[1]]), pa.array([digest.hexdigest()])], names=names)

    pieces = ends.repartitionByRange(*node, "member").sortWithinPartitions(*node, "member").select(*node, "member").mapInArrow(
        written, "conv_id BIGINT, depth BIGINT, first BIGINT, ids STRING",
    )
    return pieces.repartition(*node).sortWithinPartitions(*node, "first").select(*node, "ids").mapInArrow(digested, "conv_id BIGINT, depth BIGINT, ends_sha256 STRING")


def trie_of_conversations(conversations: DataFrame) -> Trie:
    """Trie of conversations rebuilt with shared starts; a turn weighs its text's UTF-8 bytes. Rows without conv_id belong to none."""
    named = conversations.filter("conv_id IS NOT NULL")
    turns = ordered_turns(named, {"weight": F.octet_length("text").cast("bigint")})
    return conversation_trie(*with_shared_starts(turns))
