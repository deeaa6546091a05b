"""Chat formatting of whole conversations into prefix trees that hold shared turns once."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.prefixes import content_hashes, ordered_turns, prefix_paths, wholes
from eventloom.operators.scans import running
from eventloom.session import stage_once

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Stands for a missing conv_id inside the operator; rows with this id and rows without one are one conversation.
NO_ID = -(1 << 63)


class Packed(NamedTuple):
    """A corpus as packed trees; a token is a code point of formatted text, which every offset and position counts.

    ``segments``: (tree, chain, depth, start, length, position, text, loss_start, loss_end, final), one row per distinct prefix.
    The rows of a tree, ordered by ``start``, are its token sequence depth first: each shared turn stands once, right
    before what goes on from it. ``position`` is the position id of its first token, counted along its conversation;
    ``final`` says whether a conversation ends here.
    ``chains``: (chain, tree, start, position, ancestors): a chain is a stretch of segments that one conversation adds;
    its tokens attend to the intervals (chain, start, end) of ``ancestors`` and, causally, to its own chain from ``start``.
    ``ends``: (conv_id, n_turns, chain, depth): the segment that each conversation ends with.
    """

    segments: DataFrame
    chains: DataFrame
    ends: DataFrame


def escaped(text: Column, line: bool = False) -> Column:
    """Text in which no control string can stand: ``\\`` is doubled and ``<|`` written ``<\\|``; a ``line`` also keeps line ends out."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))
    return F.replace(out, F.lit("\n"), F.lit("\\n")) if line else out


def unescaped(text: str, line: bool = False) -> str:
    """The text that ``escaped`` was given."""
    if "\\" not in text:
        return text
    return re.sub(r"\\(.)", lambda m: "\n" if line and m[1] == "n" else m[1], text, flags=re.S)


def _laid_out(paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chains with their place in the depth-first order, and the stretches of earlier chains that each goes on from.

    A chain's place is where its path left each earlier chain: the deepest branch comes first, then the lesser
    conversation. A way has at most one entry per earlier conversation it shares a start with, so at most the square
    root of twice the number of turns; usually a few.
    """
    spans = paths.filter("conv_id = owner").groupBy("conv_id").agg(F.min("position").alias("position"), F.max("so_far").alias("to"))
    turned = paths.filter("depth = 1 OR owner <> parent_owner").select("conv_id", F.struct("depth", "owner", "position").alias("step"))
    ways = turned.groupBy("conv_id").agg(F.sort_array(F.collect_list("step")).alias("way"))
    chains = spans.join(ways, "conv_id").select(
        F.col("conv_id").alias("chain"), F.col("way")[0]["owner"].alias("tree"), "position", "way", (F.col("to") - F.col("position")).alias("chars"),
        F.transform("way", lambda e: F.struct((-e["depth"]).alias("branch"), e["owner"].alias("owner"))).alias("place"),
    )
    laid = running(chains, ["tree"], ["place"], ["tree", "chain", "position", "way", "chars"], {"reached": "chars"})
    laid = stage_once(laid.select("chain", "tree", (F.col("reached") - F.col("chars")).alias("start"), "position", "way"), "chains")
    step = lambda i: F.struct(
        F.get("way", i)["owner"].alias("ancestor"), F.get("way", i)["position"].alias("begins"), F.get("way", i + 1)["position"].alias("leaves"),
    )
    steps = laid.filter(F.size("way") > 1).select("chain", F.explode(F.transform(F.sequence(F.lit(0), F.size("way") - 2), step)).alias("s")).select("chain", "s.*")
    placed = steps.join(laid.select(F.col("chain").alias("ancestor"), F.col("start").alias("at")), "ancestor")
    stretches = placed.select("chain", "ancestor", "begins", F.col("at").alias("start"), (F.col("at") + F.col("leaves") - F.col("begins")).alias("end"))
    return laid.drop("way"), stretches


def pack(conversations: DataFrame) -> Packed:
    """Merge conversations that share initial turns and lay every tree out depth first.

    Turns are ordered by turn (null first), ties by role, then a hash of the text; equal rows are turns of their own; a
    null role or text is empty. Rows without conv_id are one conversation (see NO_ID). Other columns are not read.
    A turn is written ``<|im_start|>role\\ntext<|im_end|>\\n``, role and text escaped reversibly; ``loss_start`` and
    ``loss_end`` enclose the text of an assistant's turn and are null for others. An empty table gives empty tables.

    A tree can hold most of the corpus, so none is ever gathered: chains are put in depth-first order by a sort on
    their branching points, offsets come from running totals over ranges, and each distinct text is moved once, to
    its segments, at the end.
    """
    named = conversations.withColumn("conv_id", F.coalesce(F.col("conv_id").cast("bigint"), F.lit(NO_ID)))
    head = F.concat(F.lit(OPEN), escaped(F.col("role"), line=True), F.lit("\n"))
    chars = (F.length(head) + F.length(escaped(F.col("text"))) + len(CLOSE)).cast("bigint")
    turns = stage_once(ordered_turns(named, {"chars": chars}).withColumnRenamed("position", "depth"), "turns")
    every, distinct = wholes(turns, turns.select("conv_id").distinct())
    least = every.agg(F.min("conv_id")).first()[0]
    paths = prefix_paths(turns, distinct, least or 0, ["a", "b", "chars"], {"so_far": "chars"})
    paths = paths.withColumn("position", F.col("so_far") - F.col("chars"))
    laid, stretches = _laid_out(paths)
    stretches = stage_once(stretches, "stretches")
    intervals = stretches.groupBy("chain").agg(F.sort_array(F.collect_list(F.struct("begins", F.col("ancestor").alias("chain"), "start", "end"))).alias("found"))
    plain = F.transform("found", lambda e: F.struct(e["chain"].alias("chain"), e["start"].alias("start"), e["end"].alias("end")))
    none = F.array().cast("array<struct<chain:bigint,start:bigint,end:bigint>>")
    chains = laid.join(intervals, "chain", "left").select("chain", "tree", "start", "position", F.coalesce(plain, none).alias("ancestors"))

    last = distinct.join(paths.select(F.col("conv_id").alias("rep"), F.col("depth").alias("length"), F.col("owner").alias("chain")), ["rep", "length"])
    last = stage_once(last.select("length", "x", "y", "chain"), "last")
    ends = every.join(last, ["length", "x", "y"]).select("conv_id", F.col("length").alias("n_turns"), "chain", F.col("length").alias("depth"))
    final = last.select("chain", F.col("length").alias("depth"), F.lit(True).alias("_final"))
    own = paths.filter("conv_id = owner").select(F.col("conv_id").alias("chain"), "depth", "a", "b", "chars", "position").join(final, ["chain", "depth"], "left")
    own = own.join(laid.select("chain", "tree", "start", F.col("position").alias("_from")), "chain").select(
        "tree", "chain", "depth", (F.col("start") + F.col("position") - F.col("_from")).alias("start"), F.col("chars").alias("length"), "position", "a", "b",
        F.coalesce("_final", F.lit(False)).alias("final"),
    )
    texts = named.select(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = texts.select(*content_hashes(), F.struct("role", "text").alias("turn")).groupBy("a", "b").agg(F.first("turn").alias("turn"))
    written = own.join(keyed, ["a", "b"]).select(
        "*", F.concat(F.lit(OPEN), escaped(F.col("turn.role"), line=True), F.lit("\n")).alias("head"), escaped(F.col("turn.text")).alias("body"),
    )
    at = F.col("start") + F.length("head")
    spoken = F.col("turn.role") == "assistant"
    segments = written.select(
        "tree", "chain", "depth", "start", "length", "position", F.concat("head", "body", F.lit(CLOSE)).alias("text"),
        F.when(spoken, at).alias("loss_start"), F.when(spoken, at + F.length("body")).alias("loss_end"), "final",
    )
    return Packed(stage_once(segments, "segments"), chains, ends)


def read_back(packed: Packed) -> DataFrame:
    """Digests of the distinct conversations of a packed corpus: (chain, depth, turns_sha256, loss_chars, loss_sha256, formatted_chars).

    The segments of a chain are put behind the segments that its ancestor intervals enclose, parsed by the template's
    marks, unescaped and digested in one stream, which gives every conversation that ends along the chain. A task holds
    one turn at a time.
    """
    stretches = packed.chains.select("chain", F.explode("ancestors").alias("s")).select(F.col("chain").alias("reader"), F.col("s.chain").alias("chain"), "s.start", "s.end")
    stretches = stretches.withColumnsRenamed({"start": "lo", "end": "hi"})
    read = ["position", "start", "text", "loss_start", "loss_end"]
    shared = packed.segments.select("chain", *read).join(stretches, "chain").filter("start >= lo AND start < hi")
    own = packed.segments.select("chain", *read, "depth", "final")
    lines = own.unionByName(shared.select(F.col("reader").alias("chain"), *read, F.lit(0).cast("bigint").alias("depth"), F.lit(False).alias("final")))
    schema = "chain BIGINT, depth BIGINT, turns_sha256 STRING, loss_chars BIGINT, loss_sha256 STRING, formatted_chars BIGINT"
    names = ["chain", "depth", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = turns = loss = None
        spoken = formatted = 0
        for batch in batches:
            out = []
            plain = [batch.column(c).to_pylist() for c in ("chain", "start", "loss_start", "loss_end", "depth", "final")]
            for c, start, lo, hi, depth, final, cell in zip(*plain, batch.column("text")):
                if c != chain:
                    chain, turns, loss, spoken, formatted = c, hashlib.sha256(), hashlib.sha256(), 0, 0
                text = cell.as_py()
                role, _, body = text.removeprefix(OPEN).removesuffix(CLOSE).partition("\n")
                turns.update(f"{unescaped(role, line=True)}\n{unescaped(body)}\n".encode())
                if lo is not None:
                    said = unescaped(text[lo - start:hi - start])
                    loss.update(said.encode())
                    spoken += len(said)
                formatted += len(text)
                if final:
                    out.append((c, depth, turns.copy().hexdigest(), spoken, loss.copy().hexdigest(), formatted))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out) if out else [[]] * 6, kinds)], names=names)

    columns = ["chain", "start", "text", "loss_start", "loss_end", "depth", "final"]
    return lines.repartition("chain").sortWithinPartitions("chain", "position").select(*columns).mapInArrow(run, schema)


def formatted_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of every conversation, read back from its packed form."""
    packed = pack(conversations)
    return packed.ends.join(read_back(packed), ["chain", "depth"]).select(
        F.when(F.col("conv_id") != NO_ID, F.col("conv_id")).alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars",
    )
