"""SimHash fingerprints and their groups, found by multi-index hashing."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from eventloom.llm.components import components
from eventloom.llm.words import lower_table
from eventloom.session import stage_once

BITS = 64
SHINGLE = 4
MAX_DISTANCE = 4
SEGMENTS = 3
SEED = 42


def _hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 of every shingle of a lower-cased text, repeats included."""
    words = text.split()
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    starts = np.cumsum(sizes + 1) - sizes - 1
    last = min(shingle, len(words)) - 1
    spans = zip(starts[: len(words) - last].tolist(), (starts + sizes)[last:].tolist())
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], SEED) for s, e in spans], dtype=np.uint64)


def simhash(text: bytes, shingle: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint: a bit is set if it is set in over half of the shingle hashes; 0 without words."""
    text = text.translate(bytes(lower_table()))
    if not text.split(None, 1):
        return 0
    hashes = _hashes(text, shingle)
    votes = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at:at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_key, fp) for every row of ``docs``; a NULL text counts as empty and gets 0."""

    def scan(batches):
        for batch in batches:
            prints = [simhash((text.as_buffer().to_pybytes() if text.is_valid else b""), shingle) for text in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(prints, type=pa.int64())], names=["doc_id", "text_key", "fp"],
            )

    fields = docs.select("doc_id", text_key("text").alias("text_key"), F.col("text").cast("binary").alias("text"))
    schema = T.StructType([fields.schema["doc_id"], T.StructField("text_key", T.LongType()), T.StructField("fp", T.LongType())])
    return fields.mapInArrow(scan, schema)


def text_key(column: str | Column) -> Column:
    """Short stand-in for a text when rows are matched by id; the id decides, the key tells texts of one id apart."""
    text = F.col(column) if isinstance(column, str) else column
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def whole_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, _row_key, _whole): all columns of a row as one struct, so that no name of theirs can clash."""
    return docs.select("doc_id", text_key("text").alias("_row_key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_whole"))


def _balls(width: int, radius: int) -> list[int]:
    return [sum(1 << i for i in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]


def segment_plan(max_distance: int, segments: int) -> list[tuple[int, int, int]]:
    """(lowest bit, width, radius) per segment, so that any two fingerprints within the distance meet.

    With d = m*r + a (0 <= a < m), a+1 segments are searched within r bits and the others within r-1: were
    each of them further apart, the whole would differ in at least d + 1 bits. Radius -1 needs no search.
    """
    r, a = divmod(max_distance, segments)
    edges = [BITS * i // segments for i in range(segments + 1)]
    radius = [r if i <= a else r - 1 for i in range(segments)]
    return [(lo, hi - lo, k) for lo, hi, k in zip(edges, edges[1:], radius) if k >= 0]


def _keys(plan: list[tuple[int, int, int]], ball: bool) -> Column:
    parts = []
    for i, (low, width, radius) in enumerate(plan):
        value = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1))
        masks = _balls(width, radius) if ball else [0]
        for mask in masks:
            parts.append(value.bitwiseXOR(F.lit(mask).cast("long")) + F.lit(i << 56).cast("long"))
    return F.array(*parts)


def fingerprint_links(prints: DataFrame, max_distance: int = MAX_DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """Links (a, b) that connect exactly what all pairs of distinct fingerprints within the distance connect.

    First, fingerprints two bits apart or nearer meet at a value one flip away from both (at most 65 share
    one value); each links to the least there, and these stars are contracted. Then multi-index hashing:
    every fingerprint probes the Hamming ball around each of its segments, and the complete distance is
    checked. Pairs that the stars already connect are left out, so a dense group of near copies doesn't
    yield all its pairs.
    """
    near = None
    stars = prints.select(F.lit(None).cast("long").alias("a"), F.lit(None).cast("long").alias("b")).limit(0)
    if max_distance >= 2:
        flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")) for i in range(BITS)])
        meeting = prints.select("fp", F.explode(flips).alias("value"))
        least = F.min("fp").over(Window.partitionBy("value"))
        stars = stage_once(
            meeting.select(F.col("fp").alias("a"), least.alias("b")).filter("a <> b").distinct(), "stars",
        )
        near = None if stars.isEmpty() else components(stars)
    if near is None:
        prints = prints.withColumn("star", F.col("fp"))
    else:
        prints = prints.join(near.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("label", "fp").alias("star"))
    prints = stage_once(prints, "prints")
    plan = segment_plan(max_distance, segments)
    probes = prints.select(F.col("fp").alias("a"), F.col("star").alias("star_a"), F.explode(_keys(plan, True)).alias("key"))
    table = prints.select(F.col("fp").alias("b"), F.col("star").alias("star_b"), F.explode(_keys(plan, False)).alias("key"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_distance
    found = probes.join(table, (probes["key"] == table["key"]) & (F.col("a") < F.col("b")) & (F.col("star_a") != F.col("star_b")) & close)
    return stars.unionByName(found.select("a", "b").distinct())


def simhash_groups(
    docs: DataFrame, shingle: int = SHINGLE, max_distance: int = MAX_DISTANCE, segments: int = SEGMENTS,
) -> DataFrame:
    """(doc_id, text_key, fp, component_id, group) for every row of ``docs`` (columns ``doc_id``, ``text``).

    Rows whose fingerprints differ in at most ``max_distance`` bits are linked; ``group`` names the connected
    component (its least fingerprint) and ``component_id`` is its least doc_id. Equal fingerprints are
    counted once before any search. NULL and empty texts have fingerprint 0 and are linked like any other;
    texts shorter than a shingle count as one shingle. NULL ids are kept (and never the least, unless alone);
    repeated rows come out as often as they went in. Other columns are not read. An empty table gives no rows.
    """
    rows = stage_once(fingerprints(docs, shingle), "fingerprints")
    firsts = stage_once(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    links = fingerprint_links(firsts.select("fp"), max_distance, segments)
    labels = components(links).withColumnRenamed("node", "fp")
    of_print = stage_once(firsts.join(labels, "fp", "left").select("fp", "first_id", F.coalesce("label", "fp").alias("group")), "of-print")
    least = stage_once(of_print.groupBy("group").agg(F.min("first_id").alias("component_id")), "least")
    of_print = stage_once(of_print.join(least, "group").select("fp", "group", "component_id"), "groups")
    return rows.join(of_print, "fp").select("doc_id", "text_key", "fp", "component_id", "group")


def keep_one_per_group(docs: DataFrame, **params) -> DataFrame:
    """Rows of ``docs`` with all their columns, one of each SimHash group: the least id, then the least text key.

    NULL ids come last in a group. Identical rows (same id, same text) collapse to one.
    """
    rows = simhash_groups(docs, **params)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")
    winners = rows.groupBy("group").agg(F.min(order).alias("w")).select(F.col("w.doc_id").alias("_id"), F.col("w.text_key").alias("_key"))
    keyed = whole_rows(docs)
    winners = stage_once(winners, "winners")
    kept = keyed.join(winners, keyed["doc_id"].eqNullSafe(winners["_id"]) & (keyed["_row_key"] == winners["_key"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "_row_key"]).select("_whole.*")
