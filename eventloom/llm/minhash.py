"""MinHash fingerprints of documents, their likeness, and near copies by banded joins."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventloom.llm.components import components
from eventloom.llm.simhash import text_key
from eventloom.llm.words import blocks, mix, printed_table, split_words, window_hashes, word_hashes
from eventloom.session import passing_stages, stage_once

SHINGLE = 5
PERMUTATIONS = 128
#: 25 bands of 5 values find a pair of Jaccard similarity 0.8 with probability 0.99995; the check is exact.
BANDS, ROWS = 25, 5
SIMILARITY = 0.8
SEED = 20260101
#: Shingles hashed at a time, so that scratch arrays stay in the processor's cache.
PIECE = 1 << 15


def coefficients(permutations: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and offsets of the universal hashes x -> (a*x + b) >> 32 of 32-bit shingle values."""
    draw = np.random.Generator(np.random.PCG64(SEED)).integers
    return draw(0, 1 << 64, permutations, dtype=np.uint64), draw(0, 1 << 64, permutations, dtype=np.uint64)


def shingle_values(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """32-bit values of the word shingles of every row, and per row its first; shorter texts are one shingle."""
    words = split_words(texts, printed_table(), lower=True)
    hashes = word_hashes(words)
    windows, first = window_hashes(hashes, words.first, shingle)
    counts = words.counts()
    short = np.flatnonzero((counts > 0) & (counts < shingle))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for j in range(shingle - 1):
            longer = counts[short] > j
            whole[longer] = mix(whole[longer] * np.uint64(31) + hashes[words.first[short[longer]] + j])
        windows = np.insert(windows, first[short], whole)
        sizes = np.diff(first)
        sizes[short] = 1
        first = np.concatenate([[0], np.cumsum(sizes)])
    return windows & np.uint64(0xFFFFFFFF), first


def signatures(texts: pa.Array, shingle: int = SHINGLE, permutations: int = PERMUTATIONS) -> np.ndarray:
    """One row of 16-bit values per text: the low bits of each permutation's minimum; all 0xFFFF without words."""
    values, first = shingle_values(texts, shingle)
    a, b = coefficients(permutations)
    least = np.full((len(texts), permutations), np.uint64(0xFFFF << 32))
    filled = np.flatnonzero(np.diff(first))
    at = 0
    while at < len(filled):
        low = first[filled[at]]
        stop = max(int(np.searchsorted(first[filled + 1], low + PIECE, "right")), at + 1)
        rows = filled[at:stop]
        part = values[low:first[rows[-1] + 1]]
        heads = first[rows] - low
        out = np.empty_like(part)
        for p in range(permutations):
            np.multiply(part, a[p], out=out)
            np.add(out, b[p], out=out)
            least[rows, p] = np.minimum.reduceat(out, heads)
        at = stop
    return ((least >> np.uint64(32)) & np.uint64(0xFFFF)).astype("<u2")


def likeness(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Share of equal values: the estimate of Jaccard similarity of the shingle sets, from 0 to 1."""
    return (left == right).mean(axis=1)


def _hex(rows: np.ndarray) -> list[str]:
    return [r.tobytes().hex() for r in rows]


# --- one signature per row ------------------------------------------------------------------------------------------


def _key() -> Column:
    return text_key(F.coalesce("text", F.lit("")))


def signed_rows(docs: DataFrame, shingle: int = SHINGLE, permutations: int = PERMUTATIONS) -> DataFrame:
    """(doc_id, text_key, print) of every row, in the shared folder: the only pass that signs texts as they stand."""

    def scan(batches):
        for batch in batches:
            for low, high in blocks(batch.column(2), 4 << 20):
                piece = batch.slice(low, high - low)
                prints = signatures(piece.column(2), shingle, permutations)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(1), pa.array([r.tobytes() for r in prints], pa.binary())], names=["doc_id", "text_key", "print"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key().alias("text_key"), "text")
    return stage_once(rows.mapInArrow(scan, "doc_id BIGINT, text_key BIGINT, print BINARY"), "signed")


def _prints(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(len(column), -1)


# --- documents in order ---------------------------------------------------------------------------------------------


def _placed(rows: DataFrame, doc_cuts: list[float], key_cuts: dict[float, list[int]]) -> DataFrame:
    """``rows`` with ``chunk`` and ``part``: consecutive ranges of ``doc_id`` (NULL last), and ranges of ``text_key`` within one id."""
    splits = [-float("inf"), *(doc_cuts or [0.0]), float("inf")]
    doubles = rows.withColumn("_at", F.col("doc_id").cast("double"))
    placed = Bucketizer(splits=splits, inputCol="_at", outputCol="chunk", handleInvalid="keep").transform(doubles).drop("_at")
    placed = placed.withColumn("chunk", F.coalesce("chunk", F.lit(float(len(splits)))))
    part = F.lit(0)
    for chunk, cuts in key_cuts.items():
        below = F.size(F.filter(F.array(*[F.lit(c).cast("bigint") for c in cuts]), lambda c: c <= F.col("text_key")))
        part = F.when(F.col("chunk") == chunk, below).otherwise(part)
    return placed.withColumn("part", part)


def _cuts(signed: DataFrame, chunks: int) -> tuple[list[float], dict[float, list[int]]]:
    """Cuts that deal rows out evenly in order of (doc_id, text_key); at most a few per chunk come to the driver.

    Each cut of the ids is followed by one right behind it, so an id with many rows, or none at all, is a chunk of its
    own, which is then cut by ``text_key``. Only rows equal in both stay together.
    """
    shares = [i / chunks for i in range(1, chunks)]
    found = signed.approxQuantile("doc_id", shares, 0.25 / chunks) if shares else []
    doc_cuts = sorted({float(c) for c in found} | {float(c) + 1 for c in found})
    sizes = _placed(signed.select("doc_id", "text_key"), doc_cuts, {}).groupBy("chunk").agg(
        F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"),
    ).collect()
    fair = max(1000, 2 * sum(r.n for r in sizes) // chunks)
    many = {r.chunk: -(-r.n // fair) for r in sizes if r.n > fair and r.low == r.high}
    step = lambda n, i: -(1 << 63) + (1 << 64) * i // n
    return doc_cuts, {chunk: [step(n, i) for i in range(1, n)] for chunk, n in many.items()}


def _in_order(docs: DataFrame, signed: DataFrame, classes: DataFrame | None) -> DataFrame:
    """Rows (kind, doc_id, text, print, component_id), sorted within partitions; each piece ends with the row that follows it.

    A document (kind 2) stands right behind rows with its print (kind 0) and class (kind 1). Only the first row of each
    piece is sent twice: to its own piece and, as its tail (kind 3), to the one before; the first of all follows the last.
    """
    spark = docs.sparkSession
    cuts = _cuts(signed, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    piece = ["chunk", "part"]
    heads = _placed(signed.select("doc_id", "text_key"), *cuts).groupBy(*piece).agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("head"),
    ).select(*piece, "head.doc_id", "head.text_key").orderBy(*piece).collect()
    # One row per piece, so at most a small multiple of the shuffle partitions, whatever the input's size.
    before = [(h.chunk, h.part, h.doc_id, h.text_key, heads[i - 1].chunk, heads[i - 1].part) for i, h in enumerate(heads)]
    tails = spark.createDataFrame(before, "chunk DOUBLE, part INT, _id BIGINT, _key BIGINT, to_chunk DOUBLE, to_part INT")
    rows = _placed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key().alias("text_key"), "text"), *cuts).alias("r")
    match = F.expr("r.chunk = t.chunk AND r.part = t.part AND r.doc_id <=> t._id AND r.text_key = t._key")
    places = F.filter(
        F.array(F.struct(F.col("r.chunk"), F.col("r.part"), F.lit(2).alias("kind")), F.struct(F.col("to_chunk").alias("chunk"), F.col("to_part").alias("part"), F.lit(3).alias("kind"))),
        lambda t: t["chunk"].isNotNull(),
    )
    rows = rows.join(F.broadcast(tails).alias("t"), match, "left").withColumn("to", F.explode(places)).select(
        "to.*", F.col("r.doc_id"), F.col("r.text_key"), "text", F.lit(None).cast("binary").alias("print"), F.lit(None).cast("bigint").alias("component_id"),
    )
    nothing = lambda kind: F.lit(None).cast(kind)
    about = _placed(signed, *cuts).select(*piece, F.lit(0).alias("kind"), "doc_id", "text_key", nothing("string").alias("text"), "print", nothing("bigint").alias("component_id"))
    if classes is not None:
        of_class = _placed(signed.select("doc_id", "text_key").join(classes, "text_key"), *cuts)
        about = about.unionByName(of_class.select(
            *piece, F.lit(1).alias("kind"), "doc_id", "text_key", nothing("string").alias("text"), nothing("binary").alias("print"), "component_id",
        ))
    every = rows.unionByName(about).repartition(*piece)
    every = every.sortWithinPartitions(*piece, F.col("kind") == 3, F.col("doc_id").asc_nulls_last(), "text_key", "kind")
    return every.select("chunk", "part", "kind", "doc_id", "text", "print", "component_id")


def _pairwise(shingle: int, permutations: int):
    """Each document with its follower; the last document of a block waits for the next block."""

    def emit(rows):
        own = [i for i in range(len(rows) - 1) if not rows[i][4]]  # a tail only follows
        ids, texts, _, classes, _ = zip(*rows)
        prints = np.stack([r[2] for r in rows])
        followers = [i + 1 for i in own]
        edited = []
        for i, j in zip(own, followers):
            half = len(texts[i]) // 2
            edited.append(texts[i][:len(texts[i]) - half] + texts[j][:half])
        other = signatures(pa.array(edited, pa.string()), shingle, permutations)
        return pa.RecordBatch.from_arrays([
            pa.array([ids[i] for i in own], pa.int64()), pa.array([len(texts[i]) for i in own], pa.int64()),
            pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
            pa.array(_hex(prints[own]), pa.string()), pa.array(_hex(other), pa.string()),
            pa.array(likeness(prints[own], other)), pa.array(likeness(prints[own], prints[followers])),
            pa.array([classes[i] for i in own], pa.int64()),
        ], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "component_id"])

    def compare(batches):
        rows, sig_of, class_of = [], None, None
        for batch in batches:
            for low, high in blocks(batch.column("text"), 4 << 20):
                columns = [batch.column(c).slice(low, high - low).to_pylist() for c in ("kind", "doc_id", "text", "print", "component_id")]
                for kind, doc, text, sig, component in zip(*columns):
                    if kind == 0:
                        sig_of = np.frombuffer(sig, "<u2")
                    elif kind == 1:
                        class_of = component
                    elif kind == 2:
                        rows.append((doc, text or "", sig_of, class_of, False))
                    else:
                        rows.append((doc, text or "", signatures(pa.array([text], pa.string()), shingle, permutations)[0], None, True))
                if len(rows) > 1:
                    yield emit(rows)
                    rows = rows[-1:]

    return compare


def _compared(docs: DataFrame, signed: DataFrame, classes: DataFrame | None, shingle: int, permutations: int) -> DataFrame:
    schema = (
        "doc_id BIGINT, n_chars BIGINT, edited_sha256 STRING, fingerprint STRING, edited_fingerprint STRING, "
        "near_edited DOUBLE, near_next DOUBLE, component_id BIGINT"
    )
    return _in_order(docs, signed, classes).mapInArrow(_pairwise(shingle, permutations), schema)


def edited_comparison(docs: DataFrame, shingle: int = SHINGLE, permutations: int = PERMUTATIONS) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row.

    The edited text replaces the last half of a document's characters by the first as many of the next
    document in ascending ``doc_id`` (the first follows the last; NULL ids come last; equal ids by a hash of
    their text). NULL texts count as empty; a text without words has the fingerprint of the empty text,
    which is like itself (1) and nothing else. Repeated rows follow each other. A single row is its own
    follower. An empty table gives no rows. Only ``doc_id`` and ``text`` are read.
    """
    return _compared(docs, signed_rows(docs, shingle, permutations), None, shingle, permutations).drop("component_id")


# --- near copies ----------------------------------------------------------------------------------------------------


def _band_keys(prints: np.ndarray) -> np.ndarray:
    """BANDS keys per print."""
    values = prints[:, :BANDS * ROWS].astype(np.uint64)
    keys = np.zeros((len(values), BANDS), np.uint64)
    for j in range(ROWS):
        keys = mix(keys * np.uint64(31) + values[:, j::ROWS] + np.uint64(1))
    return mix(keys + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _band_rows(batches):
    """(band, text_key) of every distinct text of a batch."""
    for batch in batches:
        if batch.num_rows:
            keys, at = np.unique(batch.column("text_key").to_numpy(), return_index=True)
            bands = _band_keys(_prints(batch.column("print").take(pa.array(at))))
            yield pa.RecordBatch.from_arrays([pa.array(bands.ravel()), pa.array(np.repeat(keys, BANDS))], names=["band", "text_key"])


def _stars(batches):
    """(band, a, b, at) per member a of each band with two texts or more, b its first; and per range its first and last band (at: range number)."""
    here, last, first = TaskContext.get().partitionId(), None, None  # last: band, key, first key of the band

    def rows(band, a, b, at):
        n = len(band)
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)) for x in (band, a, b)] + [pa.array([at] * n, pa.int32())], names=["band", "a", "b", "at"])

    for batch in batches:
        band, key = (batch.column(c).to_numpy() for c in ("band", "text_key"))
        if not len(band):
            continue
        if last is not None:  # the open band's first text goes on at the front
            band, key = np.concatenate([[last[0]], band]), np.concatenate([[last[2]], key])
        fresh = np.ones(len(band), bool)
        fresh[1:] = (band[1:] != band[:-1]) | (key[1:] != key[:-1])
        band, key = band[fresh], key[fresh]
        new = np.ones(len(band), bool)
        new[1:] = band[1:] != band[:-1]
        start = np.maximum.accumulate(np.where(new, np.arange(len(band)), 0))
        more = np.flatnonzero(~new & (key != key[start]))
        centers = np.unique(start[more])
        yield rows(np.concatenate([band[more], band[centers]]), np.concatenate([key[more], key[centers]]), np.concatenate([key[start[more]], key[centers]]), None)
        first = first or (band[0], key[0])
        last = (band[-1], key[-1], key[start[-1]])
    if last is not None:
        yield rows([first[0], last[0]], [first[1], last[2]], [first[1], last[2]], here)


def _met(signed: DataFrame) -> DataFrame:
    """(band, a, b): members of every band that several texts share, each with the band's first text (itself included).

    Band members are dealt out by ranges of (band, text), so a band of very many texts spreads over tasks, each with a
    first text of its own; those are linked across the ranges, from one row per end of a range on the driver.
    """
    keys = ["band", "text_key"]
    members = signed.select("text_key", "print").mapInArrow(_band_rows, "band BIGINT, text_key BIGINT")
    found = members.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(_stars, "band BIGINT, a BIGINT, b BIGINT, at INT")
    found = stage_once(found, "met")
    ends = defaultdict(list)
    for r in found.filter("at IS NOT NULL").collect():
        ends[r.at].append((r.band, r.a))
    ranges, across = [ends[at] for at in sorted(ends)], []
    for one, two in zip(ranges, ranges[1:]):
        for band, a in one:
            across += [(band, a, a), (band, b, a)] if (b := dict(two).get(band)) is not None and b != a else []
            across += [(band, b, b)] if b is not None and b != a else []
    plain = found.filter("at IS NULL").drop("at")
    return plain.unionByName(signed.sparkSession.createDataFrame([tuple(map(int, r)) for r in across], "band BIGINT, a BIGINT, b BIGINT")) if across else plain


#: Bits of the filter that keeps texts out which meet no other; at any number of texts it only saves work.
FILTER_BITS = 1 << 24
WORD_BITS = 1 << 15


def _shingle_sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(text_key, shingles): the distinct shingle values of the texts with a wanted ``a``, once each."""
    slot = F.pmod(F.col("a"), F.lit(FILTER_BITS))
    words = wanted.select(F.floor(slot / WORD_BITS).cast("int").alias("word"), (slot % WORD_BITS).alias("bit")).groupBy("word").agg(
        F.bitmap_construct_agg("bit").alias("bits"),
    ).collect()  # at most FILTER_BITS bits
    filled = np.zeros(FILTER_BITS // 8, np.uint8)
    for w in words:
        filled[w.word * WORD_BITS // 8:(w.word + 1) * WORD_BITS // 8] = np.frombuffer(w.bits, np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(filled)

    def scan(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy()
            at = np.mod(keys, FILTER_BITS)
            mine = np.flatnonzero(shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1)
            mine = mine[np.unique(keys[mine], return_index=True)[1]]
            part = batch.take(pa.array(np.sort(mine)))
            for low, high in blocks(part.column(1), 4 << 20):
                piece = part.slice(low, high - low)
                values, first = shingle_values(piece.column(1), shingle)
                sets = [np.unique(values[a:b]).astype(np.uint32).view(np.int32) for a, b in zip(first, first[1:])]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(sets, pa.list_(pa.int32()))], names=["text_key", "shingles"])

    found = docs.select(_key().alias("text_key"), "text").mapInArrow(scan, "text_key BIGINT, shingles ARRAY<INT>")
    return stage_once(found.groupBy("text_key").agg(F.first("shingles").alias("shingles")), "shingles")


#: Slots in which shingles are counted to order them; any order gives the same links, a good one fewer comparisons.
COUNT_SLOTS = 1 << 20


def _rare_shingles(sets: DataFrame, similarity: float) -> DataFrame:
    """(band, a, star, n, short): the shingles of each set that are rarest in a common order, one more than it may lack.

    Two sets of Jaccard similarity t share at least t * n shingles of the n of either, so also one of the first
    n - ceil(t * n) + 1 shingles of each, whatever the order. They share at least 2t / (1 + t) of the smaller set, so
    the first shingle they share is among still fewer of that one; those are ``short``. Rare ones come first: those of a
    passage that very many texts hold hardly ever count. Sets without shingles have the shingle 0, so that they meet.
    """
    of_smaller = 2 * similarity / (1 + similarity)

    def counted(batches):
        counts = np.zeros(COUNT_SLOTS, np.int64)
        for batch in batches:
            values = batch.column(0).flatten().to_numpy().view(np.uint32)
            counts += np.bincount(values % COUNT_SLOTS, minlength=COUNT_SLOTS)
        slots = np.flatnonzero(counts)
        for at in range(0, len(slots), 1 << 16):
            part = slots[at:at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(counts[part])], names=["slot", "n"])

    found = sets.select("shingles").mapInArrow(counted, "slot BIGINT, n BIGINT").groupBy("slot").agg(F.sum("n").alias("n"))
    counts = np.zeros(COUNT_SLOTS, np.int64)
    for batch in found.toArrow().to_batches():  # at most COUNT_SLOTS rows
        counts[batch.column("slot").to_numpy()] = batch.column("n").to_numpy()
    shared = sets.sparkSession.sparkContext.broadcast(counts)

    def rarest(batches):
        for batch in batches:
            bands, rows, short, sizes = [], [], [], []
            for i, cell in enumerate(batch.column("shingles")):
                values = cell.values.to_numpy().view(np.uint32)
                n = len(values)
                first = n - int(np.ceil(n * similarity - 1e-9)) + 1
                order = np.lexsort((values, shared.value[values % COUNT_SLOTS]))[:first]
                bands.append(values[order].astype(np.int64) if n else np.zeros(1, np.int64))
                rows.append(np.full(len(bands[-1]), i))
                short.append(np.arange(len(bands[-1])) <= n - int(np.ceil(n * of_smaller - 1e-9)))
                sizes.append(np.full(len(bands[-1]), n, np.int32))
            if rows:
                at = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate(bands)), batch.column("a").take(at), batch.column("star").take(at),
                    pa.array(np.concatenate(sizes)), pa.array(np.concatenate(short)),
                ], names=["band", "a", "star", "n", "short"])

    return sets.select("a", "star", "shingles").mapInArrow(rarest, "band BIGINT, a BIGINT, star BIGINT, n INT, short BOOLEAN")


def _likeness_of(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, alike, gap) of the pairs: Jaccard similarity of the shingle sets, two empty ones being alike; shingles in one set only."""
    left = sets.select(F.col("text_key").alias("a"), F.col("shingles").alias("of_a"))
    right = sets.select(F.col("text_key").alias("b"), F.col("shingles").alias("of_b"))
    shared = F.size(F.array_intersect("of_a", "of_b"))
    both = F.size("of_a") + F.size("of_b") - shared
    alike = F.when(both > 0, shared / both).otherwise(1.0)
    return stage_once(pairs.join(left, "a").join(right, "b").select("a", "b", alike.alias("alike"), (both - shared).alias("gap")), "alike")


def _labelled(rows: DataFrame, column: str, labels: DataFrame, name: str) -> DataFrame:
    """``rows`` with the group of ``column``, itself where it has none."""
    names = labels.select(F.col("node").alias(column), F.col("label").alias("_label"))
    return rows.join(names, column, "left").withColumn(name, F.coalesce("_label", column)).drop("_label")


def _by_differences(inner: DataFrame, outer: DataFrame, sets: DataFrame, share: float) -> DataFrame:
    """Pairs (a, b) of a text ``inner`` and a text ``outer`` of one center that can still be alike; columns center, a.

    Texts p and q that differ from any common set in the shingles P and Q differ from each other in |P| + |Q| - 2 |P & Q|,
    which may be ``share`` of the sum of their sizes at most: so P & Q has no less than half of (|P| + |Q| - share *
    (|p| + |q|)). The least of P & Q in a common order stands early enough in both to leave that many. The common set
    holds the shingles of most inner texts, so that what a text changed differs, and rare differences come first: edits
    of a text's own do not meet, and many near copies of one original yield few pairs. The inner texts of a center are
    connected, so an outer text that needs no common difference with the one nearest to the common set meets it alone.
    """
    of_text = sets.select(F.col("text_key").alias("a"), F.col("shingles").alias("own"))
    inner = inner.join(of_text, "a")
    votes = inner.select("center", F.explode("own").alias("shingle")).groupBy("center", "shingle").agg(F.count("*").alias("n"))
    votes = votes.join(inner.groupBy("center").agg(F.count("*").alias("texts")), "center").filter("2 * n > texts")
    # A set of majorities has at most twice the mean size of its texts.
    common = votes.groupBy("center").agg(F.collect_list("shingle").alias("common"))
    rows = inner.withColumn("inside", F.lit(True)).unionByName(outer.join(of_text, "a").withColumn("inside", F.lit(False)))
    rows = rows.join(common, "center", "left").withColumn("common", F.coalesce("common", F.array().cast("array<int>")))
    differ = F.array_union(F.array_except("own", "common"), F.array_except("common", "own"))
    rows = rows.select("center", "a", "inside", differ.alias("differ"), (F.size(differ) - share * F.size("own")).alias("over"))
    rows = stage_once(rows.select("center", "a", "inside", "over", F.size("differ").alias("size"), F.explode_outer("differ").alias("shingle")), "differences")
    inside, over = F.col("inside"), F.col("over")
    least = rows.groupBy("center").agg(
        F.min(F.when(inside, over)).alias("of_inner"), F.min(F.when(~inside, over)).alias("of_outer"), F.min_by("a", F.when(inside, over)).alias("nearest"),
    )
    rows = rows.join(stage_once(least, "least"), "center").withColumn("needed", (over + F.when(inside, F.col("of_outer")).otherwise(F.col("of_inner"))) / 2 - 1e-6)
    near = rows.filter("NOT inside AND needed <= 0").select(F.col("nearest").alias("a"), F.col("a").alias("b"))
    rows = rows.filter("(inside OR needed > 0) AND shingle IS NOT NULL")
    counts = rows.groupBy("center", "shingle").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("center", "a", "inside").orderBy("n", "shingle"))
    ranked = rows.join(counts, ["center", "shingle"]).withColumn("rest", F.col("size") - place + 1).filter("rest >= needed")
    ranked = stage_once(ranked.select("center", "shingle", "a", "inside", "over", "rest"), "rare")
    left, right = ranked.filter("inside").alias("p"), ranked.filter("NOT inside").alias("q")
    meet = F.expr("p.center = q.center AND p.shingle = q.shingle") & (F.least("p.rest", "q.rest") >= (F.col("p.over") + F.col("q.over")) / 2 - 1e-6)
    pairs = left.join(right, meet).select(F.col("p.a").alias("a"), F.col("q.a").alias("b"))
    return stage_once(pairs.unionByName(near).distinct(), "differ")


def _links(docs: DataFrame, signed: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """Links (a, b) between texts with a common band and at least the similarity, enough to connect all such texts.

    A band's first is the text that shares the most bands with others. First each text is compared with the first of
    most of its bands, then with the firsts of its other bands that are not connected to it yet. Members of bands that still hold several groups are compared further if they
    share one of their rarest shingles (see ``_rare_shingles``; without that two sets are less alike) and neither is too
    small for the other: first the least texts of their groups. The number of shingles that stand in one of two sets only
    is a metric: for members p, q of groups with least texts x, y it is at least g(x, y) - g(p, x) - g(q, y), and sets as
    alike as asked differ in a share of their sizes at most. So groups whose widest members stay out of reach are done.
    The others' members are compared with the least text of the wider group, and then with those of its members that
    differ from it in the same shingles (see ``_by_differences``).
    """
    met = _met(signed)
    # A text of which the others are edited copies is in more of their bands than they are in each other's.
    known = stage_once(met.groupBy("a").agg(F.count("*").alias("n")), "degrees")
    met = stage_once(met.select("band", "a").join(known, "a"), "members")
    firsts = stage_once(met.groupBy("band").agg(F.max_by("a", "n").alias("b")), "firsts")
    met = stage_once(met.select("band", "a").join(firsts, "band"), "met")
    sets = _shingle_sets(docs, met.select("a"), shingle)
    pairs = met.filter("a <> b").groupBy("a", "b").agg(F.count("*").alias("n"))
    pairs = stage_once(pairs, "pairs")
    good = F.col("alike") >= similarity
    links = _likeness_of(pairs.groupBy("a").agg(F.max_by("b", "n").alias("b")), sets).filter(good).select("a", "b")
    labels = components(links)
    rest = _labelled(_labelled(pairs.select("a", "b"), "a", labels, "x"), "b", labels, "y").filter("x <> y").select("a", "b")
    more = _likeness_of(rest, sets).filter(good).select("a", "b")
    links = stage_once(links.unionByName(more), "links")
    labels = components(links)

    named = stage_once(_labelled(met.select("band", "a").distinct(), "a", labels, "star"), "named")
    mixed = named.groupBy("band").agg(F.min("star").alias("low"), F.max("star").alias("high")).filter("low <> high").select("band")
    open_ = stage_once(named.join(mixed, "band").select("a", "star").distinct(), "open")
    named = stage_once(_rare_shingles(stage_once(sets.withColumnRenamed("text_key", "a").join(open_, "a"), "sets"), similarity), "rare")
    several = named.groupBy("band").agg(F.min("star").alias("low"), F.max("star").alias("high"), F.max("short").alias("short"))
    mixed = stage_once(named.join(stage_once(several.filter("low <> high AND short").select("band"), "mixed"), "band"), "mixed")
    ends = mixed.groupBy("band", "star").agg(F.max("short").alias("short"), F.min("n").alias("low"), F.max("n").alias("high"))
    ends = stage_once(ends, "ends")

    def end(side: str) -> DataFrame:
        return ends.select("band", *[F.col(c).alias(f"{c}_{side}") for c in ("star", "short", "low", "high")])

    def fits(low_x: str, high_x: str, low_y: str, high_y: str) -> Column:
        return (F.col(high_x) + 1e-6 >= F.col(low_y) * similarity) & (F.col(high_y) + 1e-6 >= F.col(low_x) * similarity)

    meet = (F.col("star_x") < F.col("star_y")) & (F.col("short_x") | F.col("short_y")) & fits("low_x", "high_x", "low_y", "high_y")
    across = end("x").join(end("y"), "band").filter(meet)
    across = across.withColumnsRenamed({"star_x": "x", "star_y": "y"})
    apart = _likeness_of(across.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), sets)
    links = links.unionByName(apart.filter(good).select("a", "b"))
    members = mixed.select("a", "star", "n").distinct()
    own = _likeness_of(members.filter("a <> star").select("a", F.col("star").alias("b")), sets)
    members = members.join(own.select("a", F.col("gap").alias("off")), "a", "left").withColumn("off", F.coalesce("off", F.lit(0)))
    members = stage_once(members, "off")
    # Sets of n and m shingles that are as alike as asked differ in (1 - t) / (1 + t) * (n + m) shingles at most.
    share = (1 - similarity) / (1 + similarity)
    reach = lambda n, m: share * (F.col(n) + F.col(m)) + 1e-6
    widest = stage_once(members.groupBy("star").agg(F.max("off").alias("wide"), F.max("n").alias("most")), "widest")
    far = apart.filter(~good).select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("gap").alias("far"))
    for side in "xy":
        far = far.join(widest.select(F.col("star").alias(side), F.col("wide").alias(f"wide_{side}"), F.col("most").alias(f"most_{side}")), side)
    far = far.filter("wide_x > 0 OR wide_y > 0").filter(F.col("far") - F.col("wide_x") - F.col("wide_y") <= reach("most_x", "most_y"))
    wider = F.col("wide_x") >= F.col("wide_y")
    turned = lambda one, two: F.when(wider, F.col(one)).otherwise(F.col(two))
    far = stage_once(far.select(
        turned("x", "y").alias("center"), turned("y", "x").alias("other"), "far", turned("wide_x", "wide_y").alias("wide"), turned("most_x", "most_y").alias("most"),
    ), "far")
    outer = far.join(members.withColumnRenamed("star", "other"), "other").filter(F.col("far") - F.col("off") - F.col("wide") <= reach("n", "most"))
    outer = stage_once(outer.select("center", "other", "a"), "outer")
    seen = _likeness_of(outer.select("a", F.col("center").alias("b")), sets)
    links = links.unionByName(seen.filter(good).select("a", "b"))
    seen = outer.join(seen.withColumnRenamed("b", "center"), ["a", "center"])
    met = seen.filter(good).select("center", "other").distinct()
    outer = stage_once(seen.join(met, ["center", "other"], "left_anti").select("center", "a").distinct(), "outer")
    inner = members.filter("a <> star").withColumnRenamed("star", "center").join(outer.select("center").distinct(), "center", "left_semi").select("center", "a")
    last = _likeness_of(_by_differences(inner, outer, sets, share), sets)
    return links.unionByName(last.filter(good).select("a", "b"))


def _classes(docs: DataFrame, signed: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """(text_key, component_id): the least id among the texts linked to a text, itself included."""
    with passing_stages(docs.sparkSession):
        return _named(signed, components(_links(docs, signed, similarity, shingle)))


def _named(signed: DataFrame, labels: DataFrame) -> DataFrame:
    of_text = _labelled(signed.groupBy("text_key").agg(F.min("doc_id").alias("first_id")), "text_key", labels, "label")
    of_text = stage_once(of_text.select("text_key", "first_id", "label"), "texts")
    firsts = stage_once(of_text.groupBy("label").agg(F.min("first_id").alias("component_id")), "firsts")
    return stage_once(of_text.join(firsts, "label").select("text_key", "component_id"), "classes", keep=True)


def near_copies(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, permutations: int = PERMUTATIONS) -> DataFrame:
    """(doc_id, component_id) for every row: the least id among the texts linked to a row's text, itself included.

    Texts whose sets of word shingles have at least the Jaccard similarity are linked if they share a band of the
    signature; the similarity is computed from the sets. Equal texts count once. NULL texts and texts without words are
    alike. NULL ids stay, and are never the least unless alone; repeated rows repeat. Other columns are not read; an
    empty table gives no rows.
    """
    signed = signed_rows(docs, shingle, permutations)
    return signed.select("doc_id", "text_key").join(_classes(docs, signed, similarity, shingle), "text_key").select("doc_id", "component_id")


def fingerprints(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, permutations: int = PERMUTATIONS) -> DataFrame:
    """The columns of ``edited_comparison`` and ``component_id``, the class of ``near_copies``, for every row of ``docs``."""
    signed = signed_rows(docs, shingle, permutations)
    return _compared(docs, signed, _classes(docs, signed, similarity, shingle), shingle, permutations)
