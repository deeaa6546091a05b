"""Removal of word sequences that occur more than once in a corpus."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.simhash import text_key
from eventloom.llm.words import blocks, printed_table, split_words, window_hashes, word_hashes
from eventloom.session import stage_once

WINDOW = 35
#: Windows of one block; their places in it fit two bytes.
BLOCK = 1 << 16
#: A bucket gets the hashes of about so many bytes of text, at whatever size of the input; the lowest byte of a hash is
#: told by its bucket, so there are 256 buckets at least.
BUCKET_BYTES, MIN_BUCKETS = 64 << 20, 256

SENT = (
    "bucket INT, block BIGINT, hashes BINARY, places BINARY, ids ARRAY<BIGINT>, keys ARRAY<BIGINT>, starts ARRAY<BIGINT>"
)
FOUND = "block BIGINT, places BINARY, ids ARRAY<BIGINT>, keys ARRAY<BIGINT>, starts ARRAY<BIGINT>"


def bucket_count(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> int:
    """Buckets of hashes, a power of two: so many that one task holds a bucket, however large the input is.

    Words take a byte and a space at least, so ``bucket_bytes`` of text have at most half as many windows.
    """
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return 1 << (max(MIN_BUCKETS, -(-size // bucket_bytes)) - 1).bit_length()


def _lists(values: np.ndarray, width: int, bounds: np.ndarray) -> pa.Array:
    """Binary column whose rows are consecutive runs of fixed-width values."""
    raw = np.ascontiguousarray(values).view(np.uint8)
    return pa.BinaryArray.from_buffers(
        pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * width).astype(np.int32)), pa.py_buffer(raw)],
    )


def _send(windows: np.ndarray, block: int, buckets: int):
    """The block's distinct window hashes, each with its first place, dealt to their buckets: seven bytes each, the
    lowest is in the bucket's number. Also all places of windows that occur twice or more within the block."""
    windows, first, of, counts = np.unique(windows, return_index=True, return_inverse=True, return_counts=True)
    again = np.flatnonzero(counts[of] > 1)
    bucket = (windows & np.uint64(buckets - 1)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    counts = np.bincount(bucket, minlength=buckets)
    used = np.flatnonzero(counts)
    bounds = np.concatenate([[0], np.cumsum(counts[used])])
    upper = (windows[order] >> np.uint64(8)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]
    none = pa.nulls(len(used), pa.list_(pa.int64()))
    sent = pa.RecordBatch.from_arrays([
        pa.array(used.astype(np.int32)), pa.array(np.full(len(used), block)), _lists(upper, 7, bounds),
        _lists(first[order].astype("<u2"), 2, bounds), none, none, none,
    ], names=["bucket", "block", "hashes", "places", "ids", "keys", "starts"])
    return sent, again


def _describe(block: int, buckets: int, ids: pa.Array, keys: pa.Array, starts: np.ndarray, again: np.ndarray):
    """Which documents a block's windows belong to: place of each document's first window, by row. With the places
    of windows that the block alone shows to be repeated."""
    one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(starts)], pa.int32()), a)
    return pa.RecordBatch.from_arrays([
        pa.array([-1 - (block + (block >> 32)) % buckets], pa.int32()), pa.array([block]), pa.nulls(1, pa.binary()),
        pa.array([again.astype("<u2").tobytes() if len(again) else None], pa.binary()),
        one(ids), one(keys), one(pa.array(starts.astype(np.int64))),
    ], names=["bucket", "block", "hashes", "places", "ids", "keys", "starts"])


def _scanner(window: int, buckets: int):
    def scan(batches):
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for low, high in blocks(batch.column(2)):
                piece = batch.slice(low, high - low)
                words = split_words(piece.column(2), printed_table(), lower=False)
                windows, first = window_hashes(word_hashes(words), words.first, window)
                for at in range(0, len(windows), BLOCK):
                    part = windows[at:at + BLOCK]
                    rows = np.flatnonzero((first[:-1] < at + len(part)) & (first[1:] > at))
                    taken = pa.array(rows)
                    sent, again = _send(part, block, buckets)
                    yield sent
                    yield _describe(block, buckets, piece.column(0).take(taken), piece.column(1).take(taken), first[rows] - at, again)
                    block += 1

    return scan


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary column's rows one after another, in however many chunks it comes, and each row's size."""
    parts, sizes = [], []
    for chunk in column.chunks:
        if len(chunk):
            offsets = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset:chunk.offset + len(chunk) + 1]
            parts.append(np.frombuffer(chunk.buffers()[2], np.uint8)[offsets[0]:offsets[-1]])
            sizes.append(np.diff(offsets).astype(np.int64))
    return np.concatenate(parts), np.concatenate(sizes)


def _repeated(table: pa.Table) -> pa.Table:
    """Places of the bucket's hashes that occur more than once, by block; descriptions pass."""
    if table.column("bucket")[0].as_py() < 0:
        return table.select(["block", "places", "ids", "keys", "starts"])
    upper, sizes = _flat(table.column("hashes"))
    wide = np.zeros((len(upper) // 7, 8), np.uint8)
    wide[:, :7] = upper.reshape(-1, 7)
    values = wide.view("<u8").ravel()
    places = _flat(table.column("places"))[0].view("<u2")
    # the bits of the bucket's number above its lowest byte are in the upper bytes too, so equal values are equal hashes
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    twin = ordered[1:] == ordered[:-1]
    again = np.zeros(len(values), bool)
    again[order[1:][twin]] = True
    again[order[:-1][twin]] = True
    counts = np.add.reduceat(again, (np.cumsum(sizes) - sizes) // 7, dtype=np.int64)
    rows = np.flatnonzero(counts)
    none = pa.nulls(len(rows), pa.list_(pa.int64()))
    return pa.Table.from_arrays([
        pa.array(table.column("block").to_numpy()[rows]),
        _lists(places[again], 2, np.concatenate([[0], np.cumsum(counts[rows])])), none, none, none,
    ], names=["block", "places", "ids", "keys", "starts"])


def _covered(window: int):
    """Word spans under the repeated windows of one block, merged, by document."""

    def cover(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        places = [np.frombuffer(r["places"], "<u2") for r in rows if r["places"] is not None]
        out = ([], [], [], [])
        if places:
            at = np.sort(np.concatenate(places)).astype(np.int64)
            of = next(r for r in rows if r["ids"] is not None)
            starts = np.array(of["starts"])
            doc = np.searchsorted(starts, at, "right") - 1
            new = np.ones(len(at), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + window)
            heads = np.flatnonzero(new)
            tails = np.append(heads[1:], len(at)) - 1
            owner = doc[heads]
            out = (
                [of["ids"][i] for i in owner], [of["keys"][i] for i in owner],
                at[heads] - starts[owner], at[tails] - starts[owner] + window,
            )
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in out], names=["doc_id", "text_key", "start", "stop"])

    return cover


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text_key, start, stop): word spans under windows whose sequence starts more than once in the corpus.

    Every window of ``window`` words gets a Rabin-Karp hash. The distinct hashes of a block go to buckets, each
    with its first place; a bucket finds those that occur in two blocks or more, and only their places go back to
    the block they came from. There they join the places of windows repeated within the block, and overlapping
    windows merge. The number of buckets follows the bytes of text (``bucket_count``). No key gathers more than its share: buckets hold hashes of all kinds, one window however
    frequent is one entry per block, and a block has at most 65,536 windows, also when one document has many blocks.
    """
    buckets = bucket_count(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key("text").alias("text_key"), "text")
    sent = rows.mapInArrow(_scanner(window, buckets), SENT)
    found = sent.groupBy("bucket").applyInArrow(_repeated, FOUND)
    spans = found.groupBy("block").applyInArrow(_covered(window), "doc_id BIGINT, text_key BIGINT, start BIGINT, stop BIGINT")
    return spans.distinct()


def _strip(batches):
    """Kept words of every row joined by one space, with counts."""
    for batch in batches:
        for low, high in blocks(batch.column(1)):
            piece = batch.slice(low, high - low)
            words = split_words(piece.column(1), printed_table(), lower=False)
            spans = piece.column(2)
            per_row = np.diff(np.frombuffer(spans.buffers()[1], np.int32)[spans.offset:spans.offset + len(spans) + 1])
            flat = spans.flatten()
            base = np.repeat(words.first[:-1], per_row)
            level = np.zeros(len(words.starts) + 1, np.int64)
            np.add.at(level, base + flat.field(0).to_numpy(zero_copy_only=False), 1)
            np.add.at(level, base + flat.field(1).to_numpy(zero_copy_only=False), -1)
            kept = np.cumsum(level[:-1]) == 0
            total = words.counts()
            before = np.concatenate([[0], np.cumsum(kept)])
            first = before[words.first]
            sizes = (words.ends - words.starts + 1)[kept]
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            at = np.repeat(words.starts[kept] - offsets[:-1], sizes) + np.arange(offsets[-1])
            text = np.append(words.data, np.uint8(0x20))[at]
            text[offsets[1:] - 1] = 0x20
            full = first[1:] > first[:-1]
            ends = offsets[first[1:][full]] - 1  # the space after each row's last word goes
            text = np.delete(text, ends)
            row_ends = offsets[first] - np.concatenate([[0], np.cumsum(full)])
            out = pa.LargeStringArray.from_buffers(len(piece), pa.py_buffer(row_ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(text)))
            yield pa.RecordBatch.from_arrays([
                piece.column(0), pa.array(total.astype(np.int64)), pa.array((total - np.diff(first)).astype(np.int64)),
                out.cast(pa.string()),
            ], names=["doc_id", "n_words", "n_removed", "kept_text"])


def remove_repeated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) for every row of ``docs`` (columns ``doc_id`` BIGINT, ``text``).

    A word goes if a window of ``window`` words that covers it starts anywhere else in the corpus, the same
    document included; windows are judged on the input. Kept words are joined by one space. NULL and empty
    texts have no words and come out empty; texts shorter than a window stay whole. Repeated rows are
    repeated sequences, so their windows go in each of them. NULL ids are kept. Other columns are not read;
    an empty table gives no rows.
    """
    spans = repeated_spans(docs, window).groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    spans = stage_once(spans, "spans").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "spans")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key("text").alias("text_key"), "text")
    match = rows["doc_id"].eqNullSafe(spans["_id"]) & (rows["text_key"] == spans["_key"])
    none = F.array().cast("array<struct<start:bigint,stop:bigint>>")
    joined = rows.join(spans, match, "left").select("doc_id", "text", F.coalesce("spans", none).alias("spans"))
    return joined.mapInArrow(_strip, "doc_id BIGINT, n_words BIGINT, n_removed BIGINT, kept_text STRING")
