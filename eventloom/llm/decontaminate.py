"""Benchmark passages in training text, found by winnowed fingerprints."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.simhash import text_key, whole_rows
from eventloom.llm.words import BASE, MASK, alnum_table, blocks, mix, split_words, window_hashes, word_hashes
from eventloom.session import stage_once

WINDOW = 10
#: Bits of the broadcast filter of benchmark fingerprints: 2 MiB whatever the benchmark's size.
FILTER_BITS = 1 << 24

HITS = "array<struct<scheme:int,print:bigint,place:bigint,around:array<bigint>>>"


def scheme(length: int) -> tuple[int, int]:
    """(k, w): each shared span of ``length`` words holds a whole winnowing window of w k-grams, so shares its minimum."""
    k = (length + 1) // 2
    return k, length - k + 1


def winnow(hashes: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Selected k-grams of every row of at least ``length`` words: (fingerprint, index of the k-gram's first word)."""
    k, w = scheme(length)
    grams, row_first = window_hashes(hashes, first, k, seed=length + 10)
    n = len(grams) - w + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    least, at = grams[:n].copy(), np.arange(n)
    for j in range(1, w):
        other = grams[j:n + j]
        better = other <= least
        least[better] = other[better]
        at[better] = np.flatnonzero(better) + j
    row = np.repeat(np.arange(len(first) - 1), np.diff(row_first))
    picked = np.unique(at[row[:n] == row[w - 1:]])
    return mix(grams[picked] + np.uint64(length * int(BASE) & MASK)), picked + (first[:-1] - row_first[:-1])[row[picked]]


def contexts(hashes: np.ndarray, first: np.ndarray, places: np.ndarray, length: int, outside: int) -> np.ndarray:
    """Word hashes from length-k words before each place to as many after its k-gram; ``outside`` beyond the row."""
    k, _ = scheme(length)
    row = np.searchsorted(first, places, "right") - 1
    at = places[:, None] + np.arange(k - length, length)[None, :]
    inside = (at >= first[row][:, None]) & (at < first[row + 1][:, None])
    return np.where(inside, hashes[np.clip(at, 0, len(hashes) - 1)] | np.uint64(2), np.uint64(outside))


def _hit_rows(prints, places, around, row, n_rows, lengths):
    """List column of hits, one list per row; ``row`` is ascending."""
    offsets = np.searchsorted(row, np.arange(n_rows + 1))
    widths = np.fromiter((len(a) for a in around), np.int64, len(around))
    lists = pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(widths)]).astype(np.int32)),
        pa.array((np.concatenate(around) if len(around) else np.zeros(0, np.uint64)).view(np.int64)),
    )
    values = pa.StructArray.from_arrays(
        [pa.array(lengths.astype(np.int32)), pa.array(prints.view(np.int64)), pa.array(places.astype(np.int64)), lists],
        names=["scheme", "print", "place", "around"],
    )
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


def _scanner(lengths: list[int], bits: np.ndarray | None, outside: int, own_length: bool):
    """Arrow function: (id, key, text) rows to (id, key, n_words, hits).

    For documents every scheme in ``lengths`` is tried and only fingerprints in the filter are kept; for
    benchmark items (``own_length``) each item uses the scheme of its own window.
    """

    def scan(batches):
        for batch in batches:
            for low, high in blocks(batch.column(2)):
                piece = batch.slice(low, high - low)
                words = split_words(piece.column(2), alnum_table(), lower=True)
                hashes, counts = word_hashes(words), words.counts()
                found = []
                for length in lengths:
                    prints, places = winnow(hashes, words.first, length)
                    row = np.searchsorted(words.first, places, "right") - 1
                    if own_length:
                        keep = np.minimum(counts[row], max(lengths)) == length
                    else:
                        slot = (prints & np.uint64(FILTER_BITS - 1)).astype(np.int64)
                        keep = (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
                    prints, places, row = prints[keep], places[keep], row[keep]
                    around = contexts(hashes, words.first, places, length, outside) if len(places) else []
                    found.append((row, prints, places - words.first[row], list(around), np.full(len(row), length)))
                row = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
                order = np.argsort(row, kind="stable")
                pick = lambda i, kind: (np.concatenate([f[i] for f in found]) if found else np.zeros(0, kind))[order]
                around = [a for f in found for a in f[3]]
                hits = _hit_rows(pick(1, np.uint64), pick(2, np.int64), [around[i] for i in order], row[order], len(piece), pick(4, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(1), pa.array(counts.astype(np.int64)), hits], names=["id", "text_key", "n_words", "hits"],
                )

    return scan


def _filter_bits(items: DataFrame) -> np.ndarray:
    """Bit set of benchmark fingerprints; at most FILTER_BITS bits come to the driver, however many items there are."""
    slot = F.col("print").bitwiseAND(F.lit(FILTER_BITS - 1))
    words = items.groupBy(F.shiftrightunsigned(slot, 5).alias("at")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(31)).cast("int"))).alias("bits"),
    ).collect()
    bits = np.zeros(FILTER_BITS // 32, np.uint32)
    for at, value in words:
        bits[at] = value
    return bits.astype("<u4").view(np.uint8)


def _extend(batches):
    """Shared span around each matching fingerprint, if it is as long as a window: (row_id, item_id, start, stop)."""
    for batch in batches:
        lengths = batch.column(2).to_numpy()
        out = ([], [], [], [])
        for length in np.unique(lengths):
            picked = pa.array(np.flatnonzero(lengths == length))
            k, _ = scheme(int(length))
            part = batch.take(picked)
            shape = (len(part), 2 * int(length) - k)
            mine = part.column(4).flatten().to_numpy().reshape(shape)
            theirs = part.column(5).flatten().to_numpy().reshape(shape)
            same = mine == theirs
            side = int(length) - k
            gram = same[:, side:side + k].all(axis=1)
            left = np.cumprod(same[:, :side][:, ::-1], axis=1).sum(axis=1)
            right = np.cumprod(same[:, side + k:], axis=1).sum(axis=1)
            hit = gram & (left + k + right >= length)
            place = part.column(3).to_numpy()
            out[0].append(part.column(0).filter(pa.array(hit)))
            out[1].append(part.column(1).filter(pa.array(hit)))
            out[2].append((place - left)[hit])
            out[3].append((place + k + right)[hit])
        if out[0]:
            yield pa.RecordBatch.from_arrays([
                pa.concat_arrays(out[0]), pa.concat_arrays(out[1]), pa.array(np.concatenate(out[2])), pa.array(np.concatenate(out[3])),
            ], names=["row_id", "item_id", "start", "stop"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text_key, n_words, n_hit, n_items, items) for every row of ``docs``.

    ``docs`` has ``doc_id`` and ``text``, ``benchmark`` has ``item_id`` and ``text``. Words are lower-cased
    runs of digits, a-z and non-ASCII characters. A window is ``window`` consecutive words of an item, or
    the whole of a shorter item; a document word inside any occurrence of a window is hit, and ``items`` are
    the ids of items with occurring windows, sorted as strings.

    Documents and items are winnowed alike (minimum k-gram hash of each sliding window), which finds every
    shared span of a window's length; equal fingerprints are joined and extended word by word on both
    sides. A fixed-size filter of benchmark fingerprints lets the scan pass on only those that can match; at
    any benchmark size it only saves work. NULL and empty texts have no words; items without words have no
    window; an item with a NULL id hits words but is not listed. Rows repeat as in the input, ids may be
    NULL or repeat, other columns are not read, empty tables give no rows or no hits.
    """
    item_rows = benchmark.select(F.col("item_id").alias("id"), F.lit(0).cast("long").alias("text_key"), "text")
    lengths = list(range(1, window + 1))
    id_type = item_rows.schema["id"].dataType.simpleString()
    items = item_rows.mapInArrow(_scanner(lengths, None, 0, True), f"id {id_type}, text_key BIGINT, n_words BIGINT, hits {HITS}")
    prints = stage_once(
        items.select(F.col("id").alias("item_id"), F.explode("hits").alias("hit"))
        .select("item_id", "hit.scheme", "hit.print", F.col("hit.around").alias("item_around")).distinct(), "benchmark",
    )
    used = sorted(r[0] for r in prints.select("scheme").distinct().collect())
    rows = docs.select(F.col("doc_id").alias("id"), text_key("text").alias("text_key"), "text")
    doc_type = rows.schema["id"].dataType.simpleString()
    scanned = rows.mapInArrow(
        _scanner(used, _filter_bits(prints), 1, False), f"id {doc_type}, text_key BIGINT, n_words BIGINT, hits {HITS}",
    )
    scanned = stage_once(scanned.withColumn("row_id", F.monotonically_increasing_id()), "scanned")
    mine = scanned.select("row_id", F.explode("hits").alias("hit")).select("row_id", "hit.scheme", "hit.print", "hit.place", "hit.around")
    met = mine.join(prints.withColumnRenamed("scheme", "item_scheme"), "print").filter("scheme = item_scheme")
    spans = met.select("row_id", "item_id", "scheme", "place", "around", "item_around").mapInArrow(
        _extend, f"row_id BIGINT, item_id {id_type}, start BIGINT, stop BIGINT",
    )
    spans = stage_once(spans.distinct(), "shared")
    covered = F.aggregate(
        F.array_sort(F.collect_set(F.struct("start", "stop"))), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda acc, span: F.struct(
            (acc["n"] + F.greatest(span["stop"] - F.greatest(span["start"], acc["end"]), F.lit(0))).alias("n"),
            F.greatest(acc["end"], span["stop"]).alias("end"),
        ),
    )
    per_row = spans.groupBy("row_id").agg(
        covered["n"].alias("n_hit"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"),
    )
    return scanned.select("row_id", F.col("id").alias("doc_id"), "text_key", "n_words").join(per_row, "row_id", "left").select(
        "doc_id", "text_key", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows of ``docs`` with all their columns in which no benchmark window occurs; the rest goes whole."""
    hit = stage_once(
        contamination(docs, benchmark, window).filter("n_hit > 0").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct(),
        "contaminated",
    )
    keyed = whole_rows(docs)
    clean = keyed.join(hit, keyed["doc_id"].eqNullSafe(hit["_id"]) & (keyed["_row_key"] == hit["_key"]), "left_anti")
    return clean.select("_whole.*")
