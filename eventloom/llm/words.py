"""Vectorised word splitting and hashing over whole Arrow batches of UTF-8 text.

Both word classes used here depend on ASCII bytes alone (every byte of a longer UTF-8 sequence belongs
to a word), so splitting works on the raw bytes of a batch without making one Python string per word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15)
MASK = (1 << 64) - 1


def alnum_table() -> np.ndarray:
    """Bytes of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``: digits, a-z and everything beyond ASCII."""
    table = np.zeros(256, dtype=bool)
    table[0x30:0x3A] = table[0x61:0x7B] = table[0x80:] = True
    return table


def printed_table() -> np.ndarray:
    """Bytes of ``[^\\x20\\x09-\\x0D]``: everything but ASCII white space."""
    table = np.ones(256, dtype=bool)
    table[0x20] = table[0x09:0x0E] = False
    return table


def lower_table() -> np.ndarray:
    """Byte map that lower-cases A-Z only."""
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 0x20
    return table


@dataclass
class Words:
    """Words of one batch: byte spans in ``data``, and per row the index of its first word."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # length rows + 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the row offsets into them; null rows are empty."""
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def split_words(column: pa.Array, table: np.ndarray, lower: bool) -> Words:
    """Words of every row; a word never crosses a row."""
    data, offsets = text_bytes(column)
    if lower:
        data = lower_table()[data]
    inside = table[data]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    filled = offsets[:-1] < offsets[1:]
    heads, tails = offsets[:-1][filled], offsets[1:][filled] - 1
    begins[heads] = inside[heads]
    stops[tails] = inside[tails]
    starts = np.flatnonzero(begins)
    return Words(data, starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def inverse(base: int) -> int:
    """Inverse of an odd number modulo 2**64."""
    return pow(base, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int, piece: int = 1 << 21) -> np.ndarray:
    """Polynomial hash of ``values[start:end]`` per ascending span, from prefix sums; ``piece`` values at a time."""
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        low = int(starts[at])
        stop = max(int(np.searchsorted(ends, low + piece, "right")), at + 1)
        high = int(ends[stop - 1])
        size = high - low
        sums = np.zeros(size + 1, dtype=np.uint64)
        np.cumsum(values[low:high].astype(np.uint64) * powers(base, size), out=sums[1:])
        s = starts[at:stop] - low
        out[at:stop] = (sums[ends[at:stop] - low] - sums[s]) * powers(inverse(base), size + 1)[s]
        at = stop
    return out


def word_hashes(words: Words, seed: int = 1) -> np.ndarray:
    """One well-mixed 64-bit hash per word; equal words give equal hashes in every batch."""
    base = (int(BASE) * (2 * seed + 1)) & MASK
    shifted = words.data.astype(np.uint16) + 1
    lengths = (words.ends - words.starts).astype(np.uint64)
    return mix(span_hashes(shifted, words.starts, words.ends, base) + lengths * BASE)


def window_hashes(hashes: np.ndarray, first: np.ndarray, size: int, seed: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Rolling (Rabin-Karp) hash of every ``size`` consecutive words of one row, and per row its first window."""
    n = len(hashes)
    per_row = np.maximum(np.diff(first) - size + 1, 0)
    starts_of_rows = np.concatenate([[0], np.cumsum(per_row)])
    if not per_row.sum():
        return np.zeros(0, dtype=np.uint64), starts_of_rows
    base = (int(BASE) * (2 * seed + 1)) & MASK
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(hashes * powers(base, n), out=sums[1:])
    at = np.repeat(first[:-1] - starts_of_rows[:-1], per_row) + np.arange(starts_of_rows[-1])
    return mix((sums[at + size] - sums[at]) * powers(inverse(base), n + 1)[at]), starts_of_rows


def blocks(column: pa.Array, limit: int = 8 << 20):
    """Row ranges of a batch holding about ``limit`` bytes of text each, so that scratch arrays stay small."""
    _, offsets = text_bytes(column)
    at = 0
    while at < len(column):
        stop = max(int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1, at + 1)
        yield at, min(stop, len(column))
        at = stop
