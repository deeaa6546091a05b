"""Byte-level BPE by replaying merges over a block of the corpus at once.

A block is one Arrow batch of documents. Its distinct words (matches of the split pattern) are laid out one
after another as byte tokens. An inverted index from the rank of a mergeable pair to the places where the
pair stands drives the replay: ranks are taken in ascending order, a rank's places are merged together, and
only the pairs with touched neighbours are looked up and indexed again.
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.words import blocks

#: Words whose ids a task remembers; beyond it, the memory is emptied and the words are merged again.
KEPT_WORDS = 100_000
#: Bytes of text whose words are numbered and merged at a time.
BLOCK_BYTES = 4 << 20
#: Words of one output batch.
PIECE = 1 << 17


class Ranks:
    """Lookup tables of a rank file: token bytes, and the rank that each mergeable pair of tokens becomes."""

    def __init__(self, raw: bytes):
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in raw.splitlines() if line)}
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        pairs = {}
        for token, rank in ranks.items():
            self.tokens[rank] = token
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.byte_pairs = np.array([[ranks.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)], np.int32)
        sizes = np.array([len(t) for t in self.tokens], np.int64)
        self.token_starts = np.concatenate([[0], np.cumsum(sizes)])
        self.token_data = np.frombuffer(b"".join(self.tokens), np.uint8)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's merge, -1 if it has none."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], -1)

    def merge_one(self, word: bytes) -> list[int]:
        """Least-rank-first merging of a single word, for words where the order within the word matters."""
        parts = [word[i:i + 1] for i in range(len(word))]
        while True:
            ranked = [(self.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.ranks]
            if not ranked:
                return [self.ranks[p] for p in parts]
            _, i = min(ranked)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]


@lru_cache(maxsize=4)
def tables(raw: bytes) -> Ranks:
    return Ranks(raw)


def _apart(places: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Of places whose pairs overlap in chains, every other one, from the left."""
    if len(places) < 2:
        return places
    joined = np.concatenate([[False], following[places[:-1]] == places[1:]])
    if not joined.any():
        return places
    at = np.arange(len(places))
    heads = np.maximum.accumulate(np.where(joined, 0, at))
    return places[(at - heads) % 2 == 0]


def replay(words: list[bytes], ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words, one after another, and per word the index of its first id."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    n = int(starts[-1])
    data = np.frombuffer(b"".join(words), np.uint8)
    ids = ranks.of_byte[data]
    following, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    filled = sizes > 0
    following[starts[1:][filled] - 1] = -1
    before[starts[:-1][filled]] = -1
    alive = np.ones(n, bool)
    rank = np.full(n, -1, np.int32)
    rank[:-1] = ranks.byte_pairs[data[:-1], data[1:]]
    rank[starts[1:][filled] - 1] = -1
    del data
    index: dict[int, list[np.ndarray]] = {}
    queue: list[int] = []
    odd: list[np.ndarray] = []

    def add(places: np.ndarray) -> None:
        places = places[rank[places] >= 0]
        order = places[np.argsort(rank[places], kind="stable")]
        found = rank[order]
        cuts = np.flatnonzero(found[1:] != found[:-1]) + 1
        for part in np.split(order, cuts) if len(order) else ():
            r = int(rank[part[0]])
            if r in index:
                index[r].append(part)
            else:
                index[r] = [part]
                heapq.heappush(queue, r)

    add(np.flatnonzero(rank >= 0))
    while queue:
        r = heapq.heappop(queue)
        listed = index.pop(r)
        places = listed[0] if len(listed) == 1 else np.unique(np.concatenate(listed))
        places = places[rank[places] == r]
        places = _apart(places, following)
        if not len(places):
            continue
        gone = following[places]
        after = following[gone]
        ids[places] = r
        following[places] = after
        alive[gone] = False
        rank[gone] = -1
        inner = after >= 0
        before[after[inner]] = places[inner]
        left = before[places]
        touched = np.unique(np.concatenate([places, left[left >= 0]]))
        right = following[touched]
        rank[touched] = np.where(right >= 0, ranks.lookup(ids[touched], ids[right]), -1)
        early = touched[(rank[touched] >= 0) & (rank[touched] < r)]
        if len(early):
            odd.append(early)
        add(touched)
    firsts = np.concatenate([[0], np.cumsum(alive, dtype=np.int32)])[starts].astype(np.int64)
    ids = ids[alive]
    if odd:
        # A merge made a pair of lower rank, which a word must take before its other pairs of the first rank.
        again = np.unique(np.searchsorted(starts, np.concatenate(odd), "right") - 1)
        pieces = [ids[a:b] for a, b in zip(firsts[:-1], firsts[1:])]
        for w in again.tolist():
            pieces[w] = np.array(ranks.merge_one(words[w]), np.int32)
        firsts = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
        ids = np.concatenate(pieces)
    return ids, firsts


class _Numbers(dict):
    """Numbers words in the order they first come."""

    def __missing__(self, word):
        number = self[word] = len(self)
        return number


def _gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``values`` one after another, and the bounds of the runs."""
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    return values[np.repeat(starts - bounds[:-1], sizes) + np.arange(bounds[-1])], bounds


def _split_pattern(pattern: str) -> regex.Pattern:
    """The pattern with white space as Unicode defines it, as the rank files' splitter reads it."""
    return regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


def _spelled(ids: np.ndarray, rows: np.ndarray, ranks: Ranks) -> pa.Array:
    """Bytes of the ids of every row, from their tokens."""
    starts = ranks.token_starts[ids]
    data, cuts = _gather(ranks.token_data, starts, ranks.token_starts[ids + 1] - starts)
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(rows) - 1, [None, pa.py_buffer(cuts[rows].astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))],
    ).cast(pa.binary())


def _encoder(raw, pattern: str, decoded: bool = False):
    def encode(batches):
        ranks, split = tables(raw.value), _split_pattern(pattern)
        numbers = _Numbers()
        ids, firsts = np.zeros(0, np.int32), np.zeros(1, np.int64)
        for batch in batches:
            for start, stop in blocks(batch.column(batch.num_columns - 1), BLOCK_BYTES):
                if len(numbers) > KEPT_WORDS:
                    numbers, ids, firsts = _Numbers(), np.zeros(0, np.int32), np.zeros(1, np.int64)
                known = len(numbers)
                block = batch.slice(start, stop - start)
                at = [
                    np.fromiter(
                        map(numbers.__getitem__, split.findall(t) if len(t) < 1 << 20 else (m.group() for m in split.finditer(t))), np.int32,
                    )
                    for t in (text.as_py() or "" for text in block.column(block.num_columns - 1))
                ]
                new, new_firsts = replay([w.encode() for w in islice(numbers, known, None)], ranks)
                firsts = np.concatenate([firsts, new_firsts[1:] + len(ids)])
                ids = np.concatenate([ids, new])
                del new, new_firsts
                bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, at), np.int64, len(at)))])
                low = 0
                while low < len(at):
                    high = min(max(int(np.searchsorted(bounds, bounds[low] + PIECE, "right")) - 1, low + 1), len(at))
                    numbered = np.concatenate(at[low:high])
                    values, cuts = _gather(ids, firsts[numbered], firsts[numbered + 1] - firsts[numbered])
                    rows = cuts[bounds[low:high + 1] - bounds[low]]
                    lists = pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), pa.array(values))
                    part = block.slice(low, high - low)
                    columns, names = [*part.columns[:-1], lists], [*batch.schema.names[:-1], "ids"]
                    if decoded:
                        columns, names = [*columns, _spelled(values, rows, ranks)], [*names, "decoded"]
                    yield pa.RecordBatch.from_arrays(columns, names=names)
                    low = high

    return encode


def encode(docs: DataFrame, rank_file: str, pattern: str, column: str = "text", decoded: bool = False) -> DataFrame:
    """``docs`` with ``column`` replaced by ``ids`` (array of token ids), at the end; other columns pass.

    Ids are those of the rank file's tokenizer without special tokens: each match of ``pattern`` is merged
    separately, least rank first. NULL and empty texts have no ids. Repeated rows repeat. A column that is
    already named ``ids`` is replaced. An empty table gives no rows. The rank file is read by the driver and
    broadcast; its size is the vocabulary's, not the corpus's. With ``decoded`` the same pass also decodes the ids, as
    ``decode`` does, which spares a second set of Python workers.
    """
    with open(rank_file, "rb") as f:
        raw = docs.sparkSession.sparkContext.broadcast(f.read())
    others = [c for c in docs.columns if c not in (column, "ids", *(["decoded"] if decoded else []))]
    text = "_" * (1 + max(map(len, docs.columns)))  # longer than any name, so it clashes with none
    picked = docs.select(*[F.col(f"`{c}`") for c in others], F.col(column).alias(text))
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1]), "ids ARRAY<INT>", *(["decoded BINARY"] if decoded else [])])
    return picked.mapInArrow(_encoder(raw, pattern, decoded), fields)


def _decoder(raw):
    def decode(batches):
        ranks = tables(raw.value)
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            if lists.null_count:
                lists = lists.fill_null([])
            offsets = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset:lists.offset + len(lists) + 1].astype(np.int64)
            low = 0
            while low < len(lists):
                high = min(max(int(np.searchsorted(offsets, offsets[low] + PIECE, "right")) - 1, low + 1), len(lists))
                ids = lists.slice(low, high - low).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                out = _spelled(ids, offsets[low:high + 1] - offsets[low], ranks)
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([*part.columns, out], names=[*batch.schema.names, "decoded"])
                low = high

    return decode


def decode(encoded: DataFrame, rank_file: str) -> DataFrame:
    """``encoded`` with ``decoded``, the bytes that its column ``ids`` stands for; NULL ids give no bytes.

    Bytes, since ids need not end at a character's end. A column named ``decoded`` is replaced.
    """
    with open(rank_file, "rb") as f:
        raw = encoded.sparkSession.sparkContext.broadcast(f.read())
    others = [c for c in encoded.columns if c not in ("ids", "decoded")]
    picked = encoded.select(*[F.col(f"`{c}`") for c in others], "ids")
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields), "decoded BINARY"])
    return picked.mapInArrow(_decoder(raw), fields)
