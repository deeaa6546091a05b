import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from eventloom.llm import substrings


def brute(docs, size):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in docs]
    seen = Counter(tuple(w[k:k + size]) for _, w in words for k in range(len(w) - size + 1))
    out = []
    for i, w in words:
        gone = {j for k in range(len(w) - size + 1) if seen[tuple(w[k:k + size])] > 1 for j in range(k, k + size)}
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=str)


def corpus(rng, n):
    vocabulary = [f"w{i}é" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    docs = []
    for i in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 90))]
        if i % 3 == 0:
            a = rng.randint(0, 20)
            w[len(w) // 2:len(w) // 2] = passage[a:a + rng.randint(20, 40)]
        docs.append((i, "\n ".join(w)))
    return docs


def test_equals_brute_force(frame):
    docs = corpus(random.Random(3), 60)
    docs += [(100, docs[0][1]), (100, docs[0][1]), (101, "a b " * 60), (102, None), (103, ""), (104, " \t "), (None, docs[3][1]), (105, "x" * 70_000)]
    for size in (5, 35):
        out = substrings.remove_repeated(frame(docs, "doc_id BIGINT, text STRING"), size)
        assert sorted((tuple(r) for r in out.collect()), key=str) == brute(docs, size)


def test_document_of_many_blocks(frame):
    rng = random.Random(5)
    long = [f"v{rng.randint(0, 10**9)}" for _ in range(150_000)]
    docs = [(1, " ".join(long)), (2, " ".join(long[65_500:65_600])), (3, " ".join(long[140_000:140_050]) + " end")]
    out = {r.doc_id: r for r in substrings.remove_repeated(frame(docs, "doc_id BIGINT, text STRING"), 35).collect()}
    assert out[1].n_words == 150_000 and out[1].n_removed == 150
    assert out[2].kept_text == "" and out[3].kept_text == "end"
    assert out[1].kept_text == " ".join(long[:65_500] + long[65_600:140_000] + long[140_050:])


def test_empty_table_and_clashing_columns(spark, frame):
    assert substrings.remove_repeated(spark.createDataFrame([], "doc_id BIGINT, text STRING")).count() == 0
    docs = frame([(1, "a b c a b c", 9, "k")], "doc_id BIGINT, text STRING, spans INT, text_key STRING")
    assert [tuple(r) for r in substrings.remove_repeated(docs, 3).collect()] == [(1, 6, 6, "")]


def test_a_window_is_sent_once_per_block(frame):
    docs = frame([(i, "0 " * 100_000 + f"end{i}") for i in range(3)], "doc_id BIGINT, text STRING")
    rows = docs.selectExpr("doc_id", "doc_id AS text_key", "text")
    sent = rows.mapInArrow(substrings._scanner(35, 256), substrings.SENT).selectExpr("sum(length(hashes)) / 7 AS n").first()
    assert sent.n < 100  # three texts of two blocks, each with one window of zeros and the one at the end
    out = {r.doc_id: r for r in substrings.remove_repeated(docs.union(frame([(9, "x " + "0 " * 35 + "y")], "doc_id BIGINT, text STRING"))).collect()}
    assert [(out[i].n_removed, out[i].kept_text) for i in (0, 1, 2, 9)] == [(100_000, f"end{i}") for i in range(3)] + [(35, "x y")]


def test_buckets_follow_the_bytes_of_text(frame, monkeypatch):
    docs = corpus(random.Random(9), 60) + [(100, None), (101, "")]
    rows = frame(docs, "doc_id BIGINT, text STRING")
    size = sum(len((t or "").encode()) for _, t in docs)
    assert substrings.bucket_count(rows) == substrings.bucket_count(rows.limit(0)) == 256
    assert substrings.bucket_count(rows, size // 900) == 1024 and substrings.bucket_count(rows, size // 5000) == 8192
    counted = substrings.bucket_count
    monkeypatch.setattr(substrings, "bucket_count", lambda d: counted(d, size // 5000))
    assert sorted((tuple(r) for r in substrings.remove_repeated(rows, 5).collect()), key=str) == brute(docs, 5)


def test_a_bucket_in_several_chunks():
    words = [np.array([0x1003, 0x2003, 0x3003], np.uint64), np.array([0x4003, 0x2003], np.uint64), np.array([0x3003, 0x5003], np.uint64)]
    table = pa.Table.from_batches([substrings._send(w, block, 256)[0] for block, w in enumerate(words)])
    assert table.column("hashes").num_chunks == 3
    found = substrings._repeated(table).to_pylist()
    assert [(r["block"], np.frombuffer(r["places"], "<u2").tolist()) for r in found] == [(0, [1, 2]), (1, [1]), (2, [0])]
