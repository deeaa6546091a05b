import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from eventloom.llm import trie

SCHEMA = "conv_id BIGINT, turn BIGINT, role STRING, text STRING, depth INT, owner STRING"


def rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own[conv].append((role or "", text or ""))
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - int(np.fmod(c, 5)), [])[:h] + turns[h:]
    return out


def brute(paths):
    """Every node of the trie from whole paths."""
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    children = defaultdict(int)
    for prefix in members:
        if prefix:
            children[prefix[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for prefix, who in members.items():
        for d in range(len(prefix) + 1):
            leaves[prefix[:d]] += children[prefix] == 0
            saved[prefix[:d]] += (len(who) - 1) * len(prefix[-1][1].encode()) if prefix else 0
    digest = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(members[p]) if len(paths[c]) == len(p)).encode()).hexdigest()
    return sorted(
        (min(who), len(p), min(members[p[:-1]]) if p else None, len(who), children[p], leaves[p], saved[p], digest(p)) for p, who in members.items()
    )


def result(spark, out):
    nodes, ends = out
    full = nodes.join(trie.list_digests(ends), ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
    return sorted(tuple(r) for r in full.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


def made(seed, n):
    """Turns with copies, shared starts, a long chain, prefixes of others, nulls and equal rows."""
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        start = rng.choice([[("user", "hello"), ("assistant", "hé")], [("user", "x")], []])
        turns = start + [(rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "", None])) for _ in range(rng.randint(1, 6))]
        rows += [(c, i, r, t, 0, "z") for i, (r, t) in enumerate(turns)]
    rows += [(1000, i, "user", f"t{i % 3}", 0, "z") for i in range(90)] + [(2005 + c, i, "user", f"t{i % 3}", 0, "z") for c in range(12) for i in range(60)]
    rows += [(c, 0, "user", "copied", 1, "q") for c in range(3000, 3060)] + [(None, 0, "user", "nobody", 1, "q")] * 5 + [(-7, None, None, "neg", 1, "q"), (-7, 0, "user", "neg", 1, "q")]
    return rows + [(77, 1, "user", "twice", 1, "q")] * 2


def test_trie_equals_brute_force(spark, frame):
    rows = made(1, 80)
    table = frame(rows, SCHEMA)
    want = brute(rebuilt(rows))
    assert result(spark, trie.trie_of_conversations(table)) == want
    named = trie.ordered_turns(table.filter("conv_id IS NOT NULL"), {"weight": F.octet_length("text").cast("bigint")})
    assert result(spark, trie.conversation_trie(*trie.with_shared_starts(named), local=6)) == want  # components split by joins


def test_empty_table_and_turnless_conversations(spark, frame):
    assert result(spark, trie.trie_of_conversations(frame([], SCHEMA))) == []
    c = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 9 > 1 and c % 5)
    assert result(spark, trie.trie_of_conversations(frame([(c, 0, "user", "gone", 1, "")], SCHEMA))) == brute({c: []})


def test_centroids_halve_components_and_sums_are_exact():
    rng = np.random.default_rng(2)
    for shape in ("chain", "star", "random"):
        n = 3000
        parent = np.array([-1] + [(i - 1) if shape == "chain" else 0 if shape == "star" else int(rng.integers(0, i)) for i in range(1, n)])
        size, sums = np.ones(n, np.int64), rng.integers(-5, 50, (n, 2))
        values = sums.copy()
        for i in range(n - 1, 0, -1):
            size[parent[i]] += size[i]
            sums[parent[i]] += sums[i]
        assert (trie.rollup_block(np.zeros(n), parent, size, values) == sums).all()
        assert size[0] == n  # the input is not changed


def test_lists_longer_than_a_piece(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 7)
    ends = spark.range(0, 100, 1, 5).select(F.lit(4).cast("bigint").alias("conv_id"), (F.col("id") % 3).alias("depth"), (F.col("id") * 37 % 100).alias("member"))
    got = {r.depth: r.ends_sha256 for r in trie.list_digests(ends).collect()}
    for d in range(3):
        ids = sorted(i * 37 % 100 for i in range(100) if i % 3 == d)
        assert got[d] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
