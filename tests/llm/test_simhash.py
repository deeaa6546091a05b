import random

import numpy as np
import xxhash

from eventloom.llm import simhash
from eventloom.llm.components import components


def brute_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_groups(prints, limit=4):
    label = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if bin(a ^ b).count("1") <= limit and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


def test_fingerprint_equals_brute_force():
    for text in ["", " \t", "one", "One two THREE", "a b c d", "Ünï Straße\x0bİ x y z w", "a " * 500 + "b", "x\x1cy z q r s"]:
        assert simhash.simhash(text.encode()) & (1 << 64) - 1 == brute_print(text)


def test_segment_plan_reaches_every_pair_within_the_distance():
    rng = random.Random(1)
    for distance, segments in ((4, 3), (4, 4), (3, 2), (7, 3), (1, 2), (0, 2)):
        plan = simhash.segment_plan(distance, segments)
        for _ in range(300):
            bits = rng.sample(range(64), rng.randint(0, distance))
            assert any(sum(lo <= b < lo + width for b in bits) <= radius for lo, width, radius in plan)


def test_groups_equal_brute_force(spark):
    rng = random.Random(7)
    values = [rng.getrandbits(64) for _ in range(25)]
    for v in list(values):
        for _ in range(rng.randint(0, 6)):
            v ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5)))
            values.append(v)
    values = sorted(set(values))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.fingerprint_links(spark.createDataFrame([(v,) for v in signed], "fp BIGINT"))
    found = {r.node: r.label for r in components(links).collect()}
    want = brute_groups(values)
    groups = lambda labels: sorted(sorted(signed[i] for i in range(len(signed)) if labels[i] == g) for g in set(labels))
    assert groups([found.get(v, v) for v in signed]) == groups(want)


def test_dense_group_does_not_yield_all_pairs(spark):
    base = 0x0123456789ABCDEF
    dense = [(base ^ bits,) for bits in range(256)]  # all within 8 bits of each other, 256 distinct texts
    links = simhash.fingerprint_links(spark.createDataFrame(dense, "fp BIGINT"))
    assert links.distinct().count() < 10 * len(dense) < 20_736  # pairs within the distance
    assert {r.label for r in components(links).collect()} == {min(d[0] for d in dense)}


def test_edge_rows_and_clashing_columns(frame):
    text = "the quick brown fox jumps over the lazy dog and runs far away from here"
    rows = [(5, text, 1), (2, text, 2), (2, text, 2), (None, text, 3), (7, None, 4), (3, "", 5), (9, " \n", 6), (11, "w" * 100_000, 7)]
    docs = frame(rows, "doc_id BIGINT, text STRING, fp INT").withColumnRenamed("fp", "_row_key")
    out = simhash.simhash_groups(docs)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id, r.fp) for r in out.collect())
    assert len(got) == len(rows)
    assert {g[2] for g in got if g[3] == 0} == {3} and sum(g[3] == 0 for g in got) == 3
    assert {r.component_id for r in out.filter("doc_id IS NULL").collect()} == {2}
    kept = simhash.keep_one_per_group(docs)
    assert kept.columns == docs.columns
    assert sorted(tuple(r) for r in kept.collect()) == [(2, text, 2), (3, "", 5), (11, "w" * 100_000, 7)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id BIGINT, text STRING")
    assert simhash.simhash_groups(docs).count() == 0
    assert simhash.keep_one_per_group(docs).count() == 0


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(1, i) for i in range(200, 300)]
    out = components(spark.createDataFrame(chain + star + [(7, 7)], "a BIGINT, b BIGINT"))
    labels = {r.node: r.label for r in out.collect()}
    assert {labels[i] for i in range(100, 161)} == {100}
    assert {labels[i] for i in range(200, 300)} == {1} and labels[1] == 1
    assert len(labels) == 61 + 101


def test_words_helpers_agree_with_python():
    import pyarrow as pa

    from eventloom.llm import words

    texts = ["", None, "a bb  ccc", " x", "y ", "é—ß a", "A1b,C2;d", "\x0b\x1f z"]
    split = words.split_words(pa.array(texts, pa.string()), words.printed_table(), lower=False)
    got = [[bytes(split.data[s:e]).decode() for s, e in zip(split.starts[a:b], split.ends[a:b])] for a, b in zip(split.first, split.first[1:])]
    assert got == [[w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in t or "").split(" ") if w] for t in texts]
    same = words.word_hashes(words.split_words(pa.array(["p q p", "q"]), words.printed_table(), False))
    assert same[0] == same[2] and same[1] == same[3] and same[0] != same[1]
    # windows never cross rows, and pieces of any size give the same hashes
    long = words.split_words(pa.array(["a b c d e f", "d e f"]), words.printed_table(), False)
    hashes = words.word_hashes(long)
    windows, first = words.window_hashes(hashes, long.first, 3)
    assert list(np.diff(first)) == [4, 1] and windows[3] == windows[4]
    assert (words.span_hashes(long.data, long.starts, long.ends, 7, piece=2) == words.span_hashes(long.data, long.starts, long.ends, 7)).all()
