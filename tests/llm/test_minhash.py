import hashlib
import random

import numpy as np
import pyarrow as pa

from eventloom.llm import minhash


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(docs):
    order = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0))
    out = []
    for k, (doc, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        out.append((doc, text, text[:len(text) - half] + after[:half], after))
    return out


def test_edited_texts_and_likeness(frame):
    rng = random.Random(6)
    docs = [(i * 3, " ".join(rng.choice(["né", "b", "cc", "Dd"]) + str(rng.randint(0, 99)) for _ in range(rng.randint(0, 120)))) for i in range(80)]
    docs += [(1000, None), (1001, ""), (1002, "𝒳𝒳𝒳 end"), (1003, docs[0][1]), (None, "no id here"), (1004, "long " * 20_000)]
    out = {r.doc_id: r for r in minhash.edited_comparison(frame(docs, "doc_id BIGINT, text STRING")).collect()}
    assert len(out) == len(docs)
    errors = []
    for doc, text, edited, after in brute(docs):
        r = out[doc]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for got, other in ((r.near_edited, edited), (r.near_next, after)):
            a, b = shingles(text), shingles(other)
            errors.append(abs(got - (len(a & b) / len(a | b) if a | b else 1.0)))
    assert max(errors) < 0.2 and np.mean(errors) < 0.04
    assert out[0].fingerprint == out[1003].fingerprint
    assert out[1000].fingerprint == out[1001].fingerprint == "f" * 512


def test_repeated_and_equal_ids_single_row_and_empty(frame, spark):
    docs = frame([(1, "a b c"), (1, "a b c"), (1, "x y"), (2, None), (2, None)], "doc_id BIGINT, text STRING")
    assert minhash.edited_comparison(docs).count() == 5
    one = minhash.edited_comparison(frame([(4, "alone here")], "doc_id BIGINT, text STRING")).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"alonealone").hexdigest()
    assert minhash.edited_comparison(spark.createDataFrame([], "doc_id BIGINT, text STRING, chunk INT")).count() == 0


def test_signature_estimates_jaccard():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(4000)]
    for share in (0.2, 0.5, 0.8, 0.95):
        base = [rng.choice(words) for _ in range(600)]
        other = base[:int(600 * share)] + [rng.choice(words) for _ in range(600 - int(600 * share))]
        a, b = " ".join(base), " ".join(other)
        s = minhash.signatures(pa.array([a, b]))
        want = len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
        assert abs(float(minhash.likeness(s[:1], s[1:])[0]) - want) < 0.15


def test_near_copies_equal_brute_force(frame, spark):
    rng = random.Random(15)
    docs = []
    for i in range(12):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(3, 90))]
        docs.append((len(docs) * 2 + 1, " ".join(base)))
        for _ in range(rng.randint(0, 5)):
            for _ in range(rng.randint(0, 2)):
                base[rng.randrange(len(base))] = f"x{rng.randint(0, 99)}"
            docs.append((len(docs) * 2 + 1, " ".join(base)))
    docs += [(500, docs[0][1]), (500, docs[0][1]), (None, docs[1][1]), (601, None), (600, ""), (602, " \n"), (603, "one two"), (604, "One  two")]
    sets = [shingles(t) for _, t in docs]
    label = list(range(len(docs)))
    for _ in docs:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a == b or (a | b and len(a & b) / len(a | b) >= 0.8):
                    label[i] = label[j] = min(label[i], label[j])
    least = {g: min((d for (d, _), k in zip(docs, label) if k == g and d is not None), default=None) for g in set(label)}
    got = minhash.near_copies(frame(docs, "doc_id BIGINT, text STRING"))
    assert sorted(map(str, ((r.doc_id, r.component_id) for r in got.collect()))) == sorted(str((d, least[g])) for (d, _), g in zip(docs, label))
    assert minhash.near_copies(spark.createDataFrame([], "doc_id BIGINT, text STRING, bands INT")).count() == 0


def test_fingerprints_carry_the_near_copy_class(frame, spark, tmp_path):
    from eventloom.llm.queries import QUERIES

    words = [f"w{i}" for i in range(80)]
    docs = [(i, " ".join(words[:79] + [f"end{i}"])) for i in range(8)] + [(20, "other text of a few words"), (21, None), (22, ""), (22, ""), (None, " ".join(words))]
    frame(docs, "doc_id BIGINT, text STRING").write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["op6_minhash_fingerprints"](spark, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.component_id) for r in out), key=str) == sorted(
        [(i, 0) for i in range(8)] + [(20, 20), (21, 21), (22, 21), (22, 21), (None, 0)], key=str)
    assert all(len(r.fingerprint) == 512 for r in out)


def test_signature_equals_plain_minhash():
    """All 128 values from universal hashes of every shingle value, one at a time."""
    texts = ["a b c d e f g a b c d e f", "one two", "", None, "x " * 300 + "end"]
    a, b = minhash.coefficients(minhash.PERMUTATIONS)
    values, first = minhash.shingle_values(pa.array(texts, pa.string()), minhash.SHINGLE)
    got = minhash.signatures(pa.array(texts, pa.string()))
    for row, (low, high) in enumerate(zip(first, first[1:])):
        for p in range(minhash.PERMUTATIONS):
            hashed = [(int(a[p]) * int(v) + int(b[p])) % (1 << 64) for v in values[low:high]]
            assert got[row, p] == ((min(hashed) >> 32) & 0xFFFF if hashed else 0xFFFF)


def test_two_groups_that_share_bands_yield_pairs_in_proportion(spark, frame, monkeypatch):
    made = []
    plain = minhash._likeness_of
    monkeypatch.setattr(minhash, "_likeness_of", lambda pairs, sets: (made.append(pairs.count()), plain(pairs, sets))[1])
    common = [f"c{i}" for i in range(200)]
    left, right = common + [f"l{i}" for i in range(70)], common + [f"r{i}" for i in range(70)]
    bands = [set(minhash._band_keys(minhash.signatures(pa.array([" ".join(w)])))[0].tolist()) for w in (left, right)]
    assert bands[0] & bands[1]  # else the test shows nothing
    counts = []
    for n in (40, 160):
        made.clear()
        docs = [(i, " ".join(left + [f"e{i}"])) for i in range(n)] + [(n + i, " ".join(right + [f"f{i}"])) for i in range(n)]
        labels = {r.doc_id: r.component_id for r in minhash.near_copies(frame(docs, "doc_id BIGINT, text STRING")).collect()}
        assert all(labels[i] == (0 if i < n else n) for i in range(2 * n))
        counts.append(sum(made))
    assert counts[1] < 6 * counts[0]


def test_hot_and_missing_ids_are_cut_by_text(spark):
    docs = spark.range(0, 6000, 1, 6).selectExpr("IF(id % 3 = 0, NULL, IF(id % 3 = 1, 77, id)) AS doc_id", "concat('w', id % 2500, ' x y z') AS text")
    signed = minhash.signed_rows(docs, permutations=128)
    placed = minhash._placed(signed, *minhash._cuts(signed, 16))
    assert placed.groupBy("chunk", "part").count().agg({"count": "max"}).first()[0] < 1500
    assert minhash.edited_comparison(docs).count() == 6000


def test_outer_texts_meet_their_like_by_differences(spark):
    """Brute force over edited copies of two originals, an empty set and sets far from all: who has a like, meets one."""
    rng = random.Random(21)
    sets = {}
    for center in (0, 1):
        base = [rng.randint(0, 10**6) for _ in range(60)]
        for k in range(60):
            own = [v for v in base if rng.random() > 0.04 * (k % 5)] + [rng.randint(0, 40) for _ in range(k % 7)]
            sets[len(sets)] = set(own)
    sets[len(sets)] = set()
    sets[len(sets)] = {5_000_000 + v for v in range(30)}
    inner = [(c, a) for c in (0, 1) for a in range(60 * c, 60 * c + 60) if a % 2]
    outer = [(c, a) for c in (0, 1) for a in sets if a % 2 == 0] + [(0, 121), (1, 121)]
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    frame = spark.createDataFrame([(a, sorted(v)) for a, v in sets.items()], "text_key BIGINT, shingles ARRAY<INT>")
    ends = [spark.createDataFrame(rows, "center BIGINT, a BIGINT") for rows in (inner, outer)]
    met = {(r.a, r.b) for r in minhash._by_differences(*ends, frame, 0.2 / 1.8).collect()}
    found = 0
    for center, b in outer:
        mates = [a for c, a in inner if c == center and alike(a, b)]
        found += bool(mates)
        assert not mates or any((a, b) in met for a in mates), b
    assert 20 < found < len(outer) and len(met) < len(inner) * len(outer) / 4
