import random
import re

from eventloom.llm import decontaminate

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words_of(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[i:i + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w = words_of(text)
        hit, found = set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(w[i:i + n])]
        out.append((doc, len(w), len(hit), len(found - {None}), sorted(str(f) for f in found if f is not None)))
    return sorted(out, key=str)


def rows(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, list(r["items"])) for r in df.collect()), key=str)


def test_equals_brute_force(frame):
    rng = random.Random(11)
    vocabulary = ["alpha", "Beta", "gamma", "é1", "x", "1a", "ZZ", "delta"]
    text = lambda n: rng.choice([" ", ", ", "-"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([1, 2, 3, 5, 9, 10, 11, 14, 25, 40])]
    items += [(77, None), (78, "..."), (79, items[6][1]), (None, "only here once upon a time there was a benchmark item")]
    docs = [(i, text(rng.randint(0, 60))) for i in range(20)]
    for i, (_, item) in enumerate(items):
        docs.append((200 + i, text(5) + "; " + (item or "") + "! " + text(5)))
    cut = words_of(items[9][1])
    docs += [(300, " ".join(cut[5:15])), (301, " ".join(cut[5:14])), (302, None), (303, ""), (303, ""), (None, items[8][1]), (304, "q " * 30_000 + items[8][1])]
    for picked in (items, items[5:9] + items[10:]):
        got = rows(decontaminate.contamination(frame(docs, "doc_id BIGINT, text STRING"), frame(picked, "item_id BIGINT, text STRING")))
        assert got == brute(docs, picked)


def test_shared_span_is_found_wherever_it_stands(frame):
    rng = random.Random(2)
    shared = [f"s{i}" for i in range(10)]
    docs = [(k, " ".join([f"d{rng.random()}" for _ in range(k)] + shared + [f"e{rng.random()}" for _ in range(rng.randint(0, 9))])) for k in range(60)]
    items = [(1, " ".join(["before"] * 7 + shared + ["after"] * 3))]
    out = decontaminate.contamination(frame(docs, "doc_id BIGINT, text STRING"), frame(items, "item_id BIGINT, text STRING"))
    assert {r.n_hit for r in out.collect()} == {10}


def test_removal_keeps_clean_rows_and_columns(frame, spark):
    passage = "one two three four five six seven eight nine ten eleven"
    docs = frame(
        [(1, "x " + passage, 1), (2, "clean text", 2), (2, "clean text", 2), (None, passage.upper(), 3), (3, None, 4)],
        "doc_id BIGINT, text STRING, _row_key INT",
    )
    items = frame([(4, passage)], "item_id BIGINT, text STRING")
    kept = decontaminate.remove_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted((tuple(r) for r in kept.collect()), key=str) == [(2, "clean text", 2), (2, "clean text", 2), (3, None, 4)]
    none = spark.createDataFrame([], "item_id BIGINT, text STRING")
    assert decontaminate.remove_contaminated(docs, none).count() == 5
    assert decontaminate.contamination(docs.limit(0), items).count() == 0
