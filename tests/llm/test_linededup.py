import random

from pyspark.sql import functions as F

from eventloom.llm import linededup


def near(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(docs):
    """``docs`` in order; the id may repeat only with the same text."""
    order = sorted(set(docs), key=lambda d: (d[0] is None, d[0] or 0))
    first = {}
    for doc, text in order:
        for place, line in enumerate((text or "").split("\n") if text is not None else []):
            if line.strip(" "):
                first.setdefault(line, (len(first), doc, place))
    late = set()
    for line, at in first.items():
        if any(first[o] < at and near(o, line) for o in first if o != line):
            late.add(line)
    kept = {(doc, place) for line, (_, doc, place) in first.items() if line not in late}
    out = []
    for doc, text in docs:
        if text is None:
            out.append((doc, None, 0, 0))
            continue
        lines = text.split("\n")
        stay = [ln for p, ln in enumerate(lines) if not ln.strip(" ") or (doc, p) in kept]
        full = [ln for ln in lines if ln.strip(" ")]
        n = len([ln for ln in stay if ln.strip(" ")])
        out.append((doc, "" if full and not n else "\n".join(stay), len(full), n))
    return sorted(out, key=str)


def rows(df):
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_kept) for r in df.collect()), key=str)


def change(rng, line):
    i = rng.randrange(len(line) + 1)
    return rng.choice([line[:i] + rng.choice("abcé") + line[i:], line[:max(i - 1, 0)] + line[i:], line[:max(i - 1, 0)] + "ß" + line[i:]])


def test_equals_brute_force(frame):
    rng = random.Random(4)
    base = ["".join(rng.choice("ab cé") for _ in range(n)) + "z" for n in (0, 1, 2, 3, 10, 19, 20, 21, 40, 127, 128, 129, 255, 256, 257, 300) for _ in range(3)]
    docs = []
    for i in range(25):
        lines = [rng.choice(base) for _ in range(rng.randint(0, 6))]
        lines = [change(rng, ln) if rng.random() < 0.5 else ln for ln in lines] + rng.choice([[], ["", "  "]])
        docs.append((i, "\n".join(lines)))
    docs += [(50, docs[3][1]), (51, None), (52, ""), (53, "\n\n"), (None, docs[5][1]), (54, docs[8][1]), (54, docs[8][1])]
    assert rows(linededup.dedup_lines(frame(docs, "doc_id BIGINT, text STRING"))) == brute(docs)


def test_every_single_edit_is_found_at_block_borders(frame):
    line = "".join(chr(97 + i * i % 23) + str(i % 10) for i in range(200))
    docs = [(0, line)]
    for i in range(0, len(line) + 1, 3):
        docs += [(1000 + i, line[:i] + "#" + line[i:]), (2000 + i, line[:i] + line[i + 1:]), (3000 + i, line[:i] + "#" + line[i + 1:])]
    out = linededup.dedup_lines(frame(docs, "doc_id BIGINT, text STRING"))
    assert [(r.doc_id, r.text) for r in out.filter("n_kept > 0").collect()] == [(0, line)]


def test_long_lines_empty_table_and_columns(frame, spark):
    long = "".join(chr(97 + (i * 7919) % 26) for i in range(20_000))
    docs = frame(
        [(1, long, 1, "x"), (2, long[:9_000] + long[9_001:], 2, "y"), (3, "short line\nanother", 3, None), (4, None, 4, "z")],
        "doc_id BIGINT, text STRING, parts INT, kept STRING",
    )
    out = linededup.drop_repeated_lines(docs)
    assert out.columns == docs.columns
    assert sorted(tuple(r) for r in out.collect() if r.text is not None) == [(1, long, 1, "x"), (2, "", 2, "y"), (3, "short line\nanother", 3, None)]
    assert linededup.dedup_lines(spark.createDataFrame([], "doc_id BIGINT, text STRING")).count() == 0


def test_lines_of_any_length_are_near(frame):
    docs = [(1, "abcdefghijklmnopqrs"), (2, "abcdefghijklmnopqrst"), (3, "abcdefghijklmnopqrstu"), (4, "x"), (5, "y"), (6, "xyz"), (7, "xy")]
    out = {r.doc_id: r.n_kept for r in linededup.dedup_lines(frame(docs, "doc_id BIGINT, text STRING")).collect()}
    assert out == {1: 1, 2: 0, 3: 0, 4: 1, 5: 0, 6: 1, 7: 0}


def test_edit_bound_is_a_parameter(frame):
    docs = frame([(1, "abcdef"), (2, "abXdYf"), (3, "abXdef"), (4, "zzzz"), (5, "abcdef")], "doc_id BIGINT, text STRING")
    kept = lambda edits: {r.doc_id for r in linededup.dedup_lines(docs, edits=edits).filter("n_kept = 1").collect()}
    assert kept(0) == {1, 2, 3, 4} and kept(1) == {1, 2, 4} and kept(2) == {1, 4}
    assert kept(4) == {1, 4}


def test_many_lines_of_one_variant_are_not_paired(frame, spark):
    lines = [f"{chr(0x4E00 + i)}same ending" for i in range(3000)]
    docs = frame([(i, line) for i, line in enumerate(lines)], "doc_id BIGINT, text STRING")
    texts = docs.select(F.struct("doc_id").alias("first"), *linededup._hash("text"), F.col("text").alias("line"))
    assert linededup._met_within_one(texts).distinct().count() < 2 * len(lines)
    assert linededup.dedup_lines(docs).filter("n_kept = 1").count() == 1
