import random
import re
import time

from pyspark.sql import functions as F

from eventloom.llm import secrets

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def brute_base(text):
    text = text or ""
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), m.end(), 1) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), m.end(), 2) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


def test_base_spans_equal_python(frame):
    rng = random.Random(9)
    pieces = [
        "password=hunter2222", "PassWord : 'x'", "secret: token: abcdefghijkl", "token=token=abcdefgh", "api_key=\"Zz09+/_.=-\"", "apikey=1234567",
        "AKIA" + "A1" * 6, "AKIA" + "A" * 11, "xAKIAAKIA0123456789", "0123456789abcdef" * 2, "g" + "0" * 31 + "h", "f" * 80, "é𝒳ß ", "\n", "passwd =",
        "ſecret=abcdefgh", "TOKEN:=abcdefgh",
    ]
    docs = [(i, rng.choice(["", " ", "é"]).join(rng.choice(pieces) for _ in range(rng.randint(0, 12))), "s", "en") for i in range(80)]
    docs += [(200, None, None, None), (201, "", "s", None), (None, pieces[0], "s", "en"), (202, "pad " * 30_000 + pieces[0], "s", "en")]
    out = secrets.find_secrets(frame(docs, "doc_id BIGINT, text STRING, source STRING, lang STRING")).collect()
    want = {d[0]: brute_base(d[1]) for d in docs}
    assert len(out) == len(docs)
    for r in out:
        assert sorted((s.start, s.stop, s.kind) for s in r.base) == want[r.doc_id]
        assert {tuple(s) for s in r.base} <= {tuple(s) for s in r.spans}


def test_ownership_separates_copied_from_live(frame):
    copied, live, bare, shared = "Ab3dEf6hIj9kLm2n", "Zx8cVb5nMq1wEr4t", "Qw7eRt2yUi5oPa9sDf3g", "Kl4jHg7fDs1aPo6iUy2t"
    docs = [(i, f"password={copied}", f"owner{i % 4}", "en") for i in range(12)]
    docs += [(20, f"key {live} password={live}", "owner1", "en"), (21, f"password={live}", "owner1", "de"), (22, f"see {bare} here", "owner2", "en")]
    docs += [(23, f"see {shared} here", "owner1", "en"), (24, f"see {shared} here", "owner2", "en"), (25, "thisisaverylongplainwordwithoutdigits", "owner1", "en")]
    out = {r.doc_id: r for r in secrets.find_secrets(frame(docs, "doc_id BIGINT, text STRING, source STRING, lang STRING")).collect()}
    assert all(out[i].copied and not out[i].live for i in range(12))
    assert [s.value for s in out[20].live] == [live] and not out[20].copied and out[21].live
    assert [(s.kind, s.value) for s in out[22].spans] == [(3, bare)] and not out[22].base
    assert not out[23].spans and not out[24].spans and not out[25].spans


def test_one_value_in_a_third_of_rows_and_empty_table(frame, spark):
    docs = [(i, "token=" + ("common-example-1" if i % 3 == 0 else f"value-number-{i:06d}x"), f"o{i % 5}", "en") for i in range(900)]
    out = secrets.find_secrets(frame(docs, "doc_id BIGINT, text STRING, source STRING, lang STRING"))
    assert out.filter("size(copied) = 1").count() == 300 and out.filter("size(base) = 1").count() == 900
    assert secrets.find_secrets(spark.createDataFrame([], "doc_id BIGINT, text STRING, source STRING, lang STRING, base INT, hash INT")).count() == 0


def test_repositories_decide_within_one_owner(frame):
    spread, few, between = "Ab3dEf6hIj9kLm2nOp", "Zx8cVb5nMq1wEr4tYu", "Qw7eRt2yUi5oPa9sDf"
    docs = [(i, f"see {spread} here", "owner1", f"l{i}") for i in range(50)]
    docs += [(100 + i, f"see {few}AA here", "owner1", f"l{i}") for i in range(2)] + [(200 + i, f"see {between}AA here", "owner1", f"l{i}") for i in range(3)]
    docs += [(300 + i, f"password={few}", f"owner{i + 2}", "en") for i in range(2)]
    out = {r.doc_id: r for r in secrets.find_secrets(frame([(i, t.replace(spread, spread + "AA"), s, g) for i, t, s, g in docs], "doc_id BIGINT, text STRING, source STRING, lang STRING")).collect()}
    assert all(out[i].copied and not out[i].live and not out[i].spans for i in range(50))
    assert all(out[100 + i].live and out[100 + i].spans for i in range(2))
    assert not any(out[200 + i].live or out[200 + i].copied for i in range(3))
    assert not any(out[300 + i].live or out[300 + i].copied for i in range(2))  # two owners: neither


def test_text_with_many_matches_takes_time_in_proportion(frame):
    text = " ".join(f"password=hunter{i:08d} see Qw7eRt2yUi5oPa{i:08d}" for i in range(32_000))
    docs = frame([(1, text, "s", "en")], "doc_id BIGINT, text STRING, source STRING, lang STRING").coalesce(1).cache()
    docs.count()
    began = time.time()
    r = secrets.find_secrets(docs).select("doc_id", "base", F.size("spans").alias("n")).first()
    assert time.time() - began < 25
    assert sorted((s.start, s.stop, s.kind) for s in r.base) == brute_base(text) and r.n == 64_000
