import random

from eventloom.llm import warc
from pyspark.sql import functions as F

SCHEMA = "record_id BIGINT, kind STRING, url STRING, time BIGINT, status INT, headers MAP<STRING, STRING>, digest STRING"


def test_canonical_url(spark):
    cases = {
        "HTTP://WWW.Example.com:80/a/b/?utm_source=x&q=1&ref=y#frag": "example.com/a/b?q=1", "https://user:pw@h.org/": "h.org",
        "https://h.org?gclid=1": "h.org", "no scheme": "no scheme", "": "", "https://h.org:8080/A//": "h.org:8080/A", "http://h/x?utm_a": "h/x",
    }
    df = spark.createDataFrame([(k,) for k in [*cases, None]], "u STRING").select("u", warc.canonical_url(F.col("u")).alias("c"))
    assert {r.u: r.c for r in df.collect()} == {**cases, None: None}


def brute(records):
    out = []
    for i, kind, url, time, _, headers, _ in records:
        if kind != "revisit":
            continue
        full = [r for r in records if r[1] == "response" and r[4] == 200 and r[2] is not None and r[2] == url and None not in (r[3], time) and r[3] < time]
        if not full:
            out.append((i, "no_response", None))
            continue
        best = max(full, key=lambda r: (r[3], r[0]))
        mine, stored = headers or {}, best[5] or {}
        pair = next(((mine[k], stored[k]) for k in ("etag", "last-modified") if k in mine and k in stored), None)
        same = pair and pair[0].removeprefix("W/") == pair[1].removeprefix("W/")
        outcome = "no_validator" if pair is None else "resolved" if same else "mismatch"
        out.append((i, outcome, best[0] if outcome == "resolved" else None))
    return sorted(out)


def test_equals_brute_force_also_on_one_hot_url(frame):
    rng = random.Random(12)
    records = []
    for i in range(900):
        url = "h.org/hot" if i % 3 == 0 else rng.choice(["h.org/a", "h.org/b", "g.net", None])
        kind = rng.choice(["response", "revisit", "revisit", "request"])
        headers = rng.choice([{"etag": rng.choice(['"1"', 'W/"1"', '"2"'])}, {"last-modified": rng.choice("xy")}, {}, None, {"etag": '"1"', "last-modified": "x"}])
        records.append((i, kind, url, rng.choice([None, *[rng.randint(0, 3000)] * 20]), rng.choice([200, 200, 200, 404, None]), headers, f"d{i}"))
    for slots in (1, 7, 512):
        got = sorted((r.record_id, r.outcome, r.resolved_id) for r in warc.resolve_revisits(frame(records, SCHEMA), slots).collect())
        assert got == brute(records)


def test_headers_ties_and_repeats(frame, spark):
    records = [
        (1, "response", "http://h/x", 5, 200, {"Content-Type": "text/html", "etag": '"1"', "date": "old", "content-length": "9"}, "body1"),
        (2, "response", "https://www.h/x/", 5, 200, {"content-type": "text/plain", "etag": '"1"'}, "body2"),
        (3, "revisit", "h://h/x", 6, 304, {"etag": 'W/"1"', "date": "new", "content-length": "0", "set-cookie": "c"}, None),
        (3, "revisit", "h://h/x", 6, 304, {"etag": 'W/"1"', "date": "new", "content-length": "0", "set-cookie": "c"}, None),
        (4, "revisit", "h://h/x", 5, 304, None, None),
    ]
    out = warc.resolve_revisits(frame(records, SCHEMA).withColumn("slot", F.lit(1)).withColumn("found", F.lit(2))).collect()
    three = [r for r in out if r.record_id == 3]
    assert len(three) == 2 and {r.resolved_id for r in three} == {2} and three[0].digest == "body2"
    assert three[0].headers == {"content-type": "text/plain", "etag": 'W/"1"', "date": "new"}
    assert [r.outcome for r in out if r.record_id == 4] == ["no_response"]
    assert warc.resolve_revisits(spark.createDataFrame([], SCHEMA)).count() == 0


def test_header_names_in_any_case_and_times_far_off(frame):
    records = [
        (1, "response", "http://h/x", 5, 200, {"ETag": '"1"', "Server": "a", "server": "b", "Date": "old"}, "body1"),
        (2, "revisit", "http://h/x", 6, 304, {"ETAG": '"1"', "date": "new", "Date": "newer"}, None),
        (3, "response", "http://h/z", -(1 << 60), 200, {}, "bogus"), (4, "response", "http://h/z", 1 << 60, 200, {}, "bogus"),
    ]
    out = warc.resolve_revisits(frame(records, SCHEMA)).collect()
    assert [(r.record_id, r.outcome, r.resolved_id) for r in out] == [(2, "resolved", 1)]
    assert out[0].headers == {"etag": '"1"', "server": "a", "date": "newer"}
    hot = [(i, "response" if i % 2 else "revisit", "http://h/x", i, 200, {"etag": "1"}, "d") for i in range(2000)] + [(9999, "response", "http://h/x", 1 << 60, 200, {}, "d")]
    assert warc.resolve_revisits(frame(hot, SCHEMA)).filter("outcome = 'resolved'").count() == 999
