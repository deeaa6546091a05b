from eventloom.llm import urlgraph
from eventloom.llm.queries import URL_RULES
from pyspark.sql import functions as F


def test_hosts_paths_and_rules(frame):
    cases = {
        "http://A.Example.NET/en/1?q#f": ("a.example.net", "/en/1", "example.net/en/", "allow"), "https://example.net/En/": ("example.net", "/En/", "net/", "block"),
        "https://notexample.net": ("notexample.net", "", None, "allow"), "x://net/": ("net", "/", "net/", "block"), "https://h.org/fr/a": ("h.org", "/fr/a", "org/fr/", "allow"),
        "https://example.com/de/?x": ("example.com", "/de/", "example.com/de/", "block"), "https://badexample.com/de/": ("badexample.com", "/de/", None, "allow"),
        "no scheme": ("", "", None, "allow"), None: ("", "", None, "allow"), "http://": ("", "", None, "allow"), "a://b://c/d": ("b:", "//c/d", None, "allow"),
        "http://É.org?x://y/z": ("É.org", "", None, "allow"),
    }
    pages = frame([(i, u, None, 1) for i, u in enumerate(cases)], "page_id BIGINT, url STRING, html STRING, host INT")
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlgraph.judge_urls(pages, URL_RULES).collect()}
    assert [out[i] for i in range(len(cases))] == list(cases.values())


def brute_spread(links, seeds, damping, rounds):
    """Trust along links, distrust against them, by plain dictionaries."""
    scores = dict(seeds)
    for _ in range(rounds):
        new = {h: [(1 - damping) * t, (1 - damping) * d] for h, (t, d) in seeds.items()}
        for (s, d), n in links.items():
            out = sum(m for (a, _), m in links.items() if a == s)
            back = sum(m for (_, b), m in links.items() if b == d)
            if s in scores:
                new.setdefault(d, [0, 0])[0] += damping * scores[s][0] * n / out
            if d in scores:
                new.setdefault(s, [0, 0])[1] += damping * scores[d][1] * n / back
        scores = new
    return scores


def test_spread_equals_plain_iteration(spark):
    links = {("a", "b"): 3, ("a", "c"): 1, ("b", "c"): 2, ("c", "a"): 1, ("d", "bad"): 1, ("c", "d"): 1, ("bad", "e"): 4}
    seeds = {"a": (1.0, 0.0), "bad": (0.0, 1.0)}
    df = spark.createDataFrame([(s, d, n) for (s, d), n in links.items()], "src STRING, dst STRING, n BIGINT")
    got = urlgraph.spread(df, spark.createDataFrame([(h, t, d) for h, (t, d) in seeds.items()], "host STRING, trust DOUBLE, distrust DOUBLE"), 0.85, 6)
    want = brute_spread(links, seeds, 0.85, 6)
    found = {r.host: (r.trust, r.distrust) for r in got.collect()}
    assert found.keys() == want.keys()
    assert all(abs(found[h][i] - want[h][i]) < 1e-12 for h in want for i in (0, 1))


def test_links_carry_the_verdict(frame, spark):
    pages = frame([
        (1, "https://seed.org/fr/1", '<a href="//friend.io/x">', 0), (2, "https://spam.net/x", None, 0),
        (3, "https://farm.io/", "<A HREF='HTTP://spam.net/y'><a href=/local><a href=\"//spam.net/z\">", 0), (4, "https://friend.io/a", "", 0),
        (5, "https://unknown.io/", "<p>", 0), (5, "https://unknown.io/", "<p>", 0),
    ], "page_id BIGINT, url STRING, html STRING, trust INT")
    out = {r.page_id: r.verdict for r in urlgraph.judge_urls(pages, URL_RULES).collect()}
    assert out == {1: "allow", 2: "block", 3: "block", 4: "allow", 5: "allow"}
    links = {(r.src, r.dst): r.n for r in urlgraph.host_links(pages.withColumn("host", urlgraph.host_of(F.col("url")))).collect()}
    assert links[("farm.io", "spam.net")] == 1
    assert urlgraph.judge_urls(spark.createDataFrame([], "page_id BIGINT, url STRING, html STRING"), URL_RULES).count() == 0


def test_distrust_reaches_the_end_of_a_long_chain(frame):
    chain = [f"https://farm{i}.io/" for i in range(30)] + ["https://spam.net/x"]
    pages = [(i, url, f'<a href="{after}">') for i, (url, after) in enumerate(zip(chain, chain[1:]))] + [(30, chain[30], None)]
    pages += [(40, "https://seed.org/fr/1", '<a href="//friend.io/">'), (41, "https://friend.io/", None), (42, "https://unknown.io/", None)]
    out = {r.page_id: r.verdict for r in urlgraph.judge_urls(frame(pages, "page_id BIGINT, url STRING, html STRING"), URL_RULES).collect()}
    assert out == {i: "block" if i <= 30 else "allow" for i in [*range(31), 40, 41, 42]}


def test_scores_settle(spark):
    links = {("a", "b"): 3, ("b", "a"): 1, ("b", "c"): 2, ("c", "b"): 1, ("d", "bad"): 1, ("bad", "d"): 1, ("c", "d"): 1}
    seeds = {"a": (1.0, 0.0), "bad": (0.0, 1.0)}
    df = spark.createDataFrame([(s, d, n) for (s, d), n in links.items()], "src STRING, dst STRING, n BIGINT")
    got = urlgraph.spread(df, spark.createDataFrame([(h, t, d) for h, (t, d) in seeds.items()], "host STRING, trust DOUBLE, distrust DOUBLE"))
    want = brute_spread(links, seeds, 0.85, 400)
    found = {r.host: (r.trust, r.distrust) for r in got.collect()}
    assert found.keys() == want.keys()
    assert sum(abs(found[h][i] - want[h][i]) for h in want for i in (0, 1)) < urlgraph.TOLERANCE * 0.85 / 0.15
