"""Funnel golden case, brute-force agreement, and invariance to arrival order and repeats."""

import random

from pyspark.sql import functions as F

from eventloom import schemas
from eventloom.operators.funnel import window_funnel
from eventloom.plans import demo, journey

RUN, OTHER = "run", "other"
CASES = [
    (["session_started", "open_product", "add_to_cart", "checkout"], [0, 1, 2, 3]),
    (["session_started", "open_product", "abandon"], [0, 1, 2]),
    (["session_started", "add_to_cart", "open_product", "checkout"], [0, 1, 2, 3]),
    (["session_started", "open_product", "add_to_cart", "checkout"], [0, 0, 0, 0]),
    (["session_started", "open_product", "add_to_cart", "checkout"], [0, 1900, 1901, 1902]),
    (["open_product"], [0]),
]


def activity_row(after, n, i, action, offset, mode="rules", run=RUN, ingested=0):
    return dict(
        schema_version=1, event_id=f"e{n}-{i}", simulation_run_id=run, customer_id=f"c{n}", session_id=f"s{n}",
        event_time=after(offset), ingested_at=after(offset + 1 + ingested), customer_label=f"C{n}", objective="", budget_minor=0,
        action=action, stage=action, reason="", restaurant_id=None, product_id=None, order_id=None, cart_total_minor=0,
        decision_mode=mode, model=None, source_kind="synthetic",
    )


def golden(spark, after):
    out = [
        activity_row(after, n, i, action, offset, "ollama" if (n, action) == (0, "checkout") else "rules")
        for n, (actions, offsets) in enumerate(CASES) for i, (action, offset) in enumerate(zip(actions, offsets))
    ]
    out.append(dict(out[1], ingested_at=after(500)))
    out.append(activity_row(after, 9, 0, "session_started", 0, run=OTHER))
    return spark.createDataFrame(out, schemas.schema("customer_activity")), len(out)


def test_golden_funnel(spark, after):
    df, n = golden(spark, after)
    steps = journey.journey_funnel(df, RUN).orderBy("step").collect()
    assert [r.sessions for r in steps] == [5, 3, 1, 1]
    assert [r.share_pct for r in steps] == [100.0, 60.0, 20.0, 20.0]
    totals = journey.journey_totals(df, RUN).first()
    assert (totals.cohort_sessions, totals.excluded_sessions, totals.abandoned_sessions) == (5, 1, 1)
    assert journey.journey_actions(df, RUN).agg(F.sum("events")).first()[0] == n - 2
    for kind, expected in (("ai", [1, 1, 1, 1]), ("simulated", [4, 2, 0, 0])):
        assert [r.sessions for r in journey.journey_funnel(df, RUN, kind).orderBy("step").collect()] == expected


def test_golden_levels(spark, after):
    df, _ = golden(spark, after)
    levels = {r.session_id: r.level for r in journey.session_levels(journey.run_activity(df, RUN)).collect()}
    assert levels == {"s0": 4, "s1": 2, "s2": 2, "s3": 1, "s4": 1, "s5": 0}


def test_empty_run_has_no_share(spark, after):
    df, _ = golden(spark, after)
    steps = journey.journey_funnel(df, "nobody").collect()
    assert [(r.sessions, r.share_pct) for r in steps] == [(0, None)] * 4
    assert journey.journey_totals(df, "nobody").first().cohort_sessions == 0


def test_timeline_counts_sessions_once(spark, after):
    df, _ = golden(spark, after)
    first = journey.journey_timeline(df, RUN).first()
    assert (first.active_sessions, first.checkout_sessions, first.abandoned_sessions) == (6, 3, 1)


def fold(events, window, strict, n):
    """The plain definition, one event at a time."""
    state = [None] * (n + 1)
    for t, step in sorted(set(events)):
        if step == 1:
            state[1] = (t, t)
        elif state[step - 1] is not None:
            start, last = state[step - 1]
            if t <= start + window and (last < t if strict else last <= t):
                state[step] = (start, t)
    return max((i for i in range(1, n + 1) if state[i] is not None), default=0)


def test_funnel_equals_plain_fold(spark):
    """Random sessions with ties, repeats, long spans and negative times, on windows of several sizes."""
    rng = random.Random(7)
    data = {s: [(rng.randint(-40, 160) * rng.choice([1, 1, 5]), rng.randint(1, 4)) for _ in range(rng.randint(1, 40))] for s in range(150)}
    df = spark.createDataFrame([(s, t, f"a{k}") for s, ev in data.items() for t, k in ev], "s INT, t BIGINT, a STRING")
    conditions = [F.col("a") == f"a{i}" for i in range(1, 5)]
    for window in (1, 7, 30, 1000):
        for strict in (True, False):
            got = {r.s: r.level for r in window_funnel(df, ["s"], F.col("t"), conditions, window, strict).collect()}
            assert got == {s: fold(ev, window, strict, 4) for s, ev in data.items()}, (window, strict)


def test_funnel_ignores_order_and_copies(spark):
    base = [("x", t, a) for t, a in [(0, "a"), (3, "b"), (5, "c")]]
    conditions = [F.col("a") == v for v in "abc"]
    for data in (base, base[::-1], base * 3):
        df = spark.createDataFrame(data, "s STRING, t BIGINT, a STRING").repartition(3)
        assert [r.level for r in window_funnel(df, ["s"], F.col("t"), conditions, 10).collect()] == [3]


def test_one_session_with_most_rows_is_cut(spark):
    """A session with nearly all rows spreads over its time buckets."""
    df = spark.range(200_000).select(
        F.lit("hot").alias("s"), (F.col("id") * 50).alias("t"), F.element_at(F.array(*map(F.lit, "abcd")), (F.col("id") % 4 + 1).cast("int")).alias("a")
    )
    levels = window_funnel(df, ["s"], F.col("t"), [F.col("a") == v for v in "abcd"], 1000)
    assert [r.level for r in levels.collect()] == [4]
    plan = levels._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "_bucket" in plan


def test_first_app_default_mode(spark, after):
    data = [("s", "simulado", sec, after(i // 2)) for i, sec in enumerate(demo.STEPS)] + [("r", "app_real", "busqueda", after(0))]
    df = spark.createDataFrame(data, "session_id STRING, origen STRING, seccion STRING, ts TIMESTAMP")
    assert [(r.level, r.sessions) for r in demo.session_levels(df).collect()] == [(5, 1)]
