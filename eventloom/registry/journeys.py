"""Funnels and customer journeys."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.operators.funnel import level_histogram, window_funnel
from eventloom.operators.metrics import search_conversion
from eventloom.plans import demo, journey
from eventloom.registry import query
from eventloom.registry.views import RUN, activity, ev, first_app, ms, plain, with_sql

STEPS = ["signup", "view", "click", "purchase"]


def funnel_sql(source: str, session: str, time: str, step: str, steps: list[str], window: int, strict: bool, where: str = "true") -> str:
    """Chains step by step: per end time the latest start that still fits the window."""
    after = ">" if strict else ">="
    parts = [
        f"fe AS (SELECT {session} AS sid, {time} AS t, {step} AS st FROM {source} WHERE {where})",
        f"f1 AS (SELECT sid, t AS f, t AS l FROM fe WHERE st = '{steps[0]}')",
    ]
    for i, name in enumerate(steps[1:], start=2):
        parts.append(
            f"f{i} AS (SELECT p.sid, max(p.f) AS f, e.t AS l FROM f{i - 1} p JOIN fe e ON p.sid = e.sid "
            f"AND e.st = '{name}' AND e.t {after} p.l AND e.t <= p.f + {window} GROUP BY p.sid, e.t)"
        )
    reached = " UNION ALL ".join(f"SELECT sid, {i} AS level FROM f{i}" for i in range(1, len(steps) + 1))
    parts.append(
        f"levels AS (SELECT s.sid, CAST(coalesce(max(r.level), 0) AS BIGINT) AS level FROM (SELECT DISTINCT sid FROM fe) s "
        f"LEFT JOIN ({reached}) r ON s.sid = r.sid GROUP BY s.sid)"
    )
    return ",\n".join(parts)


def _histogram(levels: str) -> str:
    return f"{levels} SELECT level, count(*) AS sessions FROM levels GROUP BY level"


for _name, _seconds in {"30m": 1800, "6h": 21_600, "12h": 43_200, "24h": 86_400}.items():

    def _levels(spark, sf_dir, seconds=_seconds):
        steps = [F.col("event_type") == s for s in STEPS]
        return plain(level_histogram(
            window_funnel(ev(spark, sf_dir), ["user_id"], F.unix_millis("moment"), steps, seconds * 1000)
        ))

    query(f"funnel_levels_{_name}", _histogram(
        with_sql("ev") + ", " + funnel_sql("ev", "user_id", "epoch_ms(moment)", "event_type", STEPS, _seconds * 1000, True)
    ))(_levels)


@query("funnel_by_error_flag", with_sql("ev") + ", " + funnel_sql(
    "ev", "user_id", "epoch_ms(moment)", "event_type", STEPS, 86_400_000, True
) + """, flagged AS (SELECT user_id, bool_or(event_type = 'error' AND k < 3) AS flag FROM ev GROUP BY user_id)
SELECT flag, level, count(*) AS sessions FROM levels JOIN flagged ON sid = user_id GROUP BY ALL""")
def _by_flag(spark, sf_dir):
    steps = [F.col("event_type") == s for s in STEPS]
    levels = window_funnel(
        ev(spark, sf_dir), ["user_id"], F.unix_millis("moment"), steps, 86_400_000,
        flags={"flag": (F.col("event_type") == "error") & (F.col("k") < 3)},
    )
    return plain(levels.groupBy("flag", "level").agg(F.count(F.lit(1)).alias("sessions")))


@query("funnel_default_seconds", _histogram(with_sql("first_app") + ", " + funnel_sql(
    "first_app", "session_id", "epoch_ms(ts) // 1000", "seccion", demo.STEPS, 1800, False, "origen = 'simulado'"
)))
def _default(spark, sf_dir):
    return plain(demo.session_levels(first_app(spark, sf_dir)))


@query("funnel_user_days", _histogram(with_sql("first_app") + ", " + funnel_sql(
    "first_app", "user_id", "epoch_ms(ts) // 1000", "seccion", demo.STEPS, 172_800, False
)))
def _user_days(spark, sf_dir):
    steps = [F.col("seccion") == s for s in demo.STEPS]
    levels = window_funnel(first_app(spark, sf_dir), ["user_id"], F.unix_seconds("ts"), steps, 172_800, strict=False)
    return plain(level_histogram(levels))


_KIND = {
    "all": "SELECT * FROM act",
    "ai": "SELECT * FROM act WHERE customer_id IN (SELECT customer_id FROM activity GROUP BY 1 HAVING bool_or(decision_mode = 'ollama'))",
    "simulated": "SELECT * FROM act WHERE customer_id IN (SELECT customer_id FROM activity GROUP BY 1 HAVING NOT bool_or(decision_mode = 'ollama'))",
}


def _journey_sql(kind: str) -> str:
    chosen = with_sql("act") + f", chosen AS ({_KIND[kind]})"
    return chosen + ",\n" + funnel_sql(
        "chosen", "session_id", "epoch_ms(event_time)", "action", ["session_started", "open_product", "add_to_cart", "checkout"],
        journey.WINDOW_MS, True,
    )


for _kind in _KIND:
    _labels = " UNION ALL ".join(f"SELECT {i} AS step, '{label}' AS label" for i, label in enumerate(journey.LABELS, start=1))

    def _funnel(spark, sf_dir, kind=_kind):
        return plain(journey.journey_funnel(activity(spark, sf_dir), RUN, kind))

    query(f"journey_funnel_{_kind}", _journey_sql(_kind) + f""", labels AS ({_labels})
    SELECT step::BIGINT AS step, label, count(*) FILTER (WHERE level >= step) AS sessions,
    round_even(100.0 * count(*) FILTER (WHERE level >= step) / nullif(count(*) FILTER (WHERE level >= 1), 0), 2) AS share_pct
    FROM labels, levels GROUP BY step, label""")(_funnel)

    def _totals(spark, sf_dir, kind=_kind):
        return plain(journey.journey_totals(activity(spark, sf_dir), RUN, kind))

    query(f"journey_totals_{_kind}", _journey_sql(_kind) + """
    SELECT count(*) FILTER (WHERE level >= 1) AS cohort_sessions, count(*) FILTER (WHERE level = 0) AS excluded_sessions,
    count(*) FILTER (WHERE level > 0 AND sid IN (SELECT session_id FROM chosen WHERE action = 'abandon')) AS abandoned_sessions FROM levels""")(_totals)

    def _actions(spark, sf_dir, kind=_kind):
        return plain(journey.journey_actions(activity(spark, sf_dir), RUN, kind))

    query(f"journey_actions_{_kind}", with_sql("act") + f""", chosen AS ({_KIND[_kind]})
    SELECT action, count(*) AS events, count(DISTINCT session_id) AS sessions FROM chosen GROUP BY action""")(_actions)

    def _timeline(spark, sf_dir, kind=_kind):
        return plain(journey.journey_timeline(activity(spark, sf_dir), RUN, kind))

    query(f"journey_timeline_{_kind}", with_sql("act") + f""", chosen AS ({_KIND[_kind]}), m AS (
    SELECT date_trunc('minute', event_time) AS bucket, count(DISTINCT session_id) AS active_sessions,
    count(DISTINCT session_id) FILTER (WHERE action = 'checkout') AS checkout_sessions,
    count(DISTINCT session_id) FILTER (WHERE action = 'abandon') AS abandoned_sessions FROM chosen GROUP BY 1 ORDER BY 1 DESC LIMIT 60)
    SELECT {ms('bucket')} AS bucket, active_sessions, checkout_sessions, abandoned_sessions FROM m""")(_timeline)


@query("search_conversion", with_sql("first_app") + """, s AS (SELECT session_id,
    coalesce(arg_min(busqueda, row(ts, CAST(n AS VARCHAR))) FILTER (WHERE seccion = 'busqueda'), '') AS busqueda,
    bool_or(seccion = 'pedido') AS ordered FROM first_app GROUP BY session_id)
    SELECT busqueda, count(*) AS searching_sessions, count(*) FILTER (WHERE ordered) AS ordering_sessions,
    round_even(100.0 * count(*) FILTER (WHERE ordered) / count(*), 1) AS conversion_pct FROM s WHERE busqueda <> '' GROUP BY busqueda""")
def _search(spark, sf_dir):
    return plain(search_conversion(first_app(spark, sf_dir)))
