"""Dashboards of the public datasets and experiment metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.operators.metrics import arm_rates, positive_rate, treated_funnel, uplift
from eventloom.plans import dashboards, demo
from eventloom.registry import query
from eventloom.registry.views import (
    END, START, archive, catalog, d_clicks, d_daily_clicks, d_items, d_orders, d_restaurants, d_summary, day, first_app,
    marketplace, ms, plain, samples, uplift_users, with_sql,
)
from eventloom.sources.inventory import storage_inventory


def _delivery(spark, sf_dir):
    return dashboards.delivery_dashboard(
        d_orders(spark, sf_dir), d_clicks(spark, sf_dir), d_items(spark, sf_dir), d_daily_clicks(spark, sf_dir),
        d_summary(spark, sf_dir), d_restaurants(spark, sf_dir), START, END,
    )


def _part(name, board, key, sql, drop=()):
    query(name, sql)(lambda spark, sf_dir: plain(board(spark, sf_dir)[key].drop(*drop)))


_D = with_sql("d_orders", "d_clicks", "d_summary", "d_restaurants")
_LAST = "(SELECT round_even(100.0 * count(*) FILTER (WHERE o.restaurant_id = s.last_clicked_restaurant_id) / count(*), 1) FROM d_summary s JOIN d_orders o USING (order_id))"
_part("delivery_metrics", _delivery, "metrics", _D + f"""SELECT count(*) AS orders, count(DISTINCT user_id) AS users, count(DISTINCT restaurant_id) AS restaurants,
    (SELECT count(*) FROM d_clicks) AS clicks, (SELECT count(*) FROM lineitem) AS items, {_LAST} AS last_click_match_pct,
    round_even(CAST((SELECT count(*) FROM d_clicks) AS DOUBLE) / count(*), 2) AS clicks_per_order FROM d_orders""")
_part("daily_overlay", _delivery, "daily", _D + f""", c AS (SELECT order_date, count(*) AS clicks FROM d_clicks GROUP BY 1),
    o AS (SELECT order_date, count(*) AS orders FROM d_orders GROUP BY 1)
    SELECT {day('o.order_date')} AS day, orders, coalesce(clicks, 0) AS clicks FROM o LEFT JOIN c USING (order_date)""")
_part("delivery_hours", _delivery, "hours", _D + "SELECT hour(ordered_at) AS hour, count(*) AS orders FROM d_orders GROUP BY 1")
_part("hour_zero_filled", _delivery, "hour_axis", _D + """, h AS (SELECT hour(ordered_at) AS hour, count(*) AS orders FROM d_orders GROUP BY 1)
    SELECT a.hour, coalesce(orders, 0) AS orders FROM (SELECT unnest(range(24)) AS hour) a LEFT JOIN h USING (hour)""")
_part("delivery_price_bands", _delivery, "price_bands", _D + "SELECT price_band, count(*) AS orders FROM d_orders GROUP BY 1")
_part("bucket_hist", _delivery, "depth", _D + """, b AS (SELECT CASE WHEN click_count IS NULL THEN '0' WHEN click_count = 1 THEN '1' WHEN click_count <= 3 THEN '2–3'
    WHEN click_count <= 6 THEN '4–6' WHEN click_count <= 10 THEN '7–10' ELSE '11+' END AS bucket
    FROM d_orders LEFT JOIN d_summary USING (order_id)), a AS (SELECT unnest(['0', '1', '2–3', '4–6', '7–10', '11+']) AS bucket)
    SELECT bucket, count(b.bucket) AS orders FROM a LEFT JOIN b USING (bucket) GROUP BY bucket""")
_part("last_click_match", _delivery, "last_click", _D + f"""SELECT count(*) AS sessions,
    count(*) FILTER (WHERE o.restaurant_id = s.last_clicked_restaurant_id) AS same_restaurant, {_LAST} AS last_click_match_pct
    FROM d_summary s JOIN d_orders o USING (order_id)""")
_part("top_entities_with_dims", _delivery, "top", _D + """, t AS (SELECT restaurant_id, count(*) AS orders FROM d_orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10),
    c AS (SELECT restaurant_id, count(*) AS clicks FROM d_clicks GROUP BY 1)
    SELECT restaurant_id, orders, coalesce(clicks, 0) AS clicks, category, score FROM t LEFT JOIN c USING (restaurant_id)
    LEFT JOIN d_restaurants USING (restaurant_id)""")


def _glovo_all(spark, sf_dir):
    return dashboards.glovo_dashboard(catalog(spark, sf_dir), "ALL")


def _glovo_eu(spark, sf_dir):
    return dashboards.glovo_dashboard(catalog(spark, sf_dir), "EU")


_C = with_sql("catalog")
_part("glovo_dash_metrics", _glovo_all, "metrics", _C + """SELECT count(*) AS products, count(DISTINCT store_name) AS stores,
    count(DISTINCT row(country_code, city_code)) AS cities, count(DISTINCT collection_section) AS sections,
    count(*) FILTER (WHERE has_description = 1) AS described,
    round_even(100.0 * count(*) FILTER (WHERE has_description = 1) / count(*), 1) AS description_pct FROM catalog""")
_part("glovo_dash_cities", _glovo_all, "cities", _C + """SELECT country_code || '/' || city_code AS city, count(*) AS products, count(DISTINCT store_name) AS stores
    FROM catalog GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12""")
_part("glovo_dash_sections", _glovo_all, "sections", _C + """SELECT collection_section AS section, count(*) AS products FROM catalog
    WHERE collection_section <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12""")
_part("glovo_dash_stores", _glovo_all, "stores", _C + """SELECT store_name AS store, count(*) AS products, count(DISTINCT city_code) AS cities,
    count(DISTINCT collection_section) AS sections FROM catalog WHERE aux_store = 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12""")
_part("glovo_dash_city_options", _glovo_eu, "city_options", _C + """SELECT city_code AS city, count(*) AS products FROM catalog
    WHERE country_code = 'EU' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 500""")
_part("glovo_dash_countries", _glovo_eu, "countries", _C + "SELECT country_code AS country, count(*) AS products FROM catalog GROUP BY 1")

WHOLE = "2024-01-01 00:00:10"


def _otto(spark, sf_dir):
    """The replay stands 20 seconds before the clock, each event a microsecond-scale step apart."""
    a = archive(spark, sf_dir)
    # One month of events is squeezed into the 30 seconds of the live panel.
    offset = (F.unix_seconds("event_time") - F.unix_seconds(F.lit("2024-01-01").cast("timestamp"))) / 120_000
    replay = a.withColumn("ingested_at", F.timestamp_seconds(F.unix_seconds(F.lit("2024-02-01").cast("timestamp")) - F.floor(offset)))
    clicks = a.select(F.lit("inicio").alias("section"), F.col("event_type").alias("action"), F.col("event_time").alias("clicked_at"))
    return dashboards.otto_dashboard(a, replay, clicks, F.lit("2024-02-01 00:00:00").cast("timestamp"))


_A = with_sql("archive") + """, r AS (SELECT *, 1706745600 - CAST(floor((epoch_ms(event_time) // 1000 - 1704067200) / 120000.0) AS BIGINT) AS s FROM archive)"""
_KINDS = ", ".join(f"count(*) FILTER (WHERE event_type = '{k}') AS {k}" for k in ("clicks", "carts", "orders"))
_part("otto_dash_archive", _otto, "archive", _A + f"SELECT count(*) AS events, {_KINDS} FROM archive", drop=["sessions"])
_part("otto_dash_replay", _otto, "replay_30s", _A + f"SELECT count(*) AS events, {_KINDS} FROM r WHERE s >= 1706745600 - 30", drop=["sessions"])
_part("otto_dash_total", _otto, "replayed_total", _A + "SELECT count(*) AS events FROM r")
_part("otto_dash_timeline", _otto, "timeline", _A + f"""SELECT {ms("make_timestamp(s // 2 * 2000000)")} AS second, {_KINDS} FROM r
    WHERE s >= 1706745600 - 30 GROUP BY 1""")
_part("otto_dash_top", _otto, "top", _A + """SELECT article_id, count(*) AS events, count(*) FILTER (WHERE event_type = 'clicks') AS clicks,
    count(*) FILTER (WHERE event_type = 'orders') AS orders FROM r WHERE s >= 1706745600 - 30 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8""")
_part("otto_dash_live", _otto, "live_clicks", _A + "SELECT count(*) AS clicks FROM archive")
_part("otto_dash_recent", _otto, "recent_live", _A + f"""SELECT 'inicio' AS section, event_type AS action, {ms('event_time')} AS clicked_at
    FROM archive ORDER BY event_time DESC LIMIT 8""")


def _rees(spark, sf_dir):
    return dashboards.rees46_dashboard(marketplace(spark, sf_dir))


_M = with_sql("market")
_E = {"view": "views", "cart": "carts", "remove_from_cart": "removals", "purchase": "purchases"}
_MK = lambda *ks: ", ".join(f"count(*) FILTER (WHERE event_type = '{k}') AS {_E[k]}" for k in ks)
_part("rees46_dash_metrics", _rees, "metrics", _M + f"SELECT count(*) AS events, {_MK(*_E)} FROM market", drop=["users_approx"])
_part("rees46_dash_monthly", _rees, "monthly", _M + """SELECT CAST(strftime(event_date, '%Y%m') AS BIGINT) AS month, event_type, count(*) AS events
    FROM market GROUP BY ALL""")
_part("rees46_dash_categories", _rees, "categories", _M + f"""SELECT category_code AS category, {_MK('view', 'cart', 'purchase')} FROM market
    WHERE category_code <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12""")
_part("rees46_dash_brands", _rees, "brands", _M + f"""SELECT brand, count(*) AS events, {_MK('purchase')} FROM market WHERE brand <> ''
    GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")


def _eleme(spark, sf_dir):
    s = samples(spark, sf_dir)
    return dashboards.eleme_dashboard(s, staging=s)


_S = with_sql("samples")
_SC = "count(*) AS samples, CAST(sum(clicked) AS BIGINT) AS clicks"
_part("eleme_dash_metrics", _eleme, "metrics", _S + f"SELECT {_SC}, round_even(100.0 * sum(clicked) / count(*), 2) AS positive_pct FROM samples",
      drop=["users_approx", "shops_approx"])
_part("eleme_dash_days", _eleme, "days", _S + f"SELECT sample_day AS day, {_SC} FROM samples GROUP BY 1")
_part("eleme_dash_hours", _eleme, "hours", _S + f"SELECT request_hour AS hour, {_SC} FROM samples GROUP BY 1")
_part("eleme_dash_cities", _eleme, "cities", _S + f"SELECT city_id AS city, {_SC} FROM samples GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12")
_part("eleme_dash_meals", _eleme, "meals", _S + f"SELECT meal_period AS period, {_SC} FROM samples GROUP BY 1")
_part("eleme_dash_files", _eleme, "files", _S + "SELECT source_file AS file, sample_day AS day, count(*) AS samples FROM samples GROUP BY ALL")
_part("eleme_dash_staging", _eleme, "staging", _S + "SELECT count(*) AS rows FROM samples")


@query("eleme_day_rates", _S + f"""SELECT sample_day, {_SC}, round_even(100.0 * sum(clicked) / count(*), 2) AS positive_pct FROM samples GROUP BY 1""")
def day_rates(spark, sf_dir):
    return plain(dashboards.day_rates(samples(spark, sf_dir)))


@query("eleme_hour_city", _S + f"""SELECT request_hour, city_id, {_SC} FROM samples WHERE sample_day = 1 GROUP BY ALL
    ORDER BY samples DESC, request_hour, city_id LIMIT 20""")
def hour_city(spark, sf_dir):
    return plain(dashboards.hour_city_breakdown(samples(spark, sf_dir), 1))


@query("eleme_rate_by_city_meal", _S + f"""SELECT city_id, meal_period, {_SC}, round_even(100.0 * sum(clicked) / count(*), 2) AS positive_pct
    FROM samples GROUP BY ALL""")
def city_meal(spark, sf_dir):
    return plain(positive_rate(samples(spark, sf_dir), ["city_id", "meal_period"]))


@query("time_validity", _S + "SELECT min(unix) AS min_unix, max(unix) AS max_unix, count(*) - count(unix) AS invalid_unix FROM samples")
def time_validity(spark, sf_dir):
    return plain(dashboards.time_validity(samples(spark, sf_dir)))


@query("typed_vs_json", _S + "SELECT CAST(sum(clicked) AS BIGINT) AS typed_clicks, CAST(sum(clicked) AS BIGINT) AS json_clicks FROM samples")
def typed_vs_json(spark, sf_dir):
    return plain(dashboards.typed_vs_json_clicks(samples(spark, sf_dir)))


@query("scale_totals", """SELECT (SELECT count(*) FROM events) + (SELECT count(*) FROM lineitem) AS real_events, (SELECT count(*) FROM documents) AS derived_rows""")
def scale_totals(spark, sf_dir):
    names = ["events", "lineitem", "documents", "orders"]
    inventory = storage_inventory(spark, {n: f"{sf_dir}/{n}.parquet" for n in names})
    return plain(dashboards.scale_dashboard(inventory, ["events", "lineitem"], ["documents"])["totals"])


# Experiment ------------------------------------------------------------------------------------

_U = with_sql("users")


@query("arm_rates", _U + """SELECT treatment::BIGINT AS treatment, count(*) AS users, round(avg(exposure), 6) AS exposure_rate, round(avg(visit), 6) AS visit_rate,
    round(avg(conversion), 6) AS conversion_rate, round_even(100.0 * sum(conversion) / sum(visit), 2) AS conversion_after_visit_pct FROM users GROUP BY 1""")
def arms(spark, sf_dir):
    return plain(arm_rates(uplift_users(spark, sf_dir)))


def _uplift_sql(view: str) -> str:
    rate = lambda o, t: f"(avg({o}) FILTER (WHERE treatment = {t}))"
    return ", ".join(
        f"round_even(100 * ({rate(o, 1)} - {rate(o, 0)}), 3) AS uplift_{o}_pp, "
        f"round_even(100 * ({rate(o, 1)} / nullif({rate(o, 0)}, 0) - 1), 1) AS uplift_{o}_relative_pct"
        for o in ("visit", "conversion")
    ) + f" FROM {view}"


@query("uplift", _U + "SELECT " + _uplift_sql("users"))
def lift(spark, sf_dir):
    return plain(uplift(uplift_users(spark, sf_dir)))


@query("uplift_without_control", _U + ", t AS (SELECT * FROM users WHERE treatment = 1) SELECT " + _uplift_sql("t"))
def lift_without_control(spark, sf_dir):
    """With one arm missing every lift is NULL."""
    return plain(uplift(uplift_users(spark, sf_dir).filter("treatment = 1")))


@query("treated_funnel", _U + """SELECT count(*) FILTER (WHERE treatment = 1) AS treated, count(*) FILTER (WHERE treatment = 1 AND exposure = 1) AS exposed,
    count(*) FILTER (WHERE treatment = 1 AND exposure = 1 AND visit = 1) AS visited,
    count(*) FILTER (WHERE treatment = 1 AND exposure = 1 AND visit = 1 AND conversion = 1) AS purchased FROM users""")
def treated(spark, sf_dir):
    return plain(treated_funnel(uplift_users(spark, sf_dir)))


@query("sessions_by_origin", with_sql("first_app") + "SELECT origen, count(*) AS eventos FROM first_app GROUP BY 1")
def by_origin(spark, sf_dir):
    return plain(demo.sessions_by_origin(first_app(spark, sf_dir)).drop("sesiones"))


@query("hourly_panel", with_sql("first_app") + f"""SELECT {ms("date_trunc('hour', ts)")} AS hora, seccion, count(DISTINCT session_id) AS sesiones
    FROM first_app GROUP BY ALL""")
def panel(spark, sf_dir):
    """Sketches of a few hundred members are exact, so the panel equals the distinct counts."""
    states = demo.hourly_states(first_app(spark, sf_dir))
    return plain(demo.hourly_panel(states, F.lit("2024-01-31").cast("timestamp"), seconds=400 * 86_400))
