"""Live operations, customers and daily summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.operators.joins import link_integrity
from eventloom.operators.versioning import latest_of, newest_of
from eventloom.plans import live
from eventloom.registry import query
from eventloom.registry.views import (
    RUN, activity, app_events, app_states, catalog, day, demo_products, demo_restaurants, ms, order_events, plain, positions,
    purchases, table, tag, with_sql,
)

AS_OF = "2024-01-31 00:00:00"
LATE_AS_OF = "2000-01-01 00:00:00"
WHOLE = 400 * 86_400


def _at(text: str):
    return F.lit(text).cast("timestamp")


def _couriers(spark, sf_dir):
    return latest_of("courier_positions", positions(spark, sf_dir))


def _orders(spark, sf_dir):
    return latest_of("order_events", order_events(spark, sf_dir))


def _customers(spark, sf_dir):
    return latest_of("customer_activity", activity(spark, sf_dir))


@query("live_couriers", with_sql("courier_latest") + f"""SELECT courier_id, order_id, latitude, longitude, speed_kmh, {ms('event_time')} AS event_time,
    epoch_ms(TIMESTAMP '{AS_OF}') - epoch_ms(event_time) AS age_ms FROM courier_latest""")
def couriers(spark, sf_dir):
    out = live.couriers(_couriers(spark, sf_dir), RUN, _at(AS_OF))
    return plain(out.select("courier_id", "order_id", "latitude", "longitude", "speed_kmh", "event_time", "age_ms"))


_BOARD = with_sql("order_latest", "buys") + """, board AS (SELECT * FROM order_latest
    ORDER BY status IN ('delivered', 'cancelled'), courier_id = '00000000-0000-0000-0000-000000000000', event_time DESC, order_id LIMIT 200)"""


@query("live_orders", _BOARD + f"SELECT order_id, courier_id, status, amount_minor, {ms('event_time')} AS event_time FROM board")
def board_orders(spark, sf_dir):
    out = live.board_orders(_orders(spark, sf_dir), RUN)
    return plain(out.select("order_id", "courier_id", "status", "amount_minor", "event_time"))


@query("live_orders_enriched", _BOARD + """SELECT o.order_id, o.status, b.customer_id, b.session_id, b.checkout_event_id, b.decision_mode
    FROM board o LEFT JOIN buys b USING (order_id)""")
def enriched(spark, sf_dir):
    board = live.board_orders(_orders(spark, sf_dir), RUN)
    out = live.enrich_orders(board, purchases(spark, sf_dir), RUN)
    return plain(out.select("order_id", "status", "customer_id", "session_id", "checkout_event_id", "decision_mode"))


@query("kind_metrics_total", with_sql("order_latest", "buys") + f""", j AS (
    SELECT o.*, CASE WHEN b.decision_mode = 'ollama' THEN 'ai' ELSE 'simulated' END AS k FROM order_latest o LEFT JOIN buys b USING (order_id)),
    m AS (SELECT CASE WHEN grouping(k) = 1 THEN 'total' ELSE k END AS kind, count(*) AS orders,
    count(*) FILTER (WHERE status = 'delivered') AS delivered, count(*) FILTER (WHERE status = 'cancelled') AS cancelled,
    count(*) FILTER (WHERE status NOT IN ('delivered', 'cancelled')) AS active,
    CAST(coalesce(sum(amount_minor) FILTER (WHERE status = 'delivered'), 0) AS BIGINT) AS delivered_amount_minor,
    count(*) FILTER (WHERE status NOT IN ('delivered', 'cancelled') AND promised_delivery_at < TIMESTAMP '{LATE_AS_OF}') AS late
    FROM j GROUP BY ROLLUP (k)) SELECT * FROM m""")
def kind_metrics(spark, sf_dir):
    return plain(live.order_metrics_by_kind(_orders(spark, sf_dir), purchases(spark, sf_dir), RUN, _at(LATE_AS_OF)))


@query("late_open_orders", with_sql("order_latest") + f"""SELECT order_id, status, epoch_ms(TIMESTAMP '{LATE_AS_OF}') // 1000 - epoch_ms(promised_delivery_at) // 1000
    AS overdue_seconds FROM order_latest WHERE status NOT IN ('delivered', 'cancelled') AND promised_delivery_at < TIMESTAMP '{LATE_AS_OF}'""")
def late_orders(spark, sf_dir):
    return plain(live.late_orders(_orders(spark, sf_dir), RUN, _at(LATE_AS_OF)).select("order_id", "status", "overdue_seconds"))


@query("five_second_counts", with_sql("positions") + f"""SELECT strftime(make_timestamp(epoch_ms(event_time) // 5000 * 5000000), '%Y-%m-%d %H:%M:%S.%g') AS bucket,
    count(DISTINCT event_id) AS positions FROM positions GROUP BY 1""")
def position_rate(spark, sf_dir):
    return plain(live.position_rate(positions(spark, sf_dir), RUN, _at(AS_OF), seconds=WHOLE))


@query("order_point_lookup", with_sql("order_latest") + f"""SELECT order_id, courier_id, status, amount_minor, currency, {ms('event_time')} AS event_time
    FROM order_latest WHERE order_id = 'o10'""")
def order_lookup(spark, sf_dir):
    return plain(live.order_state(_orders(spark, sf_dir), RUN, "o10"))


@query("courier_track", with_sql("pos") + f"""SELECT latitude, longitude, order_id, {ms('event_time')} AS event_time, event_id FROM pos
    WHERE courier_id = 'k7' ORDER BY pos.event_time DESC, event_id DESC LIMIT 240""")
def track(spark, sf_dir):
    return plain(live.courier_track(positions(spark, sf_dir), RUN, "k7"))


@query("map_pins", with_sql("courier_latest", "order_latest", "buys", "act") + """, names AS (SELECT DISTINCT customer_id, customer_label FROM act)
    SELECT c.courier_id, c.order_id, c.latitude, o.status, b.customer_id, n.customer_label FROM courier_latest c
    LEFT JOIN order_latest o USING (order_id) LEFT JOIN buys b USING (order_id) LEFT JOIN names n ON n.customer_id = b.customer_id""")
def map_pins(spark, sf_dir):
    out = live.map_pins(_couriers(spark, sf_dir), _orders(spark, sf_dir), purchases(spark, sf_dir), _customers(spark, sf_dir), RUN)
    return plain(out.select("courier_id", "order_id", "latitude", "status", "customer_id", "customer_label"))


@query("customer_flow", with_sql("activity") + """, k AS (SELECT customer_id, bool_or(decision_mode = 'ollama') AS ai FROM activity GROUP BY 1),
    j AS (SELECT a.*, CASE WHEN k.ai THEN 'ai' ELSE 'simulated' END AS kind FROM activity a LEFT JOIN k USING (customer_id)),
    f AS (SELECT kind, count(DISTINCT session_id) AS sessions,
    count(DISTINCT session_id) FILTER (WHERE action = 'checkout') AS purchasing_sessions,
    count(DISTINCT session_id) FILTER (WHERE action = 'abandon') AS abandoned_sessions,
    count(DISTINCT event_id) FILTER (WHERE decision_mode = 'ollama') AS model_decisions,
    count(DISTINCT event_id) FILTER (WHERE action IN ('search', 'open_restaurant', 'open_product', 'add_to_cart', 'remove_from_cart', 'checkout', 'abandon')) AS clicks,
    count(DISTINCT event_id) FILTER (WHERE action = 'checkout') AS checkouts FROM j GROUP BY kind)
    SELECT * FROM f UNION ALL SELECT 'total', CAST(sum(sessions) AS BIGINT), CAST(sum(purchasing_sessions) AS BIGINT), CAST(sum(abandoned_sessions) AS BIGINT),
    CAST(sum(model_decisions) AS BIGINT), CAST(sum(clicks) AS BIGINT), CAST(sum(checkouts) AS BIGINT) FROM f""")
def flow(spark, sf_dir):
    return plain(live.customer_flow(activity(spark, sf_dir), RUN))


@query("limit_by_flag", with_sql("act") + f"""SELECT event_id, customer_id, action, decision_mode, {ms('event_time')} AS event_time FROM act
    QUALIFY row_number() OVER (PARTITION BY decision_mode = 'ollama' ORDER BY act.event_time DESC, event_id DESC) <= 30""")
def recent_activity(spark, sf_dir):
    out = live.recent_activity(activity(spark, sf_dir), RUN)
    return plain(out.select("event_id", "customer_id", "action", "decision_mode", "event_time"))


@query("recent_purchases", with_sql("buys") + f"""SELECT order_id, customer_id, amount_minor, decision_mode, {ms('event_time')} AS event_time FROM buys
    ORDER BY buys.event_time DESC, order_id LIMIT 200""")
def recent_purchases(spark, sf_dir):
    out = live.recent_purchases(purchases(spark, sf_dir), RUN)
    return plain(out.select("order_id", "customer_id", "amount_minor", "decision_mode", "event_time"))


@query("customers_labelled", with_sql("act", "demo_products", "demo_restaurants") + """, l AS (
    SELECT * FROM act QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY event_time DESC, event_id DESC) = 1)
    SELECT customer_id, customer_label, budget_minor, action, p.product_name, r.name AS restaurant_name FROM l
    LEFT JOIN demo_products p USING (product_id) LEFT JOIN demo_restaurants r ON r.restaurant_id = l.restaurant_id""")
def customers_labelled(spark, sf_dir):
    out = live.labelled(_customers(spark, sf_dir), demo_products(spark, sf_dir), demo_restaurants(spark, sf_dir))
    return plain(out.select("customer_id", "customer_label", "budget_minor", "action", "product_name", "restaurant_name"))


@query("minute_timeline", with_sql("act") + f"""SELECT {ms("date_trunc('minute', event_time)")} AS bucket, count(DISTINCT session_id) AS active_sessions
    FROM act GROUP BY 1""")
def minute_sessions(spark, sf_dir):
    return plain(live.minute_sessions(newest_of("customer_activity", activity(spark, sf_dir))))


@query("daily_summary_rows", with_sql("app_daily") + f"""SELECT source_kind, {day('event_date')} AS event_date, city_id, section, event_type, events
    FROM app_daily ORDER BY app_daily.event_date, city_id, event_type, section, source_kind LIMIT 10000""")
def summary_rows(spark, sf_dir):
    return plain(live.daily_summary(app_states(spark, sf_dir), {})["rows"])


@query("daily_summary_totals", with_sql("app_daily") + """SELECT CAST(sum(events) AS BIGINT) AS events, count(*) AS groups, count(*) > 100 AS truncated
    FROM app_daily""")
def summary_totals(spark, sf_dir):
    return plain(live.daily_summary(app_states(spark, sf_dir), {}, limit=100)["totals"])


@query("summary_filtered", with_sql("app_daily") + f"""SELECT source_kind, {day('event_date')} AS event_date, city_id, section, event_type, events
    FROM app_daily WHERE city_id = 'city1' AND source_kind = 'synthetic' AND app_daily.event_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'""")
def summary_filtered(spark, sf_dir):
    filters = {"city_id": "city1", "source_kind": "synthetic", "from": "2024-01-05", "to": "2024-01-20"}
    return plain(live.daily_summary(app_states(spark, sf_dir), filters)["rows"])


@query("navigation_totals", with_sql("app_daily") + """, steps AS (SELECT unnest(['search', 'restaurant_opened', 'product_opened', 'cart_added', 'order_submitted']) AS event_type),
    t AS (SELECT event_type, CAST(sum(events) AS BIGINT) AS events FROM app_daily WHERE source_kind = 'synthetic' AND city_id = 'city1' GROUP BY 1)
    SELECT event_type, coalesce(events, 0) AS events FROM steps LEFT JOIN t USING (event_type)""")
def navigation(spark, sf_dir):
    return plain(live.navigation_totals(app_states(spark, sf_dir), "synthetic", "city1"))


@query("recent_events", with_sql("app") + f"""SELECT event_id, session_id, {ms('event_time')} AS event_time, {ms('ingested_at')} AS ingested_at, event_type, city_id, source, source_kind
    FROM app ORDER BY app.ingested_at DESC, event_id DESC LIMIT 30""")
def recent_events(spark, sf_dir):
    return plain(live.recent_events(app_events(spark, sf_dir)))


@query("catalog_sample", with_sql("catalog") + """SELECT source_row, city_code, store_name FROM catalog
    WHERE country_code = 'AF' ORDER BY store_name, source_row LIMIT 40""")
def catalog_sample(spark, sf_dir):
    products = catalog(spark, sf_dir).withColumn("_city", F.col("city_code")).withColumn("city_code", F.lit("MAD"))
    out = live.catalog_sample(products, "AF", "MAD").select("source_row", "store_name")
    # Names are not unique per row number, so only the ordered columns are shown.
    cities = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("store_name"), tag("C", F.col("s_nationkey")).alias("city_code"))
    return plain(out.join(cities, "store_name").select("source_row", "city_code", "store_name"))


@query("demo_catalog_products", with_sql("demo_products") + "SELECT product_id, restaurant_id, product_name, price_minor FROM demo_products")
def demo_catalog_products(spark, sf_dir):
    out = live.demo_catalog("demo_products", demo_products(spark, sf_dir))
    return plain(out.select("product_id", "restaurant_id", "product_name", "price_minor"))


@query("demo_catalog_restaurants", with_sql("demo_restaurants") + "SELECT restaurant_id, name FROM demo_restaurants")
def demo_catalog_restaurants(spark, sf_dir):
    return plain(live.demo_catalog("demo_restaurants", demo_restaurants(spark, sf_dir)).select("restaurant_id", "name"))


@query("runs_overview", with_sql("positions3") + f"""SELECT simulation_run_id, {ms('max(event_time)')} AS last_event, count(DISTINCT courier_id) AS couriers
    FROM positions3 GROUP BY 1""")
def runs_overview(spark, sf_dir):
    return plain(live.runs_overview(positions(spark, sf_dir, 3)))


@query("freshest_positions", with_sql("courier_latest") + f"""SELECT courier_id, latitude, {ms('event_time')} AS event_time,
    epoch_ms(TIMESTAMP '{AS_OF}') // 1000 - epoch_ms(event_time) // 1000 AS age_seconds FROM courier_latest
    ORDER BY courier_latest.event_time DESC, courier_id LIMIT 12""")
def freshest(spark, sf_dir):
    out = live.freshest_positions(_couriers(spark, sf_dir), _at(AS_OF))
    return plain(out.select("courier_id", "latitude", "event_time", "age_seconds"))


@query("amounts_by_status", with_sql("order_latest3") + """SELECT simulation_run_id, status, count(*) AS orders, round(CAST(sum(amount_minor) AS DOUBLE) / 100, 2) AS amount_eur
    FROM order_latest3 GROUP BY ALL""")
def amounts(spark, sf_dir):
    return plain(live.amounts_by_status(latest_of("order_events", order_events(spark, sf_dir, 3))), 2)


@query("class_board", with_sql("order_latest") + """SELECT c_name AS alias, 'o' || (c_custkey * 12) AS order_id, o.status, o.courier_id, o.order_id IS NOT NULL AS published
    FROM customer LEFT JOIN order_latest o ON o.order_id = 'o' || (c_custkey * 12)""")
def class_board(spark, sf_dir):
    records = table(spark, sf_dir, "customer").select(F.col("c_name").alias("alias"), tag("o", F.col("c_custkey") * 12).alias("order_id"))
    out = live.class_board(records, _orders(spark, sf_dir), RUN)
    return plain(out.select("alias", "order_id", "status", "courier_id", "published"))


@query("class_catalog", with_sql("demo_products") + """SELECT product_id, restaurant_id, product_name, price_minor FROM demo_products ORDER BY product_id LIMIT 50""")
def class_catalog(spark, sf_dir):
    return plain(live.class_catalog(demo_products(spark, sf_dir)))


_LINKS = with_sql("buys", "app") + """, l AS (SELECT b.order_id, a.order_id IS NOT NULL AS click_found,
    coalesce(a.order_id = b.order_id, false) AS same_order, coalesce(a.session_id = b.session_id, false) AS same_session,
    b.amount_minor = b.basket_minor AS amount_matches FROM buys b
    LEFT JOIN (SELECT * FROM app WHERE event_type = 'order_submitted') a ON a.event_id = b.checkout_event_id) """


@query("link_integrity", _LINKS + "SELECT click_found, same_order, same_session, amount_matches, count(*) AS purchases FROM l GROUP BY ALL")
def links(spark, sf_dir):
    bought = newest_of("customer_orders", purchases(spark, sf_dir))
    clicks = newest_of("app_events", app_events(spark, sf_dir)).filter(F.col("event_type") == "order_submitted")
    flags = ["click_found", "same_order", "same_session", "amount_matches"]
    return plain(link_integrity(bought, clicks).groupBy(*flags).agg(F.count(F.lit(1)).alias("purchases")))
