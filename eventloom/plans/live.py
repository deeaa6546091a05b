"""Live operations, customers, tracks and daily summaries of the current data model.

``as_of`` is the clock of every age and trailing window, so a report can be
repeated exactly.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from eventloom import schemas
from eventloom.functions.aggregates import sum_if
from eventloom.functions.scalars import euros, interval_start, millis_between, seconds_between, within_last
from eventloom.operators.joins import any_left_join, with_labels
from eventloom.operators.metrics import active_members, kinds_with_total
from eventloom.operators.topk import latest_chronological, limit_by, limited
from eventloom.operators.versioning import newest_of
from eventloom.operators.rollups import read_id_rollup
from eventloom.plans import filters as checks
from eventloom.streaming.ingest import ROLLUP_KEYS

COURIERS_SHOWN = 150
ORDERS_SHOWN = 200
ACTIVITY_SHOWN = 30
TRACK_POINTS = 240
SUMMARY_ROWS = 10_000
KINDS = ["simulated", "ai"]
NAVIGATION_STEPS = ["search", "restaurant_opened", "product_opened", "cart_added", "order_submitted"]


def _run(df: DataFrame, run_id: str) -> DataFrame:
    return df.filter(F.col("simulation_run_id") == run_id)


def _is_closed() -> Column:
    return F.col("status").isin(schemas.CLOSED_STATUSES)


def _kind(mode: Column) -> Column:
    """Purchases without a model decision, also manual ones, count as simulated."""
    return F.when(mode == schemas.MODEL_MODE, "ai").otherwise("simulated")


# Couriers and orders ----------------------------------------------------------------------


def couriers(courier_latest: DataFrame, run_id: str, as_of: Column, n: int = COURIERS_SHOWN) -> DataFrame:
    """Latest position per courier with its age and receipt delay."""
    return _run(courier_latest, run_id).select(
        "courier_id", "order_id", "city_id", "latitude", "longitude", "speed_kmh", "accuracy_m", "event_time", "ingested_at",
        millis_between(F.col("event_time"), as_of).alias("age_ms"),
        millis_between("event_time", "ingested_at").alias("receipt_delay_ms"),
    ).orderBy("courier_id").limit(n)


def board_orders(order_latest: DataFrame, run_id: str, n: int = ORDERS_SHOWN) -> DataFrame:
    """Open orders first, assigned before unassigned, newest first."""
    unassigned = F.col("courier_id") == schemas.UNASSIGNED
    return _run(order_latest, run_id).orderBy(_is_closed(), unassigned, F.desc("event_time"), "order_id").limit(n)


def enrich_orders(orders: DataFrame, purchases: DataFrame, run_id: str) -> DataFrame:
    """Add the purchase behind each order, whatever its age."""
    wanted = _run(purchases, run_id).join(orders.select("order_id"), "order_id", "left_semi")
    details = ["customer_id", "session_id", "checkout_event_id", "items", "decision_mode"]
    link = newest_of("customer_orders", wanted, details).select("order_id", *details)
    return any_left_join(orders, link, ["order_id"])


def order_metrics_by_kind(order_latest: DataFrame, purchases: DataFrame, run_id: str, as_of: Column) -> DataFrame:
    """Orders, outcomes, delivered amount and late orders per customer kind, with total."""
    modes = _run(purchases, run_id).select("order_id", "decision_mode")
    joined = any_left_join(_run(order_latest, run_id), modes, ["order_id"])
    open_order = ~_is_closed()
    by_kind = joined.groupBy(_kind(F.col("decision_mode")).alias("kind")).agg(
        F.count(F.lit(1)).alias("orders"),
        F.count_if(F.col("status") == "delivered").alias("delivered"),
        F.count_if(F.col("status") == "cancelled").alias("cancelled"),
        F.count_if(open_order).alias("active"),
        sum_if(F.col("amount_minor").cast("bigint"), F.col("status") == "delivered").alias("delivered_amount_minor"),
        F.count_if(open_order & (F.col("promised_delivery_at") < as_of)).alias("late"),
    )
    return kinds_with_total(by_kind, KINDS)


def late_orders(order_latest: DataFrame, run_id: str, as_of: Column) -> DataFrame:
    """Open orders past their promise, longest overdue first."""
    return _run(order_latest, run_id).filter(~_is_closed() & (F.col("promised_delivery_at") < as_of)).withColumn(
        "overdue_seconds", seconds_between(F.col("promised_delivery_at"), as_of)
    )


def position_rate(positions: DataFrame, run_id: str, as_of: Column, seconds: int = 120, step: int = 5) -> DataFrame:
    """Logical positions per 5 seconds over the last two minutes."""
    recent = _run(positions, run_id).filter(within_last("event_time", as_of, seconds))
    return recent.groupBy(interval_start("event_time", step).alias("bucket")).agg(
        F.count_distinct("event_id").alias("positions")
    ).orderBy("bucket")


def snapshot(
    courier_latest: DataFrame, order_latest: DataFrame, purchases: DataFrame, run_id: str, as_of: Column,
    couriers_shown: int = COURIERS_SHOWN, orders_shown: int = ORDERS_SHOWN, purchases_shown: int = ORDERS_SHOWN,
) -> DataFrame:
    """One row: exact totals of the run, how many of each the lists show, whether any list is cut, and the clock."""
    shown = {"couriers": couriers_shown, "orders": orders_shown, "purchases": purchases_shown}
    bought = _run(purchases, run_id).select(*schemas.KEYS["customer_orders"]).distinct()
    counted = None
    for name, rows in (("couriers", _run(courier_latest, run_id)), ("orders", _run(order_latest, run_id)), ("purchases", bought)):
        one = rows.agg(F.count(F.lit(1)).alias(name))
        counted = one if counted is None else counted.unionByName(one, allowMissingColumns=True)
    totals = counted.agg(*[F.max(c).alias(c) for c in shown])
    cut = F.lit(False)
    for name, n in shown.items():
        cut = cut | (F.col(name) > n)
    return totals.select(
        *shown, *[F.least(F.col(c), F.lit(n)).alias(f"{c}_shown") for c, n in shown.items()], cut.alias("truncated"),
        as_of.alias("snapshot_at"),
    )


def operations(
    courier_latest: DataFrame, order_latest: DataFrame, purchases: DataFrame, positions: DataFrame,
    activity: DataFrame, customer_latest: DataFrame, products: DataFrame, restaurants: DataFrame, run_id: str, as_of: Column,
    couriers_shown: int = COURIERS_SHOWN, orders_shown: int = ORDERS_SHOWN,
) -> dict[str, DataFrame]:
    """The whole live board; ``snapshot`` has its clock, exact totals and whether a list is cut."""
    return {
        "snapshot": snapshot(courier_latest, order_latest, purchases, run_id, as_of, couriers_shown, orders_shown),
        "couriers": couriers(courier_latest, run_id, as_of, couriers_shown),
        "orders": enrich_orders(board_orders(order_latest, run_id, orders_shown), purchases, run_id),
        "metrics_by_kind": order_metrics_by_kind(order_latest, purchases, run_id, as_of),
        "positions_by_5s": position_rate(positions, run_id, as_of),
        **customers(activity, customer_latest, purchases, products, restaurants, run_id),
    }


def order_state(order_latest: DataFrame, run_id: str, order_id: str) -> DataFrame:
    """One order of one run; another run never answers."""
    return _run(order_latest, run_id).filter(F.col("order_id") == order_id).select(
        "order_id", "courier_id", "status", "amount_minor", "currency", "event_time"
    ).limit(1)


def courier_track(positions: DataFrame, run_id: str, courier_id: str, n: int = TRACK_POINTS) -> DataFrame:
    """Last points of one courier in time order."""
    point = ["latitude", "longitude", "order_id"]
    mine = newest_of("courier_positions", _run(positions, run_id).filter(F.col("courier_id") == courier_id), point)
    return latest_chronological(mine.select(*point, "event_time", "event_id"), n, "event_time", "event_id")


def map_pins(courier_latest: DataFrame, order_latest: DataFrame, purchases: DataFrame, customer_latest: DataFrame, run_id: str) -> DataFrame:
    """Courier with its current order and that order's customer."""
    orders = _run(order_latest, run_id).select("order_id", "status")
    links = _run(purchases, run_id).select("order_id", "customer_id", "session_id", "checkout_event_id")
    names = _run(customer_latest, run_id).select("customer_id", "customer_label")
    out = any_left_join(_run(courier_latest, run_id).select("courier_id", "order_id", "latitude", "longitude"), orders, ["order_id"])
    return any_left_join(any_left_join(out, links, ["order_id"]), names, ["customer_id"])


# Customers ----------------------------------------------------------------------------------


def customer_flow(activity: DataFrame, run_id: str) -> DataFrame:
    """Sessions, purchases, abandonments, model decisions and clicks per customer kind, with total.

    One row per action identity is built first, then per session. The kind of a
    customer joins that reduced set, and each metric is a plain count afterwards.
    """
    action = F.col("action")
    modelled = F.col("decision_mode") == schemas.MODEL_MODE
    events = _run(activity, run_id).groupBy("customer_id", "session_id", "event_id").agg(
        F.bool_or(action == "checkout").alias("_checkout"),
        F.bool_or(action == "abandon").alias("_abandon"),
        F.bool_or(modelled).alias("_model"),
        F.bool_or(action.isin(schemas.CLICK_ACTIONS)).alias("_click"),
    )
    sessions = events.groupBy("customer_id", "session_id").agg(
        F.max("_checkout").alias("_buys"), F.max("_abandon").alias("_leaves"),
        F.count_if("_model").alias("_model"), F.count_if("_click").alias("_click"), F.count_if("_checkout").alias("_checkout"),
    )
    kinds = sessions.groupBy("customer_id").agg((F.sum("_model") > 0).alias("_ai"))
    by_session = sessions.join(kinds, "customer_id").groupBy(
        F.when(F.col("_ai"), "ai").otherwise("simulated").alias("kind"), "session_id"
    ).agg(
        F.max("_buys").alias("_buys"), F.max("_leaves").alias("_leaves"),
        *[F.sum(c).alias(c) for c in ("_model", "_click", "_checkout")],
    )
    by_kind = by_session.groupBy("kind").agg(
        F.count(F.lit(1)).alias("sessions"),
        F.count_if("_buys").alias("purchasing_sessions"),
        F.count_if("_leaves").alias("abandoned_sessions"),
        F.sum("_model").alias("model_decisions"),
        F.sum("_click").alias("clicks"),
        F.sum("_checkout").alias("checkouts"),
    )
    return kinds_with_total(by_kind, KINDS)


def recent_activity(activity: DataFrame, run_id: str, n: int = ACTIVITY_SHOWN) -> DataFrame:
    """The latest model decisions and, apart from them, the latest other actions."""
    shown = [
        "event_id", "customer_label", "customer_id", "session_id", "event_time", "action", "reason", "decision_mode",
        "model", "order_id", "restaurant_id", "product_id",
    ]
    logical = newest_of("customer_activity", _run(activity, run_id), shown)
    return limit_by(
        logical.select(*shown), n, [F.col("decision_mode") == schemas.MODEL_MODE], [F.desc("event_time"), F.desc("event_id")]
    ).orderBy(F.desc("event_time"), F.desc("event_id"))


def recent_purchases(purchases: DataFrame, run_id: str, n: int = ORDERS_SHOWN) -> DataFrame:
    shown = [
        "order_id", "customer_id", "session_id", "checkout_event_id", "restaurant_id", "items", "amount_minor",
        "decision_mode", "event_time",
    ]
    logical = newest_of("customer_orders", _run(purchases, run_id), shown).select(*shown)
    return logical.orderBy(F.desc("event_time"), "order_id").limit(n)


def labelled(rows: DataFrame, products: DataFrame, restaurants: DataFrame) -> DataFrame:
    named = with_labels(rows, newest_of("demo_products", products), "product_id", "product_name", "product_name")
    return with_labels(named, newest_of("demo_restaurants", restaurants), "restaurant_id", "name", "restaurant_name")


def customers(
    activity: DataFrame, customer_latest: DataFrame, purchases: DataFrame, products: DataFrame, restaurants: DataFrame, run_id: str
) -> dict[str, DataFrame]:
    return {
        "customers": labelled(_run(customer_latest, run_id), products, restaurants).orderBy("customer_label", "customer_id"),
        "activity": labelled(recent_activity(activity, run_id), products, restaurants),
        "purchases": recent_purchases(purchases, run_id),
        "customer_metrics_by_kind": customer_flow(activity, run_id),
    }


# Daily counts -----------------------------------------------------------------------------


def _filtered(df: DataFrame, filters: Mapping[str, str]) -> DataFrame:
    filters = checks.summary(filters)
    for name in ("city_id", "source_kind", "event_type"):
        if name in filters:
            df = df.filter(F.col(name) == filters[name])
    if "from" in filters:
        df = df.filter(F.col("event_date") >= F.lit(filters["from"]).cast("date"))
    if "to" in filters:
        df = df.filter(F.col("event_date") <= F.lit(filters["to"]).cast("date"))
    return df


def daily_counts(states: DataFrame) -> DataFrame:
    """Logical events per day and dimension from exact-ID states."""
    return read_id_rollup(states, ROLLUP_KEYS, "event_id")


def daily_summary(states: DataFrame, filters: Mapping[str, str], limit: int = SUMMARY_ROWS) -> dict[str, DataFrame]:
    """Filtered daily counts, with exact totals and whether rows were cut."""
    counts = daily_counts(_filtered(states, filters))
    rows, _ = limited(counts, limit, "event_date", "city_id", "event_type", "section", "source_kind")
    totals = counts.agg(
        F.coalesce(F.sum("events"), F.lit(0).cast("bigint")).alias("events"), F.count(F.lit(1)).alias("groups")
    ).withColumn("truncated", F.col("groups") > limit)
    return {"rows": rows, "totals": totals}


def navigation_totals(states: DataFrame, source_kind: str, city_id: str) -> DataFrame:
    """Events per navigation step for one origin, every step listed."""
    axis = states.sparkSession.range(1).select(F.explode(F.array(*[F.lit(s) for s in NAVIGATION_STEPS])).alias("event_type"))
    counts = daily_counts(_filtered(states, {"source_kind": source_kind, "city_id": city_id})).groupBy("event_type").agg(
        F.sum("events").alias("events")
    )
    return axis.join(counts, "event_type", "left").select("event_type", F.coalesce("events", F.lit(0).cast("bigint")).alias("events"))


# Small reads --------------------------------------------------------------------------------


def recent_events(app_events: DataFrame, n: int = 30) -> DataFrame:
    return newest_of("app_events", app_events, ["source"]).select(
        "event_id", "session_id", "event_time", "ingested_at", "event_type", "city_id", "source", "source_kind"
    ).orderBy(F.desc("ingested_at"), F.desc("event_id")).limit(n)


def catalog_sample(products: DataFrame, country: str = "ES", city: str = "MAD", n: int = 40) -> DataFrame:
    return products.filter((F.col("country_code") == country) & (F.col("city_code") == city)).select(
        "source_row", "city_code", "store_name", "product_name", "collection_section"
    ).orderBy("store_name", "source_row").limit(n)


def demo_catalog(table: str, df: DataFrame) -> DataFrame:
    """Current catalog rows without their version."""
    return newest_of(table, df).drop("version").orderBy(schemas.KEYS[table][0])


# Tracking reads -----------------------------------------------------------------------------


def runs_overview(positions: DataFrame) -> DataFrame:
    """Last event and fleet size per run, newest run first."""
    return positions.groupBy("simulation_run_id").agg(
        F.max("event_time").alias("last_event"), F.count_distinct("courier_id").alias("couriers")
    ).orderBy(F.desc("last_event"))


def freshest_positions(courier_latest: DataFrame, as_of: Column, n: int = 12) -> DataFrame:
    return courier_latest.select(
        "simulation_run_id", "courier_id", "order_id", "latitude", "longitude", "event_time",
        seconds_between(F.col("event_time"), as_of).alias("age_seconds"),
    ).orderBy(F.desc("event_time"), "courier_id").limit(n)


def amounts_by_status(order_latest: DataFrame) -> DataFrame:
    """Orders and euro amounts per run and status; fleets are never mixed."""
    return order_latest.groupBy("simulation_run_id", "status").agg(
        F.count(F.lit(1)).alias("orders"), euros(F.sum("amount_minor")).alias("amount_eur")
    )


def class_board(records: DataFrame, order_latest: DataFrame, run_id: str) -> DataFrame:
    """Class records with the published state of their order."""
    ids = records.select("order_id").distinct()
    published = _run(order_latest, run_id).join(ids, "order_id", "left_semi").select(
        "order_id", "courier_id", "status", "dropoff_lat", "dropoff_lon", "event_time", F.lit(True).alias("_published")
    )
    return records.join(published, "order_id", "left").withColumn(
        "published", F.coalesce("_published", F.lit(False))
    ).drop("_published")


def class_catalog(products: DataFrame, n: int = 50) -> DataFrame:
    return newest_of("demo_products", products).select("product_id", "restaurant_id", "product_name", "price_minor").orderBy(
        "product_id"
    ).limit(n)


def minute_sessions(activity: DataFrame) -> DataFrame:
    """Active sessions per minute over all runs."""
    return active_members(
        activity.withColumn("bucket", F.date_trunc("MINUTE", "event_time")), ["bucket"], "session_id", {}, "active_sessions"
    )
