"""Table layouts, logical keys and closed value sets of the data model."""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql.types import StructType


def _ddl(text: str) -> str:
    return " ".join(text.split())


# --- fixed values: table columns and types -------------------------------------------------
TABLES: dict[str, str] = {
    "app_events": _ddl(
        """schema_version SMALLINT, event_id STRING, session_id STRING, event_time TIMESTAMP, event_date DATE,
        ingested_at TIMESTAMP, event_type STRING, section STRING, city_id STRING, user_id STRING,
        restaurant_id STRING, product_id STRING, source STRING, source_kind STRING, source_record_id STRING,
        simulation_run_id STRING, order_id STRING"""
    ),
    "customer_activity": _ddl(
        """schema_version SMALLINT, event_id STRING, simulation_run_id STRING, customer_id STRING,
        session_id STRING, event_time TIMESTAMP, ingested_at TIMESTAMP, customer_label STRING, objective STRING,
        budget_minor INT, action STRING, stage STRING, reason STRING, restaurant_id STRING, product_id STRING,
        order_id STRING, cart_total_minor INT, decision_mode STRING, model STRING, source_kind STRING"""
    ),
    "customer_orders": _ddl(
        """schema_version SMALLINT, event_id STRING, simulation_run_id STRING, order_id STRING,
        customer_id STRING, session_id STRING, checkout_event_id STRING, event_time TIMESTAMP,
        ingested_at TIMESTAMP, restaurant_id STRING,
        items ARRAY<STRUCT<product_id: STRING, quantity: SMALLINT, unit_price_minor: INT>>,
        amount_minor INT, currency STRING, decision_mode STRING, source_kind STRING"""
    ),
    "courier_positions": _ddl(
        """schema_version SMALLINT, event_id STRING, simulation_run_id STRING, event_time TIMESTAMP,
        ingested_at TIMESTAMP, city_id STRING, courier_id STRING, order_id STRING, latitude DOUBLE,
        longitude DOUBLE, speed_kmh FLOAT, accuracy_m FLOAT, source STRING, source_kind STRING"""
    ),
    "order_events": _ddl(
        """schema_version SMALLINT, event_id STRING, simulation_run_id STRING, event_time TIMESTAMP,
        ingested_at TIMESTAMP, city_id STRING, order_id STRING, courier_id STRING, restaurant_id STRING,
        status STRING, amount_minor INT, currency STRING, pickup_lat DOUBLE, pickup_lon DOUBLE,
        dropoff_lat DOUBLE, dropoff_lon DOUBLE, order_created_at TIMESTAMP, promised_delivery_at TIMESTAMP,
        source STRING, source_kind STRING"""
    ),
    "demo_restaurants": _ddl(
        """restaurant_id STRING, name STRING, city_id STRING, latitude DOUBLE, longitude DOUBLE,
        location_kind STRING, source_kind STRING, version BIGINT"""
    ),
    "demo_products": _ddl(
        """product_id STRING, restaurant_id STRING, product_name STRING, price_minor INT, currency STRING,
        price_kind STRING, name_kind STRING, source_table STRING, source_row INT, version BIGINT"""
    ),
    "restaurants": _ddl("restaurant_id BIGINT, category STRING, area_id BIGINT, score FLOAT"),
    "foods": _ddl("food_id BIGINT, price FLOAT, category STRING"),
    "orders": _ddl(
        """order_id BIGINT, user_id BIGINT, restaurant_id BIGINT, area_id BIGINT, price_band STRING,
        ordered_at TIMESTAMP, period_code STRING, order_date DATE"""
    ),
    "order_items": _ddl("order_date DATE, order_id BIGINT, food_id BIGINT"),
    "clicks": _ddl("order_date DATE, order_id BIGINT, position INT, restaurant_id BIGINT"),
    "click_summary": _ddl(
        """order_date DATE, order_id BIGINT, click_count INT, distinct_restaurants INT,
        last_clicked_restaurant_id BIGINT"""
    ),
    "daily_clicks": _ddl("order_date DATE, restaurant_id BIGINT, clicks BIGINT"),
    "glovo_products": _ddl(
        """source_row INT, country_code STRING, city_code STRING, store_name STRING, product_name STRING,
        collection_section STRING, product_description STRING, has_description SMALLINT, aux_store SMALLINT,
        hier SMALLINT"""
    ),
    "otto_archive": _ddl(
        "session_id BIGINT, article_id BIGINT, event_time TIMESTAMP, event_type STRING, event_position INT"
    ),
    "otto_replay": _ddl(
        """session_id BIGINT, article_id BIGINT, event_time TIMESTAMP, event_type STRING, event_position INT,
        ingested_at TIMESTAMP"""
    ),
    "otto_daily_rollup": _ddl("event_date DATE, event_type STRING, events BIGINT"),
    "otto_scale_benchmark": _ddl(
        "scenario SMALLINT, session_id BIGINT, article_id BIGINT, event_time TIMESTAMP, event_type STRING"
    ),
    "live_clicks": _ddl("click_id STRING, clicked_at TIMESTAMP, section STRING, action STRING"),
    "rees46_events": _ddl(
        """event_time TIMESTAMP, event_date DATE, event_type STRING, product_id BIGINT, category_id BIGINT,
        category_code STRING, brand STRING, price DECIMAL(12,2), user_id BIGINT, user_session STRING"""
    ),
    "eleme_samples": _ddl(
        """source_id STRING, source_file STRING, source_row BIGINT, sample_day SMALLINT, clicked SMALLINT,
        user_id STRING, shop_id STRING, item_id STRING, city_id STRING, district_id STRING, category_id STRING,
        request_hour SMALLINT, weekday STRING, meal_period STRING, request_time_raw STRING, raw_features STRING,
        loaded_at TIMESTAMP"""
    ),
    "criteo_uplift": _ddl(
        """f0 DOUBLE, f1 DOUBLE, f2 DOUBLE, f3 DOUBLE, f4 DOUBLE, f5 DOUBLE, f6 DOUBLE, f7 DOUBLE, f8 DOUBLE,
        f9 DOUBLE, f10 DOUBLE, f11 DOUBLE, treatment SMALLINT, conversion SMALLINT, visit SMALLINT,
        exposure SMALLINT"""
    ),
    "demo_events": _ddl("event_id BIGINT, recorded_at TIMESTAMP, section STRING, action STRING"),
    "eventos_app": _ddl(
        """event_id STRING, ts TIMESTAMP, session_id STRING, user_id BIGINT, origen STRING, seccion STRING,
        accion STRING, restaurante_id BIGINT, plato_id BIGINT, promo_id BIGINT, busqueda STRING,
        filtros ARRAY<STRING>, importe DECIMAL(8,2), dispositivo STRING, distrito STRING"""
    ),
}

# --- fixed values: a logical row is the newest version per full sort key ----------------------
KEYS: dict[str, list[str]] = {
    "app_events": ["source_kind", "event_date", "city_id", "event_type", "event_time", "session_id", "event_id"],
    "customer_activity": ["simulation_run_id", "customer_id", "event_time", "event_id"],
    "customer_orders": ["simulation_run_id", "order_id", "event_id"],
    "courier_positions": ["simulation_run_id", "city_id", "courier_id", "event_time", "event_id"],
    "order_events": ["simulation_run_id", "city_id", "order_id", "event_time", "event_id"],
    "demo_restaurants": ["restaurant_id"],
    "demo_products": ["product_id"],
    "eventos_app": ["origen", "event_date", "session_id", "ts", "event_id"],
}
VERSION: dict[str, str] = {
    "app_events": "ingested_at",
    "customer_activity": "ingested_at",
    "customer_orders": "ingested_at",
    "courier_positions": "ingested_at",
    "order_events": "ingested_at",
    "demo_restaurants": "version",
    "demo_products": "version",
}

# --- fixed values: latest-state payloads per entity ----------------------------------------
LATEST_KEYS = {
    "courier_positions": ["simulation_run_id", "city_id", "courier_id"],
    "order_events": ["simulation_run_id", "city_id", "order_id"],
    "customer_activity": ["simulation_run_id", "customer_id"],
}
LATEST_PAYLOAD = {
    "courier_positions": [
        "latitude", "longitude", "speed_kmh", "accuracy_m", "order_id", "event_time", "ingested_at",
    ],
    "order_events": [
        "status", "courier_id", "restaurant_id", "amount_minor", "currency", "pickup_lat", "pickup_lon",
        "dropoff_lat", "dropoff_lon", "order_created_at", "promised_delivery_at", "event_time", "ingested_at",
    ],
    "customer_activity": [
        "session_id", "event_time", "customer_label", "objective", "budget_minor", "action", "stage", "reason",
        "restaurant_id", "product_id", "order_id", "cart_total_minor", "decision_mode", "model",
    ],
}
LATEST_WEIGHT = ["event_time", "event_id"]

# --- fixed values: closed sets, in the order of their stored codes ----------------------------
SOURCE_KINDS = ["synthetic", "demo_live", "public_historical", "historical_replay"]
ACTIONS = [
    "search", "filter_applied", "restaurant_opened", "product_opened", "product_impression",
    "cart_added", "cart_removed", "session_abandoned", "order_submitted",
]
STATUSES = ["created", "preparing", "picked_up", "en_route", "delivered", "cancelled"]
CLOSED_STATUSES = ["delivered", "cancelled"]
ORIGINS = ["app_real", "simulado"]
SECTIONS = ["inicio", "busqueda", "filtros", "restaurante", "menu", "carrito", "pago", "pedido"]
CLICK_ACTIONS = [
    "search", "open_restaurant", "open_product", "add_to_cart", "remove_from_cart", "checkout", "abandon",
]
JOURNEY_STEPS = ["session_started", "open_product", "add_to_cart", "checkout"]
MODEL_MODE = "ollama"
UNASSIGNED = "00000000-0000-0000-0000-000000000000"
DATASETS = ["otto", "rees46", "eleme", "glovo", "criteo"]
MARKETPLACE_MONTHS = ["201910", "201911", "201912", "202001", "202002", "202003", "202004"]
STREAMS = ["app_events", "courier_positions", "order_events", "customer_activity", "customer_orders"]

MONTH_COLUMN = {
    "app_events": "event_date",
    "customer_activity": "event_time",
    "customer_orders": "event_time",
    "courier_positions": "event_time",
    "order_events": "event_time",
    "otto_archive": "event_time",
    "otto_scale_benchmark": "event_time",
    "rees46_events": "event_date",
    "eventos_app": "ts",
}


def enum_rank(column: Column | str, values: list[str]) -> Column:
    """Sort position of an enumerated value: stored codes order these, not their text."""
    return F.array_position(F.array(*[F.lit(v) for v in values]), F.col(column) if isinstance(column, str) else column)


def schema(table: str) -> StructType:
    """Explicit schema of a table; needs an active session."""
    return StructType.fromDDL(TABLES[table])
