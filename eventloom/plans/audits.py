"""Integrity audits over streams, rollups and links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from eventloom.operators.compare import same_rows
from eventloom.operators.rollups import read_id_rollup
from eventloom.operators.versioning import newest_of
from eventloom.streaming.ingest import ROLLUP_KEYS

PURCHASE = ["checkout_event_id", "amount_minor", "items", "decision_mode"]


def detail_matches_rollup(app_events: DataFrame, states: DataFrame) -> DataFrame:
    """Logical events per dimension against the exact-ID states."""
    detail = newest_of("app_events", app_events, ["section"]).groupBy(*ROLLUP_KEYS).agg(F.count(F.lit(1)).alias("events"))
    return same_rows(detail, read_id_rollup(states, ROLLUP_KEYS, "event_id"))


def actions_of_source(app_events: DataFrame, source: str) -> DataFrame:
    """Logical actions by type for one sending application."""
    return app_events.filter(F.col("source") == source).groupBy("event_type").agg(F.count_distinct("event_id").alias("events"))


def purchase_clicks(purchases: DataFrame, app_events: DataFrame, decision_mode: str = "manual") -> DataFrame:
    """Purchases with the click that submitted them."""
    bought = newest_of("customer_orders", purchases.filter(F.col("decision_mode") == decision_mode), PURCHASE)
    clicks = newest_of("app_events", app_events, []).select(F.col("event_id").alias("checkout_event_id"), "event_type")
    return bought.join(clicks, "checkout_event_id").select("order_id", "amount_minor", "items", "event_type")


def status_history(order_events: DataFrame, order_id: str) -> DataFrame:
    return newest_of("order_events", order_events.filter(F.col("order_id") == order_id), ["status", "courier_id"]).select(
        "status", "courier_id", "event_time"
    ).orderBy("event_time")


def status_sets(order_events: DataFrame) -> DataFrame:
    """Statuses each order has been in; the status set is closed, so the list stays short."""
    return order_events.groupBy("simulation_run_id", "order_id").agg(F.array_sort(F.collect_set("status")).alias("statuses"))


def gps_coverage(positions: DataFrame) -> DataFrame:
    """Positions, couriers and time span per order."""
    return positions.groupBy("simulation_run_id", "order_id").agg(
        F.count_distinct("event_id").alias("positions"), F.count_distinct("courier_id").alias("couriers"),
        F.min("event_time").alias("first"), F.max("event_time").alias("last"),
    )
