"""Live reports: kind split, boards, lookups, flows, summaries."""

import pytest
from pyspark.sql import functions as F

from eventloom import schemas
from eventloom.operators.rollups import id_rollup
from eventloom.operators.versioning import latest_of
from eventloom.plans import filters, live
from eventloom.streaming.ingest import ROLLUP_KEYS
from tests.test_journey import activity_row
from tests.test_state import gps

RUN = "run"
STEPS = ["search", "open_restaurant", "open_product", "add_to_cart", "checkout"]


def order(after, oid, status, offset, promised=600, run=RUN, courier="k1", amount=900):
    return dict(
        schema_version=1, event_id=f"{oid}-{status}", simulation_run_id=run, event_time=after(offset), ingested_at=after(offset),
        city_id="madrid", order_id=oid, courier_id=courier, restaurant_id="shop", status=status, amount_minor=amount, currency="EUR",
        pickup_lat=0.0, pickup_lon=0.0, dropoff_lat=0.0, dropoff_lon=0.0, order_created_at=after(0), promised_delivery_at=after(promised),
        source="x", source_kind="synthetic",
    )


def purchase(after, oid, mode, offset=0, run=RUN):
    return dict(
        schema_version=1, event_id=f"p{oid}", simulation_run_id=run, order_id=oid, customer_id=f"c{oid}", session_id=f"s{oid}",
        checkout_event_id=f"e{oid}", event_time=after(offset), ingested_at=after(offset), restaurant_id="shop",
        items=[("meal", 1, 900)], amount_minor=900, currency="EUR", decision_mode=mode, source_kind="synthetic",
    )


@pytest.fixture(scope="module")
def data(spark, after):
    orders = spark.createDataFrame([
        order(after, "a", "created", 0, courier=schemas.UNASSIGNED), order(after, "a", "delivered", 50),
        order(after, "b", "created", 10, promised=20), order(after, "c", "created", 20, courier=schemas.UNASSIGNED),
        order(after, "c", "cancelled", 40), order(after, "a", "created", 5, run="other", amount=1),
    ], schemas.schema("order_events"))
    buys = spark.createDataFrame(
        [purchase(after, "a", "ollama"), purchase(after, "b", "rules"), purchase(after, "c", "manual"), purchase(after, "c", "manual")],
        schemas.schema("customer_orders"),
    )
    return latest_of("order_events", orders), buys


def test_kind_split(data, after):
    latest, buys = data
    got = {r.kind: r.asDict() for r in live.order_metrics_by_kind(latest, buys, RUN, F.lit(after(100))).collect()}
    assert (got["ai"]["orders"], got["simulated"]["orders"], got["total"]["orders"]) == (1, 2, 3)
    assert (got["ai"]["delivered_amount_minor"], got["simulated"]["late"], got["simulated"]["cancelled"]) == (900, 1, 1)
    assert live.order_metrics_by_kind(latest, buys, "nobody", F.lit(after(0))).count() == 3


def test_board_order(data):
    latest, buys = data
    board = live.enrich_orders(live.board_orders(latest, RUN), buys, RUN)
    assert [r.order_id for r in live.board_orders(latest, RUN).collect()] == ["b", "a", "c"]
    assert {r.order_id: r.customer_id for r in board.collect()} == {"a": "ca", "b": "cb", "c": "cc"}


def test_lookup_stays_in_its_run(data):
    latest, _ = data
    assert live.order_state(latest, RUN, "a").first().amount_minor == 900
    assert live.order_state(latest, "other", "a").first().amount_minor == 1
    assert live.order_state(latest, "other", "b").isEmpty()


def test_lookup_beyond_the_board(spark, after):
    many = spark.createDataFrame([order(after, f"o{i}", "created", i) for i in range(260)], schemas.schema("order_events"))
    latest = latest_of("order_events", many)
    board = live.board_orders(latest, RUN)
    assert board.count() == 200 and board.filter("order_id = 'o3'").isEmpty()
    assert live.order_state(latest, RUN, "o3").first().status == "created"


def flow_rows(after):
    out = []
    for n, mode in ((0, "ollama"), (1, "rules")):
        out += [activity_row(after, n, 0, "session_started", 0)]
        out += [activity_row(after, n, i, a, i, mode) for i, a in enumerate(STEPS, start=1)]
    return out + [activity_row(after, n, 0, "session_started", 0) for n in (2, 3)]


def test_customer_flow_split(spark, after):
    rows = flow_rows(after)
    df = spark.createDataFrame(rows + rows[:4], schemas.schema("customer_activity"))
    got = {r.kind: r for r in live.customer_flow(df, RUN).collect()}
    ai, other, total = got["ai"], got["simulated"], got["total"]
    assert (ai.sessions, ai.checkouts, ai.model_decisions, ai.clicks) == (1, 1, 5, 5)
    assert (other.sessions, other.checkouts, other.model_decisions) == (3, 1, 0)
    assert (total.sessions, total.purchasing_sessions, total.abandoned_sessions) == (4, 2, 0)


def test_recent_activity_keeps_rare_decisions(spark, after):
    rows = [activity_row(after, 1, i, "search", i) for i in range(80)] + [activity_row(after, 2, 0, "search", -50, "ollama")]
    df = spark.createDataFrame(rows, schemas.schema("customer_activity"))
    recent = live.recent_activity(df, RUN)
    assert recent.count() == 31 and recent.filter("decision_mode = 'ollama'").count() == 1
    assert "WindowGroupLimit" in recent._jdf.queryExecution().executedPlan().toString()


def test_track_and_freshness(spark, after):
    df = gps(spark, after)
    track = live.courier_track(df, RUN, "k1", 3).collect()
    assert [round(r.latitude, 3) for r in track] == [40.401, 40.402, 40.403]
    seen = live.couriers(latest_of("courier_positions", df), RUN, F.lit(after(10))).first()
    assert (seen.age_ms, seen.receipt_delay_ms) == (7000, 0)
    assert [r.positions for r in live.position_rate(df, RUN, F.lit(after(60))).collect()] == [12]
    assert live.position_rate(df, RUN, F.lit(after(600))).isEmpty()


def test_labels_use_the_newest_catalog(spark, after, collect):
    products = spark.createDataFrame(
        [("meal", "shop", n, 900, "EUR", "synthetic", "synthetic", None, None, v) for n, v in (("old", 1), ("new", 2))], schemas.schema("demo_products")
    )
    shops = spark.createDataFrame([("shop", "Shop", "madrid", 0.0, 0.0, "synthetic", "synthetic", 1)], schemas.schema("demo_restaurants"))
    rows = spark.createDataFrame([("meal", "shop"), ("ghost", None)], "product_id STRING, restaurant_id STRING")
    assert sorted(((r.product_name, r.restaurant_name) for r in live.labelled(rows, products, shops).collect()), key=str) == [("new", "Shop"), (None, None)]
    assert "version" not in live.demo_catalog("demo_products", products).columns


def test_summary_filters_and_truncation(spark, after):
    rows = [(f"e{i}", "synthetic", after(0).date(), f"city{i % 4}", "home", "search") for i in range(8)]
    states = id_rollup(spark.createDataFrame(rows, "event_id STRING, source_kind STRING, event_date DATE, city_id STRING, section STRING, event_type STRING"), ROLLUP_KEYS, "event_id")
    cut = live.daily_summary(states, {}, limit=3)
    assert cut["rows"].count() == 3 and tuple(cut["totals"].first()) == (8, 4, True)
    one = live.daily_summary(states, {"city_id": "city1", "from": "2026-10-31", "to": "2026-10-31"})
    assert tuple(one["totals"].first()) == (2, 1, False)
    assert tuple(live.daily_summary(states, {"city_id": "none"})["totals"].first()) == (0, 0, False)
    assert {r.event_type: r.events for r in live.navigation_totals(states, "synthetic", "city1").collect()}["search"] == 2


def test_filters_are_closed_sets():
    for bad in (
        lambda: filters.historical("otto", {"period": "ALL"}), lambda: filters.historical("nothing", {}),
        lambda: filters.historical("rees46", {"period": "201801"}), lambda: filters.historical("eleme", {"period": "9"}),
        lambda: filters.historical("glovo", {"country": "Spain"}), lambda: filters.historical("glovo", {"country": "ALL", "city": "MAD"}),
        lambda: filters.journey_kind("robots"), lambda: filters.summary({"from": "2024-02-01", "to": "2024-01-01"}),
        lambda: filters.summary({"table": "x"}), lambda: filters.summary({"city_id": ""}), lambda: filters.summary({"event_type": "paid"}),
    ):
        with pytest.raises(ValueError):
            bad()
    assert filters.historical("glovo", {})["country"] == "ES"
    assert filters.historical("rees46", {})["period"] == "ALL"
