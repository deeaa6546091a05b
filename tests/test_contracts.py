"""Contract negatives, digests, batch acceptance, baskets."""

import json
import uuid

import pytest
from pyspark.sql import functions as F

from eventloom import schemas
from eventloom.functions.scalars import name_uuid
from eventloom.operators import contracts, joins

U = [str(uuid.uuid5(uuid.NAMESPACE_DNS, str(i))) for i in range(9)]
NOW = "2026-10-31 15:01:00"

APP = {
    "schema_version": 1, "event_id": U[0], "session_id": U[1], "event_time": "2026-10-31T15:00:00.123Z", "event_type": "search",
    "section": "home", "city_id": "madrid", "source": "app", "source_kind": "synthetic", "simulation_run_id": U[2],
}
GPS = {
    "schema_version": 1, "event_id": U[0], "simulation_run_id": U[2], "event_time": "2026-10-31T15:00:00Z", "city_id": "madrid",
    "courier_id": U[3], "order_id": U[4], "source": "gps", "source_kind": "synthetic", "latitude": 40.4, "longitude": -3,
    "speed_kmh": 12.5, "accuracy_m": 5,
}
ORDER = {
    **{k: v for k, v in GPS.items() if k not in ("latitude", "longitude", "speed_kmh", "accuracy_m")}, "restaurant_id": "shop",
    "status": "created", "amount_minor": 900, "currency": "EUR", "pickup_lat": 40.0, "pickup_lon": -3.0, "dropoff_lat": 40.1, "dropoff_lon": -3.1,
    "order_created_at": "2026-10-31T14:59:00Z", "promised_delivery_at": "2026-10-31T15:30:00Z",
}


def reasons(spark, parse, *texts):
    df = spark.createDataFrame([(t if isinstance(t, str) else json.dumps(t),) for t in texts], "payload STRING")
    return [set(r.reasons) for r in parse(df, F.lit(NOW).cast("timestamp")).collect()]


def app(spark, *texts):
    return reasons(spark, contracts.parse_app_events, *texts)


def telemetry(stream):
    return lambda df, now: contracts.parse_telemetry(df, stream, now)


def without(d, *keys):
    return {k: v for k, v in d.items() if k not in keys}


def test_valid_app_events(spark):
    fine = [
        APP, dict(APP, user_id=None), dict(APP, event_time="2026-10-31T17:00:00+02:00"), dict(APP, order_id=U[5]),
        dict(APP, event_type="cart_added", restaurant_id="r", product_id="p"), dict(APP, event_id=U[0].upper()),
        dict(without(APP, "simulation_run_id"), source_kind="historical_replay", source_record_id="7"),
        dict(without(APP, "simulation_run_id"), source_kind="demo_live"), dict(APP, section="x" * 160),
        dict(APP, event_time="2026-10-31T15:05:59Z"),
    ]
    assert app(spark, *fine) == [set()] * len(fine)


@pytest.fixture(scope="module")
def app_negatives(spark):
    cases = {
        "not_an_object": ["[1]", "nonsense", '"text"'],
        "schema_version": [dict(APP, schema_version=True), dict(APP, schema_version=2), dict(APP, schema_version="1"), dict(APP, schema_version=1.5)],
        "missing_field": [without(APP, "section")], "unknown_field": [dict(APP, colour="red")],
        "text:section": [dict(APP, section=""), dict(APP, section="x" * 161), dict(APP, section="a\0b"), dict(APP, section=5)],
        "uuid:event_id": [dict(APP, event_id="nope")], "uuid:simulation_run_id": [dict(APP, simulation_run_id="nope")],
        "uuid:order_id": [dict(APP, order_id="nope")], "text:user_id": [dict(APP, user_id=""), dict(APP, user_id=9)],
        "event_type": [dict(APP, event_type="paid")], "source_kind": [dict(APP, source_kind="real")],
        "event_time": [dict(APP, event_time=t) for t in ("2026-10-31T15:00:00", "1999-12-31T23:59:59Z", "2026-10-31T15:06:01Z", "soon")],
        "run_required": [without(APP, "simulation_run_id"), dict(APP, simulation_run_id=None)],
        "source_record_required": [dict(APP, source_kind="public_historical")],
        "restaurant_required": [dict(APP, event_type="cart_added", product_id="p")],
        "product_required": [dict(APP, event_type="product_opened", restaurant_id="r")],
    }
    flat = [(reason, text) for reason, texts in cases.items() for text in texts]
    return list(zip([r for r, _ in flat], app(spark, *[t for _, t in flat])))


def test_app_negatives(app_negatives):
    assert all(reason in found for reason, found in app_negatives), app_negatives


def test_app_values_are_canonical(spark):
    df = spark.createDataFrame([(json.dumps(dict(APP, event_id=U[0].upper(), event_time="2026-10-31T17:00:00.1239+02:00")),)], "payload STRING")
    row = contracts.parse_app_events(df, F.lit(NOW).cast("timestamp")).select("event_id", F.date_format("event_time", "HH:mm:ss.SSSSSS")).first()
    assert tuple(row) == (U[0], "15:00:00.123000")


def test_positions(spark):
    parse = telemetry("courier_positions")
    assert reasons(spark, parse, GPS, dict(GPS, latitude=90)) == [set(), set()]
    for change, reason in [
        ({"longitude": 181}, "range:longitude"), ({"speed_kmh": -1}, "range:speed_kmh"), ({"accuracy_m": True}, "range:accuracy_m"),
        ({"source_kind": "demo_live"}, "source_kind"), ({"extra": 1}, "fields"), ({"latitude": "40"}, "range:latitude"),
        ({"courier_id": None}, "uuid:courier_id"),
    ]:
        assert reason in reasons(spark, parse, dict(GPS, **change))[0], change
    assert reasons(spark, parse, json.dumps(dict(GPS, latitude=float("nan"))))[0]


def test_order_snapshots(spark):
    parse = telemetry("order_events")
    assert reasons(spark, parse, ORDER) == [set()]
    for change, reason in [
        ({"amount_minor": 10.5}, "amount_minor"), ({"amount_minor": 1_000_001}, "amount_minor"), ({"status": "lost"}, "status"),
        ({"currency": "USD"}, "currency"), ({"order_created_at": "2026-10-31T15:00:30Z"}, "order_times"),
        ({"promised_delivery_at": "2026-10-31T14:58:00Z"}, "order_times"), ({"promised_delivery_at": "2026-11-02T15:00:00Z"}, "promised_delivery_at"),
    ]:
        assert reason in reasons(spark, parse, dict(ORDER, **change))[0], change


def test_name_uuid_is_version_five(spark):
    got = spark.range(50).select(name_uuid(str(uuid.NAMESPACE_URL), F.concat(F.lit("é:"), F.col("id").cast("string"))).alias("u")).collect()
    assert [r.u for r in got] == [str(uuid.uuid5(uuid.NAMESPACE_URL, f"é:{i}")) for i in range(50)]


# Acceptance ---------------------------------------------------------------------------------


def batch(spark, data):
    return contracts.with_digest(spark.createDataFrame(data, "event_id STRING, city STRING"), ["event_id", "city"])


def test_duplicates_and_conflicts(spark):
    ledger = batch(spark, [("a", "madrid")]).select("event_id", "digest")
    good = contracts.batch_summary(contracts.classify_batch(batch(spark, [("a", "madrid"), ("b", "x"), ("b", "x"), ("c", "y")]), ledger)).first()
    assert tuple(good) == (4, 2, 2, 0, "queued")
    again = contracts.batch_summary(contracts.classify_batch(batch(spark, [("a", "madrid")]), ledger)).first()
    assert tuple(again) == (1, 0, 1, 0, "already_accepted")
    other_city = contracts.batch_summary(contracts.classify_batch(batch(spark, [("a", "sevilla"), ("b", "x")]), ledger)).first()
    assert tuple(other_city) == (2, 0, 0, 1, "rejected")
    inside = contracts.batch_summary(contracts.classify_batch(batch(spark, [("z", "1"), ("z", "2")]), ledger)).first()
    assert inside.state == "rejected"


def test_digest_ignores_column_order(spark):
    df = spark.createDataFrame([("a", "madrid")], "event_id STRING, city STRING")
    one = contracts.with_digest(df, ["event_id", "city"]).first().digest
    two = contracts.with_digest(df.select("city", "event_id"), ["city", "event_id"]).first().digest
    assert one == two


# Baskets ------------------------------------------------------------------------------------


def price(spark, lines):
    catalog = spark.createDataFrame([("meal", "shop", 900), ("soup", "shop", 450), ("foreign", "other", 700)], "product_id STRING, restaurant_id STRING, price_minor INT")
    df = spark.createDataFrame([("o", "shop", p, q) for p, q in lines], "order_id STRING, restaurant_id STRING, product_id STRING, quantity INT")
    row = contracts.price_baskets(df, catalog).first()
    return row.amount_minor, set(row.reasons)


def test_baskets(spark):
    assert price(spark, [("meal", 1)]) == (900, set())
    assert price(spark, [("meal", 2), ("soup", 3)]) == (3150, set())
    assert price(spark, [("meal", 1), ("foreign", 1)])[1] == {"restaurant"}
    assert price(spark, [("ghost", 1)])[1] == {"restaurant"}
    assert price(spark, [("meal", 1), ("meal", 1)])[1] == {"repeated_product"}
    assert price(spark, [("meal", 0)])[1] == {"quantity"}
    assert price(spark, [("meal", 11)])[1] == {"quantity"}
    assert price(spark, [("meal", 10), ("soup", 11)])[1] == {"quantity", "units"}


def test_lines_are_dealt_before_they_are_grouped(spark):
    """A scan of lines that hardly repeat builds no groups: its memory would grow with its share of the file."""
    lines = spark.range(40).selectExpr("id % 9 AS order_id", "id % 9 % 2 AS restaurant_id", "id % 6 AS product_id", "1 AS quantity")
    catalog = spark.range(6).selectExpr("id AS product_id", "id % 2 AS restaurant_id", "CAST(100 AS INT) AS price_minor")
    priced = contracts.price_baskets(lines, catalog)
    plan = priced._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan.split("hashpartitioning(order_id")[-1], plan
    assert sorted(tuple(r)[:4] for r in priced.collect())[:2] == [(0, 5, 5, 500), (1, 5, 5, 500)]


def test_purchase_links(spark, after):
    buy = dict(order_id="o", session_id="s", checkout_event_id="e", amount_minor=900, items=[("meal", 1, 900)])
    ddl = "order_id STRING, session_id STRING, checkout_event_id STRING, amount_minor INT, items ARRAY<STRUCT<product_id: STRING, quantity: SMALLINT, unit_price_minor: INT>>"
    clicks = spark.createDataFrame([("e", "o", "s"), ("e2", "o", "x")], "event_id STRING, order_id STRING, session_id STRING")
    df = spark.createDataFrame([buy, dict(buy, order_id="o2", checkout_event_id="none"), dict(buy, order_id="o", checkout_event_id="e2", amount_minor=901)], ddl)
    assert joins.link_mismatches(df, clicks).count() == 2
    assert joins.link_integrity(df, clicks).filter("click_found and same_order and same_session and amount_matches").count() == 1


def test_stored_constraints(spark):
    df = spark.createDataFrame([(2, 24, 9), (1, 3, 4)], "clicked INT, request_hour INT, sample_day INT")
    got = [set(r.reasons) for r in contracts.check(df, contracts.table_rules("eleme_samples")).collect()]
    assert got == [{"click_binary", "hour_valid", "day_valid"}, set()]
    assert schemas.KEYS.keys() >= schemas.VERSION.keys()
