"""Contracts, batch acceptance and baskets over rows built from whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.functions.scalars import name_uuid
from eventloom.operators import contracts
from eventloom.registry import query
from eventloom.registry.views import app_events, ev, plain, positions, table, tag, with_sql
from eventloom.streaming.ingest import parse_stream

NAMESPACE = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
AS_OF = "2024-02-01 00:00:00"


def _as_of():
    return F.lit(AS_OF).cast("timestamp")


def _zoned(column):
    return F.concat(F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))


def app_payloads(spark, sf_dir, *dealt):
    """Browsing events as JSON text; some rows break one rule or another. ``dealt``: what ``repartition`` takes, before the texts are made."""
    c = F.col
    e = ev(spark, sf_dir).repartition(*dealt) if dealt else ev(spark, sf_dir)
    kinds = F.when(c("k") % 2 == 0, "synthetic").otherwise("public_historical")
    action = F.when(c("event_type") == "click", "product_opened").when(c("event_type") == "error", "paid").otherwise("search")
    payload = F.to_json(F.struct(
        F.when(c("k") != 1, 1).otherwise(2).alias("schema_version"),
        F.when(c("k") == 2, "no-uuid").otherwise(name_uuid(NAMESPACE, tag("e", c("event_id")))).alias("event_id"),
        name_uuid(NAMESPACE, tag("s", c("user_id"))).alias("session_id"),
        F.when(c("k") == 3, F.date_format("moment", "yyyy-MM-dd'T'HH:mm:ss")).when(c("k") == 4, F.lit("2030-01-01T00:00:00Z")).otherwise(_zoned("moment")).alias("event_time"),
        action.alias("event_type"), F.lit("home").alias("section"),
        F.when(c("k") == 5, F.repeat(F.lit("x"), 161)).otherwise("madrid").alias("city_id"),
        F.lit("app").alias("source"), kinds.alias("source_kind"),
        F.when(c("k") % 4 != 1, tag("rec", c("event_id"))).alias("source_record_id"),
        F.when(c("k") != 6, name_uuid(NAMESPACE, F.lit("run"))).alias("simulation_run_id"),
        F.when(c("k") != 7, tag("rest", c("k"))).alias("restaurant_id"), F.when(c("k") != 8, tag("prod", c("k"))).alias("product_id"),
        F.when(c("k") == 9, F.lit("surplus")).alias("colour"),
    ))
    return e.select("event_id", payload.alias("payload"))


_APP_RULES = {
    "schema_version": "k = 1", "uuid:event_id": "k = 2", "event_time": "k IN (3, 4)", "text:city_id": "k = 5", "unknown_field": "k = 9",
    "event_type": "event_type = 'error'", "run_required": "k = 6", "source_record_required": "k % 4 = 1",
    "restaurant_required": "k = 7 AND event_type = 'click'", "product_required": "k = 8 AND event_type = 'click'",
}


def _reasons(rules: dict[str, str], view: str) -> str:
    return " UNION ALL ".join(
        f"SELECT * FROM (SELECT '{reason}' AS reason, count(*) AS rows FROM {view} WHERE {where}) WHERE rows > 0" for reason, where in rules.items()
    )


@query("contract_app_events", with_sql("ev") + _reasons(_APP_RULES, "ev"))
def contract_app(spark, sf_dir):
    return plain(contracts.reason_counts(contracts.parse_app_events(app_payloads(spark, sf_dir), _as_of())))


@query("contract_valid_rows", with_sql("ev") + "SELECT count(*) AS received, count(*) FILTER (WHERE NOT (" + " OR ".join(
    f"({w})" for w in _APP_RULES.values()) + ")) AS valid FROM ev")
def contract_valid(spark, sf_dir):
    parsed = contracts.parse_app_events(app_payloads(spark, sf_dir), _as_of())
    return plain(parsed.agg(F.count(F.lit(1)).alias("received"), F.count_if(F.size("reasons") == 0).alias("valid")))


def gps_payloads(spark, sf_dir):
    c = F.col
    uid = lambda p, n: name_uuid(NAMESPACE, tag(p, c(n)))
    payload = F.to_json(F.struct(
        F.lit(1).alias("schema_version"), uid("e", "event_id").alias("event_id"), name_uuid(NAMESPACE, F.lit("run")).alias("simulation_run_id"),
        _zoned("moment").alias("event_time"), F.lit("madrid").alias("city_id"), uid("k", "user_id").alias("courier_id"), uid("o", "k").alias("order_id"),
        c("value").alias("latitude"), F.when(c("k") == 1, 181.0).otherwise(-3.7).alias("longitude"),
        F.when(c("k") == 2, -1.0).otherwise(20.0).alias("speed_kmh"), F.lit(5.0).alias("accuracy_m"), F.lit("gps").alias("source"),
        F.when(c("k") == 3, "demo_live").otherwise("synthetic").alias("source_kind"), F.when(c("k") == 4, F.lit(1)).alias("extra"),
    ))
    return ev(spark, sf_dir).select(payload.alias("payload"))


@query("contract_positions", with_sql("ev") + _reasons({
    "range:latitude": "value > 90", "range:longitude": "k = 1", "range:speed_kmh": "k = 2", "source_kind": "k = 3", "fields": "k = 4",
}, "ev"))
def contract_positions(spark, sf_dir):
    return plain(contracts.reason_counts(contracts.parse_telemetry(gps_payloads(spark, sf_dir), "courier_positions", _as_of())))


def order_payloads(spark, sf_dir):
    c = F.col
    uid = lambda p, n: name_uuid(NAMESPACE, tag(p, c(n)))
    o = table(spark, sf_dir, "orders")
    created = F.lit("2001-09-01 00:00:00").cast("timestamp")
    minor = F.round(c("o_totalprice") * 100).cast("bigint")
    payload = F.to_json(F.struct(
        F.lit(1).alias("schema_version"), uid("e", "o_orderkey").alias("event_id"), name_uuid(NAMESPACE, F.lit("run")).alias("simulation_run_id"),
        _zoned(F.when(c("o_orderkey") % 7 == 0, c("o_orderdate")).otherwise(created)).alias("event_time"), F.lit("madrid").alias("city_id"),
        uid("k", "o_custkey").alias("courier_id"), uid("o", "o_orderkey").alias("order_id"), F.lit("app").alias("source"),
        F.lit("synthetic").alias("source_kind"), F.lit("rest1").alias("restaurant_id"),
        F.when(c("o_orderstatus") == "P", "lost").otherwise("created").alias("status"), minor.alias("amount_minor"),
        F.when(c("o_orderkey") % 11 == 0, "USD").otherwise("EUR").alias("currency"),
        *[F.lit(40.0).alias(n) for n in ("pickup_lat", "pickup_lon", "dropoff_lat", "dropoff_lon")],
        _zoned(created).alias("order_created_at"), _zoned(created).alias("promised_delivery_at"),
    ))
    return o.select(payload.alias("payload"))


@query("contract_order_events", _reasons({
    "status": "o_orderstatus = 'P'", "currency": "o_orderkey % 11 = 0", "amount_minor": "CAST(round(o_totalprice * 100) AS BIGINT) > 1000000",
    "order_times": "o_orderkey % 7 = 0", "event_time": "o_orderkey % 7 = 0 AND o_orderdate < DATE '2000-01-01'",
}, "orders"))
def contract_orders(spark, sf_dir):
    return plain(contracts.reason_counts(contracts.parse_telemetry(order_payloads(spark, sf_dir), "order_events", _as_of())))


@query("table_checks", "SELECT 'gps_lat' AS reason, count(*) AS rows FROM events WHERE value > 90")
def table_checks(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("value").alias("latitude"), F.lit(0.0).alias("longitude"))
    return plain(contracts.reason_counts(contracts.check(rows, contracts.table_rules("courier_positions"))))


@query("order_status_checks", _reasons({"status_valid": "o_orderstatus = 'P'", "currency_eur": "o_orderpriority = '1-URGENT'"}, "orders"))
def status_checks(spark, sf_dir):
    """Stored constraints over rows of which some have no known status or another currency."""
    c = F.col
    rows = table(spark, sf_dir, "orders").select(
        F.when(c("o_orderstatus") == "F", "delivered").when(c("o_orderstatus") == "O", "created").otherwise(c("o_orderstatus")).alias("status"),
        F.when(c("o_orderpriority") == "1-URGENT", "USD").otherwise("EUR").alias("currency"),
    )
    return plain(contracts.reason_counts(contracts.check(rows, contracts.table_rules("order_events"))))


# Acceptance -----------------------------------------------------------------------------------


def _batch(df, cols):
    return contracts.with_digest(df.select(*cols), cols)


@query("batch_accepted", """SELECT count(*) + count(*) FILTER (WHERE event_id % 9 = 0) AS received, count(*) FILTER (WHERE event_id % 2 = 1) AS accepted,
    count(*) + count(*) FILTER (WHERE event_id % 9 = 0) - count(*) FILTER (WHERE event_id % 2 = 1) AS duplicates, 0::BIGINT AS conflicts, 'queued' AS state FROM events""")
def batch_accepted(spark, sf_dir):
    """Half of the identities are in the ledger, some come twice, none conflicts."""
    cols = ["event_id", "event_time", "event_type", "section"]
    batch = _batch(app_events(spark, sf_dir), cols)
    ledger = batch.filter(F.col("event_id").cast("bigint") % 2 == 0).select("event_id", "digest")
    return plain(contracts.batch_summary(contracts.classify_batch(batch, ledger)))


@query("batch_rejected", """SELECT count(*) AS received, 0::BIGINT AS accepted, 0::BIGINT AS duplicates, count(*) FILTER (WHERE event_id % 10 = 0) AS conflicts, 'rejected' AS state FROM events""")
def batch_rejected(spark, sf_dir):
    """Same identity, other content: nothing of the batch is accepted."""
    cols = ["event_id", "event_type", "value"]
    e = ev(spark, sf_dir)
    ledger = _batch(e.filter("event_id % 10 = 0").withColumn("value", F.col("value") + 1), cols).select("event_id", "digest")
    return plain(contracts.batch_summary(contracts.classify_batch(_batch(e, cols), ledger)))


@query("batch_statuses", with_sql("ev") + """SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'conflict' WHEN event_id % 2 = 0 THEN 'duplicate' ELSE 'new' END AS status,
    CASE WHEN event_id % 9 = 0 THEN 2 ELSE 1 END::BIGINT AS copies FROM ev""")
def batch_statuses(spark, sf_dir):
    cols = ["event_id", "event_type", "value"]
    e = ev(spark, sf_dir)
    changed = F.when(F.col("event_id") % 10 == 0, F.col("value") + 1).otherwise(F.col("value"))
    ledger = _batch(e.filter("event_id % 2 = 0").withColumn("value", changed), cols).select("event_id", "digest")
    batch = _batch(e.unionByName(e.filter("event_id % 9 = 0")), cols)
    return plain(contracts.classify_batch(batch, ledger).select("event_id", "status", "copies"))


# Baskets --------------------------------------------------------------------------------------

_BASKET = """WITH p AS (SELECT l_orderkey AS order_id, l_partkey, count(*) AS lines, sum(CAST(l_quantity AS BIGINT) % 12) AS units, min(CAST(l_quantity AS BIGINT) % 12) AS lo,
    max(CAST(l_quantity AS BIGINT) % 12) AS hi FROM lineitem GROUP BY ALL),
    b AS (SELECT order_id, CAST(sum(lines) AS BIGINT) AS lines, CAST(sum(units) AS BIGINT) AS units, max(lines) AS repeat, min(lo) AS lo, max(hi) AS hi,
    bool_and(p_partkey IS NOT NULL AND p_partkey % 4 = order_id % 4) AS known,
    CAST(coalesce(sum(units * CAST(round(p_retailprice * 100) AS BIGINT)), 0) AS BIGINT) AS amount_minor FROM p LEFT JOIN part ON p_partkey = l_partkey GROUP BY order_id),
    r AS (SELECT order_id, lines, units, amount_minor, concat_ws(',', CASE WHEN lines > 20 THEN 'lines' END, CASE WHEN lo < 1 OR hi > 10 THEN 'quantity' END,
    CASE WHEN units > 20 THEN 'units' END, CASE WHEN repeat > 1 THEN 'repeated_product' END, CASE WHEN NOT known THEN 'restaurant' END) AS reasons FROM b)"""


def _baskets(spark, sf_dir):
    c = F.col
    lines = table(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("order_id"), (c("l_orderkey") % 4).alias("restaurant_id"), c("l_partkey").alias("product_id"),
        (c("l_quantity").cast("bigint") % 12).alias("quantity"),
    )
    prices = table(spark, sf_dir, "part").select(
        c("p_partkey").alias("product_id"), (c("p_partkey") % 4).alias("restaurant_id"), F.round(c("p_retailprice") * 100).cast("int").alias("price_minor")
    )
    return contracts.price_baskets(lines, prices)


@query("basket_pricing", _BASKET + " SELECT * FROM r")
def baskets(spark, sf_dir):
    return plain(_baskets(spark, sf_dir).withColumn("reasons", F.array_join("reasons", ",")))


@query("basket_reasons", _BASKET + """ SELECT unnest(string_split(reasons, ',')) AS reason, count(*) AS rows FROM r WHERE reasons <> '' GROUP BY 1""")
def basket_reasons(spark, sf_dir):
    return plain(contracts.reason_counts(_baskets(spark, sf_dir)))


@query("internal_stream_rows", "SELECT count(*) AS rows, count(*) AS valid, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS basket_minor FROM orders")
def internal_rows(spark, sf_dir):
    """Purchases as JSON with positional basket lines, parsed to named structs."""
    from eventloom.operators.joins import basket_amount

    c = F.col
    amount = F.round(c("o_totalprice") * 100).cast("bigint").cast("string")
    line = F.concat(F.lit('[["prod'), (c("o_orderkey") % 36).cast("string"), F.lit('",1,'), amount, F.lit("]]"))
    payload = F.concat(
        F.lit('{"event_id":"p'), c("o_orderkey").cast("string"), F.lit('","simulation_run_id":"r","event_time":"'), _zoned("o_orderdate"),
        F.lit('","items":'), line, F.lit("}"),
    )
    parsed = parse_stream(table(spark, sf_dir, "orders").select(payload.alias("payload")), "customer_orders", _as_of())
    return plain(parsed.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.size("reasons") == 0).alias("valid"), F.sum(basket_amount("items")).alias("basket_minor")
    ))


@query("physical_gps_rows", with_sql("positions") + "SELECT courier_id, count(*) AS rows FROM positions GROUP BY 1")
def gps_rows(spark, sf_dir):
    return plain(positions(spark, sf_dir).groupBy("courier_id").agg(F.count(F.lit(1)).alias("rows")))
