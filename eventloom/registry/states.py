"""Versions, latest state, rollups, comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom import schemas
from eventloom.operators import compare
from eventloom.operators.joins import coverage, split_by_flag
from eventloom.operators.rollups import (
    hll_rollup, id_rollup, read_hll_rollup, read_id_rollup, read_sum_rollup, rollup_check, sum_rollup,
)
from eventloom.operators.versioning import (
    latest_from_long_history, latest_of, latest_state, merge_states, newest, newest_of, newest_of_repeated, partial_state, read_state, with_tombstones,
)
from eventloom.plans import audits, measurement
from eventloom.registry import query
from eventloom.registry.views import (
    activity, app_events, app_states, archive, day, ev, ms, order_events, plain, positions, purchases, table, union_all, with_sql,
)

_USER_LATEST = with_sql("ev") + f"""SELECT user_id, arg_max(event_type, row(moment, event_id)) AS event_type,
    arg_max(value, row(moment, event_id)) AS value, {ms('max(moment)')} AS last_seen FROM ev GROUP BY user_id"""


@query("latest_state_user", _USER_LATEST)
def latest_state_user(spark, sf_dir):
    states = latest_state(ev(spark, sf_dir), ["user_id"], ["event_type", "value", "moment"], ["moment", "event_id"])
    return plain(states.withColumnRenamed("moment", "last_seen"))


@query("latest_state_merged", _USER_LATEST)
def latest_state_merged(spark, sf_dir):
    """Partial states per day, merged in two rounds with some of them repeated."""
    days = ev(spark, sf_dir).withColumn("batch", F.dayofmonth("moment"))
    partial = partial_state(days, ["batch", "user_id"], ["event_type", "value", "moment"], ["moment", "event_id"])
    weekly = merge_states(partial.withColumn("week", F.floor(F.col("batch") / 7)), ["week", "user_id"])
    both = union_all([partial.drop("batch"), weekly.drop("week")])
    return plain(read_state(both, ["user_id"]).withColumnRenamed("moment", "last_seen"))


@query("final_activity", with_sql("act") + f"SELECT event_id, customer_id, reason, {ms('ingested_at')} AS ingested_at FROM act")
def final_activity(spark, sf_dir):
    return plain(newest_of("customer_activity", activity(spark, sf_dir)).select("event_id", "customer_id", "reason", "ingested_at"))


@query("final_lineitem", f"""SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, l_suppkey, l_quantity, {ms('l_shipdate')} AS l_shipdate FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
    ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC) = 1""")
def final_lineitem(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").drop("l_discount", "l_tax", "l_returnflag", "l_linestatus")
    rows = newest_of_repeated(li, ["l_orderkey", "l_linenumber"], "l_shipdate", ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"])
    return plain(rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate"))


@query("tombstones", with_sql("ev") + """SELECT event_id, CASE WHEN event_type = 'purchase' THEN 0 ELSE value END AS value
    FROM ev WHERE event_type <> 'error'""")
def tombstones(spark, sf_dir):
    """Corrections and deletions appended as newer versions."""
    first = ev(spark, sf_dir).select("event_id", "event_type", "value", F.lit(1).alias("version"), F.lit(False).alias("is_deleted"))
    fixes = first.filter(F.col("event_type") == "purchase").withColumn("value", F.lit(0.0)).withColumn("version", F.lit(2))
    drops = first.filter(F.col("event_type") == "error").withColumn("is_deleted", F.lit(True)).withColumn("version", F.lit(3))
    return plain(with_tombstones(union_all([first, fixes, drops]), ["event_id"], "version").select("event_id", "value"))


@query("courier_latest", with_sql("courier_latest") + f"""SELECT courier_id, order_id, latitude, longitude, {ms('event_time')} AS event_time
    FROM courier_latest""")
def courier_latest(spark, sf_dir):
    out = latest_of("courier_positions", positions(spark, sf_dir))
    return plain(out.select("courier_id", "order_id", "latitude", "longitude", "event_time"))


@query("order_latest", with_sql("order_latest") + f"""SELECT order_id, courier_id, status, amount_minor, {ms('event_time')} AS event_time
    FROM order_latest""")
def order_latest(spark, sf_dir):
    out = latest_of("order_events", order_events(spark, sf_dir))
    return plain(out.select("order_id", "courier_id", "status", "amount_minor", "event_time"))


@query("customer_latest", with_sql("act") + f"""SELECT customer_id, arg_max(session_id, row(event_time, event_id)) AS session_id,
    arg_max(action, row(event_time, event_id)) AS action, {ms('max(event_time)')} AS event_time FROM act GROUP BY customer_id""")
def customer_latest(spark, sf_dir):
    out = latest_of("customer_activity", activity(spark, sf_dir))
    return plain(out.select("customer_id", "session_id", "action", "event_time"))


@query("latest_long_history", with_sql("ev") + f"""SELECT CASE WHEN user_id % 5 <> 0 THEN user_id END AS member, arg_max(event_type, row(moment, event_id)) AS event_type,
    {ms('max(moment)')} AS last_seen FROM ev GROUP BY 1""")
def latest_long_history(spark, sf_dir):
    """Latest state straight from history; members without an id are one entity."""
    e = ev(spark, sf_dir).withColumn("member", F.when(F.col("user_id") % 5 != 0, F.col("user_id")))
    out = latest_from_long_history(e, ["member"], ["event_type", "moment"], ["moment", "event_id"])
    return plain(out.withColumnRenamed("moment", "last_seen"))


@query("latest_history_vs_prepared", "SELECT 0::BIGINT AS different_rows, true AS same")
def latest_history_vs_prepared(spark, sf_dir):
    """The prepared states give exactly the answer of the history."""
    history = positions(spark, sf_dir)
    hours = history.withColumn("batch", F.hour("ingested_at"))
    keys = schemas.LATEST_KEYS["courier_positions"]
    states = partial_state(hours, ["batch", *keys], schemas.LATEST_PAYLOAD["courier_positions"]).drop("batch")
    # Retries share the event weight, so the compared payload leaves the ingest time out.
    a = measurement.latest_from_history(history, "run-0", "madrid").drop("ingested_at")
    b = measurement.latest_from_state(states, "run-0", "madrid").drop("ingested_at")
    return plain(compare.same_rows(a, b))


@query("physical_vs_logical", with_sql("positions3") + """SELECT simulation_run_id, count(*) AS physical_rows,
    count(DISTINCT event_id) AS logical_rows FROM positions3 GROUP BY 1""")
def physical_vs_logical(spark, sf_dir):
    return plain(compare.physical_vs_logical(positions(spark, sf_dir, 3), ["simulation_run_id"], "event_id"))


# Rollups ------------------------------------------------------------------------------------


@query("rollup_sum_daily", with_sql("archive") + f"""SELECT {day('CAST(event_time AS DATE)')} AS event_date, event_type, count(*) AS events
    FROM archive GROUP BY ALL""")
def rollup_sum_daily(spark, sf_dir):
    days = archive(spark, sf_dir).withColumn("event_date", F.to_date("event_time")).withColumn("batch", F.hour("event_time"))
    partials = sum_rollup(days, ["batch", "event_date", "event_type"]).drop("batch")
    return plain(read_sum_rollup(partials, ["event_date", "event_type"]))


@query("rollup_check", with_sql("archive") + """SELECT count(*) AS archive_events, count(*) AS rollup_events,
    count(DISTINCT row(CAST(event_time AS DATE), event_type)) AS logical_keys, true AS same FROM archive""")
def archive_rollup_check(spark, sf_dir):
    a = archive(spark, sf_dir).withColumn("event_date", F.to_date("event_time"))
    partials = sum_rollup(a.withColumn("batch", F.hour("event_time")), ["batch", "event_date", "event_type"]).drop("batch")
    return plain(rollup_check(a, partials, ["event_date", "event_type"]))


@query("rollup_exact_ids", with_sql("app_daily") + f"""SELECT source_kind, {day('event_date')} AS event_date, city_id, section, event_type, events
    FROM app_daily""")
def rollup_exact_ids(spark, sf_dir):
    from eventloom.plans.live import daily_counts

    return plain(daily_counts(app_states(spark, sf_dir)))


@query("rollup_equals_detail", "SELECT 0::BIGINT AS different_rows, true AS same")
def rollup_equals_detail(spark, sf_dir):
    return plain(audits.detail_matches_rollup(app_events(spark, sf_dir), app_states(spark, sf_dir)))


@query("rollup_hourly_sketch")
def rollup_hourly_sketch(spark, sf_dir):
    """Approximate users per day from mergeable hourly sketches."""
    hourly = hll_rollup(ev(spark, sf_dir).withColumn("hour", F.date_trunc("HOUR", "moment")), ["hour"], "user_id")
    daily = read_hll_rollup(hourly.withColumn("day", F.to_date("hour")), ["day"], name="users_approx")
    return plain(daily)


@query("rollup_sketch_error", with_sql("ev") + f"""SELECT {day('CAST(moment AS DATE)')} AS day, count(DISTINCT user_id) AS users, true AS within_5_pct
    FROM ev GROUP BY 1""")
def rollup_sketch_error(spark, sf_dir):
    """The sketch against the exact count, per day."""
    days = ev(spark, sf_dir).withColumn("day", F.to_date("moment"))
    exact = read_id_rollup(id_rollup(days, ["day"], "user_id"), ["day"], "user_id", "users")
    approx = read_hll_rollup(hll_rollup(days, ["day"], "user_id"), ["day"], name="approx")
    error = F.abs(F.col("approx") - F.col("users")) / F.col("users")
    return plain(exact.join(approx, "day").select("day", "users", (error <= 0.05).alias("within_5_pct")))


@query("approx_users_by_type")
def approx_users_by_type(spark, sf_dir):
    return plain(ev(spark, sf_dir).groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.01).alias("users_approx")))


# Comparison ------------------------------------------------------------------------------------


@query("compare_designs", with_sql("archive") + """, g AS (SELECT 1 FROM archive GROUP BY CAST(event_time AS DATE), event_type)
    SELECT count(*) AS detail_groups, count(*) AS prepared_groups, true AS same_result FROM g""")
def compare_archive(spark, sf_dir):
    a = archive(spark, sf_dir)
    partials = sum_rollup(
        a.withColumn("event_date", F.to_date("event_time")).withColumn("batch", F.hour("event_time")),
        ["batch", "event_date", "event_type"],
    ).drop("batch")
    return plain(measurement.benchmark(measurement.archive_detail(a), measurement.archive_prepared(partials)))


@query("compare_designs_broken", with_sql("archive") + """, g AS (SELECT event_type FROM archive GROUP BY CAST(event_time AS DATE), event_type)
    SELECT count(*) AS detail_groups, count(*) FILTER (WHERE event_type <> 'orders') AS prepared_groups, false AS same_result FROM g""")
def compare_broken(spark, sf_dir):
    """A rollup that lost one type must not compare equal."""
    detail = measurement.archive_detail(archive(spark, sf_dir))
    return plain(measurement.benchmark(detail, detail.filter(F.col("event_type") != "orders")))


@query("diff_rows", with_sql("ev") + """, a AS (SELECT user_id, event_type, count(*) AS n FROM ev GROUP BY ALL),
    b AS (SELECT user_id, event_type, count(*) AS n FROM ev WHERE k < 50 GROUP BY ALL)
    SELECT a.user_id, a.event_type, a.n - coalesce(b.n, 0) AS surplus FROM a LEFT JOIN b USING (user_id, event_type)
    WHERE a.n <> coalesce(b.n, 0)""")
def diff(spark, sf_dir):
    e = ev(spark, sf_dir)
    return plain(compare.diff_rows(e.select("user_id", "event_type"), e.filter("k < 50").select("user_id", "event_type")))


@query("fingerprint_lineitem")
def fingerprint_lineitem(spark, sf_dir):
    out = compare.fingerprint(table(spark, sf_dir, "lineitem"))
    return out.select("rows", "xor_hash", F.col("sum_hash").cast("string").alias("sum_hash"))


@query("canonical_check", "SELECT count(DISTINCT user_id) AS keys, count(DISTINCT user_id) AS rows, true AS valid FROM events")
def canonical(spark, sf_dir):
    """Group count and key uniqueness of a latest-state answer."""
    e = ev(spark, sf_dir)
    states = latest_state(e, ["user_id"], ["event_type", "moment"], ["moment", "event_id"])
    expected = e.select("user_id").distinct().count()  # one number, from the events themselves
    return plain(compare.canonical_check(states, "user_id", expected).select("keys", "rows", "valid"))


@query("labelled_counts", """SELECT 'customers' AS table_name, count(*) AS rows FROM customer UNION ALL
    SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'order lines', count(*) FROM lineitem""")
def labelled_counts(spark, sf_dir):
    names = {"customers": "customer", "orders": "orders", "order lines": "lineitem"}
    return plain(compare.labelled_counts([(label, table(spark, sf_dir, t)) for label, t in names.items()]))


@query("coverage", """SELECT count(*) AS expected, count(*) FILTER (WHERE o_custkey IS NOT NULL) AS found,
    count(*) = count(*) FILTER (WHERE o_custkey IS NOT NULL) AS complete
    FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders) ON c_custkey = o_custkey""")
def customer_coverage(spark, sf_dir):
    return plain(coverage(
        table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")),
        table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")), "key",
    ))


@query("semi_and_anti", with_sql("ev") + """, f AS (SELECT DISTINCT user_id FROM ev WHERE event_type = 'error' AND k < 3)
    SELECT event_type, count(*) FILTER (WHERE user_id IN (SELECT user_id FROM f)) AS flagged,
    count(*) FILTER (WHERE user_id NOT IN (SELECT user_id FROM f)) AS others FROM ev GROUP BY event_type""")
def semi_and_anti(spark, sf_dir):
    inside, outside = split_by_flag(ev(spark, sf_dir), "user_id", (F.col("event_type") == "error") & (F.col("k") < 3))
    both = inside.withColumn("_in", F.lit(True)).unionByName(outside.withColumn("_in", F.lit(False)))
    return plain(both.groupBy("event_type").agg(F.count_if("_in").alias("flagged"), F.count_if(~F.col("_in")).alias("others")))


# Audits ---------------------------------------------------------------------------------------


@query("actions_of_source", with_sql("app_events") + """SELECT event_type, count(DISTINCT event_id) AS events FROM app_events
    WHERE source = 'miniapp' GROUP BY 1""")
def actions_of_source(spark, sf_dir):
    return plain(audits.actions_of_source(app_events(spark, sf_dir), "miniapp"))


@query("purchase_clicks", with_sql("buys", "app") + """SELECT b.order_id, b.amount_minor, 1::BIGINT AS items, a.event_type FROM buys b
    JOIN app a ON a.event_id = b.checkout_event_id WHERE b.decision_mode = 'manual'""")
def purchase_clicks(spark, sf_dir):
    out = audits.purchase_clicks(purchases(spark, sf_dir), app_events(spark, sf_dir))
    return plain(out.withColumn("items", F.size("items")))


@query("status_history", with_sql("order_events") + f"SELECT status, courier_id, {ms('event_time')} AS event_time FROM order_events WHERE order_id = 'o10'")
def status_history(spark, sf_dir):
    return plain(audits.status_history(order_events(spark, sf_dir), "o10"))


@query("status_sets", with_sql("order_events") + """, s AS (SELECT order_id, array_to_string(list_sort(list(DISTINCT status)), ',') AS statuses
    FROM order_events GROUP BY order_id) SELECT statuses, count(*) AS orders FROM s GROUP BY statuses""")
def status_sets(spark, sf_dir):
    sets = audits.status_sets(order_events(spark, sf_dir)).withColumn("statuses", F.array_join("statuses", ","))
    return plain(sets.groupBy("statuses").agg(F.count(F.lit(1)).alias("orders")))


@query("gps_coverage", with_sql("positions") + f"""SELECT order_id, count(DISTINCT event_id) AS positions, count(DISTINCT courier_id) AS couriers,
    {ms('min(event_time)')} AS first, {ms('max(event_time)')} AS last FROM positions GROUP BY order_id""")
def gps_coverage(spark, sf_dir):
    return plain(audits.gps_coverage(positions(spark, sf_dir)).drop("simulation_run_id"))
