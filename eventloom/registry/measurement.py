"""Order statistics, latency evidence, sequences, query history."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.operators.quantiles import median, nearest_rank, quantile_exact
from eventloom.operators.sequences import continuity, gaps, path_length
from eventloom.plans import measurement
from eventloom.registry import query
from eventloom.registry.views import archive, ev, marketplace, plain, positions, table, tag, with_sql
from eventloom.sources.inventory import file_footers, query_history, recent_queries, storage_inventory
from eventloom.sources.tables import scale_copies

_RANKED = "SELECT {k}, {v} AS v, row_number() OVER (PARTITION BY {k} ORDER BY {v}) AS r, count(*) OVER (PARTITION BY {k}) AS n FROM {t}"


@query("quantile_exact", "WITH x AS (" + _RANKED.format(k="l_returnflag", v="l_extendedprice", t="lineitem") + """)
    SELECT l_returnflag, n, v AS quantile FROM x WHERE r = least(floor(n * 0.5) + 1, n)""")
def quantile(spark, sf_dir):
    return plain(quantile_exact(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice"))


@query("nearest_rank", "WITH x AS (" + _RANKED.format(k="l_returnflag", v="l_extendedprice", t="lineitem") + """)
    SELECT l_returnflag, any_value(n) AS n, max(v) FILTER (WHERE r = ceil(n * 0.5)) AS p50, max(v) FILTER (WHERE r = ceil(n * 0.95)) AS p95
    FROM x GROUP BY l_returnflag""")
def ranks(spark, sf_dir):
    return plain(nearest_rank(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", {"p50": 0.5, "p95": 0.95}))


@query("nearest_rank_quantity", "WITH x AS (" + _RANKED.format(k="l_suppkey", v="l_quantity", t="lineitem") + """)
    SELECT l_suppkey, any_value(n) AS n, max(v) FILTER (WHERE r = ceil(n * 0.95)) AS p95 FROM x GROUP BY l_suppkey""")
def ranks_by_supplier(spark, sf_dir):
    return plain(nearest_rank(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity", {"p95": 0.95}))


@query("median_timing", "SELECT event_type, count(*) AS n, round(median(value), 6) AS median_seconds FROM events GROUP BY 1")
def medians(spark, sf_dir):
    return plain(measurement.median_timing(table(spark, sf_dir, "events"), ["event_type"], "value"))


@query("median_overall", "SELECT count(*) AS n, round(median(o_totalprice), 6) AS median FROM orders")
def median_overall(spark, sf_dir):
    return plain(median(table(spark, sf_dir, "orders"), [], "o_totalprice"))


# Latency evidence --------------------------------------------------------------------------------

_SAMPLE = with_sql("ev") + """, s AS (SELECT event_id AS query_id, CASE WHEN user_id % 2 = 0 THEN 'history' ELSE 'prepared' END AS design,
    user_id % 3 + 1 AS concurrency, event_id % 3 + 1 AS repetition, k >= 2 AS ok,
    CASE WHEN user_id % 2 = 0 THEN value * 10 + 1000 * (user_id % 3) ELSE value END AS wall_ms FROM ev)"""
_PHASE = "design, concurrency, repetition"


def _samples(spark, sf_dir):
    c = F.col
    history = c("user_id") % 2 == 0
    return ev(spark, sf_dir).select(
        c("event_id").alias("query_id"), F.when(history, "history").otherwise("prepared").alias("design"),
        (c("user_id") % 3 + 1).alias("concurrency"), (c("event_id") % 3 + 1).alias("repetition"), (c("k") >= 2).alias("ok"),
        F.when(history, c("value") * 10 + (c("user_id") % 3) * 1000).otherwise(c("value")).alias("wall_ms"),
    )


def _phases(samples):
    return samples.groupBy(*measurement.PHASE).agg(
        F.count(F.lit(1)).alias("requested"), F.lit(10.0).alias("duration_s"), F.lit(1000.0).alias("slo_ms"),
        F.lit("complete").alias("reason"),
    )


_SUMMARY = _SAMPLE + f""", a AS (SELECT {_PHASE}, count(*) AS requested, count(*) FILTER (WHERE ok) AS successful FROM s GROUP BY ALL),
    x AS (SELECT {_PHASE}, wall_ms, row_number() OVER (PARTITION BY {_PHASE} ORDER BY wall_ms) AS r, count(*) OVER (PARTITION BY {_PHASE}) AS n FROM s WHERE ok),
    q AS (SELECT {_PHASE}, max(wall_ms) FILTER (WHERE r = ceil(n * 0.5)) AS p50, max(wall_ms) FILTER (WHERE r = ceil(n * 0.95)) AS p95, max(wall_ms) AS top FROM x GROUP BY ALL),
    p AS (SELECT {_PHASE}, requested, requested AS attempted, successful, requested - successful AS errors, true AS complete, 'complete' AS reason,
    round(p50, 6) AS p50_client_ms, round(p95, 6) AS p95_client_ms, round(top, 6) AS max_client_ms, round(successful / 10.0, 6) AS successful_qps,
    CASE WHEN successful = requested AND p95 <= 1000 THEN 'pass' ELSE 'fail' END AS slo_status FROM a LEFT JOIN q USING ({_PHASE}))"""


@query("phase_summary", _SUMMARY + " SELECT * FROM p")
def phases(spark, sf_dir):
    s = _samples(spark, sf_dir)
    return plain(measurement.phase_summary(s, _phases(s)))


@query("boundary_verdict", _SAMPLE + """, c AS (SELECT DISTINCT concurrency FROM s) SELECT min(concurrency) AS boundary_concurrency, 'boundary' AS verdict FROM c
    WHERE concurrency >= 2""")
def verdict(spark, sf_dir):
    """Fleets whose history reads are slow from two readers on."""
    s = _samples(spark, sf_dir).withColumn("ok", F.lit(True)).withColumn(
        "wall_ms", F.when(F.col("design") == "history", F.col("concurrency") * 600.0).otherwise(F.lit(100.0))
    )
    return plain(measurement.boundary_verdict(measurement.phase_summary(s, _phases(s)), 3))


def _log(spark, sf_dir):
    c = F.col
    return ev(spark, sf_dir).filter(c("k") % 10 != 0).select(
        c("event_id").alias("query_id"), (c("value") * 2).alias("query_duration_ms"), (c("k") * 100).alias("read_rows"),
        (c("k") * 1000).alias("read_bytes"), (c("user_id") * 1048576).alias("memory_usage"),
    )


@query("log_coverage", _SAMPLE + """SELECT count(*) AS measured_requests, count(*) FILTER (WHERE k % 10 <> 0) AS terminal_records_found,
    count(*) = count(*) FILTER (WHERE k % 10 <> 0) AS complete FROM ev""")
def log_coverage(spark, sf_dir):
    return plain(measurement.log_coverage(_samples(spark, sf_dir), _log(spark, sf_dir)))


@query("phase_evidence", _SAMPLE + f""", j AS (SELECT s.*, ev.value * 2 AS ms, ev.k * 100 AS rows, ev.k * 1000 AS bytes, ev.user_id AS mem
    FROM s JOIN ev ON query_id = event_id WHERE ok AND ev.k % 10 <> 0)
    SELECT {_PHASE}, round(CAST(max(mem) AS DOUBLE), 3) AS peak_query_memory_mib, round(median(ms), 6) AS median_server_ms,
    median(rows) AS median_read_rows, median(bytes) AS median_read_bytes FROM j GROUP BY ALL""")
def evidence(spark, sf_dir):
    return plain(measurement.phase_evidence(_samples(spark, sf_dir), _log(spark, sf_dir)))


# Benchmark reads --------------------------------------------------------------------------------


@query("month_types", with_sql("market") + """SELECT event_type, count(*) AS events FROM market
    WHERE event_date >= DATE '1997-01-01' AND event_date < DATE '1997-02-01' GROUP BY 1""")
def month_types(spark, sf_dir):
    return plain(measurement.month_types(marketplace(spark, sf_dir), "1997-01-01", "1997-02-01"))


_COPIES = with_sql("archive") + ", s AS (SELECT unnest(range(5)) AS scenario), c AS (SELECT scenario, session_id + scenario * 20000000 AS session_id, event_time + to_days(CAST(scenario * 35 AS INTEGER)) AS event_time, event_type FROM archive, s) "


@query("scale_copies", _COPIES + """SELECT scenario, event_type, count(*) AS events, CAST(sum(session_id) AS BIGINT) AS sessions,
    strftime(min(event_time), '%Y-%m-%d %H:%M:%S.%g') AS first FROM c GROUP BY ALL""")
def copies(spark, sf_dir):
    out = scale_copies(archive(spark, sf_dir)).groupBy("scenario", "event_type").agg(
        F.count(F.lit(1)).alias("events"), F.sum("session_id").alias("sessions"), F.min("event_time").alias("first")
    )
    return plain(out)


@query("scenario_counts", _COPIES + "SELECT scenario, count(*) AS events FROM c GROUP BY 1")
def scenario_counts(spark, sf_dir):
    return plain(measurement.scenario_counts(scale_copies(archive(spark, sf_dir))))


@query("corpus", with_sql("positions") + """SELECT count(DISTINCT courier_id) AS couriers, strftime(min(event_time), '%Y-%m-%d %H:%M:%S.%g') AS first_event,
    strftime(max(event_time), '%Y-%m-%d %H:%M:%S.%g') AS last_event, count(*) AS rows FROM positions""")
def corpus(spark, sf_dir):
    return plain(measurement.corpus(positions(spark, sf_dir), "run-0", "madrid").drop("xor_hash", "sum_hash"))


# Sequences ----------------------------------------------------------------------------------------


@query("gap_check", """SELECT count(*) AS rows, count(DISTINCT o_orderkey) AS distinct_rows, min(o_orderkey) AS first_row, max(o_orderkey) AS last_row,
    count(*) = count(DISTINCT o_orderkey) AND count(*) = max(o_orderkey) - min(o_orderkey) + 1 AND min(o_orderkey) IN (0, 1) AS continuous FROM orders""")
def gap_check(spark, sf_dir):
    return plain(continuity(table(spark, sf_dir, "orders"), [], "o_orderkey", first_allowed=(0, 1)))


@query("gap_list", """WITH k AS (SELECT DISTINCT l_orderkey AS key FROM lineitem), p AS (SELECT key, lag(key) OVER (ORDER BY key) AS before FROM k)
    SELECT before + 1 AS gap_start, key - 1 AS gap_end, key - before - 1 AS missing FROM p WHERE key - before > 1""")
def gap_list(spark, sf_dir):
    """Orders without lines, as stretches of missing keys."""
    return plain(gaps(table(spark, sf_dir, "lineitem"), [], "l_orderkey"))


@query("path_length", with_sql("pos") + """, p AS (SELECT *, lag(latitude) OVER w AS la, lag(longitude) OVER w AS lo FROM pos
    WINDOW w AS (PARTITION BY courier_id ORDER BY event_time, event_id))
    SELECT courier_id, count(*) AS positions, round(coalesce(sum(sqrt(pow((la - latitude) * 111320, 2)
    + pow((lo - longitude) * 111320 * cos(radians((la + latitude) / 2)), 2))), 0) / 1000, 3) AS kilometres FROM p GROUP BY courier_id""")
def travelled(spark, sf_dir):
    from eventloom.operators.versioning import newest_of

    out = path_length(newest_of("courier_positions", positions(spark, sf_dir)), ["courier_id"])
    return plain(out.select("courier_id", "positions", (F.col("metres") / 1000).alias("kilometres")), 3)


# Query history and storage ---------------------------------------------------------------------------


def _query_log(spark, sf_dir):
    """The month of events squeezed into the last hour of a query log."""
    c = F.col
    start = F.unix_seconds(F.lit("2024-01-01").cast("timestamp"))
    moment = F.timestamp_seconds(F.unix_seconds(F.lit("2024-01-31").cast("timestamp")) + (F.unix_seconds("moment") - start) / 3600)
    return ev(spark, sf_dir).select(
        moment.alias("event_time"), F.when(c("event_type") == "error", "ExceptionWhileProcessing").otherwise("QueryFinish").alias("type"),
        F.lit(1).alias("is_initial_query"), F.lit("Select").alias("query_kind"), c("k").alias("normalized_query_hash"),
        F.array(tag("t", c("k") % 3), F.lit("t9")).alias("tables"),
        F.array(F.when(c("k") % 4 == 3, "system").otherwise("delivery")).alias("databases"),
        c("value").alias("query_duration_ms"), (c("user_id") * 1024).alias("memory_usage"), c("k").alias("read_rows"),
        tag("SELECT ", c("event_id")).alias("query"),
    )


@query("query_history", with_sql("ev") + """, g AS (SELECT k, value, user_id, (epoch_ms(moment) // 1000 - 1704067200) / 3600.0 AS shift,
    row_number() OVER (PARTITION BY k ORDER BY value) AS r, count(*) OVER (PARTITION BY k) AS n FROM ev WHERE event_type <> 'error' AND k % 4 <> 3),
    f AS (SELECT CAST(k AS VARCHAR) AS query_family, 't' || (k % 3) || ', t9' AS source_tables, count(*) AS executions, max(value) AS slowest_ms,
    max(user_id) * 1024 AS peak_memory_bytes, CAST(k AS DOUBLE) AS average_rows_read, max(value) FILTER (WHERE r = least(floor(n * 0.5) + 1, n)) AS median_ms,
    max(shift) AS last FROM g GROUP BY k) SELECT * EXCLUDE (last) FROM f ORDER BY last DESC, query_family, source_tables LIMIT 12""")
def history(spark, sf_dir):
    log = _query_log(spark, sf_dir)
    return plain(query_history(log, F.lit("2024-01-31 00:12:00").cast("timestamp"), ["delivery"]).drop("last_used"))


@query("recent_queries", with_sql("ev") + """SELECT value AS query_duration_ms, k AS read_rows, 'SELECT ' || event_id AS query FROM ev
    WHERE event_type <> 'error' ORDER BY epoch_ms(moment) // 1000 DESC, query LIMIT 10""")
def recent(spark, sf_dir):
    return plain(recent_queries(_query_log(spark, sf_dir), "select").drop("event_time"))


_TABLES = [
    "events", "lineitem", "orders", "customer", "supplier", "part", "nation", "region", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
]


@query("storage_rows", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS physical_rows FROM {t}" for t in _TABLES))
def storage_rows(spark, sf_dir):
    inventory = storage_inventory(spark, {t: f"{sf_dir}/{t}.parquet" for t in _TABLES})
    return plain(inventory.select("table_name", "physical_rows"))


@query("storage_inventory")
def storage(spark, sf_dir):
    return plain(storage_inventory(spark, {t: f"{sf_dir}/{t}.parquet" for t in _TABLES}))


@query("storage_files")
def storage_files(spark, sf_dir):
    footers = file_footers(spark, {t: f"{sf_dir}/{t}.parquet" for t in _TABLES})
    return plain(footers.withColumn("path", F.element_at(F.split("path", "/"), -1)))
