"""Operators whose answer another computation over the same tables must confirm."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.functions.aggregates import portable_fingerprint
from eventloom.operators.contracts import named_items
from eventloom.operators.rollups import backfill_sum, hll_rollup, id_rollup, read_hll_rollup, read_id_rollup
from eventloom.operators.versioning import latest_of
from eventloom.plans import live
from eventloom.registry import query
from eventloom.registry.contracts import app_payloads
from eventloom.registry.views import RUN, archive, ev, ms, order_events, plain, positions, purchases, table, with_sql
from eventloom.session import ensure_utc, scratch_path
from eventloom.sources.inventory import with_layout
from eventloom.streaming import ingest, windows

AS_OF = "2024-01-31 00:00:00"


@query("live_snapshot", with_sql("courier_latest", "order_latest", "buys") + """, t AS (SELECT (SELECT count(*) FROM courier_latest) AS couriers,
    (SELECT count(*) FROM order_latest) AS orders, (SELECT count(*) FROM buys) AS purchases)
    SELECT *, least(couriers, 150) AS couriers_shown, least(orders, 200) AS orders_shown, least(purchases, 200) AS purchases_shown,
    couriers > 150 OR orders > 200 OR purchases > 200 AS truncated, '2024-01-31 00:00:00.000' AS snapshot_at FROM t""")
def live_snapshot(spark, sf_dir):
    """Exact totals beside the limited lists, and whether a list is cut."""
    out = live.snapshot(
        latest_of("courier_positions", positions(spark, sf_dir)), latest_of("order_events", order_events(spark, sf_dir)),
        purchases(spark, sf_dir), RUN, F.lit(AS_OF).cast("timestamp"),
    )
    return plain(out)


@query("sketch_error_large", """SELECT l_returnflag, count(DISTINCT l_orderkey) AS members, true AS within_3_pct FROM lineitem GROUP BY 1""")
def sketch_error_large(spark, sf_dir):
    """Sketches of many thousands of members, merged from parts, against the exact count."""
    lines = table(spark, sf_dir, "lineitem")
    exact = read_id_rollup(id_rollup(lines, ["l_returnflag"], "l_orderkey"), ["l_returnflag"], "l_orderkey", "members")
    approx = read_hll_rollup(hll_rollup(lines, ["l_returnflag", "l_linestatus", "l_linenumber"], "l_orderkey"), ["l_returnflag"], name="approx")
    error = F.abs(F.col("approx") - F.col("members")) / F.col("members")
    return plain(exact.join(approx, "l_returnflag").select("l_returnflag", "members", (error <= 0.03).alias("within_3_pct")))


@query("approx_distinct_error", "SELECT l_linenumber, count(DISTINCT l_partkey) AS parts, true AS within_5_pct FROM lineitem GROUP BY 1")
def approx_distinct_error(spark, sf_dir):
    """The approximate distinct count against the exact one."""
    counted = table(spark, sf_dir, "lineitem").groupBy("l_linenumber", "l_partkey").agg(F.lit(1).alias("_"))
    both = counted.groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("parts"), F.approx_count_distinct("l_partkey", 0.01).alias("approx"))
    return plain(both.select("l_linenumber", "parts", (F.abs(F.col("approx") - F.col("parts")) <= 0.05 * F.col("parts")).alias("within_5_pct")))


@query("fingerprint_md5", """SELECT l_linestatus, count(*) AS rows, bit_xor(b) AS xor_bits, CAST(sum(CAST(b AS HUGEINT)) AS VARCHAR) AS sum_bits FROM (
    SELECT l_linestatus, CAST(('0x' || substr(md5(concat_ws('|', l_orderkey, l_partkey, l_linenumber, coalesce(l_returnflag, '\\N'))), 1, 15)) AS BIGINT) AS b
    FROM lineitem) GROUP BY 1""")
def fingerprint_md5(spark, sf_dir):
    """Order-free digest of every line, per status."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy("l_linestatus").agg(*portable_fingerprint("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag"))


@query("named_item_totals", """SELECT l_returnflag, CAST(sum(l_linenumber) AS BIGINT) AS units, CAST(sum(l_linenumber * CAST(floor(l_extendedprice) AS BIGINT)) AS BIGINT) AS amount
    FROM lineitem GROUP BY 1""")
def named_item_totals(spark, sf_dir):
    """Positional triples of every line become named items again."""
    lines = table(spark, sf_dir, "lineitem")
    triple = F.array(F.array(F.col("l_partkey").cast("string"), F.col("l_linenumber").cast("string"), F.floor("l_extendedprice").cast("string")))
    items = lines.select("l_returnflag", F.inline(named_items(triple)))
    amount = F.col("quantity").cast("bigint") * F.col("unit_price_minor")
    return plain(items.groupBy("l_returnflag").agg(F.sum("quantity").cast("bigint").alias("units"), F.sum(amount).cast("bigint").alias("amount")))


@query("layout_join", """SELECT 'db' || (n_regionkey % 2) AS database, n_name AS table_name, n_nationkey AS rows, CASE WHEN n_regionkey < 3 AND n_regionkey % 2 = 0 THEN r_name END AS engine
    FROM nation JOIN region ON n_regionkey = r_regionkey""")
def layout_join(spark, sf_dir):
    """Layout by (database, table): a table of the same name in another database gets nothing."""
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    base = F.concat(F.lit("db"), (F.col("n_regionkey") % 2).cast("string"))
    inventory = nations.select(base.alias("database"), F.col("n_name").alias("table_name"), F.col("n_nationkey").alias("rows"))
    layout = nations.filter("n_regionkey < 3").select(F.lit("db0").alias("database"), F.col("n_name").alias("table_name"), F.col("r_name").alias("engine"))
    return plain(with_layout(inventory, layout).select("database", "table_name", "rows", "engine"))


@query("backfill_check", with_sql("archive") + """SELECT count(*) AS archive_events, count(*) AS rollup_events,
    count(DISTINCT (CAST(event_time AS DATE), event_type)) AS logical_keys, true AS same FROM archive""")
def backfill_check(spark, sf_dir):
    """A rollup built from its archive holds the same events."""
    days = archive(spark, sf_dir).withColumn("day", F.to_date("event_time"))
    return plain(backfill_sum(days, scratch_path(spark, "backfill"), ["day", "event_type"]))


@query("live_clicks", with_sql("ev") + """SELECT section, count(*) AS clicks, count(*) AS ids, true AS timed FROM (
    SELECT CASE WHEN event_type = 'view' THEN 'inicio' WHEN event_type = 'click' THEN 'productos' ELSE 'other' END AS section FROM ev) WHERE section <> 'other' GROUP BY 1""")
def live_clicks(spark, sf_dir):
    """Single-row appends get their own identity and time; unknown sections are refused."""
    section = F.when(F.col("event_type") == "view", "inicio").when(F.col("event_type") == "click", "productos").otherwise("other")
    path = scratch_path(spark, "clicks")
    ingest.append_live_clicks(ev(spark, sf_dir).select(section.alias("section"), F.lit("abrir").alias("action"))).write.parquet(path)
    stored = spark.read.parquet(path)
    return plain(stored.groupBy("section").agg(
        F.count(F.lit(1)).alias("clicks"), F.count_distinct("click_id").alias("ids"), F.bool_and(F.col("clicked_at").isNotNull()).alias("timed"),
    ))


@query("stream_backpressure", with_sql("ev") + "SELECT 6::BIGINT AS batches, 2::BIGINT AS most_files, count(*) AS events FROM ev")
def stream_backpressure(spark, sf_dir):
    """Twelve files, at most two per micro-batch."""
    ensure_utc(spark)
    source, out = scratch_path(spark, "files"), scratch_path(spark, "batches")
    app_payloads(spark, sf_dir).select(F.col("payload").alias("value")).repartition(12).write.text(source)
    stream = spark.readStream.option("maxFilesPerTrigger", 2).text(source).select("value", F.col("_metadata.file_path").alias("file"))

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    stream.writeStream.option("checkpointLocation", scratch_path(spark, "ck")).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    per_batch = spark.read.parquet(out).groupBy("batch_id").agg(F.count_distinct("file").alias("files"), F.count(F.lit(1)).alias("events"))
    return plain(per_batch.agg(F.count(F.lit(1)).alias("batches"), F.max("files").alias("most_files"), F.sum("events").alias("events")))


@query("stream_trailing_ingest", with_sql("ev") + f""", s AS (SELECT make_timestamp((epoch_ms(moment + INTERVAL 1 SECOND) // 2000 * 2 - 2 * i) * 1000000) AS w, event_type FROM ev, (SELECT unnest(range(15)) AS i))
    SELECT {ms('w')} AS window_start, count(*) AS events, count(*) FILTER (WHERE event_type = 'click') AS clicks FROM s GROUP BY w""")
def stream_trailing_ingest(spark, sf_dir):
    """Thirty seconds back over the time of ingest, refreshed every two seconds, on a stream."""
    ensure_utc(spark)
    source, out = scratch_path(spark, "ingested"), scratch_path(spark, "trailing")
    e = ev(spark, sf_dir).select("event_type", (F.col("moment") + F.expr("INTERVAL 1 SECOND")).alias("ingested_at"))
    e.repartition(4).write.parquet(source)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 2).parquet(source)

    def write(batch, batch_id):
        counts = windows.sliding_counts(batch, "ingested_at", "30 seconds", "2 seconds", counts={"clicks": F.col("event_type") == "click"})
        counts.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    stream.writeStream.option("checkpointLocation", scratch_path(spark, "ck")).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    parts = spark.read.parquet(out).groupBy("window_start").agg(F.sum("events").alias("events"), F.sum("clicks").alias("clicks"))
    return plain(parts)
