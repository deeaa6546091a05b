"""Readers, layout, publishing and exports, run over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom import schemas
from eventloom.operators.versioning import newest_of, rewrite_partitions
from eventloom.registry import query
from eventloom.registry.views import (
    activity, app_events, archive, catalog, day, ev, marketplace, ms, order_events, plain, positions, purchases, samples, table, tag,
    union_all, with_sql,
)
from eventloom.session import scratch_path
from eventloom.sources import catalog as demo_catalog
from eventloom.sources import export, readers, tables
from eventloom.sources import positions as gps

# Nested and delimited inputs --------------------------------------------------------------------


@query("session_unnest", with_sql("ev") + f"SELECT user_id AS session_id, event_id AS article_id, event_type, {ms('moment')} AS event_time FROM ev")
def session_unnest(spark, sf_dir):
    """Sessions of up to one event per array, written as JSON lines, read and flattened."""
    e = ev(spark, sf_dir)
    path = scratch_path(spark, "sessions")
    e.select(
        F.col("user_id").alias("session"),
        F.array(F.struct(F.col("event_id").alias("aid"), F.unix_millis("moment").alias("ts"), F.col("event_type").alias("type"))).alias("events"),
    ).write.json(path)
    raw = spark.read.schema(readers.SESSION_SCHEMA).json(path)
    kinds = ["signup", "view", "click", "purchase", "error"]
    return plain(readers.flatten_sessions(raw, kinds).drop("event_position"))


@query("word_positions", """WITH w AS (SELECT doc_id, string_split(text, ' ') AS ws FROM documents), p AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS position FROM w)
    SELECT doc_id, count(*) AS words, max(position) AS last_position, CAST(sum(position) AS BIGINT) AS position_sum, CAST(sum(length(word)) AS BIGINT) AS letters FROM p GROUP BY doc_id""")
def word_positions(spark, sf_dir):
    """Positions of list elements, over whole texts."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("p", "word"))
    return plain(d.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("words"), F.max(F.col("p") + 1).alias("last_position"), F.sum(F.col("p") + 1).alias("position_sum"),
        F.sum(F.length("word")).alias("letters"),
    ))


_SESSIONS = """WITH s AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'NULL' ELSE doc_id || '#' || (doc_id % 7) || '#' || n_chars || '#' || (doc_id % 7) END AS clicks FROM documents),
    l AS (SELECT doc_id, string_split(clicks, '#') AS ids FROM s WHERE clicks <> 'NULL') """


def _click_sessions(spark, sf_dir):
    c = F.col
    joined = F.concat_ws("#", c("doc_id").cast("string"), (c("doc_id") % 7).cast("string"), c("n_chars").cast("string"), (c("doc_id") % 7).cast("string"))
    return table(spark, sf_dir, "documents").select(
        F.lit("20210310").alias("dt"), c("doc_id").cast("string").alias("wm_order_id"),
        F.when(c("doc_id") % 10 == 0, "NULL").otherwise(joined).alias("clicks"),
    )


@query("click_rows", _SESSIONS + """SELECT '2021-03-10' AS order_date, doc_id AS order_id, generate_subscripts(ids, 1) AS position, CAST(unnest(ids) AS BIGINT) AS restaurant_id FROM l""")
def click_rows(spark, sf_dir):
    return plain(readers.clicks_from_sessions(_click_sessions(spark, sf_dir)))


@query("click_summary", _SESSIONS + """SELECT '2021-03-10' AS order_date, doc_id AS order_id, len(ids) AS click_count, len(list_distinct(ids)) AS distinct_restaurants,
    CAST(ids[-1] AS BIGINT) AS last_clicked_restaurant_id FROM l""")
def click_summary(spark, sf_dir):
    return plain(readers.click_summary_from_sessions(_click_sessions(spark, sf_dir)))


@query("tsv_orders", "SELECT o_orderkey AS order_id, o_custkey AS user_id, o_orderpriority AS price_band, strftime(o_orderdate, '%Y-%m-%d') AS order_date, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey % 25 END AS area_id FROM orders")
def tsv_orders(spark, sf_dir):
    c = F.col
    path = scratch_path(spark, "orders-tsv")
    table(spark, sf_dir, "orders").select(
        c("o_orderkey").alias("wm_order_id"), c("o_custkey").alias("user_id"), (c("o_orderkey") % 100).alias("wm_poi_id"),
        F.when(c("o_orderkey") % 3 == 0, "NULL").otherwise((c("o_custkey") % 25).cast("string")).alias("aor_id"),
        c("o_orderpriority").alias("order_price_interval"), F.unix_seconds("o_orderdate").alias("order_timestamp"),
        F.lit("noon").alias("ord_period_name"), F.date_format("o_orderdate", "yyyyMMdd").alias("dt"),
    ).write.csv(path, sep="\t", header=True)
    out = readers.read_orders(spark, path)
    return plain(out.select("order_id", "user_id", "price_band", "order_date", "area_id"))


@query("marketplace_csv", with_sql("market") + """SELECT event_type, strftime(event_date, '%Y-%m') AS month, count(*) AS events, count(*) FILTER (WHERE brand = '') AS unbranded
    FROM market GROUP BY ALL""")
def marketplace_csv(spark, sf_dir):
    """Gzip CSV with an exact header, written and read back as typed rows."""
    path = scratch_path(spark, "marketplace")
    m = marketplace(spark, sf_dir)
    m.withColumn("event_time", F.concat(F.date_format("event_time", "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))).select(
        *readers.MARKETPLACE_COLUMNS
    ).write.csv(path, header=True, compression="gzip")
    typed = readers.type_marketplace(readers.read_marketplace(spark, path))
    return plain(typed.groupBy("event_type", F.date_format("event_date", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("brand") == "").alias("unbranded")
    ))


@query("sample_files", with_sql("samples") + """SELECT city_id, request_hour, count(*) AS samples, CAST(sum(clicked) AS BIGINT) AS clicks FROM samples GROUP BY ALL""")
def sample_files(spark, sf_dir):
    """39-field text with a detected separator, checked and projected."""
    s = samples(spark, sf_dir)
    path = scratch_path(spark, "samples")
    known = {
        "clicked": F.col("clicked").cast("string"), "user_id": F.col("user_id"), "shop_id": F.col("shop_id"), "city_id": F.col("city_id"),
        "hours": F.col("request_hour").cast("string"), "time_type": F.col("meal_period"), "times": F.col("request_time_raw"),
    }
    s.select(*[known.get(f, F.lit("0")).alias(f) for f in readers.SAMPLE_FIELDS]).write.csv(path, sep="|")
    from eventloom.operators.contracts import validate

    raw = readers.read_samples(spark, path, readers.detect_delimiter(spark, path))
    good, _ = validate(raw, readers.sample_rules())
    out = readers.project_samples(good, "a" * 64, "samples.csv", 1)
    return plain(out.groupBy("city_id", "request_hour").agg(F.count(F.lit(1)).alias("samples"), F.sum("clicked").alias("clicks")))


@query("file_row_numbers", with_sql("ev") + "SELECT count(*) AS rows, true AS continuous FROM ev")
def file_row_numbers(spark, sf_dir):
    """Row numbers of a multi-file text input are 1..n within each file."""
    from eventloom.operators.sequences import continuity
    from eventloom.sources.rowindex import with_row_index

    path = scratch_path(spark, "lines")
    ev(spark, sf_dir).select(F.col("event_type").alias("value")).repartition(4).write.text(path)
    numbered = with_row_index(spark.read.text(path).withColumn("file", F.input_file_name()))
    per_file = continuity(numbered, ["file"], "source_row")
    return plain(per_file.agg(F.sum("rows").alias("rows"), F.bool_and("continuous").alias("continuous")))


# Layout and publishing -----------------------------------------------------------------------------


@query("month_layout", with_sql("act") + """SELECT CAST(strftime(event_time, '%Y%m') AS BIGINT) AS event_month, action, count(*) AS events FROM act GROUP BY ALL""")
def month_layout(spark, sf_dir):
    """Written in month folders and key order, read back logically."""
    path = scratch_path(spark, "activity")
    tables.write_table(activity(spark, sf_dir), "customer_activity", path)
    stored = tables.read_table(spark, "customer_activity", path)
    return plain(newest_of("customer_activity", stored).groupBy("event_month", "action").agg(F.count(F.lit(1)).alias("events")))


@query("replace_month", with_sql("archive") + """SELECT CAST(strftime(event_time, '%Y%m') AS BIGINT) AS event_month, event_type, count(*) AS events FROM archive GROUP BY ALL""")
def replace_month(spark, sf_dir):
    """A month loaded twice holds its rows once."""
    path = scratch_path(spark, "archive")
    a = archive(spark, sf_dir)
    tables.write_table(a, "otto_archive", path)
    tables.replace_month(a, "otto_archive", path, 202401)
    stored = tables.read_table(spark, "otto_archive", path)
    return plain(stored.groupBy("event_month", "event_type").agg(F.count(F.lit(1)).alias("events")))


@query("staged_publish", with_sql("samples") + "SELECT source_file AS source_id, count(*) AS rows, max(source_row) AS last_row FROM samples GROUP BY 1")
def staged_publish(spark, sf_dir):
    """Four sources staged, checked and published; a second publish is skipped."""
    s = samples(spark, sf_dir)
    target, staging = scratch_path(spark, "published"), scratch_path(spark, "staging")
    counts = {r["source_file"]: r["count"] for r in s.groupBy("source_file").count().collect()}  # one row per source file
    for name, n in sorted(counts.items()):
        part = s.filter(F.col("source_file") == name)
        tables.staged_publish(part, staging, target, name, n)
        if tables.staged_publish(part, staging, target, name, n) != "skipped":
            raise AssertionError("a published source was loaded again")
    stored = spark.read.option("basePath", target).parquet(target)
    return plain(stored.groupBy("source_id").agg(F.count(F.lit(1)).alias("rows"), F.max("source_row").alias("last_row")))


@query("resume_prefix", with_sql("ev") + """, n AS (SELECT user_id % 4 AS src, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) AS r FROM ev)
    SELECT src, count(*) AS remaining, min(r) AS first_row FROM n WHERE src <> 0 AND r > 100 OR src = 0 GROUP BY src""")
def resume_prefix(spark, sf_dir):
    """Sources with a proven prefix continue after it; one with a hole starts over."""
    from eventloom.operators.scans import running

    rows = ev(spark, sf_dir).select((F.col("user_id") % 4).alias("src"), "event_id", F.lit(1).cast("bigint").alias("one"))
    ranked = running(rows, ["src"], ["event_id"], ["src"], {"source_row": "one"})
    staged = ranked.filter((F.col("source_row") <= 100) & ~((F.col("src") == 0) & (F.col("source_row") == 50)))
    points = tables.resume_point(staged, ["src"])
    rest = tables.resume_after(ranked, points, ["src"])
    return plain(rest.groupBy("src").agg(F.count(F.lit(1)).alias("remaining"), F.min("source_row").alias("first_row")))


@query("load_audit", with_sql("ev") + """SELECT event_type, count(*) FILTER (WHERE k <> 0) AS measured, count(*) AS expected FROM ev GROUP BY 1 HAVING count(*) FILTER (WHERE k <> 0) <> count(*)""")
def load_audit(spark, sf_dir):
    e = ev(spark, sf_dir)
    count = lambda d: d.groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"))
    return plain(tables.audit_counts(count(e.filter("k <> 0")), count(e), ["event_type"]))


@query("scenario_states", "SELECT s AS scenario, CASE WHEN s = 4 THEN 0 ELSE count(*) END AS rows, CASE WHEN s = 4 THEN 'absent' ELSE 'complete' END AS state FROM events, (SELECT unnest(range(5)) AS s) GROUP BY s")
def scenario_states(spark, sf_dir):
    a = archive(spark, sf_dir)
    copies = tables.scale_copies(a).filter("scenario <> 4")
    return plain(tables.missing_scenarios(copies, a.count()))  # one number


@query("update_rows", with_sql("ev") + f"""SELECT {day('CAST(moment AS DATE)')} AS day, count(*) AS events, CAST(sum(CASE WHEN event_type = 'purchase' AND CAST(moment AS DATE) < DATE '2024-01-11' THEN 12 ELSE k END) AS BIGINT) AS k
    FROM ev GROUP BY 1""")
def update_rows(spark, sf_dir):
    """Rows of the touched days are corrected, other folders stay as they were."""
    path = scratch_path(spark, "updates")
    ev(spark, sf_dir).select("event_id", "event_type", "k", F.to_date("moment").alias("day")).write.partitionBy("day").parquet(path)
    stored = spark.read.schema("event_id BIGINT, event_type STRING, k BIGINT, day DATE").parquet(path)
    touched = F.col("day") < F.lit("2024-01-11").cast("date")
    out = rewrite_partitions(stored, path, "day", touched, F.col("event_type") == "purchase", {"k": F.lit(12)})
    return plain(out.groupBy("day").agg(F.count(F.lit(1)).alias("events"), F.sum("k").alias("k")))


@query("delete_rows", with_sql("ev") + f"""SELECT {day('CAST(moment AS DATE)')} AS day, count(*) AS events FROM ev
    WHERE CAST(moment AS DATE) <> DATE '2024-01-05' AND event_type <> 'error' GROUP BY 1""")
def delete_rows(spark, sf_dir):
    """One type is deleted everywhere and one day completely."""
    path = scratch_path(spark, "deletes")
    ev(spark, sf_dir).select("event_id", "event_type", F.to_date("moment").alias("day")).write.partitionBy("day").parquet(path)
    stored = spark.read.schema("event_id BIGINT, event_type STRING, day DATE").parquet(path)
    gone = (F.col("event_type") == "error") | (F.col("day") == F.lit("2024-01-05").cast("date"))
    out = rewrite_partitions(stored, path, "day", F.lit(True), gone)
    return plain(out.groupBy("day").agg(F.count(F.lit(1)).alias("events")))


@query("schema_evolution", with_sql("ev") + "SELECT event_type, count(*) AS events, count(*) FILTER (WHERE k >= 50) AS linked FROM ev GROUP BY 1")
def schema_evolution(spark, sf_dir):
    """Rows stored before a column existed read as NULL."""
    e = ev(spark, sf_dir)
    path = scratch_path(spark, "evolution")
    e.filter("k < 50").select("event_id", "event_type").write.parquet(f"{path}/part=old")
    e.filter("k >= 50").select("event_id", "event_type", tag("o", F.col("event_id")).alias("order_id")).write.parquet(f"{path}/part=new")
    stored = spark.read.schema("event_id BIGINT, event_type STRING, order_id STRING").parquet(path)
    return plain(stored.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.count("order_id").alias("linked")))


# Catalog and exports ----------------------------------------------------------------------------


def _prices(spark, sf_dir):
    """Three products for each of as many restaurants as it takes, priced by the parts of the same number."""
    n = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        n.alias("n"), tag("restaurant-", F.floor(n / 3) + 1).alias("restaurant_id"), (n % 3 + 1).cast("int").alias("slot"),
        F.floor("p_retailprice").cast("int").alias("price_minor"),
    )


_PRICES = "p AS (SELECT p_partkey AS n, CAST(floor(p_retailprice) AS BIGINT) AS price_minor FROM part)"


@query("seed_catalog", with_sql("catalog") + f""", {_PRICES}, n AS (SELECT source_row FROM catalog WHERE country_code = 'AF' ORDER BY source_row LIMIT (SELECT count(*) FROM part))
    SELECT 'public_historical' AS name_kind, count(*) AS products, (SELECT count(*) FROM p) AS distinct_products, CAST(sum(source_row) AS BIGINT) AS source_rows,
    (SELECT CAST(sum(price_minor) AS BIGINT) FROM p) AS prices FROM n""")
def seed_catalog(spark, sf_dir):
    public = catalog(spark, sf_dir).withColumn("city_code", F.lit("MAD")).withColumn(
        "country_code", F.when(F.col("country_code") == "AF", "ES").otherwise(F.col("country_code"))
    )
    out = demo_catalog.seed_products(public, _prices(spark, sf_dir), 1)
    return plain(out.groupBy("name_kind").agg(
        F.count(F.lit(1)).alias("products"), F.count_distinct("product_id").alias("distinct_products"),
        F.sum("source_row").alias("source_rows"), F.sum("price_minor").alias("prices"),
    ))


@query("seed_catalog_fallback", f"""WITH {_PRICES} SELECT 'restaurant-' || (n // 3 + 1) || '-product-' || (n % 3 + 1) AS product_id,
    ['Vegetable bowl', 'House menu', 'Salad of the day'][n % 3 + 1] AS product_name, price_minor, 'synthetic' AS name_kind FROM p""")
def seed_catalog_fallback(spark, sf_dir):
    """Without a public name for every product all take the fallback names."""
    public = catalog(spark, sf_dir).withColumn("country_code", F.lit("ES")).withColumn("city_code", F.when(F.col("source_row") <= 10, "MAD"))
    out = demo_catalog.seed_products(public, _prices(spark, sf_dir), 1)
    return plain(out.select("product_id", "product_name", "price_minor", "name_kind"))


@query("seed_restaurants", "SELECT s_suppkey AS restaurant_id, s_name AS name, 'madrid' AS city_id, s_acctbal AS latitude, 'synthetic' AS location_kind FROM supplier")
def seed_restaurants(spark, sf_dir):
    places = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("restaurant_id"), F.col("s_name").alias("name"), F.col("s_acctbal").cast("double").alias("latitude"), F.lit(0.0).alias("longitude"),
    )
    return plain(demo_catalog.seed_restaurants(places, 1).select("restaurant_id", "name", "city_id", "latitude", "location_kind"))


@query("catalog_index", """SELECT count(*) AS rows, count(DISTINCT p_partkey) AS distinct_rows, min(p_partkey) AS first_row, max(p_partkey) AS last_row,
    count(*) = max(p_partkey) - min(p_partkey) + 1 AND min(p_partkey) = 0 AS continuous FROM part""")
def catalog_index(spark, sf_dir):
    return plain(readers.catalog_index_check(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("source_row"))))


def _streams(spark, sf_dir):
    return {
        "app_events": app_events(spark, sf_dir), "customer_activity": activity(spark, sf_dir), "customer_orders": purchases(spark, sf_dir),
        "order_events": order_events(spark, sf_dir), "courier_positions": positions(spark, sf_dir),
    }


@query("run_manifest", with_sql("app", "act", "buys", "order_events", "pos") + " UNION ALL ".join(
    f"SELECT '{name}' AS table_name, count(*) AS rows, {ms('min(event_time)')} AS first_event, {ms('max(event_time)')} AS last_event FROM {view}"
    for name, view in [("app_events", "app"), ("customer_activity", "act"), ("customer_orders", "buys"), ("order_events", "order_events"), ("courier_positions", "pos")]
))
def run_manifest(spark, sf_dir):
    streams = _streams(spark, sf_dir)
    return plain(union_all([
        export.table_stats(export.run_rows(streams, name, "run-0")).select(F.lit(name).alias("table_name"), "*") for name in streams
    ]))


@query("participants", with_sql("act", "positions") + """SELECT count(DISTINCT customer_id) AS customers, count(DISTINCT customer_id) FILTER (WHERE decision_mode = 'ollama') AS ai_customers,
    count(*) FILTER (WHERE decision_mode = 'ollama') AS ai_decisions, (SELECT count(DISTINCT courier_id) FROM positions) AS couriers FROM act""")
def participants(spark, sf_dir):
    return plain(export.participants(newest_of("customer_activity", activity(spark, sf_dir)), positions(spark, sf_dir)))


@query("orders_by_status", with_sql("order_latest") + "SELECT status, count(*) AS orders FROM order_latest GROUP BY 1")
def orders_by_status(spark, sf_dir):
    return plain(export.orders_by_status(order_events(spark, sf_dir)))


@query("orders_by_type", with_sql("buys") + "SELECT decision_mode, source_kind, count(*) AS orders, CAST(sum(amount_minor) AS BIGINT) AS amount_minor FROM buys GROUP BY ALL")
def orders_by_type(spark, sf_dir):
    return plain(export.orders_by_type(purchases(spark, sf_dir)))


@query("export_round_trip", with_sql("act") + "SELECT action, count(*) AS events FROM act GROUP BY 1")
def export_round_trip(spark, sf_dir):
    """A run is exported, verified, and read back from its compressed files."""
    out = scratch_path(spark, "export")
    export.export_run(spark, {"customer_activity": activity(spark, sf_dir)}, "run-0", out)
    export.verify_export(spark, out, "run-0")
    back = export.read_export(spark, out, "customer_activity")
    return plain(back.groupBy("action").agg(F.count(F.lit(1)).alias("events")))


@query("runs_report", with_sql("act", "pos") + f"""SELECT 'run-0' AS run_id, {ms('least((SELECT min(event_time) FROM act), (SELECT min(event_time) FROM pos))')} AS start,
    (SELECT count(*) FROM act) AS customer_activity, (SELECT count(*) FROM pos) AS courier_positions, (SELECT count(*) FROM act) + (SELECT count(*) FROM pos) AS total_rows""")
def runs_report(spark, sf_dir):
    root = scratch_path(spark, "runs")
    streams = {"customer_activity": activity(spark, sf_dir), "courier_positions": positions(spark, sf_dir)}
    export.export_run(spark, streams, "run-0", f"{root}/first")
    report = export.runs_report(export.read_manifests(spark, root))
    return plain(report.select("run_id", "start", "customer_activity", "courier_positions", "total_rows"))


@query("gps_import", with_sql("positions") + """SELECT courier_id, count(*) AS positions, CAST(round(sum(latitude), 3) AS DOUBLE) AS latitudes, CAST(round(sum(longitude), 3) AS DOUBLE) AS longitudes
    FROM positions GROUP BY courier_id""")
def gps_import(spark, sf_dir):
    """Positions written as CSV files with two header orders, read by each file's own header."""
    p = positions(spark, sf_dir)
    path = scratch_path(spark, "gps")
    as_text = p.select(*[F.col(c).cast("string").alias(c) for c in gps.COLUMNS])
    even = F.pmod(F.xxhash64("event_id"), F.lit(2)) == 0
    as_text.filter(even).write.csv(path, header=True)
    as_text.filter(~even).select(*reversed(gps.COLUMNS)).write.mode("append").csv(path, header=True, compression="gzip")
    read = gps.read_positions(spark, path)
    return plain(read.groupBy("courier_id").agg(
        F.count(F.lit(1)).alias("positions"), F.round(F.sum("latitude"), 3).alias("latitudes"), F.round(F.sum("longitude"), 3).alias("longitudes"),
    ))


@query("delete_text_partition", """SELECT CASE WHEN event_type <> 'error' THEN event_type || ':a/b c' END AS kind, count(*) AS events
    FROM events WHERE event_type NOT IN ('click', 'error') GROUP BY 1""")
def delete_text_partition(spark, sf_dir):
    """Whole partitions go whose folder names the engine escapes, and the NULL partition too."""
    path = scratch_path(spark, "kinds")
    kind = F.when(F.col("event_type") != "error", F.concat("event_type", F.lit(":a/b c")))
    table(spark, sf_dir, "events").select("event_id", kind.alias("kind")).write.partitionBy("kind").parquet(path)
    stored = spark.read.schema("event_id BIGINT, kind STRING").parquet(path)
    gone = F.col("kind").isNull() | F.col("kind").startswith("click")
    left = rewrite_partitions(stored, path, "kind", gone, gone)
    return plain(left.groupBy("kind").agg(F.count(F.lit(1)).alias("events")))


@query("catalog_rows", """SELECT p_partkey - 1 AS source_row, p_name || chr(10) || '"x", y' AS product_name, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 1 END AS has_description,
    CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END AS aux_store FROM part""")
def catalog_rows(spark, sf_dir):
    """Quoted catalog CSV with separators and line breaks inside its values."""
    path = scratch_path(spark, "catalog")
    c = F.col
    known = {
        "product_name": F.concat("p_name", F.lit('\n"x", y')), "product_description": F.when(c("p_partkey") % 3 != 0, F.lit("a, b\n\tc")),
        "aux_store": F.when(c("p_partkey") % 2 == 0, "True").otherwise("False"), "HIER": F.lit("False"),
    }
    table(spark, sf_dir, "part").select(
        (c("p_partkey") - 1).cast("string").alias("index"), *[known.get(n, F.lit("k")).alias(n) for n in readers.CATALOG_COLUMNS],
    ).write.csv(path, header=True, quote='"', escape='"')
    out = readers.read_catalog(spark, path)
    return plain(out.select("source_row", "product_name", "has_description", "aux_store"))


@query("uplift_gzip", "SELECT o_orderkey % 2 AS treatment, count(*) AS users, CAST(sum(o_custkey % 2) AS BIGINT) AS visits FROM orders GROUP BY 1")
def uplift_gzip(spark, sf_dir):
    """Gzip advertising CSV with an exact header, typed by its table."""
    path = scratch_path(spark, "uplift")
    names = [part.split()[0] for part in schemas.TABLES["criteo_uplift"].split(", ")]
    known = {"treatment": F.col("o_orderkey") % 2, "visit": F.col("o_custkey") % 2}
    table(spark, sf_dir, "orders").select(*[known.get(n, F.lit(0)).alias(n) for n in names]).write.csv(path, header=True, compression="gzip")
    read = readers.read_uplift(spark, path)
    return plain(read.groupBy("treatment").agg(F.count(F.lit(1)).alias("users"), F.sum("visit").cast("bigint").alias("visits")))


@query("drop_scenario", "SELECT s AS scenario, count(*) AS rows FROM events, (SELECT unnest([0, 1, 2, 4]) AS s) GROUP BY s")
def drop_scenario(spark, sf_dir):
    """Five scenario copies are written and one is removed."""
    path = scratch_path(spark, "copies")
    tables.write_copies(archive(spark, sf_dir), path, 5)
    left = tables.drop_scenario(tables.read_table(spark, "otto_scale_benchmark", path), path, 3)
    return plain(left.groupBy("scenario").agg(F.count(F.lit(1)).alias("rows")))


@query("not_loaded", "SELECT 'present' AS name, count(*) AS rows FROM region UNION ALL SELECT 'absent', 0")
def not_loaded(spark, sf_dir):
    """A table that was never loaded answers empty, with its columns."""
    path = scratch_path(spark, "loaded")
    table(spark, sf_dir, "region").select(F.lit(1).alias("treatment")).write.parquet(path)
    present, absent = (readers.load_or_empty(spark, "criteo_uplift", p) for p in (path, path + "-none"))
    if absent.columns != present.columns:
        raise AssertionError("an empty answer has the table's columns")
    return plain(present.agg(F.count(F.lit(1)).alias("rows")).select(F.lit("present").alias("name"), "rows").unionByName(
        absent.agg(F.count(F.lit(1)).alias("rows")).select(F.lit("absent").alias("name"), "rows")
    ))
