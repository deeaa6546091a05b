"""Headline reads, builds and reports; prints one JSON line.

The first group mirrors the published workloads: the same answer from history and
from prepared state. They run on a month-partitioned archive of labelled copies of
the events table, large enough that scanning counts. The second group runs
registered reports on the driver tables.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import functions as F

from eventloom import registry, schemas
from eventloom.operators.rollups import id_rollup, sum_rollup
from eventloom.operators.versioning import partial_state
from eventloom.plans import dashboards, measurement
from eventloom.registry import views
from eventloom.session import build_session, scratch_path
from eventloom.sources import tables
from eventloom.streaming import ingest

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
COPIES = int(os.environ.get("BENCH_COPIES", "100"))
SCENARIOS = 5
REPEATS = 3
REPORTS = [
    "journey_funnel_all", "journey_timeline_all", "funnel_levels_24h", "funnel_default_seconds", "search_conversion",
    "kind_metrics_total", "customer_flow", "limit_by_flag", "live_orders_enriched", "map_pins", "delivery_metrics",
    "top_entities_with_dims", "bucket_hist", "glovo_dash_metrics", "glovo_dash_stores", "rees46_dash_metrics", "rees46_dash_categories",
    "eleme_dash_cities", "uplift", "final_lineitem", "basket_pricing", "quantile_exact", "phase_summary", "gap_list", "path_length",
    "diff_rows", "group_five_keys", "contract_positions", "batch_accepted", "stream_latest",
]


def timed(run, repeats: int = REPEATS) -> float:
    """Median of warm runs; results go nowhere, so only the query is measured."""
    runs = []
    for i in range(repeats + 1):
        start = time.perf_counter()
        run()
        if i:
            runs.append(time.perf_counter() - start)
    return round(statistics.median(runs), 4)


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = build_session(
        "bench", f"local[{CPUS}]", spark__sql__shuffle__partitions=CPUS, spark__ui__enabled="false", spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry.load_all()
    queries: dict[str, float] = {}
    rows: dict[str, int] = {}

    def measure(name, make, n=None):
        queries[name] = timed(lambda: drain(make()))
        if n:
            rows[name] = n

    # Archive of labelled copies, its daily rollup, and the reads over them.
    stored_archive, scale = scratch_path(spark, "archive"), scratch_path(spark, "scale")
    longer = tables.scale_copies(views.archive(spark, SF_DIR), COPIES // SCENARIOS).withColumn("event_position", F.lit(0))
    tables.write_table(longer, "otto_archive", stored_archive, partitions=int(CPUS))
    archive = tables.read_table(spark, "otto_archive", stored_archive).drop("event_month")
    base = archive.count()
    start = time.perf_counter()
    tables.write_copies(archive, scale, SCENARIOS)
    n = base * SCENARIOS
    queries["scale_build"], rows["scale_build"] = round(time.perf_counter() - start, 4), n
    big = tables.read_table(spark, "otto_scale_benchmark", scale)
    dated = big.withColumn("event_date", F.to_date("event_time"))
    rollup = scratch_path(spark, "rollup")
    sum_rollup(dated, ["event_date", "event_type"]).write.parquet(rollup)
    measure("daily_counts_raw", lambda: measurement.archive_detail(big), n)
    measure("daily_counts_rollup", lambda: measurement.archive_prepared(spark.read.parquet(rollup)))
    measure("scenario_counts", lambda: measurement.scenario_counts(big), n)
    measure("one_month_pruned", lambda: measurement.month_types(dated, "2024-06-01", "2024-07-01"))

    # Exact logical events: newest versions of the history against exact-ID states.
    app, ids = scratch_path(spark, "app"), scratch_path(spark, "ids")
    tables.write_table(views.app_events(spark, SF_DIR), "app_events", app)
    events = tables.read_table(spark, "app_events", app)
    id_rollup(events, ingest.ROLLUP_KEYS, "event_id").write.parquet(ids)
    measure("exact_detail", lambda: measurement.app_day_detail(events, "2024-01-15", "synthetic", "city1"))
    measure("exact_id_rollup", lambda: measurement.app_day_prepared(spark.read.parquet(ids), "2024-01-15", "synthetic", "city1"))

    # Latest position: a long GPS history against prepared states.
    history, state = scratch_path(spark, "history"), scratch_path(spark, "state")
    shifts = F.explode(F.sequence(F.lit(0), F.lit(min(COPIES, 44) - 1)))
    gps = views.positions(spark, SF_DIR).withColumn("_k", shifts).withColumn(
        "event_time", F.col("event_time") + F.make_dt_interval(days=F.col("_k") * 30)
    ).drop("_k")
    tables.write_table(gps, "courier_positions", history)
    positions = tables.read_table(spark, "courier_positions", history)
    partial_state(
        positions.withColumn("b", F.month("event_time")), ["b", *schemas.LATEST_KEYS["courier_positions"]], schemas.LATEST_PAYLOAD["courier_positions"]
    ).drop("b").write.parquet(state)
    measure("latest_from_history", lambda: measurement.latest_from_history(positions, "run-0", "madrid"), positions.count())
    measure("latest_from_state", lambda: measurement.latest_from_state(spark.read.parquet(state), "run-0", "madrid"))

    # One typed column against the same label inside raw JSON text.
    stored = scratch_path(spark, "samples")
    views.samples(spark, SF_DIR).write.parquet(stored)
    samples = spark.read.parquet(stored)
    measure("label_sum_typed", lambda: samples.agg(F.sum("clicked")), samples.count())
    measure("label_sum_json", lambda: dashboards.typed_vs_json_clicks(samples).select("json_clicks"), samples.count())

    # Validated, idempotent ingest of one bulk batch.
    payloads = registry.contracts.gps_payloads(spark, SF_DIR)
    lines = scratch_path(spark, "lines")
    payloads.select(F.regexp_replace("payload", r"^\{", '{"_stream":"courier_positions",').alias("value")).repartition(int(CPUS)).write.text(lines)
    as_of = F.lit("2024-02-01").cast("timestamp")
    queries["ingest_batch"] = timed(
        lambda: ingest.ingest_batch(spark.read.text(lines), 0, ingest.Lake(scratch_path(spark, "lake")), as_of), repeats=1
    )
    rows["ingest_batch"] = payloads.count()

    for name in REPORTS:
        measure(name, lambda name=name: registry.QUERIES[name](spark, SF_DIR))

    rate = {k: int(rows[k] / queries[k]) for k in rows if queries[k] > 0}
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(queries.values()), 3), "unit": "sec", "queries": queries, "sf": SF_DIR.rsplit("sf", 1)[-1],
        "rows": rows, "rows_per_second": rate,
    }))
    spark.stop()


if __name__ == "__main__":
    sys.exit(main())
