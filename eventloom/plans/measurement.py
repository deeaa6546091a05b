"""Detail against prepared designs, benchmark reads and latency evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from eventloom import schemas
from eventloom.functions.aggregates import content_fingerprint
from eventloom.operators.compare import compare_designs
from eventloom.operators.quantiles import median, nearest_rank
from eventloom.operators.rollups import read_id_rollup, read_sum_rollup, sum_rollup
from eventloom.operators.versioning import latest_from_long_history, newest_of, read_state

SECTION_KEYS = ["section", "event_type"]
PHASE = ["design", "concurrency", "repetition"]
EVIDENCE = {
    "query_duration_ms": "median_server_ms", "read_rows": "median_read_rows", "read_bytes": "median_read_bytes",
}


# Two designs, one answer --------------------------------------------------------------------


def app_day_detail(app_events: DataFrame, day: str, source_kind: str, city_id: str) -> DataFrame:
    """Logical events per section and type of one day, from the event history."""
    where = (F.col("source_kind") == source_kind) & (F.col("city_id") == city_id) & (F.col("event_date") == F.lit(day).cast("date"))
    return newest_of("app_events", app_events.filter(where), ["section"]).groupBy(*SECTION_KEYS).agg(
        F.count_distinct("event_id").alias("events")
    )


def app_day_prepared(states: DataFrame, day: str, source_kind: str, city_id: str) -> DataFrame:
    """The same answer from the exact-ID states."""
    where = (F.col("source_kind") == source_kind) & (F.col("city_id") == city_id) & (F.col("event_date") == F.lit(day).cast("date"))
    return read_id_rollup(states.filter(where), SECTION_KEYS, "event_id")


def archive_detail(archive: DataFrame) -> DataFrame:
    return sum_rollup(archive.withColumn("event_date", F.to_date("event_time")), ["event_date", "event_type"])


def archive_prepared(partials: DataFrame) -> DataFrame:
    return read_sum_rollup(partials, ["event_date", "event_type"])


def latest_from_history(positions: DataFrame, run_id: str, city_id: str) -> DataFrame:
    where = (F.col("simulation_run_id") == run_id) & (F.col("city_id") == city_id)
    return latest_from_long_history(positions.filter(where), ["courier_id"], schemas.LATEST_PAYLOAD["courier_positions"])


def latest_from_state(states: DataFrame, run_id: str, city_id: str) -> DataFrame:
    where = (F.col("simulation_run_id") == run_id) & (F.col("city_id") == city_id)
    return read_state(states.filter(where), ["courier_id"])


def corpus(positions: DataFrame, run_id: str, city_id: str) -> DataFrame:
    """Row count, fleet, time span and content fingerprint of a frozen input."""
    where = (F.col("simulation_run_id") == run_id) & (F.col("city_id") == city_id)
    columns = ["event_id", "event_time", "ingested_at", "latitude", "longitude", "speed_kmh", "accuracy_m", "order_id"]
    return positions.filter(where).agg(
        F.count_distinct("courier_id").alias("couriers"), F.min("event_time").alias("first_event"),
        F.max("event_time").alias("last_event"), *content_fingerprint(*columns),
    )


def benchmark(detail: DataFrame, prepared: DataFrame) -> DataFrame:
    return compare_designs(detail, prepared)


def month_types(events: DataFrame, start: str, end: str) -> DataFrame:
    """Event types of a half-open date range; pair it with the month predicate to skip folders."""
    chosen = events.filter((F.col("event_date") >= F.lit(start).cast("date")) & (F.col("event_date") < F.lit(end).cast("date")))
    if "event_month" in events.columns:
        chosen = chosen.filter(
            F.col("event_month").between(int(start[:4]) * 100 + int(start[5:7]), int(end[:4]) * 100 + int(end[5:7]))
        )
    return chosen.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"))


def scenario_counts(copies: DataFrame) -> DataFrame:
    return copies.groupBy("scenario").agg(F.count(F.lit(1)).alias("events"))


def median_timing(runs: DataFrame, by: list[str], seconds: str = "seconds") -> DataFrame:
    return median(runs, by, seconds, "median_seconds")


# Latency evidence -----------------------------------------------------------------------------


def phase_summary(samples: DataFrame, phases: DataFrame) -> DataFrame:
    """Requests, failures, percentiles of successful ones, rate and target verdict per phase.

    ``samples``: phase columns, ``ok``, ``wall_ms``. ``phases``: phase columns,
    ``requested``, ``duration_s``, ``slo_ms``, ``reason``.
    """
    stats = samples.groupBy(*PHASE).agg(
        F.count(F.lit(1)).alias("attempted"), F.count_if("ok").alias("successful"),
        F.max(F.when(F.col("ok"), F.col("wall_ms"))).alias("max_client_ms"),
    )
    ranks = nearest_rank(samples.filter("ok"), PHASE, "wall_ms", {"p50_client_ms": 0.5, "p95_client_ms": 0.95}).drop("n")
    zero = F.lit(0).cast("bigint")
    joined = phases.join(stats, PHASE, "left").join(ranks, PHASE, "left").withColumn(
        "attempted", F.coalesce("attempted", zero)
    ).withColumn("successful", F.coalesce("successful", zero))
    complete = (F.col("reason") == "complete") & (F.col("attempted") == F.col("requested"))
    met = (F.col("successful") == F.col("requested")) & (F.col("p95_client_ms") <= F.col("slo_ms"))
    return joined.select(
        *PHASE, "requested", "attempted", "successful", (F.col("attempted") - F.col("successful")).alias("errors"),
        complete.alias("complete"), "reason", "p50_client_ms", "p95_client_ms", "max_client_ms",
        F.try_divide(F.col("successful").cast("double"), F.col("duration_s").cast("double")).alias("successful_qps"),
        F.when(~complete, "incomplete").when(F.coalesce(met, F.lit(False)), "pass").otherwise("fail").alias("slo_status"),
    )


def join_logs(samples: DataFrame, log: DataFrame) -> DataFrame:
    """Request samples with their server record, NULL where the log has none."""
    return samples.join(log, "query_id", "left")


def log_coverage(samples: DataFrame, log: DataFrame) -> DataFrame:
    found = log.select("query_id").distinct().withColumn("_hit", F.lit(True))
    return samples.join(found, "query_id", "left").agg(
        F.count(F.lit(1)).alias("measured_requests"), F.count("_hit").alias("terminal_records_found")
    ).withColumn("complete", F.col("measured_requests") == F.col("terminal_records_found"))


def phase_evidence(samples: DataFrame, log: DataFrame) -> DataFrame:
    """Median server time, rows and bytes, and peak memory of successful requests."""
    joined = join_logs(samples.filter("ok"), log).filter(F.col("query_duration_ms").isNotNull())
    peak = joined.groupBy(*PHASE).agg(F.bround(F.max("memory_usage") / 1048576, 3).alias("peak_query_memory_mib"))
    # The three measures become rows, so one pass finds all medians.
    measures = F.array(*[
        F.struct(F.lit(name).alias("name"), F.col(column).cast("double").alias("value")) for column, name in EVIDENCE.items()
    ])
    rows = joined.select(*PHASE, F.explode(measures).alias("m")).select(*PHASE, "m.name", "m.value")
    medians = median(rows, [*PHASE, "name"], "value").groupBy(*PHASE).agg(
        *[F.max(F.when(F.col("name") == name, F.col("median"))).alias(name) for name in EVIDENCE.values()]
    )
    return peak.join(medians, PHASE, "left")


def boundary_verdict(phases: DataFrame, repetitions: int) -> DataFrame:
    """Lowest concurrency at which history always fails and prepared state always passes."""
    history = F.col("design") == "history"
    ok = F.col("complete") & (F.col("slo_status") == F.when(history, "fail").otherwise("pass"))
    per = phases.groupBy("concurrency").agg(
        F.count_if(history).alias("_h"), F.count_if(~history).alias("_p"), F.bool_and(ok).alias("_ok")
    )
    hit = F.col("_ok") & (F.col("_h") == repetitions) & (F.col("_p") == repetitions)
    all_pass = phases.agg(F.bool_and(F.col("slo_status") == "pass").alias("all_pass"))
    lowest = per.agg(F.min(F.when(hit, F.col("concurrency"))).alias("boundary_concurrency"))
    merged = lowest.unionByName(all_pass, allowMissingColumns=True).agg(
        F.max("boundary_concurrency").alias("boundary_concurrency"), F.max("all_pass").alias("all_pass")
    )
    verdict: Column = (
        F.when(F.col("boundary_concurrency").isNotNull(), "boundary")
        .when(F.col("all_pass"), "not_reached").otherwise("inconclusive")
    )
    return merged.select("boundary_concurrency", verdict.alias("verdict"))
