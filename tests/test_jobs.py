"""Publishing, imports, exports, inventory, order statistics, sequences."""

import json
import math
import random
import shutil
import statistics

import pytest
from pyspark.sql import functions as F

from eventloom import schemas
from eventloom.functions import scalars as S
from eventloom.operators import quantiles, sequences, topk
from eventloom.plans import measurement
from eventloom.sources import export, inventory, positions, rowindex, tables
from tests.test_journey import activity_row
from tests.test_state import gps

RUN = "run"


# Layout and publishing ------------------------------------------------------------------------


def test_month_layout_prunes_and_replaces(spark, tmp_path, after):
    path = str(tmp_path / "t")
    rows = [activity_row(after, 0, i, "search", i * 86_400 * 10) for i in range(12)]
    df = spark.createDataFrame(rows, schemas.schema("customer_activity"))
    tables.write_table(df, "customer_activity", path, partitions=4)
    stored = tables.read_table(spark, "customer_activity", path)
    one = tables.between_dates(stored, "event_time", "2026-11-01", "2026-11-30")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "event_month" in plan.split("PartitionFilters:")[1].split("]")[0] and "PushedFilters: [IsNotNull(event_time)" in plan
    assert one.count() == 3
    tables.replace_month(df.limit(100), "customer_activity", path, 202611)
    assert tables.read_table(spark, "customer_activity", path).count() == 12


def test_staged_publish(spark, tmp_path):
    df = spark.range(10).withColumn("source_id", F.lit("abc"))
    staging, target = str(tmp_path / "s"), str(tmp_path / "t")
    with pytest.raises(ValueError):
        tables.staged_publish(df, staging, target, "abc", 11)
    assert not (tmp_path / "t" / "source_id=abc").exists()
    assert tables.staged_publish(df, staging, target, "abc", 10) == "published"
    assert tables.staged_publish(df, staging, target, "abc", 10) == "skipped"
    assert spark.read.parquet(target).count() == 10


def test_resume_needs_a_proven_prefix(spark, collect):
    rows = spark.createDataFrame([(s, r) for s in "abc" for r in range(1, 7)], "s STRING, source_row BIGINT")
    staged = spark.createDataFrame([("a", r) for r in (1, 2, 3)] + [("b", r) for r in (1, 3)] + [("c", r) for r in (3, 4)], "s STRING, source_row BIGINT")
    rest = tables.resume_after(rows, tables.resume_point(staged, ["s"]), ["s"])
    assert {r.s: r["min"] for r in rest.groupBy("s").agg(F.min("source_row").alias("min")).collect()} == {"a": 4, "b": 1, "c": 1}


def test_audit_lists_differences(spark, collect):
    measured = spark.createDataFrame([("a", 3), ("b", 1)], "t STRING, rows BIGINT")
    expected = spark.createDataFrame([("a", 3), ("b", 2), ("c", 4)], "t STRING, rows BIGINT")
    assert collect(tables.audit_counts(measured, expected, ["t"])) == [("b", 1, 2), ("c", 0, 4)]


def test_drop_scenario(spark, tmp_path, collect):
    path = str(tmp_path / "c")
    spark.range(6).select((F.col("id") % 3).cast("int").alias("scenario"), "id").write.partitionBy("scenario").parquet(path)
    left = tables.drop_scenario(spark.read.schema("id BIGINT, scenario INT").parquet(path), path, 1)
    assert collect(left.select("scenario").distinct()) == [(0,), (2,)]


def test_copies_are_written_without_a_shuffle(spark, tmp_path, after):
    rows = [(1, i, after(i), "clicks", 0) for i in range(10)]
    path = str(tmp_path / "copies")
    tables.write_copies(spark.createDataFrame(rows, schemas.schema("otto_archive")), path, 3)
    stored = tables.read_table(spark, "otto_scale_benchmark", path)
    assert {r.scenario: (r.n, r.s) for r in stored.groupBy("scenario").agg(F.count("session_id").alias("n"), F.min("session_id").alias("s")).collect()} == {
        k: (10, 1 + k * 20_000_000) for k in range(3)
    }
    assert "Exchange" not in tables.scale_copies(stored.select("session_id", "article_id", "event_time", "event_type"))._jdf.queryExecution().executedPlan().toString()
    assert (tmp_path / "copies" / "scenario=1" / "event_month=202612").exists()


def test_row_numbers_over_splits(spark, tmp_path):
    for f, n in (("a", 5000), ("b", 700)):
        (tmp_path / f).write_text("".join(f"{f}{i}\n" for i in range(1, n + 1)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = rowindex.with_row_index(spark.read.text(str(tmp_path)))
        assert got.rdd.getNumPartitions() > 4
        assert got.filter(F.substring("value", 2, 9).cast("bigint") != F.col("source_row")).isEmpty() and got.count() == 5700
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


# GPS import -----------------------------------------------------------------------------------


def gps_file(path, change=lambda row: row, n=3):
    import csv
    import uuid

    with open(path, "w", newline="", encoding="utf-8") as out:
        writer = csv.DictWriter(out, positions.COLUMNS)
        writer.writeheader()
        for i in range(n):
            row = dict(
                schema_version=1, event_id=str(uuid.uuid5(uuid.NAMESPACE_DNS, str(i))), simulation_run_id=RUN, event_time="2026-10-31 15:00:00.000",
                ingested_at="2026-10-31 15:00:01.000", city_id="madrid", courier_id=str(uuid.uuid5(uuid.NAMESPACE_DNS, "k")), order_id=schemas.UNASSIGNED,
                latitude=40.4, longitude=-3.7, speed_kmh=1, accuracy_m=5, source="a, quoted\nline", source_kind="synthetic",
            )
            writer.writerow(change(row))
    return str(path)


def test_positions_import(spark, tmp_path):
    nothing = spark.createDataFrame([], schemas.schema("courier_positions"))
    path = gps_file(tmp_path / "p.csv")
    loaded = positions.import_positions(spark, path, nothing, RUN, 3)
    assert loaded.count() == 3 and loaded.first().source == "a, quoted\nline"
    with pytest.raises(ValueError):
        positions.import_positions(spark, path, loaded, RUN, 3)
    for name, kwargs in {
        "rows": {"expected": 4}, "run": {"change": lambda r: dict(r, simulation_run_id="x")}, "city": {"change": lambda r: dict(r, city_id="x")},
        "lat": {"change": lambda r: dict(r, latitude="nan")}, "lon": {"change": lambda r: dict(r, longitude=181)},
    }.items():
        expected = kwargs.pop("expected", 3)
        with pytest.raises(ValueError):
            positions.import_positions(spark, gps_file(tmp_path / f"{name}.csv", **kwargs), nothing, RUN, expected)


# Export ---------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def streams(spark, after):
    act = [activity_row(after, n, i, a, i, m) for n, m in ((0, "ollama"), (1, "rules")) for i, a in enumerate(["search", "checkout"])]
    act[0]["reason"] = 'a, "quoted"\nreason'
    act.append(dict(act[0], ingested_at=after(500)))
    act.append(activity_row(after, 5, 0, "search", 0, run="other"))
    return {"customer_activity": spark.createDataFrame(act, schemas.schema("customer_activity")), "courier_positions": gps(spark, after)}


def test_export_verify_and_report(spark, tmp_path, streams):
    out = str(tmp_path / "runs" / "first")
    summary = export.export_run(spark, streams, RUN, out)
    assert summary["tables"]["customer_activity"]["rows"] == 4 and summary["tables"]["courier_positions"]["rows"] == 12
    assert summary["participants"] == {"customers": 2, "ai_customers": 1, "ai_decisions": 2, "couriers": 3}
    back = export.read_export(spark, out, "customer_activity")
    assert back.filter(F.col("reason") == 'a, "quoted"\nreason').count() == 1
    assert export.export_run(spark, streams, RUN, out) == export.verify_export(spark, out, RUN)
    with pytest.raises(ValueError):
        export.verify_export(spark, out, "other")
    (tmp_path / "runs" / "second.partial-1").mkdir()
    report = export.runs_report(export.read_manifests(spark, str(tmp_path / "runs"))).collect()
    assert [(r.folder, r.total_rows, r.ai_customers, r.event_span) for r in report] == [("first", 16, 1, "< 1 min")]


@pytest.mark.parametrize("damage", ["cut", "swap", "extra"])
def test_damaged_export_is_found(spark, tmp_path, streams, damage):
    out = tmp_path / "x"
    export.export_run(spark, streams, RUN, str(out))
    copy = tmp_path / "copy"
    shutil.copytree(out, copy)
    part = sorted((copy / "courier_positions").glob("*.csv.gz"))[0]
    if damage == "cut":
        part.write_bytes(part.read_bytes()[:-5])
    elif damage == "swap":
        data = bytearray(part.read_bytes())
        data[len(data) // 2] ^= 1
        part.write_bytes(bytes(data))
    else:
        shutil.copy(part, part.with_name("part-extra.csv.gz"))
    for crc in copy.rglob(".*.crc"):
        crc.unlink()
    with pytest.raises(ValueError):
        export.verify_export(spark, str(copy), RUN)


def test_span_text(spark):
    df = spark.createDataFrame([(10,), (300,), (3600 * 2 + 65,)], "s INT")
    assert [r[0] for r in df.select(export.span_text(F.col("s"))).collect()] == ["< 1 min", "5 min", "2 h 01 min"]


# Inventory ------------------------------------------------------------------------------------


def test_inventory_reads_footers(spark, tmp_path):
    spark.range(1000).repartition(3).write.parquet(str(tmp_path / "t"))
    row = inventory.storage_inventory(spark, {"t": str(tmp_path / "t")}).first()
    assert (row.physical_rows, row.files) == (1000, 3) and row.uncompressed_bytes > 0
    layout = spark.createDataFrame([("db", "t", "month")], "database STRING, table_name STRING, partition_key STRING")
    named = inventory.storage_inventory(spark, {"t": str(tmp_path / "t")}).withColumn("database", F.lit("db"))
    assert inventory.with_layout(named, layout).first().partition_key == "month"


def test_event_log(spark, tmp_path):
    start = "org.apache.spark.sql.execution.ui.SparkListenerSQLExecutionStart"
    end = "org.apache.spark.sql.execution.ui.SparkListenerSQLExecutionEnd"
    lines = [
        {"Event": start, "executionId": 1, "description": "count 5", "physicalPlanDescription": "Location: InMemoryFileIndex [file:/a/t]\n", "time": 1000},
        {"Event": end, "executionId": 1, "time": 1250}, {"Event": start, "executionId": 2, "description": "open", "physicalPlanDescription": "", "time": 1000},
    ]
    path = tmp_path / "log"
    path.write_text("\n".join(json.dumps(l) for l in lines))
    rows = inventory.read_event_log(spark, str(path)).collect()
    assert len(rows) == 1 and rows[0].query_duration_ms == 250 and rows[0].tables == ["file:/a/t"]


# Order statistics -------------------------------------------------------------------------------


def test_quantiles_equal_sorting(spark):
    rng = random.Random(5)
    data = {g: [rng.choice([rng.gauss(0, 5), 1e9 * rng.random(), float(rng.randint(0, 3))]) for _ in range(n)] for g, n in (("a", 1), ("b", 2), ("c", 777), ("d", 3000))}
    df = spark.createDataFrame([(g, v) for g, vs in data.items() for v in vs] + [("a", None)], "g STRING, v DOUBLE")
    for p in (0.0, 0.5, 0.95, 1.0):
        exact = {r.g: r.quantile for r in quantiles.quantile_exact(df, ["g"], "v", p).collect()}
        near = {r.g: r.x for r in quantiles.nearest_rank(df, ["g"], "v", {"x": p}).collect()}
        for g, vs in data.items():
            ordered = sorted(vs)
            assert exact[g] == ordered[min(math.floor(p * len(vs)), len(vs) - 1)]
            assert near[g] == ordered[max(0, math.ceil(p * len(vs)) - 1)]
    assert {r.g: r["median"] for r in quantiles.median(df, ["g"], "v").collect()} == {g: statistics.median(vs) for g, vs in data.items()}
    assert quantiles.quantile_exact(spark.createDataFrame([(1,), (2,), (3,), (4,)], "v INT"), [], "v").first()["quantile"] == 3
    assert quantiles.quantile_exact(spark.createDataFrame([], "v INT"), [], "v").isEmpty()
    assert quantiles.quantile_exact(spark.createDataFrame([], "g INT, v INT"), ["g"], "v").isEmpty()


def test_phase_summary_and_verdict(spark):
    ddl = "design STRING, concurrency INT, repetition INT, ok BOOLEAN, wall_ms DOUBLE, query_id STRING"
    rows = []
    for c in (1, 2):
        for rep in (1, 2, 3):
            for i in range(20):
                rows.append(("history", c, rep, True, 600.0 * c + i, f"h{c}{rep}{i}"))
                rows.append(("prepared", c, rep, True, 100.0 + i, f"p{c}{rep}{i}"))
    rows += [("history", 3, 1, False, 5.0, "e")]
    samples = spark.createDataFrame(rows, ddl)
    phases = spark.createDataFrame(
        [(d, c, r, 20, 10.0, 1000.0, "complete") for d in ("history", "prepared") for c in (1, 2) for r in (1, 2, 3)] + [("history", 3, 1, 20, 10.0, 1000.0, "stopped")],
        "design STRING, concurrency INT, repetition INT, requested INT, duration_s DOUBLE, slo_ms DOUBLE, reason STRING",
    )
    out = measurement.phase_summary(samples, phases)
    first = out.filter("design = 'history' AND concurrency = 1 AND repetition = 1").first()
    assert (first.p50_client_ms, first.p95_client_ms, first.max_client_ms, first.successful_qps, first.slo_status) == (609.0, 618.0, 619.0, 2.0, "pass")
    stopped = out.filter("concurrency = 3").first()
    assert (stopped.errors, stopped.p95_client_ms, stopped.slo_status) == (1, None, "incomplete")
    verdict = measurement.boundary_verdict(out.filter("concurrency < 3"), 3).first()
    assert (verdict.boundary_concurrency, verdict.verdict) == (2, "boundary")
    assert measurement.boundary_verdict(out.filter("design = 'prepared'"), 3).first().verdict == "not_reached"
    assert measurement.boundary_verdict(out, 5).first().verdict == "inconclusive"
    log = spark.createDataFrame([(r[5], 1.0 * i, i, i, 1048576 * i) for i, r in enumerate(rows[:4])], "query_id STRING, query_duration_ms DOUBLE, read_rows BIGINT, read_bytes BIGINT, memory_usage BIGINT")
    assert not measurement.log_coverage(samples, log).first().complete
    evidence = {r.design: r for r in measurement.phase_evidence(samples, log).collect()}
    assert evidence["history"].median_server_ms == 1.0 and evidence["prepared"].peak_query_memory_mib == 3.0


# Sequences ------------------------------------------------------------------------------------


def test_previous_rows_over_slots(spark):
    rng = random.Random(9)
    data = {k: sorted(rng.sample(range(-500, 500), 60)) for k in "ab"}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "k STRING, v BIGINT")
    for width in (1, 7, 100, 10_000):
        got = sequences.with_previous(df, ["k"], ["v"], ["v"], F.floor(F.col("v") / width))
        pairs = {(r.k, r.v): r.previous.v if r.previous else None for r in got.collect()}
        assert pairs == {(k, v): (vs[i - 1] if i else None) for k, vs in data.items() for i, v in enumerate(vs)}


def test_gaps_and_continuity(spark, collect):
    df = spark.createDataFrame([(n,) for n in (1, 2, 5, 6, 6, 9)], "n INT")
    assert collect(sequences.gaps(df, [], "n")) == [(3, 4, 2), (7, 8, 2)]
    assert not sequences.continuity(df, [], "n").first().continuous
    assert sequences.continuity(spark.range(2, 6), [], "id").first().continuous
    assert not sequences.continuity(spark.range(3, 6), [], "id").first().continuous


def test_path_length(spark, after):
    df = gps(spark, after)
    for r in sequences.path_length(df, ["courier_id"], slot_seconds=2).collect():
        assert r.positions == 4 and abs(r.metres - 3 * 0.001 * 111320) < 1e-6


def test_small_expressions(spark, after):
    row = spark.createDataFrame([(after(0), after(3))], "a TIMESTAMP, b TIMESTAMP").select(
        S.day_key("a"), S.interval_start("b", 5), S.millis_between("a", "b"), S.readable_size(F.lit(1536)), S.euros(F.lit(1234)).cast("string"),
        S.share_pct(F.lit(1), F.lit(0)), F.bround(F.lit(2.5), 0),
    ).first()
    assert row[0] == 20261031 and row[1].second == 0 and row[2] == 3000 and row[3] == "1.50 KiB" and row[4] == "12.34" and row[5] is None and row[6] == 2.0


def test_limits(spark):
    rows, totals = topk.limited(spark.range(10), 3, "id")
    assert [r.id for r in rows.collect()] == [0, 1, 2] and totals.first().truncated
    assert [r.id for r in topk.latest_chronological(spark.range(10), 3, "id").collect()] == [7, 8, 9]
