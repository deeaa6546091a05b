"""Versions, latest state under late arrival, rollups, comparison."""

import random

import pytest
from pyspark.sql import functions as F

from eventloom import schemas
from eventloom.operators import compare, rollups, versioning
from eventloom.paths import child_names
from eventloom.plans import audits, measurement

POS = schemas.LATEST_KEYS["courier_positions"]


def gps(spark, after, order=(2, 0, 3, 1)):
    data = [
        (1, f"{c}:{s}", "run", after(s), after(s), "madrid", f"k{c}", schemas.UNASSIGNED, 40.4 + s * 0.001, -3.7 + c * 0.001, 12.0, 5.0, "fix", "synthetic")
        for c in range(3) for s in order
    ]
    return spark.createDataFrame(data, schemas.schema("courier_positions"))


def test_out_of_order_positions(spark, after):
    latest = versioning.latest_of("courier_positions", gps(spark, after)).collect()
    assert len(latest) == 3 and all(abs(r.latitude - 40.403) < 1e-9 for r in latest)


def test_late_older_row_never_wins(spark, after, collect):
    df = gps(spark, after)
    payload = schemas.LATEST_PAYLOAD["courier_positions"]
    first = versioning.partial_state(df.filter("latitude > 40.4005"), POS, payload)
    late = versioning.partial_state(df.filter("latitude < 40.4005"), POS, payload)
    expected = collect(versioning.latest_of("courier_positions", df))
    for states in (first.unionByName(late), late.unionByName(first), first.unionByName(late).unionByName(first)):
        assert collect(versioning.read_state(states, POS)) == expected


def test_payload_keeps_null_fields(spark):
    df = spark.createDataFrame([("a", 1, "x", 5), ("a", 2, None, 7)], "k STRING, t INT, v STRING, w INT")
    assert versioning.latest_state(df, ["k"], ["v", "w"], ["t"]).first() == ("a", None, 7)


def test_newest_per_full_key(spark, after, collect):
    base = dict(zip(["customer_id", "simulation_run_id", "event_id"], ["c", "r", "e"]))
    def row(t, v, reason):
        return dict(base, event_time=after(t), ingested_at=after(v), reason=reason)
    ddl = "customer_id STRING, simulation_run_id STRING, event_id STRING, event_time TIMESTAMP, ingested_at TIMESTAMP, reason STRING"
    df = spark.createDataFrame([row(0, 1, "old"), row(0, 9, "new"), row(0, 5, "mid"), row(7, 8, "moved")], ddl)
    # The key includes the time: the same identity at another time is another row.
    assert collect(versioning.newest_of("customer_activity", df), "reason") == [("moved",), ("new",)]


def test_filters_reach_below_newest(spark, after):
    df = gps(spark, after)
    plan = versioning.newest_of("courier_positions", df).filter("courier_id = 'k1'")._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    assert next(i for i, l in enumerate(lines) if "Aggregate" in l) < next(i for i, l in enumerate(lines) if "Filter" in l)


def test_update_and_delete_touch_one_partition(spark, tmp_path, collect):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a", 10), (2, "a", 20), (3, "b", 30)], "id INT, p STRING, v INT").write.partitionBy("p").parquet(path)
    df = spark.read.schema("id INT, v INT, p STRING").parquet(path)
    here = F.col("p") == "a"
    updated = versioning.rewrite_partitions(df, path, "p", here, F.col("id") == 1, {"v": F.lit(99)})
    assert collect(updated) == [(1, 99, "a"), (2, 20, "a"), (3, 30, "b")]
    spark.catalog.clearCache()
    left = versioning.rewrite_partitions(spark.read.schema("id INT, v INT, p STRING").parquet(path), path, "p", here, here)
    assert collect(left) == [(3, 30, "b")]


# Rollups ------------------------------------------------------------------------------------


def batches(spark):
    rng = random.Random(3)
    data = [(f"e{i}", f"d{i % 3}", rng.choice("xyz")) for i in range(60)]
    return spark.createDataFrame(data, "event_id STRING, day STRING, kind STRING")


@pytest.mark.parametrize("seed", [1, 2])
def test_rollups_do_not_depend_on_batches(spark, tmp_path, seed, collect):
    df, rng = batches(spark), random.Random(seed)
    detail = collect(df.groupBy("day", "kind").agg(F.count(F.lit(1)).alias("events")))
    parts = df.withColumn("b", F.pmod(F.xxhash64("event_id", F.lit(seed)), F.lit(4)))
    sums, ids = str(tmp_path / "sum"), str(tmp_path / "ids")
    for b in rng.sample(range(4), 4):
        part = parts.filter(F.col("b") == b).drop("b")
        for _ in range(2):  # every batch is replayed once
            rollups.write_batch_state(rollups.sum_rollup(part, ["day", "kind"]), sums, b)
            rollups.write_batch_state(rollups.id_rollup(part, ["day", "kind"], "event_id"), ids, b)
    # One event repeated in another batch: exact sets stay exact.
    rollups.write_batch_state(rollups.id_rollup(df.limit(5), ["day", "kind"], "event_id"), ids, 4)
    assert collect(rollups.read_sum_rollup(rollups.read_batch_states(spark, sums), ["day", "kind"])) == detail
    assert collect(rollups.read_id_rollup(rollups.read_batch_states(spark, ids), ["day", "kind"], "event_id")) == detail
    rollups.compact(spark, sums, 3, lambda s: rollups.read_sum_rollup(s, ["day", "kind"]))
    assert collect(rollups.read_sum_rollup(rollups.read_batch_states(spark, sums), ["day", "kind"])) == detail
    # A batch that compaction absorbed is not added again.
    assert not rollups.write_batch_state(rollups.sum_rollup(df, ["day", "kind"]), sums, 2)
    assert rollups.write_batch_state(rollups.sum_rollup(df, ["day", "kind"]), sums, 4)
    assert "generation=3" in child_names(spark, sums)


def test_backfill_checks_totals(spark, tmp_path):
    check = rollups.backfill_sum(batches(spark), str(tmp_path / "r"), ["day", "kind"]).first()
    assert check.same and check.archive_events == check.rollup_events == 60
    broken = rollups.sum_rollup(batches(spark).limit(50), ["day", "kind"])
    assert not rollups.rollup_check(batches(spark), broken, ["day", "kind"]).first().same
    good = rollups.sum_rollup(batches(spark), ["day", "kind"])
    assert not rollups.rollup_check(batches(spark), good, ["day", "kind"], expected_keys=87).first().same


def test_sketch_error(spark):
    df = spark.range(200_000).select((F.col("id") % 2).alias("g"), (F.col("id") % 40_000).alias("u"), (F.col("id") % 5).alias("batch"))
    states = rollups.hll_rollup(df, ["batch", "g"], "u")
    for r in rollups.read_hll_rollup(states, ["g"]).collect():
        assert abs(r.approx_members - 20_000) / 20_000 < 0.03


# Comparison ---------------------------------------------------------------------------------


def app_event(after, ingested=0, event_type="search"):
    return (1, "e1", "s1", after(0), after(0).date(), after(1 + ingested), event_type, "home", "madrid", None, None, None, "app", "synthetic", None, "run", None)


def test_retry_counts_once_and_broken_rollup_is_seen(spark, after):
    df = spark.createDataFrame([app_event(after), app_event(after, 60)], schemas.schema("app_events"))
    day = "2026-10-31"
    detail = measurement.app_day_detail(df, day, "synthetic", "madrid")
    states = rollups.id_rollup(df, ["source_kind", "event_date", "city_id", "section", "event_type"], "event_id")
    prepared = measurement.app_day_prepared(states, day, "synthetic", "madrid")
    assert [r.events for r in detail.collect()] == [1]
    good = compare.timing_ratio(measurement.benchmark(detail, prepared), 8.0, 2.0).first()
    assert good.same_result and good.ratio == 4.0
    bad = compare.timing_ratio(measurement.benchmark(detail, prepared.withColumn("events", F.col("events") + 1)), 8.0, 2.0).first()
    assert not bad.same_result and bad.ratio is None
    assert audits.detail_matches_rollup(df, states).first().same


def test_diff_counts_multiplicity(spark, collect):
    a = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a INT, b STRING")
    b = spark.createDataFrame([(1, None), (3, "y")], "a INT, b STRING")
    assert sorted((r.a, r.surplus) for r in compare.diff_rows(a, b).collect()) == [(1, 1), (2, 1), (3, -1)]
    assert compare.same_rows(a, a.orderBy("a")).first().same
    assert compare.same_rows(a.limit(0), a.limit(0)).first().same


def test_fingerprint_sees_pairs_and_ignores_order(spark):
    df = spark.range(100).select("id", (F.col("id") * 2).alias("v"))
    assert compare.fingerprint(df).first() == compare.fingerprint(df.repartition(7)).first()
    extra = df.unionByName(df.limit(1)).unionByName(df.limit(1))
    assert compare.fingerprint(df).first() != compare.fingerprint(extra).first()


def test_ranks_of_a_large_group_with_outliers_on_several_scales(spark):
    import random

    from eventloom.operators import quantiles

    rng = random.Random(2)
    hot = [rng.random() for _ in range(4000)] + [1e6 * rng.random() for _ in range(40)] + [1e15 * rng.random() for _ in range(4)]
    rows = [("hot", v) for v in hot] + [(f"g{i % 50}", float(i)) for i in range(500)] + [(None, 5.0), (None, 7.0), ("hot", None), ("empty", None)]
    df = spark.createDataFrame(rows, "g STRING, v DOUBLE").repartition(5)
    got = {r.g: r.q for r in quantiles.quantile_exact(df, ["g"], "v", 0.5, "q").collect()}
    assert got["hot"] == sorted(hot)[len(hot) // 2] and got[None] == 7.0 and "empty" not in got and len(got) == 52
    levels = quantiles.nearest_rank(df, [], "v", {"p1": 0.01, "p99": 0.99}).first()
    values = sorted(v for _, v in rows if v is not None)
    assert (levels.p1, levels.p99) == (values[-(-len(values) // 100) - 1], values[-(-len(values) * 99 // 100) - 1])


def test_passing_stages_removes_its_tables_only(spark):
    from eventloom.session import passing_stages, stage_once

    before = stage_once(spark.range(3), "before")
    with passing_stages(spark):
        inner = stage_once(before.selectExpr("id + 1 AS id"), "inner")
        kept = stage_once(inner, "kept", keep=True)
        with passing_stages(spark):
            handed = stage_once(kept, "handed", keep=True)
        assert handed.count() == 3
    assert [df.count() for df in (before, kept)] == [3, 3]
    for gone in (inner, handed):
        files = gone.inputFiles()
        assert files and not any(spark._jvm.java.io.File(f.removeprefix("file://")).exists() for f in files)


def test_only_repeated_keys_are_merged(spark):
    from eventloom.operators.versioning import newest, newest_of_repeated

    rows = [(i % 40 if i < 60 else None if i % 3 == 0 else i, i % 2, i * 7 % 11, f"t{i}") for i in range(300)]
    df = spark.createDataFrame(rows + [(5, 1, 99, "hot")] * 200, "k INT, part INT, version INT, text STRING").repartition(6)
    plain = lambda out: sorted((tuple(r) for r in out.collect()), key=str)
    assert plain(newest_of_repeated(df, ["k", "part"], "version", ["text"])) == plain(newest(df, ["k", "part"], "version", ["text"]))
    assert newest_of_repeated(df.limit(0), ["k"], "version").count() == 0
    single = spark.range(1000).selectExpr("id AS k", "id AS version", "id AS payload")
    merged = newest_of_repeated(single, ["k"], "version")
    merged.collect()
    plan = merged._jdf.queryExecution().executedPlan().toString().split("Union")[-1]
    passing = plan[:plan.index("LeftSemi")] if "LeftSemi" in plan else plan
    assert "BroadcastHashJoin" in passing and "LeftAnti" in passing and "Sort " not in passing.split("LeftAnti")[0].split("SortAggregate")[0]
