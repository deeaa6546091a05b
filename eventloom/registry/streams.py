"""Streaming jobs drained over the events table; their tables must equal the batch answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.operators.rollups import compact, read_batch_states, read_hll_rollup, read_id_rollup, read_sum_rollup
from eventloom.operators.versioning import merge_states, read_state
from eventloom.registry import query
from eventloom.registry.contracts import app_payloads
from eventloom.registry.views import day, ev, ms, plain, with_sql
from eventloom.session import ensure_utc, scratch_path
from eventloom.streaming import ingest, replay, windows

FILES = 4


def _source(spark, sf_dir):
    """The whole events table as several small files, read as a stream, one file per micro-batch."""
    ensure_utc(spark)
    path = scratch_path(spark, "source")
    ev(spark, sf_dir).withColumn("day", F.to_date("moment")).repartition(FILES).write.parquet(path)
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def _rollups(spark, sf_dir):
    path = scratch_path(spark, "rollups")
    ingest.stream_rollups(_source(spark, sf_dir), path, scratch_path(spark, "ck"), ["day", "event_type"], "user_id").awaitTermination()
    return path


_BY_DAY = with_sql("ev") + f"SELECT {day('CAST(moment AS DATE)')} AS day, event_type, {{}} FROM ev GROUP BY ALL"


@query("stream_rollup_sum", _BY_DAY.format("count(*) AS events"))
def stream_sum(spark, sf_dir):
    states = read_batch_states(spark, _rollups(spark, sf_dir) + "/sum")
    return plain(read_sum_rollup(states, ["day", "event_type"]))


@query("stream_rollup_ids", _BY_DAY.format("count(DISTINCT user_id) AS users"))
def stream_ids(spark, sf_dir):
    """Exact distinct users, after folding all batches into one."""
    path = _rollups(spark, sf_dir) + "/ids"
    last = max(int(r[0]) for r in read_batch_states(spark, path).select(
        F.regexp_extract(F.input_file_name(), "batch_id=([0-9]+)", 1)).distinct().collect())  # one row per batch
    compact(spark, path, last, lambda s: s.distinct())
    return plain(read_id_rollup(read_batch_states(spark, path), ["day", "event_type"], "user_id", "users"))


@query("stream_rollup_sketch")
def stream_sketch(spark, sf_dir):
    states = read_batch_states(spark, _rollups(spark, sf_dir) + "/hll")
    return plain(read_hll_rollup(states, ["day", "event_type"]))


@query("stream_latest", with_sql("ev") + f"""SELECT user_id, arg_max(event_type, row(moment, event_id)) AS event_type, {ms('max(moment)')} AS last_seen FROM ev GROUP BY user_id""")
def stream_latest(spark, sf_dir):
    path = scratch_path(spark, "latest")
    ingest.stream_latest(
        _source(spark, sf_dir), path, scratch_path(spark, "ck"), ["user_id"], ["event_type", "moment"], ["moment", "event_id"]
    ).awaitTermination()
    states = merge_states(read_batch_states(spark, path), ["user_id"])
    return plain(read_state(states, ["user_id"]).withColumnRenamed("moment", "last_seen"))


_HOURLY = """, h AS (SELECT {at} AS moment, event_type, k FROM ev)
    SELECT """ + ms("date_trunc('hour', moment)") + """ AS bucket, event_type, count(*) AS events, count(*) FILTER (WHERE k < 10) AS low FROM h GROUP BY ALL"""


def _hourly(spark, source):
    """Hourly windows of a drained stream: every micro-batch stores its part of each window it touches."""
    out = scratch_path(spark, "windows")
    windows.store_window_parts(source, out, scratch_path(spark, "ck"), "moment", "1 hour", ["event_type"], {"low": F.col("k") < 10}).awaitTermination()
    return plain(windows.read_window_parts(read_batch_states(spark, out), ["event_type"], ["low"]))


@query("stream_tumbling", with_sql("ev") + _HOURLY.format(at="moment"))
def stream_tumbling(spark, sf_dir):
    return _hourly(spark, _source(spark, sf_dir))


_VERY_LATE = "CASE WHEN event_id % 5 = 0 THEN moment - INTERVAL 3653 DAY ELSE moment END"


@query("stream_tumbling_late", with_sql("ev") + _HOURLY.format(at=_VERY_LATE))
def stream_tumbling_late(spark, sf_dir):
    """A fifth of the events arrives ten years late, among the others; none is lost."""
    late = F.when(F.col("event_id") % 5 == 0, F.col("moment") - F.expr("INTERVAL 3653 DAYS")).otherwise(F.col("moment"))
    return _hourly(spark, _source(spark, sf_dir).withColumn("moment", late))


@query("window_tumbling", with_sql("ev") + f"""SELECT {ms("date_trunc('hour', moment)")} AS bucket, event_type, count(*) AS events FROM ev GROUP BY ALL""")
def window_tumbling(spark, sf_dir):
    return plain(windows.tumbling_counts(ev(spark, sf_dir), "moment", "1 hour", ["event_type"]))


@query("window_distinct", with_sql("ev") + f"""SELECT {ms("date_trunc('hour', moment)")} AS bucket, count(DISTINCT user_id) AS users FROM ev GROUP BY 1""")
def window_distinct(spark, sf_dir):
    return plain(windows.distinct_per_window(ev(spark, sf_dir), "moment", "1 hour", "user_id", "users"))


@query("window_sliding", with_sql("ev") + f""", s AS (SELECT make_timestamp((epoch_ms(moment) // 600000 - i) * 600000000) AS w, event_type FROM ev, (SELECT unnest(range(6)) AS i))
    SELECT {ms('w')} AS window_start, {ms('w + INTERVAL 1 HOUR')} AS window_end, count(*) AS events, count(*) FILTER (WHERE event_type = 'click') AS clicks FROM s GROUP BY w""")
def window_sliding(spark, sf_dir):
    out = windows.sliding_counts(ev(spark, sf_dir), "moment", "1 hour", "10 minutes", counts={"clicks": F.col("event_type") == "click"})
    return plain(out)


@query("window_trailing", with_sql("ev") + "SELECT count(*) AS events FROM ev WHERE moment >= TIMESTAMP '2024-01-31' - INTERVAL 1 DAY")
def window_trailing(spark, sf_dir):
    recent = windows.trailing(ev(spark, sf_dir), "moment", F.lit("2024-01-31").cast("timestamp"), 86_400)
    return plain(recent.agg(F.count(F.lit(1)).alias("events")))


_OK = ("NOT (k IN (1, 2, 3, 4, 5, 6, 9) OR event_type = 'error' OR k % 4 = 1 OR (k IN (7, 8) AND event_type = 'click'))")


def _ingested(spark, sf_dir):
    ensure_utc(spark)
    source = scratch_path(spark, "json")
    # Dealt as short rows; the texts are made where they are written.
    app_payloads(spark, sf_dir, FILES, "event_id").select(F.col("payload").alias("value")).write.text(source)
    # The same lines again, in two files: retries of everything.
    spark.read.text(source).coalesce(2).write.mode("append").text(source)
    lake = ingest.Lake(scratch_path(spark, "lake"))
    ingest.start_ingest(spark, source, lake, scratch_path(spark, "ck"), files_per_trigger=3, interval=None).awaitTermination()
    return lake


@query("stream_ingest", with_sql("ev") + f"""SELECT event_type, count(*) AS events FROM (
    SELECT CASE WHEN event_type = 'click' THEN 'product_opened' ELSE 'search' END AS event_type FROM ev WHERE {_OK}) GROUP BY 1""")
def stream_ingest(spark, sf_dir):
    """Every event is sent twice; valid ones are stored once."""
    lake = _ingested(spark, sf_dir)
    return plain(lake.read(spark, "app_events").groupBy("event_type").agg(F.count(F.lit(1)).alias("events")))


@query("stream_ingest_counters", with_sql("ev") + f"""SELECT 2 * count(*) FILTER (WHERE {_OK}) AS received, count(*) FILTER (WHERE {_OK}) AS accepted,
    count(*) FILTER (WHERE {_OK}) AS duplicates, 0::BIGINT AS conflicts, 2 * count(*) FILTER (WHERE NOT ({_OK})) AS invalid FROM ev""")
def stream_counters(spark, sf_dir):
    lake = _ingested(spark, sf_dir)
    counters = spark.read.parquet(lake.metrics)
    return plain(counters.agg(*[F.sum(c).alias(c) for c in ("received", "accepted", "duplicates", "conflicts", "invalid")]))


@query("stream_ingest_conflicts", with_sql("ev") + f""", ok AS (SELECT event_id, event_id % 40 AS part FROM ev WHERE {_OK}),
    bad AS (SELECT DISTINCT part FROM ok WHERE event_id % 1000 = 0)
    SELECT count(*) AS stored, count(*) AS accepted, count(*) FILTER (WHERE part NOT IN (SELECT part FROM bad)) AS duplicates,
    count(*) FILTER (WHERE event_id % 1000 = 0) AS conflicts FROM ok""")
def stream_conflicts(spark, sf_dir):
    """All events arrive once, then again in 40 files, some of which change an event: only those files are refused."""
    ensure_utc(spark)
    source = scratch_path(spark, "json")
    # Dealt as short rows; the texts are made where they are written.
    first = app_payloads(spark, sf_dir, FILES, "event_id").select(F.col("payload").alias("value"), F.lit(1000).alias("part"))
    first.write.partitionBy("part").text(source)
    other = F.replace("payload", F.lit('"city_id":"madrid"'), F.lit('"city_id":"other"'))
    part = F.col("event_id") % 40
    again = app_payloads(spark, sf_dir, 40, part).select(F.when(F.col("event_id") % 1000 == 0, other).otherwise(F.col("payload")).alias("value"), part.alias("part"))
    again.write.partitionBy("part").mode("append").text(source)
    lake = ingest.Lake(scratch_path(spark, "lake"))
    ingest.start_ingest(spark, source, lake, scratch_path(spark, "ck"), files_per_trigger=100, interval=None).awaitTermination()
    sums = spark.read.parquet(lake.metrics).select("accepted", "duplicates", "conflicts", F.lit(0).cast("bigint").alias("stored"))
    stored = lake.read(spark, "app_events").agg(F.count(F.lit(1)).alias("stored"))
    both = sums.unionByName(stored, allowMissingColumns=True)
    return plain(both.agg(*[F.sum(c).alias(c) for c in ("stored", "accepted", "duplicates", "conflicts")]))


@query("replay_order", with_sql("archive") + f"""SELECT session_id, event_type, {ms('event_time')} AS event_time FROM archive
    ORDER BY archive.event_time, session_id LIMIT 500""")
def replay_order(spark, sf_dir):
    """The first 500 events of the archive, replayed 100 per micro-batch."""
    from eventloom.registry.views import archive

    source, out = scratch_path(spark, "replay"), scratch_path(spark, "replayed")
    replay.write_replay_files(replay.ordered_slice(archive(spark, sf_dir), 500), source, 100)
    stream = replay.replay_files(spark, source)

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    stream.writeStream.option("checkpointLocation", scratch_path(spark, "ck")).foreachBatch(write).trigger(
        availableNow=True
    ).start().awaitTermination()
    stored = spark.read.parquet(out)
    if stored.groupBy("batch_id").count().filter("count <> 100").count():
        raise AssertionError("every micro-batch replays one file")
    return plain(stored.select("session_id", "event_type", "event_time"))
