"""Micro-batch ingest: contracts, idempotent acceptance, routed appends, incremental states.

Every output of a batch lies in a folder named by its batch id, and a replayed
batch overwrites exactly those folders. A failure after some of the tables were
written is therefore repaired by the replay, without a transaction across tables.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from eventloom import schemas
from eventloom.functions.scalars import month_key
from eventloom.operators.contracts import (
    named_items, parse_app_events, parse_telemetry, request_summary, settle_requests, with_digest,
)
from eventloom.operators.rollups import id_rollup, write_batch_state
from eventloom.operators.versioning import partial_state
from eventloom.paths import table_exists, write_text
from eventloom.session import passing_stages, stage_once

#: The ledger lies in folders by a hash of the identity, so that a batch reads only those its identities fall in.
LEDGER_BUCKETS = 64
LEDGER_SCHEMA = "event_id STRING, digest STRING, bucket INT, batch_id BIGINT"
ROLLUP_KEYS = ["source_kind", "event_date", "city_id", "section", "event_type"]


@dataclass(frozen=True)
class Lake:
    """Folder layout of the ingest outputs."""

    root: str

    def table(self, name: str) -> str:
        return f"{self.root}/tables/{name}"

    def state(self, name: str) -> str:
        return f"{self.root}/states/{name}"

    @property
    def ledger(self) -> str:
        return f"{self.root}/ledger"

    @property
    def quarantine(self) -> str:
        return f"{self.root}/quarantine"

    @property
    def metrics(self) -> str:
        return f"{self.root}/metrics"

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        path = self.table(name)
        if not table_exists(spark, path):
            return spark.createDataFrame([], schemas.schema(name))
        ddl = schemas.TABLES[name] + ", event_month INT, batch_id BIGINT"
        return spark.read.schema(ddl).parquet(path).drop("batch_id")

    def read_batch(self, spark: SparkSession, name: str, batch_id: int) -> DataFrame:
        """Rows that one batch stored in a table."""
        ddl = schemas.TABLES[name] + ", event_month INT, batch_id BIGINT"
        rows = spark.read.schema(ddl).parquet(self.table(name)).filter(F.col("batch_id") == batch_id)
        return rows.select(*schemas.schema(name).fieldNames())

    def clock(self, batch_id: int) -> str:
        return f"{self.root}/clocks/{batch_id}"

    def read_ledger(self, spark: SparkSession) -> DataFrame:
        if not table_exists(spark, self.ledger):
            # Seen to be empty when planned, so that a first batch is not dealt to meet it.
            return spark.range(1).filter(F.lit(False)).select(F.from_json(F.lit(None), LEDGER_SCHEMA).alias("_row")).select("_row.*")
        return spark.read.schema(LEDGER_SCHEMA).parquet(self.ledger)


def _write_batch(df: DataFrame, path: str, batch_id: int, partitions: Sequence[str] = (), order: Sequence[str] = ()) -> None:
    """Store a batch under its id; each partition's rows lie together, in the given order, so that readers can skip."""
    rows = df.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
    if partitions:
        rows = rows.hint("rebalance", *[F.col(p) for p in partitions])
    if order:
        rows = rows.sortWithinPartitions(*partitions, *order)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions, "batch_id").parquet(
        path, compression="zstd"
    )


def ledger_bucket(event_id: Column | str) -> Column:
    return F.pmod(F.xxhash64(event_id), F.lit(LEDGER_BUCKETS)).cast("int")


def batch_clock(spark: SparkSession, lake: Lake, batch_id: int) -> datetime:
    """The batch's one clock: written before its first use, so a replay decides by the same time."""
    path = lake.clock(batch_id)
    if not table_exists(spark, path):
        now = datetime.now(timezone.utc)
        write_text(spark, path, now.replace(microsecond=now.microsecond // 1000 * 1000).isoformat())
    return datetime.fromisoformat(spark.read.text(path).first().value)


def _internal_rows(df: DataFrame, stream: str, payload: str) -> DataFrame:
    """Streams produced inside the platform: typed by their table, ids required."""
    fields = schemas.schema(stream).fields
    if stream == "customer_orders":
        ddl = ", ".join(
            f"items ARRAY<ARRAY<STRING>>" if f.name == "items" else f"{f.name} {f.dataType.simpleString()}" for f in fields
        )
        # Lines arrive as positional triples or as objects.
        flat = F.from_json(payload, ddl)
        nested = F.from_json(payload, schemas.schema(stream))
        triples = F.array_size(F.coalesce(flat["items"], F.array())) > 0
        row = F.struct(*[
            (F.when(triples, named_items(flat["items"])).otherwise(nested["items"]) if f.name == "items" else nested[f.name]).alias(f.name)
            for f in fields
        ])
    else:
        row = F.from_json(payload, schemas.schema(stream))
    kept = [payload, *(["request"] if "request" in df.columns else [])]
    parsed = df.select(*kept, row.alias("_row")).select(*kept, "_row.*")
    missing = F.array(*[F.when(F.col(c).isNull(), F.lit(f"missing:{c}")) for c in ("event_id", "simulation_run_id", "event_time")])
    return parsed.withColumn("reasons", F.array_compact(missing))


def parse_stream(df: DataFrame, stream: str, as_of: Column, payload: str = "payload") -> DataFrame:
    """Typed rows of one stream plus ``reasons``."""
    if stream == "app_events":
        return parse_app_events(df, as_of, payload)
    if stream in ("courier_positions", "order_events"):
        return parse_telemetry(df, stream, as_of, payload)
    return _internal_rows(df, stream, payload)


def route(batch: DataFrame, payload: str = "value") -> DataFrame:
    """Add the target stream and the payload without its routing field.

    An unknown route stops the batch; browsing events need no route.
    """
    # Only a text that holds the field's name, plain or escaped, can name a route.
    named = F.contains(payload, F.lit("_stream")) | F.contains(payload, F.lit("\\"))
    stream = F.coalesce(F.when(named, F.get_json_object(payload, "$._stream")), F.lit("app_events"))
    known = F.when(stream.isin(schemas.STREAMS), stream).otherwise(
        F.raise_error(F.concat(F.lit("Unknown publishing route: "), stream)).cast("string")
    )
    # The routing field is the only one dropped; the rest of the text stays as received.
    cut = F.regexp_replace(payload, r'"_stream"\s*:\s*"[a-z_]*"\s*,\s*|,\s*"_stream"\s*:\s*"[a-z_]*"', "")
    plain = F.when(F.contains(payload, F.lit('"_stream"')), cut).otherwise(F.col(payload))
    extra = ["request"] if "request" in batch.columns else []
    return batch.select(known.alias("stream"), plain.alias("payload"), *extra)


def ingest_batch(batch: DataFrame, batch_id: int, lake: Lake, as_of: Column | None = None) -> dict:
    """Accept one micro-batch of JSON lines in ``value``; returns its counters.

    Rows of one ``request`` (a text that sorts in the order of arrival; without that column all rows are one
    request) are accepted or rejected together: a conflict, the same identity with other content, sends its
    request to quarantine, and no other. What is stored doesn't depend on how many requests a micro-batch holds.
    """
    with passing_stages(batch.sparkSession):
        return _accept(batch, batch_id, lake, as_of)


def _accept(batch: DataFrame, batch_id: int, lake: Lake, as_of: Column | None) -> dict:
    spark = batch.sparkSession
    clock = F.lit(batch_clock(spark, lake, batch_id))
    as_of = clock if as_of is None else as_of
    if "request" not in batch.columns:
        batch = batch.withColumn("request", F.lit(""))
    routed = route(batch)
    present = {r[0] for r in routed.select("stream").distinct().collect()}  # at most one per table
    parsed = []
    for stream in sorted(present) or schemas.STREAMS[:1]:
        mine = routed if present == {stream} else routed.filter(F.col("stream") == stream)
        rows = parse_stream(mine, stream, as_of)
        data = [c for c in rows.columns if c not in ("payload", "request", "reasons")]
        digested = with_digest(rows, data, text="row")
        fine = F.size("reasons") == 0
        # Good rows go on as their typed content, the others as the text they came as.
        parsed.append(digested.select(
            F.lit(stream).alias("stream"), "request", F.when(fine, F.col("event_id")).alias("event_id"), F.when(fine, F.col("digest")).alias("digest"),
            "reasons", F.when(~fine, F.col("payload")).alias("payload"), F.when(fine, F.col("row")).alias("row"),
        ))
    stamped = stage_once(reduce(DataFrame.unionByName, parsed).withColumn("ingested_at", clock), "stamped", compression="zstd")
    bad = stamped.filter(F.size("reasons") > 0)
    good = stamped.filter(F.size("reasons") == 0).drop("reasons", "payload")
    ledger = lake.read_ledger(spark)
    if table_exists(spark, lake.ledger):
        touched = [r[0] for r in good.select(ledger_bucket("event_id").alias("b")).distinct().collect()]  # at most LEDGER_BUCKETS
        ledger = ledger.filter(F.col("bucket").isin(touched) & (F.col("batch_id") != batch_id))
    # Digests are compared in 32 bytes; the stored ledger keeps their text.
    digest = F.unhex("digest").alias("digest")
    settled = settle_requests(good.select("request", "event_id", digest), ledger.select("event_id", digest))
    counters = request_summary(settled).first().asDict()
    stored = settled_rows(good, settled)
    refused = stored.filter(F.col("status").isin("conflict", "rejected"))
    _write_batch(
        bad.select("stream", "payload", "reasons", "ingested_at").unionByName(refused.select(
            "stream", F.col("row").alias("payload"),
            F.when(F.col("status") == "conflict", F.array(F.lit("conflicting_content"))).otherwise(F.array(F.lit("batch_rejected"))).alias("reasons"),
            "ingested_at",
        )), lake.quarantine, batch_id,
    )
    counters["invalid"] = bad.count()
    if counters["accepted"]:
        publish(stored.filter(F.col("status") == "new"), sorted(present), batch_id, lake)
        # The ledger comes last: what it holds is stored.
        new = settled.filter(F.col("status") == "new").select(
            "event_id", F.lower(F.hex("digest")).alias("digest"), ledger_bucket("event_id").alias("bucket")
        )
        _write_batch(new, lake.ledger, batch_id, ["bucket"], ["event_id"])
    _write_batch(spark.createDataFrame([counters], "received BIGINT, accepted BIGINT, duplicates BIGINT, conflicts BIGINT, state STRING, invalid BIGINT"), lake.metrics, batch_id)
    return counters


def settled_rows(rows: DataFrame, settled: DataFrame) -> DataFrame:
    """Whole rows of what is to be stored, accepted or refused, each identity of a request once, with its status.

    Requests that bring nothing but duplicates are left out, and requests of nothing but new identities, each
    given once, are taken as they are; only the rest is matched with its statuses row by row.
    """
    fresh = F.col("status") == "new"
    requests = stage_once(settled.groupBy("request").agg(
        F.bool_and(fresh & (F.col("copies") == 1)).alias("_whole"), F.bool_or(F.col("status") != "duplicate").alias("_any"),
    ).filter("_any").drop("_any"), "requests")
    rows = rows.join(requests, "request")
    whole = rows.filter("_whole").drop("_whole").withColumn("status", F.lit("new"))
    if requests.filter("NOT _whole").isEmpty():
        return whole
    wanted = settled.filter(F.col("status") != "duplicate").join(requests.filter("NOT _whole"), "request", "left_semi")
    wanted = wanted.select("request", "event_id", F.col("digest").alias("_digest"), "status")
    matched = rows.filter("NOT _whole").drop("_whole").join(wanted, ["request", "event_id"]).filter("unhex(digest) = _digest").drop("_digest")
    matched = stage_once(matched.dropDuplicates(["request", "event_id"]), "matched", compression="zstd")
    return whole.unionByName(matched)


def publish(accepted: DataFrame, streams: Sequence[str], batch_id: int, lake: Lake) -> None:
    """Append accepted rows to their tables and, from there, to the states."""
    for stream in streams:
        rows = accepted.filter(F.col("stream") == stream).select(
            F.from_json("row", schemas.schema(stream)).alias("_row"), "ingested_at"
        )
        names = schemas.schema(stream).fieldNames()
        typed = rows.select(*[
            F.col("ingested_at") if c == "ingested_at" else F.to_date("_row.event_time").alias(c) if c == "event_date"
            else F.col(f"_row.{c}").alias(c) for c in names
        ])
        _write_batch(typed.withColumn("event_month", month_key("event_time")), lake.table(stream), batch_id, ["event_month"], schemas.KEYS[stream])
        update_states(stream, lake.read_batch(typed.sparkSession, stream, batch_id), batch_id, lake)


def update_states(stream: str, rows: DataFrame, batch_id: int, lake: Lake) -> None:
    """Partial states of one batch; readers merge them."""
    if stream == "app_events":
        write_batch_state(id_rollup(rows, ROLLUP_KEYS, "event_id"), lake.state("app_daily_rollup"), batch_id)
    if stream in schemas.LATEST_KEYS:
        state = partial_state(rows, schemas.LATEST_KEYS[stream], schemas.LATEST_PAYLOAD[stream])
        write_batch_state(state, lake.state(f"{stream}_latest"), batch_id)


def start_ingest(
    spark: SparkSession, source: str, lake: Lake, checkpoint: str, files_per_trigger: int = 100,
    interval: str | None = "1 second",
) -> StreamingQuery:
    """Ingest JSON lines from a folder; ``interval=None`` drains what is there and stops.

    A file is one request, taken in the order of writing. Files per trigger bound how much one micro-batch may
    hold; they don't change what is stored.
    """
    arrival = F.concat_ws("|", F.date_format("_metadata.file_modification_time", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.col("_metadata.file_path"))
    stream = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(source).select("value", arrival.alias("request"))
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, batch_id: ingest_batch(batch, batch_id, lake) and None
    )
    trigger = {"availableNow": True} if interval is None else {"processingTime": interval}
    return writer.trigger(**trigger).start()


def _fold(spark: SparkSession, path: str, ddl: str, through: int, part: str, wanted: Column | None = None) -> None:
    """Merge the batch folders up to ``through`` into the folder of ``through``, per value of ``part``.

    The merged rows are staged first; then they replace the last folder, and the
    folders they came from are emptied. Run it between micro-batches and only over
    committed batches. If it is interrupted between these steps, rows appear twice,
    which logical reads and the ledger join ignore.
    """
    old = spark.read.schema(f"{ddl}, {part} INT, batch_id BIGINT").parquet(path).filter(F.col("batch_id") <= through)
    if wanted is not None:
        old = old.filter(wanted)
    folded = stage_once(old.drop("batch_id"), "compact")
    emptied = old.filter(F.col("batch_id") != through).select(part, "batch_id").distinct().collect()  # one per folder
    _write_batch(folded, path, through, [part])
    empty = folded.drop(part).limit(0)
    for value, batch_id in emptied:
        empty.write.mode("overwrite").parquet(f"{path}/{part}={value}/batch_id={batch_id}")


def compact_table(spark: SparkSession, lake: Lake, stream: str, month: int, through: int) -> None:
    """Fold one month of a table; rows keep their content."""
    _fold(spark, lake.table(stream), schemas.TABLES[stream], through, "event_month", F.col("event_month") == month)


def compact_ledger(spark: SparkSession, lake: Lake, through: int) -> None:
    """Fold the accepted identities of many small batches."""
    _fold(spark, lake.ledger, "event_id STRING, digest STRING", through, "bucket")


def append_live_clicks(clicks: DataFrame) -> DataFrame:
    """Live clicks of the page with their default identity and time."""
    ok = F.col("section").isin("inicio", "productos", "cesta") & F.col("action").isin("abrir", "explorar", "anadir")
    return clicks.filter(ok).select(
        F.uuid().alias("click_id"), F.date_trunc("MILLISECOND", F.current_timestamp()).alias("clicked_at"), "section", "action"
    )


def stream_rollups(
    source: DataFrame, path: str, checkpoint: str, keys: Sequence[str], member: str
) -> StreamingQuery:
    """Maintain additive, exact-ID and HLL rollups of a stream until its input is drained."""
    from eventloom.operators.rollups import hll_rollup, sum_rollup

    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch_state(sum_rollup(batch, keys), f"{path}/sum", batch_id)
        write_batch_state(id_rollup(batch, keys, member), f"{path}/ids", batch_id)
        write_batch_state(hll_rollup(batch, keys, member), f"{path}/hll", batch_id)

    return source.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def stream_latest(
    source: DataFrame, path: str, checkpoint: str, keys: Sequence[str], payload: Sequence[str], weight: Sequence[str]
) -> StreamingQuery:
    """Maintain latest state per entity until the input is drained."""
    return source.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, batch_id: write_batch_state(partial_state(batch, keys, payload, weight), path, batch_id) and None
    ).trigger(availableNow=True).start()
