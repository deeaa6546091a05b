"""Verified run exports: ordered gzip CSV per table, a manifest, and a report over manifests."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType

from eventloom import schemas
from eventloom.operators.compare import same_rows
from eventloom.operators.metrics import active_members
from eventloom.operators.versioning import latest_of, newest_of
from eventloom.paths import child_names, path_exists, rename, write_text
from eventloom.session import scratch_path
from eventloom.sources.inventory import _uri, list_files

TABLES = ["app_events", "customer_activity", "customer_orders", "order_events", "courier_positions"]
DIGEST_BLOCK = 1 << 20


def run_rows(tables: Mapping[str, DataFrame], table: str, run_id: str) -> DataFrame:
    """Logical rows of one run."""
    return newest_of(table, tables[table].filter(F.col("simulation_run_id") == run_id))


def table_stats(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.min("event_time").alias("first_event"), F.max("event_time").alias("last_event")
    )


def _flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, times with milliseconds."""
    out = []
    for field in df.schema:
        column: Column = F.col(field.name)
        if isinstance(field.dataType, ArrayType):
            column = F.to_json(column)
        elif field.dataType.typeName() == "timestamp":
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSS")
        out.append(column.alias(field.name))
    return df.select(*out)


def participants(activity: DataFrame, positions: DataFrame) -> DataFrame:
    """Customers, those with a model decision, model decisions, and couriers of one run."""
    modelled = F.col("decision_mode") == schemas.MODEL_MODE
    people = active_members(activity, [], "customer_id", {"ai_customers": modelled}, "customers")
    decisions = activity.agg(F.count_if(modelled).alias("ai_decisions"))
    couriers = positions.agg(F.count_distinct("courier_id").alias("couriers"))
    parts = people.unionByName(decisions, True).unionByName(couriers, True)
    return parts.agg(*[F.max(c).alias(c) for c in ("customers", "ai_customers", "ai_decisions", "couriers")])


def orders_by_status(order_events: DataFrame) -> DataFrame:
    return latest_of("order_events", order_events).groupBy("status").agg(F.count(F.lit(1)).alias("orders"))


def orders_by_type(customer_orders: DataFrame) -> DataFrame:
    return newest_of("customer_orders", customer_orders).groupBy("decision_mode", "source_kind").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("amount_minor").cast("bigint").alias("amount_minor")
    )


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of each file, read block by block."""
    import hashlib

    from pyarrow import fs

    for batch in batches:
        out = []
        for table, path, size in zip(batch["table_name"], batch["path"], batch["length"]):
            system, name = fs.FileSystem.from_uri(_uri(path))
            digest = hashlib.sha256()
            # The stored bytes, not the unpacked ones.
            with system.open_input_stream(name, compression=None) as stream:
                while block := stream.read(DIGEST_BLOCK):
                    digest.update(block)
            out.append((table, path.rsplit("/", 1)[1], size, digest.hexdigest()))
        yield pd.DataFrame(out, columns=["table_name", "file", "bytes", "sha256"])


def file_digests(spark: SparkSession, folder: str, tables: list[str]) -> DataFrame:
    files = list_files(spark, {t: f"{folder}/{t}" for t in tables}, "*.csv.gz")
    return files.repartition("path").mapInPandas(_digests, "table_name STRING, file STRING, bytes BIGINT, sha256 STRING")


def read_export(spark: SparkSession, folder: str, table: str) -> DataFrame:
    path = f"{folder}/{table}"
    names = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"').columns
    schema = ", ".join(f"`{n}` STRING" for n in names)
    return spark.read.schema(schema).csv(path, header=True, enforceSchema=False, multiLine=True, quote='"', escape='"', mode="FAILFAST")


def _time_text(value: object) -> str | None:
    return None if value is None else value.strftime("%Y-%m-%d %H:%M:%S.%f")[:-3]


def export_run(spark: SparkSession, tables: Mapping[str, DataFrame], run_id: str, out: str) -> dict:
    """Write one run, check what was written, then promote the folder.

    An existing export is verified instead of rewritten. A failed attempt stays in
    its own ``.partial-`` folder and is never reused.
    """
    if path_exists(spark, out):
        return verify_export(spark, out, run_id)
    partial = f"{out}.partial-{scratch_path(spark, 'x').rsplit('-', 1)[1]}"
    summary: dict = {"run_id": run_id, "tables": {}}
    names = [t for t in TABLES if t in tables]
    for name in names:
        logical = run_rows(tables, name, run_id)
        before = table_stats(logical).first()
        if before["rows"] == 0:
            _flat(logical).coalesce(1).write.csv(f"{partial}/{name}", header=True, compression="gzip", escape='"')
        else:
            _flat(logical.sort("event_time", "event_id")).write.csv(
                f"{partial}/{name}", header=True, compression="gzip", escape='"'
            )
        written = read_export(spark, partial, name).agg(
            F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("simulation_run_id").eqNullSafe(run_id)).alias("foreign")
        ).first() if before["rows"] else {"rows": 0, "foreign": 0}
        if written["rows"] != before["rows"] or written["foreign"] or table_stats(logical).first() != before:
            raise ValueError(f"{name}: the export differs or its source changed; kept in {partial}")
        summary["tables"][name] = {
            "rows": before["rows"],
            "first_event": _time_text(before["first_event"]),
            "last_event": _time_text(before["last_event"]),
            "file": name,
        }
    files = file_digests(spark, partial, names).orderBy("table_name", "file").collect()  # one row per export file
    for name in names:
        mine = [f for f in files if f["table_name"] == name]
        summary["tables"][name]["bytes"] = sum(f["bytes"] for f in mine)
        summary["tables"][name]["files"] = [{"file": f["file"], "bytes": f["bytes"], "sha256": f["sha256"]} for f in mine]
    mine = {t: tables[t].filter(F.col("simulation_run_id") == run_id) for t in names}
    if {"customer_activity", "courier_positions"} <= set(names):
        summary["participants"] = participants(
            newest_of("customer_activity", mine["customer_activity"]), mine["courier_positions"]
        ).first().asDict()
    if "order_events" in names:
        rows = orders_by_status(mine["order_events"]).orderBy(F.desc("orders"), "status").collect()  # one per status
        summary["orders_by_status"] = [r.asDict() for r in rows]
    if "customer_orders" in names:
        rows = orders_by_type(mine["customer_orders"]).orderBy(F.desc("orders"), "decision_mode").collect()  # one per type
        summary["orders_by_type"] = [r.asDict() for r in rows]
    write_text(spark, f"{partial}/summary.json", json.dumps(summary, indent=2) + "\n")
    if not rename(spark, partial, out):
        raise FileExistsError(f"{out} appeared during the export; it was not replaced")
    return summary


def read_manifest(spark: SparkSession, folder: str) -> dict:
    return json.loads("\n".join(r.value for r in spark.read.text(f"{folder}/summary.json").collect()))  # one small file


def verify_export(spark: SparkSession, folder: str, run_id: str) -> dict:
    """Reread every file: counts, run, sizes and digests must equal the manifest."""
    summary = read_manifest(spark, folder)
    if summary["run_id"] != run_id:
        raise ValueError(f"{folder}: manifest of another run")
    names = list(summary["tables"])
    expected = [
        (t, f["file"], f["bytes"], f["sha256"]) for t, info in summary["tables"].items() for f in info["files"]
    ]
    listed = spark.createDataFrame(expected, "table_name STRING, file STRING, bytes BIGINT, sha256 STRING")
    if not same_rows(file_digests(spark, folder, names), listed).first()["same"]:
        raise ValueError(f"{folder}: files differ from the manifest")
    for name, info in summary["tables"].items():
        if info["rows"] == 0:
            continue
        found = read_export(spark, folder, name).agg(
            F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("simulation_run_id").eqNullSafe(run_id)).alias("foreign")
        ).first()
        if found["rows"] != info["rows"] or found["foreign"]:
            raise ValueError(f"{folder}/{name}: rows differ from the manifest")
    return summary


_TABLE = "STRUCT<rows: BIGINT, first_event: STRING, last_event: STRING, bytes: BIGINT>"
MANIFEST_SCHEMA = (
    "run_id STRING, tables STRUCT<" + ", ".join(f"{t}: {_TABLE}" for t in TABLES) + ">, "
    "participants STRUCT<customers: BIGINT, ai_customers: BIGINT, ai_decisions: BIGINT, couriers: BIGINT>, "
    "orders_by_status ARRAY<STRUCT<status: STRING, orders: BIGINT>>"
)


def read_manifests(spark: SparkSession, root: str) -> DataFrame:
    """All finished manifests under a folder; partial exports are left out."""
    done = [n for n in child_names(spark, root) if ".partial" not in n and path_exists(spark, f"{root}/{n}/summary.json")]
    paths = [f"{root}/{n}/summary.json" for n in done]
    if not paths:
        return spark.createDataFrame([], MANIFEST_SCHEMA + ", folder STRING")
    raw = spark.read.schema(MANIFEST_SCHEMA).json(paths, multiLine=True)
    return raw.withColumn("folder", F.element_at(F.split(F.input_file_name(), "/"), -2))


def span_text(seconds: Column) -> Column:
    """Rounded to minutes, the way a run table shows it."""
    minutes = F.bround(seconds / 60, 0).cast("bigint")
    hours, rest = F.floor(minutes / 60), minutes % 60
    return (
        F.when(hours > 0, F.format_string("%d h %02d min", hours, rest))
        .when(rest > 0, F.format_string("%d min", rest))
        .otherwise("< 1 min")
    )


def runs_report(manifests: DataFrame) -> DataFrame:
    """One row per run: start, span, participants, rows per table, deliveries, totals."""
    each = F.array(*[
        F.struct(F.lit(t).alias("name"), *[F.col(f"tables.{t}.{c}").alias(c) for c in ("rows", "first_event", "last_event", "bytes")])
        for t in TABLES
    ])
    with_tables = manifests.withColumn("_t", each)
    filled = F.filter("_t", lambda t: t["rows"] > 0)
    total = lambda c: F.aggregate("_t", F.lit(0).cast("bigint"), lambda acc, t: acc + F.coalesce(t[c], F.lit(0)))
    out = with_tables.select(
        "folder",
        "run_id",
        F.array_min(F.transform(filled, lambda t: t["first_event"])).alias("start"),
        F.array_max(F.transform(filled, lambda t: t["last_event"])).alias("end"),
        *[F.coalesce(f"participants.{c}", F.lit(0).cast("bigint")).alias(c) for c in ("customers", "ai_customers", "couriers")],
        *[F.coalesce(f"tables.{t}.rows", F.lit(0).cast("bigint")).alias(t) for t in TABLES],
        F.aggregate(
            F.filter("orders_by_status", lambda s: s["status"] == "delivered"),
            F.lit(0).cast("bigint"), lambda acc, s: acc + s["orders"],
        ).alias("delivered"),
        total("rows").alias("total_rows"),
        total("bytes").alias("total_bytes"),
    )
    stamp = lambda c: F.to_timestamp(F.substring(c, 1, 19), "yyyy-MM-dd HH:mm:ss")
    seconds = F.unix_seconds(stamp("end")) - F.unix_seconds(stamp("start"))
    return out.withColumn("event_span", span_text(seconds)).orderBy("start")
