"""Storage and query-history reports."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from eventloom.functions.scalars import within_last
from eventloom.operators.quantiles import quantile_exact

FOOTER_SCHEMA = (
    "table_name STRING, path STRING, file_bytes BIGINT, rows BIGINT, row_groups BIGINT, "
    "compressed_bytes BIGINT, uncompressed_bytes BIGINT"
)


def _uri(path: str) -> str:
    return path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path


def _footers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Row and byte counts from parquet footers; no data page is read."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    for batch in batches:
        out = []
        for table, path, size in zip(batch["table_name"], batch["path"], batch["length"]):
            system, name = fs.FileSystem.from_uri(_uri(path))
            meta = pq.read_metadata(name, filesystem=system)
            groups = [meta.row_group(i) for i in range(meta.num_row_groups)]
            columns = [g.column(j) for g in groups for j in range(g.num_columns)]
            out.append((
                table, path, size, meta.num_rows, meta.num_row_groups,
                sum(c.total_compressed_size for c in columns), sum(c.total_uncompressed_size for c in columns),
            ))
        yield pd.DataFrame(
            out, columns=["table_name", "path", "file_bytes", "rows", "row_groups", "compressed_bytes", "uncompressed_bytes"]
        )


def list_files(spark: SparkSession, paths: Mapping[str, str], glob: str = "*.parquet") -> DataFrame:
    """Files per table; listing does not open them."""
    parts = [
        spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
        .select(F.lit(table).alias("table_name"), "path", "length")
        for table, path in paths.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def file_footers(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    files = list_files(spark, paths)
    return files.repartition("path").mapInPandas(_footers, FOOTER_SCHEMA)


def storage_inventory(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """Files, physical rows and bytes per table, with bytes per row."""
    total = lambda c: F.sum(c).alias(c)
    out = file_footers(spark, paths).groupBy("table_name").agg(
        F.count(F.lit(1)).alias("files"), total("row_groups"), F.sum("rows").alias("physical_rows"),
        total("file_bytes"), total("compressed_bytes"), total("uncompressed_bytes"),
    )
    return out.withColumn("bytes_per_row", F.bround(F.try_divide(F.col("file_bytes"), F.col("physical_rows")), 2))


def with_layout(inventory: DataFrame, layout: DataFrame) -> DataFrame:
    """Add engine, sort key and partition key per (database, table)."""
    return inventory.join(layout, ["database", "table_name"], "left")


def query_history(log: DataFrame, as_of: Column, databases: list[str], limit: int = 12) -> DataFrame:
    """Completed selects of the last hour by query family, most recently used first."""
    recent = log.filter(
        (F.col("type") == "QueryFinish")
        & (F.col("is_initial_query") == 1)
        & (F.col("query_kind") == "Select")
        & within_last("event_time", as_of, 3600)
        & F.exists("databases", lambda db: db.isin(databases))
    ).withColumn("source_tables", F.array_join("tables", ", "))
    keys = ["query_family", "source_tables"]
    families = recent.withColumn("query_family", F.col("normalized_query_hash").cast("string"))
    stats = families.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("executions"),
        F.max("query_duration_ms").alias("slowest_ms"),
        F.max("memory_usage").alias("peak_memory_bytes"),
        F.bround(F.avg("read_rows"), 0).alias("average_rows_read"),
        F.max("event_time").alias("last_used"),
    )
    mid = quantile_exact(families, keys, "query_duration_ms", 0.5, "median_ms").drop("n")
    return stats.join(mid, keys, "left").orderBy(F.desc("last_used"), *keys).limit(limit)


def recent_queries(log: DataFrame, text: str, limit: int = 10) -> DataFrame:
    """Latest finished queries that mention ``text``."""
    return log.filter((F.col("type") == "QueryFinish") & F.col("query").ilike(f"%{text}%")).select(
        "event_time", "query_duration_ms", "read_rows", F.substring("query", 1, 80).alias("query")
    ).orderBy(F.desc("event_time"), "query").limit(limit)


def read_event_log(spark: SparkSession, path: str) -> DataFrame:
    """Finished SQL executions from a Spark event log, in the shape of a query log."""
    raw = spark.read.schema(
        "Event STRING, executionId BIGINT, description STRING, physicalPlanDescription STRING, time BIGINT"
    ).json(path)
    ends = F.col("Event").endswith("SparkListenerSQLExecutionEnd")
    starts = F.col("Event").endswith("SparkListenerSQLExecutionStart")
    runs = raw.filter(starts | ends).groupBy(F.input_file_name().alias("application"), "executionId").agg(
        F.max(F.when(starts, F.col("time"))).alias("_start"),
        F.max(F.when(ends, F.col("time"))).alias("_end"),
        F.max(F.when(starts, F.col("description"))).alias("query"),
        F.max(F.when(starts, F.col("physicalPlanDescription"))).alias("_plan"),
    )
    done = runs.filter(F.col("_start").isNotNull() & F.col("_end").isNotNull())
    return done.select(
        F.timestamp_millis("_end").alias("event_time"),
        F.lit("QueryFinish").alias("type"),
        "query",
        F.xxhash64(F.regexp_replace("query", "[0-9]+", "?")).alias("normalized_query_hash"),
        (F.col("_end") - F.col("_start")).alias("query_duration_ms"),
        F.array_distinct(F.regexp_extract_all("_plan", F.lit(r"Location: \w+ \[([^\]]+)\]"), F.lit(1))).alias("tables"),
    )
