"""Historical replay: original order and times, a new ingest time, a fixed rate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from eventloom.operators.scans import running


def ordered_slice(archive: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` events in time order, numbered from 0 by running totals over ranges of the order."""
    order = ["event_time", "session_id", "event_position"]
    first = archive.orderBy(*order).limit(limit).withColumn("_one", F.lit(1).cast("bigint"))
    numbered = running(first, [], order, archive.columns, {"seq": "_one"})
    return numbered.withColumn("seq", F.col("seq") - 1)


def replay_stream(spark: SparkSession, prepared: DataFrame, rate: int, test_batches: bool = False) -> DataFrame:
    """Stream of the prepared events, ``rate`` per second.

    A rate source counts upward; each count picks the event with that number.
    ``test_batches`` uses the source that emits ``rate`` rows per micro-batch at once.
    """
    if test_batches:
        ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", rate).option("numPartitions", 1).load()
    else:
        ticks = spark.readStream.format("rate").option("rowsPerSecond", rate).load()
    return ticks.select(F.col("value").alias("seq")).join(prepared, "seq").drop("seq").withColumn(
        "ingested_at", F.current_timestamp()
    )


def write_replay_files(prepared: DataFrame, path: str, rows_per_file: int) -> None:
    """The prepared slice as consecutive files; one task writes them so that their times follow the order."""
    prepared.coalesce(1).sortWithinPartitions("seq").write.option("maxRecordsPerFile", rows_per_file).parquet(path)


def replay_files(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Stream of prepared files, some per micro-batch; it ends with the last file under ``availableNow``."""
    schema = spark.read.parquet(path).schema
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return files.withColumn("ingested_at", F.current_timestamp())


def start_replay(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).start()
