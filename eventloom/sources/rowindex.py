"""Row positions inside text files, found in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

BROADCAST_SPLITS = 100_000


def with_row_index(df: DataFrame, name: str = "source_row", first: int = 1) -> DataFrame:
    """Number the rows of each input file in file order.

    ``df`` must come straight from a file scan. Each split knows where it starts,
    so per-split row counts give the offsets; no split waits for another one.
    The offsets have one row per split; up to ``BROADCAST_SPLITS`` of them are
    broadcast, so the rows themselves stay where they were read.
    """
    # Every file adds at most one split beyond what fills its read tasks.
    splits_bound = len(df.inputFiles()) + df.rdd.getNumPartitions()
    tagged = df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"),
    )
    splits = tagged.groupBy("_file", "_start").agg(F.min("_id").alias("_base"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    if splits_bound <= BROADCAST_SPLITS:
        offsets = F.broadcast(offsets)
    return (
        tagged.join(offsets, ["_file", "_start"])
        .withColumn(name, F.col("_offset") + F.col("_id") - F.col("_base") + first)
        .drop("_file", "_start", "_id", "_base", "_offset")
    )
