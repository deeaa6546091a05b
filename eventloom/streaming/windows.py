"""Windowed counts, the same code on a stream and on a table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from eventloom.functions.scalars import within_last
from eventloom.operators.rollups import write_batch_state


def tumbling_counts(
    df: DataFrame, at: str, width: str, by: Sequence[str] = (), watermark: str | None = None,
    counts: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Rows per fixed window and group. On a stream give a watermark to bound the state."""
    source = df.withWatermark(at, watermark) if watermark else df
    aggs = [F.count(F.lit(1)).alias("events"), *[F.count_if(c).alias(n) for n, c in (counts or {}).items()]]
    out = source.groupBy(F.window(at, width).alias("w"), *by).agg(*aggs)
    return out.select(F.col("w.start").alias("bucket"), *by, "events", *(counts or {}))


def store_window_parts(
    source: DataFrame, path: str, checkpoint: str, at: str, width: str, by: Sequence[str], counts: Mapping[str, Column] | None = None,
) -> StreamingQuery:
    """Drain a stream into additive window counts, one folder per micro-batch.

    Nothing is kept between batches and no watermark is needed, so rows of any age
    count, and a replayed batch replaces its own folder.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch_state(tumbling_counts(batch, at, width, by, counts=counts), path, batch_id)

    return source.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def read_window_parts(parts: DataFrame, by: Sequence[str], counts: Sequence[str] = ()) -> DataFrame:
    """Windows of all batches together."""
    return parts.groupBy("bucket", *by).agg(*[F.sum(c).alias(c) for c in ("events", *counts)])


def sliding_counts(
    df: DataFrame, at: str, width: str, step: str, watermark: str | None = None, counts: Mapping[str, Column] | None = None
) -> DataFrame:
    """Trailing totals refreshed every ``step``."""
    source = df.withWatermark(at, watermark) if watermark else df
    aggs = [F.count(F.lit(1)).alias("events"), *[F.count_if(c).alias(n) for n, c in (counts or {}).items()]]
    out = source.groupBy(F.window(at, width, step).alias("w")).agg(*aggs)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "events", *(counts or {}))


def trailing(df: DataFrame, at: str, as_of: Column, seconds: int) -> DataFrame:
    """Rows of the last ``seconds`` before an explicit clock."""
    return df.filter(within_last(at, as_of, seconds))


def distinct_per_window(df: DataFrame, at: str, width: str, member: str, name: str) -> DataFrame:
    """Exact distinct members per window, for tables."""
    return df.groupBy(F.window(at, width).alias("w")).agg(F.count_distinct(member).alias(name)).select(
        F.col("w.start").alias("bucket"), name
    )
