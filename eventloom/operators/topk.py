"""Limits, rankings and fixed axes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def limit_by(df: DataFrame, n: int, by: Sequence[Column], order: Sequence[Column]) -> DataFrame:
    """The first ``n`` rows of each group.

    Each map task keeps at most ``n`` rows per group before the shuffle, so a
    group of any size reaches its final task already cut down.
    """
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def top_k(counts: DataFrame, value: str, k: int, *labels: str) -> DataFrame:
    """Greatest values first, ties by label."""
    return counts.orderBy(F.desc(value), *[F.asc(c) for c in labels]).limit(k)


def latest_chronological(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The newest ``n`` rows, shown oldest first."""
    newest = df.orderBy(*[F.desc(c) for c in order]).limit(n)
    return newest.orderBy(*[F.asc(c) for c in order])


def limited(df: DataFrame, n: int, *order: Column | str) -> tuple[DataFrame, DataFrame]:
    """First ``n`` rows, and the exact number of groups with whether rows were left out."""
    totals = df.agg(F.count(F.lit(1)).alias("groups")).withColumn("truncated", F.col("groups") > n)
    return df.orderBy(*order).limit(n), totals


def hour_axis(counts: DataFrame, hour: str, value: str) -> DataFrame:
    """All 24 hours, 0 where nothing happened."""
    axis = counts.sparkSession.range(24).select(F.col("id").cast("int").alias(hour))
    # One row per hour on both sides.
    return axis.join(counts.withColumn(hour, F.col(hour).cast("int")), hour, "left").select(
        hour, F.coalesce(F.col(value), F.lit(0).cast("bigint")).alias(value)
    )
