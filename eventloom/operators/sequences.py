"""Neighbouring rows, continuity and travelled distance.

Long sequences are cut into slots: neighbours inside a slot come from a window
over (key, slot), and only one edge row per slot is compared across slots. A key
with a third of all rows spreads over its slots.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from eventloom.functions.scalars import metres_between
from eventloom.operators.scans import running


def with_previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], carry: Sequence[str], slot: Column, name: str = "previous"
) -> DataFrame:
    """Attach the preceding row's ``carry`` columns as a struct, NULL for the first row.

    ``slot`` must not decrease along ``order``; keys must not be NULL.
    """
    pieces = df.withColumn("_slot", slot)
    inside = Window.partitionBy(*keys, "_slot").orderBy(*order)
    rows = pieces.withColumn("_inside", F.lag(F.struct(*carry)).over(inside))
    edges = pieces.groupBy(*keys, "_slot").agg(F.max_by(F.struct(*carry), F.struct(*order)).alias("_edge"))
    across = Window.partitionBy(*keys).orderBy("_slot")
    edges = edges.withColumn("_edge", F.lag("_edge").over(across))
    return rows.join(edges, [*keys, "_slot"], "left").withColumn(
        name, F.coalesce("_inside", "_edge")
    ).drop("_inside", "_edge", "_slot")


def gaps(df: DataFrame, keys: Sequence[str], number: str) -> DataFrame:
    """Missing stretches of an integer sequence per key; keys must not be NULL, a NULL number is no number.

    Numbers that follow one another differ from their rank by the same amount, so each unbroken stretch is one group;
    a gap lies between the stretch that ends at a rank and the one that starts at the next. Ranks come from running
    totals over ranges, so neither a table without keys nor a key with most rows meets in one task.
    """
    distinct = df.select(*keys, F.col(number).cast("bigint").alias("_number")).filter("_number IS NOT NULL").distinct()
    ranked = running(distinct.withColumn("_one", F.lit(1).cast("bigint")), list(keys), ["_number"], [*keys, "_number"], {"_rank": "_one"})
    stretches = ranked.groupBy(*keys, (F.col("_number") - F.col("_rank")).alias("_stretch")).agg(
        F.min("_number").alias("_low"), F.max("_number").alias("_high"), F.min("_rank").alias("_first"), F.max("_rank").alias("_last"),
    )
    before = stretches.select(*keys, (F.col("_last") + 1).alias("_first"), (F.col("_high") + 1).alias("gap_start"))
    return stretches.join(before, [*keys, "_first"]).select(
        *keys, "gap_start", (F.col("_low") - 1).alias("gap_end"), (F.col("_low") - F.col("gap_start")).alias("missing"),
    )


def continuity(df: DataFrame, keys: Sequence[str], number: str, first_allowed: Sequence[int] = (1, 2)) -> DataFrame:
    """Whether stored row numbers form an unbroken, unrepeated prefix."""
    stats = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct(number).alias("distinct_rows"),
        F.min(number).alias("first_row"),
        F.max(number).alias("last_row"),
    )
    whole = (
        (F.col("rows") == F.col("distinct_rows"))
        & (F.col("rows") == F.col("last_row") - F.col("first_row") + 1)
        & F.col("first_row").isin(*first_allowed)
    )
    return stats.withColumn("continuous", F.coalesce(whole, F.lit(False)))


def path_length(positions: DataFrame, keys: Sequence[str], slot_seconds: int = 3600) -> DataFrame:
    """Metres travelled per key along consecutive GPS samples."""
    slot = F.floor(F.unix_seconds("event_time") / F.lit(slot_seconds))
    steps = with_previous(positions, keys, ["event_time", "event_id"], ["latitude", "longitude"], slot)
    metres = metres_between(
        F.col("previous.latitude"), F.col("previous.longitude"), F.col("latitude"), F.col("longitude")
    )
    return steps.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("positions"), F.coalesce(F.sum(metres), F.lit(0.0)).alias("metres")
    )
