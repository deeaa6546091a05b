"""Exact order statistics without gathering a group in one place.

Values are first counted per (group, value). The counts are then dealt out by ranges
of (group, value), so a large group lies in many consecutive ranges. The totals per
range say which range holds a rank; only that range's rows of the group are ordered.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from eventloom.session import stage_once


def values_at_ranks(df: DataFrame, keys: Sequence[str], value: str, ranks: Mapping[str, Column]) -> DataFrame:
    """Value at each named 1-based rank per group; rank columns may use ``n``, the group size.

    Groups with NULL keys are groups like any other; NULL values have no rank.
    """
    keys = list(keys)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    # Written first, as finding the ranges reads the counts once more.
    counts = stage_once(counts, "counts")
    ranged = stage_once(counts.repartitionByRange(*keys, "_v").withColumn("_range", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy(*keys, "_range").agg(F.sum("_c").alias("_c"))
    # One row per range and group here, so at most as many per group as there are ranges.
    group = Window.partitionBy(*(keys or [F.lit(0)]))
    upto = F.sum("_c").over(group.orderBy("_range"))
    wanted = F.array(*[F.struct(F.lit(name).alias("q"), rank.cast("bigint").alias("r")) for name, rank in ranks.items()])
    targets = totals.withColumn("n", F.sum("_c").over(group)).withColumn("_before", upto - F.col("_c"))
    targets = targets.withColumn("_w", F.explode(wanted)).filter(
        (F.col("_w.r") > F.col("_before")) & (F.col("_w.r") <= F.col("_before") + F.col("_c"))
    ).select(
        *[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.col("_range").alias("_at"), "n", F.col("_w.q").alias("_q"),
        (F.col("_w.r") - F.col("_before")).alias("_r"),
    )
    same = F.col("_range") == F.col("_at")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    near = ranged.join(targets, same)
    reached = F.sum("_c").over(Window.partitionBy(*keys, "_range", "_q").orderBy("_v"))
    found = near.withColumn("_upto", reached).filter((F.col("_upto") >= F.col("_r")) & (F.col("_upto") - F.col("_c") < F.col("_r")))
    return found.groupBy(*keys, "n").agg(*[F.max(F.when(F.col("_q") == name, F.col("_v"))).alias(name) for name in ranks])


def quantile_exact(df: DataFrame, keys: Sequence[str], value: str, p: float = 0.5, name: str = "quantile") -> DataFrame:
    """Element at 0-based position ``floor(p * n)`` of the sorted group."""
    n = F.col("n")
    return values_at_ranks(df, keys, value, {name: F.least(F.floor(n * F.lit(p)) + 1, n)})


def nearest_rank(df: DataFrame, keys: Sequence[str], value: str, levels: Mapping[str, float]) -> DataFrame:
    """Smallest value with at least a share ``p`` of the group at or below it."""
    n = F.col("n")
    return values_at_ranks(
        df, keys, value, {name: F.greatest(F.ceil(n * F.lit(p)), F.lit(1)) for name, p in levels.items()}
    )


def median(df: DataFrame, keys: Sequence[str], value: str, name: str = "median") -> DataFrame:
    """Middle value, or the mean of the two middle values."""
    n = F.col("n")
    both = values_at_ranks(df, keys, value, {"_low": F.floor((n + 1) / 2), "_high": F.floor(n / 2) + 1})
    return both.withColumn(name, (F.col("_low") + F.col("_high")).cast("double") / 2).drop("_low", "_high")
