"""Ordered session funnels within a time window.

A chain that reaches step ``i`` at time ``t`` lies within ``[t - window, t]``, and
starts only move forward in time. Events of one window-wide time bucket therefore
depend on nothing older than the bucket before, and a session can be cut into
(session, bucket) pieces that each see their own bucket and the previous one.
The cut is exact. Together with removing repeated (time, step) pairs it bounds a
piece by the number of distinct timestamps in two windows, however long or busy a
session is.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def window_funnel(
    df: DataFrame,
    session: Sequence[str],
    at: Column,
    steps: Sequence[Column],
    window: int,
    strict: bool = True,
    flags: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Greatest step each session reaches in order within ``window``.

    ``at`` and ``window`` share one integer unit. ``strict`` requires increasing
    times from step to step; otherwise equal times may advance in step order.
    ``flags`` are per-session booleans over all events of the session.
    """
    flags = dict(flags or {})
    n = len(steps)
    matched = F.array_compact(F.array(*[F.when(c, F.lit(i)) for i, c in enumerate(steps, start=1)]))
    rows = df.select(
        *session, at.cast("bigint").alias("_t"), F.explode_outer(matched).alias("_step"),
        *[F.coalesce(c, F.lit(False)).alias(name) for name, c in flags.items()],
    ).withColumn("_t", F.when(F.col("_step").isNotNull(), F.col("_t")))
    # Rows outside the funnel collapse to one per session, repeats to one per (time, step).
    points = rows.groupBy(*session, "_t", "_step").agg(
        F.count(F.lit(1)).alias("_n"), *[F.max(name).alias(name) for name in flags]
    )
    bucket = F.floor(F.col("_t") / F.lit(window)).cast("bigint")
    # The last step starts nothing, so only earlier steps are shown to the next bucket.
    homes = F.when(F.col("_step") < n, F.array(bucket, bucket + 1)).otherwise(F.array(bucket))
    pieces = points.withColumn("_bucket", F.explode(homes))

    earlier = (
        Window.partitionBy(*session, "_bucket").orderBy("_t", "_step").rowsBetween(Window.unboundedPreceding, -1)
    )
    reached = pieces.withColumn("_s1", F.when(F.col("_step") == 1, F.struct(F.col("_t").alias("start"), F.col("_t").alias("last"))))
    for i in range(2, n + 1):
        reached = reached.withColumn("_prev", F.last(f"_s{i - 1}", ignorenulls=True).over(earlier))
        after = F.col("_prev.last") < F.col("_t") if strict else F.col("_prev.last") <= F.col("_t")
        ok = (F.col("_step") == i) & after & (F.col("_t") - F.col("_prev.start") <= window)
        reached = reached.withColumn(
            f"_s{i}", F.when(ok, F.struct(F.col("_prev.start").alias("start"), F.col("_t").alias("last")))
        )
    level = reduce(
        lambda acc, i: F.when(F.col(f"_s{i}").isNotNull(), F.lit(i)).otherwise(acc), range(1, n + 1), F.lit(0)
    )
    return reached.groupBy(*session).agg(
        F.max(level).alias("level"), *[F.max(name).alias(name) for name in flags]
    )


def level_histogram(levels: DataFrame) -> DataFrame:
    return levels.groupBy("level").agg(F.count(F.lit(1)).alias("sessions"))


def funnel_reach(levels: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Sessions that got at least to each step, and their share of the cohort.

    The share is NULL, not 0, when nobody entered the funnel.
    """
    n = len(labels)
    counts = levels.agg(*[F.count_if(F.col("level") >= i).alias(f"_{i}") for i in range(1, n + 1)])
    rows = F.array(*[
        F.struct(F.lit(i).alias("step"), F.lit(label).alias("label"), F.col(f"_{i}").alias("sessions"))
        for i, label in enumerate(labels, start=1)
    ])
    return counts.select(F.col("_1").alias("_cohort"), F.explode(rows).alias("r")).select(
        "r.*",
        F.bround(F.try_divide(F.col("r.sessions") * F.lit(100.0), F.col("_cohort").cast("double")), 2).alias("share_pct"),
    )


def funnel_totals(levels: DataFrame, abandoned: str = "abandoned") -> DataFrame:
    """Cohort, sessions that never entered, and abandonments among the cohort."""
    return levels.agg(
        F.count_if(F.col("level") >= 1).alias("cohort_sessions"),
        F.count_if(F.col("level") == 0).alias("excluded_sessions"),
        F.count_if((F.col("level") > 0) & F.col(abandoned)).alias("abandoned_sessions"),
    )
