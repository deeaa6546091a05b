"""Grouped business metrics: by kind with total, arms and uplift, histograms, conversion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from eventloom.functions.aggregates import any_if, avg_if, flag
from eventloom.functions.scalars import ratio, share_pct


def kinds_with_total(by_kind: DataFrame, kinds: Sequence[str], kind: str = "kind") -> DataFrame:
    """Additive metrics per kind on a fixed list of kinds, 0 where absent, plus ``total``."""
    metrics = [c for c in by_kind.columns if c != kind]
    spark = by_kind.sparkSession
    axis = spark.range(1).select(F.explode(F.array(*[F.lit(k) for k in [*kinds, "total"]])).alias(kind))
    summed = by_kind.rollup(kind).agg(F.grouping(kind).alias("_all"), *[F.sum(m).alias(m) for m in metrics])
    summed = summed.withColumn(kind, F.when(F.col("_all") == 1, "total").otherwise(F.col(kind))).drop("_all")
    joined = axis.join(summed, kind, "left")
    return joined.select(kind, *[F.coalesce(m, F.lit(0).cast("bigint")).alias(m) for m in metrics])


def arm_rates(users: DataFrame) -> DataFrame:
    """Size and outcome rates per experiment arm."""
    return users.groupBy("treatment").agg(
        F.count(F.lit(1)).alias("users"),
        F.avg("exposure").alias("exposure_rate"),
        F.avg("visit").alias("visit_rate"),
        F.avg("conversion").alias("conversion_rate"),
        share_pct(F.sum("conversion"), F.sum("visit")).alias("conversion_after_visit_pct"),
    )


def uplift(users: DataFrame, outcomes: Sequence[str] = ("visit", "conversion")) -> DataFrame:
    """Absolute (percentage points) and relative lift per outcome, NULL without a usable control."""
    aggs = []
    for o in outcomes:
        aggs += [
            avg_if(F.col(o), F.col("treatment") == 1).alias(f"_{o}_1"),
            avg_if(F.col(o), F.col("treatment") == 0).alias(f"_{o}_0"),
        ]
    out = []
    for o in outcomes:
        treated, control = F.col(f"_{o}_1"), F.col(f"_{o}_0")
        out += [
            F.bround((treated - control) * 100, 3).alias(f"uplift_{o}_pp"),
            F.bround((F.try_divide(treated, control) - 1) * 100, 1).alias(f"uplift_{o}_relative_pct"),
        ]
    return users.agg(*aggs).select(*out)


def treated_funnel(users: DataFrame) -> DataFrame:
    """Treated, then shown, then visiting, then buying."""
    treated = F.col("treatment") == 1
    shown = treated & (F.col("exposure") == 1)
    visits = shown & (F.col("visit") == 1)
    return users.agg(
        F.count_if(treated).alias("treated"),
        F.count_if(shown).alias("exposed"),
        F.count_if(visits).alias("visited"),
        F.count_if(visits & (F.col("conversion") == 1)).alias("purchased"),
    )


# --- fixed values: click-depth labels and their upper bounds -------------------------------
DEPTH_BUCKETS = [("0", 0), ("1", 1), ("2–3", 3), ("4–6", 6), ("7–10", 10), ("11+", None)]


def depth_bucket(clicks: Column) -> Column:
    out = F.lit(DEPTH_BUCKETS[-1][0])
    for label, upper in reversed(DEPTH_BUCKETS[:-1]):
        out = F.when(clicks <= upper, label).otherwise(out)
    return out


def depth_histogram(orders: DataFrame, click_summary: DataFrame) -> DataFrame:
    """Orders per click depth; bucket 0 is what the summary does not cover."""
    covered = click_summary.groupBy(depth_bucket(F.col("click_count")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    total = orders.agg(F.lit("0").alias("bucket"), F.count(F.lit(1)).alias("n"))
    rest = covered.agg(F.lit("0").alias("bucket"), (-F.coalesce(F.sum("n"), F.lit(0))).alias("n"))
    axis = orders.sparkSession.range(1).select(F.explode(F.array(*[F.lit(b) for b, _ in DEPTH_BUCKETS])).alias("bucket"))
    parts = covered.unionByName(total).unionByName(rest).groupBy("bucket").agg(F.sum("n").alias("orders"))
    return axis.join(parts, "bucket", "left").select("bucket", F.coalesce("orders", F.lit(0).cast("bigint")).alias("orders"))


def search_conversion(events: DataFrame) -> DataFrame:
    """Per search term: sessions that searched it and the share that ordered."""
    sessions = events.groupBy("session_id").agg(
        any_if(F.col("busqueda"), F.struct("ts", "event_id"), F.col("seccion") == "busqueda").alias("busqueda"),
        flag(F.col("seccion") == "pedido").alias("ordered"),
    ).filter(F.col("busqueda") != "")
    return sessions.groupBy("busqueda").agg(
        F.count(F.lit(1)).alias("searching_sessions"), F.count_if("ordered").alias("ordering_sessions")
    ).withColumn("conversion_pct", share_pct(F.col("ordering_sessions"), F.col("searching_sessions"), 1))


def positive_rate(samples: DataFrame, by: Sequence[str]) -> DataFrame:
    return samples.groupBy(*by).agg(
        F.count(F.lit(1)).alias("samples"), F.sum("clicked").cast("bigint").alias("clicks")
    ).withColumn("positive_pct", ratio(F.col("clicks"), F.col("samples"), 2, 100.0))


def active_members(
    df: DataFrame, by: Sequence[str], member: str, conditions: dict[str, Column], total: str
) -> DataFrame:
    """Distinct members per group, in total and under each condition.

    Reducing to one row per (group, member) with flags replaces several distinct
    counts, which would copy every input row once per condition.
    """
    pairs = df.groupBy(*by, member)
    members = pairs.agg(*[flag(c).alias(n) for n, c in conditions.items()]) if conditions else pairs.count()
    return members.groupBy(*by).agg(
        F.count(member).alias(total), *[F.count_if(F.col(name) & F.col(member).isNotNull()).alias(name) for name in conditions]
    )
