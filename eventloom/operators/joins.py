"""Enrichment joins. None carries a hint: sizes are measured at run time (AQE)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def any_left_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], order: Column | None = None,
    defaults: Mapping[str, object] | None = None,
) -> DataFrame:
    """Left join that keeps the left row count: one right row per key.

    With ``order`` the earliest right row is taken, otherwise any; ``defaults``
    replace NULL where nothing matched.
    """
    rest = [c for c in right.columns if c not in on]
    if order is None:
        one = right.groupBy(*on).agg(*[F.any_value(c).alias(c) for c in rest])
    else:
        one = right.groupBy(*on).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*on, "_r.*")
    joined = left.join(one, list(on), "left")
    for name, value in (defaults or {}).items():
        joined = joined.withColumn(name, F.coalesce(F.col(name), F.lit(value)))
    return joined


def with_labels(df: DataFrame, dimension: DataFrame, key: str, label: str, name: str) -> DataFrame:
    """Add a display name from a keyed dimension."""
    return df.join(dimension.select(key, F.col(label).alias(name)), key, "left")


def basket_amount(items: Column | str) -> Column:
    """Sum of quantity times unit price over nested basket lines."""
    return F.aggregate(
        items, F.lit(0).cast("bigint"),
        lambda acc, x: acc + x["quantity"].cast("bigint") * x["unit_price_minor"].cast("bigint"),
    )


def link_integrity(purchases: DataFrame, clicks: DataFrame) -> DataFrame:
    """Each purchase against its checkout click: same order, same session, matching amount."""
    c = clicks.select(
        F.col("event_id").alias("checkout_event_id"), F.col("order_id").alias("_order"), F.col("session_id").alias("_session"),
    )
    return purchases.join(c, "checkout_event_id", "left").select(
        "order_id",
        "checkout_event_id",
        F.col("_order").isNotNull().alias("click_found"),
        F.coalesce(F.col("_order") == F.col("order_id"), F.lit(False)).alias("same_order"),
        F.coalesce(F.col("_session") == F.col("session_id"), F.lit(False)).alias("same_session"),
        (F.col("amount_minor") == basket_amount("items")).alias("amount_matches"),
    )


def link_mismatches(purchases: DataFrame, clicks: DataFrame) -> DataFrame:
    ok = F.col("click_found") & F.col("same_order") & F.col("same_session") & F.col("amount_matches")
    return link_integrity(purchases, clicks).filter(~F.coalesce(ok, F.lit(False)))


def daily_overlay(orders: DataFrame, clicks: DataFrame, day: str = "day") -> DataFrame:
    """Days that have orders, with that day's clicks or 0."""
    return orders.join(clicks, day, "left").withColumn("clicks", F.coalesce("clicks", F.lit(0).cast("bigint")))


def coverage(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Whether every expected key was found."""
    return expected.select(key).distinct().join(
        found.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left"
    ).agg(
        F.count(F.lit(1)).alias("expected"),
        F.count("_hit").alias("found"),
    ).withColumn("complete", F.col("expected") == F.col("found"))


def split_by_flag(df: DataFrame, key: str, condition: Column) -> tuple[DataFrame, DataFrame]:
    """Rows whose key has any matching row, and the rows of all other keys."""
    keys = df.filter(condition).select(key).distinct()
    return df.join(keys, key, "left_semi"), df.join(keys, key, "left_anti")
