"""Row-for-row comparison of two designs and order-free digests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from eventloom.functions.aggregates import content_fingerprint


def diff_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows whose multiplicity differs, with how many more ``a`` has.

    One aggregation over both inputs answers both directions, and equal rows
    cancel on the map side.
    """
    columns = a.columns
    tagged = a.withColumn("_side", F.lit(1)).unionByName(b.select(*columns).withColumn("_side", F.lit(-1)))
    return tagged.groupBy(*columns).agg(F.sum("_side").alias("surplus")).filter(F.col("surplus") != 0)


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    return diff_rows(a, b).agg(F.count(F.lit(1)).alias("different_rows")).withColumn(
        "same", F.col("different_rows") == 0
    )


def compare_designs(detail: DataFrame, prepared: DataFrame) -> DataFrame:
    """One row: equality and the group count of each design."""
    columns = detail.columns
    tagged = detail.withColumn("_a", F.lit(1)).withColumn("_b", F.lit(0)).unionByName(
        prepared.select(*columns).withColumn("_a", F.lit(0)).withColumn("_b", F.lit(1))
    )
    merged = tagged.groupBy(*columns).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    zero = F.lit(0).cast("bigint")
    return merged.agg(
        F.coalesce(F.sum("_a"), zero).alias("detail_groups"),
        F.coalesce(F.sum("_b"), zero).alias("prepared_groups"),
        F.coalesce(F.bool_and(F.col("_a") == F.col("_b")), F.lit(True)).alias("same_result"),
    )


def timing_ratio(comparison: DataFrame, detail_ms: float, prepared_ms: float) -> DataFrame:
    """Speed ratio, given only for equal answers."""
    usable = F.col("same_result") & (F.lit(prepared_ms) > 0)
    return comparison.withColumn("ratio", F.when(usable, F.try_divide(F.lit(detail_ms), F.lit(prepared_ms))))


def fingerprint(df: DataFrame, *columns: str) -> DataFrame:
    return df.agg(*content_fingerprint(*(columns or df.columns)))


def canonical_check(df: DataFrame, key: str, expected: int) -> DataFrame:
    """Result digest with its group count and key uniqueness."""
    return df.agg(F.count_distinct(key).alias("keys"), *content_fingerprint(*sorted(df.columns))).withColumn(
        "valid", (F.col("rows") == expected) & (F.col("keys") == F.col("rows"))
    )


def labelled_counts(tables: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """One counted row per named table."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows") for name, df in tables]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def physical_vs_logical(df: DataFrame, by: Sequence[str], member: str) -> DataFrame:
    """Stored rows and distinct identities per group; retries make the first greater."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("physical_rows"), F.count_distinct(member).alias("logical_rows")
    )
