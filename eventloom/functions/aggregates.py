"""Aggregate expressions shared by the reports."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def count_rows(name: str = "rows") -> Column:
    return F.count(F.lit(1)).alias(name)


def sum_if(value: Column, condition: Column) -> Column:
    """Conditional sum, 0 when nothing matches."""
    return F.coalesce(F.sum(F.when(condition, value)), F.lit(0).cast("bigint"))


def avg_if(value: Column, condition: Column) -> Column:
    """Conditional mean, NULL when nothing matches."""
    return F.avg(F.when(condition, value))


def distinct_if(value: Column, condition: Column) -> Column:
    return F.count_distinct(F.when(condition, value))


def any_or_default(value: Column, order: Column, default: object) -> Column:
    """Some value of the group, the earliest by ``order`` so that reruns agree."""
    return F.coalesce(F.min_by(value, order), F.lit(default))


def any_if(value: Column, order: Column, condition: Column, default: object = "") -> Column:
    return F.coalesce(F.min_by(value, F.when(condition, order)), F.lit(default))


def flag(condition: Column) -> Column:
    """Whether any row of the group matches; unknown counts as no."""
    return F.coalesce(F.bool_or(condition), F.lit(False))


def content_fingerprint(*columns: Column | str) -> list[Column]:
    """Order-free digest of a row set.

    XOR alone cancels equal pairs, so the digest carries the row count and an
    additive hash as well.
    """
    row_hash = F.xxhash64(*columns)
    return [
        F.count(F.lit(1)).alias("rows"),
        F.bit_xor(row_hash).alias("xor_hash"),
        F.sum(row_hash.cast("decimal(38,0)")).alias("sum_hash"),
    ]


def portable_fingerprint(*columns: Column | str) -> list[Column]:
    """Order-free digest that any engine with MD5 can repeat: rows, and the XOR and sum of the first 60 digest bits."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit("\\N")) for c in columns])
    bits = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")
    return [
        F.count(F.lit(1)).alias("rows"), F.bit_xor(bits).alias("xor_bits"), F.sum(bits.cast("decimal(38,0)")).cast("string").alias("sum_bits"),
    ]
