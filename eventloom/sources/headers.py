"""Delimited text whose files each have their own header order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from eventloom.session import stage_once


def read_headed(
    spark: SparkSession, path: str, names: Sequence[str], exact: bool = False, first: str | None = None, **options,
) -> DataFrame:
    """The named columns as text; every file's own header says where they stand.

    A header is a row that holds all ``names``; a byte-order mark does not hide its first name. With ``exact`` it
    holds nothing else, and every row must have as many cells. Otherwise a row may be shorter, but not wider, than
    the first file's header. A file without a header, or a row that breaks this, raises an error. ``first`` also
    returns each row's first cell under that name. Rows and headers meet on the file's path, so files may be split
    among tasks.
    """
    cells = spark.read.csv(path, **options).columns
    odd = "_broken" if exact else "_wider"
    schema = ", ".join(f"`{c}` STRING" for c in [*cells, odd])
    reader = spark.read.schema(schema)
    if exact:
        reader = reader.option("columnNameOfCorruptRecord", odd)
    rows = reader.csv(path, **options).select(F.array(*cells).alias("cells"), odd, F.col("_metadata.file_path").alias("file"))
    shown = F.transform("cells", lambda c: F.regexp_replace(c, "^﻿", ""))
    is_header = F.size(F.array_intersect(shown, F.array(*map(F.lit, names)))) == len(names)
    if exact:
        is_header = is_header & (F.size(F.array_compact("cells")) == len(names))
    marked = rows.withColumn("header", F.coalesce(is_header, F.lit(False)))
    headers = stage_once(marked.groupBy("file").agg(F.first(F.when(F.col("header"), shown), ignorenulls=True).alias("order")), "headers")
    without = headers.filter(F.col("order").isNull()).first()
    if without:
        raise ValueError(f"No header with the columns {list(names)}: {without.file}")
    found = marked.filter(~F.col("header")).join(headers, "file")
    fail = F.raise_error(F.concat(F.lit("A row does not fit its header: "), "file")).cast("string")
    checked = F.when(F.col(odd).isNotNull(), fail).otherwise(F.lit(""))
    found = found.withColumn("checked", checked)
    value = lambda at: F.when(F.col("checked") == "", F.get("cells", at))
    return found.select(
        *([value(F.lit(0)).alias(first)] if first else []),
        *[value(F.array_position("order", n).cast("int") - 1).alias(n) for n in names],
    )
