"""Table layout on disk, staged publishing, partition replacement and load audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from eventloom import schemas
from eventloom.functions.scalars import month_key, plus_days
from eventloom.operators.sequences import continuity
from eventloom.paths import path_exists, rename


def conform(df: DataFrame, table: str) -> DataFrame:
    """Columns of the table in order; columns added later are NULL in older data."""
    known = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in known else F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.schema(table)
    ])


def write_table(df: DataFrame, table: str, path: str, partitions: int | None = None, mode: str = "append") -> None:
    """Month folders with rows in key order.

    Ranges follow (month, key), not the month alone: a month with most of the data
    is spread over many tasks and files, and each file covers a narrow key range
    that row-group statistics can skip.
    """
    out = conform(df, table)
    order = schemas.KEYS.get(table) or [schemas.MONTH_COLUMN[table]]
    order = [c for c in order if c in out.columns]
    if table in schemas.MONTH_COLUMN:
        out = out.withColumn("event_month", month_key(schemas.MONTH_COLUMN[table]))
        order = ["event_month", *order]
    # Copies with one and the same key still spread, by the task that read them.
    spread = out.withColumn("_task", F.spark_partition_id())
    ranges = [*order, "_task"]
    ranged = spread.repartitionByRange(partitions, *ranges) if partitions else spread.repartitionByRange(*ranges)
    writer = ranged.drop("_task").sortWithinPartitions(*order).write.mode(mode).option("partitionOverwriteMode", "dynamic")
    if table in schemas.MONTH_COLUMN:
        writer = writer.partitionBy("event_month")
    writer.parquet(path)


def read_table(spark: SparkSession, table: str, path: str) -> DataFrame:
    ddl = schemas.TABLES[table]
    if table in schemas.MONTH_COLUMN:
        ddl += ", event_month INT"
    return spark.read.schema(ddl).parquet(path)


def between_dates(df: DataFrame, column: str, start: str, end: str) -> DataFrame:
    """Date range, with the month predicate that lets whole folders be skipped."""
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    out = df.filter((F.col(column) >= first) & (F.col(column) < F.date_add(last, 1)))
    if "event_month" in df.columns:
        out = out.filter(F.col("event_month").between(month_key(first), month_key(last)))
    return out


def replace_month(df: DataFrame, table: str, path: str, month: int) -> None:
    """Reload one month; other months stay as they are."""
    column = schemas.MONTH_COLUMN[table]
    write_table(df.filter(month_key(column) == month), table, path, mode="overwrite")


def staged_publish(df: DataFrame, staging: str, target: str, source_id: str, expected_rows: int) -> str:
    """Load one source aside, check its row count, then move it into place.

    Returns ``published`` or, when this source is already there, ``skipped``.
    """
    spark = df.sparkSession
    final = f"{target}/source_id={source_id}"
    if path_exists(spark, final):
        return "skipped"
    staged = f"{staging}/source_id={source_id}"
    df.drop("source_id").write.mode("overwrite").parquet(staged)
    found = spark.read.parquet(staged).count()
    if found != expected_rows:
        raise ValueError(f"Staged {found} rows, read {expected_rows}; nothing was published.")
    if not rename(spark, staged, final):
        raise FileExistsError(final)
    return "published"


def resume_point(staged: DataFrame, keys: list[str], number: str = "source_row") -> DataFrame:
    """Last row of a proven prefix per source; ``continuous`` must hold to resume after it."""
    return continuity(staged, keys, number)


def resume_after(rows: DataFrame, points: DataFrame, keys: list[str], number: str = "source_row") -> DataFrame:
    """Rows still to load: those after the proven prefix of their source."""
    proven = points.filter("continuous").select(*keys, F.col("last_row").alias("_last"))
    return rows.join(proven, keys, "left").filter(
        F.col("_last").isNull() | (F.col(number) > F.col("_last"))
    ).drop("_last")


def audit_counts(measured: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Expected and measured rows that disagree; empty when the load is complete."""
    tagged = measured.select(*keys, F.col("rows").alias("measured"), F.lit(None).cast("bigint").alias("expected")).unionByName(
        expected.select(*keys, F.lit(None).cast("bigint").alias("measured"), F.col("rows").cast("bigint").alias("expected"))
    )
    merged = tagged.groupBy(*keys).agg(
        F.coalesce(F.sum("measured"), F.lit(0).cast("bigint")).alias("measured"),
        F.coalesce(F.sum("expected"), F.lit(0).cast("bigint")).alias("expected"),
    )
    return merged.filter(F.col("measured") != F.col("expected"))


def scale_copies(
    archive: DataFrame, scenarios: int = 5, session_step: int = 20_000_000, day_step: int = 35
) -> DataFrame:
    """Labelled derived copies: shifted session numbers and times, one scenario each.

    Copies are made row by row inside each task, so nothing is shuffled.
    """
    k = F.col("scenario")
    return archive.withColumn("scenario", F.explode(F.sequence(F.lit(0), F.lit(scenarios - 1)))).select(
        k.cast("smallint").alias("scenario"),
        (F.col("session_id").cast("bigint") + k * F.lit(session_step).cast("bigint")).alias("session_id"),
        "article_id",
        plus_days("event_time", k * day_step).alias("event_time"),
        "event_type",
    )


def write_copies(archive: DataFrame, path: str, scenarios: int = 5) -> None:
    """Store the copies in scenario and month folders, without a shuffle.

    A task that reads a stretch of the archive writes that stretch once per scenario.
    Scenario folders make counts and repairs of one scenario touch nothing else.
    """
    copies = scale_copies(archive, scenarios).withColumn("event_month", month_key("event_time"))
    copies.write.mode("append").partitionBy("scenario", "event_month").parquet(path)


def missing_scenarios(copies: DataFrame, expected_rows: int, scenarios: int = 5) -> DataFrame:
    """State of every scenario: absent, partial or complete."""
    axis = copies.sparkSession.range(scenarios).select(F.col("id").cast("smallint").alias("scenario"))
    counted = copies.groupBy("scenario").agg(F.count(F.lit(1)).alias("rows"))
    rows = F.coalesce(F.col("rows"), F.lit(0).cast("bigint"))
    state = F.when(rows == 0, "absent").when(rows == expected_rows, "complete").otherwise("partial")
    return axis.join(counted, "scenario", "left").select("scenario", rows.alias("rows"), state.alias("state"))


def drop_scenario(df: DataFrame, path: str, scenario: int) -> DataFrame:
    """Remove one scenario from a table partitioned by scenario."""
    from eventloom.operators.versioning import rewrite_partitions

    here: Column = F.col("scenario") == scenario
    return rewrite_partitions(df, path, "scenario", here, here)

