"""Newest version per key, latest state per entity, and row corrections.

Every merge is ``max_by`` over an explicit weight, so partial results combine on
the map side: a key that holds a third of all rows shrinks to one row per map
task before the shuffle, and arrival order never matters.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from eventloom import schemas
from eventloom.session import scratch_path, stage_once


def newest(df: DataFrame, keys: Sequence[str], version: str, ties: Sequence[str] = ()) -> DataFrame:
    """One row per key: the one with the greatest version, then the greatest ``ties``, then by a hash of the row.

    So every run picks the same row. Keys stay grouping columns, so filters on them still reach the scan.
    """
    rest = [c for c in df.columns if c not in keys]
    merged = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(version, *ties, F.xxhash64(*rest))).alias("_row"))
    return merged.select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns])


def newest_of_repeated(df: DataFrame, keys: Sequence[str], version: str, ties: Sequence[str] = ()) -> DataFrame:
    """The rows of ``newest``, at the cost of the repeated keys only.

    A hash aggregate over the keys finds those with more than one copy; all other rows pass without being sorted or
    merged. The repeated keys are written to the shared folder first, so the joins know their size: few are broadcast,
    many are shuffled with splittable parts. NULL keys are one key. ``df`` is read three times, once for its keys alone.
    """
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    repeated = stage_once(repeated.select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)]), "repeated")
    same = [df[k].eqNullSafe(repeated[f"_{i}"]) for i, k in enumerate(keys)]
    return df.join(repeated, same, "left_anti").unionByName(newest(df.join(repeated, same, "left_semi"), keys, version, ties))


def newest_of(table: str, df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``newest`` with the key and version of a known table.

    Name the ``columns`` a report needs: the merged row carries only those, so the
    scan and the shuffle do too.
    """
    if columns is not None:
        wanted = [*schemas.KEYS[table], schemas.VERSION[table], *columns]
        df = df.select(*[c for c in df.columns if c in wanted])
    return newest(df, schemas.KEYS[table], schemas.VERSION[table])


def partial_state(
    df: DataFrame, keys: Sequence[str], payload: Sequence[str], weight: Sequence[str] = tuple(schemas.LATEST_WEIGHT)
) -> DataFrame:
    """Mergeable latest state: keys, the winning weight and its payload."""
    w = F.struct(*weight)
    return df.groupBy(*keys).agg(F.max(w).alias("weight"), F.max_by(F.struct(*payload), w).alias("state"))


def merge_states(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Combine partial states of any batches, in any order, with any repeats."""
    return states.groupBy(*keys).agg(F.max("weight").alias("weight"), F.max_by("state", "weight").alias("state"))


def read_state(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Flat view over partial states."""
    return merge_states(states, keys).select(*keys, "state.*")


def latest_state(
    df: DataFrame, keys: Sequence[str], payload: Sequence[str], weight: Sequence[str] = tuple(schemas.LATEST_WEIGHT)
) -> DataFrame:
    """Latest payload per entity straight from its history, in one pass.

    Rows of an entity combine on the map side, so little is shuffled, but each task
    sorts what it read.
    """
    return partial_state(df, keys, payload, weight).select(*keys, "state.*")


def latest_from_long_history(
    df: DataFrame, keys: Sequence[str], payload: Sequence[str], weight: Sequence[str] = tuple(schemas.LATEST_WEIGHT),
) -> DataFrame:
    """``latest_state`` for entities that are few against their rows.

    The newest time per entity is found first, a hash aggregation over narrow
    columns, and stored, so its size is known when the join is planned: a small
    table is broadcast, a large one is not. Only the rows at that time are compared
    in full. NULL keys are an entity like any other.
    """
    stored = [f"_key{i}" for i, _ in enumerate(keys)]
    newest_time = df.groupBy(*[F.col(k).alias(s) for k, s in zip(keys, stored)]).agg(F.max(weight[0]).alias("_newest"))
    newest_time = stage_once(newest_time, "newest")
    same = F.col(weight[0]).eqNullSafe(F.col("_newest"))
    for k, s in zip(keys, stored):
        same = same & F.col(k).eqNullSafe(F.col(s))
    return latest_state(df.join(newest_time, same, "left_semi"), keys, payload, weight)


def latest_of(stream: str, df: DataFrame) -> DataFrame:
    return latest_state(df, schemas.LATEST_KEYS[stream], schemas.LATEST_PAYLOAD[stream])


def with_tombstones(df: DataFrame, keys: Sequence[str], version: str, deleted: str = "is_deleted") -> DataFrame:
    """Resolve corrections and deletions that were appended as newer versions."""
    return newest(df, keys, version).filter(~F.coalesce(F.col(deleted), F.lit(False))).drop(deleted)


def rewrite_partitions(
    df: DataFrame,
    path: str,
    partition: str,
    touched: Column,
    condition: Column,
    assign: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Update (``assign``) or delete the matching rows of a partitioned parquet table.

    Only partitions that satisfy ``touched`` are read and replaced. New contents
    are staged in the shared folder first, so a failure leaves the table as it was.
    """
    spark = df.sparkSession
    hit = F.coalesce(condition, F.lit(False))
    part = df.filter(touched)
    if assign is None:
        changed = part.withColumn("_keep", ~hit)
    else:
        changed = part.select(
            *[F.when(hit, assign[c]).otherwise(F.col(c)).cast(df.schema[c].dataType).alias(c) if c in assign else F.col(c)
              for c in part.columns]
        ).withColumn("_keep", F.lit(True))
    # Folder names are the engine's: it escapes values and names the NULL folder, so they are taken from the files.
    folders = spark.read.schema(df.schema).parquet(path).filter(touched).select(
        F.col(partition).alias("_value"), F.regexp_extract("_metadata.file_path", "^(.*)/[^/]*$", 1).alias("_folder"),
    ).distinct()
    staging = scratch_path(spark, "rewrite")
    changed.write.partitionBy(partition).parquet(staging)
    staged = spark.read.schema(changed.schema).parquet(staging)
    emptied = staged.groupBy(partition).agg(F.bool_or("_keep").alias("_any")).filter(~F.col("_any"))
    kept = staged.filter("_keep").drop("_keep")
    # A fully deleted partition has no row to replace it with, so its folder is emptied.
    gone = emptied.join(folders, F.col(partition).eqNullSafe(F.col("_value"))).select(
        F.url_decode(F.replace("_folder", F.lit("+"), F.lit("%2B"))).alias("folder"),
    ).collect()  # one per emptied partition folder
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    for row in gone:
        spark.createDataFrame([], kept.drop(partition).schema).write.mode("overwrite").parquet(row.folder)
    return spark.read.schema(df.schema).parquet(path)
