"""Incremental rollups kept as mergeable partial states, one folder per batch.

A batch replaces its own folder, so a replayed micro-batch never counts twice,
also for additive sums. Compaction folds every batch up to ``through`` into one
folder of a new generation; readers take the newest finished generation.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from eventloom.paths import child_names, path_exists

SKETCH_LOG2 = 14


def sum_rollup(df: DataFrame, keys: Sequence[str], events: str = "events") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(events))


def read_sum_rollup(partials: DataFrame, keys: Sequence[str], events: str = "events") -> DataFrame:
    """Several physical rows may share a key, so reading sums them."""
    return partials.groupBy(*keys).agg(F.sum(events).alias(events))


def id_rollup(df: DataFrame, keys: Sequence[str], member: str) -> DataFrame:
    """Exact-distinct state: the set of members, stored as rows instead of one growing blob."""
    return df.select(*keys, member).distinct()


def read_id_rollup(states: DataFrame, keys: Sequence[str], member: str, name: str = "events") -> DataFrame:
    return states.groupBy(*keys).agg(F.count_distinct(member).alias(name))


def hll_rollup(df: DataFrame, keys: Sequence[str | Column], member: str, name: str = "sketch") -> DataFrame:
    """Approximate-distinct state, at most 16 KB per key whatever the traffic; error near 1 %."""
    return df.groupBy(*keys).agg(F.hll_sketch_agg(member, SKETCH_LOG2).alias(name))


def read_hll_rollup(
    states: DataFrame, keys: Sequence[str], sketch: str = "sketch", name: str = "approx_members"
) -> DataFrame:
    return states.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg(sketch)).alias(name))


def _generations(spark: SparkSession, path: str) -> list[int]:
    found = []
    for name in child_names(spark, path):
        if name.startswith("generation="):
            through = int(name.split("=")[1])
            if through < 0 or path_exists(spark, f"{path}/{name}/batch_id={through}/_SUCCESS"):
                found.append(through)
    return sorted(found)


def write_batch_state(state: DataFrame, path: str, batch_id: int) -> bool:
    """Store one batch's partial state; a replay replaces it.

    Returns False when compaction has already absorbed that batch.
    """
    spark = state.sparkSession
    generation = max(_generations(spark, path), default=-1)
    if batch_id <= generation:
        return False
    state.write.mode("overwrite").parquet(f"{path}/generation={generation}/batch_id={batch_id}")
    return True


def read_batch_states(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """All partial states of the newest finished generation."""
    generation = max(_generations(spark, path), default=None)
    if generation is None:
        raise FileNotFoundError(f"No rollup state under {path}")
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(f"{path}/generation={generation}/batch_id=*")


def compact(spark: SparkSession, path: str, through: int, merge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Merge every batch up to ``through`` into one; call it between micro-batches."""
    generation = max(_generations(spark, path))
    if through <= generation:
        raise ValueError("These batches are compacted already.")
    root = f"{path}/generation={generation}"
    batches = sorted(int(n.split("=")[1]) for n in child_names(spark, root) if n.startswith("batch_id="))
    if not batches or batches[-1] > through:
        raise ValueError("Later batches exist; compact through the last committed one.")
    target = f"{path}/generation={through}/batch_id={through}"
    merge(spark.read.parquet(f"{root}/batch_id=*")).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def backfill_sum(archive: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """Build the rollup from its archive and report whether both totals agree."""
    spark = archive.sparkSession
    if not write_batch_state(sum_rollup(archive, keys), path, 0):
        raise ValueError("The rollup has newer batches; rebuild it in a new folder.")
    return rollup_check(archive, read_batch_states(spark, path), keys)


def rollup_check(
    archive: DataFrame, partials: DataFrame, keys: Sequence[str], expected_keys: int | None = None
) -> DataFrame:
    """One row: archive total, rollup total, logical keys, and whether they match."""
    rolled = read_sum_rollup(partials, keys).agg(
        F.lit(None).cast("bigint").alias("archive_events"),
        F.coalesce(F.sum("events"), F.lit(0).cast("bigint")).alias("rollup_events"),
        F.count(F.lit(1)).alias("logical_keys"),
    )
    total = archive.agg(F.count(F.lit(1)).alias("archive_events"))
    both = rolled.unionByName(total, allowMissingColumns=True)
    same = F.col("archive_events") == F.col("rollup_events")
    if expected_keys is not None:
        same = same & (F.col("logical_keys") == expected_keys)
    return both.agg(*[F.max(c).alias(c) for c in rolled.columns]).withColumn("same", same)
