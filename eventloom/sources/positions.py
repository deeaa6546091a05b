"""GPS file import: exact columns, one run, one city, plausible values, expected row count."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from eventloom import schemas
from eventloom.functions.scalars import is_uuid, plausible_coordinate
from eventloom.sources.headers import read_headed

COLUMNS = [part.split()[0] for part in schemas.TABLES["courier_positions"].split(", ")]


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """CSV or CSV.gz with exactly the position columns, in any order, which may differ from file to file."""
    raw = read_headed(spark, path, COLUMNS, exact=True, multiLine=True, quote='"', escape='"')
    fields = schemas.schema("courier_positions")
    return raw.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in fields])


def inspect_positions(positions: DataFrame, run_id: str, city_id: str, expected_rows: int) -> DataFrame:
    """One row of counts and the verdict, from a single pass."""
    bad = lambda ok: F.count_if(~F.coalesce(ok, F.lit(False)))
    out = positions.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("courier_id").alias("couriers"),
        bad(F.col("simulation_run_id") == run_id).alias("other_run"),
        bad(F.col("city_id") == city_id).alias("other_city"),
        bad(is_uuid("courier_id")).alias("bad_courier"),
        bad(plausible_coordinate("latitude", "longitude")).alias("bad_coordinate"),
    )
    clean = F.lit(True)
    for c in ("other_run", "other_city", "bad_courier", "bad_coordinate"):
        clean = clean & (F.col(c) == 0)
    return out.withColumn("valid", clean & (F.col("rows") == expected_rows))


def import_positions(
    spark: SparkSession, path: str, existing: DataFrame, run_id: str, expected_rows: int, city_id: str = "madrid"
) -> DataFrame:
    """Validated rows, ready to append. Refuses a bad file and a run that is already loaded."""
    if not existing.filter(F.col("simulation_run_id") == run_id).isEmpty():
        raise ValueError("This run already has data; it is not loaded a second time.")
    positions = read_positions(spark, path)
    verdict = inspect_positions(positions, run_id, city_id, expected_rows).first()
    if not verdict["valid"]:
        raise ValueError(f"Import refused: {verdict.asDict()}")
    return positions
