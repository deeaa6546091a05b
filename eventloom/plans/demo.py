"""First-application reports: session funnel, search conversion, sessions by origin, hourly panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from eventloom import schemas
from eventloom.functions.scalars import within_last
from eventloom.operators.funnel import level_histogram, window_funnel
from eventloom.operators.rollups import SKETCH_LOG2, hll_rollup, read_hll_rollup

STEPS = ["busqueda", "restaurante", "carrito", "pago", "pedido"]
WINDOW_SECONDS = 1800
PANEL_KEYS = ["hora", "origen", "seccion", "dispositivo", "distrito"]


def sessions_by_origin(events: DataFrame) -> DataFrame:
    return events.groupBy("origen").agg(
        F.count(F.lit(1)).alias("eventos"),
        F.hll_sketch_estimate(F.hll_sketch_agg("session_id", SKETCH_LOG2)).alias("sesiones"),
    ).orderBy(schemas.enum_rank("origen", schemas.ORIGINS))


def session_levels(events: DataFrame, origin: str = "simulado") -> DataFrame:
    """Sessions per step reached within 30 minutes, at second resolution."""
    levels = window_funnel(
        events.filter(F.col("origen") == origin), ["session_id"], F.unix_seconds("ts"),
        [F.col("seccion") == s for s in STEPS], WINDOW_SECONDS, strict=False,
    )
    return level_histogram(levels).orderBy("level")


def hourly_states(events: DataFrame) -> DataFrame:
    """Mergeable session sketches per hour and dimension."""
    return hll_rollup(events.withColumn("hora", F.date_trunc("HOUR", "ts")), PANEL_KEYS, "session_id")


def hourly_panel(states: DataFrame, as_of: Column, seconds: int = 86_400) -> DataFrame:
    """Sessions per hour and section over the last day, sections in their own order."""
    recent = states.filter(within_last("hora", as_of, seconds))
    return read_hll_rollup(recent, ["hora", "seccion"], name="sesiones").orderBy(
        "hora", schemas.enum_rank("seccion", schemas.SECTIONS)
    )
