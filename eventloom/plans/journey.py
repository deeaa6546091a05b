"""Customer journey of one run: ordered funnel, actions, minute timeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from eventloom import schemas
from eventloom.operators.funnel import funnel_reach, funnel_totals, window_funnel
from eventloom.operators.metrics import active_members
from eventloom.operators.topk import latest_chronological
from eventloom.operators.versioning import newest_of
from eventloom.plans import filters

WINDOW_MS = 30 * 60 * 1000
LABELS = ["Session started", "Product opened", "Cart added", "Checkout"]
MINUTES_SHOWN = 60


def run_activity(activity: DataFrame, run_id: str, kind: str = "all") -> DataFrame:
    """Logical actions of one run, for all customers or one kind of them.

    A customer is AI once the model has taken one of its decisions in this run.
    """
    filters.journey_kind(kind)
    run = activity.filter(F.col("simulation_run_id") == run_id)
    logical = newest_of("customer_activity", run, ["session_id", "action"])
    if kind == "all":
        return logical
    modelled = run.groupBy("customer_id").agg(F.max(F.col("decision_mode") == schemas.MODEL_MODE).alias("_ai"))
    chosen = modelled.filter(F.col("_ai") if kind == "ai" else ~F.col("_ai"))
    return logical.join(chosen, "customer_id", "left_semi")


def session_levels(actions: DataFrame) -> DataFrame:
    """Greatest step per session; equal timestamps do not advance twice."""
    return window_funnel(
        actions, ["session_id"], F.unix_millis("event_time"), [F.col("action") == s for s in schemas.JOURNEY_STEPS],
        WINDOW_MS, strict=True, flags={"abandoned": F.col("action") == "abandon"},
    )


def journey_funnel(activity: DataFrame, run_id: str, kind: str = "all") -> DataFrame:
    return funnel_reach(session_levels(run_activity(activity, run_id, kind)), LABELS)


def journey_totals(activity: DataFrame, run_id: str, kind: str = "all") -> DataFrame:
    return funnel_totals(session_levels(run_activity(activity, run_id, kind)))


def journey_actions(activity: DataFrame, run_id: str, kind: str = "all") -> DataFrame:
    """Logical actions by type, with the sessions that took them."""
    return run_activity(activity, run_id, kind).groupBy("action").agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct("session_id").alias("sessions")
    ).orderBy(F.desc("events"), "action")


def journey_timeline(activity: DataFrame, run_id: str, kind: str = "all") -> DataFrame:
    """Active, buying and abandoning sessions per minute, the latest hour of minutes."""
    by_minute = run_activity(activity, run_id, kind).withColumn("bucket", F.date_trunc("MINUTE", "event_time"))
    counts = active_members(
        by_minute, ["bucket"], "session_id",
        {"checkout_sessions": F.col("action") == "checkout", "abandoned_sessions": F.col("action") == "abandon"},
        "active_sessions",
    )
    return latest_chronological(counts, MINUTES_SHOWN, "bucket")


def journey(activity: DataFrame, run_id: str, kind: str = "all") -> dict[str, DataFrame]:
    return {
        "steps": journey_funnel(activity, run_id, kind),
        "totals": journey_totals(activity, run_id, kind),
        "actions": journey_actions(activity, run_id, kind),
        "timeline": journey_timeline(activity, run_id, kind),
    }
