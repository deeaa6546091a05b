"""Historical explorer: coverage metrics and three charts per public dataset.

Chart rows are ``label``, optionally ``series``, and ``value``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from eventloom.functions.scalars import month_key
from eventloom.operators.topk import top_k
from eventloom.plans import filters as checks

TOP = 10
CATALOG_TOP = 12


def _count(df: DataFrame, label: Column, series: Column | None = None, value: Column | None = None) -> DataFrame:
    keys = [label.alias("label")] + ([series.alias("series")] if series is not None else [])
    return df.groupBy(*keys).agg((F.count(F.lit(1)) if value is None else value).alias("value"))


def otto(archive: DataFrame) -> dict[str, DataFrame]:
    return {
        "metrics": archive.agg(F.count(F.lit(1)).alias("events"), F.approx_count_distinct("session_id", 0.01).alias("sessions_approx")),
        "daily": _count(archive, F.to_date("event_time").cast("string"), F.col("event_type")).orderBy("label", "series"),
        "actions": _count(archive, F.col("event_type")).orderBy(F.desc("value"), "label"),
        "articles": top_k(_count(archive, F.col("article_id").cast("string")), "value", TOP, "label"),
    }


def rees46(events: DataFrame, period: str = "ALL") -> dict[str, DataFrame]:
    checks.marketplace_month(period)
    if period != "ALL":
        events = events.filter(month_key("event_date") == int(period))
    views = F.count_if(F.col("event_type") == "view")
    return {
        "metrics": events.agg(F.count(F.lit(1)).alias("events"), F.approx_count_distinct("user_id", 0.01).alias("users_approx")),
        "monthly": _count(events, month_key("event_date").cast("string"), F.col("event_type")).orderBy("label", "series"),
        "categories": top_k(
            _count(events.filter(F.col("category_code") != ""), F.col("category_code"), value=views), "value", TOP, "label"
        ),
        "brands": top_k(_count(events.filter(F.col("brand") != ""), F.col("brand")), "value", TOP, "label"),
    }


def eleme(samples: DataFrame, period: str = "ALL") -> dict[str, DataFrame]:
    checks.sample_day(period)
    if period != "ALL":
        samples = samples.filter(F.col("sample_day") == int(period))
    clicks = F.sum("clicked").cast("bigint")
    return {
        "metrics": samples.agg(
            F.count(F.lit(1)).alias("samples"), clicks.alias("positive_labels"),
            F.approx_count_distinct("user_id", 0.01).alias("users_approx"),
        ),
        "days": _count(samples, F.col("sample_day").cast("string")).orderBy(F.col("label").cast("int")),
        "hours": _count(samples, F.col("request_hour").cast("string")).orderBy(F.col("label").cast("int")),
        "meals": _count(samples, F.col("meal_period"), value=clicks).orderBy("label"),
    }


def glovo(products: DataFrame, country: str = "ES", city: str | None = None) -> dict[str, DataFrame]:
    country, city = checks.place(country, city)
    if country != "ALL":
        products = products.filter(F.col("country_code") == country)
    if city:
        products = products.filter(F.col("city_code") == city)

    def chart(label: Column) -> DataFrame:
        return top_k(_count(products.filter(label != ""), label), "value", CATALOG_TOP, "label")

    return {
        "metrics": products.agg(
            F.count(F.lit(1)).alias("products"),
            F.count_distinct("store_name").alias("store_names"),
            F.count_distinct("country_code", "city_code").alias("cities"),
        ),
        "cities": chart(F.concat("country_code", F.lit("/"), "city_code")),
        "sections": chart(F.col("collection_section")),
        "stores": chart(F.col("store_name")),
    }


def criteo(users: DataFrame) -> dict[str, DataFrame]:
    groups = users.groupBy("treatment").agg(
        F.count(F.lit(1)).alias("users"), (F.avg("visit") * 100).alias("visit_pct"), (F.avg("conversion") * 100).alias("purchase_pct")
    ).select(F.when(F.col("treatment") == 1, "Treatment").otherwise("Control").alias("label"), "users", "visit_pct", "purchase_pct")
    return {
        "metrics": users.agg(
            F.count(F.lit(1)).alias("users"), F.sum("visit").cast("bigint").alias("visits"), F.sum("conversion").cast("bigint").alias("purchases")
        ),
        "groups": groups,
        **{name: groups.select("label", F.col(name).alias("value")) for name in ("users", "visit_pct", "purchase_pct")},
    }


def historical(dataset: str, df: DataFrame, **filters: str) -> dict[str, DataFrame]:
    chosen = checks.historical(dataset, filters)
    return {"otto": otto, "rees46": rees46, "eleme": eleme, "glovo": glovo, "criteo": criteo}[dataset](df, **chosen)


def dataset_summaries(users: DataFrame | None, products: DataFrame | None) -> dict[str, DataFrame | None]:
    """Per-arm rates and per-country catalog sizes; None for a dataset that is not loaded."""
    arms = countries = None
    if users is not None:
        arms = users.groupBy("treatment").agg(
            F.count(F.lit(1)).alias("users"), F.avg("exposure").alias("exposure_rate"), F.avg("visit").alias("visit_rate"),
            F.avg("conversion").alias("conversion_rate"),
        ).orderBy("treatment")
    if products is not None:
        countries = products.groupBy("country_code").agg(
            F.count(F.lit(1)).alias("products"), F.count_distinct("store_name").alias("stores"),
            F.count_if(F.col("city_code") == "MAD").alias("madrid_products"),
        ).orderBy(F.desc("products"), "country_code")
    return {"criteo": arms, "glovo": countries}
