"""Dashboards of the public datasets, each a dict of DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from eventloom.functions.scalars import interval_start, month_key, ratio, share_pct, unsigned_or_null, json_text
from eventloom.operators.joins import any_left_join, daily_overlay
from eventloom.operators.metrics import depth_histogram, positive_rate
from eventloom.operators.topk import hour_axis, top_k
from eventloom.plans import filters as checks
from eventloom.streaming.windows import trailing

TOP_RESTAURANTS = 10
TOP = 12
BRANDS = 10
CITY_OPTIONS = 500


def _between(df: DataFrame, start: str, end: str) -> DataFrame:
    return df.filter(F.col("order_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def _one_row(*parts: DataFrame) -> DataFrame:
    """Single-row aggregates side by side."""
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part, allowMissingColumns=True)
    return merged.agg(*[F.max(c).alias(c) for c in merged.columns])


def delivery_dashboard(
    orders: DataFrame, clicks: DataFrame, items: DataFrame, daily_clicks: DataFrame, click_summary: DataFrame,
    restaurants: DataFrame, start: str, end: str,
) -> dict[str, DataFrame]:
    """Orders, clicks and their relation over a date range."""
    checks.date_range(start, end)
    orders, clicks, items, daily_clicks, click_summary = (
        _between(t, start, end) for t in (orders, clicks, items, daily_clicks, click_summary)
    )
    last = last_click_match(click_summary, orders)
    metrics = _one_row(
        orders.agg(
            F.count(F.lit(1)).alias("orders"), F.count_distinct("user_id").alias("users"),
            F.count_distinct("restaurant_id").alias("restaurants"),
        ),
        clicks.agg(F.count(F.lit(1)).alias("clicks")),
        items.agg(F.count(F.lit(1)).alias("items")),
        last.select("last_click_match_pct"),
    ).withColumn("clicks_per_order", F.coalesce(ratio(F.col("clicks"), F.col("orders"), 2), F.lit(0.0)))
    by_day = orders.groupBy(F.col("order_date").alias("day")).agg(F.count(F.lit(1)).alias("orders"))
    click_days = daily_clicks.groupBy(F.col("order_date").alias("day")).agg(F.sum("clicks").cast("bigint").alias("clicks"))
    hours = orders.groupBy(F.hour("ordered_at").alias("hour")).agg(F.count(F.lit(1)).alias("orders"))
    return {
        "metrics": metrics,
        "daily": daily_overlay(by_day, click_days).orderBy("day"),
        "hours": hours.orderBy("hour"),
        "hour_axis": hour_axis(hours, "hour", "orders").orderBy("hour"),
        "price_bands": orders.groupBy("price_band").agg(F.count(F.lit(1)).alias("orders")).orderBy(F.desc("orders"), "price_band"),
        "depth": depth_histogram(orders, click_summary),
        "last_click": last,
        "top": top_restaurants(orders, daily_clicks, restaurants),
    }


def last_click_match(click_summary: DataFrame, orders: DataFrame) -> DataFrame:
    """Share of sessions whose last click is the restaurant they ordered from."""
    joined = click_summary.select("order_id", "last_clicked_restaurant_id").join(
        orders.select("order_id", "restaurant_id"), "order_id"
    )
    return joined.agg(
        F.count(F.lit(1)).alias("sessions"),
        F.count_if(F.col("restaurant_id") == F.col("last_clicked_restaurant_id")).alias("same_restaurant"),
    ).withColumn("last_click_match_pct", F.coalesce(share_pct(F.col("same_restaurant"), F.col("sessions"), 1), F.lit(0.0)))


def top_restaurants(orders: DataFrame, daily_clicks: DataFrame, restaurants: DataFrame, k: int = TOP_RESTAURANTS) -> DataFrame:
    """Restaurants by orders; only the top rows are joined to clicks and the dimension."""
    top = top_k(orders.groupBy("restaurant_id").agg(F.count(F.lit(1)).alias("orders")), "orders", k, "restaurant_id")
    # The clicks of the few chosen restaurants are picked before they are added up.
    chosen = daily_clicks.join(F.broadcast(top.select("restaurant_id")), "restaurant_id", "left_semi")  # k rows
    clicks = chosen.groupBy("restaurant_id").agg(F.sum("clicks").cast("bigint").alias("clicks"))
    dims = restaurants.join(F.broadcast(top.select("restaurant_id")), "restaurant_id", "left_semi")  # k rows
    out = any_left_join(top, clicks, ["restaurant_id"], defaults={"clicks": 0})
    return any_left_join(out, dims.select("restaurant_id", "category", "score"), ["restaurant_id"]).orderBy(
        F.desc("orders"), "restaurant_id"
    )


def glovo_dashboard(products: DataFrame, country: str = "ES", city: str | None = None) -> dict[str, DataFrame]:
    """Catalog size by city, section and store for a country and optionally a city."""
    country, city = checks.place(country, city)
    in_country = products if country == "ALL" else products.filter(F.col("country_code") == country)
    chosen = in_country.filter(F.col("city_code") == city) if city else in_country
    label: Column = F.concat("country_code", F.lit("/"), "city_code") if country == "ALL" else F.col("city_code")
    n = F.count(F.lit(1)).alias("products")
    options = in_country if country != "ALL" else products.filter(F.lit(False))
    return {
        "metrics": chosen.agg(
            n, F.count_distinct("store_name").alias("stores"), F.count_distinct("country_code", "city_code").alias("cities"),
            F.count_distinct("collection_section").alias("sections"), F.count_if(F.col("has_description") == 1).alias("described"),
        ).withColumn("description_pct", F.coalesce(share_pct(F.col("described"), F.col("products"), 1), F.lit(0.0))),
        "cities": top_k(chosen.groupBy(label.alias("city")).agg(n, F.count_distinct("store_name").alias("stores")), "products", TOP, "city"),
        "sections": top_k(
            chosen.filter(F.col("collection_section") != "").groupBy(F.col("collection_section").alias("section")).agg(n),
            "products", TOP, "section",
        ),
        "stores": top_k(
            chosen.filter(F.col("aux_store") == 0).groupBy(F.col("store_name").alias("store")).agg(
                n, F.count_distinct("city_code").alias("cities"), F.count_distinct("collection_section").alias("sections")
            ), "products", TOP, "store",
        ),
        "city_options": top_k(options.groupBy(F.col("city_code").alias("city")).agg(n), "products", CITY_OPTIONS, "city"),
        "countries": products.groupBy(F.col("country_code").alias("country")).agg(n).orderBy(F.desc("products"), "country"),
    }


def _type_counts(types: list[str]) -> list[Column]:
    return [F.count_if(F.col("event_type") == t).alias(t) for t in types]


def otto_dashboard(archive: DataFrame, replay: DataFrame, live_clicks: DataFrame, as_of: Column) -> dict[str, DataFrame]:
    """Archive totals, the last 30 seconds of the replay, and live clicks."""
    kinds = ["clicks", "carts", "orders"]
    total = [F.count(F.lit(1)).alias("events"), *_type_counts(kinds), F.approx_count_distinct("session_id", 0.01).alias("sessions")]
    recent = trailing(replay, "ingested_at", as_of, 30)
    return {
        "archive": archive.agg(*total),
        "replay_30s": recent.agg(*total),
        "replayed_total": replay.agg(F.count(F.lit(1)).alias("events")),
        "timeline": recent.groupBy(interval_start("ingested_at", 2).alias("second")).agg(*_type_counts(kinds)).orderBy("second"),
        "top": top_k(
            recent.groupBy("article_id").agg(F.count(F.lit(1)).alias("events"), *_type_counts(["clicks", "orders"])),
            "events", 8, "article_id",
        ),
        "live_clicks": live_clicks.agg(F.count(F.lit(1)).alias("clicks")),
        "recent_live": live_clicks.select("section", "action", "clicked_at").orderBy(F.desc("clicked_at")).limit(8),
    }


def rees46_dashboard(events: DataFrame, month: str = "ALL") -> dict[str, DataFrame]:
    """Marketplace activity of one month or all; the monthly chart always shows all."""
    checks.marketplace_month(month)
    chosen = events if month == "ALL" else events.filter(month_key("event_date") == int(month))
    kind = F.col("event_type")
    return {
        "metrics": chosen.agg(
            F.count(F.lit(1)).alias("events"), F.count_if(kind == "view").alias("views"), F.count_if(kind == "cart").alias("carts"),
            F.count_if(kind == "remove_from_cart").alias("removals"), F.count_if(kind == "purchase").alias("purchases"),
            F.approx_count_distinct("user_id", 0.01).alias("users_approx"),
        ),
        "monthly": events.groupBy(month_key("event_date").alias("month"), "event_type").agg(
            F.count(F.lit(1)).alias("events")
        ).orderBy("month", "event_type"),
        "categories": top_k(
            chosen.filter(F.col("category_code") != "").groupBy(F.col("category_code").alias("category")).agg(
                F.count_if(kind == "view").alias("views"), F.count_if(kind == "cart").alias("carts"),
                F.count_if(kind == "purchase").alias("purchases"),
            ), "views", TOP, "category",
        ),
        "brands": top_k(
            chosen.filter(F.col("brand") != "").groupBy("brand").agg(
                F.count(F.lit(1)).alias("events"), F.count_if(kind == "purchase").alias("purchases")
            ), "events", BRANDS, "brand",
        ),
    }


def eleme_dashboard(samples: DataFrame, day: str = "ALL", staging: DataFrame | None = None) -> dict[str, DataFrame]:
    """Recommendation samples by day, hour, city and meal; files and staging cover all days."""
    checks.sample_day(day)
    chosen = samples if day == "ALL" else samples.filter(F.col("sample_day") == int(day))
    n, clicks = F.count(F.lit(1)).alias("samples"), F.sum("clicked").cast("bigint").alias("clicks")
    out = {
        "metrics": chosen.agg(
            n, clicks, F.approx_count_distinct("user_id", 0.01).alias("users_approx"),
            F.approx_count_distinct("shop_id", 0.01).alias("shops_approx"),
        ).withColumn("positive_pct", share_pct(F.col("clicks"), F.col("samples"))),
        "days": samples.groupBy(F.col("sample_day").alias("day")).agg(n, clicks).orderBy("day"),
        "hours": chosen.groupBy(F.col("request_hour").alias("hour")).agg(n, clicks).orderBy("hour"),
        "cities": top_k(chosen.groupBy(F.col("city_id").alias("city")).agg(n, clicks), "samples", TOP, "city"),
        "meals": chosen.groupBy(F.col("meal_period").alias("period")).agg(n, clicks).orderBy(F.desc("samples"), "period"),
        "files": samples.groupBy(F.col("source_file").alias("file"), F.col("sample_day").alias("day")).agg(n).orderBy("day", "file"),
    }
    if staging is not None:
        out["staging"] = staging.agg(F.count(F.lit(1)).alias("rows"))
    return out


def day_rates(samples: DataFrame) -> DataFrame:
    return positive_rate(samples, ["sample_day"]).orderBy("sample_day")


def hour_city_breakdown(samples: DataFrame, day: int, k: int = 20) -> DataFrame:
    counts = samples.filter(F.col("sample_day") == day).groupBy("request_hour", "city_id").agg(
        F.count(F.lit(1)).alias("samples"), F.sum("clicked").cast("bigint").alias("clicks")
    )
    return top_k(counts, "samples", k, "request_hour", "city_id")


def time_validity(samples: DataFrame) -> DataFrame:
    """Range of the raw epoch texts and how many are none."""
    epoch = unsigned_or_null("request_time_raw")
    return samples.agg(
        F.min(epoch).alias("min_unix"), F.max(epoch).alias("max_unix"), F.count_if(epoch.isNull()).alias("invalid_unix")
    )


def typed_vs_json_clicks(samples: DataFrame) -> DataFrame:
    """The same label count from the typed column and from the raw JSON text."""
    return samples.agg(
        F.sum("clicked").cast("bigint").alias("typed_clicks"),
        F.count_if(json_text("raw_features", "clicked") == "1").alias("json_clicks"),
    )


def scale_dashboard(inventory: DataFrame, real: list[str], derived: list[str]) -> dict[str, DataFrame]:
    """Rows and bytes per table; observed and derived rows are totalled apart."""
    name, rows = F.col("table_name"), F.col("physical_rows")
    zero = F.lit(0).cast("bigint")
    return {
        "tables": inventory.select("table_name", "physical_rows", "file_bytes").orderBy("table_name"),
        "totals": inventory.agg(
            F.coalesce(F.sum(F.when(name.isin(real), rows)), zero).alias("real_events"),
            F.coalesce(F.sum(F.when(name.isin(derived), rows)), zero).alias("derived_rows"),
        ),
    }
