"""Demo catalog with the provenance of every field."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from eventloom.operators.scans import running

# --- fixed values ------------------------------------------------------------------------
FALLBACK_PRODUCTS = ["Vegetable bowl", "House menu", "Salad of the day"]
SLOTS = len(FALLBACK_PRODUCTS)


def seed_restaurants(places: DataFrame, version: int, city_id: str = "madrid") -> DataFrame:
    """Fictional restaurants from ``places`` (restaurant_id, name, latitude, longitude), labelled synthetic."""
    return places.select(
        "restaurant_id", "name", F.lit(city_id).alias("city_id"), "latitude", "longitude",
        F.lit("synthetic").alias("location_kind"), F.lit("synthetic").alias("source_kind"),
        F.lit(version).cast("bigint").alias("version"),
    )


def seed_products(public: DataFrame, prices: DataFrame, version: int) -> DataFrame:
    """One product per price: public names when there is one for every product, the fallback names otherwise.

    ``prices`` has ``n`` (0, 1, 2, ...), ``restaurant_id``, ``slot`` (from 1) and ``price_minor``; the n-th
    product takes the n-th public name. ``name_kind`` and ``source_row`` record which names were used.
    """
    wanted = prices.count()
    places = public.filter((F.col("country_code") == "ES") & (F.col("city_code") == "MAD"))
    places = places.select("source_row", "product_name", F.lit(1).cast("bigint").alias("_one"))
    numbered = running(places, [], ["source_row", "product_name"], ["source_row", "product_name"], {"n": "_one"})
    named = numbered.filter(F.col("n") <= wanted).withColumn("n", F.col("n") - 1)
    if named.count() < wanted:
        named = named.limit(0)
    fallback = F.element_at(F.array(*[F.lit(p) for p in FALLBACK_PRODUCTS]), F.pmod(F.col("slot") - 1, F.lit(SLOTS)).cast("int") + 1)
    product_id = F.concat("restaurant_id", F.lit("-product-"), F.col("slot").cast("string"))
    found = F.col("source_row").isNotNull()
    return prices.join(named, "n", "left").select(
        product_id.alias("product_id"),
        "restaurant_id",
        F.coalesce("product_name", fallback).alias("product_name"),
        "price_minor",
        F.lit("EUR").alias("currency"),
        F.lit("synthetic").alias("price_kind"),
        F.when(found, "public_historical").otherwise("synthetic").alias("name_kind"),
        F.when(found, "delivery.glovo_products").alias("source_table"),
        F.col("source_row").cast("int").alias("source_row"),
        F.lit(version).cast("bigint").alias("version"),
    )
