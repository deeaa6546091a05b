"""Typed readers of the public dataset formats. Schemas are explicit, headers are checked."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from eventloom import schemas
from eventloom.functions.scalars import compact_date, digits_or_zero, number_or_null, parse_time
from eventloom.operators.contracts import Rule
from eventloom.operators.sequences import continuity
from eventloom.paths import table_exists
from eventloom.sources.headers import read_headed
from eventloom.sources.rowindex import with_row_index

# --- fixed values: published file layouts -----------------------------------------------
SESSION_SCHEMA = "session BIGINT, events ARRAY<STRUCT<aid: BIGINT, ts: BIGINT, type: STRING>>"
SESSION_TYPES = ["clicks", "carts", "orders"]
CLICK_END_DATE = "20210321"
NO_CLICKS = ["", "NULL"]
MARKETPLACE_COLUMNS = [
    "event_time", "event_type", "product_id", "category_id", "category_code", "brand", "price", "user_id",
    "user_session",
]
SAMPLE_FIELDS = (
    "clicked user_id gender visit_city avg_price is_supervip ctr_30 ord_30 total_amt_30 "
    "shop_id item_id city_id district_id shop_aoi_id shop_geohash_6 shop_geohash_12 "
    "brand_id category_1_id merge_standard_food_id rank_7 rank_30 rank_90 "
    "shop_id_list item_id_list category_1_id_list merge_standard_food_id_list "
    "brand_id_list price_list shop_aoi_id_list shop_geohash6_list timediff_list "
    "hours_list time_type_list weekdays_list times hours time_type weekdays geohash12"
).split()
DELIMITERS = {"tab": "\t", "comma": ",", "pipe": "|", "ctrl-a": "\x01"}
CATALOG_COLUMNS = [
    "country_code", "city_code", "store_name", "product_name", "collection_section", "product_description",
    "aux_store", "HIER",
]


def load_or_empty(spark: SparkSession, table: str, path: str) -> DataFrame:
    """The table, or a typed empty frame when it has not been loaded."""
    if not table_exists(spark, path):
        return spark.createDataFrame([], schemas.schema(table))
    return spark.read.schema(schemas.TABLES[table]).parquet(path)


# Nested sessions ------------------------------------------------------------------------


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """One JSON line per session, flattened to one row per event."""
    return flatten_sessions(spark.read.schema(SESSION_SCHEMA).json(path, mode="FAILFAST"))


def flatten_sessions(sessions: DataFrame, known_types: list[str] = SESSION_TYPES) -> DataFrame:
    """Events with their 0-based position; an unknown type stops the load."""
    events = sessions.select("session", F.posexplode("events").alias("event_position", "e"))
    kind = F.when(F.col("e.type").isin(known_types), F.col("e.type")).otherwise(
        F.raise_error(F.concat(F.lit("Unknown event type: "), F.coalesce("e.type", F.lit("null")))).cast("string")
    )
    return events.select(
        F.col("session").alias("session_id"),
        F.col("e.aid").alias("article_id"),
        F.timestamp_millis("e.ts").alias("event_time"),
        kind.alias("event_type"),
        F.col("event_position").cast("int").alias("event_position"),
    )


# Header TSV of orders and clicks ---------------------------------------------------------


def read_tsv(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """Header TSV as text columns, each file by its own header."""
    raw = read_headed(spark, path, required, sep="\t")
    return raw.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in required])


def read_restaurants(spark: SparkSession, path: str) -> DataFrame:
    raw = read_tsv(spark, path, ["wm_poi_id", "primary_first_tag_name", "aor_id", "poi_score"])
    return raw.select(
        F.col("wm_poi_id").cast("bigint").alias("restaurant_id"),
        F.col("primary_first_tag_name").alias("category"),
        digits_or_zero("aor_id").alias("area_id"),
        number_or_null("poi_score").cast("float").alias("score"),
    )


def read_foods(spark: SparkSession, path: str) -> DataFrame:
    raw = read_tsv(spark, path, ["wm_food_spu_id", "price", "category"])
    return raw.select(
        F.col("wm_food_spu_id").cast("bigint").alias("food_id"), number_or_null("price").cast("float").alias("price"), "category"
    )


def read_orders(spark: SparkSession, path: str) -> DataFrame:
    raw = read_tsv(
        spark, path,
        ["wm_order_id", "user_id", "wm_poi_id", "aor_id", "order_price_interval", "order_timestamp", "ord_period_name", "dt"],
    )
    at = F.col("order_timestamp")
    # The stored wall clock is the local one; hours are read from it as they stand.
    local = F.coalesce(F.timestamp_seconds(at.try_cast("bigint")) + F.expr("INTERVAL 8 HOURS"), at.try_cast("timestamp"))
    return raw.select(
        F.col("wm_order_id").cast("bigint").alias("order_id"),
        F.col("user_id").cast("bigint"),
        F.col("wm_poi_id").cast("bigint").alias("restaurant_id"),
        digits_or_zero("aor_id").alias("area_id"),
        F.col("order_price_interval").alias("price_band"),
        local.alias("ordered_at"),
        F.col("ord_period_name").alias("period_code"),
        compact_date("dt").alias("order_date"),
    )


def read_order_items(spark: SparkSession, path: str) -> DataFrame:
    raw = read_tsv(spark, path, ["dt", "wm_order_id", "wm_food_spu_id"])
    return raw.select(
        compact_date("dt").alias("order_date"),
        F.col("wm_order_id").cast("bigint").alias("order_id"),
        F.col("wm_food_spu_id").cast("bigint").alias("food_id"),
    )


def read_click_sessions(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, ["dt", "wm_order_id", "clicks"])


def _recorded_clicks(sessions: DataFrame, last_day: str) -> DataFrame:
    return sessions.filter((F.col("dt") <= last_day) & ~F.col("clicks").isin(NO_CLICKS)).select(
        compact_date("dt").alias("order_date"),
        F.col("wm_order_id").cast("bigint").alias("order_id"),
        F.split("clicks", "#").alias("ids"),
    )


def clicks_from_sessions(sessions: DataFrame, last_day: str = CLICK_END_DATE) -> DataFrame:
    """One row per click with its 1-based position."""
    return _recorded_clicks(sessions, last_day).select(
        "order_date", "order_id", F.posexplode("ids").alias("_p", "_id")
    ).select("order_date", "order_id", (F.col("_p") + 1).alias("position"), F.col("_id").cast("bigint").alias("restaurant_id"))


def click_summary_from_sessions(sessions: DataFrame, last_day: str = CLICK_END_DATE) -> DataFrame:
    """Clicks, distinct restaurants and the last one, per order."""
    return _recorded_clicks(sessions, last_day).select(
        "order_date",
        "order_id",
        F.size("ids").alias("click_count"),
        F.size(F.array_distinct("ids")).alias("distinct_restaurants"),
        F.element_at("ids", -1).cast("bigint").alias("last_clicked_restaurant_id"),
    )


# Marketplace CSV ------------------------------------------------------------------------


def read_marketplace(spark: SparkSession, path: str) -> DataFrame:
    """Marketplace CSV (plain or gzip) with an exact header, as text.

    A gzip file is one task whatever its size; pass many files, or unpack them
    first when they are large.
    """
    ddl = ", ".join(f"{c} STRING" for c in MARKETPLACE_COLUMNS)
    return spark.read.schema(ddl).csv(path, header=True, enforceSchema=False, mode="FAILFAST")


def type_marketplace(raw: DataFrame) -> DataFrame:
    at = parse_time("event_time")
    return raw.select(
        at.alias("event_time"),
        at.cast("date").alias("event_date"),
        "event_type",
        *[F.col(c).try_cast("bigint").alias(c) for c in ("product_id", "category_id")],
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("category_code", "brand")],
        F.col("price").try_cast("decimal(12,2)").alias("price"),
        F.col("user_id").try_cast("bigint").alias("user_id"),
        F.coalesce("user_session", F.lit("")).alias("user_session"),
    )


def marketplace_rules() -> list[Rule]:
    return [
        ("event_time", F.col("event_time").isNull()),
        *[(c, F.col(c).isNull() | (F.col(c) < 0)) for c in ("product_id", "category_id", "user_id")],
        ("price", F.col("price").isNull()),
    ]


# Recommendation samples --------------------------------------------------------------------


def detect_delimiter(spark: SparkSession, path: str, fields: int = len(SAMPLE_FIELDS)) -> str:
    """The one separator that splits the first lines into the published field count."""
    first = [r.value.lstrip("﻿") for r in spark.read.text(path).limit(3).collect()]  # three lines
    fitting = [
        name for name, sep in DELIMITERS.items()
        if first and all(len(row) == fields for row in csv.reader(first, delimiter=sep) if row)
    ]
    if len(fitting) != 1:
        raise ValueError(f"No single separator gives {fields} fields.")
    return DELIMITERS[fitting[0]]


def read_samples(spark: SparkSession, path: str, delimiter: str) -> DataFrame:
    """All published fields as text with their row number; one exact header row is skipped."""
    ddl = ", ".join([*(f"`{c}` STRING" for c in SAMPLE_FIELDS), "_corrupt STRING"])
    raw = spark.read.schema(ddl).csv(
        path, sep=delimiter, columnNameOfCorruptRecord="_corrupt", mode="PERMISSIVE", emptyValue="", nullValue="\0"
    )
    numbered = with_row_index(raw)
    header = F.lit(True)
    for name in SAMPLE_FIELDS[:3]:
        header = header & (F.regexp_replace(F.col(f"`{name}`"), "^﻿", "") == name)
    return numbered.filter(~F.coalesce(header, F.lit(False)))


def sample_rules() -> list[Rule]:
    hour = F.col("hours").try_cast("int")
    return [
        ("field_count", F.col("_corrupt").isNotNull()),
        ("clicked", ~F.col("clicked").isin("0", "1")),
        ("hours", ~hour.between(0, 23)),
    ]


def project_samples(raw: DataFrame, source_id: str, source_file: str, day: int) -> DataFrame:
    """Typed columns for the reports, and every raw field as one JSON text."""
    return raw.select(
        F.lit(source_id).alias("source_id"),
        F.lit(source_file).alias("source_file"),
        "source_row",
        F.lit(day).cast("smallint").alias("sample_day"),
        F.col("clicked").cast("smallint").alias("clicked"),
        "user_id", "shop_id", "item_id", "city_id", "district_id",
        F.col("category_1_id").alias("category_id"),
        F.col("hours").cast("smallint").alias("request_hour"),
        F.col("weekdays").alias("weekday"),
        F.col("time_type").alias("meal_period"),
        F.col("times").alias("request_time_raw"),
        F.to_json(F.struct(*SAMPLE_FIELDS)).alias("raw_features"),
        F.current_timestamp().alias("loaded_at"),
    )


# Product catalog ------------------------------------------------------------------------


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Quoted catalog CSV; descriptions may hold separators and line breaks."""
    raw = read_headed(spark, path, CATALOG_COLUMNS, first="source_row", multiLine=True, quote='"', escape='"')
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    truth: Column = lambda c: F.coalesce(F.col(c) == "True", F.lit(False)).cast("smallint")
    return raw.select(
        F.col("source_row").cast("int").alias("source_row"),
        *[text(c).alias(c) for c in CATALOG_COLUMNS[:6]],
        (text("product_description") != "").cast("smallint").alias("has_description"),
        truth("aux_store").alias("aux_store"),
        truth("HIER").alias("hier"),
    )


def catalog_index_check(catalog: DataFrame) -> DataFrame:
    """Row numbers must be 0, 1, 2, ... without a gap."""
    return continuity(catalog, [], "source_row", first_allowed=(0,))


def escape_text(value: Column | str) -> Column:
    """Backslash escapes for one-line text files."""
    out = F.col(value) if isinstance(value, str) else value
    for raw, shown in [("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r"), ("\0", "\\0")]:
        out = F.replace(out, F.lit(raw), F.lit(shown))
    return out


def read_uplift(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.TABLES["criteo_uplift"]).csv(path, header=True, enforceSchema=False, mode="FAILFAST")
