"""The data model derived from the driver tables: Spark frames and the same rows in SQL.

Every view covers its whole source table. Views with retries add a second physical
copy of some rows, with a later ingest time, so that logical reads have work to do.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from eventloom import schemas
from eventloom.operators.rollups import id_rollup, sum_rollup
from eventloom.session import ensure_utc
from eventloom.streaming.ingest import ROLLUP_KEYS

RUN = "run-0"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_utc(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    local = [f.name for f in df.schema if f.dataType.typeName() == "timestamp_ntz"]
    return df.select(*[F.col(c).cast("timestamp").alias(c) if c in local else F.col(c) for c in df.columns])


def tag(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), number.cast("string"))


def choose(column: Column, pairs: dict[str, str], default: str | None = None) -> Column:
    out = F.lit(default)
    for key, value in reversed(pairs.items()):
        out = F.when(column == key, value).otherwise(out)
    return out


def sql_choose(column: str, pairs: dict[str, str], default: str | None = None) -> str:
    cases = " ".join(f"WHEN {column} = '{k}' THEN '{v}'" for k, v in pairs.items())
    end = "NULL" if default is None else f"'{default}'"
    return f"CASE {cases} ELSE {end} END"


def plain(df: DataFrame, digits: int = 6) -> DataFrame:
    """Types both engines write alike: whole numbers, rounded doubles, text times."""
    out = []
    for f in df.schema:
        kind, c = f.dataType.typeName(), F.col(f"`{f.name}`")
        if kind == "timestamp":
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSS")
        elif kind == "date":
            c = F.date_format(c, "yyyy-MM-dd")
        elif kind in ("byte", "short", "integer"):
            c = c.cast("bigint")
        elif kind in ("float", "double", "decimal"):
            c = F.round(c.cast("double"), digits)
        out.append(c.alias(f.name))
    return df.select(*out)


def ms(column: str) -> str:
    """SQL text of a time with milliseconds."""
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%g')"


def day(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d')"


def with_sql(*names: str) -> str:
    """WITH clause holding the named views and what they need."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in _NEEDS.get(name, []):
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in ordered) + "\n"


def final_sql(view: str, table_name: str) -> str:
    keys = ", ".join(schemas.KEYS[table_name])
    version = schemas.VERSION[table_name]
    return f"SELECT * FROM {view} QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY {version} DESC) = 1"


SQL: dict[str, str] = {}
_NEEDS: dict[str, list[str]] = {}

# events with parsed props and millisecond times ------------------------------------------------

SQL["ev"] = (
    "SELECT event_id, user_id, event_type, value, ts, date_trunc('milliseconds', ts) AS moment, "
    "CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"
)


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", "value", "ts",
        F.date_trunc("MILLISECOND", "ts").alias("moment"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )


def _late(moment: Column, seconds: int) -> Column:
    return moment + F.make_dt_interval(secs=F.lit(seconds))


def _with_copies(df: DataFrame, every: int, number: str) -> DataFrame:
    """Second physical copies of every n-th row, ingested a minute later, made without a second scan."""
    copies = F.when(F.col(number) % every == 0, F.array(F.lit(0), F.lit(60))).otherwise(F.array(F.lit(0)))
    return df.withColumn("_late", F.explode(copies))


# customer activity ---------------------------------------------------------------------------

_ACTION = {
    "signup": "session_started", "view": "open_product", "click": "add_to_cart", "purchase": "checkout", "error": "abandon",
}


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    e = _with_copies(ev(spark, sf_dir), 7, "event_id")
    action = choose(c("event_type"), _ACTION)
    return e.select(
        F.lit(1).cast("smallint").alias("schema_version"),
        c("event_id").cast("string").alias("event_id"),
        F.lit(RUN).alias("simulation_run_id"),
        tag("c", c("user_id")).alias("customer_id"),
        F.concat(tag("s", c("user_id")), F.lit("-"), F.date_format("ts", "yyyyMMdd")).alias("session_id"),
        c("moment").alias("event_time"),
        _late(c("moment"), 1).__add__(F.make_dt_interval(secs=c("_late"))).alias("ingested_at"),
        tag("Customer ", c("user_id")).alias("customer_label"),
        tag("goal", c("user_id") % 3).alias("objective"),
        ((c("user_id") % 20) * 100).cast("int").alias("budget_minor"),
        action.alias("action"),
        action.alias("stage"),
        F.when(c("_late") > 0, "retry").otherwise(tag("reason", c("k"))).alias("reason"),
        tag("rest", c("k") % 12).alias("restaurant_id"),
        tag("prod", c("k") % 36).alias("product_id"),
        F.when(c("event_type") == "purchase", tag("o", c("event_id"))).alias("order_id"),
        F.round(c("value") * 100).cast("int").alias("cart_total_minor"),
        F.when((c("k") % 25 == 0) & (c("user_id") % 5 == 0), schemas.MODEL_MODE).otherwise("rules").alias("decision_mode"),
        F.lit(None).cast("string").alias("model"),
        F.lit("synthetic").alias("source_kind"),
    )


def _activity_sql(late: int) -> str:
    reason = "'retry'" if late else "'reason' || k"
    where = " WHERE event_id % 7 = 0" if late else ""
    return f"""SELECT CAST(event_id AS VARCHAR) AS event_id, '{RUN}' AS simulation_run_id, 'c' || user_id AS customer_id,
        's' || user_id || '-' || strftime(ts, '%Y%m%d') AS session_id, moment AS event_time,
        moment + INTERVAL {1 + late} SECOND AS ingested_at, 'Customer ' || user_id AS customer_label,
        'goal' || (user_id % 3) AS objective, (user_id % 20) * 100 AS budget_minor,
        {sql_choose('event_type', _ACTION)} AS action, {reason} AS reason, 'rest' || (k % 12) AS restaurant_id,
        'prod' || (k % 36) AS product_id, CASE WHEN event_type = 'purchase' THEN 'o' || event_id END AS order_id,
        CAST(round(value * 100) AS BIGINT) AS cart_total_minor,
        CASE WHEN k % 25 = 0 AND user_id % 5 = 0 THEN 'ollama' ELSE 'rules' END AS decision_mode FROM ev{where}"""


SQL["activity"] = _activity_sql(0) + " UNION ALL " + _activity_sql(60)
SQL["act"] = final_sql("activity", "customer_activity")
_NEEDS["activity"], _NEEDS["act"] = ["ev"], ["activity"]

# courier positions ---------------------------------------------------------------------------


def positions(spark: SparkSession, sf_dir: str, runs: int = 1) -> DataFrame:
    c = F.col
    e = _with_copies(ev(spark, sf_dir), 11, "event_id")
    return e.select(
        F.lit(1).cast("smallint").alias("schema_version"),
        c("event_id").cast("string").alias("event_id"),
        tag("run-", c("user_id") % runs).alias("simulation_run_id"),
        c("moment").alias("event_time"),
        (_late(c("moment"), 1) + F.make_dt_interval(secs=c("_late"))).alias("ingested_at"),
        F.lit("madrid").alias("city_id"),
        tag("k", c("user_id") % 50).alias("courier_id"),
        tag("o", c("event_id") % 500).alias("order_id"),
        (F.lit(40.0) + (c("event_id") % 1000).cast("double") / 1000).alias("latitude"),
        (F.lit(-3.0) - (c("user_id") % 100).cast("double") / 100).alias("longitude"),
        (c("event_id") % 60).cast("float").alias("speed_kmh"),
        F.lit(5.0).cast("float").alias("accuracy_m"),
        F.lit("gps").alias("source"),
        F.lit("synthetic").alias("source_kind"),
    )


def _positions_sql(late: int, runs: int) -> str:
    where = " WHERE event_id % 11 = 0" if late else ""
    return f"""SELECT CAST(event_id AS VARCHAR) AS event_id, 'run-' || (user_id % {runs}) AS simulation_run_id,
        moment AS event_time, moment + INTERVAL {1 + late} SECOND AS ingested_at, 'madrid' AS city_id,
        'k' || (user_id % 50) AS courier_id, 'o' || (event_id % 500) AS order_id,
        40.0::DOUBLE + CAST(event_id % 1000 AS DOUBLE) / 1000 AS latitude,
        -3.0::DOUBLE - CAST(user_id % 100 AS DOUBLE) / 100 AS longitude,
        CAST(event_id % 60 AS DOUBLE) AS speed_kmh, 5.0::DOUBLE AS accuracy_m FROM ev{where}"""


SQL["positions"] = _positions_sql(0, 1) + " UNION ALL " + _positions_sql(60, 1)
SQL["positions3"] = _positions_sql(0, 3) + " UNION ALL " + _positions_sql(60, 3)
SQL["pos"] = final_sql("positions", "courier_positions")
SQL["courier_latest"] = (
    "SELECT * FROM positions QUALIFY row_number() OVER (PARTITION BY simulation_run_id, city_id, courier_id "
    "ORDER BY event_time DESC, event_id DESC, ingested_at DESC) = 1"
)
_NEEDS |= {"positions": ["ev"], "positions3": ["ev"], "pos": ["positions"], "courier_latest": ["positions"]}

# order snapshots -----------------------------------------------------------------------------


def order_events(spark: SparkSession, sf_dir: str, runs: int = 1) -> DataFrame:
    c = F.col
    o = table(spark, sf_dir, "orders")
    status, courier = c("o_orderstatus"), tag("k", c("o_custkey") % 50)

    def step(n: int, name: str, days: int, who: Column, when: Column) -> Column:
        return F.when(when, F.struct(
            F.lit(n).alias("n"), F.lit(name).alias("status"), F.lit(days).alias("days"), who.alias("courier_id")
        ))

    none = F.lit(schemas.UNASSIGNED)
    steps = F.array_compact(F.array(
        step(0, "created", 0, none, F.lit(True)),
        step(1, "en_route", 1, courier, status.isin("P", "F")),
        step(2, "delivered", 2, courier, status == "F"),
        step(3, "cancelled", 1, none, (status == "O") & (c("o_orderkey") % 11 == 0)),
    ))
    moment = c("o_orderdate") + F.make_dt_interval(days=c("s.days"))
    return o.withColumn("s", F.explode(steps)).select(
        F.lit(1).cast("smallint").alias("schema_version"),
        F.concat(tag("oe", c("o_orderkey")), F.lit("-"), c("s.n").cast("string")).alias("event_id"),
        tag("run-", c("o_orderkey") % runs).alias("simulation_run_id"),
        moment.alias("event_time"),
        _late(moment, 2).alias("ingested_at"),
        F.lit("madrid").alias("city_id"),
        tag("o", c("o_orderkey")).alias("order_id"),
        c("s.courier_id").alias("courier_id"),
        tag("rest", c("o_orderkey") % 12).alias("restaurant_id"),
        c("s.status").alias("status"),
        F.round(c("o_totalprice") * 100).cast("int").alias("amount_minor"),
        F.lit("EUR").alias("currency"),
        *[F.lit(v).alias(n) for n, v in (("pickup_lat", 40.1), ("pickup_lon", -3.1), ("dropoff_lat", 40.2), ("dropoff_lon", -3.2))],
        c("o_orderdate").alias("order_created_at"),
        (c("o_orderdate") + F.make_dt_interval(days=F.lit(3))).alias("promised_delivery_at"),
        F.lit("shop").alias("source"),
        F.lit("synthetic").alias("source_kind"),
    )


def _order_events_sql(runs: int) -> str:
    def part(n: int, name: str, days: int, who: str, when: str) -> str:
        return f"""SELECT 'oe' || o_orderkey || '-{n}' AS event_id, 'run-' || (o_orderkey % {runs}) AS simulation_run_id,
        o_orderdate + INTERVAL {days} DAY AS event_time, 'madrid' AS city_id, 'o' || o_orderkey AS order_id, {who} AS courier_id,
        'rest' || (o_orderkey % 12) AS restaurant_id, '{name}' AS status, CAST(round(o_totalprice * 100) AS BIGINT) AS amount_minor,
        'EUR' AS currency, 40.2::DOUBLE AS dropoff_lat, -3.2::DOUBLE AS dropoff_lon, o_orderdate AS order_created_at,
        o_orderdate + INTERVAL 3 DAY AS promised_delivery_at FROM orders WHERE {when}"""

    none, courier = f"'{schemas.UNASSIGNED}'", "'k' || (o_custkey % 50)"
    return " UNION ALL ".join([
        part(0, "created", 0, none, "true"), part(1, "en_route", 1, courier, "o_orderstatus IN ('P', 'F')"),
        part(2, "delivered", 2, courier, "o_orderstatus = 'F'"),
        part(3, "cancelled", 1, none, "o_orderstatus = 'O' AND o_orderkey % 11 = 0"),
    ])


_LATEST_ORDER = (
    "SELECT * FROM {} QUALIFY row_number() OVER (PARTITION BY simulation_run_id, city_id, order_id "
    "ORDER BY event_time DESC, event_id DESC) = 1"
)
SQL["order_events"], SQL["order_events3"] = _order_events_sql(1), _order_events_sql(3)
SQL["order_latest"], SQL["order_latest3"] = _LATEST_ORDER.format("order_events"), _LATEST_ORDER.format("order_events3")
_NEEDS |= {"order_latest": ["order_events"], "order_latest3": ["order_events3"]}

# purchases -----------------------------------------------------------------------------------

_MODE = {"1-URGENT": "ollama", "2-HIGH": "manual"}


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    amount = F.round(c("o_totalprice") * 100).cast("int")
    line = F.struct(
        tag("prod", c("o_orderkey") % 36).alias("product_id"), F.lit(1).cast("smallint").alias("quantity"),
        F.when(c("o_orderkey") % 17 == 0, amount - 1).otherwise(amount).alias("unit_price_minor"),
    )
    o = _with_copies(table(spark, sf_dir, "orders"), 13, "o_orderkey")
    return o.select(
        F.lit(1).cast("smallint").alias("schema_version"),
        tag("p", c("o_orderkey")).alias("event_id"),
        F.lit(RUN).alias("simulation_run_id"),
        tag("o", c("o_orderkey")).alias("order_id"),
        tag("c", c("o_custkey")).alias("customer_id"),
        tag("s", c("o_orderkey") % 101).alias("session_id"),
        c("o_orderkey").cast("string").alias("checkout_event_id"),
        c("o_orderdate").alias("event_time"),
        (_late(c("o_orderdate"), 1) + F.make_dt_interval(secs=c("_late"))).alias("ingested_at"),
        tag("rest", c("o_orderkey") % 12).alias("restaurant_id"),
        F.array(line).alias("items"),
        amount.alias("amount_minor"),
        F.lit("EUR").alias("currency"),
        choose(c("o_orderpriority"), _MODE, "rules").alias("decision_mode"),
        F.when(c("o_orderpriority") == "2-HIGH", "demo_live").otherwise("synthetic").alias("source_kind"),
    )


SQL["buys"] = f"""SELECT 'p' || o_orderkey AS event_id, '{RUN}' AS simulation_run_id, 'o' || o_orderkey AS order_id,
    'c' || o_custkey AS customer_id, 's' || (o_orderkey % 101) AS session_id, CAST(o_orderkey AS VARCHAR) AS checkout_event_id,
    o_orderdate AS event_time, 'rest' || (o_orderkey % 12) AS restaurant_id, 'prod' || (o_orderkey % 36) AS product_id,
    CAST(round(o_totalprice * 100) AS BIGINT) AS amount_minor,
    CAST(round(o_totalprice * 100) AS BIGINT) - CASE WHEN o_orderkey % 17 = 0 THEN 1 ELSE 0 END AS basket_minor,
    {sql_choose('o_orderpriority', _MODE, 'rules')} AS decision_mode,
    CASE WHEN o_orderpriority = '2-HIGH' THEN 'demo_live' ELSE 'synthetic' END AS source_kind FROM orders"""

# browsing events -----------------------------------------------------------------------------

_APP_TYPE = {
    "signup": "search", "view": "restaurant_opened", "click": "product_opened", "purchase": "order_submitted",
    "error": "session_abandoned",
}


def app_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    e = _with_copies(ev(spark, sf_dir), 9, "event_id")
    kinds = F.array(*[F.lit(k) for k in schemas.SOURCE_KINDS])
    return e.select(
        F.lit(1).cast("smallint").alias("schema_version"),
        c("event_id").cast("string").alias("event_id"),
        tag("s", c("event_id") % 100).alias("session_id"),
        c("moment").alias("event_time"),
        F.to_date("moment").alias("event_date"),
        (_late(c("moment"), 1) + F.make_dt_interval(secs=c("_late"))).alias("ingested_at"),
        choose(c("event_type"), _APP_TYPE).alias("event_type"),
        tag("sec", c("k") % 4).alias("section"),
        tag("city", c("user_id") % 5).alias("city_id"),
        tag("u", c("user_id")).alias("user_id"),
        tag("rest", c("k") % 12).alias("restaurant_id"),
        tag("prod", c("k") % 36).alias("product_id"),
        F.when(c("event_id") % 3 == 0, "miniapp").otherwise("app").alias("source"),
        F.element_at(kinds, (c("event_id") % 4 + 1).cast("int")).alias("source_kind"),
        tag("rec", c("event_id")).alias("source_record_id"),
        F.lit(RUN).alias("simulation_run_id"),
        tag("o", c("event_id")).alias("order_id"),
    )


def _app_sql(late: int) -> str:
    where = " WHERE event_id % 9 = 0" if late else ""
    kinds = "[" + ", ".join(f"'{k}'" for k in schemas.SOURCE_KINDS) + "]"
    return f"""SELECT CAST(event_id AS VARCHAR) AS event_id, 's' || (event_id % 100) AS session_id, moment AS event_time,
        CAST(moment AS DATE) AS event_date, moment + INTERVAL {1 + late} SECOND AS ingested_at, {sql_choose('event_type', _APP_TYPE)} AS event_type,
        'sec' || (k % 4) AS section, 'city' || (user_id % 5) AS city_id,
        CASE WHEN event_id % 3 = 0 THEN 'miniapp' ELSE 'app' END AS source,
        {kinds}[event_id % 4 + 1] AS source_kind, '{RUN}' AS simulation_run_id, 'o' || event_id AS order_id FROM ev{where}"""


SQL["app_events"] = _app_sql(0) + " UNION ALL " + _app_sql(60)
SQL["app"] = final_sql("app_events", "app_events")
SQL["app_daily"] = (
    f"SELECT {', '.join(ROLLUP_KEYS)}, count(DISTINCT event_id) AS events FROM app_events GROUP BY ALL"
)
_NEEDS |= {"app_events": ["ev"], "app": ["app_events"], "app_daily": ["app_events"]}


def app_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact-ID states as the micro-batches of each day would have left them."""
    batches = app_events(spark, sf_dir).withColumn("batch_id", F.dayofmonth("ingested_at"))
    return id_rollup(batches, ["batch_id", *ROLLUP_KEYS], "event_id").drop("batch_id")


# demo catalog --------------------------------------------------------------------------------


def _versions(df: DataFrame) -> DataFrame:
    return df.withColumn("version", F.explode(F.array(F.lit(1).cast("bigint"), F.lit(2).cast("bigint"))))


def demo_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return _versions(table(spark, sf_dir, "part")).select(
        tag("prod", c("p_partkey")).alias("product_id"),
        tag("rest", c("p_partkey") % 12).alias("restaurant_id"),
        F.when(c("version") == 1, "old name").otherwise(c("p_name")).alias("product_name"),
        F.round(c("p_retailprice") * 100).cast("int").alias("price_minor"),
        F.lit("EUR").alias("currency"),
        F.lit("synthetic").alias("price_kind"),
        F.lit("synthetic").alias("name_kind"),
        F.lit(None).cast("string").alias("source_table"),
        F.lit(None).cast("int").alias("source_row"),
        "version",
    )


def demo_restaurants(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return _versions(table(spark, sf_dir, "supplier")).select(
        tag("rest", c("s_suppkey")).alias("restaurant_id"),
        F.when(c("version") == 1, "old name").otherwise(c("s_name")).alias("name"),
        F.lit("madrid").alias("city_id"),
        F.lit(40.4).alias("latitude"),
        F.lit(-3.7).alias("longitude"),
        F.lit("synthetic").alias("location_kind"),
        F.lit("synthetic").alias("source_kind"),
        "version",
    )


SQL["demo_products"] = (
    "SELECT 'prod' || p_partkey AS product_id, 'rest' || (p_partkey % 12) AS restaurant_id, p_name AS product_name, "
    "CAST(round(p_retailprice * 100) AS BIGINT) AS price_minor FROM part"
)
SQL["demo_restaurants"] = "SELECT 'rest' || s_suppkey AS restaurant_id, s_name AS name FROM supplier"

# delivery dataset ------------------------------------------------------------------------------

START, END = "1990-01-01", "2010-12-31"


def d_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "orders").select(
        c("o_orderkey").alias("order_id"), c("o_custkey").alias("user_id"), (c("o_orderkey") % 100).alias("restaurant_id"),
        (c("o_custkey") % 25).alias("area_id"), c("o_orderpriority").alias("price_band"),
        (c("o_orderdate") + F.make_dt_interval(hours=(c("o_orderkey") % 24).cast("int"))).alias("ordered_at"),
        F.lit("noon").alias("period_code"), F.to_date("o_orderdate").alias("order_date"),
    )


def d_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        F.to_date("l_shipdate").alias("order_date"), c("l_orderkey").alias("order_id"),
        c("l_linenumber").alias("position"), c("l_suppkey").alias("restaurant_id"),
    )


def d_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.to_date("l_shipdate").alias("order_date"), F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("food_id")
    )


def d_daily_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sum_rollup(d_clicks(spark, sf_dir), ["order_date", "restaurant_id"], "clicks")


def d_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    per_restaurant = d_clicks(spark, sf_dir).groupBy("order_id", "restaurant_id").agg(
        F.count(F.lit(1)).alias("_n"), F.max(F.struct("position", "order_date")).alias("_last")
    )
    summary = per_restaurant.groupBy("order_id").agg(
        F.sum("_n").cast("int").alias("click_count"), F.count(F.lit(1)).cast("int").alias("distinct_restaurants"),
        F.max_by("restaurant_id", F.struct("_last", "restaurant_id")).alias("last_clicked_restaurant_id"),
    )
    dates = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("order_id"), F.to_date("o_orderdate").alias("order_date"))
    return summary.join(dates, "order_id").select(
        "order_date", "order_id", "click_count", "distinct_restaurants", "last_clicked_restaurant_id"
    )


def d_restaurants(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "supplier").select(
        c("s_suppkey").alias("restaurant_id"), tag("cat", c("s_nationkey")).alias("category"),
        c("s_nationkey").cast("bigint").alias("area_id"), F.round(c("s_acctbal"), 2).alias("score"),
    )


SQL["d_orders"] = """SELECT o_orderkey AS order_id, o_custkey AS user_id, o_orderkey % 100 AS restaurant_id, o_orderpriority AS price_band,
    o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS ordered_at, CAST(o_orderdate AS DATE) AS order_date FROM orders"""
SQL["d_clicks"] = """SELECT CAST(l_shipdate AS DATE) AS order_date, l_orderkey AS order_id, l_linenumber AS position,
    l_suppkey AS restaurant_id FROM lineitem"""
SQL["d_summary"] = """SELECT CAST(any_value(o_orderdate) AS DATE) AS order_date, l_orderkey AS order_id, count(*) AS click_count,
    count(DISTINCT l_suppkey) AS distinct_restaurants,
    arg_max(l_suppkey, row(l_linenumber, l_shipdate, l_suppkey)) AS last_clicked_restaurant_id
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey"""
SQL["d_restaurants"] = "SELECT s_suppkey AS restaurant_id, 'cat' || s_nationkey AS category, round(s_acctbal, 2) AS score FROM supplier"

# product catalog -------------------------------------------------------------------------------


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    li, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    supplier, nation, region = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    stores = supplier.join(nation, c("s_nationkey") == c("n_nationkey")).join(region, c("n_regionkey") == c("r_regionkey"))
    described = c("l_linenumber") % 2 == 0
    return li.join(part, c("l_partkey") == c("p_partkey")).join(stores, c("l_suppkey") == c("s_suppkey")).select(
        (c("l_orderkey") * 10 + c("l_linenumber")).cast("int").alias("source_row"),
        F.upper(F.substring("r_name", 1, 2)).alias("country_code"),
        tag("C", c("n_nationkey")).alias("city_code"),
        c("s_name").alias("store_name"),
        c("p_name").alias("product_name"),
        F.when(c("p_size") > 5, c("p_type")).otherwise("").alias("collection_section"),
        F.when(described, c("p_brand")).otherwise("").alias("product_description"),
        described.cast("smallint").alias("has_description"),
        (c("l_returnflag") == "A").cast("smallint").alias("aux_store"),
        F.lit(0).cast("smallint").alias("hier"),
    )


SQL["catalog"] = """SELECT l_orderkey * 10 + l_linenumber AS source_row, upper(substr(r_name, 1, 2)) AS country_code,
    'C' || n_nationkey AS city_code, s_name AS store_name, p_name AS product_name,
    CASE WHEN p_size > 5 THEN p_type ELSE '' END AS collection_section,
    CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE 0 END AS has_description,
    CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS aux_store
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""

# marketplace -----------------------------------------------------------------------------------


def marketplace(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    kind = (
        F.when(c("l_returnflag") == "A", "view").when(c("l_returnflag") == "N", "cart")
        .when(c("l_linestatus") == "O", "purchase").otherwise("remove_from_cart")
    )
    return table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), c("l_partkey") == c("p_partkey")).select(
        c("l_shipdate").alias("event_time"), F.to_date("l_shipdate").alias("event_date"), kind.alias("event_type"),
        c("l_partkey").alias("product_id"), c("p_size").cast("bigint").alias("category_id"),
        F.when(c("p_size") < 4, "").otherwise(c("p_type")).alias("category_code"),
        F.when(c("p_size") % 10 == 0, "").otherwise(c("p_brand")).alias("brand"),
        c("l_extendedprice").cast("decimal(12,2)").alias("price"), c("l_suppkey").alias("user_id"),
        tag("s", c("l_orderkey")).alias("user_session"),
    )


SQL["market"] = """SELECT l_shipdate AS event_time, CAST(l_shipdate AS DATE) AS event_date,
    CASE WHEN l_returnflag = 'A' THEN 'view' WHEN l_returnflag = 'N' THEN 'cart' WHEN l_linestatus = 'O' THEN 'purchase'
    ELSE 'remove_from_cart' END AS event_type, CASE WHEN p_size < 4 THEN '' ELSE p_type END AS category_code,
    CASE WHEN p_size % 10 = 0 THEN '' ELSE p_brand END AS brand, l_suppkey AS user_id
    FROM lineitem JOIN part ON l_partkey = p_partkey"""

# recommendation samples ------------------------------------------------------------------------


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    hour, clicked = F.hour("ts"), (c("event_type") == "click").cast("smallint")
    meal = F.when(hour < 11, "breakfast").when(hour < 16, "lunch").otherwise("dinner")
    return ev(spark, sf_dir).select(
        F.lit("src").alias("source_id"), tag("file", c("user_id") % 4).alias("source_file"), c("event_id").alias("source_row"),
        (c("user_id") % 8 + 1).cast("smallint").alias("sample_day"), clicked.alias("clicked"),
        tag("u", c("user_id")).alias("user_id"), tag("shop", c("k")).alias("shop_id"), tag("city", c("user_id") % 20).alias("city_id"),
        hour.cast("smallint").alias("request_hour"), meal.alias("meal_period"),
        F.when(c("event_id") % 13 == 0, "bad").otherwise(F.unix_seconds("ts").cast("string")).alias("request_time_raw"),
        F.to_json(F.struct(clicked.cast("string").alias("clicked"), tag("u", c("user_id")).alias("user_id"))).alias("raw_features"),
    )


SQL["samples"] = """SELECT 'file' || (user_id % 4) AS source_file, event_id AS source_row, user_id % 8 + 1 AS sample_day,
    CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS clicked, 'city' || (user_id % 20) AS city_id, hour(ts) AS request_hour,
    CASE WHEN hour(ts) < 11 THEN 'breakfast' WHEN hour(ts) < 16 THEN 'lunch' ELSE 'dinner' END AS meal_period,
    CASE WHEN event_id % 13 = 0 THEN NULL ELSE epoch_ms(ts) // 1000 END AS unix FROM ev"""
_NEEDS["samples"] = ["ev"]

# advertising users -------------------------------------------------------------------------------


def uplift_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    treated, visit = c("l_linestatus") == "O", c("l_returnflag") != "R"
    flag = lambda cond: cond.cast("smallint")
    return table(spark, sf_dir, "lineitem").select(
        flag(treated).alias("treatment"), flag(visit & (c("l_discount") >= 0.05)).alias("conversion"),
        flag(visit).alias("visit"), flag(treated & (c("l_quantity") > 10)).alias("exposure"),
    )


SQL["users"] = """SELECT CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS treatment,
    CASE WHEN l_returnflag <> 'R' AND l_discount >= 0.05 THEN 1 ELSE 0 END AS conversion,
    CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END AS visit,
    CASE WHEN l_linestatus = 'O' AND l_quantity > 10 THEN 1 ELSE 0 END AS exposure FROM lineitem"""

# e-commerce archive ------------------------------------------------------------------------------

_ARCHIVE_TYPE = {"view": "clicks", "click": "clicks", "purchase": "orders"}


def archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return ev(spark, sf_dir).select(
        c("user_id").alias("session_id"), c("k").alias("article_id"), c("moment").alias("event_time"),
        choose(c("event_type"), _ARCHIVE_TYPE, "carts").alias("event_type"), F.lit(0).alias("event_position"),
    )


SQL["archive"] = (
    f"SELECT user_id AS session_id, k AS article_id, moment AS event_time, {sql_choose('event_type', _ARCHIVE_TYPE, 'carts')} "
    "AS event_type FROM ev"
)
_NEEDS["archive"] = ["ev"]

# first application ---------------------------------------------------------------------------------

_SECCION = {"signup": "busqueda", "view": "restaurante", "click": "carrito", "error": "pago", "purchase": "pedido"}


def first_app(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return ev(spark, sf_dir).select(
        c("event_id").cast("string").alias("event_id"), c("moment").alias("ts"),
        F.concat(tag("s", c("user_id")), F.lit("-"), F.date_format("ts", "yyyyMMdd")).alias("session_id"), "user_id",
        F.when(c("user_id") % 2 == 0, "app_real").otherwise("simulado").alias("origen"),
        choose(c("event_type"), _SECCION).alias("seccion"), c("event_type").alias("accion"),
        tag("q", c("k") % 20).alias("busqueda"), tag("d", c("k") % 3).alias("dispositivo"), tag("x", c("user_id") % 5).alias("distrito"),
        c("event_id").alias("n"),
    )


SQL["first_app"] = f"""SELECT event_id AS n, moment AS ts, 's' || user_id || '-' || strftime(ts, '%Y%m%d') AS session_id, user_id,
    CASE WHEN user_id % 2 = 0 THEN 'app_real' ELSE 'simulado' END AS origen, {sql_choose('event_type', _SECCION)} AS seccion,
    'q' || (k % 20) AS busqueda, 'd' || (k % 3) AS dispositivo, 'x' || (user_id % 5) AS distrito FROM ev"""
_NEEDS["first_app"] = ["ev"]


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
