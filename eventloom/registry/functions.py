"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom import schemas
from eventloom.functions import scalars as S
from eventloom.functions.aggregates import any_or_default, avg_if, distinct_if, sum_if
from eventloom.operators.topk import latest_chronological, top_k
from eventloom.registry import query
from eventloom.registry.views import app_events, day, ev, ms, plain, table, tag, with_sql


@query("time_functions", with_sql("ev") + f"""SELECT event_id, {day('moment')} AS date, CAST(strftime(moment, '%Y%m') AS BIGINT) AS month_key,
    CAST(strftime(moment, '%Y%m%d') AS BIGINT) AS day_key, hour(moment) AS hour, {ms("date_trunc('minute', moment)")} AS minute, {ms("date_trunc('hour', moment)")} AS hour_start,
    {ms("make_timestamp(epoch_ms(moment) // 5000 * 5000000)")} AS slot, epoch_ms(moment) AS millis, {ms("moment + to_days(CAST(k AS INTEGER))")} AS shifted FROM ev""")
def time_functions(spark, sf_dir):
    return plain(ev(spark, sf_dir).select(
        "event_id", F.to_date("moment").alias("date"), S.month_key("moment").alias("month_key"), S.day_key("moment").alias("day_key"),
        F.hour("moment").alias("hour"), F.date_trunc("MINUTE", "moment").alias("minute"), F.date_trunc("HOUR", "moment").alias("hour_start"),
        S.interval_start("moment", 5).alias("slot"), F.unix_millis("moment").alias("millis"), S.plus_days("moment", F.col("k")).alias("shifted"),
    ))


@query("time_differences", """SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, epoch_ms(l_shipdate) - epoch_ms(o_orderdate) AS millis,
    epoch_ms(l_shipdate) // 1000 - epoch_ms(o_orderdate) // 1000 AS seconds FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def time_differences(spark, sf_dir):
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return plain(joined.select(
        "l_orderkey", "l_linenumber", "l_partkey", S.millis_between("o_orderdate", "l_shipdate").alias("millis"),
        S.seconds_between("o_orderdate", "l_shipdate").alias("seconds"),
    ))


@query("json_extract", with_sql("ev") + "SELECT event_id, CAST(k AS VARCHAR) AS k, '' AS missing FROM ev")
def json_extract(spark, sf_dir):
    return plain(table(spark, sf_dir, "events").select(
        "event_id", S.json_text("props", "k").alias("k"), S.json_text("props", "other").alias("missing")
    ))


@query("parse_times", with_sql("ev") + f"""SELECT event_id, {ms("date_trunc('second', moment)")} AS zoned, {day('moment')} AS compact, CAST(NULL AS VARCHAR) AS bad FROM ev""")
def parse_times(spark, sf_dir):
    e = ev(spark, sf_dir)
    return plain(e.select(
        "event_id", S.parse_time(F.concat(F.date_format("moment", "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))).alias("zoned"),
        S.compact_date(F.date_format("moment", "yyyyMMdd")).alias("compact"),
        S.parse_time(F.concat(F.lit("x"), F.col("k").cast("string"))).cast("string").alias("bad"),
    ))


@query("clean_numbers", """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size ELSE 0 END::BIGINT AS digits,
    CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS BIGINT) END AS unsigned, CASE WHEN p_size % 3 <> 0 THEN round(p_retailprice, 6) END AS number FROM part""")
def clean_numbers(spark, sf_dir):
    c = F.col
    text = F.when(c("p_size") % 2 == 0, c("p_size").cast("string")).otherwise(F.concat(F.lit("-"), c("p_size").cast("string")))
    price = F.when(c("p_size") % 3 == 0, "n/a").otherwise(c("p_retailprice").cast("string"))
    return plain(table(spark, sf_dir, "part").select(
        "p_partkey", S.digits_or_zero(text).alias("digits"), S.unsigned_or_null(text).alias("unsigned"), S.number_or_null(price).alias("number")
    ))


@query("text_functions", """SELECT c_custkey, substr(c_name, 1, 8) AS head, c_name LIKE 'Customer%' AS starts, c_name ILIKE '%CUSTOMER%' AS holds,
    c_mktsegment || '/' || c_nationkey AS joined, sha256(c_name) AS sha, md5(c_name) AS md5 FROM customer""")
def text_functions(spark, sf_dir):
    c = F.col
    return plain(table(spark, sf_dir, "customer").select(
        "c_custkey", F.substring("c_name", 1, 8).alias("head"), F.startswith("c_name", F.lit("Customer")).alias("starts"),
        c("c_name").ilike("%CUSTOMER%").alias("holds"), F.concat("c_mktsegment", F.lit("/"), c("c_nationkey").cast("string")).alias("joined"),
        F.sha2("c_name", 256).alias("sha"), F.md5("c_name").alias("md5"),
    ))


@query("money", "SELECT o_orderkey, round(CAST(round(o_totalprice * 100) AS BIGINT) / 100.0, 2) AS euros FROM orders")
def money(spark, sf_dir):
    minor = F.round(F.col("o_totalprice") * 100).cast("bigint")
    return plain(table(spark, sf_dir, "orders").select("o_orderkey", S.euros(minor).alias("euros")), 2)


@query("sizes_and_ratios", """SELECT l_orderkey % 1000 AS bucket, count(*) AS n, round_even(CAST(count(*) FILTER (WHERE l_returnflag = 'A') AS DOUBLE) * 100 / count(*), 2) AS share_pct,
    CAST(NULL AS DOUBLE) AS empty_pct FROM lineitem GROUP BY 1""")
def ratios(spark, sf_dir):
    out = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 1000).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "A").alias("a")
    )
    return plain(out.select(
        "bucket", "n", S.share_pct(F.col("a"), F.col("n")).alias("share_pct"), S.share_pct(F.col("a"), F.lit(0)).alias("empty_pct")
    ))


@query("enum_order", with_sql("app_events") + f"""SELECT source_kind, count(*) AS rows, list_position({schemas.SOURCE_KINDS}, source_kind)::BIGINT AS code
    FROM app_events GROUP BY 1""")
def enum_order(spark, sf_dir):
    """Enumerated values order by their stored code."""
    counts = app_events(spark, sf_dir).groupBy("source_kind").agg(F.count(F.lit(1)).alias("rows"))
    return plain(counts.withColumn("code", schemas.enum_rank("source_kind", schemas.SOURCE_KINDS)).orderBy("code"))


@query("distinct_if", with_sql("ev") + f"""SELECT {day('CAST(moment AS DATE)')} AS day, count(DISTINCT user_id) AS users,
    count(DISTINCT user_id) FILTER (WHERE event_type = 'purchase') AS buyers, count(DISTINCT row(user_id, event_type)) AS pairs,
    CAST(coalesce(sum(k) FILTER (WHERE event_type = 'click'), 0) AS BIGINT) AS click_k, round(avg(value) FILTER (WHERE event_type = 'view'), 6) AS view_value
    FROM ev GROUP BY 1""")
def conditional(spark, sf_dir):
    kind = F.col("event_type")
    return plain(ev(spark, sf_dir).groupBy(F.to_date("moment").alias("day")).agg(
        F.count_distinct("user_id").alias("users"), distinct_if(F.col("user_id"), kind == "purchase").alias("buyers"),
        F.count_distinct("user_id", "event_type").alias("pairs"), sum_if(F.col("k"), kind == "click").alias("click_k"),
        avg_if(F.col("value"), kind == "view").alias("view_value"),
    ))


@query("any_value_per_user", with_sql("ev") + "SELECT user_id, arg_min(event_type, row(moment, event_id)) AS first_type FROM ev GROUP BY 1")
def any_per_user(spark, sf_dir):
    return plain(ev(spark, sf_dir).groupBy("user_id").agg(
        any_or_default(F.col("event_type"), F.struct("moment", "event_id"), "").alias("first_type")
    ))


@query("having_filter", with_sql("ev") + "SELECT user_id, count(*) AS events FROM ev GROUP BY 1 HAVING count(*) FILTER (WHERE event_type = 'purchase') > 10")
def having(spark, sf_dir):
    return plain(ev(spark, sf_dir).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("event_type") == "purchase").alias("_p")
    ).filter("_p > 10").drop("_p"))


@query("group_five_keys", """SELECT l_returnflag, l_linestatus, l_linenumber::BIGINT AS l_linenumber, CAST(l_quantity AS BIGINT) AS quantity, l_suppkey % 10 AS shard, count(*) AS n,
    CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM lineitem GROUP BY ALL""")
def five_keys(spark, sf_dir):
    c = F.col
    return plain(table(spark, sf_dir, "lineitem").groupBy(
        "l_returnflag", "l_linestatus", "l_linenumber", c("l_quantity").cast("bigint").alias("quantity"), (c("l_suppkey") % 10).alias("shard")
    ).agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(c("l_extendedprice") * 100).cast("bigint")).alias("cents")))


@query("top_k_ties", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_suppliers(spark, sf_dir):
    return plain(top_k(table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n")), "n", 10, "l_suppkey"))


@query("latest_chronological", with_sql("ev") + f"SELECT event_id, event_type, {ms('moment')} AS moment FROM ev ORDER BY ev.moment DESC, event_id DESC LIMIT 240")
def chronological(spark, sf_dir):
    return plain(latest_chronological(ev(spark, sf_dir).select("event_id", "event_type", "moment"), 240, "moment", "event_id"))


@query("name_identities", """WITH h AS (SELECT c_custkey, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(c_name)) AS h FROM customer)
    SELECT c_custkey, concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), '5' || substr(h, 14, 3),
    substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3), substr(h, 21, 12)) AS identity FROM h""")
def name_identities(spark, sf_dir):
    """Deterministic identities; the namespace is the published DNS one."""
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", S.name_uuid("6ba7b810-9dad-11d1-80b4-00c04fd430c8", F.col("c_name")).alias("identity"))


@query("distance_metres", with_sql("ev") + """SELECT event_id, round(sqrt(pow(((40 + (event_id % 1000) / 1000.0) - 40.4) * 111320, 2)
    + pow((-3.7 + 3.0 + (user_id % 100) / 100.0) * 111320 * cos(radians(((40 + (event_id % 1000) / 1000.0) + 40.4) / 2)), 2)), 2) AS metres FROM ev""")
def distance(spark, sf_dir):
    c = F.col
    lat, lon = F.lit(40.0) + (c("event_id") % 1000) / 1000, F.lit(-3.0) - (c("user_id") % 100) / 100
    return plain(ev(spark, sf_dir).select("event_id", S.metres_between(lat, lon, F.lit(40.4), F.lit(-3.7)).alias("metres")), 2)


@query("readable_sizes", """SELECT doc_id, CASE WHEN n_chars >= 1048576 THEN format('{:,.2f}', n_chars / 1048576.0::DOUBLE) || ' GiB'
    WHEN n_chars >= 1024 THEN format('{:,.2f}', n_chars / 1024.0::DOUBLE) || ' MiB' WHEN n_chars >= 1 THEN format('{:,.2f}', n_chars::DOUBLE) || ' KiB'
    ELSE '0.00 B' END AS size FROM documents""")
def readable_sizes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.readable_size(F.col("n_chars") * 1024).alias("size"))


@query("map_lookup", with_sql("ev") + "SELECT event_id, k AS hits, 0::BIGINT AS missing FROM ev")
def map_lookup(spark, sf_dir):
    counters = F.create_map(F.lit("hits"), F.col("k"))
    return plain(ev(spark, sf_dir).select(
        "event_id", S.map_value(counters, "hits").alias("hits"), S.map_value(counters, "other").alias("missing")
    ))


@query("plausible_points", """SELECT count(*) FILTER (WHERE v BETWEEN -90 AND 90) AS plausible, count(*) AS points FROM (SELECT value AS v FROM events)""")
def plausible(spark, sf_dir):
    """Values read as latitudes; most are off the globe."""
    e = table(spark, sf_dir, "events")
    ok = S.plausible_coordinate(F.col("value"), F.lit(0.0))
    return plain(e.agg(F.count_if(ok).alias("plausible"), F.count(F.lit(1)).alias("points")))


@query("uuid_check", "SELECT count(*) AS identities, count(*) AS valid, 0::BIGINT AS names_valid FROM customer")
def uuid_check(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    made = S.name_uuid("6ba7b810-9dad-11d1-80b4-00c04fd430c8", tag("c", F.col("c_custkey")))
    return plain(c.agg(
        F.count_distinct(made).alias("identities"), F.count_if(S.is_uuid(made)).alias("valid"), F.count_if(S.is_uuid("c_name")).alias("names_valid")
    ))
