"""Web-archive records: revisits answered "not modified" resolved to the response they stand for."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventloom.llm.urlgraph import lower_ascii
from eventloom.session import stage_once

#: Header fields that a 304 answer may update; all others stay as the full response gave them.
UPDATED_HEADERS = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that name the visitor's way to the page, not the page.
TRACKING = "utm_[a-z]+|gclid|fbclid|ref"
#: Time slots that a URL's records are split into, so that one very common URL is worked on by many tasks.
SLOTS = 512


def canonical_url(url: Column) -> Column:
    """One form for addresses of one page.

    The scheme, ``www.``, user data, the default ports, the fragment, tracking parameters and slashes at the
    end of the path go; A-Z in the host are lower-cased. What has no ``://`` stays as it is.
    """
    rest = F.regexp_replace(F.regexp_replace(url, r"^[^:/?#]*://", ""), r"#[\s\S]*$", "")
    host = lower_ascii(F.regexp_extract(rest, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":(80|443)?$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(rest, r"^[^?]*\?([\s\S]*)$", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(rf"^({TRACKING})(=|$)")), "&")
    return F.when(F.instr(url, "://") > 0, F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))).otherwise(url)


def _weak(etag: Column) -> Column:
    """An entity tag as weak comparison sees it."""
    return F.regexp_replace(F.trim(etag), "^W/", "")


def lowered_headers(headers: Column) -> Column:
    """Headers with names in lower case; of names that differ in case only the one that sorts first counts. NULL is empty."""
    entries = F.array_sort(F.transform(
        F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("name"), e["key"].alias("key"), e["value"].alias("value")),
    ))
    # The inner array is bound once, so that its elements can be compared with their predecessors.
    firsts = F.transform(F.array(entries), lambda z: F.filter(z, lambda e, i: (i == 0) | (F.get(z, i - 1)["name"] != e["name"])))[0]
    plain = F.map_from_entries(F.transform(firsts, lambda e: F.struct(e["name"].alias("key"), e["value"].alias("value"))))
    return F.coalesce(plain, F.create_map().cast("map<string,string>"))


def merged_headers(stored: Column, fresh: Column) -> Column:
    """Headers of the stored response, with the permitted ones of the 304 answer in their place; names in lower case."""
    update = F.filter(F.map_entries(fresh), lambda e: e["key"].isin(*UPDATED_HEADERS))
    names = F.transform(update, lambda e: e["key"])
    stays = F.filter(F.map_entries(stored), lambda e: ~F.array_contains(names, e["key"]))
    return F.map_from_entries(F.array_sort(F.concat(stays, update)))


def resolve_revisits(records: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Every revisit of ``records`` with the response it stands for.

    ``records``: ``record_id`` BIGINT, ``kind`` ('response' or 'revisit'), ``url``, ``time`` BIGINT,
    ``status`` INT, ``headers`` MAP<STRING, STRING> (names in any case, see ``lowered_headers``), ``digest``. The result has, per revisit,
    ``record_id``, ``canonical_url``, ``outcome``, ``resolved_id``, ``digest`` (of the stored body),
    ``headers`` (merged; the revisit's own if unresolved).

    A revisit is matched as of its time to the latest strictly earlier full response (status 200) with its
    canonical URL; at one time the greatest ``record_id`` counts. ``outcome`` is 'resolved' if the validators
    agree: equal entity tags by weak comparison if both have one, else equal Last-Modified dates. Otherwise it
    is 'mismatch', or 'no_validator' where neither pair can be compared, or 'no_response' without an earlier
    response. A NULL url or time matches nothing; NULL headers are empty; repeated records stay, each with its
    answer. Other columns are not read. No records give no rows.

    One URL's records are split into ``slots`` ranges of time, cut at quantiles so that a few times far off do not empty
    the others: a range looks back within itself, and only its first revisits take what the last earlier range left, one
    row per URL and range.
    """
    rows = records.select(
        "record_id", "kind", canonical_url(F.col("url")).alias("canonical_url"), F.col("time").cast("long").alias("time"), "status",
        lowered_headers(F.col("headers")).alias("headers"), "digest",
    )
    found = records.select(F.col("time").cast("long").alias("time")).approxQuantile("time", [i / slots for i in range(1, slots)], 0.25 / slots) if slots > 1 else []
    splits = [-float("inf"), *(sorted(set(found)) or [0.0]), float("inf")]
    full = (F.col("kind") == "response") & (F.col("status") == 200) & F.col("canonical_url").isNotNull() & F.col("time").isNotNull()
    answer = F.struct("time", "record_id", "digest", "headers")
    rows = rows.filter(full | (F.col("kind") == "revisit")).withColumn("_at", F.col("time").cast("double"))
    rows = Bucketizer(splits=splits, inputCol="_at", outputCol="slot", handleInvalid="keep").transform(rows).drop("_at")
    rows = rows.withColumn("answer", F.when(full, answer))
    key = ["canonical_url", "slot"]
    # Rows of one time stand together in the frame, and a range frame up to the moment before leaves them out.
    # NULL urls and times match nothing: they skip the windows.
    known = rows.filter("canonical_url IS NOT NULL AND time IS NOT NULL")
    earlier = Window.partitionBy(*key).orderBy("time").rangeBetween(Window.unboundedPreceding, -1)
    order = F.when(F.col("answer").isNotNull(), F.struct("time", "record_id"))
    looked = known.withColumn("found", F.max_by("answer", order).over(earlier)).filter("kind = 'revisit'").drop("answer")
    left = known.filter("answer IS NOT NULL").groupBy(*key).agg(F.max_by("answer", F.struct("time", "record_id")).alias("last"))
    asked = known.filter("kind = 'revisit'").select(*key).distinct()
    before = Window.partitionBy("canonical_url").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = asked.join(left, key, "full_outer").withColumn("carried", F.last("last", ignorenulls=True).over(before))
    carried = stage_once(carried.filter("carried IS NOT NULL").select(*key, "carried"), "carried")
    found = looked.join(carried, key, "left").withColumn("found", F.coalesce("found", "carried")).drop("carried", "slot")
    lost = rows.filter("kind = 'revisit' AND (canonical_url IS NULL OR time IS NULL)").drop("answer", "slot")
    found = found.unionByName(lost, allowMissingColumns=True)
    mine, stored = F.col("headers"), F.col("found.headers")
    both = lambda name: mine[name].isNotNull() & stored[name].isNotNull()
    agree = F.when(both("etag"), _weak(mine["etag"]) == _weak(stored["etag"])).when(
        both("last-modified"), mine["last-modified"] == stored["last-modified"],
    )
    outcome = F.when(F.col("found").isNull(), "no_response").when(agree.isNull(), "no_validator").when(agree, "resolved").otherwise("mismatch")
    judged = found.withColumn("outcome", outcome)
    resolved = F.col("outcome") == "resolved"
    return judged.select(
        "record_id", "canonical_url", "outcome", F.when(resolved, F.col("found.record_id")).alias("resolved_id"),
        F.when(resolved, F.col("found.digest")).alias("digest"),
        F.when(resolved, merged_headers(stored, mine)).otherwise(mine).alias("headers"),
    )


def crawl_records(pages: DataFrame) -> DataFrame:
    """Records of two crawls of a ``pages`` table (``page_id``, ``url``, ``html``).

    Every page was stored in full at 1000 times its id. Every page was asked for again, half a round later,
    with a validator: by its id, the stored tag, its weak form, the date only, a tag that has changed, none
    at all, or (asked for before anything was stored) the tag too early.
    """
    tag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))
    day = F.concat(F.lit("day "), F.floor(F.col("page_id") / 7).cast("string"))
    form = F.pmod("page_id", F.lit(6))
    text = lambda c: F.col(c).cast("string") if isinstance(c, str) else c
    stored = F.create_map(
        F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), F.length(F.coalesce("html", F.lit(""))).cast("string"),
        F.lit("etag"), tag, F.lit("last-modified"), day, F.lit("date"), text("page_id"), F.lit("cache-control"), F.lit("max-age=60"),
    )
    validator = F.when(form == 1, F.concat(F.lit("W/"), tag)).when(form == 2, F.lit(None)).when(form == 3, F.lit('"changed"')).when(
        form == 4, F.lit(None),
    ).otherwise(tag)
    fresh = F.map_filter(
        F.create_map(
            F.lit("etag"), validator, F.lit("last-modified"), F.when(form == 2, day), F.lit("date"), F.concat(F.lit("again "), text("page_id")),
            F.lit("content-length"), F.lit("0"), F.lit("expires"), F.lit("never"),
        ), lambda _, v: v.isNotNull(),
    )
    digest = F.md5(F.coalesce("html", F.lit("")))
    response = F.struct(
        (F.col("page_id") * 2).alias("record_id"), F.lit("response").alias("kind"), (F.col("page_id") * 1000).alias("time"),
        F.lit(200).alias("status"), stored.alias("headers"), digest.alias("digest"),
    )
    revisit = F.struct(
        (F.col("page_id") * 2 + 1).alias("record_id"), F.lit("revisit").alias("kind"),
        (F.col("page_id") * 1000 + F.when(form == 5, -500).otherwise(500)).alias("time"),
        F.lit(304).alias("status"), fresh.alias("headers"), F.lit(None).cast("string").alias("digest"),
    )
    return pages.select("url", F.explode(F.array(response, revisit)).alias("r")).select("url", "r.*")
