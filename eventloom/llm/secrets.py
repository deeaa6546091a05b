"""Secrets in text, judged by who owns the documents that hold them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.session import stage_once

#: What each kind matches; letters of the keywords count in either case.
ASSIGN = (
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{32,}"
#: Bare strings that become spans only if the corpus shows them to belong to one owner.
BARE = "[A-Za-z0-9+/_-]{20,}={0,2}"
KINDS = ("assign", "access", "hex", "token")
MIN_ASSIGN, MIN_ACCESS = 8, 16
#: A value with this many owners, or in this many repositories of whomever, is a copied example.
COPIED_OWNERS, COPIED_REPOSITORIES = 3, 4
#: A value is owner-specific if one owner has it, in this many repositories at most.
OWN_REPOSITORIES = 2
#: Matches of one text whose places are summed up together.
RUN = 256


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body's lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _matches(pattern: str, group: int, kind: str, keep) -> Column:
    """Array of (start, stop, kind, value) of the leftmost non-overlapping matches, in code points.

    ``split`` yields the text between the same matches, so summed lengths give their places.
    """
    text = F.col("text")
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    between = F.split(text, pattern, -1)
    items = F.filter(
        F.arrays_zip(whole.alias("whole"), value.alias("value"), between.alias("gap")), lambda i: i["whole"].isNotNull(),
    )
    sizes = F.transform(items, lambda i: F.struct(F.length(i["gap"]).alias("gap"), F.length(i["whole"]).alias("whole"), i["value"].alias("value")))
    # Places are summed up within runs of matches and over the runs: an array that grows match by match would be
    # copied as often as there are matches.
    cut = lambda sizes: F.transform(
        F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / RUN).cast("int")), lambda r: F.slice(sizes, r * RUN + 1, F.lit(RUN)),
    )
    begins = lambda runs: F.aggregate(
        F.transform(runs, lambda run: F.aggregate(run, F.lit(0), lambda n, i: n + i["gap"] + i["whole"])),
        F.array(F.lit(0)), lambda done, n: F.concat(done, F.array(F.element_at(done, -1) + n)),
    )

    def step(state, item):
        start = state["at"] + item["gap"]
        stop = start + item["whole"]
        span = F.struct(start.alias("start"), stop.alias("stop"), F.lit(KINDS.index(kind)).alias("kind"), item["value"].alias("value"))
        return F.struct(stop.alias("at"), F.concat(state["found"], F.array(span)).alias("found"))

    none = F.array().cast("array<struct<start:int,stop:int,kind:int,value:string>>")
    found = _let(sizes, lambda z: _let(cut(z), lambda runs: _let(begins(runs), lambda starts: F.flatten(
        F.transform(runs, lambda run, i: F.aggregate(run, F.struct(F.get(starts, i).alias("at"), none.alias("found")), step)["found"]),
    ))))
    return F.when(text.rlike(pattern), F.filter(found, keep)).otherwise(none)


def live_looking(value: Column) -> Column:
    """A string as issued by a machine: 16 characters or more, digits and letters, at least 8 different ones."""
    return (F.length(value) >= 16) & value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= 8)


def _count(ordered: Column, value: Column, equal: bool) -> Column:
    """How many entries of an ascending array are less than ``value`` (or equal to it), by halving."""
    def step(state, _):
        middle = F.floor((state["low"] + state["high"]) / 2).cast("int")
        there = F.get(ordered, middle)
        less = (there <= value) if equal else (there < value)
        open_ = state["low"] < state["high"]
        return F.struct(
            F.when(open_ & less, middle + 1).otherwise(state["low"]).alias("low"), F.when(open_ & ~less, middle).otherwise(state["high"]).alias("high"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.ceil(F.log2(F.size(ordered) + 1)).cast("int") + 1), F.struct(F.lit(0).alias("low"), F.size(ordered).alias("high")), step)["low"]


def _free(spans: Column, starts: Column, stops: Column) -> Column:
    """The spans that overlap none of others, given by their ascending starts and ascending stops."""
    return _let(F.struct(starts.alias("starts"), stops.alias("stops")), lambda o: F.filter(
        spans, lambda t: _count(o["starts"], t["stop"], equal=False) == _count(o["stops"], t["start"], equal=True),
    ))


def written(spans: Column) -> Column:
    """kind:start:end of every span, by start and then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["stop"])))
    return F.array_join(
        F.transform(ordered, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["stop"].cast("string"))), ",",
    )


def find_secrets(
    docs: DataFrame, owner: str = "source", repository: tuple[str, ...] = ("source", "lang"), copied_owners: int = COPIED_OWNERS,
    copied_repositories: int = COPIED_REPOSITORIES, own_repositories: int = OWN_REPOSITORIES,
) -> DataFrame:
    """(doc_id, base, spans, live, copied) for every row of ``docs``: arrays of (start, stop, kind, value).

    ``base`` holds what the three base patterns find. Every base value and every bare machine-made string is a
    candidate; its hash is counted over the whole corpus by distinct repositories and owners. Values of
    ``copied_owners`` owners or more, or in ``copied_repositories`` repositories or more, also of one owner, are
    ``copied`` examples. Live-looking values of a single owner, in at most ``own_repositories`` repositories, are
    ``live``. What lies between (two owners, or one with some more repositories) is neither. Bare strings that are live
    become spans of kind ``token``, in addition to the base spans. Base spans always stay.

    NULL and empty texts have no spans; a NULL owner or repository part counts as the empty name. Repeated
    rows repeat in the result and add no owner. ``doc_id`` may be NULL or repeat; columns other than
    ``doc_id``, ``text``, the owner and the repository's are not read; an empty table gives no rows.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), name(owner).alias("owner"),
        F.struct(name(owner).alias("owner"), *[name(c).alias(f"part{i}") for i, c in enumerate(repository)]).alias("repository"),
    )
    base = F.concat(
        _matches(ASSIGN, 2, "assign", lambda s: F.length(s["value"]) >= MIN_ASSIGN),
        _matches(ACCESS, 0, "access", lambda s: F.length(s["value"]) >= MIN_ACCESS),
        _matches(HEX, 0, "hex", lambda s: F.lit(True)),
    )
    bare = _matches(BARE, 0, "token", lambda s: live_looking(s["value"]))
    scanned = rows.select("doc_id", "owner", "repository", base.alias("base"), bare.alias("bare")).withColumn(
        "bare", _free(F.col("bare"), F.array_sort(F.col("base.start")), F.array_sort(F.col("base.stop"))),
    )
    scanned = stage_once(scanned.withColumn("row_id", F.monotonically_increasing_id()), "secrets")
    candidates = scanned.select("row_id", "owner", "repository", F.explode(F.concat("base", "bare")).alias("span"))
    candidates = candidates.withColumn("hash", F.sha2("span.value", 256))
    spread = candidates.groupBy("hash", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    spread = spread.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repositories"))
    spread = stage_once(
        spread.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories")), "ownership",
    )
    known = candidates.select("row_id", "span", "hash").join(spread, "hash")
    is_live = (F.col("owners") == 1) & (F.col("repositories") <= own_repositories) & live_looking(F.col("span.value"))
    is_copied = (F.col("owners") >= copied_owners) | (F.col("repositories") >= copied_repositories)
    judged = known.groupBy("row_id").agg(
        F.collect_list(F.when(is_live & (F.col("span.kind") == KINDS.index("token")), F.col("span"))).alias("added"),
        F.collect_list(F.when(is_live, F.col("span"))).alias("live"),
        F.collect_list(F.when(is_copied, F.col("span"))).alias("copied"),
    )
    empty = F.array().cast("array<struct<start:int,stop:int,kind:int,value:string>>")
    return scanned.select("row_id", "doc_id", "base").join(stage_once(judged, "judged"), "row_id", "left").select(
        "doc_id", "base", F.concat("base", F.coalesce("added", empty)).alias("spans"),
        F.coalesce("live", empty).alias("live"), F.coalesce("copied", empty).alias("copied"),
    )
