"""Event contracts: rules, quarantine, canonical digests, batch acceptance, baskets.

A contract is a list of ``(reason, broken)`` pairs. All rules are evaluated in one
projection, so validation never shuffles and reports every broken rule of a row.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from eventloom import schemas
from eventloom.functions.scalars import is_uuid
from eventloom.session import pin, stage_once

Rule = tuple[str, Column]

# --- fixed values: field sets, limits and conditional requirements --------------------
APP_REQUIRED = [
    "schema_version", "event_id", "session_id", "event_time", "event_type", "section", "city_id", "source",
    "source_kind",
]
APP_OPTIONAL = ["user_id", "restaurant_id", "product_id", "source_record_id", "simulation_run_id", "order_id"]
TELEMETRY_COMMON = [
    "schema_version", "event_id", "simulation_run_id", "event_time", "city_id", "courier_id", "order_id", "source",
    "source_kind",
]
TELEMETRY_FIELDS = {
    "courier_positions": [*TELEMETRY_COMMON, "latitude", "longitude", "speed_kmh", "accuracy_m"],
    "order_events": [
        *TELEMETRY_COMMON, "restaurant_id", "status", "amount_minor", "currency", "pickup_lat", "pickup_lon",
        "dropoff_lat", "dropoff_lon", "order_created_at", "promised_delivery_at",
    ],
}
NEEDS_RESTAURANT = [
    "restaurant_opened", "product_opened", "product_impression", "cart_added", "cart_removed", "order_submitted",
]
NEEDS_PRODUCT = ["product_opened", "product_impression", "cart_added", "cart_removed"]
MAX_TEXT = 160
MAX_AMOUNT_MINOR = 1_000_000
MAX_SPEED_KMH = 150
MAX_ACCURACY_M = 10_000
EARLIEST = "2000-01-01 00:00:00"
FUTURE_SECONDS = 300
MAX_LINES, MAX_UNITS, MAX_QUANTITY = 20, 20, 10


def check(df: DataFrame, rules: Sequence[Rule], reasons: str = "reasons") -> DataFrame:
    """Add the list of broken rules per row; a rule that cannot be decided is broken."""
    broken = F.array(*[F.when(F.coalesce(cond, F.lit(True)), F.lit(reason)) for reason, cond in rules])
    return df.withColumn(reasons, F.array_compact(broken))


def validate(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """Valid rows and the quarantine with reasons."""
    checked = check(df, rules)
    return checked.filter(F.size("reasons") == 0).drop("reasons"), checked.filter(F.size("reasons") > 0)


def reason_counts(checked: DataFrame) -> DataFrame:
    return checked.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


class RawEvent:
    """Typed access to JSON events held as text, keeping JSON types apart.

    Each step is its own projection: the text is parsed once, each field is cut out
    once, and the rules read finished columns.
    """

    def __init__(self, df: DataFrame, payload: str, texts: Sequence[str], wholes: Sequence[str] = (),
                 numbers: Sequence[str] = (), moments: Sequence[str] = ()):
        self.kept = [payload, *(["request"] if "request" in df.columns else [])]
        c = F.col
        targets = {**dict.fromkeys([*texts, *moments], "STRING"), **dict.fromkeys(wholes, "BIGINT"), **dict.fromkeys(numbers, "DOUBLE")}
        ddl = "STRUCT<" + ", ".join(f"{n}: {t}" for n, t in targets.items()) + ">"
        step = df.select("*", F.try_parse_json(c(payload)).alias("_v"), F.json_object_keys(c(payload)).alias("_keys"))
        # The type text of the object, OBJECT<a: BIGINT, b: STRING>, names every field's
        # type. A nested object could repeat a name, but its own field is then no
        # scalar and fails.
        step = step.select(
            "*",
            F.concat(F.lit(", "), F.substring(F.schema_of_variant("_v"), len("OBJECT<") + 1, 1 << 30)).alias("_types"),
            F.try_variant_get("_v", "$", ddl).alias("_row"),
        )
        accepted = {"STRING": ["STRING"], "BIGINT": ["BIGINT"], "DOUBLE": ["BIGINT", "DECIMAL", "DOUBLE", "FLOAT"]}

        def typed(name: str, target: str) -> Column:
            fits = reduce(Column.__or__, [self.has_type(name, kind) for kind in accepted[target]])
            return F.when(fits, c(f"_row.{name}")).alias(f"_t_{name}")

        step = step.select("*", *[typed(n, t) for n, t in targets.items()])
        zone = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$"
        # ISO times that name their zone, cut to milliseconds.
        self.df = step.withColumns({
            f"_t_{n}": F.when(c(f"_t_{n}").rlike(zone), F.date_trunc("MILLISECOND", c(f"_t_{n}").try_cast("timestamp")))
            for n in moments
        }) if moments else step

    def value(self, name: str) -> Column:
        """The field in its own type, NULL when it is missing, null or of another type."""
        return F.col(f"_t_{name}")

    @staticmethod
    def has_type(name: str, kind: str) -> Column:
        return F.contains(F.col("_types"), F.lit(f", {name}: {kind}"))

    def missing(self, name: str) -> Column:
        """Missing or null."""
        return F.coalesce(~self.has_type(name, "") | self.has_type(name, "VOID"), F.lit(True))

    def not_an_object(self) -> Column:
        return F.col("_v").isNull() | F.col("_keys").isNull()

    def lacks(self, names: Sequence[str]) -> Column:
        return F.size(F.array_except(F.array(*map(F.lit, names)), F.col("_keys"))) > 0

    def has_other_than(self, names: Sequence[str]) -> Column:
        return F.size(F.array_except(F.col("_keys"), F.array(*map(F.lit, names)))) > 0

    def finish(self, rules: Sequence[Rule], fields: dict[str, Column]) -> DataFrame:
        row = F.struct(F.col("reasons"), *[v.alias(n) for n, v in fields.items()])
        # One row in, one row out. Filters on the result are not copied below this
        # step, where each copy would parse the text again.
        return check(self.df, rules).select(*self.kept, F.inline(F.array(row)))


def _bad_text(value: Column) -> Column:
    return ~F.coalesce(F.length(value).between(1, MAX_TEXT) & ~F.contains(value, F.lit("\0")), F.lit(False))


def _out_of_time(at: Column, as_of: Column, extra_seconds: int = 0) -> Column:
    latest = as_of + F.make_dt_interval(secs=F.lit(FUTURE_SECONDS + extra_seconds))
    return ~at.between(F.lit(EARLIEST).cast("timestamp"), latest)


def parse_app_events(df: DataFrame, as_of: Column, payload: str = "payload") -> DataFrame:
    """Browsing events from JSON text: typed columns plus ``reasons``."""
    required = [c for c in APP_REQUIRED if c not in ("schema_version", "event_time")]
    raw = RawEvent(df, payload, [*required, *APP_OPTIONAL], wholes=["schema_version"], moments=["event_time"])
    v = raw.value
    kind, action = v("source_kind"), v("event_type")
    yes = lambda cond: F.coalesce(cond, F.lit(False))
    rules: list[Rule] = [
        ("not_an_object", raw.not_an_object()),
        ("missing_field", raw.lacks(APP_REQUIRED)),
        ("unknown_field", raw.has_other_than(APP_REQUIRED + APP_OPTIONAL)),
        ("schema_version", v("schema_version") != 1),
        *[(f"text:{c}", _bad_text(v(c))) for c in required],
        *[(f"text:{c}", ~raw.missing(c) & _bad_text(v(c))) for c in APP_OPTIONAL],
        *[(f"uuid:{c}", ~is_uuid(v(c))) for c in ("event_id", "session_id")],
        *[(f"uuid:{c}", ~raw.missing(c) & ~yes(is_uuid(v(c)))) for c in ("simulation_run_id", "order_id")],
        ("event_type", ~action.isin(schemas.ACTIONS)),
        ("source_kind", ~kind.isin(schemas.SOURCE_KINDS)),
        ("event_time", _out_of_time(v("event_time"), as_of)),
        ("run_required", yes(kind == "synthetic") & v("simulation_run_id").isNull()),
        (
            "source_record_required",
            yes(kind.isin("public_historical", "historical_replay")) & v("source_record_id").isNull(),
        ),
        ("restaurant_required", yes(action.isin(NEEDS_RESTAURANT)) & v("restaurant_id").isNull()),
        ("product_required", yes(action.isin(NEEDS_PRODUCT)) & v("product_id").isNull()),
    ]
    fields = {c: v(c) for c in [*required, *APP_OPTIONAL, "event_time"]}
    for c in ("event_id", "session_id", "simulation_run_id", "order_id"):
        fields[c] = F.lower(v(c))
    fields["schema_version"] = v("schema_version").cast("smallint")
    return raw.finish(rules, fields)


def parse_telemetry(df: DataFrame, stream: str, as_of: Column, payload: str = "payload") -> DataFrame:
    """Courier positions or order snapshots from JSON text: typed columns plus ``reasons``."""
    names = TELEMETRY_FIELDS[stream]
    is_order = stream == "order_events"
    ids = ["event_id", "simulation_run_id", "courier_id", "order_id"]
    texts = ["city_id", "source"] + (["restaurant_id"] if is_order else [])
    if is_order:
        limits = [
            ("pickup_lat", -90, 90), ("pickup_lon", -180, 180), ("dropoff_lat", -90, 90), ("dropoff_lon", -180, 180),
        ]
    else:
        limits = [
            ("latitude", -90, 90), ("longitude", -180, 180),
            ("speed_kmh", 0, MAX_SPEED_KMH), ("accuracy_m", 0, MAX_ACCURACY_M),
        ]
    raw = RawEvent(
        df, payload, [*ids, *texts, "source_kind", *(["status", "currency"] if is_order else [])],
        wholes=["schema_version", *(["amount_minor"] if is_order else [])], numbers=[n for n, _, _ in limits],
        moments=["event_time", *(["order_created_at", "promised_delivery_at"] if is_order else [])],
    )
    v = raw.value
    rules: list[Rule] = [
        ("not_an_object", raw.not_an_object()),
        ("fields", raw.lacks(names) | raw.has_other_than(names)),
        ("schema_version", v("schema_version") != 1),
        *[(f"uuid:{c}", ~is_uuid(v(c))) for c in ids],
        *[(f"text:{c}", _bad_text(v(c))) for c in texts],
        ("source_kind", v("source_kind") != "synthetic"),
        ("event_time", _out_of_time(v("event_time"), as_of)),
        *[(f"range:{n}", F.isnan(v(n)) | ~v(n).between(low, high)) for n, low, high in limits],
    ]
    if is_order:
        created, promised = v("order_created_at"), v("promised_delivery_at")
        rules += [
            ("status", ~v("status").isin(schemas.STATUSES)),
            ("currency", v("currency") != "EUR"),
            ("amount_minor", ~v("amount_minor").between(0, MAX_AMOUNT_MINOR)),
            ("order_created_at", _out_of_time(created, as_of)),
            ("promised_delivery_at", _out_of_time(promised, as_of, 86_400)),
            ("order_times", (created > v("event_time")) | (promised < created)),
        ]
    fields = {c: F.lower(v(c)) if c in ids else v(c) for c in names}
    fields["schema_version"] = v("schema_version").cast("smallint")
    if is_order:
        fields["amount_minor"] = v("amount_minor").try_cast("int")
    return raw.finish(rules, fields)


def table_rules(table: str) -> list[Rule]:
    """Row constraints stored with the tables."""
    c = F.col
    return {
        "app_events": [
            ("version_v1", c("schema_version") != 1),
            ("action_valid", ~c("event_type").isin(schemas.ACTIONS)),
        ],
        "courier_positions": [
            ("gps_lat", F.isnan("latitude") | ~c("latitude").between(-90, 90)),
            ("gps_lon", F.isnan("longitude") | ~c("longitude").between(-180, 180)),
        ],
        "order_events": [
            ("status_valid", ~c("status").isin(schemas.STATUSES)),
            ("currency_eur", c("currency") != "EUR"),
        ],
        "eleme_samples": [
            ("click_binary", ~c("clicked").isin(0, 1)),
            ("hour_valid", ~c("request_hour").between(0, 23)),
            ("day_valid", ~c("sample_day").between(1, 8)),
        ],
    }[table]


def with_digest(df: DataFrame, columns: Sequence[str], name: str = "digest", text: str | None = None) -> DataFrame:
    """SHA-256 over the canonical JSON of the named columns, in name order; ``text`` names a column that keeps this JSON."""
    canonical = F.to_json(F.struct(*sorted(columns)))
    if text is None:
        return df.withColumn(name, F.sha2(canonical, 256))
    return df.withColumn(text, canonical).withColumn(name, F.sha2(text, 256))


def classify_batch(batch: DataFrame, ledger: DataFrame, key: str = "event_id", digest: str = "digest") -> DataFrame:
    """One row per identity of the batch: new, duplicate or conflict, with its copies.

    The ledger keeps its whole history, so it is first cut to the identities of the
    batch; a small batch is then shipped to the ledger scan instead of the ledger
    being shuffled.
    """
    rest = [c for c in batch.columns if c != key]
    ids = batch.groupBy(key).agg(
        F.count(F.lit(1)).alias("copies"),
        F.min(digest).alias("_min"),
        F.max(digest).alias("_max"),
        F.min_by(F.struct(*rest), digest).alias("_row"),
    )
    known = ledger.select(key, F.col(digest).alias("_known")).join(batch.select(key).distinct(), key, "left_semi").distinct()
    joined = ids.join(known, key, "left")
    conflict = (F.col("_min") != F.col("_max")) | (F.col("_known") != F.col("_min"))
    status = F.when(F.coalesce(conflict, F.lit(False)), "conflict").when(F.col("_known").isNotNull(), "duplicate")
    return joined.select(key, "_row.*", "copies", status.otherwise("new").alias("status"))


def settle_requests(
    batch: DataFrame, ledger: DataFrame, key: str = "event_id", digest: str = "digest", request: str = "request"
) -> DataFrame:
    """One row per request and identity with its status; requests are taken in their order, each as a whole.

    A request that gives an identity other content than the ledger, than itself or than an earlier accepted
    request is rejected, and only that request: its conflicting identities are ``conflict``, its others
    ``rejected``. In accepted requests the first to bring an identity is ``new``, all others are
    ``duplicate``. Disputed identities are settled in rounds over their few claims: whoever no earlier undecided
    request contradicts is accepted, and rejects those who contradict it.
    """
    rest = [c for c in batch.columns if c not in (key, request)]
    known = ledger.select(key, F.col(digest).alias("_known")).join(batch.select(key).distinct(), key, "left_semi").distinct()
    broken = F.coalesce((F.col("_min") != F.col("_max")) | (F.col("_known") != F.col("_min")), F.lit(False))
    # All claims to an identity meet once: copies, ledger and rival requests are compared without dealing rows again.
    of_key = Window.partitionBy(key)
    mine = batch.repartition(key).groupBy(key, request).agg(
        F.count(F.lit(1)).alias("copies"), F.min(digest).alias("_min"), F.max(digest).alias("_max"),
        *([F.min_by(F.struct(*rest), digest).alias("_row")] if rest != [digest] else []),
    ).join(known, key, "left").withColumn("_broken", broken)
    row = [F.col("_min").alias(digest)] if rest == [digest] else [F.col(f"_row.{c}").alias(c) for c in rest]
    mine = stage_once(mine.select(
        request, key, *row, "copies", F.col("_known").isNotNull().alias("_old"), "_broken",
        (F.min("_min").over(of_key) != F.max("_min").over(of_key)).alias("_rivals"), F.min(request).over(of_key).alias("_taker"),
    ), "claims", compression="zstd")
    if mine.filter("_broken OR _rivals").isEmpty():
        # Nothing contradicts: every request is accepted.
        first = ~F.col("_old") & (F.col("_taker") == F.col(request))
        return mine.select(request, key, *rest, "copies", F.when(first, "new").otherwise("duplicate").alias("status"))
    rejected = mine.filter("_broken").select(request).distinct()
    fair = mine.filter("_rivals").join(rejected, request, "left_anti").select(request, key, F.col(digest).alias("_content"))
    disputed = fair.groupBy(key).agg(F.min("_content").alias("_a"), F.max("_content").alias("_b")).filter("_a <> _b").select(key)
    claims = pin(fair.join(disputed, key))
    lost = claims.limit(0)
    while not claims.isEmpty():
        leads = claims.groupBy(key).agg(F.min(request).alias("_first"), F.min_by("_content", request).alias("_leading"))
        led = claims.join(leads, key)
        rivals = led.filter("_content <> _leading").groupBy(key).agg(F.min(request).alias("_rival"))
        blocked = (F.col("_content") != F.col("_leading")) | F.coalesce(F.col("_rival") < F.col(request), F.lit(False))
        winners = led.join(rivals, key, "left").groupBy(request).agg(F.bool_or(blocked).alias("_b")).filter("NOT _b").select(request)
        winners = pin(winners)
        settled = claims.join(winners, request).select(key, F.col("_content").alias("_settled")).distinct()
        out = pin(claims.join(winners, request, "left_anti").join(settled, key).filter("_content <> _settled").select(request, key, "_content"))
        lost = lost.unionByName(out)
        claims = pin(claims.join(winners, request, "left_anti").join(out.select(request).distinct(), request, "left_anti"))
    # Staged, so that few refusals are known to be few and travel to the claims.
    lost = stage_once(lost.select(request, key).distinct().withColumn("_lost", F.lit(True)), "lost")
    out_of = stage_once(rejected.unionByName(lost.select(request)).distinct().withColumn("_out", F.lit(True)), "refused")
    judged = mine.drop("_taker").join(lost, [request, key], "left").join(out_of, request, "left")
    judged = judged.withColumn("_taker", F.min(F.when(F.col("_out").isNull(), F.col(request))).over(of_key))
    status = F.when(F.col("_broken") | F.col("_lost").isNotNull(), "conflict").when(F.col("_out").isNotNull(), "rejected").when(
        F.col("_old") | (F.col("_taker") != F.col(request)), "duplicate",
    ).otherwise("new")
    return stage_once(judged.select(request, key, *rest, "copies", status.alias("status")), "judged", compression="zstd")


def request_summary(settled: DataFrame) -> DataFrame:
    """Counters over all requests of a batch; ``duplicates`` are copies in accepted requests beyond the new rows."""
    zero = F.lit(0).cast("bigint")
    total = lambda *kinds: F.coalesce(F.sum(F.when(F.col("status").isin(*kinds), F.col("copies"))), zero)
    out = settled.agg(
        F.coalesce(F.sum("copies"), zero).alias("received"), F.count_if(F.col("status") == "new").alias("accepted"),
        total("new", "duplicate").alias("_taken"), F.count_if(F.col("status") == "conflict").alias("conflicts"),
    )
    state = F.when((F.col("conflicts") > 0) & (F.col("_taken") == 0), "rejected").when(F.col("accepted") > 0, "queued")
    return out.select(
        "received", "accepted", (F.col("_taken") - F.col("accepted")).alias("duplicates"), "conflicts", state.otherwise("already_accepted").alias("state"),
    )


def batch_summary(classified: DataFrame) -> DataFrame:
    """Counters of one batch; a single conflict rejects all of it."""
    zero = F.lit(0).cast("bigint")
    received = F.coalesce(F.sum("copies"), zero)
    fresh = F.count_if(F.col("status") == "new")
    conflicts = F.count_if(F.col("status") == "conflict")
    out = classified.agg(received.alias("received"), fresh.alias("_new"), conflicts.alias("conflicts"))
    clean = F.col("conflicts") == 0
    return out.select(
        "received",
        F.when(clean, F.col("_new")).otherwise(zero).alias("accepted"),
        F.when(clean, F.col("received") - F.col("_new")).otherwise(zero).alias("duplicates"),
        "conflicts",
        F.when(~clean, "rejected").when(F.col("_new") > 0, "queued").otherwise("already_accepted").alias("state"),
    )


def price_baskets(lines: DataFrame, catalog: DataFrame) -> DataFrame:
    """Amount and broken rules per basket; prices come from the catalog only.

    ``lines``: order_id, restaurant_id, product_id, quantity. ``catalog``:
    product_id, restaurant_id, price_minor.
    """
    prices = catalog.select("product_id", F.col("restaurant_id").alias("_shop"), "price_minor")
    # One row per (order, product) first: repeats are found without a distinct count. Lines are dealt before they are
    # grouped, as few of them repeat: a scan holds no groups, and each of all shuffle partitions only its share.
    keys = ["order_id", "restaurant_id", "product_id"]
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    products = lines.repartition(parts, *keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_lines"),
        F.sum("quantity").cast("bigint").alias("_units"),
        F.min("quantity").alias("_min"),
        F.max("quantity").alias("_max"),
    ).join(prices, "product_id", "left")
    same_shop = F.coalesce(F.col("_shop") == F.col("restaurant_id"), F.lit(False))
    baskets = products.groupBy("order_id").agg(
        F.sum("_lines").alias("lines"),
        F.sum("_units").alias("units"),
        F.max("_lines").alias("_repeat"),
        F.min("_min").alias("_low"),
        F.max("_max").alias("_high"),
        F.bool_and(same_shop).alias("_known"),
        (F.min("restaurant_id") != F.max("restaurant_id")).alias("_shops"),
        F.coalesce(F.sum(F.col("price_minor").cast("bigint") * F.col("_units")), F.lit(0).cast("bigint")).alias("amount_minor"),
    )
    rules: list[Rule] = [
        ("lines", ~F.col("lines").between(1, MAX_LINES)),
        ("quantity", ~(F.col("_low") >= 1) | ~(F.col("_high") <= MAX_QUANTITY)),
        ("units", F.col("units") > MAX_UNITS),
        ("repeated_product", F.col("_repeat") > 1),
        ("restaurant", F.col("_shops") | ~F.col("_known")),
    ]
    return check(baskets, rules).select("order_id", "lines", "units", "amount_minor", "reasons")


def named_items(items: Column | str) -> Column:
    """Positional basket triples as named structs."""
    return F.transform(
        items,
        lambda x: F.struct(
            x[0].alias("product_id"), x[1].cast("smallint").alias("quantity"), x[2].cast("int").alias("unit_price_minor")
        ),
    )
