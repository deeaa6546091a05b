"""Time, parsing, text and geometry expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

# --- fixed values -----------------------------------------------------------------
UUID_PATTERN = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
TIME_FORMATS = [
    "yyyy-MM-dd HH:mm:ss 'UTC'",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss[.SSS]XXX",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd",
]
METRES_PER_DEGREE = 111320


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def month_key(at: Column | str) -> Column:
    """yyyymm as an integer."""
    return F.year(_col(at)) * 100 + F.month(_col(at))


def day_key(at: Column | str) -> Column:
    """yyyymmdd as an integer."""
    return month_key(at) * 100 + F.dayofmonth(_col(at))


def interval_start(at: Column | str, seconds: int) -> Column:
    """Start of the fixed interval that contains ``at``, counted from the epoch."""
    return F.timestamp_seconds(F.floor(F.unix_seconds(_col(at)) / F.lit(seconds)) * seconds)


def millis_between(start: Column | str, end: Column | str) -> Column:
    return F.unix_millis(_col(end)) - F.unix_millis(_col(start))


def seconds_between(start: Column | str, end: Column | str) -> Column:
    return F.unix_seconds(_col(end)) - F.unix_seconds(_col(start))


def within_last(at: Column | str, as_of: Column, seconds: int) -> Column:
    """Trailing-time predicate against an explicit clock."""
    return _col(at) >= as_of - F.make_dt_interval(secs=F.lit(seconds))


def plus_days(at: Column | str, days: Column) -> Column:
    return _col(at) + F.make_dt_interval(days=days.cast("int"))


def parse_time(text: Column | str, formats: Iterable[str] = TIME_FORMATS) -> Column:
    """First format that fits, else NULL."""
    return F.coalesce(*[F.try_to_timestamp(_col(text), F.lit(f)) for f in formats])


def digits_or_zero(text: Column | str) -> Column:
    return F.when(_col(text).rlike("^[0-9]+$"), _col(text).try_cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def number_or_null(text: Column | str) -> Column:
    return _col(text).try_cast("double")


def unsigned_or_null(text: Column | str) -> Column:
    """Non-negative integer text, else NULL."""
    return F.when(_col(text).rlike("^[0-9]+$"), _col(text).try_cast("bigint"))


def compact_date(text: Column | str) -> Column:
    """yyyymmdd text as a date, NULL if it is none."""
    return F.try_to_timestamp(_col(text), F.lit("yyyyMMdd")).cast("date")


def is_uuid(text: Column | str) -> Column:
    return F.lower(_col(text)).rlike(UUID_PATTERN)


def name_uuid(namespace: str, name: Column) -> Column:
    """Deterministic version-5 identity of ``name`` inside a namespace UUID."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3),
        F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12),
    )


def json_text(payload: Column | str, field: str) -> Column:
    """Text of one JSON field, empty when it is missing."""
    return F.coalesce(F.get_json_object(_col(payload), f"$.{field}"), F.lit(""))


def map_value(counters: Column | str, key: str) -> Column:
    """Map lookup, 0 when the key is missing."""
    return F.coalesce(F.try_element_at(_col(counters), F.lit(key)), F.lit(0))


def readable_size(size: Column | str) -> Column:
    """Byte count with a binary unit and two decimals."""
    size = _col(size)
    out = F.concat(F.format_number(size.cast("double"), 2), F.lit(" B"))
    for power, unit in enumerate(["KiB", "MiB", "GiB", "TiB"], start=1):
        scaled = F.format_number(size / float(1024**power), 2)
        out = F.when(size >= 1024**power, F.concat(scaled, F.lit(f" {unit}"))).otherwise(out)
    return out


def euros(minor: Column | str) -> Column:
    """Integer cents as an exact amount."""
    return (_col(minor).cast("decimal(20,2)") / F.lit(100)).cast("decimal(20,2)")


def ratio(part: Column, whole: Column, digits: int, scale: float = 1.0) -> Column:
    """Rounded ``scale * part / whole``; NULL when the whole is 0 or missing."""
    return F.bround(F.try_divide(part.cast("double") * F.lit(float(scale)), whole.cast("double")), digits)


def share_pct(part: Column, whole: Column, digits: int = 2) -> Column:
    return ratio(part, whole, digits, 100.0)


def metres_between(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Equirectangular distance, good for the few metres between two GPS samples."""
    mid = F.radians((lat_a + lat_b) / 2)
    return F.hypot((lat_a - lat_b) * METRES_PER_DEGREE, (lon_a - lon_b) * METRES_PER_DEGREE * F.cos(mid))


def plausible_coordinate(lat: Column | str, lon: Column | str) -> Column:
    """Finite and on the globe; NULL counts as implausible."""
    lat, lon = _col(lat), _col(lon)
    ok = ~F.isnan(lat) & ~F.isnan(lon) & lat.between(-90, 90) & lon.between(-180, 180)
    return F.coalesce(ok, F.lit(False))
