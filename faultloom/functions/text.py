"""Column functions for text, identifiers and display.  All run JVM-side."""

from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as fv


def remembered(build: Callable[[str], Column]) -> Callable[[str], Column]:
    """Keep the expression built for a column name while the Spark context lives.

    Long expressions take a thousand calls from Python to the JVM; a session that plans many
    queries, or a stream that plans one per batch, then pays for them once.
    """
    built: dict[tuple[str, str], Column] = {}

    def get(name: str) -> Column:
        key = (SparkContext.getOrCreate().applicationId, name)
        if key not in built:
            built[key] = build(name)
        return built[key]

    return get


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` applied to ``value``, which is evaluated once however often the body uses it.

    Keeps long derivations one expression of linear size.  As a chain of columns they would be
    copied into every predicate that the optimizer moves below the projection.
    """
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def strip(c: Column) -> Column:
    """Trim all Unicode white space (Spark's trim() removes blanks only)."""
    return F.btrim(c, F.lit(fv.WHITESPACE))


def lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(fv.WHITESPACE))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(fv.WHITESPACE))


def fold_case(c: Column) -> Column:
    """Lower case that also maps the letters a case-insensitive match takes for ASCII ones."""
    for special, plain in (("\u0130", "i"), ("\u0131", "i"), ("\u017f", "s")):
        c = F.replace(c, F.lit(special), F.lit(plain))
    return F.lower(c)


def contains_any(c: Column, literals: list[str]) -> Column:
    expr = F.contains(c, F.lit(literals[0]))
    for x in literals[1:]:
        expr = expr | F.contains(c, F.lit(x))
    return expr


def split_lines(c: Column) -> Column:
    """Lines of a text; a final line break does not yield an empty last line."""

    def trimmed(parts: Column) -> Column:
        shorter = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
        return F.when(F.element_at(parts, -1) == "", shorter).otherwise(parts)

    # Splitting by a pattern compiles it for every row, splitting by one character does not.
    parts = F.when(F.rlike(c, F.lit(fv.RARE_LINE_BREAKS)), F.split(c, fv.LINE_BREAKS)).otherwise(F.split(c, "\n"))
    return let(parts, trimmed)


def truncate_ellipsis(c: Column, limit: int) -> Column:
    """At most ``limit`` characters, the ellipsis included."""
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit - 1), F.lit("…"))).otherwise(c)


def truncate_run_id(c: Column, limit: int = fv.DISPLAY_RUN_ID_CHARS) -> Column:
    """``limit`` characters plus an ellipsis; null becomes empty."""
    short = F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("…"))).otherwise(c)
    return F.coalesce(short, F.lit(""))


def cap_raw_log(c: Column, limit: int | None = None) -> Column:
    """The raw log, empty as null; whole unless a ``limit`` in characters is given."""
    return F.when(F.length(c) > 0, c if limit is None else F.substring(c, 1, limit))


def key_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def key_prefix(c: Column) -> Column:
    return F.substring(c, 1, fv.KEY_PREFIX_CHARS)


def workspace_of_user(c: Column) -> Column:
    return c.cast("string")


def derived_run_id(prefix: Column, *parts: Column) -> Column:
    """A run id that a replay reproduces: ``<prefix>-<8 hex digits of a hash over parts>``."""
    text = [F.coalesce(p.cast("string"), F.lit("\u0002")) for p in parts]
    return F.concat(prefix, F.lit("-"), F.substring(F.sha2(F.concat_ws("\u0001", *text), 256), 1, 8))


def utc_ntz(ts: Column) -> Column:
    """The UTC wall clock of a timestamp, whatever the session time zone is."""
    seconds = (F.unix_micros(ts) / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)")
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)


def iso_utc(ts: Column) -> Column:
    """Second-precision ISO-8601 text in UTC for a timestamp."""
    return F.date_format(utc_ntz(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def lookup(mapping: dict, key: Column, default=None) -> Column:
    """Small fixed mapping as a CASE expression."""
    if not mapping:
        return F.lit(default)
    expr = None
    for k, v in mapping.items():
        expr = F.when(key == k, F.lit(v)) if expr is None else expr.when(key == k, F.lit(v))
    return expr.otherwise(F.lit(default))


def html_escape(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


# Zone labels by (zone, offset hours): fixed display values.
_ZONE_LABELS = {
    "UTC": {0.0: "UTC"},
    "Asia/Kolkata": {5.5: "IST"},
    "America/New_York": {-5.0: "EST", -4.0: "EDT"},
    "America/Los_Angeles": {-8.0: "PST", -7.0: "PDT"},
    "Europe/London": {0.0: "GMT", 1.0: "BST"},
    "Asia/Tokyo": {9.0: "JST"},
    "Asia/Singapore": {8.0: "SGT"},
}


def display_timestamp(utc: Column, zone: str, as_of_utc: Column) -> Column:
    """Time of day in ``zone``; the date comes first unless it is the same day as ``as_of_utc``.

    Both inputs are timestamp_ntz values in UTC, so the result does not depend on the session zone.
    """
    def to_local(c: Column) -> Column:
        return F.convert_timezone(F.lit("UTC"), F.lit(zone), c)

    local = to_local(utc)
    hours = F.timestamp_diff("MINUTE", utc, local) / 60.0
    label = lookup(_ZONE_LABELS.get(zone, {}), hours, zone)
    time = F.concat(F.date_format(local, "hh:mm:ss a"), F.lit(" "), label)
    same_day = F.to_date(local) == F.to_date(to_local(as_of_utc))
    return F.when(same_day, time).otherwise(F.concat(F.date_format(local, "MMM d"), F.lit(" · "), time))
