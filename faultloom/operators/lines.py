"""Parsing of raw log lines into levelled, timestamped messages."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import text as tx
from ..functions.rows import explode_rows


def normal_level(level: Column) -> Column:
    up = F.upper(level)
    return F.when(up == "WARNING", F.lit("WARN")).otherwise(up)


_SHORT = r"^(\d{2})/(\d{2})/(\d{2}) (\d{2}:\d{2}:\d{2})$"
_ISO = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?$"
_ISO_COMPAT = r"^\d{4}-\d{2}-\d{2}(?:T\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?Z| \d{2}:\d{2}:\d{2}(?:[.,]\d{1,6})?)$"


def parse_timestamp(raw: Column, *, compat: bool = False) -> Column:
    """Timestamp of a log stamp, or null when no form fits.

    The default applies a UTC offset and accepts ISO stamps with or without ``Z``.  ``compat``
    drops the offset and then accepts six forms only (so ``T`` stamps without ``Z`` give null).
    """
    value = tx.strip(raw)
    if compat:
        value = tx.rstrip(F.regexp_replace(value, r"[+-]\d{2}:?\d{2}$", ""))

    def with_zone(v: Column) -> Column:
        return (
            F.when(F.rlike(v, F.lit(r"(?:Z|:\d{2}(?:\.\d+)?[+-]\d{2}:\d{2})$")), v)
            .when(F.rlike(v, F.lit(r":\d{2}(?:\.\d+)?[+-]\d{4}$")), F.regexp_replace(v, r"(\d{2})$", ":$1"))
            .otherwise(F.concat(v, F.lit("Z")))
        )

    def normal(v: Column) -> Column:
        century = F.when(F.substring(v, 1, 2) >= "69", F.lit("19")).otherwise(F.lit("20"))
        short = F.concat(century, F.regexp_replace(v, _SHORT, "$1-$2-$3 $4Z"))
        iso = tx.let(F.translate(v, ",", "."), with_zone)
        return F.when(F.rlike(v, F.lit(_SHORT)), short).when(
            F.rlike(v, F.lit(_ISO_COMPAT if compat else _ISO)), iso
        )

    return tx.let(value, normal).try_cast("timestamp")


def parsed_line(line: Column) -> Column:
    """Struct (form, stamp, level, logger, message) of a raw line, or null for blank and unknown lines."""

    def fields(text: Column, form: str, pattern: str, message: int, logger: int | None = None) -> Column:
        named = F.lit(None).cast("string") if logger is None else F.regexp_extract(text, pattern, logger)
        return F.struct(
            F.lit(form).alias("form"),
            F.regexp_extract(text, pattern, 1).alias("stamp"),
            F.regexp_extract(text, pattern, 2).alias("level"),
            named.alias("logger"),
            tx.strip(F.regexp_extract(text, pattern, message)).alias("message"),
        )

    def parse(text: Column) -> Column:
        return (
            F.when(F.rlike(text, F.lit(fv.LINE_AIRFLOW)), fields(text, "airflow", fv.LINE_AIRFLOW, 3))
            .when(F.rlike(text, F.lit(fv.LINE_LOG4J)), fields(text, "spark", fv.LINE_LOG4J, 4, 3))
            .when(F.rlike(text, F.lit(fv.LINE_ISO)), fields(text, "spark", fv.LINE_ISO, 3))
        )

    return tx.let(tx.rstrip(line), parse)


def parse_lines(
    lines: DataFrame, line: str = "line", *, ingest_ts: Column | None = None, compat: bool = False
) -> DataFrame:
    """Keep the lines that have a known form and add the parsed fields.

    Adds level, message, logger (Log4j form only), ts, ts_inferred, timestamp (ISO text) and
    source_format.  A stamp that cannot be read takes ``ingest_ts`` (default: the query's current
    time) and sets ``ts_inferred``.
    """
    now = F.current_timestamp() if ingest_ts is None else ingest_ts
    # Out of a generator the parse runs once, and filters on its fields stay behind it.
    parsed = explode_rows(lines, ["*"], F.array(parsed_line(F.col(line))), "_line", "_one").drop("_one")
    parsed = parsed.filter(F.col("_line").isNotNull())
    timed = parsed.withColumn("_ts", parse_timestamp(F.col("_line.stamp"), compat=compat))
    return (
        timed.withColumns(
            {
                "level": normal_level(F.col("_line.level")),
                "message": F.col("_line.message"),
                "logger": F.col("_line.logger"),
                "ts": F.coalesce("_ts", now),
                "ts_inferred": F.col("_ts").isNull(),
                "source_format": F.col("_line.form"),
            }
        )
        .withColumn("timestamp", tx.iso_utc(F.col("ts")))
        .drop("_line", "_ts")
    )


def errors_only(events: DataFrame) -> DataFrame:
    return events.filter(F.col("level") == "ERROR")


def run_status(level: Column) -> Column:
    """Only the level ERROR fails a run."""
    return F.when(F.upper(level) == "ERROR", F.lit("Failed")).otherwise(F.lit("Success"))
