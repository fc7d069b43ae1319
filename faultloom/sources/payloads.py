"""JSON events and webhook payloads, normalised to the log event layout."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed_values as fv
from ..functions import text as tx
from ..schemas import AIRFLOW_PUSH, AIRFLOW_STATE, GENERIC_WEBHOOK, LOG_EVENT, LOG_EVENT_REQUIRED

REQUIRED = {
    "log_event": (LOG_EVENT, LOG_EVENT_REQUIRED),
    "airflow_push": (AIRFLOW_PUSH, ["dag_id", "run_id", "exception"]),
    "airflow_state": (AIRFLOW_STATE, ["dag_id", "run_id", "state"]),
    "generic": (GENERIC_WEBHOOK, ["pipeline", "message"]),
}


def parse_json(raw: DataFrame, column: str = "value", form: str = "log_event") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejects) of JSON texts; rejects keep the input row and add ``reason``.

    A row is rejected when it is no JSON object or lacks a required field.  Other input columns pass
    through, so an API key or arrival number stays with its event.
    """
    schema, required = REQUIRED[form]
    others = [c for c in raw.columns if c != column]
    text = F.col(column)
    malformed = F.coalesce(
        F.get_json_object(text, "$").isNull() | ~F.startswith(F.ltrim(text), F.lit("{")), F.lit(True)
    )

    def judge(value: Column) -> Column:
        missing = F.array_compact(F.array(*[F.when(value[f].isNull(), F.lit(f)) for f in required]))
        reason = F.when(malformed, F.lit("malformed_json")).otherwise(
            tx.let(missing, lambda m: F.when(F.size(m) > 0, F.concat(F.lit("missing:"), F.array_join(m, ","))))
        )
        return F.struct(value.alias("value"), reason.alias("reason"))

    judged = raw.withColumn("_judged", tx.let(F.from_json(text, schema, {"mode": "PERMISSIVE"}), judge))
    reason = F.col("_judged.reason")
    accepted = judged.filter(reason.isNull()).select(*others, "_judged.value.*")
    rejects = judged.filter(reason.isNotNull()).select(*others, column, reason.alias("reason"))
    return accepted, rejects


def _event(df: DataFrame, keep: list[str], **fields: Column) -> DataFrame:
    columns = [
        fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in LOG_EVENT.fields
    ]
    return df.select(*keep, *columns)


def _extra(df: DataFrame, schema: T.StructType) -> list[str]:
    used = {f.name for f in schema.fields} | {f.name for f in LOG_EVENT.fields}
    return [c for c in df.columns if c not in used]


def from_airflow_push(df: DataFrame, now: Column) -> DataFrame:
    """Failure callbacks: always an ERROR, the exception is the message."""
    return _event(
        df, _extra(df, AIRFLOW_PUSH),
        source=F.lit("airflow"), job_id=F.col("dag_id"), run_id=F.col("run_id"), task_id=F.col("task_id"),
        level=F.lit("ERROR"), timestamp=_or(F.col("execution_date"), now), message=F.col("exception"),
        raw_log_uri=F.col("log_url"),
    )


def from_airflow_state(df: DataFrame, now: Column) -> DataFrame:
    """State callbacks: failing states are errors; without an exception the state is described."""
    level = F.when(F.lower("state").isin(fv.AIRFLOW_FAILED_STATES), F.lit("ERROR")).otherwise(F.lit("INFO"))
    described = F.concat(
        F.lit("DAG "), "dag_id", F.lit(" — task "), _or(F.col("task_id"), F.lit("N/A")), F.lit(" "), "state"
    )
    return _event(
        df, _extra(df, AIRFLOW_STATE),
        source=F.lit("airflow"), job_id=F.col("dag_id"), run_id=F.col("run_id"), task_id=F.col("task_id"),
        level=level, timestamp=_or(F.col("execution_date"), now), message=_or(F.col("exception"), described),
        raw_log_uri=F.col("log_url"),
    )


def from_generic(df: DataFrame, now: Column) -> DataFrame:
    """Generic payloads; a missing run id is derived from the payload, so a replay gives the same one."""
    level, stamp = F.upper(F.coalesce("level", F.lit("ERROR"))), _or(F.col("timestamp"), now)
    run = tx.derived_run_id(F.col("pipeline"), F.col("level"), F.col("message"), F.col("timestamp"))
    return _event(
        df, _extra(df, GENERIC_WEBHOOK),
        source=_or(F.col("source"), F.lit("webhook")), job_id=F.col("pipeline"), run_id=_or(F.col("run_id"), run),
        level=level, timestamp=stamp, message=F.col("message"),
    )


def from_parsed_lines(
    parsed: DataFrame, job_id: Column, *, source: str = "agent", workspace_id: str = "default",
    identity: tuple[str, ...] = ("path", "nth"), keep: tuple[str, ...] = ("ts", "ts_inferred"),
) -> DataFrame:
    """Events of parsed log lines; the run id is derived from the line and where it stands.

    The default identity is the file, the line's own text and which of the file's equal lines it is, so
    neither other files nor the split size change a run id.
    """
    where = [F.col(c) for c in identity if c in parsed.columns]
    if "line" in parsed.columns and "nth" in identity:
        where.append(F.col("line"))
    return _event(
        parsed.withColumn("_run", tx.derived_run_id(job_id, *where, F.col("message"))),
        list(keep),
        source=F.lit(source), workspace_id=F.lit(workspace_id), job_id=job_id, run_id=F.col("_run"),
        level=F.col("level"), timestamp=F.col("timestamp"), message=F.col("message"),
    )


def _or(value: Column, default: Column) -> Column:
    """The value unless it is null or empty."""
    return F.when(value != "", value).otherwise(default)


def with_event_time(events: DataFrame, ingest_ts: Column) -> DataFrame:
    """Add ts: the parsed event time, or the ingest time when the text is no timestamp."""
    from ..operators.lines import normal_level, parse_timestamp

    parsed = parse_timestamp(F.col("timestamp"))
    return (
        events.withColumn("ts", F.coalesce(parsed, ingest_ts))
        .withColumn("ts_inferred", parsed.isNull())
        .withColumn("level", normal_level(F.col("level")))
    )
