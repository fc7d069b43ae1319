"""Queries over log text: redaction, line parsing, payloads, blocks, exceptions."""

import uuid

from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import text as tx
from ..operators import blocks, lines, reports, scrub
from ..operators.exceptions import parse_all_blocks, parse_errors
from ..operators.positions import chunk_of
from ..session import checkpoint_folder
from ..sources import logs, payloads
from ..sources.tables import read_table, spread
from . import pipelines as pl
from . import testviews as tv
from .oracle_views import ERRORS, LOG_EVENTS, MARKERS, RULES, SEVERITY, lit, with_views
from .oracle_views import stamp as sql_stamp
from .registry import query, stamp


@query(
    "incident_summary",
    with_views(LOG_EVENTS, RULES, ERRORS, select=f"""
SELECT workspace_id, job_id AS pipeline_name, signature AS error_type, severity,
  count(*) AS occurrences, {sql_stamp('max(ts)')} AS last_seen, arg_max(fix, seq) AS best_fix
FROM analysed GROUP BY 1, 2, 3, 4"""),
)
def incident_summary(spark, sf_dir):
    return pl.incident_summary(tv.log_events(spark, sf_dir)).withColumn("last_seen", stamp("last_seen"))


@query("scrub_events", with_views(LOG_EVENTS, select="SELECT seq, clean AS message, redactions FROM log_events"))
def scrub_events(spark, sf_dir):
    clean = scrub.scrub(tv.log_events(spark, sf_dir), "message")
    return clean.select("seq", "message", F.array_join("redactions", ",").alias("redactions"))


def _re2_chain() -> str:
    steps = ["s0 AS (SELECT doc_id, source, text, '' AS red FROM documents)"]
    for i, (name, pattern, token) in enumerate(fv.REDACTIONS_RE2):
        steps.append(
            f"s{i + 1} AS (SELECT doc_id, source, regexp_replace(text, '{pattern}', '{token}', 'g') AS text,\n"
            f"  red || CASE WHEN regexp_matches(text, '{pattern}') THEN ',{name}' ELSE '' END AS red FROM s{i})"
        )
    return ",\n".join(steps) + ",\nscrubbed AS (SELECT doc_id, source, text, red[2:] AS redactions FROM s12)"


@query("scrub_documents", f"WITH {_re2_chain()}\nSELECT doc_id, text AS clean, redactions FROM scrubbed")
def scrub_documents(spark, sf_dir):
    docs = spread(read_table(spark, sf_dir, "documents")).select("doc_id", "text")
    clean = scrub.scrub(docs, "text", out="clean")
    return clean.select("doc_id", "clean", F.array_join("redactions", ",").alias("redactions"))


@query(
    "redaction_audit",
    f"""WITH {_re2_chain()}
SELECT source, category, count(*) AS n_rows
FROM (SELECT source, unnest(string_split(redactions, ',')) AS category FROM scrubbed WHERE redactions <> '')
GROUP BY 1, 2""",
)
def redaction_audit(spark, sf_dir):
    docs = spread(read_table(spark, sf_dir, "documents")).select("source", "text")
    return scrub.redaction_audit(scrub.scrub(docs, "text"), ["source"])


_LINES = f"""
lines AS (
  SELECT event_id AS seq, event_id % 6 AS form, 'job_' || (user_id % 7) AS path,
    CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'WARN' WHEN 'view' THEN 'DEBUG' ELSE 'INFO' END AS level,
    'step ' || CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) || ' of ' || event_type AS message,
    date_trunc('millisecond', ts) AS ms, date_trunc('second', ts) AS sec
  FROM events
),
parsed AS (
  SELECT seq, path, level, message, CASE WHEN form = 2 THEN 'TaskSetManager' END AS logger, form,
    CASE WHEN form < 2 THEN 'airflow' ELSE 'spark' END AS source_format,
    CASE form WHEN 0 THEN ms - INTERVAL 330 MINUTE WHEN 1 THEN ms WHEN 3 THEN ms ELSE sec END AS t
  FROM lines WHERE form < 5
)"""


@query(
    "line_parse",
    f"WITH {_LINES}\nSELECT seq, level, message, logger, source_format, {sql_stamp('t')} AS ts, false AS ts_inferred FROM parsed",
)
def line_parse(spark, sf_dir):
    parsed = lines.parse_lines(tv.log_lines(spark, sf_dir))
    return parsed.select(
        "seq", "level", "message", "logger", "source_format", stamp(tx.utc_ntz(F.col("ts"))).alias("ts"), "ts_inferred"
    )


@query(
    "line_parse_compat",
    f"""WITH {_LINES}
SELECT seq, form = 0 AS ts_inferred,
  strftime(CASE WHEN form = 0 THEN TIMESTAMP '2025-01-01 00:00:00' ELSE t END, '%Y-%m-%dT%H:%M:%SZ') AS timestamp
FROM parsed""",
)
def line_parse_compat(spark, sf_dir):
    now = F.timestamp_seconds(F.lit(1735689600))
    parsed = lines.parse_lines(tv.log_lines(spark, sf_dir), ingest_ts=now, compat=True)
    return parsed.select("seq", "ts_inferred", "timestamp")


@query("level_counts", f"WITH {_LINES}\nSELECT level, source_format, count(*) AS n FROM parsed GROUP BY 1, 2")
def level_counts(spark, sf_dir):
    parsed = lines.parse_lines(tv.log_lines(spark, sf_dir))
    return parsed.groupBy("level", "source_format").agg(F.count(F.lit(1)).alias("n"))


@query(
    "agent_events",
    f"""WITH {_LINES}
SELECT seq, 'agent' AS source, 'default' AS workspace_id, path AS job_id,
  path || '-' || left(sha256(concat_ws(chr(1), path, seq, message)), 8) AS run_id,
  level, strftime(t, '%Y-%m-%dT%H:%M:%SZ') AS timestamp, message
FROM parsed WHERE level = 'ERROR'""",
)
def agent_events(spark, sf_dir):
    parsed = lines.errors_only(lines.parse_lines(tv.log_lines(spark, sf_dir)))
    events = payloads.from_parsed_lines(parsed, F.col("path"), identity=("path", "seq"), keep=("seq",))
    return events.select("seq", "source", "workspace_id", "job_id", "run_id", "level", "timestamp", "message")


@query(
    "log_scan",
    f"""WITH {_LINES}
SELECT level, message, {sql_stamp('t')} AS ts, 'scan' AS job_id, 'w' AS workspace_id
FROM parsed WHERE level = 'ERROR'""",
)
def log_scan(spark, sf_dir):
    """The raw lines written as log files to the shared folder, scanned and collected."""
    folder = f"{checkpoint_folder(spark, 'logs')}/{uuid.uuid4().hex}"
    tv.log_lines(spark, sf_dir).select("line").write.text(folder)
    events = pl.collect_logs(logs.read_log_lines(spark, folder), F.lit("scan"), workspace_id="w")
    return events.select("level", "message", stamp(tx.utc_ntz(F.col("ts"))).alias("ts"), "job_id", "workspace_id")


def _marked() -> str:
    rows = ", ".join(f"({i}, {lit(c)}, {lit(SEVERITY[c])})" for i, c in enumerate(MARKERS))
    return f"""SELECT event_id AS seq, category, severity, category || ':JobException' AS signature
FROM events JOIN (VALUES {rows}) AS c(slot, category, severity) ON slot = event_id % {len(MARKERS)}"""


@query("all_categories", _marked())
def all_categories(spark, sf_dir):
    """Each event with a trace that holds one category's marker, category after category."""
    marks = F.array(*[F.lit(m) for m in MARKERS.values()])
    mark = F.element_at(marks, F.pmod("event_id", F.lit(len(MARKERS))).cast("int") + 1)
    trace = F.concat(F.lit("org.acme.JobException: "), mark, F.lit(" at row "), F.col("event_id").cast("string"), F.lit("\n\tat com.acme.Job.run(Job.scala:5)"))
    events = read_table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), trace.alias("message"))
    return parse_errors(events).select("seq", "category", "severity", "signature")


@query(
    "published_errors",
    with_views(LOG_EVENTS, select="SELECT seq, workspace_id, job_id, run_id, clean AS message FROM log_events WHERE level = 'ERROR'"),
)
def published_errors(spark, sf_dir):
    return pl.publish(tv.log_events(spark, sf_dir)).select("seq", "workspace_id", "job_id", "run_id", "message")


_STATE = "CASE event_type WHEN 'error' THEN 'Failed' WHEN 'click' THEN 'up_for_retry' WHEN 'view' THEN 'UPSTREAM_FAILED' ELSE 'success' END"


@query(
    "airflow_state_events",
    with_views(LOG_EVENTS, select=f"""
SELECT seq, 'airflow' AS source, job_id, run_id, CASE WHEN value > 20 THEN 'load' END AS task_id,
  CASE WHEN event_type IN ('error', 'click', 'view') THEN 'ERROR' ELSE 'INFO' END AS level,
  CASE WHEN value > 5 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') ELSE '2025-01-01T00:00:00Z' END AS timestamp,
  CASE WHEN event_type = 'error' THEN message
    ELSE 'DAG ' || job_id || ' — task ' || CASE WHEN value > 20 THEN 'load' ELSE 'N/A' END || ' ' || {_STATE} END AS message
FROM log_events"""),
)
def airflow_state_events(spark, sf_dir):
    events = tv.log_events(spark, sf_dir)
    state = (
        F.when(F.col("event_type") == "error", F.lit("Failed"))
        .when(F.col("event_type") == "click", F.lit("up_for_retry"))
        .when(F.col("event_type") == "view", F.lit("UPSTREAM_FAILED"))
        .otherwise(F.lit("success"))
    )
    body = events.select(
        "seq",
        F.to_json(F.struct(
            F.col("job_id").alias("dag_id"), "run_id", F.when(F.col("value") > 20, F.lit("load")).alias("task_id"),
            state.alias("state"), F.when(F.col("value") > 5, tx.iso_utc(F.col("ts"))).alias("execution_date"),
            F.when(F.col("event_type") == "error", F.col("message")).alias("exception"),
        )).alias("value"),
    )
    accepted, _ = payloads.parse_json(body, form="airflow_state")
    out = payloads.from_airflow_state(accepted, F.lit("2025-01-01T00:00:00Z"))
    return out.select("seq", "source", "job_id", "run_id", "task_id", "level", "timestamp", "message")


@query(
    "airflow_push_events",
    with_views(LOG_EVENTS, select="""
SELECT seq, 'airflow' AS source, job_id, run_id, 'ERROR' AS level, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS timestamp,
  message, 's3://logs/' || run_id AS raw_log_uri
FROM log_events WHERE level = 'ERROR'"""),
)
def airflow_push_events(spark, sf_dir):
    events = lines.errors_only(tv.log_events(spark, sf_dir))
    body = events.select(
        "seq",
        F.to_json(F.struct(
            F.col("job_id").alias("dag_id"), "run_id", F.col("message").alias("exception"),
            F.concat(F.lit("s3://logs/"), "run_id").alias("log_url"), tx.iso_utc(F.col("ts")).alias("execution_date"),
        )).alias("value"),
    )
    accepted, _ = payloads.parse_json(body, form="airflow_push")
    out = payloads.from_airflow_push(accepted, F.lit("2025-01-01T00:00:00Z"))
    return out.select("seq", "source", "job_id", "run_id", "level", "timestamp", "message", "raw_log_uri")


@query(
    "generic_events",
    with_views(LOG_EVENTS, select="""
SELECT seq, CASE WHEN value > 50 THEN 'ci' ELSE 'webhook' END AS source, job_id,
  CASE WHEN level = 'ERROR' THEN run_id ELSE job_id || '-' || left(sha256(concat_ws(chr(1),
    CASE WHEN event_type IN ('view', 'click') THEN lower(event_type) ELSE chr(2) END, message, chr(2))), 8) END AS run_id,
  CASE WHEN event_type IN ('view', 'click') THEN upper(event_type) ELSE 'ERROR' END AS level,
  '2025-01-01T00:00:00Z' AS timestamp, message
FROM log_events"""),
)
def generic_events(spark, sf_dir):
    events = tv.log_events(spark, sf_dir)
    body = events.select(
        "seq",
        F.to_json(F.struct(
            F.col("job_id").alias("pipeline"), F.when(F.col("level") == "ERROR", F.col("run_id")).alias("run_id"),
            F.when(F.col("event_type").isin("view", "click"), F.col("event_type")).alias("level"), "message",
            F.when(F.col("value") > 50, F.lit("ci")).alias("source"),
        )).alias("value"),
    )
    accepted, _ = payloads.parse_json(body, form="generic")
    out = payloads.from_generic(accepted, F.lit("2025-01-01T00:00:00Z"))
    return out.select("seq", "source", "job_id", "run_id", "level", "timestamp", "message")


def _json_events(spark, sf_dir):
    """Events as JSON texts: some lack required fields, some are cut off, some are plain text."""
    events = tv.log_events(spark, sf_dir)
    kind = F.col("event_type")
    whole = F.to_json(F.struct(
        F.lit("spark").alias("source"), F.when(kind != "signup", F.col("job_id")).alias("job_id"), "run_id",
        F.when(~kind.isin("signup", "view"), F.col("level")).alias("level"),
        tx.iso_utc(F.col("ts")).alias("timestamp"), "message",
    ))
    text = F.when(kind == "click", F.concat(F.lit("not json "), "run_id")).otherwise(whole)
    return events.select("seq", text.alias("value"))


@query(
    "json_events",
    with_views(LOG_EVENTS, select="""
SELECT seq, 'spark' AS source, job_id, run_id, level, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS timestamp, message,
  strftime(ts, '%Y-%m-%d %H:%M:%S.000000') AS ts
FROM log_events WHERE event_type IN ('error', 'purchase')"""),
)
def json_events(spark, sf_dir):
    accepted, _ = payloads.parse_json(_json_events(spark, sf_dir))
    timed = payloads.with_event_time(accepted, F.timestamp_seconds(F.lit(0)))
    return timed.select(
        "seq", "source", "job_id", "run_id", "level", "timestamp", "message", stamp(tx.utc_ntz(F.col("ts"))).alias("ts")
    )


@query(
    "event_rejects",
    """SELECT event_id AS seq, CASE event_type WHEN 'click' THEN 'malformed_json' WHEN 'view' THEN 'missing:level'
  ELSE 'missing:job_id,level' END AS reason
FROM events WHERE event_type IN ('click', 'view', 'signup')""",
)
def event_rejects(spark, sf_dir):
    _, rejects = payloads.parse_json(_json_events(spark, sf_dir))
    return rejects.select("seq", "reason")


_BLOCKS = """
raw AS (
  SELECT job_id AS path, seq, unnest(string_split(message, chr(10))) AS line,
    generate_subscripts(string_split(message, chr(10)), 1) - 1 AS i
  FROM log_events
),
classed AS (
  SELECT path, seq * 10 + i AS line_no, line,
    CASE WHEN regexp_matches(line, '^(\\s+(at |\\.{3}\\s*\\d+\\s+more|Caused by:|Suppressed:|File "|    )|Caused by:|Traceback )') THEN 'C'
      WHEN regexp_matches(line, '(?i)ERROR|EXCEPTION|CRITICAL|FATAL') THEN 'A' ELSE 'O' END AS cls
  FROM raw
),
marked AS (
  SELECT *, sum(CASE WHEN cls = 'A' THEN 1 ELSE 0 END) OVER w AS block_id,
    last_value(CASE WHEN cls <> 'C' THEN cls END IGNORE NULLS) OVER w AS state
  FROM classed WINDOW w AS (PARTITION BY path ORDER BY line_no ROWS UNBOUNDED PRECEDING)
)"""


@query(
    "blocks_from_lines",
    with_views(LOG_EVENTS, _BLOCKS, select="""
SELECT path, CAST(block_id AS BIGINT) AS block_id, min(line_no) AS first_line, count(*) AS n_lines,
  string_agg(line, chr(10) ORDER BY line_no) AS block
FROM marked WHERE cls <> 'O' AND state = 'A' GROUP BY 1, 2"""),
)
def blocks_from_lines(spark, sf_dir):
    labelled = blocks.assign_blocks(
        tv.message_lines(spark, sf_dir), source=["path"], order="line_no", chunk=chunk_of("line_no", 10_000)
    )
    found = blocks.collect_blocks(labelled, source=["path"], order="line_no")
    return found.select(
        "path", "block_id", "first_line", F.size("block").cast("long").alias("n_lines"),
        F.array_join("block", "\n").alias("block"),
    )


@query(
    "block_exceptions",
    with_views(LOG_EVENTS, select="""
SELECT seq, 0 AS block_no, signature, severity FROM log_events WHERE slot NOT IN (4, 11)
UNION ALL
SELECT seq, 1, 'SCHEMA_MISMATCH:UnknownException', 'high' FROM log_events WHERE slot = 22"""),
)
def block_exceptions(spark, sf_dir):
    clean = scrub.scrub(tv.log_events(spark, sf_dir), "message")
    return parse_all_blocks(clean).select("seq", "block_no", "signature", "severity")


@query(
    "classify_errors",
    with_views(LOG_EVENTS, select="""
SELECT seq, category, signature, severity, form AS source_format, summary FROM log_events"""),
)
def classify_errors(spark, sf_dir):
    parsed = parse_errors(scrub.scrub(tv.log_events(spark, sf_dir), "message"))
    return parsed.select("seq", "category", "signature", "severity", "source_format", "summary")


@query(
    "exception_fields",
    with_views(LOG_EVENTS, select="""
SELECT seq,
  CASE slot WHEN 4 THEN 'ExecutorLostFailure' WHEN 10 THEN 'SparkException' WHEN 11 THEN 'plain notice' WHEN 12 THEN 'KeyError'
    WHEN 13 THEN 'PythonException' ELSE CASE WHEN form = 'generic' THEN 'UnknownError' ELSE 'UnknownException' END END AS exception_class,
  CASE slot WHEN 10 THEN 'OutOfMemoryError: Java heap space' WHEN 14 THEN 'FileNotFoundException: /data/part-' || v || '.parquet'
    ELSE '' END AS causes,
  CASE slot WHEN 10 THEN 'com.acme.Job.run(Job.scala:10)' WHEN 12 THEN '/dags/load_' || v || '.py:42 in run() → result = frame[key]'
    WHEN 13 THEN 'com.acme.Etl.load(Etl.scala:77)' WHEN 22 THEN 'com.acme.Job.step(Job.scala:5)' ELSE '' END AS frames,
  CASE slot WHEN 12 THEN 'Task failed with code ' || v
    WHEN 14 THEN 'Task 3 in stage ' || v || ' failed 4 times, most recent failure: ERROR lost task' END AS task_context
FROM log_events"""),
)
def exception_fields(spark, sf_dir):
    parsed = parse_errors(scrub.scrub(tv.log_events(spark, sf_dir), "message"))
    return parsed.select(
        "seq", "exception_class", F.array_join("causal_chain", "|").alias("causes"),
        F.array_join("user_frames", "|").alias("frames"), "task_context",
    )


@query(
    "signature_counts",
    with_views(LOG_EVENTS, select="SELECT signature, severity, count(*) AS n FROM log_events GROUP BY 1, 2"),
)
def signature_counts(spark, sf_dir):
    parsed = parse_errors(scrub.scrub(tv.log_events(spark, sf_dir), "message"))
    return parsed.groupBy("signature", "severity").agg(F.count(F.lit(1)).alias("n"))


@query(
    "incident_windows",
    with_views(LOG_EVENTS, select=f"""
SELECT {sql_stamp("date_trunc('day', ts)")} AS window_start, category, severity, count(*) AS incidents
FROM log_events WHERE level = 'ERROR' GROUP BY 1, 2, 3"""),
)
def incident_windows(spark, sf_dir):
    parsed = parse_errors(pl.publish(tv.log_events(spark, sf_dir)))
    windows = reports.incident_windows(parsed, "1 day")
    return windows.withColumn("window_start", stamp("window_start"))
