"""Streaming runs over the event table, cut into files that arrive one after the other.

Each result must equal the batch result, so the SQL is that of the batch queries.
"""

import uuid

from pyspark.sql import functions as F

from ..operators import reports, state
from ..operators.exceptions import parse_errors
from ..session import checkpoint_folder
from ..sources import tables, tenants
from ..sources.tables import read_table
from ..streaming import dead_letters, late, streams
from . import pipelines as pl
from . import testviews as tv
from .oracle_views import ERRORS, LOG_EVENTS, RULES, RUNS, with_views
from .oracle_views import stamp as sql_stamp
from .registry import query, stamp

FILES = 3


def _replay(spark, sf_dir, name, build, write, mode="append"):
    """Write the log events as files in order of arrival and run a stream of ``FILES`` batches over them.

    A batch gets as many files as keep each one small, since a file of one row group is read by one task.
    """
    root = f"{checkpoint_folder(spark, name)}/{uuid.uuid4().hex}"
    events = tv.log_events(spark, sf_dir)
    each = tables.pieces(read_table(spark, sf_dir, "events").count(), FILES * tables.SPREAD_ROWS)
    events.repartitionByRange(FILES * each, "seq").write.parquet(f"{root}/source")
    stream = streams.read_events(spark, f"{root}/source", events.schema, files_per_trigger=each)
    streams.start(build(stream), f"{root}/checkpoint", write(root), mode=mode).awaitTermination()
    return root


@query(
    "stream_errors",
    with_views(LOG_EVENTS, RULES, ERRORS, select=f"""
SELECT workspace_id, pipeline_name, error_type, fix, {sql_stamp('detected_at')} AS detected_at, raw_log FROM errors"""),
)
def stream_errors(spark, sf_dir):
    root = _replay(spark, sf_dir, "errors", pl.publish, lambda root: streams.error_changes(f"{root}/errors"))
    changes = spark.read.parquet(f"{root}/errors").drop(tables.BATCH)
    return state.upsert_errors(changes).select(
        "workspace_id", "pipeline_name", "error_type", "fix", stamp("detected_at").alias("detected_at"), "raw_log"
    )


@query(
    "stream_quota",
    with_views(LOG_EVENTS, """
quota AS (SELECT CAST(c_custkey AS VARCHAR) AS ws, 100 - (c_custkey * 7) % 120 AS remaining FROM customer),
errors_only AS (
  SELECT seq, workspace_id, seq % 5 IN (3, 4) AS billable, remaining,
    coalesce(sum(CASE WHEN seq % 5 IN (3, 4) THEN 1 ELSE 0 END) OVER (
      PARTITION BY workspace_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM log_events LEFT JOIN quota ON ws = workspace_id WHERE level = 'ERROR'
)""", select="""
SELECT workspace_id, count(*) FILTER (billable AND (remaining IS NULL OR before < remaining)) AS ai_calls
FROM errors_only GROUP BY 1"""),
)
def stream_quota(spark, sf_dir):
    """Calls billed by a stream of several batches: the same as in one batch."""
    from .queries_state import quota_users

    answered = F.pmod("seq", F.lit(5)).isin(3, 4)
    ai = F.when(answered, F.struct(F.lit("a cause").alias("root_cause"), F.lit("a fix").alias("suggested_fix"), F.lit(0.9).alias("confidence_score")))
    users = quota_users(spark, sf_dir)
    root = _replay(
        spark, sf_dir, "quota", pl.publish,
        lambda root: streams.error_changes(f"{root}/errors", users=users, usage_path=f"{root}/usage", ai=ai),
    )
    return spark.read.parquet(f"{root}/usage").groupBy("workspace_id").agg(F.sum("ai_calls").alias("ai_calls"))


@query(
    "stream_run_status",
    with_views(LOG_EVENTS, RUNS, select=f"""
SELECT workspace_id, pipeline_name, status, {sql_stamp('last_run')} AS last_run FROM pipelines"""),
)
def stream_run_status(spark, sf_dir):
    root = _replay(spark, sf_dir, "runs", lambda s: s, streams.run_changes)
    runs = state.dedup_runs(spark.read.parquet(f"{root}/runs").drop(tables.BATCH))
    return state.pipeline_state(runs).withColumn("last_run", stamp("last_run"))


@query("stream_dedup", with_views(LOG_EVENTS, RUNS, select="SELECT workspace_id, count(*) AS runs FROM runs GROUP BY 1"))
def stream_dedup(spark, sf_dir):
    root = _replay(
        spark, sf_dir, "dedup", lambda s: streams.dedup_runs(s, "60 days").select("workspace_id", "run_id"),
        lambda root: lambda batch, i: tables.append_changes(batch, f"{root}/runs", i),
    )
    return spark.read.parquet(f"{root}/runs").groupBy("workspace_id").agg(F.count(F.lit(1)).alias("runs"))


@query(
    "stream_windows",
    with_views(LOG_EVENTS, select=f"""
SELECT {sql_stamp("date_trunc('day', ts)")} AS window_start, category, severity, count(*) AS incidents
FROM log_events WHERE level = 'ERROR' GROUP BY 1, 2, 3"""),
)
def stream_windows(spark, sf_dir):
    keys = ["window_start", "category", "severity"]
    root = _replay(
        spark, sf_dir, "windows", lambda s: streams.incident_windows(s, "1 day", "60 days"),
        lambda root: lambda batch, i: tables.append_changes(batch, f"{root}/windows", i), mode="update",
    )
    latest = spark.read.parquet(f"{root}/windows").groupBy(*keys).agg(F.max_by("incidents", tables.BATCH).alias("incidents"))
    return latest.withColumn("window_start", stamp("window_start"))


#: Files that arrive one after the other: event numbers are dealt over them in turn, so times go back and forth.
LATE_FILES = 4
LATENESS = "12 HOURS"


def _in_turns(spark, sf_dir, name, files, build, write):
    """Write one file of events after the other, each with every ``files``-th event, and go on with one stream after each."""
    root = f"{checkpoint_folder(spark, name)}/{uuid.uuid4().hex}"
    built = build(tv.log_events(spark, sf_dir))
    # Built once and kept: each file is a choice of its rows.
    built.write.parquet(f"{root}/built")
    events = spark.read.schema(built.schema).parquet(f"{root}/built")
    for turn in range(files):
        events.filter(F.pmod("seq", F.lit(files)) == turn).write.mode("append").parquet(f"{root}/source")
        stream = streams.read_events(spark, f"{root}/source", events.schema)
        streams.start(stream, f"{root}/checkpoint", write(root)).awaitTermination()
    return root


@query(
    "stream_late",
    with_views(LOG_EVENTS, f"""
marks AS (SELECT seq % {LATE_FILES} AS turn, max(ts) AS latest FROM log_events GROUP BY 1),
measured AS (
  SELECT e.*, (SELECT max(latest) - INTERVAL {LATENESS} FROM marks WHERE turn < e.seq % {LATE_FILES}) AS mark FROM log_events e WHERE level = 'ERROR'
)""", select=f"""
SELECT {sql_stamp("date_trunc('day', ts)")} AS window_start, category, severity, count(*) AS incidents,
  count(*) FILTER (mark IS NULL OR ts >= mark) AS in_time, count(*) FILTER (ts < mark) AS late
FROM measured GROUP BY 1, 2, 3"""),
)
def stream_late(spark, sf_dir):
    """Incident windows with a short watermark: what came in time, what came late, and both merged."""
    keys = ["window_start", "category", "severity"]

    def fold(events):
        return reports.incident_windows(parse_errors(pl.publish(events)), "1 day")

    root = _in_turns(
        spark, sf_dir, "late", LATE_FILES, lambda events: events,
        lambda root: late.split_late(root, "ts", LATENESS, fold, ["seq", "workspace_id", "job_id", "run_id", "level", "ts", "message"]),
    )
    merged = late.merged(spark.read.parquet(f"{root}/folded"), spark.read.parquet(f"{root}/late"), fold, keys, "incidents")
    return merged.withColumn("window_start", stamp("window_start"))


@query(
    "stream_rejects",
    with_views(LOG_EVENTS, select=f"""
SELECT seq, CASE event_type WHEN 'click' THEN 'malformed_json' WHEN 'signup' THEN 'missing:job_id' END AS reason,
  CASE event_type WHEN 'view' THEN 2 ELSE 3 END AS attempts, CASE event_type WHEN 'view' THEN 'done' ELSE 'dead' END AS status,
  {sql_stamp('ts')} AS first_seen, CAST(NULL AS VARCHAR) AS event_level
FROM log_events WHERE event_type IN ('click', 'view', 'signup')
UNION ALL
SELECT seq, NULL, NULL, 'event', {sql_stamp('ts')}, CASE event_type WHEN 'view' THEN 'WARN' ELSE level END
FROM log_events WHERE event_type NOT IN ('click', 'signup')"""),
)
def stream_rejects(spark, sf_dir):
    """Raw JSON on a stream: events and dead letters, after two retries that can add a missing level."""
    from .queries_logs import _json_events

    def build(events):
        return _json_events(spark, sf_dir).join(events.select("seq", F.col("ts").alias("at")), "seq")

    root = _in_turns(spark, sf_dir, "rejects", 2, build, dead_letters.json_letters)
    leveled = F.when(F.col("reason_was") == "missing:level", F.regexp_replace("value", r"\}$", ',"level":"WARN"}'))
    named = F.when(F.col("reason_was") == "missing:job_id,level", F.regexp_replace("value", r"\}$", ',"level":"INFO"}'))
    for turn in range(2):
        reasons = dead_letters.letters(spark, root).select("letter_id", F.col("reason").alias("reason_was"))
        dead_letters.retry(
            spark, root, turn,
            lambda rows: rows.join(reasons, "letter_id").withColumn("value", F.coalesce(leveled, named, F.col("value"))).drop("reason_was"),
        )
    letters = dead_letters.letters(spark, root).select(
        "seq", "reason", "attempts", "status", stamp("at").alias("first_seen"), F.lit(None).cast("string").alias("event_level")
    )
    events = spark.read.parquet(f"{root}/events").select(
        "seq", F.lit(None).cast("string").alias("reason"), F.lit(None).cast("int").alias("attempts"), F.lit("event").alias("status"),
        stamp("at").alias("first_seen"), F.col("level").alias("event_level"),
    )
    return letters.unionByName(events)


#: Files of the stream below, and batches of one epoch: two snapshots and one batch after them.
TENANT_FILES, TENANT_EPOCH = 7, 3


@query(
    "tenant_errors",
    with_views(LOG_EVENTS, RULES, ERRORS, select=f"""
SELECT workspace_id, pipeline_name, error_type, fix, {sql_stamp('detected_at')} AS detected_at, seq FROM errors
WHERE workspace_id IN (SELECT CAST(c_custkey % 20 AS VARCHAR) FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey < 2)"""),
)
def tenant_errors(spark, sf_dir):
    """The error table of some tenants, out of a state that a stream keeps by tenant in snapshots and change sets."""
    root = f"{checkpoint_folder(spark, 'tenants')}/{uuid.uuid4().hex}"
    events = tv.log_events(spark, sf_dir)
    schema = None

    def build(batch):
        nonlocal schema
        rows = pl.process_events(pl.publish(batch))
        schema = rows.schema
        return rows

    for turn in range(TENANT_FILES):
        events.filter(F.pmod("seq", F.lit(TENANT_FILES)) == turn).write.parquet(f"{root}/source/part={turn}")
        stream = streams.read_events(spark, f"{root}/source/part=*", events.schema)
        write = tenants.changes_by_tenant(f"{root}/errors", build, state.upsert_errors, every=TENANT_EPOCH)
        streams.start(stream, f"{root}/checkpoint", write).awaitTermination()
    wanted = read_table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING' AND c_nationkey < 2").select(
        F.pmod("c_custkey", F.lit(20)).cast("string").alias("workspace_id")
    )
    stored = tenants.read(spark, f"{root}/errors", schema, state.upsert_errors)
    return stored.join(wanted, "workspace_id", "left_semi").select(
        "workspace_id", "pipeline_name", "error_type", "fix", stamp("detected_at").alias("detected_at"), "seq"
    )
