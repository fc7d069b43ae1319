"""The composite pipelines, each one lazy plan over the operators."""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import text as tx
from ..operators import alerts, hypotheses, jobs, lines, prompts, quota, reports, retrieval, runbooks, scrub, state
from ..operators.exceptions import parse_errors


@dataclass
class Ingested:
    runs: DataFrame
    pipelines: DataFrame
    queue: DataFrame
    rejects: DataFrame | None = None


def ingest(
    events: DataFrame, api_keys: DataFrame | None = None, *, key: str = "api_key", seq: str = "seq", global_runs: bool = False
) -> Ingested:
    """Stamp the tenant, record runs, derive pipeline status and publish scrubbed ERROR events.

    ``events`` carry workspace_id (or an API key), job_id, run_id, level, ts, message and ``seq``; with
    ``ingest_ts`` a pipeline's last run is its last arrival.  ``global_runs`` ignores the workspace in
    the run key.
    """
    rejects = None
    if api_keys is not None:
        events, rejects = state.stamp_tenants(events, api_keys, key)
    events = events.withColumn("level", lines.normal_level(F.col("level")))
    runs = state.pipeline_runs(events, seq=seq, global_runs=global_runs)
    arrivals = events if "ingest_ts" in events.columns else None
    return Ingested(runs, state.pipeline_state(runs, arrivals, seq=seq), publish(events, seq=seq), rejects)


def publish(events: DataFrame, *, seq: str = "seq") -> DataFrame:
    """Queue records of ERROR events with redacted messages (filter first, then the regexes)."""
    clean = scrub.scrub(lines.errors_only(events), "message")
    return clean.select("workspace_id", "job_id", "run_id", "message", "ts", seq)


def analyse(
    queue: DataFrame,
    *,
    ai: Column | None = None,
    users: DataFrame | None = None,
    rules: DataFrame | None = None,
    seq: str = "seq",
    chunk: Column | None = None,
    redacted: bool = False,
    compat: bool = False,
) -> DataFrame:
    """Redact, parse, admit by quota and choose a root cause for each queue record.

    ``redacted`` says that the messages come from :func:`publish`, which has redacted them.  ``compat``
    cuts long exceptions.  ``ai`` is a struct column (root_cause, suggested_fix, confidence_score) from an external step;
    without it every event counts as not analysed and the rules decide.
    """
    clean = queue if redacted else scrub.scrub(queue, "message")
    return decide(parse_errors(clean, "message", compat=compat), ai=ai, users=users, rules=rules, seq=seq, chunk=chunk)


def decide(
    parsed: DataFrame, *, ai: Column | None = None, users: DataFrame | None = None, rules: DataFrame | None = None,
    seq: str = "seq", chunk: Column | None = None,
) -> DataFrame:
    """Admit parsed events by quota and choose their root cause (see :func:`analyse`)."""
    fallback = F.struct(
        F.lit(fv.AI_UNAVAILABLE_CAUSE).alias("root_cause"),
        F.lit(fv.AI_UNAVAILABLE_FIX).alias("suggested_fix"),
        F.lit(None).cast("double").alias("confidence_score"),
    )
    rows = parsed.withColumn("ai", fallback if ai is None else F.coalesce(ai, fallback))
    if users is None:
        rows = rows.withColumn("admitted", F.lit(True))
    else:
        billable = hypotheses.usable_ai(F.col("ai.root_cause"))
        rows = hypotheses.quota_substitute(quota.admit(rows, users, seq=seq, chunk=chunk, billable=billable))
    return hypotheses.pick_top(hypotheses.with_hypotheses(rows, rules=rules))


def error_rows(
    analysed: DataFrame, *, seq: str = "seq", embedding: str | None = None, raw_log_chars: int | None = None
) -> DataFrame:
    """Analysed events as rows of the error table; the raw log is whole unless ``raw_log_chars`` limits it."""
    return analysed.select(
        "workspace_id",
        F.col("job_id").alias("pipeline_name"),
        F.col("signature").alias("error_type"),
        F.col("final_root_cause").alias("root_cause"),
        F.col("final_fix").alias("fix"),
        F.col("ts").alias("detected_at"),
        tx.cap_raw_log(F.col("message"), raw_log_chars).alias("raw_log"),
        "severity",
        "category",
        "run_id",
        seq,
        *([embedding] if embedding else []),
    )


def process_events(queue: DataFrame, *, embedding: str | None = None, raw_log_chars: int | None = None, **options) -> DataFrame:
    """The error table that the queue records give: one row per workspace, pipeline and signature.

    ``embedding`` names a column of vectors to keep (an event without one keeps the older vector).
    """
    seq = options.get("seq", "seq")
    rows = error_rows(analyse(queue, **options), seq=seq, embedding=embedding, raw_log_chars=raw_log_chars)
    return state.upsert_errors(rows, seq=seq, embedding=embedding)


def with_context(
    analysed: DataFrame, errors: DataFrame, chunks: DataFrame, *, event_id: str = "seq",
    k: int = fv.RETRIEVAL_K, min_similarity: float = fv.RETRIEVAL_MIN_SIMILARITY,
) -> DataFrame:
    """Add the retrieved context and the prompt to events that carry an embedding."""
    options = {"event_id": event_id, "k": k, "min_similarity": min_similarity}
    incidents = retrieval.similar_incidents(analysed, errors, **options)
    sections = retrieval.runbook_sections(analysed, chunks, **options)
    context = prompts.context_lists(incidents, sections, event_id)
    described = analysed.withColumn(
        "pipeline_context",
        F.concat(F.lit("Severity: "), "severity", F.lit("\nError summary: "), "summary"),
    )
    return prompts.with_prompts(described, context, event_id)


@dataclass
class Processed:
    """What one batch of queue records gives: analysed events with their prompts, error rows to upsert, and alerts."""

    analysed: DataFrame
    errors: DataFrame
    alerts: DataFrame


def process_with_context(
    queue: DataFrame,
    errors: DataFrame,
    chunks: DataFrame,
    *,
    answer: Callable[[Column], Column] | None = None,
    users: DataFrame | None = None,
    rules: DataFrame | None = None,
    seq: str = "seq",
    chunk: Column | None = None,
    embedding: str = "embedding",
    width: str = "1 hour",
    redacted: bool = False,
    **retrieval_options,
) -> Processed:
    """The whole way of an event: redact, embed, parse, retrieve, prompt, answer, rank, upsert, alert.

    ``errors`` (with error_id) and ``chunks`` (with chunk_id) are the stored tables with embeddings.
    ``answer`` maps the prompt column to an AI result struct; without it the rules decide.  Events that
    bring an ``embedding`` column keep it, others get the offline one.
    """
    clean = queue if redacted else scrub.scrub(queue, "message")
    embedded = clean if embedding in clean.columns else retrieval.embed_text(clean, "message", embedding)
    prompted = with_context(parse_errors(embedded, "message"), errors, chunks, event_id=seq, **retrieval_options)
    ai = None if answer is None else answer(F.col("prompt"))
    analysed = decide(prompted, ai=ai, users=users, rules=rules, seq=seq, chunk=chunk)
    rows = state.upsert_errors(error_rows(analysed, seq=seq, embedding=embedding), seq=seq, embedding=embedding)
    return Processed(analysed, rows, alerts.dedup_alerts(alert_rows(analysed, seq=seq), width, order=seq))


def alert_rows(analysed: DataFrame, *, seq: str = "seq") -> DataFrame:
    return analysed.select(
        seq,
        "workspace_id",
        F.col("job_id").alias("pipeline_name"),
        "run_id",
        F.col("signature").alias("error_type"),
        F.col("final_root_cause").alias("root_cause"),
        F.col("final_fix").alias("fix"),
        alerts.alert_level(F.col("severity")).alias("severity"),
        F.col("ts").alias("detected"),
    )


def incident_summary(events: DataFrame, *, seq: str = "seq") -> DataFrame:
    """Per workspace and pipeline: the distinct signatures, severity, occurrences, last time and best fix."""
    analysed = analyse(publish(events, seq=seq), seq=seq, redacted=True)
    return analysed.groupBy(
        "workspace_id",
        F.col("job_id").alias("pipeline_name"),
        F.col("signature").alias("error_type"),
        "severity",
    ).agg(
        F.count(F.lit(1)).alias("occurrences"),
        F.max("ts").alias("last_seen"),
        F.max_by("final_fix", seq).alias("best_fix"),
    )


def dashboard(
    pipelines: DataFrame, errors: DataFrame, users: DataFrame, workspace_id: str, *, query: str = "", sort: str = "timestamp"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pipeline cards, active error cards, quota) of one workspace, searched and sorted."""
    mine = reports.for_tenant(pipelines, workspace_id)
    shown = reports.active_errors(reports.for_tenant(errors, workspace_id), mine)
    found = reports.sort_errors(reports.search_errors(shown, query), sort)
    used = users.filter(tx.workspace_of_user(F.col("id")) == workspace_id).select(
        F.col("ai_calls_used").alias("used"),
        F.col("ai_calls_limit").alias("limit"),
        quota.quota_percent(F.col("ai_calls_used"), F.col("ai_calls_limit")).alias("percent"),
        quota.quota_exceeded(F.col("ai_calls_used"), F.col("ai_calls_limit")).alias("exceeded"),
    )
    cards = reports.pipeline_cards(reports.search_pipelines(mine, query)).orderBy("name")
    return cards, reports.error_cards(found), used


def ingest_runbooks(files: DataFrame, *, embed: bool = True, **options) -> DataFrame:
    """Chunk and embed runbook files: rows for the chunk table."""
    chunks = runbooks.chunk_runbooks(files, **options)
    return retrieval.embed_text(chunks, "chunk_text") if embed else chunks


def ingest_report(chunks: DataFrame, short: DataFrame | None = None) -> DataFrame:
    """Per file: chunks stored and chunks without an embedding; with ``runbooks.short_chunks`` also those left out."""
    keys = ["workspace_id", "source_file"]
    report = chunks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("chunks_stored"),
        F.count_if(F.col("embedding").isNull()).alias("chunks_failed"),
    )
    if short is None:
        return report
    return short.join(report, keys, "left").fillna(0, ["chunks_stored", "chunks_failed"])


def replace_runbooks(current: DataFrame, files: DataFrame, **options) -> DataFrame:
    """The chunk table after ``files`` were ingested: their new chunks in place of all their old ones."""
    new = ingest_runbooks(files, **options)
    keys = ["workspace_id", "source_file"]
    return state.delete_by_key(current, files, keys).unionByName(new.select(current.columns))


def collect_logs(
    log_lines: DataFrame, job_id: Column, *, workspace_id: str = "default", identity: tuple[str, ...] = ("path", "nth")
) -> DataFrame:
    """Events of the ERROR lines of a log directory (batch or stream); ``identity`` names a line, (path, offset) for growing files."""
    from ..sources.payloads import from_parsed_lines

    parsed = lines.errors_only(lines.parse_lines(log_lines))
    return from_parsed_lines(parsed, job_id, workspace_id=workspace_id, identity=identity)


def student_analytics(students: DataFrame, grades: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(grades per department, graded rows, quarantine counts)."""
    graded = jobs.grade(jobs.join_grades(students, grades))
    return jobs.grades_per_department(graded), graded, jobs.quarantine_counts(graded)


def error_report(errors: DataFrame) -> DataFrame:
    """Schema-type errors with their fixes."""
    return reports.schema_errors(reports.error_cards(errors)).select("pipeline", "error", "fix")
