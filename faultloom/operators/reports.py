"""Dashboard and admin queries over the result tables."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import text as tx


def for_tenant(df: DataFrame, workspace_id: str) -> DataFrame:
    """The mandatory tenant predicate; reaches the scan as a pushed or partition filter."""
    return df.filter(F.col("workspace_id") == workspace_id)


def active_errors(errors: DataFrame, pipelines: DataFrame) -> DataFrame:
    """Errors of pipelines that are failing now; errors without a pipeline row are hidden."""
    failing = pipelines.filter(F.col("status") == "Failed").select("workspace_id", "pipeline_name")
    return errors.join(failing, ["workspace_id", "pipeline_name"], "left_semi")


def search(df: DataFrame, query: str, columns: Sequence[str]) -> DataFrame:
    """Rows where any of ``columns`` contains the trimmed query, ignoring case; a blank query keeps all."""
    wanted = query.strip().lower()
    if not wanted:
        return df
    hits = [F.coalesce(F.contains(F.lower(F.col(c)), F.lit(wanted)), F.lit(False)) for c in columns]
    return df.filter(reduce(lambda a, b: a | b, hits))


def search_pipelines(pipelines: DataFrame, query: str) -> DataFrame:
    return search(pipelines, query, ["pipeline_name", "status", "last_run"])


def search_errors(errors: DataFrame, query: str) -> DataFrame:
    return search(errors, query, ["pipeline_name", "error_type", "root_cause", "fix"])


def sort_errors(errors: DataFrame, key: str = "timestamp") -> DataFrame:
    """Newest first with missing times last, or by pipeline name; ties by the error key."""
    ties = [F.col("workspace_id"), F.col("pipeline_name"), F.col("error_type")]
    if key == "pipeline":
        return errors.orderBy("pipeline_name", "workspace_id", "error_type")
    return errors.orderBy(F.col("detected_at").desc_nulls_last(), *ties)


def sort_runs(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.col("created_at").desc_nulls_last(), F.col("run_id"))


def recent_errors(errors: DataFrame, n: int = 4) -> DataFrame:
    """The n newest errors that have a time (one top-n per task, then one merge)."""
    return sort_errors(errors.filter(F.col("detected_at").isNotNull())).limit(n)


def first_pipelines(pipelines: DataFrame, n: int = 6) -> DataFrame:
    """The first n pipeline cards by name (and workspace), as the start page shows them."""
    return pipelines.orderBy("pipeline_name", "workspace_id").limit(n)


def recent_signups(users: DataFrame, n: int = 10) -> DataFrame:
    return users.orderBy(F.col("created_at").desc_nulls_last(), F.col("id")).limit(n)


def status_counts(pipelines: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return pipelines.groupBy(*by).agg(
        F.count_if(F.col("status") == "Failed").alias("failed"),
        F.count_if(F.col("status") == "Success").alias("success"),
        F.count(F.lit(1)).alias("total"),
    )


def admin_totals(users: DataFrame, pipelines: DataFrame, errors: DataFrame, runs: DataFrame) -> DataFrame:
    """One row of totals: each table gives one partial row, the rows are added up."""
    measures = ["total_users", "paid_users", "total_pipelines", "total_errors", "total_runs"]

    def part(df: DataFrame, **counts: Column) -> DataFrame:
        return df.agg(*[F.coalesce(counts.get(m, F.lit(0)), F.lit(0)).cast("long").alias(m) for m in measures])

    one = F.count(F.lit(1))
    stacked = (
        part(users, total_users=one, paid_users=F.count_if("paid"))
        .unionByName(part(pipelines, total_pipelines=one))
        .unionByName(part(errors, total_errors=one))
        .unionByName(part(runs, total_runs=one))
    )
    total = stacked.agg(*[F.sum(m).alias(m) for m in measures])
    return total.withColumn("free_users", F.col("total_users") - F.col("paid_users"))


def users_by_plan(users: DataFrame) -> DataFrame:
    return users.groupBy("plan").agg(F.count(F.lit(1)).alias("n_users"))


def user_activity(
    users: DataFrame, pipelines: DataFrame, errors: DataFrame, runs: DataFrame, api_keys: DataFrame
) -> DataFrame:
    """Counts of pipelines, errors and runs per user plus the prefix of one active key (the smallest).

    Each table is aggregated per workspace before it meets the users, so the joins move one row per
    workspace whatever the size of the table.
    """
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("workspace_id").agg(F.count(F.lit(1)).alias(name))

    keys = api_keys.filter("is_active").groupBy("workspace_id").agg(F.min("key_prefix").alias("api_key_prefix"))
    out = users.withColumn("workspace_id", tx.workspace_of_user(F.col("id")))
    for table, name in ((pipelines, "pipeline_count"), (errors, "error_count"), (runs, "run_count")):
        out = out.join(counted(table, name), "workspace_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out.join(keys, "workspace_id", "left")


def backfill(df: DataFrame, defaults: dict) -> DataFrame:
    return df.fillna(defaults)


def violations(df: DataFrame, rules: dict[str, Column], keys: Sequence[str]) -> DataFrame:
    """One row per broken rule and row: (keys, rule).  A rule that evaluates to null counts as met.

    ``rules`` maps a name to the condition that must hold, as a CHECK constraint does.
    """
    broken = F.array_compact(
        F.array(*[F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in rules.items()])
    )
    return df.select(*keys, F.explode(broken).alias("rule"))


def status_rule(column: str = "status") -> Column:
    return F.col(column).isin(fv.RUN_STATUSES)


def plan_rule(column: str = "plan") -> Column:
    return F.col(column).isin(fv.PLANS)


def pipeline_cards(pipelines: DataFrame) -> DataFrame:
    return pipelines.select(F.col("pipeline_name").alias("name"), "status", F.col("last_run").alias("lastRun"))


def error_cards(errors: DataFrame) -> DataFrame:
    return errors.select(
        F.col("pipeline_name").alias("pipeline"),
        F.col("error_type").alias("error"),
        F.col("root_cause").alias("rootCause"),
        "fix",
        F.col("detected_at").alias("detectedAt"),
        F.col("raw_log").alias("rawLog"),
    )


def run_cards(runs: DataFrame) -> DataFrame:
    return runs.select(F.col("run_id").alias("runId"), "status", F.col("created_at").alias("createdAt"))


def schema_errors(errors: DataFrame, column: str = "error") -> DataFrame:
    """Errors whose type speaks of a schema or a missing key."""
    return errors.filter(F.rlike(F.col(column), F.lit("SCHEMA|MISSING_KEY")))


def incident_windows(incidents: DataFrame, width: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Incidents per tumbling window, category and severity; add a watermark first on a stream."""
    return (
        incidents.groupBy(F.window(ts, width).alias("_w"), "category", "severity")
        .agg(F.count(F.lit(1)).alias("incidents"))
        .select(F.col("_w.start").alias("window_start"), "category", "severity", "incidents")
    )
