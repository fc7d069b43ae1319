"""Tenant stamping and the keyed state tables: runs, pipelines, errors, chunks."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .lines import run_status


def stamp_tenants(events: DataFrame, api_keys: DataFrame, key: str = "api_key") -> tuple[DataFrame, DataFrame]:
    """Replace each event's workspace by the one its API key belongs to.

    Returns (accepted, rejected).  Rejected rows carry ``reason``: no key, unknown key or revoked
    key.  Keys are compared by SHA-256.  The key table has no broadcast hint: Spark broadcasts it
    only while it is below the size threshold, and adaptive skew handling splits a hot key beyond.
    """
    hashed = events.withColumn(
        "_hash", F.when(F.col(key) != "", tx.key_hash(F.col(key)))
    )
    known = api_keys.groupBy("key_hash").agg(
        F.max_by("workspace_id", F.struct(F.col("is_active"), F.col("workspace_id"))).alias("_workspace"),
        F.max("is_active").alias("_active"),
    )
    accepted = (
        hashed.join(known.filter("_active"), hashed["_hash"] == known["key_hash"])
        .withColumn("workspace_id", F.col("_workspace"))
        .drop("_workspace", "_active", "_hash", "key_hash", key)
    )
    # Events without a key skip the join: as null keys they would all meet in one partition.
    keyless = hashed.filter(F.col("_hash").isNull()).withColumn("reason", F.lit("missing_key"))
    keyed = hashed.filter(F.col("_hash").isNotNull())
    refused = (
        keyed.join(known, keyed["_hash"] == known["key_hash"], "left")
        .filter(F.col("_active").isNull() | ~F.col("_active"))
        .withColumn("reason", F.when(F.col("_active").isNull(), F.lit("unknown_key")).otherwise(F.lit("revoked_key")))
        .drop("_workspace", "_active", "key_hash")
    )
    return accepted, keyless.unionByName(refused).drop("_hash")


def first_by(df: DataFrame, keys: Sequence[str], order: str | Column) -> DataFrame:
    """The first row of each key by ``order``.  Each map task keeps one row per key before the shuffle."""
    return _pick(df, keys, order, F.min_by)


def last_by(df: DataFrame, keys: Sequence[str], order: str | Column) -> DataFrame:
    """The last row of each key by ``order``, with the same map-side reduction."""
    return _pick(df, keys, order, F.max_by)


def _pick(df, keys, order, fn):
    keys = list(keys)
    order = F.col(order) if isinstance(order, str) else order
    rest = [c for c in df.columns if c not in keys]
    row = fn(F.struct(*rest), order).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, "_row.*").select(*df.columns)


def dedup_runs(events: DataFrame, *, seq: str = "seq", global_runs: bool = False) -> DataFrame:
    """One row per run: the first arrival wins.  ``global_runs`` ignores the workspace in the key."""
    keys = ["run_id"] if global_runs else ["workspace_id", "run_id"]
    return first_by(events, keys, seq)


def pipeline_runs(events: DataFrame, *, seq: str = "seq", global_runs: bool = False) -> DataFrame:
    """Run table (workspace, pipeline, run, status, created ts, arrival seq)."""
    rows = events.select(
        "workspace_id",
        F.col("job_id").alias("pipeline_name"),
        "run_id",
        run_status(F.col("level")).alias("status"),
        F.col("ts").alias("created_at"),
        seq,
    )
    return dedup_runs(rows, seq=seq, global_runs=global_runs)


def pipeline_state(runs: DataFrame, events: DataFrame | None = None, *, seq: str = "seq") -> DataFrame:
    """Status of the newest run per pipeline by event time, so a late old error changes nothing.

    ``last_run`` is the greatest arrival time: ``ingest_ts`` of ``events`` if given, else the run's own time.
    """
    keys = ["workspace_id", "pipeline_name"]
    status = runs.groupBy(*keys).agg(
        F.max_by("status", F.struct("created_at", seq)).alias("status"),
        F.max("created_at").alias("last_run"),
    )
    if events is None:
        return status
    seen = events.groupBy("workspace_id", F.col("job_id").alias("pipeline_name")).agg(
        F.max("ingest_ts").alias("last_run")
    )
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    return status.drop("last_run").alias("l").join(seen.alias("r"), same[0] & same[1]).select("l.*", "r.last_run")


ERROR_KEYS = ["workspace_id", "pipeline_name", "error_type"]


def upsert_errors(errors: DataFrame, *, seq: str = "seq", embedding: str | None = None) -> DataFrame:
    """One row per error key; the last event's fields win, a null embedding keeps the older one.

    Order-insensitive and idempotent, so a replayed batch gives the same table.
    """
    fields = [c for c in errors.columns if c not in (*ERROR_KEYS, embedding)]
    aggregates = [F.max_by(F.struct(*fields), F.col(seq)).alias("_row")]
    if embedding:
        order = F.when(F.col(embedding).isNotNull(), F.col(seq))
        aggregates.append(F.max_by(embedding, order).alias(embedding))
    merged = errors.groupBy(*ERROR_KEYS).agg(*aggregates)
    return merged.select(*ERROR_KEYS, "_row.*", *([embedding] if embedding else []))


def replace_by_key(current: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``current`` whose key is not in ``incoming``, plus all of ``incoming``."""
    return delete_by_key(current, incoming, keys).unionByName(incoming)


def delete_by_key(current: DataFrame, doomed: DataFrame, keys: Sequence[str]) -> DataFrame:
    return current.join(doomed.select(*keys).distinct(), list(keys), "left_anti")


def unknown_pipelines(requests: DataFrame, pipelines: DataFrame) -> DataFrame:
    """Requested (workspace, pipeline) pairs that no pipeline row has."""
    keys = ["workspace_id", "pipeline_name"]
    return requests.select(*keys).distinct().join(pipelines, keys, "left_anti")
