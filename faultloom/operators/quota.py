"""AI-call quota: admission, usage, percentages and the grant ledger."""

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from .positions import with_sum_before

# Send the functions of this module with the job: executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def admit(
    events: DataFrame, users: DataFrame, *, seq: str = "seq", chunk: Column | None = None, billable: Column | None = None
) -> DataFrame:
    """Mark each event ``admitted`` while its workspace's calls stay below the limit, in ``seq`` order.

    Only ``billable`` events use up calls (by default all do): a call that gave no result is not
    counted, so the events after it are still admitted.  ``users`` has workspace_id, ai_calls_used, ai_calls_limit.  Workspaces without a user row are
    not limited.  A usage row is looked up per event, positions are computed per (workspace, piece),
    so one hot workspace does not end up in one task.
    """
    limits = users.select(
        F.col("workspace_id").alias("_ws"), (F.col("ai_calls_limit") - F.col("ai_calls_used")).alias("_left")
    )
    calls = F.lit(1) if billable is None else F.coalesce(billable.cast("long"), F.lit(0))
    counted = with_sum_before(events, ["workspace_id"], seq, calls, chunk=chunk, out="_before")
    joined = counted.join(limits, counted["workspace_id"] == limits["_ws"], "left")
    allowed = F.col("_left").isNull() | (F.col("_before") < F.col("_left"))
    return joined.withColumn("admitted", allowed).drop("_ws", "_left", "_before")


def usage(admitted: DataFrame, *, billable: Column | None = None) -> DataFrame:
    """Calls to add per workspace: admitted events that gave a real AI result."""
    counts = F.col("admitted") if billable is None else F.col("admitted") & billable
    return admitted.groupBy("workspace_id").agg(F.count_if(counts).alias("ai_calls"))


def add_usage(users: DataFrame, calls: DataFrame) -> DataFrame:
    """Users with the calls of :func:`usage` added to ``ai_calls_used``."""
    added = users.join(calls, "workspace_id", "left")
    return added.withColumn("ai_calls_used", F.col("ai_calls_used") + F.coalesce("ai_calls", F.lit(0))).drop("ai_calls")


def quota_percent(used: Column, limit: Column) -> Column:
    """min(100, round(100·used/limit)) with halves rounded up; null limit or zero limit gives null."""
    ratio = F.try_divide(used.cast("double"), limit.cast("double")) * 100
    return F.least(F.lit(100), F.floor(ratio + 0.5).cast("int"))


def quota_exceeded(used: Column, limit: Column) -> Column:
    return used >= limit


def cooldown_remaining(last_grant: Column, now: Column) -> Column:
    """Struct (hours, minutes) until the next grant is allowed; null when it already is."""
    left = F.lit(fv.GRANT_COOLDOWN_SECONDS) - (F.unix_seconds(now) - F.unix_seconds(last_grant))
    hours = F.floor(left / 3600).cast("int")
    minutes = F.floor((left % 3600) / 60).cast("int")
    return F.when(left > 0, F.struct(hours.alias("hours"), minutes.alias("minutes")))


def apply_ledger(users: DataFrame, actions: DataFrame) -> DataFrame:
    """Quota state after all admin actions: (workspace_id, ai_calls_used, ai_calls_limit, last_grant_at).

    A grant adds 1000 calls unless the last accepted grant is under 24 hours old; a reset sets used
    to 0, limit to 1000 and clears the cooldown.  Nothing before a user's last reset matters, so those
    actions are dropped first.  What is left is read in order as a stream of sorted rows with one
    user's state in memory; no group is collected.
    """
    key, when = "workspace_id", F.struct("ts", "seq")
    resets = actions.filter(F.col("action") == "reset").groupBy(key).agg(F.max(when).alias("_reset"))
    base = (
        users.select(key, "ai_calls_used", "ai_calls_limit", "last_grant_at")
        .join(resets, key, "left")
        .withColumn("ai_calls_used", F.when(F.col("_reset").isNull(), F.col("ai_calls_used")).otherwise(F.lit(0)))
        .withColumn(
            "ai_calls_limit",
            F.when(F.col("_reset").isNull(), F.col("ai_calls_limit")).otherwise(F.lit(fv.GRANT_CALLS)),
        )
        .withColumn("last_grant_at", F.when(F.col("_reset").isNull(), F.col("last_grant_at")))
    )
    grants = actions.filter(F.col("action") == "grant").join(
        base.select(key, "_reset", F.unix_micros("last_grant_at").alias("_start")), key
    )
    live = grants.filter(F.col("_reset").isNull() | (when > F.col("_reset")))
    ordered = (
        live.select(key, F.unix_micros("ts").alias("t"), "seq", "_start")
        .repartition(key)
        .sortWithinPartitions(key, "t", "seq")
        .select(key, "t", "_start")
    )
    gap = fv.GRANT_COOLDOWN_SECONDS * 1_000_000

    def accepted(batches):
        user, last, count, found = None, None, 0, []
        for rows in batches:
            for ws, t, start in zip(rows[key], rows["t"], rows["_start"]):
                if ws != user:
                    if user is not None:
                        found.append((user, count, last))
                    user, count = ws, 0
                    last = None if pd.isna(start) else int(start)
                if last is None or t - last >= gap:
                    last, count = int(t), count + 1
            if len(found) >= 10_000:
                yield pd.DataFrame(found, columns=[key, "_n", "_last"])
                found = []
        if user is not None:
            found.append((user, count, last))
        if found:
            yield pd.DataFrame(found, columns=[key, "_n", "_last"])

    totals = ordered.mapInPandas(accepted, f"{key} string, _n bigint, _last bigint")
    return base.join(totals, key, "left").select(
        key,
        "ai_calls_used",
        (F.col("ai_calls_limit") + F.coalesce("_n", F.lit(0)) * fv.GRANT_CALLS).alias("ai_calls_limit"),
        F.coalesce(F.timestamp_micros("_last"), "last_grant_at").alias("last_grant_at"),
    )
