"""The pipelines as Structured Streaming queries.

Delivery is at least once with idempotent writes: the checkpoint holds the source offsets, and each
micro-batch writes its change set under its own batch id, so a replayed batch replaces itself.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import alerts, hypotheses, quota, reports, scrub, state
from ..operators.exceptions import parse_errors
from ..plans import pipelines as pl
from ..sources import payloads
from ..sources.tables import BATCH, append_changes, read_changes


def read_events(
    spark: SparkSession, directory: str, schema: T.StructType, *, fmt: str = "parquet", files_per_trigger: int = 1000,
    glob: str = "*",
) -> DataFrame:
    """Events from files that arrive in a folder, ``files_per_trigger`` at a time."""
    return (
        spark.readStream.format(fmt)
        .schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .option("pathGlobFilter", glob)
        .load(directory)
    )


def read_queue(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """JSON texts of a Kafka topic, new records only (needs the Kafka connector on the classpath)."""
    stream = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "latest")
        .load()
    )
    return stream.select(F.col("value").cast("string").alias("value"), F.col("timestamp").alias("ingest_ts"))


def dedup_runs(events: DataFrame, horizon: str = "2 days") -> DataFrame:
    """First event of each run; a duplicate later than ``horizon`` behind the watermark may pass.

    The horizon bounds the state.  The run table drops such late duplicates when it is reduced, so
    only consumers of the stream itself see them.
    """
    return events.withWatermark("ts", horizon).dropDuplicatesWithinWatermark(["workspace_id", "run_id"])


def dedup_alerts(alert_rows: DataFrame, horizon: str = "1 hour") -> DataFrame:
    """One alert per workspace, dedup key and tumbling window of ``horizon``: the rule of the batch form."""
    keyed = alert_rows.withColumn("dedup_key", alerts.dedup_key()).withColumn("window_start", F.window("detected", horizon)["start"])
    return keyed.withWatermark("detected", horizon).dropDuplicatesWithinWatermark(["workspace_id", "dedup_key", "window_start"])


def incident_windows(events: DataFrame, width: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """Incidents per window, category and severity of an event stream."""
    parsed = parse_errors(pl.publish(events))
    return reports.incident_windows(parsed.withWatermark("ts", lateness), width)


def pipeline_updates(runs: DataFrame, *, seq: str = "seq") -> DataFrame:
    """Running pipeline state; one status per pipeline is kept, whatever the number of runs."""
    return state.pipeline_state(runs, seq=seq)


def start(
    df: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], *, mode: str = "append", once: bool = True
) -> StreamingQuery:
    """Run ``write`` on every micro-batch; ``once`` stops after the data that is there now."""
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()


def start_files(df: DataFrame, checkpoint: str, path: str, *, once: bool = True) -> StreamingQuery:
    """Append a stream to a Parquet folder exactly once (the queue sink)."""
    writer = df.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()


def run_changes(root: str) -> Callable[[DataFrame, int], None]:
    """Batch writer: first arrivals per run to ``root/runs`` and queue records to ``root/queue``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()
        try:
            ingested = pl.ingest(held)
            append_changes(ingested.runs, f"{root}/runs", batch_id)
            append_changes(ingested.queue, f"{root}/queue", batch_id)
        finally:
            held.unpersist()

    return write


def json_changes(root: str, ingest_ts: Column) -> Callable[[DataFrame, int], None]:
    """Batch writer for raw JSON: accepted events to ``root/events``, the others to ``root/rejects``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()
        try:
            accepted, rejects = payloads.parse_json(held)
            append_changes(payloads.with_event_time(accepted, ingest_ts), f"{root}/events", batch_id)
            append_changes(rejects, f"{root}/rejects", batch_id)
        finally:
            held.unpersist()

    return write


USAGE = T.StructType([T.StructField("workspace_id", T.StringType()), T.StructField("ai_calls", T.LongType())])


def usage_before(spark: SparkSession, usage_path: str, batch_id: int) -> DataFrame:
    """Calls per workspace billed by all batches before this one: the running totals that the last one left.

    One change set is read, however many batches there were.  Folders written without totals are summed.
    """
    totals = f"{usage_path}_totals"
    last = read_changes(spark, f"{totals}/{BATCH}={batch_id - 1:012d}", USAGE).drop(BATCH) if batch_id else None
    if last is not None and last.inputFiles():
        return last
    earlier = read_changes(spark, usage_path, USAGE).filter(F.col(BATCH) < batch_id)
    return earlier.groupBy("workspace_id").agg(F.sum("ai_calls").alias("ai_calls"))


def fold_usage(before: DataFrame, billed: DataFrame, usage_path: str, batch_id: int) -> None:
    """The batch's usage as a change set, and the running totals with it added."""
    append_changes(billed, usage_path, batch_id)
    total = before.unionByName(billed).groupBy("workspace_id").agg(F.sum("ai_calls").alias("ai_calls"))
    append_changes(total, f"{usage_path}_totals", batch_id)


def error_changes(
    path: str, *, users: DataFrame | None = None, usage_path: str | None = None, embedding: str | None = None,
    raw_log_chars: int | None = None, **options,
) -> Callable[[DataFrame, int], None]:
    """Batch writer: the batch's error rows, already reduced to one per key, as a change set.

    With ``users`` and ``usage_path`` the quota goes on from batch to batch: calls that gave a result
    are kept as change sets and folded into running totals, which count against the limits.  A batch
    reads the totals of the one before, so its work does not grow with the stream's life; a replayed batch reads
    the same totals and replaces its own.
    """
    seq = options.get("seq", "seq")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, limits = batch.sparkSession, users
        if users is not None and usage_path:
            before = usage_before(spark, usage_path, batch_id)
            limits = quota.add_usage(users, before)
        # The quota reads the events twice (sums by piece, positions inside it), so what is parsed is held.
        how = {k: v for k, v in options.items() if k not in ("redacted", "compat")}
        clean = batch if options.get("redacted") else scrub.scrub(batch, "message")
        parsed = parse_errors(clean, "message", compat=options.get("compat", False))
        held = parsed.persist() if limits is not None else parsed
        analysed = pl.decide(held, users=limits, **how).persist()
        try:
            rows = pl.error_rows(analysed, seq=seq, embedding=embedding, raw_log_chars=raw_log_chars)
            append_changes(state.upsert_errors(rows, seq=seq, embedding=embedding), path, batch_id)
            if users is not None and usage_path:
                billed = quota.usage(analysed, billable=hypotheses.usable_ai(F.col("ai.root_cause")))
                fold_usage(before, billed, usage_path, batch_id)
        finally:
            analysed.unpersist()
            held.unpersist()

    return write
