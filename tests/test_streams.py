"""Streams give the batch result, reject bad rows, and survive replays."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from faultloom.operators import state
from faultloom.plans import pipelines as pl
from faultloom.sources import logs, tables
from faultloom.streaming import streams

T0 = dt.datetime(2026, 1, 1)
EVENT = "seq long, workspace_id string, job_id string, run_id string, level string, ts timestamp, message string"


@pytest.fixture
def source(spark, tmp_path):
    rows = [
        (i, f"w{i % 2}", f"j{i % 3}", f"r{i // 4}", "ERROR" if i % 3 else "INFO", T0 + dt.timedelta(minutes=(i * 37) % 60),
         f"KeyError: 'k{i}'" if i % 2 else f"ValueError: {i} from a{i}@b.example")
        for i in range(60)
    ]
    events = spark.createDataFrame(rows, EVENT)
    path = str(tmp_path / "source")
    events.repartitionByRange(4, "seq").write.parquet(path)
    return events, path


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_replayed_stream_gives_the_batch_table(spark, source, tmp_path):
    events, path = source
    want = rows(pl.process_events(pl.publish(events)))
    for attempt in ("first", "again"):
        stream = streams.read_events(spark, path, events.schema, files_per_trigger=1)
        streams.start(
            pl.publish(stream), str(tmp_path / attempt), streams.error_changes(str(tmp_path / "errors"))
        ).awaitTermination()
        schema = pl.process_events(pl.publish(events)).schema
        assert rows(tables.current_rows(spark, str(tmp_path / "errors"), schema, state.upsert_errors)) == want


def test_running_status_in_update_mode(spark, source, tmp_path):
    events, path = source
    runs = events.select(
        "workspace_id", F.col("job_id").alias("pipeline_name"), F.col("level").alias("status"), F.col("ts").alias("created_at"), "seq"
    )
    stream = streams.read_events(spark, path, events.schema, files_per_trigger=1).select(
        "workspace_id", F.col("job_id").alias("pipeline_name"), F.col("level").alias("status"), F.col("ts").alias("created_at"), "seq"
    )
    out = str(tmp_path / "out")
    streams.start(
        streams.pipeline_updates(stream), str(tmp_path / "cp"), lambda b, i: tables.append_changes(b, out, i), mode="update"
    ).awaitTermination()
    keys = ["workspace_id", "pipeline_name"]
    latest = spark.read.parquet(out).groupBy(*keys).agg(F.max_by(F.struct("status", "last_run"), "batch_id").alias("r"))
    assert rows(latest.select(*keys, "r.*")) == rows(state.pipeline_state(runs))


def test_late_duplicate_runs_are_dropped_within_the_horizon(spark, source, tmp_path):
    events, path = source
    out = str(tmp_path / "out")
    stream = streams.dedup_runs(streams.read_events(spark, path, events.schema, files_per_trigger=1), "1 hour")
    streams.start_files(stream.select("workspace_id", "run_id"), str(tmp_path / "cp"), out).awaitTermination()
    assert rows(spark.read.parquet(out)) == rows(events.select("workspace_id", "run_id").distinct())


def test_json_stream_splits_rejects(spark, tmp_path):
    (tmp_path / "in").mkdir()
    good = '{"source":"s","job_id":"j","run_id":"r","level":"ERROR","timestamp":"2026-01-01T00:00:00Z","message":"m"}'
    (tmp_path / "in" / "a.txt").write_text(good + "\n{broken\n")
    (tmp_path / "in" / "b.txt").write_text('{"source":"s"}\n')
    stream = streams.read_events(spark, str(tmp_path / "in"), "value string", fmt="text", files_per_trigger=1)
    root = str(tmp_path / "out")
    streams.start(stream, str(tmp_path / "cp"), streams.json_changes(root, F.current_timestamp())).awaitTermination()
    assert [r.job_id for r in spark.read.parquet(f"{root}/events").collect()] == ["j"]
    assert spark.read.parquet(f"{root}/rejects").count() == 2


def test_log_folder_stream(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.log").write_text("2026-03-08T10:23:45Z ERROR one\n2026-03-08T10:23:45Z INFO two\n")
    (tmp_path / "logs" / "b.md").write_text("2026-03-08T10:23:45Z ERROR three\n")
    events = pl.collect_logs(logs.stream_log_lines(spark, str(tmp_path / "logs")), F.lit("job"))
    out = str(tmp_path / "out")
    streams.start_files(events, str(tmp_path / "cp"), out).awaitTermination()
    assert [r.message for r in spark.read.parquet(out).collect()] == ["one"]


def test_alert_stream_keeps_one_per_key(spark, source, tmp_path):
    events, path = source
    stream = streams.read_events(spark, path, events.schema, files_per_trigger=1)
    alerts = streams.dedup_alerts(pl.alert_rows(pl.analyse(pl.publish(stream))), "1 day")
    out = str(tmp_path / "out")
    streams.start_files(alerts.select("workspace_id", "dedup_key"), str(tmp_path / "cp"), out).awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == got.distinct().count() == pl.process_events(pl.publish(events)).count()
