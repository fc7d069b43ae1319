"""Run, error, tenant and quota state, including hot keys and replays."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from faultloom.operators import alerts, hypotheses, jobs, lines, quota, state
from faultloom.operators.positions import chunk_of, with_position
from faultloom.plans import pipelines as pl
from faultloom.sources import payloads, tables
from faultloom.schemas import AI_RESULT, GRADES, LOG_EVENT, STUDENTS

T0 = dt.datetime(2026, 1, 1)
EVENT = "seq long, workspace_id string, job_id string, run_id string, level string, ts timestamp, message string"


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def test_late_old_error_does_not_flip_a_recovered_pipeline(spark):
    rows = [(1, "w", "j", "r1", "INFO", at(10), "ok"), (2, "w", "j", "r0", "ERROR", at(1), "late")]
    runs = state.pipeline_runs(spark.createDataFrame(rows, EVENT))
    assert state.pipeline_state(runs).first().status == "Success"


def test_run_dedup_keys(spark):
    rows = [(1, "a", "j", "r", "ERROR", at(1), ""), (2, "a", "j", "r", "INFO", at(2), ""), (3, "b", "j", "r", "INFO", at(3), "")]
    events = spark.createDataFrame(rows, EVENT)
    assert state.pipeline_runs(events).count() == 2
    assert [r.status for r in state.pipeline_runs(events, global_runs=True).collect()] == ["Failed"]


@pytest.mark.parametrize("level, status", [("ERROR", "Failed"), ("error", "Failed"), ("FATAL", "Success"), ("INFO", "Success")])
def test_run_status(spark, level, status):
    df = spark.createDataFrame([(level,)], "level string")
    assert df.select(lines.run_status(F.col("level")).alias("s")).first().s == status


def test_upsert_is_order_free_and_keeps_the_embedding(spark):
    rows = [
        ("w", "p", "e", 1, "old", [1.0]), ("w", "p", "e", 2, "new", None), ("w", "p", "f", 3, "other", None),
    ]
    schema = "workspace_id string, pipeline_name string, error_type string, seq long, root_cause string, embedding array<float>"
    for order in (rows, rows[::-1]):
        df = state.upsert_errors(spark.createDataFrame(order, schema), embedding="embedding")
        got = {r.error_type: (r.root_cause, r.embedding) for r in df.collect()}
        assert got == {"e": ("new", [1.0]), "f": ("other", None)}


def test_tenant_of_the_key_wins(spark):
    keys = [("k1", "ws1", True), ("k2", "ws2", False)]
    api = spark.createDataFrame(keys, "k string, workspace_id string, is_active boolean").withColumn("key_hash", F.sha2("k", 256)).drop("k")
    events = spark.createDataFrame(
        [(1, "evil", "k1"), (2, "x", "k2"), (3, "x", "nope"), (4, "x", None), (5, "x", "")],
        "seq int, workspace_id string, api_key string",
    )
    good, bad = state.stamp_tenants(events, api)
    assert [(r.seq, r.workspace_id) for r in good.collect()] == [(1, "ws1")]
    assert {r.seq: r.reason for r in bad.collect()} == {
        2: "revoked_key", 3: "unknown_key", 4: "missing_key", 5: "missing_key"
    }


def test_position_with_a_hot_key(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.6 else rng.choice("abc"), i) for i in range(4000)]
    rng.shuffle(rows)
    df = with_position(spark.createDataFrame(rows, "k string, seq long"), ["k"], "seq", chunk=chunk_of("seq", 100))
    seen: dict[str, int] = {}
    want = {}
    for k, seq in sorted(rows, key=lambda r: r[1]):
        seen[k] = seen.get(k, 0) + 1
        want[seq] = seen[k]
    assert {r.seq: r.position for r in df.collect()} == want


def test_quota_without_user_row_is_not_enforced(spark):
    events = spark.createDataFrame([("a", i) for i in range(5)] + [("b", i) for i in range(5, 8)], "workspace_id string, seq long")
    users = spark.createDataFrame([("a", 98, 100)], "workspace_id string, ai_calls_used long, ai_calls_limit long")
    got = {r.seq: r.admitted for r in quota.admit(events, users).collect()}
    assert [got[i] for i in range(8)] == [True, True, False, False, False, True, True, True]


def test_usage_is_added(spark):
    users = spark.createDataFrame([("a", 1), ("b", 2)], "workspace_id string, ai_calls_used long")
    events = spark.createDataFrame([("a", True), ("a", False), ("a", True)], "workspace_id string, admitted boolean")
    got = {r.workspace_id: r.ai_calls_used for r in quota.add_usage(users, quota.usage(events)).collect()}
    assert got == {"a": 3, "b": 2}


def test_ledger(spark):
    users = spark.createDataFrame(
        [("a", 5, 100, None), ("b", 7, 100, T0), ("c", 1, 100, None)],
        "workspace_id string, ai_calls_used long, ai_calls_limit long, last_grant_at timestamp",
    )
    hour = 60
    rows = [
        ("a", "grant", at(0), 1), ("a", "grant", at(23 * hour), 2), ("a", "grant", at(24 * hour), 3),
        ("b", "grant", at(5), 4), ("b", "reset", at(6), 5), ("b", "grant", at(7), 6),
    ]
    actions = spark.createDataFrame(rows, "workspace_id string, action string, ts timestamp, seq long")
    got = {r.workspace_id: (r.ai_calls_used, r.ai_calls_limit, r.last_grant_at) for r in quota.apply_ledger(users, actions).collect()}
    assert got == {"a": (5, 2100, at(24 * hour)), "b": (0, 2000, at(7)), "c": (1, 100, None)}


def choose(spark, signature, cause, score):
    df = spark.createDataFrame([(signature, (cause, "f", score))], "signature string, ai " + AI_RESULT.simpleString())
    return hypotheses.pick_top(hypotheses.with_hypotheses(df)).first()


@pytest.mark.parametrize(
    "signature, cause, score, source",
    [
        ("OOM:X", "c", 0.95, "ai"), ("OOM:X", "c", 0.5, "rule"), ("OOM:X", "c", None, "rule"), ("OOM:X", "c", 0.82, "ai"),
        ("OOM:X", "Service unavailable", 0.9, "rule"), ("UNKNOWN:X", "Service unavailable", 0.9, None),
        ("UNKNOWN:X", "c", None, "ai"), ("UNKNOWN:X", " ", 0.9, None), ("DB_ERROR:X", None, None, None),
    ],
)
def test_hypothesis_choice(spark, signature, cause, score, source):
    row = choose(spark, signature, cause, score)
    assert row.cause_source == source
    if source is None:
        assert row.final_root_cause == (cause if cause is not None else "Pending")


def test_json_rejects(spark):
    good = '{"source":"s","job_id":"j","run_id":"r","level":"error","timestamp":"2026-01-01T00:00:00+05:30","message":"m","x":1}'
    raw = spark.createDataFrame([(good,), ('{"source":"s"}',), ("{oops",), ("[1]",), (None,)], "value string")
    accepted, rejects = payloads.parse_json(raw)
    timed = payloads.with_event_time(accepted, F.current_timestamp()).first()
    assert timed.ts == dt.datetime(2025, 12, 31, 18, 30) and timed.level == "ERROR"
    assert sorted(str(r.reason) for r in rejects.collect()) == [
        "malformed_json", "malformed_json", "malformed_json", "missing:job_id,run_id,level,timestamp,message"
    ]


def test_generic_run_id_is_replay_safe(spark):
    raw = spark.createDataFrame([('{"pipeline":"p","message":"m","level":"warning"}',)] * 2, "value string")
    accepted, _ = payloads.parse_json(raw, form="generic")
    rows = payloads.from_generic(accepted, F.lit("2026-01-01T00:00:00Z")).collect()
    assert rows[0].run_id == rows[1].run_id and rows[0].level == "WARNING" and rows[0].source == "webhook"
    assert [f.name for f in LOG_EVENT.fields] == rows[0].__fields__


def test_jobs(spark):
    students = spark.createDataFrame([(1, "a", "CS", 1, "x"), (2, "b", "Math", 1, "y")], STUDENTS)
    scores = ["92", "88.5", " 71 ", "60", "12", "N/A", "", None, "5d", "nan"]
    grades = spark.createDataFrame([(1 if i < 6 else 2, f"c{i}", "s", s) for i, s in enumerate(scores)], GRADES)
    per, graded, bad = pl.student_analytics(students, grades)
    assert {r.department: r.total_grades for r in per.collect()} == {"CS": 6, "Math": 4}
    assert {r.course: r.letter_grade for r in graded.collect()} == dict(
        zip([f"c{i}" for i in range(10)], ["A", "B", "C", "D", "F", None, None, None, None, None])
    )
    assert {r.reason: r.n_rows for r in bad.collect()} == {"not_a_number": 3, "empty": 1, "null": 1}
    ltv = jobs.lifetime_value(spark.createDataFrame([(10.0, 0.5), (1.0, 0.0)], "avg_monthly_revenue float, monthly_churn_rate float"))
    assert [r.lifetime_value_usd for r in ltv.collect()] == [20.0, None]


def test_alert_truncation(spark):
    df = spark.createDataFrame(
        [("p", "r" * 50, "e" * 130, "c" * 700, "f", "boom", T0)],
        "pipeline_name string, run_id string, error_type string, root_cause string, fix string, severity string, detected timestamp",
    )
    row = df.select(
        alerts.dedup_key(compat=True).alias("k"), alerts.dedup_key().alias("whole"), alerts.severity_color(F.col("severity")).alias("c"), alerts.slack_payload().alias("s")
    ).first()
    assert row.k == "p:" + "e" * 119 + "…" and row.whole == "p:" + "e" * 130 and row.c == "CC0000"
    assert "r" * 40 + "…" in row.s and "c" * 599 + "…" in row.s


def test_signatures_with_one_beginning_are_different_alerts(spark):
    rows = [(i, "w", "p", "r", "e" * 130 + str(i % 2), "c", "f", "ERROR", T0) for i in range(4)]
    df = spark.createDataFrame(
        rows, "seq long, workspace_id string, pipeline_name string, run_id string, error_type string, root_cause string, fix string, severity string, detected timestamp"
    )
    assert sorted(r.seq for r in alerts.dedup_alerts(df).collect()) == [0, 1]


def test_null_workspace_keeps_its_state(spark):
    events = spark.createDataFrame(
        [(None, "p", "r1", "ERROR", 1), ("w", "p", "r2", "INFO", 2)], "workspace_id string, job_id string, run_id string, level string, seq long"
    ).withColumns({"ts": F.lit(T0), "ingest_ts": F.lit(T0)})
    rows = state.pipeline_state(state.pipeline_runs(events), events).collect()
    assert {(r.workspace_id, r.status) for r in rows} == {(None, "Failed"), ("w", "Success")}


def test_error_table_keeps_whole_logs_and_embeddings(spark):
    long = "boom: " + "x" * 20_000
    queue = spark.createDataFrame(
        [("w", "p", "r1", long, 1, [1.0, 0.0]), ("w", "p", "r2", long, 2, None)],
        "workspace_id string, job_id string, run_id string, message string, seq long, embedding array<double>",
    ).withColumn("ts", F.lit(T0))
    row = pl.process_events(queue, embedding="embedding").first()
    assert row.raw_log == long and row.embedding == [1.0, 0.0] and row.run_id == "r2"
    assert len(pl.process_events(queue, raw_log_chars=10_000).first().raw_log) == 10_000


def test_lines_without_source_form_blocks(spark):
    from faultloom.operators import blocks

    rows = [(None, i, x) for i, x in enumerate(["java.lang.RuntimeException: x", "\tat a.B.c(B.java:1)", "done"])]
    found = blocks.assign_blocks(spark.createDataFrame(rows, "path string, n long, line string"), source=["path"], order="n", chunk=F.floor(F.col("n") / 2))
    assert sorted(r.n for r in found.collect()) == [0, 1]


def test_change_sets_are_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("w", "p", "e", 1, "x")], "workspace_id string, pipeline_name string, error_type string, seq long, fix string")
    assert tables.current_rows(spark, path, df.schema, state.upsert_errors).count() == 0
    for batch in (0, 1, 1):
        tables.append_changes(df.withColumn("seq", F.lit(batch).cast("long")), path, batch)
    assert tables.read_changes(spark, path, df.schema).count() == 2
    assert [r.seq for r in tables.current_rows(spark, path, df.schema, state.upsert_errors).collect()] == [1]
    tables.compact_changes(spark, path, str(tmp_path / "u"), df.schema, state.upsert_errors)
    assert tables.read_changes(spark, str(tmp_path / "u"), df.schema).count() == 1


def test_newest_set_per_key(spark):
    rows = [("w", "f", 0, 0), ("w", "f", 1, 0), ("w", "f", 0, 1), ("w", "g", 0, 0)]
    df = spark.createDataFrame(rows, "workspace_id string, source_file string, chunk_index int, batch_id long")
    assert tables.latest_sets(df, ["workspace_id", "source_file"]).count() == 2


def test_failed_calls_use_no_quota(spark):
    events = spark.createDataFrame([(i, "w", i % 3 == 0) for i in range(12)], "seq long, workspace_id string, paid boolean")
    users = spark.createDataFrame([("w", 0, 2)], "workspace_id string, ai_calls_used long, ai_calls_limit long")
    rows = quota.admit(events, users, chunk=chunk_of("seq", 5), billable=F.col("paid")).orderBy("seq").collect()
    # The second paid call is number 3; everything up to it is admitted.
    assert [r.admitted for r in rows] == [i <= 3 for i in range(12)]


def test_quota_goes_on_from_batch_to_batch(spark, tmp_path):
    from faultloom.streaming import streams

    users = spark.createDataFrame([("w", 0, 1)], "workspace_id string, ai_calls_used long, ai_calls_limit long")
    write = streams.error_changes(
        f"{tmp_path}/errors", users=users, usage_path=f"{tmp_path}/usage",
        ai=F.struct(F.lit("c").alias("root_cause"), F.lit("f").alias("suggested_fix"), F.lit(0.9).alias("confidence_score")),
    )
    batch = lambda i: spark.createDataFrame([("w", "p", f"r{i}", f"boom{i}", i)], "workspace_id string, job_id string, run_id string, message string, seq long").withColumn("ts", F.lit(T0))
    for i in (0, 1, 1, 0):  # with replays
        write(batch(i), i)
    used = spark.read.parquet(f"{tmp_path}/usage").groupBy().sum("ai_calls").first()[0]
    assert used == 1


def test_lists_come_in_order(spark):
    from faultloom.operators import reports

    rows = [(f"w{i % 3}", f"p{i % 7}", f"e{i}", at(i * 37 % 60) if i % 9 else None) for i in range(60)]
    errors = spark.createDataFrame(rows, "workspace_id string, pipeline_name string, error_type string, detected_at timestamp").repartition(5)
    newest = [r.detected_at for r in reports.sort_errors(errors).collect()]
    timed = [t for t in newest if t]
    assert timed == sorted(timed, reverse=True) and newest[: len(timed)] == timed
    names = [(r.pipeline_name, r.workspace_id, r.error_type) for r in reports.sort_errors(errors, "pipeline").collect()]
    assert names == sorted(names)
    assert [r.detected_at for r in reports.recent_errors(errors).collect()] == timed[:4]
    runs = errors.select(F.col("error_type").alias("run_id"), F.col("detected_at").alias("created_at"))
    assert [r.created_at for r in reports.sort_runs(runs).collect()] == newest
