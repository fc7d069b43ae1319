"""Tasks follow the rows and the bytes, and work that several results share is done once."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from faultloom.operators import hypotheses
from faultloom.plans import pipelines as pl
from faultloom.plans import queries_streams
from faultloom.sources import tables, tail
from faultloom.streaming import block_stream, dead_letters, streams


def test_spread_bounds_the_rows_of_a_task(spark):
    df = spark.range(20_000, numPartitions=8)
    out = tables.spread(df, rows=500)
    assert out.rdd.getNumPartitions() == 40 and max(len(p) for p in out.rdd.glom().collect()) < 1000
    assert sorted(r.id for r in out.collect()) == list(range(20_000))


def test_a_batch_of_a_replay_has_as_many_files_as_it_needs(spark, tmp_path, monkeypatch):
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(minutes=i), i % 9, "error" if i % 3 else "view", 1.5 * i, "{}") for i in range(600)]
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(tables, "SPREAD_ROWS", 50)
    seen = []
    root = queries_streams._replay(spark, str(tmp_path), "sizes", lambda s: s, lambda root: lambda batch, i: seen.append(batch.count()))
    files = [f for f in os.listdir(f"{root}/source") if f.endswith(".parquet")]
    assert len(files) == 12 and len(seen) == queries_streams.FILES and sum(seen) == 600


def test_rules_are_broadcast(spark):
    events = spark.range(50).select(F.when(F.col("id") % 2 == 0, "MISSING_KEY:KeyError").otherwise(F.concat(F.lit("X"), "id")).alias("signature"), F.lit(None).cast("struct<root_cause string, suggested_fix string, confidence_score double>").alias("ai"))
    joined = hypotheses.with_hypotheses(events, rules=hypotheses.rule_table(spark))
    joined.collect()
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_small_pieces_share_a_task():
    found = [tail.Piece(f"f{i}", 0, 0, 100, 100, 0) for i in range(1000)]
    packs = tail.packed(found)
    assert len(packs) <= 2 * tail.FEW_TASKS and [p for pack in packs for p in pack.pieces] == found
    assert tail.packed([]) == []


def test_keys_of_whole_blocks_do_not_grow_with_the_files():
    keys = set()
    for i in range(1000):
        out: list = []
        cutter = block_stream.Cutter(f"file-{i}.log", 0, datetime.datetime(2024, 1, 1), 10, out)
        for at, cls in enumerate("OAAAO"):
            cutter.add(at, cls, "x")
        cutter.close()
        keys |= {row[:2] for row in out if row[4] == block_stream.WHOLE}
    assert 1 < len(keys) <= block_stream.LANES


def test_a_batch_with_a_quota_is_parsed_once(spark, tmp_path, monkeypatch):
    queue = spark.createDataFrame([(1, "1", "j", "r", "KeyError: 'a'", None)], "seq long, workspace_id string, job_id string, run_id string, message string, ts timestamp")
    users = spark.createDataFrame([("1", 0, 5)], "workspace_id string, ai_calls_used long, ai_calls_limit long")
    seen, decide = [], pl.decide
    monkeypatch.setattr(pl, "decide", lambda parsed, **o: seen.append(parsed.is_cached) or decide(parsed, **o))
    streams.error_changes(f"{tmp_path}/errors", users=users, usage_path=f"{tmp_path}/usage")(queue, 0)
    assert seen == [True] and spark.read.parquet(f"{tmp_path}/errors").count() == 1


@pytest.mark.parametrize("turn", [0])
def test_a_retry_reads_its_letters_once(spark, tmp_path, monkeypatch, turn):
    root, seen, attempt = str(tmp_path), [], dead_letters._attempt
    batch = spark.createDataFrame([("not json", datetime.datetime(2024, 1, 1))], "value string, at timestamp")
    dead_letters.json_letters(root)(batch, 0)
    monkeypatch.setattr(dead_letters, "_attempt", lambda tried, *a: seen.append(tried.is_cached) or attempt(tried, *a))
    dead_letters.retry(spark, root, turn, lambda rows: rows)
    assert seen == [True] and [r.attempts for r in dead_letters.letters(spark, root).collect()] == [2]
