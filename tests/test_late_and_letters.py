"""Late rows are counted apart and merged; dead letters are tried again; totals are folded batch by batch."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from faultloom.operators import retrieval
from faultloom.streaming import dead_letters, late, streams
from faultloom.sources import tables

T0 = dt.datetime(2026, 1, 1)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def fold(df):
    return df.groupBy("k").agg(F.count(F.lit(1)).alias("n"))


def test_late_rows_are_split_the_same_on_replay(spark, tmp_path):
    def batch(*minutes):
        return spark.createDataFrame([(m % 2, None if m is None else T0 + dt.timedelta(minutes=m)) for m in minutes], "k int, ts timestamp")

    root = str(tmp_path)
    write = late.split_late(root, "ts", "10 MINUTES", fold, ["k", "ts"])
    batches = [batch(0, 30), batch(19, 20, 21, 90), batch(5, 79, 80, 81), spark.createDataFrame([(1, None)], "k int, ts timestamp")]
    for i in [0, 1, 1, 2, 0, 1, 3]:  # some run again
        write(batches[i], i)
    folded, side = spark.read.parquet(f"{root}/folded"), spark.read.parquet(f"{root}/late")
    assert sorted(int((r["ts"] - T0).total_seconds() // 60) for r in side.collect()) == [5, 19, 79]
    assert {int((r["watermark"] - T0).total_seconds() // 60) for r in side.collect()} == {20, 80}
    assert rows(late.merged(folded, side, fold, ["k"], "n")) == [(0, 5, 0, 5), (1, 3, 3, 6)]


def test_letters_wait_for_their_attempts(spark, tmp_path):
    good = '{"source":"s","job_id":"j","run_id":"r","level":"ERROR","timestamp":"no time","message":"m"}'
    root = str(tmp_path)
    raw = [(1, good, T0), (2, "{broken", T0), (3, '{"source":"s"}', T0), (4, None, None), (5, "{broken", T0 + dt.timedelta(1)), (6, good, None)]
    batch = spark.createDataFrame(raw, "n int, value string, at timestamp")
    write = dead_letters.json_letters(root)
    write(batch, 0)
    write(batch, 0)
    events = spark.read.parquet(f"{root}/events")
    assert rows(events.select("n", "ts")) == [(1, T0), (6, None)]  # the record's time, not the time of the run
    assert {(r["n"], r["attempts"], r["status"]) for r in dead_letters.letters(spark, root).collect()} == {(n, 1, "waiting") for n in (2, 3, 4, 5)}
    mend = lambda df: df.withColumn("value", F.when(F.col("n") == 5, F.lit(good)).otherwise(F.col("value")))
    for turn in (0, 0, 1, 1, 0):
        dead_letters.retry(spark, root, turn, mend)
    state = {(r["n"], r["attempts"], r["status"], r["reason"]) for r in dead_letters.letters(spark, root).collect()}
    missing = "missing:job_id,run_id,level,timestamp,message"
    assert {(n, a, s) for n, a, s, _ in state} == {(2, 3, "dead"), (3, 3, "dead"), (4, 3, "dead"), (5, 2, "done")}
    assert {r for n, _, _, r in state if n in (2, 4)} == {"malformed_json"} and [r for n, _, _, r in state if n == 3][0].startswith(missing[:14])
    assert rows(spark.read.parquet(f"{root}/events").select("n")) == [(1,), (5,), (6,)]
    dead_letters.retry(spark, root, 2, mend)
    assert {r["attempts"] for r in dead_letters.letters(spark, root).collect()} == {2, 3}


def test_usage_totals_read_one_change_set(spark, tmp_path):
    path = str(tmp_path / "usage")
    billed = [[("a", 2), ("b", 1)], [("a", 3)], [], [("c", 4), ("a", 1)]]
    for i, b in enumerate(billed):
        for _ in range(2):  # a replay replaces its own sets
            before = streams.usage_before(spark, path, i)
            streams.fold_usage(before, spark.createDataFrame(b, "workspace_id string, ai_calls long"), path, i)
    total = streams.usage_before(spark, path, 4)
    assert rows(total) == [("a", 6), ("b", 1), ("c", 4)]
    assert all("_totals/batch_id=000000000003" in f for f in total.inputFiles())
    assert rows(tables.read_changes(spark, path, streams.USAGE).groupBy("workspace_id").agg(F.sum("ai_calls"))) == rows(total)


def test_hook_loads_once_per_task_and_isolates_bad_texts(spark, tmp_path):
    marks = str(tmp_path)

    def load():
        import os
        import uuid

        open(os.path.join(marks, uuid.uuid4().hex), "w").close()

        def run(texts):
            if any("bad" in t for t in texts):
                raise RuntimeError("no")
            return [[float(len(t)), 1.0] for t in texts]

        return run

    texts = [f"text {i}" + (" bad" if i % 17 == 3 else "") for i in range(200)] + [None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        got = {r["i"]: r for r in retrieval.embed_with(df, "t", load=load, failure="why").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    bad = {i for i, t in enumerate(texts) if t and "bad" in t}
    assert {i for i, r in got.items() if r["embedding"] is None} == bad and {got[i]["why"] for i in bad} == {"RuntimeError: no"}
    assert got[0]["embedding"] == pytest.approx([6 / 37**0.5, 1 / 37**0.5], abs=1e-6) and got[200]["embedding"] == [0.0, 1.0]
    import os

    assert len(os.listdir(marks)) == 1

    def broken():
        raise OSError("no file")

    assert {r["why"] for r in retrieval.embed_with(df, "t", load=broken, failure="why").collect()} == {"OSError: no file"}
    with pytest.raises(ValueError):
        retrieval.embed_with(df, "t")
