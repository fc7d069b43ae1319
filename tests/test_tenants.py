"""State by tenant: the same rows as all changes together, from few folders."""

import pytest
from pyspark.sql import functions as F

from faultloom.sources import tenants

SCHEMA = "workspace_id string, k int, seq long, v string"


def last(df):
    return df.groupBy("workspace_id", "k").agg(F.max_by(F.struct("seq", "v"), "seq").alias("r")).select("workspace_id", "k", "r.*")


def batch(spark, i):
    rows = [(None if w == 3 else str(w), k, i * 100 + w * 10 + k, f"{i}") for w in range(4) for k in range(3) if (i + w + k) % 2]
    return spark.createDataFrame(rows, SCHEMA)


def rows(df):
    return sorted((tuple(r) for r in df.select("workspace_id", "k", "seq", "v").collect()), key=repr)


def scanned(df):
    """Files that rows come from."""
    return {r[0] for r in df.select(F.input_file_name()).distinct().collect()}


def test_snapshots_and_changes_give_all_rows(spark, tmp_path):
    root = str(tmp_path)
    write = tenants.changes_by_tenant(root, lambda b: b, last, every=3)
    want, read = None, []
    for i in range(11):
        for _ in range(2 if i in (2, 5, 7) else 1):  # a batch that runs again replaces itself
            write(batch(spark, i), i)
        want = batch(spark, i) if want is None else want.unionByName(batch(spark, i))
        assert rows(tenants.read(spark, root, want.schema, last)) == rows(last(want))
        read.append(len(scanned(tenants.changes_since(spark, root, want.schema, tenants.last_snapshot(spark, root)))))
    assert tenants.last_snapshot(spark, root) == 2
    assert max(read[6:]) <= max(read[:6]) + 4  # as many batches again, no more files


def test_a_snapshot_without_its_mark_does_not_count(spark, tmp_path):
    root = str(tmp_path)
    for i in range(4):
        tenants.append(batch(spark, i), root, i, every=2)
    df = batch(spark, 0)
    tenants.fold(spark, root, df.schema, last, 0)
    tenants.write_parquet(df.limit(0), f"{root}/snapshots/epoch={1:012d}")  # cut off before its mark
    whole = batch(spark, 0).unionByName(batch(spark, 1)).unionByName(batch(spark, 2)).unionByName(batch(spark, 3))
    assert rows(tenants.read(spark, root, df.schema, last)) == rows(last(whole))


@pytest.mark.parametrize("form", ["filter", "join"])
def test_one_tenant_reads_its_folders_only(spark, tmp_path, form):
    root = str(tmp_path)
    for i in range(4):
        tenants.append(batch(spark, i), root, i, every=3)
    df = batch(spark, 0)
    tenants.fold(spark, root, df.schema, last, 0)
    stored = tenants.read(spark, root, df.schema, last)
    if form == "filter":
        chosen = stored.filter(F.col("workspace_id") == "1")
        assert "PartitionFilters: [isnotnull(workspace_id" in chosen._jdf.queryExecution().executedPlan().toString()
    else:
        one = spark.range(5).filter("id = 1").select(F.col("id").cast("string").alias("workspace_id"))
        chosen = stored.join(F.broadcast(one), "workspace_id", "left_semi")
    assert rows(chosen) == [r for r in rows(stored) if r[0] == "1"]
    raw = tenants.changes_since(spark, root, df.schema, 0).filter(F.col("workspace_id") == "1")
    assert all("workspace_id=1/" in f for f in scanned(raw))
    assert rows(stored.filter(F.col("workspace_id").isNull())) == [r for r in rows(stored) if r[0] is None]


def test_no_batches_yet(spark, tmp_path):
    assert tenants.read(spark, str(tmp_path), batch(spark, 0).schema, last).count() == 0
