"""State by tenant: change sets in a folder per workspace, folded into a snapshot every few batches.

A reader takes the last snapshot and the change sets after it, so what it lists and reads does not
grow with the number of batches; a filter or join on the workspace prunes the folders of all other
tenants.  Batches of one snapshot share an epoch folder.  A snapshot counts once its mark is written, so a
failure in between leaves the former one in force, and a replayed batch replaces its own folders.
"""

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import BATCH, append_changes, read_changes, write_parquet

TENANT = "workspace_id"
#: Batches of one epoch.
EPOCH_BATCHES = 8

_MARK = T.StructType([T.StructField("epoch", T.LongType())])
Reduce = Callable[[DataFrame], DataFrame]


def _epoch_folder(root: str, epoch: int) -> str:
    return f"{root}/changes/epoch={epoch:012d}"


def _snapshot_folder(root: str, epoch: int) -> str:
    return f"{root}/snapshots/epoch={epoch:012d}"


def append(df: DataFrame, root: str, batch_id: int, *, every: int = EPOCH_BATCHES) -> None:
    """One batch's changes, a folder per tenant; small tenants share tasks, large ones are split."""
    folder = f"{_epoch_folder(root, batch_id // every)}/{BATCH}={batch_id:012d}"
    write_parquet(df.hint("rebalance", TENANT), folder, [TENANT])


def last_snapshot(spark: SparkSession, root: str) -> int:
    """The epoch of the last whole snapshot, -1 before the first."""
    row = read_changes(spark, f"{root}/marks", _MARK).agg(F.max("epoch")).first()
    return -1 if row[0] is None else row[0]


def _exists(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def changes_since(spark: SparkSession, root: str, schema: T.StructType, epoch: int, until: int | None = None) -> DataFrame:
    """Rows of the snapshot of ``epoch`` and of all change sets after it (up to the epoch ``until``)."""
    found = _exists(spark, _snapshot_folder(root, epoch), schema) if epoch >= 0 else None
    rows = spark.createDataFrame([], schema) if found is None else found.select(schema.names)
    full = T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())])
    at = epoch + 1
    while until is None or at <= until:
        part = _exists(spark, _epoch_folder(root, at), full)
        if part is None:
            break
        rows = rows.unionByName(part.select(schema.names))
        at += 1
    return rows


def read(spark: SparkSession, root: str, schema: T.StructType, reduce: Reduce) -> DataFrame:
    """The current rows; filter or join the result by workspace to read those tenants only."""
    return reduce(changes_since(spark, root, schema, last_snapshot(spark, root)))


def fold(spark: SparkSession, root: str, schema: T.StructType, reduce: Reduce, epoch: int) -> None:
    """Write the snapshot of ``epoch`` from the last one before it and the changes since."""
    marks = read_changes(spark, f"{root}/marks", _MARK).filter(F.col("epoch") < epoch).agg(F.max("epoch")).first()[0]
    rows = reduce(changes_since(spark, root, schema, -1 if marks is None else marks, epoch))
    write_parquet(rows.hint("rebalance", TENANT), _snapshot_folder(root, epoch), [TENANT])
    append_changes(spark.createDataFrame([(epoch,)], _MARK).coalesce(1), f"{root}/marks", epoch)


def changes_by_tenant(
    root: str, build: Callable[[DataFrame], DataFrame], reduce: Reduce, *, every: int = EPOCH_BATCHES
) -> Callable[[DataFrame, int], None]:
    """Batch writer: ``build`` of each batch by tenant, and a snapshot at the end of each epoch.

    ``reduce`` must not depend on row order, and reducing its own result with later rows must give what all rows give.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = build(batch)
        append(rows, root, batch_id, every=every)
        if (batch_id + 1) % every == 0:
            fold(batch.sparkSession, root, rows.schema, reduce, batch_id // every)

    return write
