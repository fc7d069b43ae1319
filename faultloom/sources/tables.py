"""Parquet tables: plain writes, rows with a schema, and state kept as an append-only change log.

A state table is a folder of change sets, one per batch id.  Writing a batch replaces its own
folder only, so a replay after a failure leaves one copy; readers reduce the change sets to the
current rows.  No file is ever rewritten in place, which any shared file system supports.
"""

import math
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH = "batch_id"


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


#: Rows of one task at most where text work is spread.
SPREAD_ROWS = 50_000


def pieces(rows: int, size: int = SPREAD_ROWS) -> int:
    """How many pieces of at most ``size`` rows hold ``rows`` rows."""
    return max(1, math.ceil(rows / size))


def spread(df: DataFrame, rows: int = SPREAD_ROWS) -> DataFrame:
    """Redistribute an input that comes in fewer pieces than there are cores, or in pieces of more than ``rows`` rows.

    Text work is bound by the processor, and a file of a few large row groups is a few tasks however
    many rows it holds.  Counting a Parquet table reads its footers only.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    wanted = cores * pieces(df.count(), cores * rows)
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def rows_to_frame(spark: SparkSession, rows: list[dict], schema: T.StructType, default: str = "") -> DataFrame:
    """Dictionaries to a DataFrame; keys that are absent take ``default``."""
    return spark.createDataFrame([tuple(r.get(f.name, default) for f in schema.fields) for r in rows], schema)


def read_json_rows(spark: SparkSession, path: str, schema: T.StructType, default: str = "") -> DataFrame:
    """JSON lines with an explicit schema; absent text fields take ``default``."""
    names = [f.name for f in schema.fields if isinstance(f.dataType, T.StringType)]
    return spark.read.schema(schema).json(path).fillna(default, subset=names)


def append_changes(df: DataFrame, path: str, batch_id: int) -> None:
    """Write one batch's changes; running the same batch again replaces them."""
    df.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id:012d}")


def read_changes(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All change sets with their batch id (an empty frame before the first batch)."""
    full = T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())])
    try:
        return spark.read.schema(full).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], full)


def current_rows(
    spark: SparkSession, path: str, schema: T.StructType, reduce: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """The state: ``reduce`` applied to every change (it must not depend on row order)."""
    return reduce(read_changes(spark, path, schema).drop(BATCH))


def compact_changes(
    spark: SparkSession, path: str, target: str, schema: T.StructType, reduce: Callable[[DataFrame], DataFrame]
) -> None:
    """Write the reduced state to a new folder as its batch 0."""
    append_changes(current_rows(spark, path, schema, reduce), target, 0)


def latest_sets(changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Replace-by-key on read: of each key only the rows of its newest batch."""
    newest = changes.groupBy(*keys).agg(F.max(BATCH).alias("_newest"))
    return changes.join(newest, list(keys)).filter(F.col(BATCH) == F.col("_newest")).drop("_newest", BATCH)
