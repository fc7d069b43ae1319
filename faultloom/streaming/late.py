"""Late rows: a short watermark, a side table of what came after it, and the merge of both.

The watermark of a batch is the latest event time of the batches before it, less the allowed
lateness.  It comes from a table of one row per batch, so a replayed batch has the watermark it had
before and splits its rows in the same way.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import BATCH, append_changes, read_changes

MARK = T.StructType([T.StructField("latest", T.TimestampType())])


def watermark(spark: SparkSession, root: str, batch_id: int, lateness: str) -> Column:
    """The batch's watermark as a literal; null before the first event time."""
    marks = read_changes(spark, f"{root}/marks", MARK).filter(F.col(BATCH) < batch_id)
    row = marks.agg((F.max("latest") - F.expr(f"INTERVAL {lateness}")).alias("w")).select(F.unix_micros("w")).first()
    return F.timestamp_micros(F.lit(row[0]).cast("long"))


def split_late(
    root: str, ts: str, lateness: str, fold: Callable[[DataFrame], DataFrame], keep: list[str]
) -> Callable[[DataFrame, int], None]:
    """Batch writer: ``fold`` of the rows in time to ``root/folded``, the late ones whole to ``root/late``.

    The side table has the columns ``keep``, and ``watermark``, what the row was measured against.  Rows without a time are in time.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()
        try:
            mark = watermark(batch.sparkSession, root, batch_id, lateness)
            late = F.coalesce(F.col(ts) < mark, F.lit(False))
            append_changes(fold(held.filter(~late)), f"{root}/folded", batch_id)
            append_changes(held.filter(late).select(*keep).withColumn("watermark", mark), f"{root}/late", batch_id)
            append_changes(held.agg(F.max(F.col(ts).cast("timestamp")).alias("latest")), f"{root}/marks", batch_id)
        finally:
            held.unpersist()

    return write


def merged(
    folded: DataFrame, late: DataFrame, fold: Callable[[DataFrame], DataFrame], keys: list[str], value: str
) -> DataFrame:
    """Per key the value in time, the value of the late rows, and their sum (for counts and sums)."""
    late_part = fold(late).select(*keys, F.col(value).alias("late"), F.lit(0).cast("long").alias("in_time"))
    parts = folded.select(*keys, F.lit(0).cast("long").alias("late"), F.col(value).alias("in_time")).unionByName(late_part)
    sums = parts.groupBy(*keys).agg(F.sum("in_time").alias("in_time"), F.sum("late").alias("late"))
    return sums.withColumn(value, F.col("in_time") + F.col("late"))
