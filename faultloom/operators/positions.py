"""Positions in an ordered key group without putting the whole group into one task."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEQ_CHUNK = 100_000


def chunk_of(seq: str | Column, width: int = SEQ_CHUNK) -> Column:
    """Range piece of an integer sequence; unique values give at most ``width`` rows per piece."""
    seq = F.col(seq) if isinstance(seq, str) else seq
    return F.floor(seq / F.lit(width))


def with_sum_before(
    df: DataFrame, keys: Sequence[str], order: str, value: Column, *, chunk: Column | None = None, out: str = "before"
) -> DataFrame:
    """Sum of ``value`` over the rows before each row in its key group, cut into pieces like :func:`with_position`."""
    keys = list(keys)
    pieces = df.withColumn("_chunk", chunk_of(order) if chunk is None else chunk).withColumn("_value", value)
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        pieces.groupBy(*keys, "_chunk")
        .agg(F.sum("_value").alias("_n"))
        .withColumn("_carried", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    within = Window.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = pieces.withColumn("_local", F.coalesce(F.sum("_value").over(within), F.lit(0)))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, "_chunk"]]
    return (
        local.alias("l")
        .join(carried.alias("r"), reduce(lambda a, b: a & b, same))
        .select("l.*", (F.col("r._carried") + F.col("l._local")).alias(out))
        .drop("_chunk", "_local", "_value")
    )


def with_position(
    df: DataFrame, keys: Sequence[str], order: str, *, chunk: Column | None = None, out: str = "position"
) -> DataFrame:
    """1-based position of each row in its key group by ``order`` (a unique integer by default).

    Rows are numbered inside (key, piece); the pieces' counts are summed per key and added.  A key
    that holds a third of all rows is spread over as many tasks as it has pieces.
    """
    keys = list(keys)
    pieces = df.withColumn("_chunk", chunk_of(order) if chunk is None else chunk)
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        pieces.groupBy(*keys, "_chunk")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    local = pieces.withColumn(
        "_local", F.row_number().over(Window.partitionBy(*keys, "_chunk").orderBy(order))
    )
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, "_chunk"]]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    return (
        local.alias("l")
        .join(offsets.alias("r"), condition)
        .select("l.*", (F.col("r._before") + F.col("l._local")).alias(out))
        .drop("_chunk", "_local")
    )
