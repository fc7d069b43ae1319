"""Connected components by alternating large and small stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _mark(edges: DataFrame) -> tuple:
    """A fingerprint of a set of edges."""
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo")), F.bit_xor(F.xxhash64("lo", "hi"))).first()
    return tuple(row)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label): for every node of ``edges(a, b)`` the least node it is connected to.

    Each round hangs all larger neighbours of a node on the least one, then all smaller ones; the
    rounds grow with the logarithm of the longest path.  Every round is written to the shared folder.
    Groups are joined, never collected, so a node with any number of neighbours is no single task.
    """
    edges = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).filter("hi <> lo").distinct()
    edges = written(edges, "edges")
    before = _mark(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.min("lo").alias("m")).select("hi", F.least("hi", "m").alias("m"))
        large = (
            both.filter("lo > hi")
            .join(least, "hi")
            .select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .filter("hi <> lo")
            .distinct()
        )
        large = written(large, "stars")
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(least, "hi")
            .filter("lo <> m")
            .select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .unionByName(least.select("hi", F.col("m").alias("lo")))
            .distinct()
        )
        edges = written(small, "edges")
        after = _mark(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("label")).unionByName(
        edges.select(F.col("lo").alias("node"), F.col("lo").alias("label")).distinct()
    )
