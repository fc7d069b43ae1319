"""Assembly of multi-line error blocks.

An anchor line opens a block, continuation lines extend an open one, any other line closes it.
There are two forms: inside one text value (no shuffle), and over rows that hold one line each.
"""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import text as tx

ANCHOR, CONTINUATION, OTHER = "A", "C", "O"


def line_class(line: Column) -> Column:
    """A (anchor), C (continuation) or O (other); a continuation is never an anchor."""
    indented = (tx.lstrip(line) != line) & F.rlike(line, F.lit(fv.BLOCK_CONTINUATION_INDENTED))
    starts = [F.startswith(line, F.lit(x)) for x in fv.BLOCK_CONTINUATION_STARTS]
    return (
        F.when(indented | starts[0] | starts[1], F.lit(CONTINUATION))
        .when(tx.contains_any(tx.fold_case(line), fv.BLOCK_ANCHORS), F.lit(ANCHOR))
        .otherwise(F.lit(OTHER))
    )


def text_blocks(text: Column) -> Column:
    """Blocks of a multi-line text as ``array<array<string>>`` (one inner array of lines per block).

    Linear in the text: the positions of the non-continuation lines bound the blocks, so each
    block is one slice.
    """

    def solid(lines: Column) -> Column:
        marked = F.transform(
            lines, lambda line, i: F.struct(i.alias("pos"), line_class(line).alias("cls"))
        )
        return F.filter(marked, lambda m: m["cls"] != CONTINUATION)

    def cut(lines: Column, marks: Column) -> Column:
        bounded = F.transform(
            marks,
            lambda m, i: F.struct(
                m["pos"].alias("start"),
                F.coalesce(F.get(marks, i + 1)["pos"], F.size(lines)).alias("end"),
                m["cls"].alias("cls"),
            ),
        )
        anchored = F.filter(bounded, lambda b: b["cls"] == ANCHOR)
        return F.transform(anchored, lambda b: F.slice(lines, b["start"] + 1, b["end"] - b["start"]))

    general = tx.let(
        tx.split_lines(F.coalesce(text, F.lit(""))), lambda lines: tx.let(solid(lines), lambda marks: cut(lines, marks))
    )
    # Most messages are one line, which is a block or is not.
    one_line = ~F.rlike(text, F.lit(fv.ANY_LINE_BREAK))
    none = F.array().cast("array<array<string>>")
    single = F.when(line_class(text) == ANCHOR, F.array(F.array(text))).otherwise(none)
    return F.when(one_line, single).otherwise(general)


def assign_blocks(
    lines: DataFrame,
    *,
    source: Sequence[str],
    order: str,
    chunk: str | Column,
    line: str = "line",
) -> DataFrame:
    """Label the lines that belong to a block with ``block_id`` (1, 2, … per source); drop the rest.

    ``chunk`` cuts a source into pieces of bounded size in line order (a file split, or a range of
    line numbers).  Each piece is one window partition, so a source that holds most of the data is
    spread over many tasks.  A small per-piece summary (anchors seen, last class) is carried
    forward over the pieces of a source, which makes the result equal to one pass over the source.
    """
    source = list(source)
    chunk = F.col(chunk) if isinstance(chunk, str) else chunk
    piece = [*source, "_chunk"]
    classed = lines.withColumn("_chunk", chunk).withColumn("_cls", line_class(F.col(line)))
    solid = F.when(F.col("_cls") != CONTINUATION, F.col("_cls"))

    within = Window.partitionBy(*piece).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = classed.withColumn(
        "_anchors", F.sum((F.col("_cls") == ANCHOR).cast("long")).over(within)
    ).withColumn("_state", F.last(solid, ignorenulls=True).over(within))

    before = Window.partitionBy(*source).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        classed.select(*piece, "_cls", order)
        .groupBy(*piece)
        .agg(
            F.sum((F.col("_cls") == ANCHOR).cast("long")).alias("_n"),
            F.max_by(solid, F.when(solid.isNotNull(), F.col(order))).alias("_last"),
        )
        .withColumn("_prior_anchors", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .withColumn("_prior_state", F.last("_last", ignorenulls=True).over(before))
        .select(*piece, "_prior_anchors", "_prior_state")
    )
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in piece]
    joined = (
        local.alias("l")
        .join(carried.alias("r"), reduce(lambda a, b: a & b, same))
        .select("l.*", "r._prior_anchors", "r._prior_state")
    )
    open_state = F.coalesce("_state", "_prior_state")
    return (
        joined.filter((F.col("_cls") != OTHER) & (open_state == ANCHOR))
        .withColumn("block_id", F.col("_prior_anchors") + F.col("_anchors"))
        .drop("_chunk", "_cls", "_anchors", "_state", "_prior_anchors", "_prior_state")
    )


def collect_blocks(
    block_lines: DataFrame, *, source: Sequence[str], order: str, line: str = "line"
) -> DataFrame:
    """One row per block with its lines in order; a group is one stack trace, not one source."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(line).alias("l"))))
    return (
        block_lines.groupBy(*source, "block_id")
        .agg(ordered.alias("_sorted"))
        .withColumn("block", F.transform("_sorted", lambda x: x["l"]))
        .withColumn("first_line", F.get("_sorted", F.lit(0))["o"])
        .drop("_sorted")
    )
