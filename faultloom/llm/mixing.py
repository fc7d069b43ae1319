"""Mixing sources to target weights by balanced sampling (the cube method).

A source's target over its size is how often each of its documents is wanted.  The whole part is
taken for every document; the fraction is an inclusion probability.  The cube method moves the
probabilities of three documents at a time along the null space of the two balancing constraints
(words and documents), until one of them reaches 0 or 1, so both totals stay what they were.  A
block of any length leaves at most two documents undecided; the undecided ones of all blocks of a
source are balanced again in ever fewer blocks.  The last block keeps a handful of documents back:
with the last two undecided ones they are the landing problem, solved by trying every choice.
"""

import sys
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import rows_of, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows of one balancing block; it sets how many tasks share a source, not what is kept.
BLOCK_ROWS = 4096
#: Documents of a source's last block that are left to the landing problem, besides two undecided ones.
LANDING = 12
#: No document is taken more often than this.
MOST_COPIES = 3

_EPS = 1e-9
#: Sources up to which the plan is sent to every task.
PLAN_ROWS = 100_000


def word_count(column: str = "text") -> Column:
    """Runs of characters other than space and the control characters tab to carriage return; null has none."""
    return F.coalesce(F.regexp_count(F.col(column), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def shares(sizes: dict, total: float | None = None, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = MOST_COPIES) -> dict:
    """Target of each source: the total dealt by weight, none above ``most`` times its size.

    ``sizes`` maps a source (or None) to its size.  Sources in code point order, None last, weigh 1, 2,
    3, repeating.  What a full source cannot take is dealt again among the others by weight.
    """
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    left = float(sum(sizes.values()) if total is None else total)
    targets = {s: 0.0 for s in order}
    open_ = [s for s in order if sizes[s] > 0]
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if unit * weight[s] > most * sizes[s]]
        if not full:
            targets |= {s: unit * weight[s] for s in open_}
            break
        for s in full:
            targets[s] = float(most * sizes[s])
            left -= targets[s]
        open_ = [s for s in open_ if s not in full]
    return targets


def flight(state: list, size: float, ident, p: float, toss: float) -> tuple[list, list]:
    """One step of the cube method: add a unit to at most two undecided ones and decide as many as possible.

    ``state`` holds (probability, size, ident).  Returns the undecided units (at most two) and the
    decided ones as (ident, taken).  Three units have a one-dimensional null space for the rows (size)
    and (1); the probabilities move along it in one of two directions, chosen by ``toss`` so that
    every unit's expected value stays its probability.
    """
    state = [*state, (p, size, ident)]
    decided = []
    while True:
        still = []
        for unit in state:
            if unit[0] <= _EPS or unit[0] >= 1 - _EPS:
                decided.append((unit[2], unit[0] > 0.5))
            else:
                still.append(unit)
        state = still
        if len(state) < 3:
            return state, decided
        (p0, a, _), (p1, b, _), (p2, c, _) = state
        u = (b - c, c - a, a - b)
        if u == (0, 0, 0):
            u = (1.0, -1.0, 0.0)
        up = down = float("inf")
        for q, x in zip((p0, p1, p2), u):
            if x > 0:
                up, down = min(up, (1 - q) / x), min(down, q / x)
            elif x < 0:
                up, down = min(up, q / -x), min(down, (1 - q) / -x)
        step = up if toss * (up + down) < down else -down
        state = [(q + step * x, s, i) for (q, s, i), x in zip(state, u)]


def land(state: list) -> list:
    """Decide the last units: of all 0/1 choices the one whose words and documents are nearest to what is expected."""
    if not state:
        return []
    probs, sizes = np.array([(u[0], u[1]) for u in state], float).T
    choices = (np.arange(1 << len(state))[:, None] >> np.arange(len(state))) & 1
    off_words = np.abs(choices @ sizes - probs @ sizes) / max(sizes.mean(), 1.0)
    off_rows = np.abs(choices.sum(axis=1) - probs.sum())
    best = choices[int(np.argmin(np.round(off_words + 0.1 * off_rows, 9)))]
    return [(u[2], bool(x)) for x, u in zip(best, state)]


def _balance(last: bool):
    """Run the flight over rows sorted by (grp, block, ordinal); constant memory however long a block is."""
    names = ("grp", "ordinal", "tie", "size")

    def toss(ordinal: int) -> float:
        return (((ordinal * 0x9E3779B97F4A7C15) + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF) / 2**64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        state: list = []
        back: deque = deque()
        current = None
        out: list = []

        def leave() -> None:
            if last:
                units = [*state, *((p, float(ident[-1]), ident) for ident, p in back)]
                out.extend((*ident, 1.0 if taken else 0.0, True) for ident, taken in land(units))
            else:
                out.extend((*ident, p, False) for p, _, ident in state)
            state.clear()
            back.clear()

        for batch in batches:
            cols = batch.to_pydict()
            for grp, block, ordinal, tie, size, p in zip(*(cols[n] for n in ("grp", "block", "ordinal", "tie", "size", "p"))):
                if (grp, block) != current:
                    leave()
                    current = (grp, block)
                back.append(((grp, ordinal, tie, size), p))
                if last and len(back) <= LANDING:
                    continue
                ident, p = back.popleft()
                state[:], decided = flight(state, float(ident[-1]), ident, p, toss(ident[1]))
                out.extend((*i, 1.0 if taken else 0.0, True) for i, taken in decided)
            yield _columns(out, names)
            out.clear()
        leave()
        yield _columns(out, names)

    return run


def _columns(out: list, names: tuple) -> dict:
    columns = list(zip(*out)) or [[] for _ in range(len(names) + 2)]
    return dict(zip((*names, "p", "done"), columns))


_UNITS = "grp int, ordinal long, tie long, size long, p double, done boolean"


def balanced(units: DataFrame, rows: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """0/1 choices for ``units(grp, ordinal, tie, size, p)`` that keep each group's expected words and documents.

    ``ordinal`` and ``tie`` are hashes that together are unique in a group; the first spreads rows
    evenly over blocks.  ``rows`` is the largest group's row count; it sets the number of levels.
    """
    done = None
    while True:
        blocks = max(1, -(-rows // block_rows))
        dealt = units.withColumn("block", F.pmod(F.shiftright("ordinal", 7), F.lit(blocks)))
        moved = written(
            rows_of(
                dealt.select("grp", "block", "ordinal", "tie", "size", "p")
                .repartition("grp", "block")
                .sortWithinPartitions("grp", "block", "ordinal", "tie", "size"),
                _UNITS,
                _balance(blocks == 1),
            ),
            "cube",
        )
        decided = moved.filter("done").select("grp", "ordinal", "tie", "p")
        done = decided if done is None else done.unionByName(decided)
        if blocks == 1:
            return done
        units = moved.filter(~F.col("done")).drop("done")
        rows = 2 * blocks


def _marks(seed: int = 11) -> list[Column]:
    """Two hashes of a row's id and text: they order the draw and tell rows apart."""
    return [F.xxhash64(F.lit(seed), "doc_id", "text").alias("_hash"), F.xxhash64(F.lit(seed + 1), "text", "doc_id").alias("_tie")]


def mix(df: DataFrame, *, weights: tuple[float, ...] = (1.0, 2.0, 3.0), share: float = 1.0, most: int = MOST_COPIES, seed: int = 11) -> DataFrame:
    """How often each row of ``df(doc_id, source, text)`` is taken so that sources meet their targets.

    Result: doc_id, source, size, source_size, target, copies, taken (copies x size), and two hashes of
    id and text.  Null texts have size 0; a null source is a source of its own, last in order.  Rows without
    words weigh nothing: they are taken as often as chance and the documents' balance give.  Repeated
    rows are units of their own: each is decided separately, equal rows in no set order.  An empty
    table gives an empty result.  The draw depends on ids and texts alone, so reruns agree under any
    partitioning.
    """
    sized = written(
        df.select(
            F.col("doc_id"),
            F.col("source"),
            word_count().alias("size"),
            *_marks(seed),
        ),
        "mix",
    )
    totals = sized.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows")).collect()
    sizes = {r["source"]: int(r["words"]) for r in totals}
    rows = {r["source"]: int(r["rows"]) for r in totals}
    targets = shares(sizes, share * sum(sizes.values()), weights, most)
    spark = df.sparkSession
    plan = spark.createDataFrame(
        [
            (i, s, sizes[s], targets[s], min(targets[s] / sizes[s] if sizes[s] else 1.0, float(most)))
            for i, s in enumerate(targets)
        ],
        "grp int, _source string, source_size long, target double, ratio double",
    )
    if len(sizes) <= PLAN_ROWS:
        plan = F.broadcast(plan)
    joined = sized.join(plan, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    # Equal rows share both hashes; their rank among themselves tells them apart.
    rank = F.row_number().over(Window.partitionBy("grp", "_hash", "_tie").orderBy("size"))
    base = (
        joined.withColumn("_rank", rank)
        .withColumn("whole", F.floor("ratio").cast("long"))
        .select(
            "grp", F.xxhash64("_hash", "_rank").alias("ordinal"), F.xxhash64("_tie", "_rank").alias("tie"),
            "_hash", "_tie", "doc_id", "source", "size", "source_size", "target", "whole", (F.col("ratio") - F.col("whole")).alias("p"),
        )
    )
    open_ = base.filter((F.col("p") > _EPS) & (F.col("p") < 1 - _EPS)).select("grp", "ordinal", "tie", "size", "p")
    chosen = balanced(open_, max(rows.values(), default=0))
    extra = F.coalesce(F.col("_p"), F.when(F.col("p") > 0.5, 1.0).otherwise(0.0)).cast("long")
    return (
        base.join(chosen.withColumnRenamed("p", "_p"), ["grp", "ordinal", "tie"], "left")
        .withColumn("copies", F.col("whole") + extra)
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "_hash", "_tie")
    )


def taken(df: DataFrame, *, seed: int = 11, **options) -> DataFrame:
    """``df`` with every row repeated as often as ``mix`` takes it; rows not taken are absent.

    Rows equal in id, source and text share the copies that were decided for them.  All columns stay, whatever their
    names.  Nulls and empty tables are treated as in ``mix``.
    """
    decided = mix(df, seed=seed, **options).groupBy("_hash", "_tie", "source").agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows"))
    decided = decided.withColumnRenamed("source", "_source")
    # The row travels as one struct, so its columns may have any names.
    marked = df.select(F.struct("*").alias("_row"), "source", *_marks(seed))
    nth = F.row_number().over(Window.partitionBy("_hash", "_tie", "source").orderBy(F.lit(0)))
    joined = marked.alias("d").join(
        decided.alias("m"),
        (F.col("d._hash") == F.col("m._hash"))
        & (F.col("d._tie") == F.col("m._tie"))
        & F.col("d.source").eqNullSafe(F.col("m._source")),
    ).select("d.*", "m._copies", "m._rows")
    # Of n equal rows the first (copies mod n) give one more than the others.
    share = F.floor(F.col("_copies") / F.col("_rows")) + (nth <= F.col("_copies") % F.col("_rows")).cast("long")
    return (
        joined.withColumn("_share", share)
        .filter("_share > 0")
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_share").cast("int"))))
        .select("_row.*")
    )
