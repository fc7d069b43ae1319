"""Hard negatives for anchors, found through zone maps of Hilbert-ordered blocks.

Vectors become integers floor(256 x).  Rows are ordered by number of components, label and their place on a
Hilbert curve through sixteen fixed projections, so neighbours in space are neighbours in the table, and cut
into Parquet blocks of bounded size.  The zone map of a block has the least and the largest value of
every component.  For an anchor a and a block, interval arithmetic gives bounds of all its scores:
sum(min(a*lo, a*hi)) to sum(max(a*lo, a*hi)).  A block is read for an anchor only if these can
reach one of its windows, and not if another block is known to fill the window with higher scores.

First every anchor gets its positives (one window without limits over the blocks of its label), then
each positive's score gives a window for negatives (blocks of other labels).  Anchors travel in
groups that are cut like blocks; a task holds one group, a slice of the blocks chosen for it, and the
best few rows of every window.
"""

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import rows_of, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

POSITIVES = 5
NEGATIVES = 3
#: A negative's score in hundredths of the positive's, at least and at most.
WINDOW = (50, 95)
#: Bytes of the integers of one block of candidates and of one group of anchors.
BLOCK_BYTES = 128 << 10
GROUP_BYTES = 512 << 10
#: Zone maps that travel together, and blocks that one task reads for a group.
ZONES = 256
SLICE = 64
#: Projections and bits of each on the Hilbert curve; together 64 bits.
AXES = 16
BITS = 4
FEWEST, MOST = -(1 << 63) + 1, (1 << 63) - 1


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of ``cells``, whole numbers below ``2**bits``; at most 64 bits in all."""
    x = cells.astype(np.uint64).T.copy()
    one = np.uint64(1)
    q = 1 << (bits - 1)
    while q > 1:
        bit, low = np.uint64(q), np.uint64(q - 1)
        for i in range(len(x)):
            flip = (x[i] & bit) != 0
            swap = np.where(flip, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.uint64)
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[-1] & np.uint64(q)) != 0, turn ^ np.uint64(q - 1), turn)
        q >>= 1
    x ^= turn
    key = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for row in x:
            key = (key << one) | ((row >> np.uint64(b)) & one)
    return key


def axes(dim: int) -> np.ndarray:
    """Fixed random signs that project unit vectors to ``AXES`` numbers of variance one."""
    return np.where(np.random.default_rng(dim).random((dim, AXES)) < 0.5, -1.0, 1.0)


def _rows(df: DataFrame, ident: str, label: str, vector: str) -> DataFrame:
    """(ident, label, dim, q, axes): one row per usable id, its integers as 2 or 8 bytes each and the projections of its direction."""
    kind = df.schema[label].dataType.simpleString()
    rows = df.filter(F.col(ident).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        signs = {}
        for batch in batches:
            taken, dims, qs, places = [], [], [], []
            for at, values in enumerate(batch.column(2).to_pylist()):
                if not values or any(v is None for v in values):
                    continue
                x = np.array(values, np.float64)
                with np.errstate(over="ignore", invalid="ignore"):
                    whole = np.floor(x * 256.0)
                    # Beyond this length products need not fit into a long.
                    if not np.isfinite(x).all() or not (whole * whole).sum() < 2.0**62:
                        continue
                dim = len(x)
                if dim not in signs:
                    signs[dim] = axes(dim)
                length = np.sqrt((whole * whole).sum())
                taken.append(at)
                dims.append(dim)
                qs.append(whole.astype(np.int16 if np.abs(whole).max() < 1 << 15 else np.int64).tobytes())
                places.append((whole @ signs[dim] / (length or 1.0)).tolist())
            chosen = batch.take(pa.array(taken, pa.int64()))
            yield {"ident": chosen.column(0), "label": chosen.column(1), "dim": dims, "q": qs, "axes": places}

    chosen = rows.select(F.col(ident).cast("long"), label, vector)
    found = rows_of(chosen, f"ident long, label {kind}, dim int, q binary, axes array<double>", run)
    # An id that occurs more than once counts once.
    least = found.groupBy("ident").agg(F.min(F.struct("label", "dim", "q", "axes")).alias("r"))
    return written(least.select("ident", "r.label", "r.dim", "r.q", "r.axes"), "vectors")


def _placed(rows: DataFrame) -> DataFrame:
    """The rows with their place on the curve; projections are cut by their means and deviations over all rows."""
    column = [F.get("axes", F.lit(i)) for i in range(AXES)]
    stats = rows.agg(*[F.avg(c) for c in column], *[F.stddev_pop(c) for c in column]).first()
    mean = [x or 0.0 for x in stats[:AXES]]
    deviation = [x or 1.0 for x in stats[AXES:]]
    steps = 1 << BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            at = np.array(batch.column("axes").to_pylist(), float).reshape(batch.num_rows, AXES)
            cells = np.clip(np.floor((at - mean) / deviation * (steps / 8) + steps / 2), 0, steps - 1)
            place = hilbert(cells, BITS).astype(">u8")
            yield {c: batch.column(c) for c in ("ident", "label", "dim", "q")} | {"place": [p.tobytes() for p in place]}

    kind = rows.schema["label"].dataType.simpleString()
    return written(rows_of(rows, f"ident long, label {kind}, dim int, q binary, place binary", run), "placed")


def _blocks(placed: DataFrame, size: int, name: str) -> DataFrame:
    """Parquet blocks of neighbours of one label: (dim, label, block, n, width, ids, q, lo, hi)."""
    kind = placed.schema["label"].dataType.simpleString()
    order = ["dim", "label", "place", "ident"]
    ordered = placed.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        current, ids, qs, used = None, [], [], 0

        def finish() -> dict:
            dim, label, width = current
            q = np.frombuffer(b"".join(qs), np.int16 if width == 2 else np.int64).reshape(len(ids), dim)
            packed = np.array(ids, np.int64).tobytes()
            return {
                "dim": [dim], "label": [label], "block": [xxhash.xxh3_128_digest(packed)], "n": [len(ids)], "width": [width],
                "ids": [packed], "q": [q.tobytes()], "lo": [q.min(axis=0).astype(np.int64).tobytes()], "hi": [q.max(axis=0).astype(np.int64).tobytes()],
            }

        for batch in batches:
            for ident, label, dim, q in zip(*(batch.column(c).to_pylist() for c in ("ident", "label", "dim", "q"))):
                own = (dim, label, len(q) // dim)
                if ids and (own != current or used + len(q) > size):
                    yield finish()
                    ids, qs, used = [], [], 0
                current = own
                ids.append(ident)
                qs.append(q)
                used += len(q)
        if ids:
            yield finish()

    schema = f"dim int, label {kind}, block binary, n int, width int, ids binary, q binary, lo binary, hi binary"
    return written(rows_of(ordered, schema, run), name)


def _zones(blocks: DataFrame) -> DataFrame:
    """Zone maps in bundles: (dim, first, last, blocks, labels, n, lo, hi), ``first`` and ``last`` of the labels."""
    kind = blocks.schema["label"].dataType.simpleString()
    ordered = blocks.select("dim", "label", "block", "n", "lo", "hi").repartitionByRange("dim", "label", "block").sortWithinPartitions("dim", "label", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        rows = []

        def finish() -> dict:
            dims, labels, blocks, n, lo, hi = zip(*rows)
            return {
                "dim": [dims[0]], "first": [labels[0]], "last": [labels[-1]], "blocks": [list(blocks)], "labels": [list(labels)],
                "n": [list(n)], "lo": [b"".join(lo)], "hi": [b"".join(hi)],
            }

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and (row[0] != rows[0][0] or len(rows) == ZONES):
                    yield finish()
                    rows = []
                rows.append(row)
        if rows:
            yield finish()

    schema = f"dim int, first {kind}, last {kind}, blocks array<binary>, labels array<{kind}>, n array<int>, lo binary, hi binary"
    return written(rows_of(ordered, schema, run), "zones")


def bounds(a: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of each anchor with anything between ``lo`` and ``hi``, widened by what doubles round."""
    up, down = np.maximum(a, 0.0), np.minimum(a, 0.0)
    least, most = up @ lo.T + down @ hi.T, up @ hi.T + down @ lo.T
    largest = max(np.abs(lo).max(initial=0), np.abs(hi).max(initial=0)) * np.abs(a).max(initial=0) * max(1, a.shape[1])
    slack = 0.0 if largest < 2.0**52 else largest * 2.0**-40
    return least - slack, most + slack


def needed(least: np.ndarray, most: np.ndarray, n: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: int) -> np.ndarray:
    """Which blocks each anchor must read: ``least``, ``most`` are anchors x blocks, ``lo``, ``hi`` anchors x windows."""
    out = np.zeros(least.shape, bool)
    for w in range(lo.shape[1]):
        low, high = lo[:, w, None].astype(float), hi[:, w, None].astype(float)
        # A block that lies inside the window with k rows or more: nothing below its least score is asked for.
        full = (least >= low) & (most <= high) & (n >= k)
        floor = np.where(full, least, -np.inf).max(axis=1, initial=-np.inf)[:, None]
        out |= (most >= np.maximum(low, floor)) & (least <= high) & (low <= high)
    return out


def _matrix(q: bytes, width: int, dim: int) -> np.ndarray:
    return np.frombuffer(q, np.int16 if width == 2 else np.int64).reshape(-1, dim)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products; in doubles where they hold them, else in 64-bit integers."""
    largest = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    kind = np.float64 if largest < 2.0**53 else np.int64
    return a.astype(kind) @ b.astype(kind).T


class Best:
    """The ``k`` highest scores of every anchor and window, ties to the smaller id."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray, k: int):
        self.lo, self.hi, self.k = lo, hi, k
        self.scores = np.full((*lo.shape, k), FEWEST - 1, np.int64)
        self.ids = np.full((*lo.shape, k), MOST, np.int64)

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, without: np.ndarray | None) -> None:
        """Candidates ``ids`` with ``scores`` (rows x ids) for the anchors ``rows``; ``without`` has each anchor's own id."""
        for w in range(self.lo.shape[1]):
            low = np.maximum(self.lo[rows, w], self.scores[rows, w, -1])
            fits = (scores >= low[:, None]) & (scores <= self.hi[rows, w, None])
            if without is not None:
                fits &= ids[None] != without[rows][:, None]
            i, j = np.nonzero(fits)
            if not len(i):
                continue
            some = np.unique(i)
            own = rows[some]
            who = np.concatenate([rows[i], np.repeat(own, self.k)])
            score = np.concatenate([scores[i, j].astype(np.int64), self.scores[own, w].ravel()])
            ident = np.concatenate([ids[j], self.ids[own, w].ravel()])
            # ~x falls as x rises and has no overflow.
            order = np.lexsort((ident, ~score, who))
            who, score, ident = who[order], score[order], ident[order]
            _, first, count = np.unique(who, return_index=True, return_counts=True)
            at = np.arange(len(who)) - np.repeat(first, count)
            kept = at < self.k
            self.scores[who[kept], w, at[kept]] = score[kept]
            self.ids[who[kept], w, at[kept]] = ident[kept]


def _search(groups: DataFrame, windows: DataFrame | None, blocks: DataFrame, zones: DataFrame, *, same: bool, k: int) -> DataFrame:
    """(block, at, window, ident, score): the ``k`` best rows of each window of the anchors ``at`` of a group.

    ``windows`` has (block, lo, hi), packed longs of anchors x windows; without it there is one window
    without limits.  ``same`` searches the blocks of the anchors' label, else those of the others.
    """
    salts = max(1, zones.count())
    if windows is None:
        windows = groups.select("block", F.lit(None).cast("binary").alias("los"), F.lit(None).cast("binary").alias("his"))
    asked = groups.select("dim", "label", F.col("block").alias("group"), "n", "width", "ids", "q").join(windows.withColumnRenamed("block", "group"), "group")
    asked = written(asked, "asked")

    def limits(los: bytes | None, his: bytes | None, count: int) -> tuple[np.ndarray, np.ndarray]:
        if los is None:
            return np.full((count, 1), FEWEST, np.int64), np.full((count, 1), MOST, np.int64)
        return np.frombuffer(los, np.int64).reshape(count, -1), np.frombuffer(his, np.int64).reshape(count, -1)

    dealt = zones.withColumn("salt", F.pmod(F.xxhash64("lo", F.get("blocks", F.lit(0))), F.lit(salts)).cast("int"))
    salted = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumnRenamed("n", "count")
    met = salted.join(dealt, ["dim", "salt"])
    met = met.filter((F.col("label") >= F.col("first")) & (F.col("label") <= F.col("last")) if same else (F.col("label") != F.col("first")) | (F.col("label") != F.col("last")))
    columns = ["group", "dim", "label", "count", "width", "q", "los", "his", "blocks", "labels", "n", "lo", "hi"]

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in columns}
                a = _matrix(row["q"], row["width"], row["dim"]).astype(float)
                low, high = (np.frombuffer(row[c], np.int64).reshape(-1, row["dim"]).astype(float) for c in ("lo", "hi"))
                other = np.array([(x == row["label"]) == same for x in row["labels"]])
                least, most = bounds(a, low, high)
                must = needed(least[:, other], most[:, other], np.array(row["n"])[other], *limits(row["los"], row["his"], row["count"]), k + same)
                names = [b for b, o in zip(row["blocks"], other) if o]
                some = np.flatnonzero(must.any(axis=0))
                yield {
                    "group": [row["group"]] * len(some), "block": [names[s] for s in some],
                    "mask": [np.packbits(must[:, s]).tobytes() for s in some], "upper": most[:, other][:, some].max(axis=0, initial=-np.inf).tolist(),
                }

    chosen = rows_of(met.select(columns), "group binary, block binary, mask binary, upper double", choose)
    nth = F.row_number().over(Window.partitionBy("group").orderBy(F.desc("upper"), "block"))
    chosen = written(chosen.withColumn("slice", F.floor((nth - 1) / SLICE).cast("int")), "chosen")

    none = F.lit(None).cast("binary")
    hosts = chosen.select("group", "slice").distinct().join(asked, "group").select(
        "group", "slice", F.lit(0).alias("role"), F.lit(0.0).alias("order"), "dim", "width", "ids", "q", "los", "his", none.alias("mask")
    )
    come = chosen.join(blocks.select("block", "dim", "width", "ids", "q"), "block").select(
        "group", "slice", F.lit(1).alias("role"), (-F.col("upper")).alias("order"), "dim", "width", "ids", "q", none.alias("los"), none.alias("his"), "mask"
    )
    ordered = hosts.unionByName(come).repartition("group", "slice").sortWithinPartitions("group", "slice", "role", "order")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        group = best = own = ids = None

        def answer() -> dict:
            at, w, r = np.nonzero(best.scores >= FEWEST)
            return {
                "group": [group] * len(at), "at": at.astype(np.int32), "window": w.astype(np.int32),
                "ident": best.ids[at, w, r], "score": best.scores[at, w, r],
            }

        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("group", "role", "dim", "width", "ids", "q", "los", "his", "mask")}
                matrix, numbers = _matrix(row["q"], row["width"], row["dim"]), np.frombuffer(row["ids"], np.int64)
                if row["role"] == 0:
                    if best is not None:
                        yield answer()
                    group, own, ids = row["group"], matrix, numbers
                    best = Best(*limits(row["los"], row["his"], len(ids)), k)
                    continue
                rows = np.flatnonzero(np.unpackbits(np.frombuffer(row["mask"], np.uint8), count=len(ids)))
                best.add(rows, products(own[rows], matrix), numbers, ids if same else None)
        if best is not None:
            yield answer()

    found = rows_of(ordered, "group binary, at int, window int, ident long, score long", scan)
    rank = F.row_number().over(Window.partitionBy("group", "at", "window").orderBy(F.desc("score"), "ident"))
    return written(found.withColumn("rank", rank).filter(F.col("rank") <= k), "positives" if same else "negatives")


def _windows(positives: DataFrame, groups: DataFrame, most: int, window: tuple[int, int]) -> DataFrame:
    """(block, los, his): the range of scores that negatives may have for each anchor and positive; empty where there is none."""
    low, high = window
    listed = positives.groupBy("group").agg(F.collect_list(F.struct("at", "rank", "score")).alias("l"))
    rows = groups.select("block", "n").join(listed.withColumnRenamed("group", "block"), "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            los, his = [], []
            for n, found in zip(batch.column("n").to_pylist(), batch.column("l").to_pylist()):
                lo, hi = np.full((n, most), MOST, np.int64), np.full((n, most), FEWEST, np.int64)
                for x in found:
                    lo[x["at"], x["rank"] - 1] = max(FEWEST, -(-low * x["score"] // 100))
                    hi[x["at"], x["rank"] - 1] = min(MOST, high * x["score"] // 100)
                los.append(lo.tobytes())
                his.append(hi.tobytes())
            yield {"block": batch.column("block"), "los": los, "his": his}

    return rows_of(rows, "block binary, los binary, his binary", run)


def mine(
    df: DataFrame, anchors: Callable[[Column], Column], *, positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW,
    ident: str = "vec_id", label: str = "label", vector: str = "embedding", block_bytes: int = BLOCK_BYTES, group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """Hard negatives: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows for whose id ``anchors`` gives true.  An anchor's positives are the ``positives`` other rows of its label with the highest score, the inner product of the integers
    floor(256 x); for each of them the ``negatives`` highest rows of other labels are returned whose score is at
    least ``window[0]`` and at most ``window[1]`` hundredths of the positive's (nothing fits below a
    negative score).  Ties go to the smaller id.  Ids are whole numbers.  Rows with a null id or label, or whose vector is
    null, empty or holds null or non-finite components, take no part, nor do rows whose
    squared length in integers is 2**62 or more, since their scores need not fit into a long.  Vectors of different
    lengths are never compared.  An id that occurs more than once counts once, with the least label and, of that, vector.  An
    empty table gives an empty result; other columns are ignored.
    """
    placed = _placed(_rows(df, ident, label, vector))
    blocks = _blocks(placed, block_bytes, "blocks")
    zones = _zones(blocks)
    groups = _blocks(placed.filter(anchors(F.col("ident"))), group_bytes, "groups")
    near = _search(groups, None, blocks, zones, same=True, k=positives)
    hard = _search(groups, _windows(near, groups, positives, window), blocks, zones, same=False, k=negatives)

    names = rows_of(
        groups.select("block", "ids"), "group binary, at int, anchor_id long",
        lambda batches: (
            {"group": [block] * len(ids), "at": list(range(len(ids))), "anchor_id": ids}
            for batch in batches for block, packed in zip(*(c.to_pylist() for c in batch.columns)) for ids in [np.frombuffer(packed, np.int64)]
        ),
    )
    near = near.select("group", "at", (F.col("rank") - 1).alias("window"), F.col("ident").alias("positive_id"), F.col("score").alias("positive_score"))
    hard = hard.select("group", "at", "window", "rank", F.col("ident").alias("negative_id"), F.col("score").alias("negative_score"))
    return hard.join(near, ["group", "at", "window"]).join(names, ["group", "at"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


def oracle() -> str:
    """DuckDB SQL of ``op11``: all scores of all anchors."""
    low, high = WINDOW
    return f"""
WITH usable AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM usable a JOIN usable b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= {POSITIVES})
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)::INTEGER AS rank,
  other AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE NOT same AND {low} * positive_score <= 100 * score AND 100 * score <= {high} * positive_score
QUALIFY rank <= {NEGATIVES}"""
