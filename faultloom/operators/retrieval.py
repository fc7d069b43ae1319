"""Cosine nearest neighbours inside a workspace, embeddings, and formatting of the hits.

Vectors are packed into blocks of bounded size and compared block against block, so a task holds
two blocks at most and emits k hits per query, never all pairs.  A workspace that holds most of the
vectors simply has more blocks.  Block centres and radii bound the best similarity a pair of blocks
can reach; pairs that cannot matter are dropped before any vector is shuffled to them.  Bounds are
tried from the top: blocks stand on the shelf of the nearest of a few leaders, whose number follows the
root of the blocks' number, or alone if all leaders are far; pairs of shelves are bounded first, and block
pairs are formed only inside pairs of shelves that are left.
"""

import math
import sys
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed_values as fv
from ..session import checkpoint_folder

# Send the functions of this module with the job: executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_ROWS = 1024
PAIR_SALTS = 16
# Corpus blocks that visit a query block in one task.
SLICE_VISITS = 256
# Leaders are so many times the root of the number of blocks; blocks farther from all (in radians) stand alone.
LEADERS = 4
LEADER_REACH = 0.25
_CELL_BITS = 16
_PLANE_SEED = 7
_DIGITS = 12  # similarities are rounded here so that equal vectors tie and ids decide


def _unit(matrix: np.ndarray) -> np.ndarray:
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def _codes(matrix: np.ndarray) -> np.ndarray:
    planes = np.random.default_rng(_PLANE_SEED).standard_normal((matrix.shape[1], _CELL_BITS))
    return ((matrix @ planes) > 0) @ (1 << np.arange(_CELL_BITS - 1, -1, -1)).astype(np.int64)


@F.pandas_udf(T.IntegerType())
def _cell_code(vectors: pd.Series) -> pd.Series:
    """Signs of 16 seeded random projections as one integer: near vectors share leading bits."""
    return pd.Series(_codes(np.stack(vectors.to_numpy()).astype(np.float64))).astype("int32")


def _vectors(packed: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Ids and unit vectors of one packed block."""
    ids, vecs = packed.flatten()
    flat = vecs.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return ids, _unit(flat.reshape(len(ids), -1))


def _blocks(df: DataFrame, group: str, ident: str, vector: str, rows: int) -> DataFrame:
    """Packed blocks (group, block, items, centre, radius) of about ``rows`` vectors each, as a table.

    A histogram of cell codes per group (at most 65,536 rows) cuts the codes in their order into runs of about ``rows`` vectors, so a
    block shares as many leading bits as its size allows; a crowded code (for example one full of copies) is split into parts.
    """
    clean = df.select(
        F.col(group).alias("grp"), F.col(ident).alias("id"), F.col(vector).alias("vec")
    ).filter(F.col("vec").isNotNull() & F.exists("vec", lambda x: x != 0))
    coded = clean.withColumn("code", _cell_code("vec"))
    histogram = coded.groupBy("grp", "code").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("grp").orderBy("code").rowsBetween(Window.unboundedPreceding, -1)
    layout = (
        histogram.withColumn("cell", F.floor(F.coalesce(F.sum("n").over(order), F.lit(0)) / rows))
        .withColumn("parts", F.ceil(F.col("n") / rows))
        .select("grp", "code", "cell", "parts")
    )
    placed = coded.join(layout, ["grp", "code"]).withColumn(
        "block", F.concat_ws(":", "cell", F.when(F.col("parts") > 1, F.concat_ws(":", "code", F.pmod(F.xxhash64("id"), F.col("parts")))))
    )
    packed = placed.groupBy("grp", "block").agg(F.collect_list(F.struct("id", "vec")).alias("items"))
    schema = T.StructType(
        [*packed.schema.fields, T.StructField("centre", T.ArrayType(T.DoubleType())), T.StructField("radius", T.DoubleType())]
    )

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            centres, radii = [], []
            for cell in batch.column("items"):
                _, unit = _vectors(cell.values)
                mean = unit.mean(axis=0)
                norm = np.linalg.norm(mean)
                centre = mean / norm if norm > 1e-9 else unit[0]
                centres.append(centre.tolist())
                radii.append(float(np.arccos(np.clip(unit @ centre, -1, 1)).max()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(centres, pa.list_(pa.float64())), pa.array(radii, pa.float64())],
                names=[*batch.schema.names, "centre", "radius"],
            )

    return _stored(packed.mapInArrow(describe, schema), "blocks")


def _stored(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder: computed once however often it is read."""
    folder = f"{checkpoint_folder(df.sparkSession, name)}/{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _angle(a: Column, b: Column) -> Column:
    return F.acos(F.greatest(F.least(_dot(a, b), F.lit(1.0)), F.lit(-1.0)))


def _shelved(meta: DataFrame) -> DataFrame:
    """``meta(grp, block, centre, radius)`` with the shelf of each block, as a table."""
    order = Window.partitionBy("grp").orderBy(F.xxhash64("block"), "block")
    names = meta.select("grp", "block")
    many = names.groupBy("grp").agg(F.ceil(LEADERS * F.sqrt(F.count(F.lit(1)))).alias("leaders"))
    ranked = names.withColumn("n", F.row_number().over(order)).join(many, "grp").filter(F.col("n") <= F.col("leaders"))
    leaders = ranked.select("grp", "block").join(meta, ["grp", "block"]).select("grp", F.col("block").alias("shelf"), F.col("centre").alias("middle"))
    salted = meta.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(PAIR_SALTS)).cast("int"))
    copies = leaders.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(PAIR_SALTS - 1))))
    near = salted.join(copies, ["grp", "salt"]).groupBy("grp", "block").agg(
        F.max(F.struct(_dot(F.col("centre"), F.col("middle")).alias("near"), "shelf")).alias("best"),
        F.bool_or(F.col("block") == F.col("shelf")).alias("leads"),
    )
    # A leader stays on its own shelf, so every shelf has its centre.
    joins = ~F.col("leads") & (F.col("best.near") >= F.lit(math.cos(LEADER_REACH)))
    near = near.select("grp", "block", F.when(joins, F.col("best.shelf")).otherwise(F.col("block")).alias("shelf"))
    return _stored(meta.join(near, ["grp", "block"]), "shelved")


def _shelves(shelved: DataFrame) -> DataFrame:
    """(grp, shelf, centre, radius): the leader's centre, and how far the shelf's blocks reach from it."""
    middle = shelved.filter(F.col("block") == F.col("shelf")).select("grp", "shelf", F.col("centre").alias("middle"))
    found = shelved.join(middle, ["grp", "shelf"])
    return found.groupBy("grp", "shelf").agg(
        F.any_value("middle").alias("centre"), F.max(_angle(F.col("middle"), F.col("centre")) + F.col("radius")).alias("radius")
    )


def _pairs(q: DataFrame, c: DataFrame) -> DataFrame:
    """All pairs of two sides (grp, <key>, centre, radius) of one group: (grp, q_<key>, c_<key>, near, bound).

    The query side is salted and the corpus side copied to every salt, so the pairs of one large group
    are formed in many tasks.
    """
    key = next(x for x in q.columns if x not in ("grp", "centre", "radius"))
    left = q.select("grp", F.col(key).alias(f"q_{key}"), F.col("centre").alias("qc"), F.col("radius").alias("qr"))
    right = c.select("grp", F.col(key).alias(f"c_{key}"), F.col("centre").alias("cc"), F.col("radius").alias("cr"))
    salted = left.withColumn("salt", F.pmod(F.xxhash64(f"q_{key}"), F.lit(PAIR_SALTS)).cast("int"))
    copies = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(PAIR_SALTS - 1))))
    met = salted.join(copies, ["grp", "salt"]).withColumn("near", _dot(F.col("qc"), F.col("cc")))
    return met.select("grp", f"q_{key}", f"c_{key}", "near", _pair_bound(F.col("near"), F.col("qr"), F.col("cr")).alias("bound"))


def _inside(shelf_pairs: DataFrame, q: DataFrame, c: DataFrame) -> DataFrame:
    """Block pairs (grp, qblock, cblock, near, bound) of the listed pairs of shelves."""
    left = q.select("grp", F.col("shelf").alias("q_shelf"), F.col("block").alias("qblock"), F.col("centre").alias("qc"), F.col("radius").alias("qr"))
    right = c.select("grp", F.col("shelf").alias("c_shelf"), F.col("block").alias("cblock"), F.col("centre").alias("cc"), F.col("radius").alias("cr"))
    met = shelf_pairs.select("grp", "q_shelf", "c_shelf").join(left, ["grp", "q_shelf"]).join(right, ["grp", "c_shelf"])
    met = met.withColumn("near", _dot(F.col("qc"), F.col("cc")))
    return met.select("grp", "qblock", "cblock", "near", _pair_bound(F.col("near"), F.col("qr"), F.col("cr")).alias("bound"))


def block_pairs(q: DataFrame, c: DataFrame, floor: float) -> DataFrame:
    """Pairs of shelved blocks that can hold a similarity of ``floor`` or more, from pairs of shelves down."""
    shelves = _pairs(_shelves(q), _shelves(c))
    return _inside(shelves.filter(F.col("bound") >= floor), q, c).filter(F.col("bound") >= floor)


def seed_pairs(q: DataFrame, c: DataFrame, count: int) -> DataFrame:
    """For every query block the ``count`` nearest corpus blocks of the shelves nearest to its own."""
    order = Window.partitionBy("grp", "q_shelf").orderBy(F.col("near").desc(), "c_shelf")
    size = c.groupBy("grp", F.col("shelf").alias("c_shelf")).agg(F.count(F.lit(1)).alias("n"))
    ranked = _pairs(_shelves(q), _shelves(c)).join(size, ["grp", "c_shelf"])
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near = ranked.withColumn("before", before).filter(F.col("before") < count)
    promising = F.row_number().over(Window.partitionBy("grp", "qblock").orderBy(F.col("near").desc(), "cblock"))
    return _inside(near, q, c).withColumn("_n", promising).filter(F.col("_n") <= count).drop("_n")


def pairs_above(q: DataFrame, c: DataFrame, cut: DataFrame) -> DataFrame:
    """Pairs of blocks whose bound reaches the query block's ``cut(grp, qblock, cut)``, from pairs of shelves down."""
    of_block = q.select("grp", "shelf", F.col("block").alias("qblock")).join(cut, ["grp", "qblock"])
    of_shelf = of_block.groupBy("grp", F.col("shelf").alias("q_shelf")).agg(F.min("cut").alias("cut"))
    shelves = _pairs(_shelves(q), _shelves(c)).join(of_shelf, ["grp", "q_shelf"]).filter(F.col("bound") >= F.col("cut"))
    return _inside(shelves, q, c).join(cut, ["grp", "qblock"]).filter(F.col("bound") >= F.col("cut")).drop("cut")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _pair_bound(dot: Column, ra: Column, rb: Column) -> Column:
    """Greatest cosine any two members of two blocks can have, from their centres' cosine and radii."""
    angle = F.acos(F.greatest(F.least(dot, F.lit(1.0)), F.lit(-1.0)))
    return F.cos(F.greatest(angle - ra - rb - F.lit(1e-6), F.lit(0.0)))


def _top_in_block(sims: np.ndarray, k: int) -> np.ndarray:
    """Column indices of each row's k best, earlier columns first among equals."""
    n = sims.shape[1]
    if n <= k:
        return np.argsort(-sims, axis=1, kind="stable")
    best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    cut = np.take_along_axis(sims, best, axis=1).min(axis=1, keepdims=True)
    tied = (sims >= cut).sum(axis=1) > k
    if tied.any():
        best[tied] = np.argsort(-sims[tied], axis=1, kind="stable")[:, :k]
    return best


class _Runs:
    """Unit vectors of a block in the order of their cell codes, cut into runs that have a centre and a radius each."""

    def __init__(self, ids: pa.Array, unit: np.ndarray, rows: int):
        order = np.argsort(_codes(unit), kind="stable") if rows < len(unit) else np.arange(len(unit))
        self.ids, self.unit = ids.take(pa.array(order)), unit[order]
        self.cuts = np.append(np.arange(0, len(unit), rows), len(unit))
        sums = np.add.reduceat(self.unit, self.cuts[:-1], axis=0)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        self.centres = np.where(norms > 1e-9, sums / np.maximum(norms, 1e-9), self.unit[self.cuts[:-1]])
        near = np.einsum("ij,ij->i", self.unit, np.repeat(self.centres, np.diff(self.cuts), axis=0))
        self.radii = np.maximum.reduceat(np.arccos(np.clip(near, -1, 1)), self.cuts[:-1])

    def rows(self, runs: np.ndarray) -> np.ndarray:
        return np.concatenate([np.arange(self.cuts[r], self.cuts[r + 1]) for r in runs])


class _Nearest:
    """The k best corpus rows so far of each query of one block, which corpus blocks visit one after the other."""

    def __init__(self, grp: object, queries: _Runs, k: int, floor: float, skip_self: bool):
        self.grp, self.queries, self.k, self.floor, self.skip_self = grp, queries, k, floor, skip_self
        self.cut = np.full(len(queries.ids), floor)
        self.held: pa.Table | None = None

    def visit(self, corpus: _Runs) -> None:
        q = self.queries
        lowest = np.minimum.reduceat(self.cut, q.cuts[:-1])
        angle = np.arccos(np.clip(q.centres @ corpus.centres.T, -1, 1)) - q.radii[:, None] - corpus.radii[None]
        meets = np.cos(np.maximum(angle - 1e-6, 0)) >= lowest[:, None]
        if 2 * np.count_nonzero(meets) > meets.size:
            self._add(corpus, np.arange(len(q.ids)), np.arange(len(corpus.ids)))
        else:
            for run in np.flatnonzero(meets.any(axis=1)):
                self._add(corpus, np.arange(q.cuts[run], q.cuts[run + 1]), corpus.rows(np.flatnonzero(meets[run])))

    def _add(self, corpus: _Runs, rows: np.ndarray, cols: np.ndarray) -> None:
        ids = corpus.ids.take(pa.array(cols))
        order = pa.compute.sort_indices(ids).to_numpy()
        ids, cols = ids.take(pa.array(order)), cols[order]
        whole = len(rows) == len(self.queries.ids)
        q_ids = self.queries.ids if whole else self.queries.ids.take(pa.array(rows))
        sims = (self.queries.unit if whole else self.queries.unit[rows]) @ corpus.unit[cols].T
        if self.skip_self:
            at = pa.compute.index_in(q_ids, value_set=ids)
            own = at.is_valid().to_numpy(zero_copy_only=False)
            sims[np.flatnonzero(own), at.drop_null().to_numpy()] = -np.inf
        # Rounding moves a similarity by less than this.
        able = np.flatnonzero(sims.max(axis=1) >= self.cut[rows] - 10.0**-_DIGITS)
        if not len(able):
            return
        sims, rows = np.round(sims[able], _DIGITS), rows[able]
        best = _top_in_block(sims, self.k)
        values = np.take_along_axis(sims, best, axis=1)
        at = np.repeat(rows, best.shape[1])
        keep = np.flatnonzero(values.ravel() >= self.cut[at])
        found = pa.table({"row": pa.array(at[keep], pa.int32()), "cid": ids.take(pa.array(best.ravel()[keep])), "similarity": values.ravel()[keep]})
        held = found if self.held is None else pa.concat_tables([self.held, found])
        held = held.sort_by([("row", "ascending"), ("similarity", "descending"), ("cid", "ascending")]).combine_chunks()
        row = held["row"].to_numpy()
        first = np.flatnonzero(np.diff(row, prepend=-1))
        place = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
        last = np.flatnonzero(place == self.k - 1)
        self.cut[row[last]] = held["similarity"].to_numpy()[last]
        self.held = held.filter(pa.array(place < self.k))

    def hits(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        if self.held is None:
            return
        held = self.held.combine_chunks()
        columns = [pa.array([self.grp] * len(held), schema.field("grp").type), self.queries.ids.take(held["row"].combine_chunks()), held["cid"].combine_chunks(), held["similarity"].combine_chunks()]
        yield from pa.table(columns, names=["grp", "qid", "cid", "similarity"]).to_batches()


def _compare(pairs: DataFrame, q: DataFrame, c: DataFrame, k: int, floor: float | None, skip_self: bool, run_rows: int = BLOCK_ROWS) -> DataFrame:
    """Top k hits of every query over the corpus blocks that it is paired with, k for each slice of these.

    A query block waits in a task and the corpus blocks visit it, the nearest first, so what leaves the task is k hits per query
    however many blocks came.  Slices of ``SLICE_VISITS`` visits keep a block with many visitors from becoming one task.
    Inside a pair of blocks runs of ``run_rows`` vectors are bounded against the k-th hit so far.
    """
    qid = q.schema["items"].dataType.elementType["id"].dataType
    cid = c.schema["items"].dataType.elementType["id"].dataType
    met = _stored(pairs.select("grp", "qblock", "cblock", "near"), "pairs")
    slices = met.groupBy("grp", "qblock").agg(F.ceil(F.count(F.lit(1)) / F.lit(SLICE_VISITS)).alias("slices"))
    same = F.col("p.grp").eqNullSafe(F.col("s.grp")) & (F.col("p.qblock") == F.col("s.qblock"))
    sliced = met.alias("p").join(slices.alias("s"), same).select("p.*", F.pmod(F.xxhash64("cblock"), F.col("slices")).alias("slice"))
    place = ["grp", "qblock", "slice"]
    empty_q, empty_c = F.lit(None).cast(q.schema["items"].dataType), F.lit(None).cast(c.schema["items"].dataType)
    homes = (
        sliced.select(*place).distinct()
        .join(q.select("grp", "qblock", F.col("items").alias("qs")), ["grp", "qblock"])
        .select(*place, F.lit(2.0).alias("near"), "qs", empty_c.alias("cs"))
    )
    visits = (
        sliced.join(c.select("grp", "cblock", F.col("items").alias("cs")), ["grp", "cblock"])
        .select(*place, F.least("near", F.lit(1.0)).alias("near"), empty_q.alias("qs"), "cs")
    )
    work = homes.unionByName(visits).repartition(*place).sortWithinPartitions(*place, F.desc("near")).select("grp", "qs", "cs")
    schema = T.StructType(
        [
            T.StructField("grp", q.schema["grp"].dataType),
            T.StructField("qid", qid),
            T.StructField("cid", cid),
            T.StructField("similarity", T.DoubleType()),
        ]
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home = given = None
        for batch in batches:
            given = batch.schema
            for grp, qs, cs in zip(*(batch.column(n) for n in ("grp", "qs", "cs"))):
                if qs.is_valid:
                    if home is not None:
                        yield from home.hits(given)
                    home = _Nearest(grp.as_py(), _Runs(*_vectors(qs.values), run_rows), k, -2.0 if floor is None else floor, skip_self)
                else:
                    home.visit(_Runs(*_vectors(cs.values), run_rows))
        if home is not None:
            yield from home.hits(given)

    return work.mapInArrow(score, schema)


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("grp", "qid").orderBy(F.col("similarity").desc(), "cid")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def knn(
    queries: DataFrame,
    corpus: DataFrame,
    *,
    group: str,
    query_id: str,
    corpus_id: str,
    query_vector: str = "embedding",
    corpus_vector: str = "embedding",
    k: int = fv.RETRIEVAL_K,
    min_similarity: float | None = None,
    skip_self: bool = False,
    refine: bool = False,
    probes: int | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Up to k nearest corpus rows per query within ``group``: (group, query_id, corpus_id, similarity, rank).

    ``min_similarity`` applies before the top-k (same result) and prunes block pairs.  ``refine`` first
    searches each query block's most promising corpus block and then skips the pairs that cannot beat
    that result: worth it for large clustered corpora, where most pairs fall away.  ``probes`` does the same after that many
    blocks, so no hit is lost.  All these prune pairs of
    shelves before pairs of blocks, so the pairs that are formed follow those that matter.  Without any of them
    every query block meets every corpus block.  For a search that is not exact see ``vector_index``.
    Null and zero vectors have no cosine and take no part.
    """
    # Blocks travel and are paired by the thousand rows; smaller ones are runs inside a block, bounded where it is compared.
    rows = max(block_rows, BLOCK_ROWS)
    q = _blocks(queries, group, query_id, query_vector, rows)
    one_table = queries is corpus and query_id == corpus_id and query_vector == corpus_vector
    c = q if one_table else _blocks(corpus, group, corpus_id, corpus_vector, rows)
    meta = ["grp", "block", "centre", "radius"]
    bounded = refine or probes is not None or min_similarity is not None
    q_meta = _shelved(q.select(meta)) if bounded else q.select(meta)
    c_meta = q_meta if one_table else _shelved(c.select(meta)) if bounded else c.select(meta)
    q_items, c_items = q.select("grp", F.col("block").alias("qblock"), "items"), c.select("grp", F.col("block").alias("cblock"), "items")
    if refine or probes is not None:
        seeds = seed_pairs(q_meta, c_meta, 1 if probes is None else probes)
        hits = _best(_compare(seeds, q_items, c_items, k, None, skip_self, block_rows), k)
        worst = hits.filter(F.col("rank") == k).select(F.col("grp").alias("g"), F.col("qid").alias("i"), "similarity")
        members = q.select("grp", F.col("block").alias("qblock"), F.explode("items.id").alias("i"))
        lowest = F.lit(-2.0 if min_similarity is None else float(min_similarity))
        cut = (
            members.join(worst, (members["grp"] == worst["g"]) & (members["i"] == worst["i"]), "left")
            .groupBy("grp", "qblock")
            .agg(F.greatest(F.min(F.coalesce("similarity", F.lit(-2.0))), lowest).alias("cut"))
        )
        pairs = pairs_above(q_meta, c_meta, _stored(cut, "cuts"))
    elif min_similarity is not None:
        pairs = block_pairs(q_meta, c_meta, min_similarity)
    else:
        pairs = _pairs(q_meta, c_meta).withColumnsRenamed({"q_block": "qblock", "c_block": "cblock"})
    hits = _compare(pairs, q_items, c_items, k, min_similarity, skip_self, block_rows)
    names = [group, query_id if query_id != corpus_id else f"query_{query_id}", corpus_id]
    return _best(hits, k).select(
        F.col("grp").alias(names[0]), F.col("qid").alias(names[1]), F.col("cid").alias(names[2]), "similarity", "rank"
    )


def similar_incidents(
    events: DataFrame, errors: DataFrame, *, event_id: str = "event_id",
    min_similarity: float | None = fv.RETRIEVAL_MIN_SIMILARITY, **options,
) -> DataFrame:
    """Past errors of the same workspace nearest to each event (needs embedding and root_cause).

    Hits below ``min_similarity`` are left out, and with them most block pairs; None keeps all.

    ``errors`` carries ``error_id``.  Returns event id, rank, similarity, error_type, root_cause, fix.
    """
    corpus = errors.filter(F.col("embedding").isNotNull() & F.col("root_cause").isNotNull())
    hits = knn(events, corpus, group="workspace_id", query_id=event_id, corpus_id="error_id", min_similarity=min_similarity, **options)
    detail = corpus.select("workspace_id", "error_id", "error_type", "root_cause", "fix")
    return hits.join(detail, ["workspace_id", "error_id"])


def runbook_sections(
    events: DataFrame, chunks: DataFrame, *, event_id: str = "event_id",
    min_similarity: float | None = fv.RETRIEVAL_MIN_SIMILARITY, **options,
) -> DataFrame:
    """Runbook chunks of the same workspace nearest to each event; ``chunks`` carries ``chunk_id``.

    The threshold is that of :func:`similar_incidents`.
    """
    corpus = chunks.filter(F.col("embedding").isNotNull())
    hits = knn(events, corpus, group="workspace_id", query_id=event_id, corpus_id="chunk_id", min_similarity=min_similarity, **options)
    detail = corpus.select("workspace_id", "chunk_id", "source_file", "section_title", "chunk_text")
    return hits.join(detail, ["workspace_id", "chunk_id"])


def format_incident() -> Column:
    return F.format_string(
        "[%s] Root cause: %s | Fix: %s (similarity=%.2f)",
        F.col("error_type"), F.col("root_cause"), F.col("fix"), F.col("similarity"),
    )


def format_section() -> Column:
    title = F.when(F.col("section_title") != "", F.concat(F.lit(" > "), "section_title")).otherwise(F.lit(""))
    return F.concat(F.lit("From: "), "source_file", title, F.lit("\n"), "chunk_text")


def embed_with(
    df: DataFrame, column: str, model: Callable[[list[str]], list[list[float]]] | None = None, out: str = "embedding", *,
    load: Callable[[], Callable[[list[str]], list[list[float]]]] | None = None, max_chars: int | None = None, failure: str | None = None,
) -> DataFrame:
    """Unit-length vectors of a model function, called once per Arrow batch of texts.

    ``load`` makes the model where it is used, once per task instead of once per batch; it may read files.  The
    whole text goes to the model unless ``max_chars`` states its input limit.  A batch that fails is
    halved until the texts that fail stand alone: they get null vectors, so their events go on without
    retrieval, and a column named by ``failure`` holds the reason, so failures can be counted.  A model that cannot be
    loaded fails every text in the same way.
    """
    if (model is None) == (load is None):
        raise ValueError("give the model or how to load it")
    found = T.StructType([T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("failure", T.StringType())])

    def answers(run: Callable[[list[str]], list[list[float]]], texts: list[str]) -> list[tuple]:
        try:
            matrix = np.asarray(run(texts), dtype=np.float64)
            if matrix.ndim != 2 or len(matrix) != len(texts):
                raise ValueError(f"{len(texts)} texts gave an array of shape {matrix.shape}")
            with np.errstate(invalid="ignore", divide="ignore"):
                matrix = _unit(matrix)
            return [(list(v), None) if np.isfinite(v).all() else (None, "no finite vector") for v in matrix]
        except Exception as error:  # noqa: BLE001  (a failing model must not fail the event)
            if len(texts) > 1:
                half = len(texts) // 2
                return answers(run, texts[:half]) + answers(run, texts[half:])
            return [(None, f"{type(error).__name__}: {error}")]

    @F.pandas_udf(found)
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        run, broken = model, None
        if run is None:
            try:
                run = load()
            except Exception as error:  # noqa: BLE001
                broken = f"{type(error).__name__}: {error}"
        for texts in batches:
            rows = [(None, broken)] * len(texts) if broken else answers(run, [t or "" for t in texts]) if len(texts) else []
            yield pd.DataFrame(rows, columns=["vector", "failure"])

    text = F.col(column) if max_chars is None else F.substring(F.col(column), 1, max_chars)
    answered = df.withColumn("_answer", vectors(text)).withColumn(out, F.col("_answer.vector"))
    if failure:
        answered = answered.withColumn(failure, F.col("_answer.failure"))
    return answered.drop("_answer")


def embed_text(df: DataFrame, column: str, out: str = "embedding", *, dim: int = fv.EMBED_DIM,
               max_chars: int | None = None) -> DataFrame:
    """Unit-length hashed bag-of-words vector; null for texts without words.

    The offline default, over the whole text unless ``max_chars`` is given.  A model's vectors can
    take its place: join a table of them, or use :func:`embed_with`.
    """
    from pyspark.ml.feature import HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    text = F.col(column) if max_chars is None else F.substring(F.col(column), 1, max_chars)
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[^\w]+"), lambda w: w != "")
    tokens = df.withColumn("_words", words)
    counted = HashingTF(numFeatures=dim, inputCol="_words", outputCol="_tf").transform(tokens)
    unit = Normalizer(p=2.0, inputCol="_tf", outputCol="_unit").transform(counted)
    vector = F.when(F.size("_words") > 0, vector_to_array("_unit", "float32"))
    return unit.withColumn(out, vector).drop("_words", "_tf", "_unit")
