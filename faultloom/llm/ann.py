"""Approximate nearest neighbours by robust-pruned directed graphs.

Equal vectors are one point that knows its least ids.  Points are dealt over shards of bounded size.
Each shard builds a directed graph: points enter in batches, a greedy beam search from the centre
proposes neighbours, and relaxed pruning keeps a proposal only if no kept neighbour is closer to it
by the factor alpha, so edges stay diverse and some of them long.  Reverse edges are added and pruned
the same way.  Every query searches every shard with a beam; the best of all shards are ranked by
their exact cosine in double precision on the vectors as given.
"""

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import rows_of, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Points of one shard, about.
SHARD_POINTS = 16_384
#: Edges of a point, proposals while building, beam while searching, and the factor of relaxed pruning.
DEGREE = 32
PROPOSALS = 64
BEAM = 128
ALPHA = 1.2
#: Points that enter the graph together, and queries that search together.
BATCH = 256


def search(points: np.ndarray, edges: np.ndarray, entry: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Beam search for unit ``queries`` at once: (ids, distances) of the ``beam`` best found, nearest first; -1 where fewer."""
    count = len(queries)
    ids = np.full((count, beam), -1, np.int32)
    far = np.full((count, beam), np.inf, np.float32)
    open_ = np.zeros((count, beam), bool)
    seen = np.zeros((count, len(points)), bool)
    ids[:, 0], far[:, 0], open_[:, 0] = entry, 1 - queries @ points[entry], True
    seen[:, entry] = True
    active = np.arange(count)
    while len(active):
        nearest = np.where(open_[active], far[active], np.inf)
        pick = nearest.argmin(axis=1)
        live = np.isfinite(nearest[np.arange(len(active)), pick])
        active, pick = active[live], pick[live]
        if not len(active):
            break
        open_[active, pick] = False
        around = edges[ids[active, pick]]
        fresh = around >= 0
        fresh &= ~seen[active[:, None], np.maximum(around, 0)]
        row, col = np.nonzero(fresh)
        reached = around[row, col]
        seen[active[row], reached] = True
        new_far = np.full(around.shape, np.inf, np.float32)
        new_far[row, col] = 1 - np.einsum("ij,ij->i", points[reached], queries[active[row]])
        all_far = np.concatenate([far[active], new_far], axis=1)
        all_ids = np.concatenate([ids[active], np.where(fresh, around, -1)], axis=1)
        all_open = np.concatenate([open_[active], fresh], axis=1)
        order = np.argsort(all_far, axis=1, kind="stable")[:, :beam]
        far[active] = np.take_along_axis(all_far, order, axis=1)
        ids[active] = np.take_along_axis(all_ids, order, axis=1)
        open_[active] = np.take_along_axis(all_open, order, axis=1)
    return ids, far


def prune(points: np.ndarray, who: np.ndarray, ids: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Neighbours of ``who`` out of the proposals ``ids`` (-1 for none): nearest first, dropping what a kept one is closer to by ``alpha``."""
    ids = np.where(ids == who[:, None], -1, ids)
    ordered = np.sort(ids, axis=1)
    repeated = np.zeros(ids.shape, bool)
    repeated[:, 1:] = (ordered[:, 1:] == ordered[:, :-1]) & (ordered[:, 1:] >= 0)
    ids = np.where(repeated, -1, ordered)
    vectors = points[np.maximum(ids, 0)]
    far = np.where(ids >= 0, 1 - np.einsum("ijk,ik->ij", vectors, points[who]), np.inf)
    order = np.argsort(far, axis=1, kind="stable")
    ids, far = np.take_along_axis(ids, order, axis=1), np.take_along_axis(far, order, axis=1)
    vectors = np.take_along_axis(vectors, order[:, :, None], axis=1)
    between = 1 - np.matmul(vectors, vectors.transpose(0, 2, 1))
    alive = ids >= 0
    out = np.full((len(who), degree), -1, np.int32)
    rows = np.arange(len(who))
    for at in range(degree):
        first = alive.argmax(axis=1)
        some = alive[rows, first]
        if not some.any():
            break
        out[some, at] = ids[rows[some], first[some]]
        # 1 - cosine is half the squared distance of unit vectors, so alpha enters squared.
        alive &= ~(some[:, None] & (alpha * alpha * between[rows, first] <= far))
        alive[rows, first] = False
    return out


def build(points: np.ndarray, *, degree: int = DEGREE, proposals: int = PROPOSALS, alpha: float = ALPHA, seed: int = 3) -> tuple[np.ndarray, int]:
    """(edges, entry) of the graph over unit ``points``; edges is a matrix with -1 where a point has fewer."""
    count = len(points)
    edges = np.full((count, degree), -1, np.int32)
    entry = int(np.argmax(points @ points.mean(axis=0)))
    order = np.random.default_rng(seed).permutation(count)
    order = np.concatenate([[entry], order[order != entry]])
    done = 1
    while done < count:
        batch = order[done : done + min(BATCH, max(1, done))]
        ids, _ = search(points, edges, entry, points[batch], proposals)
        # Points that enter together do not find each other; the nearest of them are proposed too.
        few = min(len(batch) - 1, degree // 2)
        if few:
            alike = points[batch] @ points[batch].T
            np.fill_diagonal(alike, -np.inf)
            ids = np.concatenate([ids, batch[np.argsort(-alike, axis=1)[:, :few]].astype(np.int32)], axis=1)
        edges[batch] = prune(points, batch, ids, degree, alpha)
        _link_back(points, edges, batch, degree, alpha)
        done += len(batch)
    return edges, entry


def _link_back(points: np.ndarray, edges: np.ndarray, batch: np.ndarray, degree: int, alpha: float) -> None:
    """Add the reverse of the batch's edges; targets with too many are pruned over their nearest ones."""
    target = edges[batch].ravel()
    source = np.repeat(batch, degree)[target >= 0]
    target = target[target >= 0]
    have = (edges[target] == source[:, None]).any(axis=1)
    target, source = target[~have], source[~have]
    if not len(target):
        return
    nearness = np.einsum("ij,ij->i", points[target], points[source])
    order = np.lexsort((-nearness, target))
    target, source = target[order], source[order]
    distinct, first, number = np.unique(target, return_index=True, return_counts=True)
    rank = np.arange(len(target)) - np.repeat(first, number)
    kept = rank < 2 * degree
    incoming = np.full((len(distinct), min(int(number.max()), 2 * degree)), -1, np.int32)
    incoming[np.repeat(np.arange(len(distinct)), number)[kept], rank[kept]] = source[kept]
    full = (edges[distinct] >= 0).sum(axis=1) + number > degree
    for at in np.flatnonzero(~full):
        row = edges[distinct[at]]
        used = int((row >= 0).sum())
        new = incoming[at][incoming[at] >= 0]
        row[used : used + len(new)] = new
    crowded = np.flatnonzero(full)
    for at in range(0, len(crowded), BATCH):
        part = crowded[at : at + BATCH]
        who = distinct[part]
        edges[who] = prune(points, who, np.concatenate([edges[who], incoming[part]], axis=1), degree, alpha)


def _points(df: DataFrame, ident: str, vector: str, kept_ids: int) -> DataFrame:
    """(key, dim, ids, vec): distinct usable vectors with their least ``kept_ids`` ids.

    Copies are combined in every batch before they meet, so a vector that many rows share sends a few
    ids per batch.
    """
    kind = df.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            groups: dict[bytes, list] = {}
            for number, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not values or any(v is None for v in values):
                    continue
                array = np.array(values, np.float64)
                if np.isfinite(array).all() and array.any():
                    groups.setdefault((array + 0.0).tobytes(), []).append(number)
            yield {
                "key": [xxhash.xxh3_128_digest(b) for b in groups],
                "dim": [len(b) // 8 for b in groups],
                "ids": [sorted(set(n))[:kept_ids] for n in groups.values()],
                "vec": list(groups),
            }

    rows = df.filter(F.col(ident).isNotNull() & F.col(vector).isNotNull()).select(ident, vector)
    found = written(rows_of(rows, f"key binary, dim int, ids array<{kind}>, vec binary", run), "vectors")
    merged = found.groupBy("key").agg(
        F.min("dim").alias("dim"), F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, kept_ids).alias("ids")
    )
    one = found.groupBy("key").agg(F.min("vec").alias("vec"))
    return merged.join(one, "key")


def _unit(vectors: np.ndarray) -> np.ndarray:
    # Scale first: squares of very large or very small components would overflow or vanish.
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def index(points: DataFrame, id_type: str, *, shard_points: int = SHARD_POINTS) -> DataFrame:
    """One row per shard: dim, shard, ids, vectors, edges, entry.  Every point is in one shard."""
    sizes = points.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / F.lit(shard_points)).cast("int").alias("shards"))
    dealt = points.join(sizes, "dim").withColumn("shard", F.pmod(F.xxhash64("key"), F.col("shards")).cast("int"))
    ordered = (
        dealt.select("dim", "shard", "shards", "key", "ids", "vec")
        .repartition("dim", "shard")
        .sortWithinPartitions("dim", "shard", "key")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        current, ids, vecs = None, [], []

        def finish() -> dict:
            vectors = np.frombuffer(b"".join(vecs), np.float64).reshape(len(vecs), -1)
            edges, entry = build(_unit(vectors).astype(np.float32))
            out = {
                "dim": [current[0]], "shard": [current[1]], "shards": [current[2]], "ids": [ids],
                "vectors": [vectors.tobytes()], "edges": [edges.tobytes()], "entry": [entry],
            }
            return out

        for batch in batches:
            for dim, shard, shards, _, own, vec in zip(*(c.to_pylist() for c in batch.columns)):
                if (dim, shard, shards) != current:
                    if ids:
                        yield finish()
                    current, ids, vecs = (dim, shard, shards), [], []
                ids.append(own)
                vecs.append(vec)
        if ids:
            yield finish()

    schema = f"dim int, shard int, shards int, ids array<array<{id_type}>>, vectors binary, edges binary, entry int"
    return written(rows_of(ordered, schema, run), "index")


class Shard:
    """A shard's graph, loaded for searching."""

    def __init__(self, ids: list, vectors: bytes, edges: bytes, entry: int):
        self.ids = ids
        self.vectors = np.frombuffer(vectors, np.float64).reshape(len(ids), -1)
        self.unit = _unit(self.vectors)
        self.points = self.unit.astype(np.float32)
        self.edges = np.frombuffer(edges, np.int32).reshape(len(ids), -1)
        self.entry = entry

    def best(self, queries: list[tuple], k: int, beam: int) -> list[tuple]:
        """(query, vec_id, score) for each query's ``k`` best ids in this shard, by exact cosine, ties to the smaller id."""
        unit = _unit(np.stack([np.frombuffer(v, np.float64) for _, v in queries]))
        found, _ = search(self.points, self.edges, self.entry, unit.astype(np.float32), max(beam, k + 1))
        out = []
        for (query, _), vector, near in zip(queries, unit, found):
            near = near[near >= 0]
            # Rows are multiplied and summed alike, so equal vectors have equal scores.
            scores = (self.unit[near] * vector).sum(axis=1)
            order = np.argsort(-scores, kind="stable")
            cut = scores[order[min(2 * k, len(order)) - 1]]
            ranked = sorted((-s, i) for s, n in zip(scores[scores >= cut], near[scores >= cut]) for i in self.ids[n] if i != query)
            out += [(query, i, min(1.0, -s)) for s, i in ranked[:k]]
        return out


def nearest(df: DataFrame, queries: DataFrame, *, k: int = 5, ident: str = "vec_id", vector: str = "embedding", beam: int = BEAM, shard_points: int = SHARD_POINTS) -> DataFrame:
    """The ``k`` nearest rows of ``df`` by cosine for every row of ``queries`` (both with ``ident`` and ``vector``).

    Result: query_id, rank (from 1), vec_id, score; nearest first, ties to the smaller id.  A query's
    own id is no candidate.  Null ids and vectors that are null, empty, zero or hold null or non-finite
    components take no part; vectors of different lengths are never compared.  Repeated rows are one
    candidate; of a query id with several vectors the one of least hash asks.  An empty table gives an
    empty result; other columns are ignored.
    """
    kind = df.schema[ident].dataType.simpleString()
    points = written(_points(df, ident, vector, k + 1), "points")
    graph = index(points, kind, shard_points=shard_points)
    asked = _points(queries, ident, vector, 1 << 30).select("key", "dim", F.explode("ids").alias("query"), "vec")
    first = asked.groupBy("query").agg(F.min("key").alias("key"))
    asked = asked.join(first, ["query", "key"])
    shards = graph.select("dim", "shard")
    empty = F.lit(None)
    rows = graph.select(
        "dim", "shard", F.lit(0).alias("role"), empty.cast(kind).alias("query"), "vectors", "ids", "edges", "entry"
    ).unionByName(
        asked.join(shards, "dim").select(
            "dim", "shard", F.lit(1).alias("role"), "query", F.col("vec").alias("vectors"),
            empty.cast(f"array<array<{kind}>>").alias("ids"), empty.cast("binary").alias("edges"), empty.cast("int").alias("entry"),
        )
    )
    ordered = rows.repartition("dim", "shard").sortWithinPartitions("dim", "shard", "role", "query")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        shard, waiting = None, []

        def answer() -> dict:
            rows = shard.best(waiting, k, beam) if waiting else []
            waiting.clear()
            return dict(zip(("query_id", "vec_id", "score"), zip(*rows) if rows else [[], [], []]))

        for batch in batches:
            cols = [batch.column(n) for n in ("role", "query", "vectors", "ids", "edges", "entry")]
            for i in range(batch.num_rows):
                role, query, vectors = (c[i].as_py() for c in cols[:3])
                if role == 0:
                    if waiting:
                        yield answer()
                    shard = Shard(cols[3][i].as_py(), vectors, cols[4][i].as_py(), cols[5][i].as_py())
                    continue
                waiting.append((query, vectors))
                if len(waiting) >= BATCH:
                    yield answer()
        if waiting:
            yield answer()

    found = rows_of(ordered, f"query_id {kind}, vec_id {kind}, score double", run)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return (
        found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        .withColumn("rank", rank)
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
