"""Near-duplicate embeddings by dual traversal of cover trees.

Rows with one label and one vector are one point that knows how many they are.  The upper levels of a
label's tree are built by Spark: a cell with more points than a block holds picks leaders among its
points (the least hash of each of up to 64 buckets), and every point goes to the nearest one.  The lower
levels are built inside a block: from level to level the radius halves, the centre of a node is also the
centre of its first child, and a point that no centre reaches becomes one itself.  Every node
knows its covering radius, the distance to the farthest point below it.

Two nodes whose centres are farther apart than the threshold and both radii hold no link; they are
pruned.  Where even the farthest points are near enough, all pairs are links and are counted at once.
Between cells this runs as joins, one level at a time; between blocks it runs in tasks, down to pairs
of points, which are decided by their cosine.  Tasks return counts of links and a spanning forest of
them, never the pairs.
"""

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import rows_of, written
from .graphs import components

cloudpickle.register_pickle_by_value(sys.modules[__name__])

THRESHOLD = 0.98
#: Bytes of the vectors of one block, and its points at least.
BLOCK_BYTES = 2 << 20
BLOCK_POINTS = 64
#: Leaders of a cell at most, rounds of splitting at most, and points that share one copy of the leaders.
LEADERS = 64
ROUNDS = 24
ROUTED = 65_536
#: Visiting blocks that one task takes for a block.
VISITORS = 64
#: Points below which a node is not split, radius from which on it is not, and the slack of every bound
#: (distances of near points come out of cosines, whose last digits are rounded).
LEAF = 32
TINY = 1e-6
SLACK = 1e-6
#: Rows of one distance matrix.
TILE = 1024


def unit(vectors: np.ndarray) -> np.ndarray:
    # Scale first: squares of very large or very small components would overflow or vanish.
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between unit vectors."""
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def net(points: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(centre of each point, distance to it, centres): no point is farther than ``limit``, no two centres are nearer; point 0 is the first."""
    far = gaps(points, points[:1])[:, 0]
    which = np.zeros(len(points), np.int64)
    far[0] = 0
    centres = [0]
    while True:
        open_ = np.flatnonzero(far > limit)[:128]
        if not len(open_):
            return which, far, centres
        between = gaps(points[open_], points[open_])
        free = np.ones(len(open_), bool)
        chosen = []
        for i in range(len(open_)):
            if free[i]:
                chosen.append(i)
                free &= between[i] > limit
        new = open_[chosen]
        found = gaps(points, points[new])
        near = found.argmin(axis=1)
        reach = found[np.arange(len(points)), near]
        better = reach < far
        which[better], far[better] = len(centres) + near[better], reach[better]
        which[new], far[new] = len(centres) + np.arange(len(new)), 0
        centres += new.tolist()


def build(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, nodes, radii) of the cover tree: a node is (start, end, first child, children) over the ordered points, its centre comes first."""
    order = np.arange(len(points))
    middle = int(np.argmax(points @ points.mean(axis=0)))
    order[[0, middle]] = order[[middle, 0]]
    nodes = [[0, len(points), 0, 0]]
    radii = [float(gaps(points, points[middle : middle + 1]).max())]
    at = 0
    while at < len(nodes):
        start, end = nodes[at][:2]
        if end - start > LEAF and radii[at] > TINY:
            own = order[start:end]
            # The levels are powers of two; the children of a node are at the next one below its radius.
            which, far, centres = net(points[own], 2.0 ** (math.ceil(math.log2(radii[at])) - 1))
            later = np.ones(len(own), bool)
            later[centres] = False
            order[start:end] = own[np.lexsort((later, which))]
            size = np.bincount(which, minlength=len(centres))
            reach = np.zeros(len(centres))
            np.maximum.at(reach, which, far)
            ends = start + np.cumsum(size)
            nodes[at][2:] = [len(nodes), len(centres)]
            nodes += [[int(e - s), int(e), 0, 0] for e, s in zip(ends, size)]
            radii += reach.tolist()
        at += 1
    return order, np.array(nodes, np.int32), np.array(radii)


class Forest:
    """Which of a number of points are connected."""

    def __init__(self, count: int):
        self.root = np.arange(count)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            ra, rb = self.root[a], self.root[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


class Tree:
    """A block's tree with the weights (rows) of its points."""

    def __init__(self, keys: bytes, weights: bytes, vectors: bytes, nodes: bytes, radii: bytes):
        self.keys = [keys[i : i + 16] for i in range(0, len(keys), 16)]
        self.weights = np.frombuffer(weights, np.int64)
        self.points = np.frombuffer(vectors, np.float64).reshape(len(self.keys), -1)
        self.nodes = np.frombuffer(nodes, np.int32).reshape(-1, 4).astype(np.int64)
        self.radii = np.frombuffer(radii, np.float64)
        self.before = np.concatenate([[0], np.cumsum(self.weights)])

    def below(self, node: int) -> np.ndarray:
        """The children of a node, or the node if it is a leaf."""
        first, count = self.nodes[node, 2:]
        return np.arange(first, first + count) if count else np.array([node])


def links(a: Tree, b: Tree, threshold: float) -> tuple[np.ndarray, np.ndarray, Forest]:
    """Rows linked to each point of ``a`` out of ``b`` and the other way round, and what is connected (points of ``b`` after those of ``a``).

    ``a`` and ``b`` may be one tree; then each pair counts once for both its points.
    """
    same = a is b
    shift = 0 if same else len(a.keys)
    limit = math.sqrt(max(0.0, 2 - 2 * threshold))
    to_a = np.zeros(len(a.keys), np.int64)
    to_b = to_a if same else np.zeros(len(b.keys), np.int64)
    forest = Forest(len(a.keys) + (0 if same else len(b.keys)))

    def points(x: np.ndarray, y: np.ndarray) -> None:
        np.add.at(to_a, x, b.weights[y])
        np.add.at(to_b, y, a.weights[x])
        forest.join(x, y + shift)

    def whole(x: int, y: int) -> None:
        (s, e), (t, u) = a.nodes[x, :2], b.nodes[y, :2]
        to_a[s:e] += b.before[u] - b.before[t]
        to_b[t:u] += a.before[e] - a.before[s]
        forest.join(np.arange(s, e), np.full(e - s, t + shift))
        forest.join(np.arange(t, u) + shift, np.full(u - t, s))

    def inside(x: int) -> None:
        s, e = a.nodes[x, :2]
        to_a[s:e] += a.before[e] - a.before[s] - a.weights[s:e]
        forest.join(np.arange(s, e), np.full(e - s, s))

    def compare(s: int, e: int, t: int, u: int, own: bool) -> None:
        for at in range(s, e, TILE):
            near = a.points[at : min(e, at + TILE)] @ b.points[t:u].T >= threshold
            if own:
                near &= np.arange(at, at + len(near))[:, None] < np.arange(t, u)[None]
            i, j = np.nonzero(near)
            points(at + i, t + j)

    waiting = [(0, 0)]
    while waiting:
        x, y = waiting.pop()
        own = same and x == y
        if own and 2 * a.radii[x] < limit - SLACK:
            inside(x)
            continue
        if not a.nodes[x, 3] and not b.nodes[y, 3]:
            compare(*a.nodes[x, :2], *b.nodes[y, :2], own)
            continue
        left, right = a.below(x), b.below(y)
        if own:
            waiting += [(c, c) for c in left[a.nodes[left, 1] - a.nodes[left, 0] > 1].tolist()]
        heads = b.points[b.nodes[right, 0]]
        for at in range(0, len(left), TILE):
            part = left[at : at + TILE]
            cosine = a.points[a.nodes[part, 0]] @ heads.T
            reach = a.radii[part][:, None] + b.radii[right][None]
            gap = np.sqrt(np.maximum(2 - 2 * cosine, 0))
            near = gap <= limit + reach + SLACK
            if own:
                near &= part[:, None] < right[None]
            i, j = np.nonzero(near)
            m, n = part[i], right[j]
            single = (a.nodes[m, 1] - a.nodes[m, 0] == 1) & (b.nodes[n, 1] - b.nodes[n, 0] == 1)
            linked = single & (cosine[i, j] >= threshold)
            points(a.nodes[m[linked], 0], b.nodes[n[linked], 0])
            all_ = ~single & (gap[i, j] + reach[i, j] < limit - SLACK)
            for c, d in zip(m[all_].tolist(), n[all_].tolist()):
                whole(c, d)
            rest = ~single & ~all_
            waiting += zip(m[rest].tolist(), n[rest].tolist())
    return to_a, to_b, forest


def _rows(df: DataFrame, ident: str, label: str, vector: str) -> DataFrame:
    """(ident, cell, key, dim, vec) of all rows; the last four are null for rows that link with nothing.

    ``cell`` stands for the label and the number of components, ``key`` for these and the direction.
    """
    kind = df.schema[ident].dataType.simpleString()
    cell = F.unhex(F.md5(F.concat_ws("|", F.size(vector).cast("string"), F.col(label).cast("string"))))
    usable = F.col(ident).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull()
    rows = df.select(F.col(ident).alias("ident"), F.when(usable, cell).alias("cell"), F.when(usable, F.col(vector)).alias("vec"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            cells, keys, dims, vecs = [], [], [], []
            for own, values in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                array = np.array(values, np.float64) if values and not any(v is None for v in values) else np.zeros(0)
                if not array.any() or not np.isfinite(array).all():
                    own, key, dim, vec = None, None, None, None
                else:
                    vec, dim = (unit(array[None])[0] + 0.0).tobytes(), len(array)
                    key = xxhash.xxh3_128_digest(own + vec)
                for out, value in zip((cells, keys, dims, vecs), (own, key, dim, vec)):
                    out.append(value)
            yield {"ident": batch.column(0), "cell": cells, "key": keys, "dim": dims, "vec": vecs}

    return written(rows_of(rows, f"ident {kind}, cell binary, key binary, dim int, vec binary", run), "vectors")


def _points(rows: DataFrame) -> DataFrame:
    """(cell, parent, key, dim, weight, vec, far) of the distinct vectors; ``weight`` counts their different ids."""
    used = rows.filter(F.col("key").isNotNull())
    weights = used.select("key", "ident").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("weight"))
    vectors = used.groupBy("key").agg(F.min(F.struct("cell", "dim", "vec")).alias("v"))
    found = vectors.join(weights, "key")
    return written(
        found.select("v.cell", F.col("v.cell").alias("parent"), "key", "v.dim", "weight", "v.vec", F.lit(0.0).alias("far")), "points"
    )


def _route(points: DataFrame, leaders: DataFrame, salts: int) -> DataFrame:
    """Points of split cells moved to the cell of the nearest leader; the others stay where they are."""
    none = F.lit(None)
    head = leaders.select(
        "cell", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("role"), F.col("cells").alias("key"),
        none.cast("int").alias("dim"), none.cast("long").alias("weight"), F.col("vecs").alias("vec"), none.cast("double").alias("far"),
    )
    body = points.select("cell", F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("role"), "key", "dim", "weight", "vec", "far")
    ordered = head.unionByName(body).repartition("cell", "salt").sortWithinPartitions("cell", "salt", "role", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        own, cells, lead = None, [], None
        for batch in batches:
            columns = {c: batch.column(c).to_pylist() for c in ("cell", "role", "key", "dim", "weight", "vec", "far")}
            out = {c: [] for c in ("cell", "parent", "key", "dim", "weight", "vec", "far")}
            at, count = 0, batch.num_rows
            while at < count:
                cell = columns["cell"][at]
                if columns["role"][at] == 0:
                    packed = columns["key"][at]
                    own, cells = cell, [packed[i : i + 16] for i in range(0, len(packed), 16)]
                    lead = np.frombuffer(columns["vec"][at], np.float64).reshape(len(cells), -1)
                    at += 1
                    continue
                end = at
                while end < count and columns["cell"][end] == cell and columns["role"][end] == 1:
                    end += 1
                for c in ("key", "dim", "weight", "vec"):
                    out[c] += columns[c][at:end]
                out["parent"] += [cell] * (end - at)
                if cell == own:
                    cosine = np.frombuffer(b"".join(columns["vec"][at:end]), np.float64).reshape(end - at, -1) @ lead.T
                    best = cosine.argmax(axis=1)
                    out["cell"] += [cells[b] for b in best]
                    out["far"] += np.sqrt(np.maximum(2 - 2 * cosine[np.arange(end - at), best], 0)).tolist()
                else:
                    out["cell"] += [cell] * (end - at)
                    out["far"] += columns["far"][at:end]
                at = end
            yield out

    return written(rows_of(ordered, "cell binary, parent binary, key binary, dim int, weight long, vec binary, far double", run), "routed")


def _arrays(df: DataFrame) -> DataFrame:
    """(cell, parent, centre) with the centre as an array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            yield {
                "cell": batch.column("cell"), "parent": batch.column("parent"),
                "centre": [np.frombuffer(v, np.float64).tolist() for v in batch.column("vec").to_pylist()],
            }

    return rows_of(df.select("cell", "parent", "vec"), "cell binary, parent binary, centre array<double>", run)


def _cells(points: DataFrame, block_bytes: int, limit: float) -> tuple[DataFrame, DataFrame]:
    """(points in cells of block size, pairs of cells (a, b) that may hold links, each with itself included)."""
    spark = points.sparkSession
    room = F.greatest(F.lit(BLOCK_POINTS), F.floor(F.lit(block_bytes) / (8 * F.col("dim"))))
    centres = spark.createDataFrame([], "cell binary, centre array<double>")
    pairs = None
    for at in range(ROUNDS + 1):
        hashed = F.xxhash64("key", F.lit(at))
        grouped = points.groupBy("cell", F.pmod(hashed, F.lit(LEADERS)).cast("int").alias("bucket")).agg(
            F.count(F.lit(1)).alias("n"), F.max("far").alias("far"), F.min(F.struct(hashed.alias("h"), "key", "dim", "vec")).alias("first")
        )
        stats = written(grouped.select("cell", "bucket", "n", "far", "first.key", "first.dim", "first.vec"), "leaders")
        sizes = stats.groupBy("cell").agg(F.sum("n").alias("n"), F.max("far").alias("radius"), F.max("dim").alias("dim"))
        if pairs is None:
            pairs = sizes.select(F.col("cell").alias("a"), F.col("cell").alias("b"))
        else:
            pairs = written(_near(pairs, family, sizes, centres, limit), "pairs")  # noqa: F821  set by the round before
        big = sizes.filter(F.col("n") > room).withColumn("leaders", F.least(F.lit(LEADERS), 2 * F.ceil(F.col("n") / room)))
        most = big.agg(F.max("n")).first()[0]
        if most is None or at == ROUNDS:
            break
        # Buckets may be empty in small cells, so leaders are the first of those there are.
        nth = F.row_number().over(Window.partitionBy("cell").orderBy("bucket"))
        picked = stats.select("cell", "bucket", "key", "vec").join(big.select("cell", "leaders"), "cell").withColumn("nth", nth)
        picked = picked.filter("nth <= leaders").select(
            F.col("cell").alias("parent"), "nth", F.unhex(F.md5(F.concat("cell", "key"))).alias("cell"), "vec"
        )
        picked = written(picked, "picked")
        heads = _packed(picked)
        points = _route(points, heads, max(1, math.ceil(most / ROUTED)))
        family = points.select("parent", "cell").distinct()
        centres = written(_arrays(picked).select("cell", "centre").unionByName(centres), "centres")
    return points, pairs


def _packed(picked: DataFrame) -> DataFrame:
    """One row per split cell: (cell, cells, vecs), the ids and vectors of its leaders one after the other."""
    listed = picked.groupBy("parent").agg(F.array_sort(F.collect_list(F.struct("nth", "cell", "vec"))).alias("l"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            rows = batch.column("l").to_pylist()
            yield {
                "cell": batch.column("parent"), "cells": [b"".join(x["cell"] for x in r) for r in rows],
                "vecs": [b"".join(x["vec"] for x in r) for r in rows],
            }

    return rows_of(listed, "cell binary, cells binary, vecs binary", run)


def _near(pairs: DataFrame, family: DataFrame, sizes: DataFrame, centres: DataFrame, limit: float) -> DataFrame:
    """Pairs one level further down: children of near cells whose centres are not too far apart for both radii."""
    child = family.join(sizes.select("cell", "radius"), "cell").join(centres, "cell", "left")

    def side(name: str) -> DataFrame:
        return child.select(*[F.col(c).alias(f"{name}_{c}") for c in ("parent", "cell", "radius", "centre")])

    both = pairs.join(side("x"), F.col("a") == F.col("x_parent")).join(side("y"), F.col("b") == F.col("y_parent"))
    squares = F.aggregate(F.zip_with("x_centre", "y_centre", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)
    far = F.sqrt(squares) > F.col("x_radius") + F.col("y_radius") + F.lit(limit + SLACK)
    same = F.col("x_cell") == F.col("y_cell")
    once = (F.col("a") != F.col("b")) | (F.col("x_cell") <= F.col("y_cell"))
    return both.filter(once & (same | ~F.coalesce(far, F.lit(False)))).select(F.col("x_cell").alias("a"), F.col("y_cell").alias("b"))


def _blocks(points: DataFrame, block_bytes: int) -> DataFrame:
    """One row per block: its cell, its number there, and its tree.  A cell is one block unless splitting gave up on it."""
    ordered = points.select("cell", "key", "dim", "weight", "vec").repartition("cell").sortWithinPartitions("cell", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        cell, number, size, rows = None, 0, 0, []

        def finish() -> dict:
            vectors = np.frombuffer(b"".join(r[2] for r in rows), np.float64).reshape(len(rows), -1)
            order, nodes, radii = build(vectors)
            return {
                "cell": [cell], "block": [number], "keys": [b"".join(rows[i][0] for i in order)],
                "weights": [np.array([rows[i][1] for i in order], np.int64).tobytes()],
                "vectors": [vectors[order].tobytes()], "nodes": [nodes.tobytes()], "radii": [radii.tobytes()],
            }

        for batch in batches:
            for own, key, dim, weight, vec in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and (own != cell or size >= max(block_bytes, 8 * dim * BLOCK_POINTS)):
                    yield finish()
                    number, size, rows = number + 1 if own == cell else 0, 0, []
                cell = own
                rows.append((key, weight, vec))
                size += len(vec)
        if rows:
            yield finish()

    schema = "cell binary, block int, keys binary, weights binary, vectors binary, nodes binary, radii binary"
    return written(rows_of(ordered, schema, run), "trees")


def _traversals(blocks: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """(key, other, links): per point the rows it is linked to (other null), and connecting edges (links null)."""
    tree = ["keys", "weights", "vectors", "nodes", "radii"]
    names = blocks.select("cell", "block")
    left = names.select(F.col("cell").alias("a"), F.col("block").alias("m"))
    right = names.select(F.col("cell").alias("b"), F.col("block").alias("n"))
    visits = pairs.join(left, "a").join(right, "b").filter((F.col("a") != F.col("b")) | (F.col("m") < F.col("n")))
    nth = F.row_number().over(Window.partitionBy("a", "m").orderBy("b", "n"))
    visits = written(visits.withColumn("slice", F.floor((nth - 1) / VISITORS).cast("int")), "visits")
    # Slice 0 is there for every block, for the pairs inside it.
    hosts = visits.select("a", "m", "slice").distinct().unionByName(left.withColumn("slice", F.lit(0))).distinct()
    own = hosts.join(blocks.withColumnsRenamed({"cell": "a", "block": "m"}), ["a", "m"]).withColumn("role", F.lit(0))
    come = visits.join(blocks.withColumnsRenamed({"cell": "b", "block": "n"}), ["b", "n"]).withColumn("role", F.lit(1))
    columns = ["a", "m", "slice", "role", *tree]
    ordered = own.select(columns).unionByName(come.select(columns)).repartition("a", "m", "slice").sortWithinPartitions("a", "m", "slice", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        host = None
        for batch in batches:
            for i in range(batch.num_rows):
                part, role, *packed = (batch.column(c)[i].as_py() for c in ("slice", "role", *tree))
                guest = Tree(*packed)
                if role == 0:
                    host = guest
                    if part:
                        continue
                to_a, to_b, forest = links(host, guest, threshold)
                keys = host.keys if guest is host else host.keys + guest.keys
                counts = to_a if guest is host else np.concatenate([to_a, to_b])
                some, hung = np.flatnonzero(counts), np.flatnonzero(forest.root != np.arange(len(keys)))
                yield {
                    "key": [keys[k] for k in some] + [keys[k] for k in hung],
                    "other": [None] * len(some) + [keys[forest.root[k]] for k in hung],
                    "links": counts[some].tolist() + [None] * len(hung),
                }

    return written(rows_of(ordered, "key binary, other binary, links long", run), "links")


def near_duplicates(
    df: DataFrame, *, threshold: float = THRESHOLD, ident: str = "vec_id", label: str = "label", vector: str = "embedding",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Links between vectors of one label with a cosine of ``threshold`` or more: ident, n_links, component_id, kept.

    One row per row of ``df``.  ``n_links`` counts the different ids of all vectors linked to the row's, itself
    left out; ``component_id`` is the smallest id that links lead to, the row's own included; ``kept`` says that this is
    the row's own.  Rows with a null id or label, or whose vector is null, empty, zero or holds null or
    non-finite components, link with nothing (their component is their own id), and vectors of different
    lengths never do.  Repeated rows are one vector with several result rows; rows of one id with different
    vectors or labels are told apart.  An empty table gives an empty result; other columns are ignored.
    """
    rows = _rows(df, ident, label, vector)
    points, pairs = _cells(_points(rows), block_bytes, math.sqrt(max(0.0, 2 - 2 * threshold)))
    found = _traversals(_blocks(points, block_bytes), pairs, threshold)
    counts = found.filter(F.col("other").isNull()).groupBy("key").agg(F.sum("links").alias("links"))
    joined = components(found.filter(F.col("other").isNotNull()), "key", "other").select(F.col("node").alias("key"), "label")
    ids = rows.filter(F.col("key").isNotNull()).select("key", "ident").distinct()
    classes = ids.groupBy("key").agg(F.count(F.lit(1)).alias("weight"), F.min("ident").alias("least"))
    classes = written(classes.join(joined, "key", "left").withColumn("label", F.coalesce("label", "key")), "classes")
    least = classes.groupBy("label").agg(F.min("least").alias("component"))
    result = classes.join(least, "label").join(counts, "key", "left").select(
        "key", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component"
    )
    component = F.coalesce("component", "ident")
    return rows.select("ident", "key").join(result, "key", "left").select(
        F.col("ident").alias(ident), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("ident").eqNullSafe(component).alias("kept"),
    )


def oracle(threshold: float = THRESHOLD) -> str:
    """DuckDB SQL of ``op13``: all pairs of a label, then the smallest id over links until nothing changes."""
    return f"""
WITH RECURSIVE usable AS MATERIALIZED (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
linked AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= {threshold}),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT reach.a, linked.b FROM reach JOIN linked ON reach.b = linked.a),
least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY 1),
counts AS (SELECT a AS vec_id, count(*) AS n_links FROM linked GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least USING (vec_id) LEFT JOIN counts USING (vec_id)"""
