"""An index for approximate nearest neighbours by cosine: coarse cells, residuals in product codes, exact re-ranking.

A bounded sample gives the centres of the cells and the codebooks; every vector is then indexed.  The
rows are packed into blocks of one cell and group and stored in a folder per cell, codes and vectors in
columns of their own.  A search reads the codes of the cells nearest to each query, keeps the best
candidates by decoded similarity, and reads vectors only of the blocks these are in, to rank the
candidates exactly.  Queries are packed too, and a candidate is a place in a pack and a place in a block:
vectors travel once per pack that wants them, not once per candidate.
"""

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed_values as fv
from .retrieval import _stored

# Send the functions of this module with the job: executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: The sample that centres and codebooks are learned from: rows and bytes at most.
SAMPLE_ROWS = 16_384
SAMPLE_BYTES = 32 << 20
#: Cells at most (there are about as many as the root of the rows), components of one code, entries of a codebook, rounds of learning.
MOST_CELLS = 4096
PART = 4
ENTRIES = 256
ROUNDS = 8
#: Rows of one block, queries that travel together, and digits to which similarities are rounded so that ties are ties.
BLOCK_ROWS = 4096
QUERY_ROWS = 1024
DIGITS = 12
#: Blocks that visit one pack of queries in a task; packs that ask one block together; rows that are scored at once; bytes of vectors that leave a task at once.
SLICE_VISITS = 4096
BLOCK_VISITS = 16
SCORE_ROWS = 1024
SENT_BYTES = 4 << 20


def _unit(matrix: np.ndarray) -> np.ndarray:
    scaled = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def centres_of(points: np.ndarray, count: int, rounds: int = ROUNDS, seed: int = 1) -> np.ndarray:
    """Centres by k-means; an empty one moves to the point that is farthest from its own."""
    rng = np.random.default_rng(seed)
    centres = points[rng.permutation(len(points))[:count]].copy()
    for _ in range(rounds):
        far = (points * points).sum(axis=1)[:, None] - 2 * points @ centres.T + (centres * centres).sum(axis=1)[None]
        near = far.argmin(axis=1)
        size = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        centres = sums / np.maximum(size, 1)[:, None]
        empty = np.flatnonzero(size == 0)
        lost = np.argsort(-far[np.arange(len(points)), near])[: len(empty)]
        centres[empty[: len(lost)]] = points[lost]
    return centres


def nearest_of(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1)[None] - 2 * points @ centres.T).argmin(axis=1)


@dataclass
class VectorIndex:
    """Where the blocks are, the cells' centres and one codebook per part of the residuals."""

    folder: str
    centres: np.ndarray
    books: list[np.ndarray]

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/blocks")


def _parts(dim: int) -> list[slice]:
    return [slice(at, min(at + PART, dim)) for at in range(0, dim, PART)]


def _usable(vector: str) -> Column:
    v = F.col(vector)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return v.isNotNull() & F.forall(v, finite) & F.exists(v, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    return _unit(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1))


def build(
    corpus: DataFrame, folder: str, *, group: str, ident: str, vector: str = "embedding", cells: int | None = None,
    sample_rows: int = SAMPLE_ROWS, block_rows: int = BLOCK_ROWS,
) -> VectorIndex:
    """Index all rows of ``corpus`` in ``folder``.  Vectors have one length; null, zero and non-finite ones are left out."""
    rows = corpus.filter(F.col(ident).isNotNull() & _usable(vector)).select(F.col(group).alias("grp"), F.col(ident).alias("id"), F.col(vector).alias("vec"))
    count = rows.count()
    first = rows.select(F.size("vec")).first()
    dim = first[0] if first else 1
    few = max(1, min(sample_rows, SAMPLE_BYTES // (8 * dim)))
    sample = [r["vec"] for r in rows.orderBy(F.xxhash64("id"), "id").select("vec").limit(few).collect()]
    points = _unit(np.array(sample, np.float64).reshape(-1, dim)) if sample else np.eye(1, dim)
    cells = max(1, min(MOST_CELLS, round(count**0.5), len(points))) if cells is None else min(cells, len(points))
    centres = centres_of(points, cells)
    residuals = points - centres[nearest_of(points, centres)]
    books = [centres_of(residuals[:, p], min(ENTRIES, len(points)), seed=2) for p in _parts(dim)]
    kinds = rows.schema
    plain = VectorIndex(folder, centres, books)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _matrix(batch.column("vec"))
            cell = nearest_of(unit, centres)
            rest = unit - centres[cell]
            codes = np.stack([nearest_of(rest[:, p], b) for p, b in zip(_parts(dim), books)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [batch.column("grp"), batch.column("id"), pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()),
                 pa.array([v.tobytes() for v in unit], pa.binary())],
                names=["grp", "id", "cell", "code", "vec"],
            )

    coded = rows.mapInArrow(code, T.StructType([kinds["grp"], kinds["id"], *T._parse_datatype_string("cell int, code binary, vec binary").fields]))
    # The hash lets a crowded cell go to several ranges.
    order = ["cell", "grp", F.xxhash64("id")]
    ordered = coded.repartitionByRange(*order).sortWithinPartitions(*order, "id")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, begun, part = None, [], None, 0

        def finish() -> pa.RecordBatch:
            nonlocal begun, part
            ids, codes, vecs = zip(*held)
            # Blocks full of rows of one id begin alike.
            part = part + 1 if begun == (*current, ids[0]) else 0
            begun = (*current, ids[0])
            return pa.RecordBatch.from_arrays(
                [pa.array([part]), pa.array([current[0]], pa.int32()), pa.array([current[1]], schema.field("grp").type), pa.array([list(ids)], schema.field("ids").type),
                 pa.array([b"".join(codes)]), pa.array([b"".join(vecs)])],
                schema=schema,
            )

        for batch in batches:
            for grp, ident, cell, code, vec in zip(*(c.to_pylist() for c in batch.columns)):
                if held and ((cell, grp) != current or len(held) == block_rows):
                    yield finish()
                    held = []
                current = (cell, grp)
                held.append((ident, code, vec))
        if held:
            yield finish()

    from pyspark.sql.pandas.types import to_arrow_schema

    packed = T.StructType(
        [T.StructField("part", T.LongType()), T.StructField("cell", T.IntegerType()), kinds["grp"], T.StructField("ids", T.ArrayType(kinds["id"].dataType)),
         T.StructField("codes", T.BinaryType()), T.StructField("vecs", T.BinaryType())]
    )
    schema = to_arrow_schema(packed)
    blocks = ordered.mapInArrow(pack, packed).withColumn("block", F.xxhash64("grp", "cell", F.get("ids", F.lit(0))).bitwiseXOR(F.col("part")))
    blocks.drop("part").write.partitionBy("cell").parquet(f"{folder}/blocks")
    model = [(dim, centres.tobytes(), [b.tobytes() for b in books])]
    corpus.sparkSession.createDataFrame(model, "dim int, centres binary, books array<binary>").coalesce(1).write.parquet(f"{folder}/model")
    return plain


def load(spark: SparkSession, folder: str) -> VectorIndex:
    """The index that ``build`` wrote to ``folder``."""
    row = spark.read.parquet(f"{folder}/model").first()
    books = [np.frombuffer(b, np.float64).reshape(-1, p.stop - p.start) for b, p in zip(row["books"], _parts(row["dim"]))]
    return VectorIndex(folder, np.frombuffer(row["centres"], np.float64).reshape(-1, row["dim"]), books)


def _asks(unit: np.ndarray, centres: np.ndarray, probes: int) -> np.ndarray:
    """For every query the cells that it asks, nearest first."""
    return np.argsort(-(unit @ centres.T), axis=1, kind="stable")[:, :probes]


def _packs(queries: DataFrame, index: VectorIndex, probes: int) -> DataFrame:
    """(pack, grp, qids, qvecs, cells): queries of a group packed in the order of their nearest cells, with all cells that a pack asks."""
    centres, kinds = index.centres, queries.schema
    single = isinstance(kinds["vec"].dataType.elementType, T.FloatType)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = nearest_of(_matrix(batch.column("vec")), centres)
            raw = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            packed = pa.array([v.tobytes() for v in raw.astype(np.float32 if single else np.float64)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("grp"), batch.column("id"), pa.array(cell, pa.int32()), packed], names=["grp", "qid", "cell", "qvec"])

    schema = T.StructType([kinds["grp"], T.StructField("qid", kinds["id"].dataType), *T._parse_datatype_string("cell int, qvec binary").fields])
    order = ["grp", "cell", F.xxhash64("qid")]
    ordered = queries.mapInArrow(place, schema).repartitionByRange(*order).sortWithinPartitions(*order, "qid")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []

        def finish() -> pa.RecordBatch:
            qids, vecs = zip(*held)
            cells = np.unique(_asks(_raw(vecs, single), centres, probes)).tolist()
            return pa.RecordBatch.from_arrays(
                [pa.array([current], arrow.field("grp").type), pa.array([list(qids)], arrow.field("qids").type), pa.array([list(vecs)], arrow.field("qvecs").type),
                 pa.array([cells], arrow.field("cells").type)],
                schema=arrow,
            )

        for batch in batches:
            for grp, qid, _, vec in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (grp != current or len(held) == QUERY_ROWS):
                    yield finish()
                    held = []
                current = grp
                held.append((qid, vec))
        if held:
            yield finish()

    from pyspark.sql.pandas.types import to_arrow_schema

    packed = T.StructType([
        kinds["grp"], T.StructField("qids", T.ArrayType(kinds["id"].dataType)), *T._parse_datatype_string("qvecs array<binary>, cells array<int>").fields,
    ])
    arrow = to_arrow_schema(packed)
    return _stored(ordered.mapInArrow(pack, packed).withColumn("pack", F.monotonically_increasing_id()), "asked")


def _raw(vecs: Sequence[bytes], single: bool) -> np.ndarray:
    return _unit(np.frombuffer(b"".join(vecs), np.float32 if single else np.float64).astype(np.float64).reshape(len(vecs), -1))


def _wanted(best: DataFrame, blocks: DataFrame) -> DataFrame:
    """(pack, spots, rows, ids, vecs): of every block the rows that a pack wants, each once, and which of them each query of the pack asks for.

    The candidates are read once and meet their block in a join, so no task relies on an order in which they come.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    # Packs that lie next to each other have near numbers.
    asks = best.withColumn("slice", F.expr(f"pack div {BLOCK_VISITS}")).groupBy("block", "slice").agg(F.collect_list(F.struct("pack", "spot", "place")).alias("asked"))
    met = asks.join(blocks, "block").select("ids", "vecs", "asked")
    kinds = T.StructType([blocks.schema["ids"], *T._parse_datatype_string("pack long, spots array<int>, rows array<int>, vecs binary").fields])
    arrow = to_arrow_schema(kinds)

    def lists(parts: list[pa.Array], name: str) -> pa.Array:
        ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.concat_arrays(parts), type=arrow.field(name).type)

    def sent(held: list[tuple]) -> pa.RecordBatch:
        ids, packs, spots, rows, vecs = zip(*held)
        return pa.RecordBatch.from_arrays(
            [lists(ids, "ids"), pa.array(packs, pa.int64()), lists(spots, "spots"), lists(rows, "rows"), pa.array(vecs, pa.binary())], schema=arrow
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for ids, vecs, asked in zip(*batch.columns):
                vectors = np.frombuffer(vecs.as_py(), np.float64).reshape(len(ids.values), -1)
                packs, spots, places = (x.to_numpy() for x in asked.values.flatten())
                order = np.argsort(packs, kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(packs[order])) + 1):
                    own, rows = np.unique(places[part], return_inverse=True)
                    held.append((ids.values.take(pa.array(own)), packs[part[0]], pa.array(spots[part]), pa.array(rows.astype(np.int32)), vectors[own].tobytes()))
                    size += len(held[-1][-1])
                    if size >= SENT_BYTES:
                        yield sent(held)
                        held, size = [], 0
        if held:
            yield sent(held)

    return met.mapInArrow(run, kinds)


def _empty(frame: DataFrame, names: Sequence[str]) -> list[Column]:
    return [F.lit(None).cast(frame.schema[n].dataType).alias(n) for n in names]


class _Rough:
    """The best candidates of a pack of queries by decoded vectors; blocks of the cells they ask come one after the other."""

    def __init__(self, index: VectorIndex, pack: int, grp, qids: pa.Array, qvecs: pa.Array, single: bool, probes: int, keep: int, skip_self: bool):
        self.index, self.pack, self.grp, self.qids, self.keep, self.skip_self = index, pack, grp, qids, keep, skip_self
        unit = _raw(qvecs.to_pylist(), single)
        self.unit = unit.astype(np.float32)
        self.asks = np.zeros((len(unit), len(index.centres)), bool)
        np.put_along_axis(self.asks, _asks(unit, index.centres, probes), True, axis=1)
        shape = (len(unit), 0)
        self.scores, self.blocks, self.places = np.empty(shape, np.float32), np.empty(shape, np.int64), np.empty(shape, np.int32)
        self.waiting, self.count = [], 0

    def visit(self, block: int, cell: int, ids: pa.Array, codes: bytes) -> None:
        self.waiting.append((block, cell, ids, np.frombuffer(codes, np.uint8).reshape(len(ids), -1)))
        self.count += len(ids)
        if self.count >= SCORE_ROWS:
            self._score()

    def _score(self) -> None:
        blocks, cells, ids, digits = zip(*self.waiting)
        sizes = [len(x) for x in ids]
        self.waiting, self.count = [], 0
        cell, digits = np.repeat(cells, sizes), np.concatenate(digits)
        decoded = self.index.centres[cell] + np.concatenate([b[digits[:, p]] for p, b in enumerate(self.index.books)], axis=1)
        decoded /= np.maximum(np.linalg.norm(decoded, axis=1, keepdims=True), 1e-12)
        scores = self.unit @ decoded.astype(np.float32).T
        scores[~self.asks[:, cell]] = -np.inf
        if self.skip_self:
            at: dict = {}
            for part, start in zip(ids, np.cumsum([0, *sizes])):
                for v, j in {v: j for j, v in enumerate(part.to_pylist())}.items():
                    at.setdefault(v, []).append(start + j)
            for i, v in enumerate(self.qids.to_pylist()):
                if v in at:
                    scores[i, at[v]] = -np.inf
        block = np.broadcast_to(np.repeat(np.array(blocks, np.int64), sizes), scores.shape)
        place = np.broadcast_to(np.concatenate([np.arange(n, dtype=np.int32) for n in sizes]), scores.shape)
        both = [np.concatenate(x, axis=1) for x in ((self.scores, scores), (self.blocks, block), (self.places, place))]
        if both[0].shape[1] > self.keep:
            best = np.argpartition(-both[0], self.keep - 1, axis=1)[:, : self.keep]
            both = [np.take_along_axis(x, best, axis=1) for x in both]
        self.scores, self.blocks, self.places = both

    def hits(self, arrow: pa.Schema) -> pa.RecordBatch:
        if self.waiting:
            self._score()
        rows, cols = np.nonzero(np.isfinite(self.scores))
        return pa.RecordBatch.from_arrays(
            [pa.array([self.grp] * len(rows), arrow.field("grp").type), self.qids.take(pa.array(rows)), pa.array(np.full(len(rows), self.pack, np.int64)),
             pa.array(rows.astype(np.int32)), pa.array(self.blocks[rows, cols]), pa.array(self.places[rows, cols]), pa.array(self.scores[rows, cols].astype(float))],
            schema=arrow,
        )


def _candidates(packs: DataFrame, codes: DataFrame, schema: T.StructType, make) -> DataFrame:
    """``make(pack, grp, qids, qvecs)`` for every pack, visited by the blocks of its group and cells: few rows per query leave the task."""
    asked = packs.select("pack", F.col("grp").alias("g"), F.explode("cells").alias("c"))
    places = codes.select("block", "grp", "cell")
    met = asked.join(places, asked["g"].eqNullSafe(places["grp"]) & (asked["c"] == places["cell"])).select("pack", "block")
    sizes = met.groupBy("pack").agg(F.ceil(F.count(F.lit(1)) / F.lit(SLICE_VISITS)).alias("slices"))
    sliced = met.join(sizes, "pack").select("pack", "block", F.pmod(F.xxhash64("block"), F.col("slices")).alias("slice"))
    place, home, guest = ["pack", "slice"], ["grp", "qids", "qvecs"], ["block", "cell", "ids", "codes"]
    homes = sliced.select(*place).distinct().join(packs, "pack").select(*place, F.lit(0).alias("role"), *home, *_empty(codes, guest))
    come = sliced.join(codes, "block").select(*place, F.lit(1).alias("role"), *_empty(packs, home), *guest)
    ordered = homes.unionByName(come).repartition(*place).sortWithinPartitions(*place, "role", "block").select("role", "pack", *home, *guest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in batches:
            for role, pack, grp, qids, qvecs, block, cell, ids, digits in zip(*batch.columns):
                if role.as_py():
                    at.visit(block.as_py(), cell.as_py(), ids.values, digits.as_py())
                    continue
                if at is not None:
                    yield at.hits(arrow)
                at = make(pack.as_py(), grp.as_py(), qids.values, qvecs.values)
        if at is not None:
            yield at.hits(arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return ordered.mapInArrow(run, schema)


def _exact(packs: DataFrame, wanted: DataFrame, schema: T.StructType, single: bool) -> DataFrame:
    """Exact similarities of the candidates: every pack waits in a task for the rows that it wants."""
    from pyspark.sql.pandas.types import to_arrow_schema

    home, guest = ["grp", "qids", "qvecs"], ["spots", "rows", "ids", "vecs"]
    homes = packs.select("pack", F.lit(0).alias("role"), *home, *_empty(wanted, guest))
    come = wanted.select("pack", F.lit(1).alias("role"), *_empty(packs, home), *guest)
    ordered = homes.unionByName(come).repartition("pack").sortWithinPartitions("pack", "role").select("role", *home, *guest)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in batches:
            found = []
            for role, grp, qids, qvecs, spots, rows, ids, vecs in zip(*batch.columns):
                if role.as_py() == 0:
                    at = grp.as_py(), qids.values, _raw(qvecs.values.to_pylist(), single)
                    continue
                vectors = np.frombuffer(vecs.as_py(), np.float64).reshape(len(ids.values), -1)
                similar = np.round(np.einsum("ij,ij->i", at[2][spots.values.to_numpy()], vectors[rows.values.to_numpy()]), DIGITS)
                found.append(pa.RecordBatch.from_arrays(
                    [pa.array([at[0]] * len(similar), arrow.field("grp").type), at[1].take(spots.values), ids.values.take(rows.values), pa.array(similar)], schema=arrow
                ))
            if found:
                yield from pa.Table.from_batches(found, arrow).combine_chunks().to_batches()

    return ordered.mapInArrow(run, schema)


def search(
    index: VectorIndex, queries: DataFrame, *, group: str, query_id: str, vector: str = "embedding", k: int = fv.RETRIEVAL_K,
    probes: int | float = 0.25, candidates: int | None = None, skip_self: bool = False, corpus_id: str = "id",
) -> DataFrame:
    """Up to ``k`` near indexed rows per query within its group: (group, query_id, corpus_id, similarity, rank).

    ``probes`` says how many cells a query asks, as a number or as a share of all cells; ``candidates`` (8 k by
    default) how many rows are ranked exactly.  Similarities are exact, so a hit is wrong only by a nearer one that
    was not found.  Clustered vectors need few cells; without any structure the share of cells is about
    the share of neighbours found.
    """
    spark = queries.sparkSession
    asked = queries.filter(F.col(query_id).isNotNull() & _usable(vector)).select(F.col(group).alias("grp"), F.col(query_id).alias("id"), F.col(vector).alias("vec"))
    cells = len(index.centres)
    probes = min(cells, max(1, round(probes * cells) if isinstance(probes, float) else probes))
    keep = candidates or 8 * k
    table = index.table(spark)
    single = isinstance(asked.schema["vec"].dataType.elementType, T.FloatType)
    packs = _packs(asked, index, probes)
    # At most MOST_CELLS numbers; only their folders are read.
    wanted = [r[0] for r in packs.select(F.explode("cells")).distinct().collect()]
    codes = table.filter(F.col("cell").isin(wanted)).select("block", "grp", "cell", "ids", "codes")
    grp, ident = asked.schema["grp"], table.schema["ids"].dataType.elementType
    qid = T.StructField("qid", asked.schema["id"].dataType)
    rough = T.StructType([grp, qid, *T._parse_datatype_string("pack long, spot int, block long, place int, score double").fields])
    found = _candidates(packs, codes, rough, lambda *pack: _Rough(index, *pack, single, probes, keep, skip_self))
    order = Window.partitionBy("grp", "qid").orderBy(F.desc("score"), "block", "place", "pack", "spot")
    best = found.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= keep)
    fine = T.StructType([grp, qid, T.StructField("cid", ident), T.StructField("similarity", T.DoubleType())])
    exact = _exact(packs, _wanted(best, table.filter(F.col("cell").isin(wanted)).select("block", "ids", "vecs")), fine, single)
    rank = F.row_number().over(Window.partitionBy("grp", "qid").orderBy(F.desc("similarity"), "cid"))
    return exact.withColumn("rank", rank).filter(F.col("rank") <= k).select(
        F.col("grp").alias(group), F.col("qid").alias(query_id if query_id != corpus_id else f"query_{query_id}"), F.col("cid").alias(corpus_id), "similarity", "rank"
    )
