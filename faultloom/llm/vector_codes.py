"""Vector code compression by product quantisation with active-entry Lloyd rounds.

A vector of integers floor(256 x) is cut into consecutive parts, and each part is replaced by the
index of the nearest entry of that part's codebook.  A round assigns every part, then moves each
entry to the mean of its parts.  From the second assignment on, a part whose entry did not move keeps
its stored exact distance and is compared with the moved entries only; the distances of entries that
stayed cannot have become smaller.  A part whose entry moved is compared with all of them.  Equal
distances go to the lower index both ways, so the result equals complete scans.

Assignments are Arrow passes over Parquet tables in the shared folder.  What reaches the driver is one
sum per component of the codebooks, summed by a shuffle first.
"""

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PARTS = 16
ENTRIES = 64
ROUNDS = 2
#: Integers are held exactly in doubles up to here; larger components count as this.
LARGEST = 1 << 53
LONG = (1 << 63) - 1
#: Rows assigned together, and pieces into which a label's rows are dealt for the sums by label.
ROWS = 2048
SALTS = 32

Books = list[list[list[int]]]


def integers(values: np.ndarray) -> np.ndarray:
    """floor(256 x) as whole doubles."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(values * 256.0), -LARGEST, LARGEST)


def cuts(dim: int, parts: int) -> list[slice]:
    """Consecutive parts, equal where ``parts`` divides ``dim``; else the first ones have one component more."""
    sizes = [dim // parts + (p < dim % parts) for p in range(parts)]
    ends = np.cumsum([0, *sizes])
    return [slice(int(a), int(b)) for a, b in zip(ends, ends[1:])]


def _distances(q: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows and entries; Python integers where doubles would round."""
    largest = max(np.abs(q).max(initial=0), np.abs(book).max(initial=0))
    if 4 * max(1, q.shape[1]) * largest * largest < LARGEST:
        return (q * q).sum(axis=1)[:, None] - 2 * (q @ book.T) + (book * book).sum(axis=1)[None]
    exact = q.astype(object).reshape(q.shape)
    whole = np.vectorize(int, otypes=[object])
    gap = whole(exact)[:, None, :] - whole(book.astype(object))[None] if q.shape[1] else np.zeros((len(q), len(book), 0), object)
    return (gap * gap).sum(axis=2)


def assign(q: np.ndarray, book: np.ndarray, code: np.ndarray | None, far: np.ndarray | None, moved: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(code, distance) of the nearest entry for the rows of one part.

    With the former code and distance, rows whose entry is not ``moved`` are compared with the moved
    entries only.
    """
    if code is None:
        found = _distances(q, book)
        best = found.argmin(axis=1)
        return best, found[np.arange(len(q)), best]
    code, far = code.copy(), far.copy()
    stayed = ~moved[code]
    entries = np.flatnonzero(moved)
    if len(entries) and stayed.any():
        found = _distances(q[stayed], book[entries])
        best = found.argmin(axis=1)
        near, entry = found[np.arange(len(best)), best], entries[best]
        was, kept = far[stayed], code[stayed]
        better = (near < was) | ((near == was) & (entry < kept))
        code[stayed] = np.where(better, entry, kept)
        far[stayed] = np.where(better, near, was)
    if not stayed.all():
        code[~stayed], far[~stayed] = assign(q[~stayed], book, None, None, None)
    return code, far


def kept_vectors(df: DataFrame, ident: str, label: str, vector: str) -> DataFrame:
    """(ident, label, dim, vec): rows whose vector is neither null nor holds null or non-finite components; ``vec`` as doubles."""
    kinds = df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            taken, vecs = [], []
            for at, values in enumerate(batch.column(2).to_pylist()):
                if any(v is None for v in values):
                    continue
                array = np.array(values, np.float64)
                if np.isfinite(array).all():
                    taken.append(at)
                    vecs.append(array)
            chosen = batch.take(pa.array(taken, pa.int64()))
            yield {"ident": chosen.column(0), "label": chosen.column(1), "dim": [len(v) for v in vecs], "vec": [v.tobytes() for v in vecs]}

    schema = f"ident {kinds[ident].dataType.simpleString()}, label {kinds[label].dataType.simpleString()}, dim int, vec binary"
    rows = df.filter(F.col(vector).isNotNull()).select(ident, label, vector)
    return rows_of(rows, schema, run)


def start(kept: DataFrame, parts: int, entries: int) -> tuple[Books, int]:
    """Codebooks of the ``entries`` smallest ids (of equal ids the least vector), and the length of their vectors."""
    ids = kept.filter(F.col("ident").isNotNull()).select("ident").distinct().orderBy("ident").limit(entries).collect()
    if not ids:
        return [], 0
    few = kept.filter(F.col("ident") <= F.lit(ids[-1]["ident"]))
    least = few.groupBy("ident").agg(F.min(F.struct("dim", "vec")).alias("v"))
    rows = least.orderBy("ident").select("v.dim", "v.vec").collect()
    dim = rows[0]["dim"]
    first = integers(np.array([np.frombuffer(r["vec"], np.float64) for r in rows if r["dim"] == dim]).reshape(-1, dim))
    return [[[int(x) for x in row] for row in first[:, cut]] for cut in cuts(dim, parts)], dim


def _pass(state: DataFrame, books: Books, dim: int, moved: list[list[bool]] | None, name: str) -> DataFrame:
    """One assignment of all rows, as a new table of (ident, label, dim, vec, codes, distances, error)."""
    kinds = state.schema
    own = cuts(dim, len(books))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        arrays = [np.array(b, np.float64).reshape(len(b), -1) for b in books]
        flags = None if moved is None else [np.array(m) for m in moved]
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                dims = batch.column("dim").to_numpy(zero_copy_only=False)
                fits = np.flatnonzero((dims == dim) & (len(books) > 0))
                out = {c: batch.column(c) for c in ("ident", "label", "dim", "vec")}
                codes, stored, errors = [None] * batch.num_rows, [None] * batch.num_rows, [None] * batch.num_rows
                if len(fits):
                    vecs = batch.column("vec").take(pa.array(fits)).to_pylist()
                    q = integers(np.frombuffer(b"".join(vecs), np.float64).reshape(len(fits), dim))
                    before = former = None
                    if flags is not None:
                        before = np.frombuffer(b"".join(batch.column("codes").take(pa.array(fits)).to_pylist()), np.uint8).reshape(len(fits), -1).astype(int)
                        far = [d for d in batch.column("distances").take(pa.array(fits)).to_pylist()]
                        # Rows with distances beyond doubles carry none and are always scanned completely.
                        former = None if any(d is None for d in far) else np.frombuffer(b"".join(far), np.float64).reshape(len(fits), -1)
                    code, near = [], []
                    for p, cut in enumerate(own):
                        if former is None:
                            c, d = assign(q[:, cut], arrays[p], None, None, None)
                        else:
                            c, d = assign(q[:, cut], arrays[p], before[:, p], former[:, p], flags[p])
                        code.append(c)
                        near.append(d)
                    exact = all(d.dtype != object and d.max() < LARGEST for d in near)
                    packed = np.stack(code, axis=1).astype(np.uint8)
                    total = np.stack([d.astype(object) if not exact else d for d in near], axis=1)
                    sums = total.sum(axis=1)
                    for i, row in enumerate(fits):
                        codes[row] = packed[i].tobytes()
                        stored[row] = total[i].astype(np.float64).tobytes() if exact else None
                        errors[row] = min(int(sums[i]), LONG)
                yield out | {"codes": codes, "distances": stored, "error": errors}

    schema = ", ".join(f"{c} {kinds[c].dataType.simpleString()}" for c in ("ident", "label", "dim", "vec"))
    return written(rows_of(state, f"{schema}, codes binary, distances binary, error long", run), name)


def _means(state: DataFrame, books: Books, dim: int) -> Books:
    """Entries moved to the floor of the mean of their parts; unused ones stay."""
    own, size = cuts(dim, len(books)), len(books[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total = np.zeros((size, dim), object)
        count = np.zeros((size, len(own)), np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                q = integers(np.frombuffer(b"".join(batch.column("vec").to_pylist()), np.float64).reshape(-1, dim))
                codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(len(q), -1)
                small = np.abs(q).max(initial=0) * len(q) < LARGEST
                for p, cut in enumerate(own):
                    count[:, p] += np.bincount(codes[:, p], minlength=size)
                    for j in range(cut.start, cut.stop):
                        if small:
                            total[:, j] += np.bincount(codes[:, p], q[:, j], size).astype(np.int64).astype(object)
                        else:
                            for entry, value in zip(codes[:, p], q[:, j]):
                                total[entry, j] += int(value)
        rows = [(p, e, j, int(count[e, p]), str(total[e, j])) for p, cut in enumerate(own) for e in range(size) if count[e, p] for j in range(cut.start, cut.stop)]
        yield dict(zip(("part", "entry", "at", "n", "total"), zip(*rows) if rows else [[]] * 5))

    found = rows_of(state.filter("codes IS NOT NULL").select("vec", "codes"), "part int, entry int, at int, n long, total string", run)
    sums = found.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    out = [[list(e) for e in book] for book in books]
    for r in sums.collect():
        out[r["part"]][r["entry"]][r["at"] - own[r["part"]].start] = int(r["total"]) // r["n"]
    return out


def fit(df: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, ident: str = "vec_id", label: str = "label", vector: str = "embedding") -> tuple[Books, DataFrame]:
    """(codebooks, table of ident, label, dim, vec, codes, distances, error by them): see ``compress``."""
    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte: 1 to 256 entries")
    state = written(kept_vectors(df, ident, label, vector), "vectors")
    books, dim = start(state, parts, entries)
    moved = None
    for at in range(rounds):
        state = _pass(state, books, dim, moved, f"assigned{at}")
        if not books:
            return books, state
        new = _means(state, books, dim)
        moved = [[a != b for a, b in zip(old, now)] for old, now in zip(books, new)]
        books = new
    return books, _pass(state, books, dim, moved, "assigned")


def checksum(books: Books) -> str:
    """SHA-256 of all components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()


def compress(df: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, ident: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """Codes of all vectors: ident, code, error, label_error, codebooks_sha256.

    ``code`` has the entry of each part as two hex digits, ``error`` the sum of the parts' squared
    distances, ``label_error`` the errors of the row's label together (rows without a label are one
    label).  Rows whose vector is null or holds null or non-finite components are dropped.  Repeated rows are
    all coded; of equal ids the least vector starts the codebooks, rows without an id are coded but start
    none.  With fewer ids than entries the codebooks are that short.  All vectors should have one
    length, that of the smallest id; others (and all, where no row has an id) are returned with a null code and
    error.  A length that the number of parts does not divide gives the first parts one component
    more.  Components beyond 2**53 count as 2**53, errors and sums beyond a long as the largest long.
    An empty table gives an empty result; other columns are ignored.
    """
    books, state = fit(df, parts=parts, entries=entries, rounds=rounds, ident=ident, label=label, vector=vector)
    rows = state.select("ident", "label", F.lower(F.hex("codes")).alias("code"), "error")
    # A label may hold a third of all rows: its rows are dealt over salts, its sum is repeated for each.
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    sums = rows.groupBy("label").agg(F.when(total > LONG, F.lit(LONG)).otherwise(total).cast("long").alias("label_error"))
    sums = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("ident", "code"), F.lit(SALTS)).cast("int"))
    joined = dealt.alias("r").join(sums.alias("s"), F.col("r.label").eqNullSafe(F.col("s.label")) & (F.col("r.salt") == F.col("s.salt")))
    return joined.select(F.col("r.ident").alias(ident), "r.code", "r.error", "s.label_error", F.lit(checksum(books)).alias("codebooks_sha256"))


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """DuckDB SQL of ``op12``: complete scans in every round."""

    def nearest(name: str, book: str) -> str:
        return f"""
{name} AS MATERIALIZED (
  SELECT rid, part, q, arg_min(entry, (far, entry)) AS entry, min(far) AS far FROM (
    SELECT p.rid, p.part, p.q, b.entry, list_sum(list_transform(range(1, len(p.q) + 1), lambda i: (p.q[i] - b.e[i]) * (p.q[i] - b.e[i])))::BIGINT AS far
    FROM parts p JOIN {book} b USING (part))
  GROUP BY rid, part, q)"""

    def means(name: str, found: str, book: str) -> str:
        return f"""
{name} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(m.e, b.e) AS e FROM {book} b LEFT JOIN (
    SELECT part, entry, list(mean ORDER BY pos) AS e FROM (
      SELECT part, entry, pos, floor(sum(value)::DOUBLE / count(*))::BIGINT AS mean
      FROM (SELECT part, entry, unnest(range(1, len(q) + 1)) AS pos, unnest(q) AS value FROM {found}) GROUP BY part, entry, pos)
    GROUP BY part, entry) m USING (part, entry))"""

    steps = []
    for at in range(rounds):
        steps += [nearest(f"found{at}", f"book{at}"), means(f"book{at + 1}", f"found{at}", f"book{at}")]
    steps.append(nearest("final", f"book{rounds}"))
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT rid, part, v[part * (len(v) // {parts}) + 1 : (part + 1) * (len(v) // {parts})] AS q
  FROM kept, (SELECT unnest(range({parts})) AS part)),
book0 AS MATERIALIZED (SELECT part, rid - 1 AS entry, q AS e FROM parts WHERE rid <= {entries}),
{",".join(steps)},
rows_ AS (
  SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(far)::BIGINT AS error FROM final GROUP BY rid),
sha AS (
  SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM rows_ JOIN kept USING (rid), sha"""
