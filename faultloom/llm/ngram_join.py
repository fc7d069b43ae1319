"""Similarity join on word n-grams: MinHash banding, verified on the full n-gram sets.

1. Documents with equal n-gram sets form a class of copies; only one of each class goes on.
2. A class has one MinHash value per hash function, cut into bands.  Classes that agree in a band meet
   in its bucket.  Bands and rows are chosen so that a pair at the threshold meets with the wanted recall.
3. Every class joins the group of the least class it meets in any bucket, which brings near copies
   together.  A group is split into blocks of bounded size.
4. A class visits the blocks of every group it has met.  A block indexes its members' n-grams, and
   each visitor is compared with all members at once: links are counted and a spanning forest of them is
   kept, so a group of near copies yields rows in proportion to its size, not to its pairs.
5. Components of the forests are the near-duplicate groups.
"""

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NEAR, SHINGLE_WORDS, WordHashes, mixed, rows_of, shingles, worker_memory, words, written
from .graphs import components

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Chance that a pair just at the threshold meets in a bucket, and how many hash functions may be spent on it.
RECALL = 0.9995
MOST_HASHES = 256
#: N-grams of one block's members, about; more members make more blocks.
BLOCK_GRAMS = 500_000


def banding(threshold: float = NEAR, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most selective banding with the wanted recall at the threshold within the hash functions."""
    best = None
    for rows in range(1, most + 1):
        meet = min(threshold**rows, 1 - 1e-12)
        bands = max(1, math.ceil(math.log(1 - recall) / math.log1p(-meet)))
        if bands * rows > most:
            break
        best = (bands, rows)
    if best is None:
        raise ValueError("the recall needs more hash functions")
    return best


def gram_set(text: str | None, hashes: WordHashes, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct hashes of the text's word n-grams."""
    return np.unique(shingles(hashes.of(words(text)), size))


class MinHash:
    """Band values of n-gram sets, the same in every process."""

    def __init__(self, bands: int, rows: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = (rng.integers(0, 1 << 31, bands * rows, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)
        self.weights = rng.integers(1, 1 << 62, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.salts = rng.integers(1, 1 << 62, bands, dtype=np.uint64)

    def values(self, grams: np.ndarray) -> np.ndarray:
        """One 64-bit value per band; the band's number is part of it."""
        low = (grams >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(low), 1024):
            part = np.multiply.outer(self.a, low[at : at + 1024])
            part += self.b[:, None]
            # A product's low bits hang on the input's low bits alone; fold the high ones in.
            part ^= part >> np.uint32(15)
            np.minimum(least, part.min(axis=1), out=least)
        table = least.reshape(self.bands, self.rows).astype(np.uint64)
        return mixed((table * self.weights).sum(axis=1, dtype=np.uint64) + self.salts).view(np.int64)


def _hashes() -> WordHashes:
    return worker_memory("words").setdefault("word_hashes", WordHashes())


def _row_mark() -> list[Column]:
    """Two hashes that tell the texts of equal ids apart."""
    return [F.xxhash64("text").alias("_t1"), F.xxhash64(F.lit(3), "text").alias("_t2")]


def signatures(df: DataFrame, bands: int, rows: int, size: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, _t1, _t2, key, grams, bands): 128-bit key of the n-gram set, its size, and the band values.

    A text without words has a null key.
    """
    ident = df.schema["doc_id"].dataType.simpleString()
    scheme = MinHash(bands, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        hashes = _hashes()
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                keys, sizes, values = [], [], []
                for text in batch.column("text").to_pylist():
                    grams = gram_set(text, hashes, size)
                    sizes.append(len(grams))
                    keys.append(xxhash.xxh3_128_digest(grams.tobytes()) if len(grams) else None)
                    values.append(scheme.values(grams) if len(grams) else None)
                yield {
                    "doc_id": batch.column("doc_id"), "_t1": batch.column("_t1"), "_t2": batch.column("_t2"),
                    "key": keys, "grams": sizes, "bands": values,
                }

    return rows_of(
        df.select("doc_id", "text", *_row_mark()),
        f"doc_id {ident}, _t1 long, _t2 long, key binary, grams int, bands array<long>",
        run,
    )


def sets_of(df: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """(key, doc_id, set): the full n-gram sets as bytes of sorted 64-bit hashes."""
    ident = df.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        hashes = _hashes()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                sets = [gram_set(t, hashes, size).tobytes() for t in batch.column("text").to_pylist()]
                yield {"key": [xxhash.xxh3_128_digest(s) for s in sets], "doc_id": batch.column("doc_id"), "set": sets}

    return rows_of(df.select("doc_id", "text"), f"key binary, doc_id {ident}, set binary", run)


class Block:
    """The n-grams of a block's members, indexed so that one visitor meets all members at once."""

    def __init__(self, rows: list[tuple]):
        self.keys = [r[0] for r in rows]
        self.copies = np.array([r[1] for r in rows], np.int64)
        self.bands = np.stack([r[2] for r in rows])
        sets = [r[3] for r in rows]
        self.sizes = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        self.owners = np.repeat(np.arange(len(sets), dtype=np.int32), self.sizes)[order]
        self.grams, starts = np.unique(flat[order], return_index=True)
        self.starts = np.append(starts, len(flat))
        self.root = {k: k for k in self.keys}

    def links(self, key: bytes, grams: np.ndarray, threshold: float) -> np.ndarray:
        """Members other than the visitor that reach the threshold."""
        place = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        place = place[self.grams[place] == grams]
        first, count = self.starts[place], self.starts[place + 1] - self.starts[place]
        index = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        common = np.bincount(self.owners[index], minlength=len(self.keys))
        near = np.flatnonzero(common / (len(grams) + self.sizes - common) >= threshold)
        return np.array([i for i in near if self.keys[i] != key], np.int64)

    def _find(self, key: bytes) -> bytes:
        root = self.root
        while root[key] != key:
            root[key] = root[root[key]]
            key = root[key]
        return key

    def join(self, a: bytes, b: bytes) -> None:
        a, b = self._find(a), self._find(b)
        if a != b:
            self.root[max(a, b)] = min(a, b)

    def forest(self) -> list[tuple[bytes, bytes]]:
        """Every member that hangs on another, with its root."""
        return [(k, r) for k in self.root if (r := self._find(k)) != k]


def _verify(threshold: float):
    """Rows sorted by (home, block, members first, key) to (key, links, other, mine, theirs): link counts of visits, forest edges, and links without a shared band with both sides' copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        current, members, block, last = None, [], None, None
        out: list[tuple] = []

        def visit(key, copies, bands, grams, member):
            near = block.links(key, grams, threshold)
            banded = (block.bands[near] == bands).any(axis=1)
            out.append((key, int(block.copies[near[banded]].sum()), None, None, None))
            # Classes that share a band visit each other; others may meet from one side only, so such links go out as pairs.
            for i in near[~banded]:
                sides = sorted([(key, copies), (block.keys[i], int(block.copies[i]))])
                out.append((sides[0][0], 0, sides[1][0], sides[0][1], sides[1][1]))
            if len(near):
                # Members are joined here; a visitor hangs on one of them, so nothing grows with the visitors.
                first = block.keys[near[0]]
                for i in near[1:]:
                    block.join(first, block.keys[i])
                if member:
                    block.join(key, first)
                else:
                    out.append((key, 0, first, None, None))

        def open_block():
            nonlocal block, members
            block, held = Block(members), members
            members = []
            for row in held:
                visit(*row, True)

        def close_block():
            if members:
                open_block()
            if block:
                out.extend((a, 0, b, None, None) for a, b in block.forest())

        def give():
            rows = list(zip(*out)) or [[]] * 5
            out.clear()
            return dict(zip(("key", "links", "other", "mine", "theirs"), rows))

        for batch in batches:
            cols = [batch.column(n) for n in ("home", "block", "member", "key", "copies", "bands", "set")]
            for home, number, member, key, copies, bands, grams in zip(*(c.to_pylist() for c in cols)):
                if (home, number) != current:
                    close_block()
                    current, members, block, last = (home, number), [], None, None
                if key == last:  # a repeated row
                    continue
                last = key
                row = (key, copies, np.array(bands, np.int64), np.frombuffer(grams, np.uint64))
                if member:
                    members.append(row)
                    continue
                if block is None and members:
                    open_block()
                if block:
                    visit(*row, False)
                if len(out) >= 10_000:
                    yield give()
            yield give()
        close_block()
        yield give()

    return run


def near_duplicates(df: DataFrame, *, threshold: float = NEAR, size: int = SHINGLE_WORDS, recall: float = RECALL) -> DataFrame:
    """Near-duplicate groups and link counts of ``df(doc_id, text)``, one row per input row.

    Two documents are linked when the Jaccard similarity of their sets of ``size``-word n-grams is at
    least ``threshold`` (a text of fewer words is one n-gram; words are lower-cased runs of letters and
    digits, or whitespace pieces where there are none).  Result: doc_id, class_id (least id of all
    documents connected by links), copies (documents with the same n-gram set), n_links (other
    documents linked), _t1, _t2 (hashes of the text, which tell rows with equal ids apart) and _group (a key
    of the group itself, null for texts without words).  Texts
    without words, empty or null, are linked to nothing and keep their own id.  Repeated rows are copies
    of each other.  Null ids count as rows but are never the least id unless all are null.  An empty
    table gives an empty result; other columns are ignored.
    """
    bands, rows = banding(threshold, recall)
    signed = written(signatures(df, bands, rows, size), "signatures")
    classes = written(
        signed.filter(F.col("key").isNotNull())
        .groupBy("key")
        .agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("grams").alias("grams"), F.first("bands").alias("bands")),
        "classes",
    )
    met = classes.select("key", F.explode("bands").alias("bucket"))
    shared = met.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("lead")).filter("n > 1").drop("n")
    met = written(met.join(shared, "bucket"), "buckets")
    homes = met.groupBy("key").agg(F.min("lead").alias("home")).join(classes.select("key", "rep", "copies", "grams", "bands"), "key")
    homes = written(homes, "homes")
    blocks = homes.groupBy("home").agg(F.ceil(F.sum("grams") / F.lit(BLOCK_GRAMS)).cast("int").alias("blocks"))

    def block_of(blocks_column: str) -> Column:
        return F.pmod(F.xxhash64("key"), F.col(blocks_column)).cast("int")

    # Which groups does a class meet?  Each bucket lists its groups once, however many classes are in it.
    in_bucket = met.join(homes.select("key", "home"), "key")
    meets = (
        in_bucket.select("key", "bucket")
        .join(in_bucket.select("bucket", "home").distinct(), "bucket")
        .select("key", "home")
        .distinct()
        .join(blocks, "home")
    )
    own = homes.select("key", F.col("home").alias("own_home"))
    visits = (
        meets.join(own, "key")
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("member", (F.col("home") == F.col("own_home")) & (F.col("block") == block_of("blocks")))
        .select("key", "home", "block", "member")
    )
    # The ids' number grows with the documents, so they are never broadcast: texts and ids meet by a shuffle at every size.
    reps = homes.select(F.col("rep").alias("doc_id")).distinct().hint("merge")
    docs = df.select("doc_id", "text")
    texts = docs.alias("d").join(reps.alias("r"), F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")), "left_semi")
    sets = (
        sets_of(texts, size)
        .alias("s")
        .join(
            homes.select("key", "rep", "copies", "bands").alias("h"),
            (F.col("s.key") == F.col("h.key")) & F.col("s.doc_id").eqNullSafe(F.col("h.rep")),
        )
        .select("s.key", "h.copies", "h.bands", "s.set")
        .dropDuplicates(["key"])  # rows repeated under one id bring one set
    )
    dealt = (
        visits.join(sets, "key")
        .repartition("home", "block")
        .sortWithinPartitions("home", "block", F.desc("member"), "key")
        .select("home", "block", "member", "key", "copies", "bands", "set")
    )
    found = written(rows_of(dealt, "key binary, links long, other binary, mine long, theirs long", _verify(threshold)), "links")
    apart = found.filter(F.col("mine").isNotNull()).select("key", "other", "mine", "theirs").distinct()
    links = (
        found.filter(F.col("other").isNull()).select("key", "links")
        .unionByName(apart.select("key", F.col("theirs").alias("links")))
        .unionByName(apart.select(F.col("other").alias("key"), F.col("mine").alias("links")))
        .groupBy("key").agg(F.sum("links").alias("links"))
    )
    label = components(found.filter(F.col("other").isNotNull()), "key", "other")
    labelled = classes.select("key", "rep", "copies").join(label.withColumnRenamed("node", "key"), "key", "left")
    labelled = labelled.withColumn("label", F.coalesce("label", "key"))
    least = labelled.groupBy("label").agg(F.min("rep").alias("class_id"))
    table = labelled.join(least, "label").join(links, "key", "left").select(
        "key", "label", "class_id", "copies", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    return (
        signed.select("doc_id", "_t1", "_t2", "key")
        .join(table, "key", "left")
        .select(
            "doc_id",
            F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
            F.coalesce("copies", F.lit(1)).cast("long").alias("copies"),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            "_t1",
            "_t2",
            F.col("label").alias("_group"),
        )
    )


def keep_one(df: DataFrame, **options) -> DataFrame:
    """``df`` with one document of each near-duplicate group: the one of least id, of equal ids the one of least text hash.

    Texts without words, null ones included, all stay, and so do all columns, whatever their names; an empty table gives
    an empty one.
    """
    grouped = near_duplicates(df, **options)
    first = Window.partitionBy("_group").orderBy("_t1", "_t2")
    least = grouped.filter(F.col("_group").isNotNull() & F.col("doc_id").eqNullSafe(F.col("class_id")))
    least = least.withColumn("_nth", F.row_number().over(first)).filter("_nth = 1")
    wordless = grouped.filter(F.col("_group").isNull())
    columns = ["doc_id", "_t1", "_t2", F.col("_group").isNull().alias("_wordless")]
    wanted = written(least.select(*columns).unionByName(wordless.select(*columns).distinct()), "kept")
    same_id = F.col("d.doc_id").eqNullSafe(F.col("k.doc_id"))
    # The row travels as one struct, so its columns may have any names.
    marked = df.select(F.struct("*").alias("_row"), "doc_id", *_row_mark())
    kept = (
        marked.alias("d")
        .join(wanted.alias("k"), same_id & (F.col("d._t1") == F.col("k._t1")) & (F.col("d._t2") == F.col("k._t2")))
        .select("d.*", "k._wordless")
    )
    nth = F.row_number().over(Window.partitionBy("doc_id", "_t1", "_t2").orderBy(F.lit(0)))
    return kept.withColumn("_nth", nth).filter(F.col("_wordless") | (F.col("_nth") == 1)).select("_row.*")


#: Words of a text in SQL, as ``common.words`` gives them.
SQL_WORDS = r"""
worded AS (
  SELECT *, CASE WHEN len(w) > 0 THEN w ELSE list_filter(regexp_split_to_array(low, '\s+'), lambda x: x <> '') END AS words
  FROM (SELECT *, regexp_extract_all(low, '[\p{L}\p{N}_]+') AS w FROM (SELECT *, lower(coalesce(text, '')) AS low FROM documents))
)"""


def oracle(threshold: float = NEAR, size: int = SHINGLE_WORDS) -> str:
    """All pairs by shared n-grams, exact similarities, and the closure of the links (ids are taken to be unique)."""
    return f"""
WITH RECURSIVE {SQL_WORDS},
grams AS (
  SELECT DISTINCT doc_id, array_to_string(words[i : i + {size} - 1], ' ') AS gram
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - {size} + 1, least(len(words), 1)) + 1)) AS i FROM worded)
),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY 1),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2
),
links AS (
  SELECT a, b, c = x.n AND c = y.n AS equal FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE c / (x.n + y.n - c) >= {threshold}
),
reached AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b
),
class AS (SELECT a AS doc_id, min(b) AS class_id FROM reached GROUP BY 1),
degree AS (SELECT a AS doc_id, count(*) AS n_links, count(*) FILTER (equal) AS equal FROM links GROUP BY 1)
SELECT doc_id, class_id, 1 + coalesce(equal, 0) AS copies, coalesce(n_links, 0) AS n_links
FROM class LEFT JOIN degree USING (doc_id)
"""
