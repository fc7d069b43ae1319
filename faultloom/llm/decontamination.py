"""Benchmark decontamination: SimHash fingerprints of item-sized windows.

A benchmark item of n words is compared with every run of n words of a document.  A run that shares
no shingle with the item has similarity 0, so fingerprints are made of the runs around shared shingles
only; nothing else can reach the threshold.  Runs and items are reduced to 64-bit SimHash
fingerprints over their weighted shingles.  An index per item length cuts fingerprints into seven
blocks: two fingerprints within the radius of 20 bits differ by at most two bits in one of the
blocks, so looking up each block's value finds all of them.  What is within the radius is verified by
the exact weighted Jaccard similarity of the shingles, weights being how often a shingle occurs.
"""

import sys
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NEAR, SHINGLE_WORDS, WordHashes, rows_of, shingles, worker_memory, words

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Greatest Hamming distance of two fingerprints that are compared.  Equal weights and a similarity of 0.8 give a mean
#: of 9.7 differing bits with a deviation of 2.9.
RADIUS = 20
#: Bits of the blocks; by the pigeonhole principle one block differs in at most RADIUS // 7 bits.
BLOCK_BITS = (10, 9, 9, 9, 9, 9, 9)
#: Words of benchmark items that are held and sent to tasks at once; a larger benchmark takes several passes.
PACK_WORDS = 1_000_000

_FILTER = 1 << 20


def fingerprints(sums: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of rows of 64 sign sums: a bit is set where the sum is positive."""
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8").ravel()


def sign_sums(grams: np.ndarray) -> np.ndarray:
    """Running sums of the shingles' signs, a row of zeros first: row b less row a is the sum over a..b-1."""
    bits = np.unpackbits(grams.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    out = np.zeros((len(grams) + 1, 64), np.int32)
    np.cumsum(bits.astype(np.int8) * np.int8(2) - np.int8(1), axis=0, dtype=np.int32, out=out[1:])
    return out


def block_values(prints: np.ndarray) -> list[np.ndarray]:
    out, shift = [], 0
    for bits in BLOCK_BITS:
        out.append(((prints >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64))
        shift += bits
    return out


def popcount(values: np.ndarray) -> np.ndarray:
    return np.bitwise_count(values)


class Length:
    """Items of one length: their fingerprints and the block index.

    A block's table has one row per value and one bit per item: set where the item's block is near the value.
    """

    def __init__(self, grams: list[np.ndarray], items: list[int]):
        self.items = items
        self.grams = len(grams[0])
        self.bags = [Counter(g.tolist()) for g in grams]
        self.prints = np.concatenate([fingerprints(sign_sums(g)[-1:]) for g in grams])
        groups = -(-len(items) // 64)
        self.index = [np.zeros((1 << bits, groups), np.uint64) for bits in BLOCK_BITS]
        for table, bits, values in zip(self.index, BLOCK_BITS, block_values(self.prints)):
            flips = [0, *(sum(1 << i for i in c) for n in range(1, RADIUS // len(BLOCK_BITS) + 1) for c in combinations(range(bits), n))]
            near = np.array(flips, np.int64)
            for i, value in enumerate(values):
                table[value ^ near, i // 64] |= np.uint64(1 << (i % 64))

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item position) pairs within the radius."""
        pairs = []
        at_once = max(1, (1 << 20) // self.index[0].shape[1])  # keeps the masks at 8 MiB
        for low in range(0, len(prints), at_once):
            part = prints[low : low + at_once]
            mask = np.zeros((len(part), self.index[0].shape[1]), np.uint64)
            for table, value in zip(self.index, block_values(part)):
                mask |= table[value]
            # Only words of the mask that have a bit are looked into.
            window, group = np.nonzero(mask)
            bits = np.unpackbits(mask[window, group].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            which, bit = np.nonzero(bits)
            window, item = window[which], 64 * group[which] + bit
            near = popcount(part[window] ^ self.prints[item]) <= RADIUS
            pairs.append((low + window[near], item[near]))
        return np.concatenate([w for w, _ in pairs]), np.concatenate([i for _, i in pairs])


class Items:
    """A pack of benchmark items, indexed by the size of their shingles and their length."""

    def __init__(self, rows: list[tuple], size: int):
        hashes = WordHashes()
        self.idents: list = []
        self.sizes: dict[int, dict] = {}
        by_length = defaultdict(list)
        for ident, text in rows:
            tokens = words(text)
            if tokens:
                self.idents.append(ident)
                by_length[len(tokens)].append((len(self.idents) - 1, hashes.of(tokens)))
        for length, items in sorted(by_length.items()):
            own = min(size, length)
            grams = [shingles(h, own) for _, h in items]
            entry = self.sizes.setdefault(own, {"filter": np.zeros(_FILTER, bool), "lengths": {}, "where": defaultdict(set)})
            entry["lengths"][len(grams[0])] = Length(grams, [i for i, _ in items])
            for g in grams:
                entry["filter"][(g & np.uint64(_FILTER - 1)).astype(np.int64)] = True
                for gram in g.tolist():
                    entry["where"][gram].add(len(g))

    def plain(self) -> tuple:
        """Built-in values and arrays only: what workers unpickle must not need this package."""
        sizes = [
            (size, e["filter"], [(n, x.__dict__ | {"bags": [dict(b) for b in x.bags]}) for n, x in e["lengths"].items()], dict(e["where"]))
            for size, e in self.sizes.items()
        ]
        return self.idents, sizes

    @classmethod
    def from_plain(cls, plain: tuple) -> "Items":
        out = cls.__new__(cls)
        out.idents, out.sizes = plain[0], {}
        for size, filter_, lengths, where in plain[1]:
            entry = out.sizes[size] = {"filter": filter_, "lengths": {}, "where": where}
            for n, fields in lengths:
                entry["lengths"][n] = Length.__new__(Length)
                entry["lengths"][n].__dict__.update(fields)
        return out

    def matches(self, hashed: np.ndarray, threshold: float) -> list[tuple]:
        """(item, similarity, first word, words) for the most similar run of each item that reaches the threshold; the first of equals."""
        best: dict[int, tuple] = {}
        for size, entry in self.sizes.items():
            if len(hashed) < size:
                continue
            grams = shingles(hashed, size)
            hits = np.flatnonzero(entry["filter"][(grams & np.uint64(_FILTER - 1)).astype(np.int64)])
            places = defaultdict(list)
            for at, gram in zip(hits.tolist(), grams[hits].tolist()):
                for n in entry["where"].get(gram, ()):
                    places[n].append(at)
            for n, ats in places.items():
                self._windows(entry["lengths"][n], grams, np.array(ats), threshold, size, best)
        return [(self.idents[i], *found) for i, found in sorted(best.items())]

    def _windows(self, length: Length, grams: np.ndarray, ats: np.ndarray, threshold: float, size: int, best: dict) -> None:
        n = min(length.grams, len(grams))
        starts = np.zeros(len(grams) - n + 2, np.int32)
        np.add.at(starts, np.clip(ats - n + 1, 0, len(grams) - n), 1)
        np.add.at(starts, np.minimum(ats, len(grams) - n) + 1, -1)
        starts = np.flatnonzero(np.cumsum(starts[:-1]) > 0)
        for piece in np.split(starts, np.flatnonzero(np.diff(starts) > n) + 1):
            for at in range(0, len(piece), 4096):
                part = piece[at : at + 4096]
                low = part[0]
                sums = sign_sums(grams[low : part[-1] + n])
                windows, items = length.near(fingerprints(sums[part - low + n] - sums[part - low]))
                for w, i in zip(part[windows].tolist(), items.tolist()):
                    bag = Counter(grams[w : w + n].tolist())
                    other = length.bags[i]
                    common = sum(min(c, other[g]) for g, c in bag.items() if g in other)
                    alike = common / (n + length.grams - common)
                    if alike >= threshold:
                        item = length.items[i]
                        if item not in best or (-alike, w) < (-best[item][0], best[item][1]):
                            best[item] = (alike, w, n + size - 1)


def packs(benchmark: DataFrame, size: int = SHINGLE_WORDS, most: int = PACK_WORDS) -> Iterator[Items]:
    """The benchmark in packs of about ``most`` words each."""
    items = benchmark.select("item_id", "text").filter(F.col("text").isNotNull())
    total = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    count = max(1, -(-total // most))
    for number in range(count):
        pack = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == number)
        rows = sorted(((r["item_id"], r["text"]) for r in pack.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        yield Items(rows, size)


def _hashes() -> WordHashes:
    return worker_memory("words").setdefault("word_hashes", WordHashes())


def contaminated(docs: DataFrame, benchmark: DataFrame, *, threshold: float = NEAR, size: int = SHINGLE_WORDS) -> DataFrame:
    """Benchmark items found in ``docs(doc_id, text)``: one row per document row and item.

    Result: doc_id, item_id, similarity (of the most similar run), first_word (its place, from 0) and
    n_words.  Shingles have ``size`` words; an item of fewer words is one shingle.  A document shorter
    than an item is compared as a whole.  Items and documents without words match nothing; items with
    equal texts are each reported; repeated document rows are each reported.  An empty table on either
    side gives an empty result; other columns are ignored.
    """
    ident, item = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {ident}, item_id {item}, similarity double, first_word long, n_words long"
    found = None
    for items in packs(benchmark, size):
        sent = docs.sparkSession.sparkContext.broadcast(items.plain())

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[dict]:
            items, hashes = Items.from_plain(sent.value), _hashes()
            for batch in batches:
                out = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    out += [(doc_id, *m) for m in items.matches(hashes.of(words(text)), threshold)]
                yield dict(zip(("doc_id", "item_id", "similarity", "first_word", "n_words"), zip(*out) if out else [[]] * 5))

        part = rows_of(docs.select("doc_id", "text"), schema, run)
        found = part if found is None else found.unionByName(part)
    return found


def clean(docs: DataFrame, benchmark: DataFrame, *, threshold: float = NEAR, size: int = SHINGLE_WORDS) -> DataFrame:
    """``docs`` without the rows that contain a benchmark item (see ``contaminated``).

    All columns stay, whatever their names.  Null and empty texts contain nothing and stay, repeated rows stay or go
    together, and an empty table on either side leaves ``docs`` as it is.
    """
    for items in packs(benchmark, size):
        sent = docs.sparkSession.sparkContext.broadcast(items.plain())

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items, hashes = Items.from_plain(sent.value), _hashes()
            for batch in batches:
                keep = [not items.matches(hashes.of(words(t)), threshold) for t in batch.column("text").to_pylist()]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def oracle(threshold: float = NEAR, size: int = SHINGLE_WORDS) -> str:
    """Every run of an item's length that shares a shingle with it, by exact weighted similarity.

    Items are taken to have at least ``size`` words, and ids to be unique.
    """
    words_of = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')"
    return f"""
WITH texts AS (
  SELECT 'd' AS kind, doc_id AS id, {words_of} AS w FROM documents UNION ALL
  SELECT 'i', item_id, {words_of} FROM benchmark
),
grams AS (
  SELECT kind, id, pos, array_to_string(w[pos + 1 : pos + {size}], ' ') AS gram, len(w) - {size - 1} AS n
  FROM (SELECT *, unnest(range(0, len(w) - {size - 1})) AS pos FROM texts)
),
items AS (SELECT id AS item_id, gram, n AS m, count(*) AS weight FROM grams WHERE kind = 'i' GROUP BY ALL),
hits AS (
  SELECT g.id AS doc_id, item_id, pos, gram, weight, m, n, least(m, n) AS run
  FROM grams g JOIN items USING (gram) WHERE kind = 'd'
),
starts AS (
  SELECT DISTINCT doc_id, item_id, m, run, unnest(range(greatest(0, pos - run + 1), least(pos, n - run) + 1)) AS start FROM hits
),
shared AS (
  SELECT s.doc_id, s.item_id, s.m, s.run, s.start, h.gram, least(count(*), any_value(h.weight)) AS c
  FROM starts s JOIN hits h ON h.doc_id = s.doc_id AND h.item_id = s.item_id AND h.pos BETWEEN s.start AND s.start + s.run - 1
  GROUP BY ALL
),
alike AS (
  SELECT doc_id, item_id, start, run, CAST(sum(c) AS DOUBLE) / (run + m - sum(c)) AS similarity FROM shared GROUP BY doc_id, item_id, m, run, start
)
SELECT doc_id, item_id, similarity, start AS first_word, run + {size - 1} AS n_words FROM alike WHERE similarity >= {threshold}
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1
"""
