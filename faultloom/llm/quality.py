"""Quality classifier by supervised subword embeddings.

Each lower-cased whitespace token has a hashed vector of its own and one for every run of three or
four characters in it (with marks for its begin and end).  A document is the average of its vectors;
a softmax over two classes reads it.  Vectors and softmax are learned together by stochastic gradient
descent, one document at a time, in numpy, on a bounded sample of the labelled documents.  Since the
average and the softmax's input are linear, scoring needs one number per bucket: what its vector adds
to the difference of the two classes.
"""

import sys
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mixed, rows_of, worker_memory

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUCKETS = 1 << 17
DIMENSIONS = 16
GRAMS = (3, 4)
#: The sample that is learned from: at most so many labelled documents with at most so many bytes of text in all.
SAMPLE_ROWS = 6000
SAMPLE_BYTES = 32 << 20
EPOCHS = 5
RATE = 0.5
#: Tokens a worker remembers with their value (two generations of this many).
TOKEN_CACHE = 250_000

_BEGIN, _END, _REPEAT = "\x02", "\x03", "\x04"
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xA0761D6478BD642F], np.uint64)


def tokens_of(text: str | None) -> list[str]:
    """Lower-cased whitespace tokens, a mark for each that repeats the one before, and one closing token.

    An average of vectors does not see order; the marks tell it of words said over and over.  The
    closing token leaves no document without features.
    """
    tokens = (text or "").lower().split()
    return [*tokens, *[_REPEAT] * sum(map(eq, tokens, tokens[1:])), _END]


def features(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Flat (token number, bucket) pairs: every token's own bucket and those of its character runs."""
    owners = [np.arange(len(tokens))]
    buckets = [np.array([xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) for t in tokens], np.uint64)]
    marked = [f"{_BEGIN}{t}{_END}" for t in tokens]
    chars = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(tokens)), [len(m) for m in marked])
    for n in GRAMS:
        if len(chars) < n:
            continue
        inside = owner[: len(owner) - n + 1] == owner[n - 1 :]
        runs = np.full(len(chars) - n + 1, n, np.uint64)
        for j in range(n):
            runs += (chars[j : len(chars) - n + 1 + j] + np.uint64(1)) * _MULTIPLIERS[j]
        owners.append(owner[: len(owner) - n + 1][inside])
        buckets.append(mixed(runs[inside]))
    flat = np.concatenate(buckets) & np.uint64(BUCKETS - 1)
    return np.concatenate(owners), flat.astype(np.int64)


def document_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and the share each has of its features."""
    counts = Counter(tokens_of(text))
    owner, bucket = features(list(counts))
    weight = np.fromiter(counts.values(), np.float64, len(counts))[owner]
    distinct, place = np.unique(bucket, return_inverse=True)
    total = np.bincount(place, weight)
    return distinct.astype(np.int32), (total / total.sum()).astype(np.float32)


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], *, epochs: int = EPOCHS, rate: float = RATE, seed: int = 1) -> tuple[np.ndarray, float]:
    """Gradient descent over (buckets, shares, label); returns each bucket's addition to the log odds of label 1, and a constant."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    output = np.zeros((2, DIMENSIONS), np.float32)
    labels = [y for _, _, y in examples]
    rare = (sum(labels) + 0.5) / (len(labels) + 1)
    bias = np.array([0.0, np.log(rare / (1 - rare))], np.float32)
    steps, done = max(1, epochs * len(examples)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(examples)):
            buckets, shares, label = examples[i]
            lr = rate * (1 - done / steps)
            done += 1
            own = vectors[buckets]
            hidden = shares @ own
            scores = output @ hidden + bias
            scores = np.exp(scores - scores.max())
            error = scores / scores.sum()
            error[label] -= 1
            back = error @ output
            output -= lr * np.outer(error, hidden)
            bias -= 0.1 * lr * error
            # Shares of one document sum to 1; scaled by their number they act like one step per feature.
            vectors[buckets] = own - np.outer(lr * shares * min(len(shares), 100), back)
    return vectors.astype(np.float64) @ (output[1] - output[0]).astype(np.float64), float(bias[1] - bias[0])


@dataclass
class Model:
    """Log-odds weights per bucket; ``name`` tells workers which cached token values are its own."""

    weights: np.ndarray
    constant: float
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def scores(self, texts: list[str | None], memory: dict) -> np.ndarray:
        """Probability of label 1 for each text; ``memory`` remembers token values from call to call."""
        young, old = memory.setdefault("young", {}), memory.setdefault("old", {})
        split = [tokens_of(t) for t in texts]
        new = [t for t in set().union(*split) if t not in young]
        young.update((t, old[t]) for t in new if t in old)
        missing = [t for t in new if t not in young]
        for at in range(0, len(missing), 50_000):
            part = missing[at : at + 50_000]
            owner, bucket = features(part)
            # A token's value: its sum of weights, and as imaginary part how many features it has.
            sums = np.bincount(owner, self.weights[bucket], len(part)) + 1j * np.bincount(owner, minlength=len(part))
            young.update(zip(part, sums.tolist()))
        totals = np.array([sum(map(young.__getitem__, tokens)) for tokens in split], complex)
        if len(young) > TOKEN_CACHE:
            memory["young"], memory["old"] = {}, young
        odds = totals.real / np.maximum(totals.imag, 1) + self.constant
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def remainder(ident: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(ident).cast("string"), F.lit("")).cast("binary")) % modulus


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> Model:
    """Learn from ``docs(doc_id, text)`` and ``labels(doc_id, <label> 0 or 1)``.

    The sample is one text for each of the ``rows`` labelled ids of least hash that have a document, as
    far as the texts fit into ``size`` bytes; one that does not fit is passed over.  Of an id with
    several texts that of least hash counts, copies once.  Null ids and labels are left out; of an id
    labelled both ways the majority counts, ties as 1.  Without labels every document scores 0.5.
    """
    voted = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy("doc_id")
        .agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("_label"))
    )
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_hash", F.xxhash64("text"))
    length = F.octet_length("text").alias("_bytes")
    # One row per id before ids are joined, ordered or collected: copies of an id never leave their map task.
    least = texts.filter(length <= size).groupBy("doc_id").agg(F.min(F.struct("_hash", length)).alias("_least"))
    held = (
        least.join(voted, "doc_id")
        .select("doc_id", F.xxhash64("doc_id").alias("_order"), "_least._hash", "_label", "_least._bytes")
        .orderBy("_order", "doc_id")
        .limit(rows)
    )
    total, wanted = 0, []
    for *row, length_of in held.collect():
        if total + length_of <= size:
            total += length_of
            wanted.append(tuple(row))
    few = docs.sparkSession.createDataFrame(wanted, held.drop("_bytes").schema)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        seen = set()
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            new = [i for i, d in enumerate(ids) if not (d in seen or seen.add(d))]
            part = batch.take(pa.array(new, pa.int64()))
            found = [document_features(t) for t in part.column("text").to_pylist()]
            yield {
                "doc_id": part.column("doc_id"),
                "order": part.column("_order"),
                "label": part.column("_label"),
                "buckets": [b.tobytes() for b, _ in found],
                "shares": [s.tobytes() for _, s in found],
            }

    ident = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {ident}, order long, label int, buckets binary, shares binary"
    sample = rows_of(texts.join(F.broadcast(few), ["doc_id", "_hash"]), schema, extract).dropDuplicates(["doc_id"]).collect()
    sample.sort(key=lambda r: (r["order"], r["buckets"], r["shares"]))
    examples = [(np.frombuffer(r["buckets"], np.int32), np.frombuffer(r["shares"], np.float32), r["label"]) for r in sample]
    if not examples:
        return Model(np.zeros(BUCKETS), 0.0)
    return Model(*train(examples))


def score(df: DataFrame, model: Model) -> DataFrame:
    """``df`` with score (probability of label 1) and predicted (1 from 0.5 on) for each whole ``text``.

    Null texts score as empty ones; existing columns of these names are replaced; an empty table gives
    an empty result.
    """
    # A tuple: what workers unpickle must not need this package.
    sent = df.sparkSession.sparkContext.broadcast((model.weights, model.constant, model.name))
    kept = df.drop("score", "predicted")
    schema = widened(kept, "score double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*sent.value)
        memory = worker_memory(f"quality {model.name}")
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                scores = model.scores(part.column("text").to_pylist(), memory)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores)], names=[*part.schema.names, "score"])

    return kept.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def widened(df: DataFrame, more: str) -> T.StructType:
    return T.StructType([*df.schema.fields, *T._parse_datatype_string(more).fields])
