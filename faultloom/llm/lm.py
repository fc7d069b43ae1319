"""Language model scoring by a hashed maximum-entropy model with a class-factored softmax.

Tokens are the lower-cased whitespace pieces of a text and one end.  The probability of a token given
those before it is that of its class times that of the token in its class.  The most frequent words
fill classes of equal size, and a softmax inside the class picks one of them; every other word
belongs to a class by the letters it ends in and has its smoothed share of that class.  Both
softmaxes are log-linear in hashed features: the word before, the two words before together, and
single words further back (skips).  Weights start at the unigram distribution and are trained over
every training document: the documents are dealt into parts by hash, in each round gradient steps are
taken on some of the parts from common weights, and the changes are averaged per weight row by how
often each part used it.  Rows, parts and rounds follow the number of training tokens.

The unigram base needs the count of every token.  The most frequent tokens, a table of bounded size,
are looked up where the text is read; the others are joined to their counts by a shuffle.
"""

import math
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frequent, mixed, rows_of, worker_memory, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Classes of frequent words and words in each; classes of all other words, by their ending.
CLASSES = 32
CLASS_WORDS = 32
ENDINGS = 16
#: Fewest bits of the feature hash (the weights are 2**bits rows; see ``feature_bits``) and fewest rounds (see ``fit``).
BITS = 12
ROUNDS = 3
#: Tokens, about, that are learned from one after the other before changes are averaged.
PART_TOKENS = 1 << 21
RATE = 0.1
STEP_TOKENS = 8192
#: The frequent tokens sent to every task: at most so many, each at most so long, together at most so many bytes.
HEAD_TOKENS = 1 << 18
HEAD_TOKEN_BYTES = 64
HEAD_BYTES = 8 << 20
#: Word hashes a worker remembers.
HASH_CACHE = 200_000
#: Weight rows that travel together.
BLOCK_ROWS = 256

END = b"\n"
_FRONT = 3  # tokens of context; each document starts with as many blanks
_A = np.uint64(0x9E3779B97F4A7C15)
_C = np.uint64(0xC2B2AE3D27D4EB4F)


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Number of words of each text, and the words of all: A-Z in lower case, cut at space and the control characters tab to carriage return."""
    lower = pc.ascii_trim_whitespace(pc.ascii_lower(texts))
    words = pc.ascii_split_whitespace(pc.if_else(pc.equal(pc.binary_length(lower), 0), pa.scalar(None, lower.type), lower))
    return pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64), words.flatten()


def as_bytes(words: pa.Array) -> list[bytes]:
    return words.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()


def ending(token: bytes) -> int:
    """Class of a rare word: a hash of its last two bytes before closing punctuation."""
    return xxhash.xxh32_intdigest((token.rstrip(b".,;:!?)\"'|&") or token)[-2:]) % ENDINGS


class TokenHashes(dict):
    """64-bit context hash and ending class of tokens, remembered up to a fixed number."""

    def __missing__(self, token: bytes) -> tuple[int, int]:
        value = (xxhash.xxh3_64_intdigest(token), ending(token))
        if len(self) < HASH_CACHE:
            self[token] = value
        return value


class Index(dict):
    """Place of the frequent tokens; -1 for others."""

    def __missing__(self, token: bytes) -> int:
        return -1


@dataclass
class Vocabulary:
    """The frequent tokens in order of count, and what the distribution of the others needs."""

    tokens: list[bytes]
    counts: np.ndarray
    total: int
    distinct: int
    ending_mass: np.ndarray
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    @property
    def top(self) -> int:
        return min(CLASSES * CLASS_WORDS, len(self.tokens))

    def plain(self) -> tuple:
        """What workers unpickle must not need this package."""
        return self.tokens, self.counts, self.total, self.distinct, self.ending_mass, self.name

    def log_norm(self) -> float:
        return math.log10(self.total + 0.5 * (self.distinct + 1))

    def tables(self) -> dict:
        """Per frequent token: context hash, target and log10(count + 0.5); a worker makes them once."""
        memory = worker_memory(f"lm {self.name}")
        if "lm" not in memory:
            hashes = np.array([xxhash.xxh3_64_intdigest(t) for t in self.tokens], np.uint64)
            target = np.array([i if i < self.top else CLASSES * CLASS_WORDS + ending(t) for i, t in enumerate(self.tokens)], np.int32)
            memory["lm"] = {
                "index": Index(zip(self.tokens, range(len(self.tokens)))),
                "hash": np.append(hashes, np.uint64(0)),
                "target": np.append(target, np.int32(0)),
                "log": np.append(np.log10(self.counts + 0.5), 0.0),
                "other": TokenHashes(),
            }
        return memory["lm"]


class Coded:
    """Texts as arrays: context hashes with blanks in front of each text, targets, and where each text's tokens are.

    Tokens are looked up once for each distinct one: ``tokens`` are these, ``number`` is the place of each token among them.
    """

    def __init__(self, texts: pa.Array | list[str | None], tables: dict):
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        lengths, words = words_of(texts)
        words = words.dictionary_encode()
        self.lengths = lengths + 1
        self.tokens = [*as_bytes(words.dictionary), END]
        self.number = np.full(len(words) + len(texts), len(self.tokens) - 1, np.int32)
        self.document = np.repeat(np.arange(len(texts)), self.lengths)
        self.number[np.arange(len(words)) + np.repeat(np.arange(len(texts)), lengths)] = words.indices.to_numpy()
        place = np.fromiter(map(tables["index"].__getitem__, self.tokens), np.int32, len(self.tokens))
        hashes, target = tables["hash"][place], tables["target"][place]
        rare = np.flatnonzero(place < 0)
        if len(rare):
            other = [tables["other"][self.tokens[i]] for i in rare.tolist()]
            hashes[rare] = np.fromiter((h for h, _ in other), np.uint64, len(other))
            target[rare] = np.fromiter((e for _, e in other), np.int32, len(other)) + CLASSES * CLASS_WORDS
        self.place, self.hashes, self.target = place[self.number], hashes[self.number], target[self.number]
        self.rare = np.flatnonzero(self.place < 0)
        self.context = np.zeros(len(self.place) + _FRONT * len(texts), np.uint64)
        self.at = np.arange(len(self.place)) + _FRONT * (self.document + 1)
        self.context[self.at] = self.hashes


def class_of(target: np.ndarray) -> np.ndarray:
    frequent = CLASSES * CLASS_WORDS
    return np.where(target < frequent, target // CLASS_WORDS, CLASSES + target - frequent)


def class_features(context: np.ndarray, at: np.ndarray, bits: int) -> np.ndarray:
    """Rows of the class weights: the word before, two words before together, and the second and third word back."""
    a, b, c = context[at - 1], context[at - 2], context[at - 3]
    down = np.uint64(64 - bits)
    return np.stack(
        [mixed(a * _A + np.uint64(1)) >> down, mixed(a * _A + mixed(b + np.uint64(2))) >> down,
         mixed(b * _A + np.uint64(3)) >> down, mixed(c * _A + np.uint64(3)) >> down]
    ).astype(np.int32)


def word_features(context: np.ndarray, at: np.ndarray, classes: np.ndarray, bits: int) -> np.ndarray:
    """Rows of the weights inside a class: the word before and the second word back, each with the class."""
    a, b = context[at - 1], context[at - 2]
    down, of_class = np.uint64(64 - bits), classes.astype(np.uint64) * _C
    return np.stack([mixed(a * _A + of_class + np.uint64(5)) >> down, mixed(b * _A + of_class + np.uint64(6)) >> down]).astype(np.int32)


def softmax(weights: np.ndarray, start: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Probabilities for the sum of the feature rows' weights and the starting log-odds."""
    scores = np.take(weights, rows[0], axis=0)
    for row in rows[1:]:
        scores += np.take(weights, row, axis=0)
    scores += start
    np.clip(scores, -60, 60, out=scores)
    np.exp(scores, out=scores)
    scores *= (1 / (scores @ np.ones(scores.shape[1], np.float32)))[:, None]
    return scores


def summed_by_row(rows: np.ndarray, gradient: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct rows, how often each occurs, sum of the gradients of its occurrences); ``rows`` is features x tokens."""
    count = rows.shape[1]
    flat = rows.ravel()
    # Keys below 2**16 sort by radix.
    order = np.argsort(flat.astype(np.uint16) if flat.max() < 1 << 16 else flat, kind="stable")
    ordered = flat[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    times = np.diff(np.append(first, len(flat)))
    by_times = np.argsort(-times, kind="stable")
    first, times = first[by_times], times[by_times]
    token = order % count
    sums = np.take(gradient, token[first], axis=0)
    often = int(np.searchsorted(-times, -40))  # the first so many rows occur at least 40 times
    for i in range(often):
        sums[i] = np.take(gradient, token[first[i] : first[i] + times[i]], axis=0).sum(axis=0)
    for nth in range(1, 40):
        stop = int(np.searchsorted(-times, -nth))  # rows that occur more than nth times
        if stop <= often:
            break
        sums[often:stop] += np.take(gradient, token[first[often:stop] + nth], axis=0)
    return ordered[first], times, sums


class Weights:
    """Both weight tables with the running squares of their rows' gradients and how often rows were used."""

    @classmethod
    def of(cls, fields: dict) -> "Weights":
        """From the fields of other weights, which are plain arrays."""
        out = cls.__new__(cls)
        out.__dict__.update(fields)
        return out

    def __init__(self, vocabulary: Vocabulary, bits: int = BITS):
        self.bits = bits
        n_classes = CLASSES + ENDINGS
        self.tables = [np.zeros((1 << bits, n_classes), np.float32), np.zeros((1 << bits, CLASS_WORDS), np.float32)]
        self.squares = [np.full(1 << bits, 1e-3, np.float32) for _ in range(2)]
        self.used = [np.zeros(1 << bits, np.float32) for _ in range(2)]
        frequent = np.zeros(CLASSES * CLASS_WORDS)
        frequent[: vocabulary.top] = vocabulary.counts[: vocabulary.top] + 0.5
        mass = np.concatenate([frequent.reshape(CLASSES, CLASS_WORDS).sum(axis=1), vocabulary.ending_mass]) + 1e-6
        self.class_start = np.log(mass / mass.sum()).astype(np.float32)
        inside = np.maximum(frequent.reshape(CLASSES, CLASS_WORDS), 1e-6)
        self.word_start = np.log(inside / inside.sum(axis=1, keepdims=True)).astype(np.float32)

    def _step(self, which: int, rows: np.ndarray, error: np.ndarray, rate: float) -> None:
        distinct, times, sums = summed_by_row(rows, error)
        squares = self.squares[which]
        now = np.take(squares, distinct) + np.einsum("ij,ij->i", sums, sums) / sums.shape[1]
        squares[distinct] = now
        sums *= (-rate / np.sqrt(now))[:, None]
        table = self.tables[which]
        sums += np.take(table, distinct, axis=0)
        # Rows are written as single items: one copy each.
        whole = np.dtype((np.void, table.itemsize * table.shape[1]))
        table.view(whole)[distinct, 0] = sums.view(whole)[:, 0]
        self.used[which][distinct] += times

    def learn(self, coded: Coded, rate: float = RATE) -> None:
        """One pass of gradient steps over the tokens."""
        for low in range(0, len(coded.at), STEP_TOKENS):
            at, target = coded.at[low : low + STEP_TOKENS], coded.target[low : low + STEP_TOKENS]
            classes = class_of(target)
            rows = class_features(coded.context, at, self.bits)
            error = softmax(self.tables[0], self.class_start, rows)
            error[np.arange(len(at)), classes] -= 1
            self._step(0, rows, error, rate)
            inner = np.flatnonzero(target < CLASSES * CLASS_WORDS)
            if len(inner):
                rows = word_features(coded.context, at[inner], classes[inner], self.bits)
                error = softmax(self.tables[1], self.word_start[classes[inner]], rows)
                error[np.arange(len(inner)), target[inner] % CLASS_WORDS] -= 1
                self._step(1, rows, error, rate)

    def log10(self, coded: Coded) -> np.ndarray:
        """Per token: log10 of its class's probability, and of a frequent word's in its class."""
        out = np.empty(len(coded.at))
        for low in range(0, len(coded.at), STEP_TOKENS):
            at, target = coded.at[low : low + STEP_TOKENS], coded.target[low : low + STEP_TOKENS]
            classes = class_of(target)
            chance = softmax(self.tables[0], self.class_start, class_features(coded.context, at, self.bits))
            part = np.log10(chance[np.arange(len(at)), classes].astype(np.float64))
            inner = np.flatnonzero(target < CLASSES * CLASS_WORDS)
            if len(inner):
                rows = word_features(coded.context, at[inner], classes[inner], self.bits)
                chance = softmax(self.tables[1], self.word_start[classes[inner]], rows)
                part[inner] += np.log10(chance[np.arange(len(inner)), target[inner] % CLASS_WORDS].astype(np.float64))
            out[low : low + STEP_TOKENS] = part
        return out

    def packed(self, which_rows: slice) -> np.ndarray:
        return np.concatenate(
            [x for t, s in zip(self.tables, self.squares) for x in (t[which_rows], s[which_rows, None])], axis=1
        )


def feature_bits(tokens: int) -> int:
    """Bits of the feature hash for so many training tokens: rows grow with their square root (15 bits at 60 million).

    The weights are held whole by the driver and every task, about 350 bytes a row, so they may not
    grow as fast as the corpus.
    """
    return max(BITS, int(math.log2(max(1, tokens)) / 2 + 2.1))


def _changes(start: Weights, now: Weights) -> Iterator[tuple[int, bytes]]:
    """Per block of rows: changes times use, and use, of both tables, as one array that can be summed."""
    for block, low in enumerate(range(0, 1 << start.bits, BLOCK_ROWS)):
        rows = slice(low, low + BLOCK_ROWS)
        if not any(u[rows].any() for u in now.used):
            continue
        parts = []
        for which in range(2):
            used = now.used[which][rows, None]
            parts += [
                (now.tables[which][rows] - start.tables[which][rows]) * used,
                (now.squares[which][rows] - start.squares[which][rows])[:, None] * used,
                used,
            ]
        yield block, np.concatenate(parts, axis=1).astype(np.float32).tobytes()


def _added(batches: Iterator[pa.RecordBatch], by_salt: bool = False) -> Iterator[dict]:
    """Sums of the arrays of each block in order of the rows; a task holds at most one array per block."""
    sums: dict[tuple, np.ndarray] = {}
    for batch in batches:
        for block, salt, change in zip(*(batch.column(c).to_pylist() for c in ("block", "salt", "change"))):
            array = np.frombuffer(change, np.float32)
            key = (block, salt if by_salt else 0)
            if key in sums:
                sums[key] += array
            else:
                sums[key] = array.copy()
    yield {"block": [b for b, _ in sums], "salt": [s for _, s in sums], "part": [0] * len(sums), "change": [a.tobytes() for a in sums.values()]}


def count_tokens(docs: DataFrame) -> DataFrame:
    """(token, c): how often each token occurs in ``docs(text)``, ends included."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = words_of(batch.column(0))[1].value_counts()
            yield {"token": [*as_bytes(found.field("values")), END], "c": np.append(found.field("counts").to_numpy(), batch.num_rows)}

    return written(rows_of(docs.select("text"), "token binary, c long", gather).groupBy("token").agg(F.sum("c").alias("c")), "token_counts")


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The bounded head of the counts, and the mass of each ending class over all other tokens."""
    head = frequent(counts, "token", "c", rows=HEAD_TOKENS, word_bytes=HEAD_TOKEN_BYTES, size=HEAD_BYTES)
    tokens, numbers = head.column("token").to_pylist(), head.column("c").to_pylist()

    def endings(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        mass, total, distinct = np.zeros(ENDINGS), np.zeros(ENDINGS, np.int64), np.zeros(ENDINGS, np.int64)
        for batch in batches:
            group = np.fromiter(map(ending, batch.column("token").to_pylist()), np.int64, batch.num_rows)
            c = batch.column("c").to_numpy()
            mass += np.bincount(group, c + 0.5, ENDINGS)
            total += np.bincount(group, c, ENDINGS).astype(np.int64)
            distinct += np.bincount(group, minlength=ENDINGS)
        yield {"ending": list(range(ENDINGS)), "mass": mass, "total": total, "distinct": distinct}

    grouped = (
        rows_of(counts, "ending int, mass double, total long, distinct long", endings)
        .groupBy("ending")
        .agg(F.sum("mass"), F.sum("total"), F.sum("distinct"))
        .orderBy("ending")
        .collect()
    )
    mass = np.zeros(ENDINGS)
    for row in grouped:
        mass[row[0]] = row[1]
    top = min(CLASSES * CLASS_WORDS, len(tokens))
    for token, c in zip(tokens[:top], numbers[:top]):
        mass[ending(token)] -= c + 0.5
    # Half a count per class is for words never seen.
    mass = np.maximum(mass, 0) + 0.5
    return Vocabulary(tokens, np.array(numbers, np.int64), sum(r[2] for r in grouped), sum(r[3] for r in grouped), mass)


def fit(
    docs: DataFrame, words: Vocabulary, *, rounds: int | None = None, bits: int | None = None, rate: float = RATE, ident: str = "doc_id",
    part_tokens: int = PART_TOKENS,
) -> Weights:
    """Train on every row of ``docs(doc_id, text)``, dealt by hash of id and text into parts of about ``part_tokens`` tokens.

    Each round takes one slice of the parts; every part is learned from alone, in order of the hash, and
    the changes are added in order of the parts, so the weights do not depend on cores or file splits.  There are
    three rounds, or half the root of the number of parts if that is more.  What the parts send back is
    proportional to their number; it is added in two steps, so what one task holds, and what the driver gets,
    is the size of the weights.
    """
    spark = docs.sparkSession
    weights = Weights(words, feature_bits(words.total) if bits is None else bits)
    parts = max(1, -(-words.total // part_tokens))
    rounds = rounds or max(ROUNDS, math.isqrt(parts) // 2)
    parts = max(parts, rounds)
    salts = max(1, math.isqrt(parts // rounds))
    vocabulary_sent = spark.sparkContext.broadcast(words.plain())
    schema = "block int, salt int, part int, change binary"
    hashed = docs.select("text", F.xxhash64(ident, "text").alias("hash")).withColumn("part", F.pmod("hash", F.lit(parts)).cast("int"))
    for turn in range(rounds):
        sent = spark.sparkContext.broadcast(weights.__dict__)

        def learn(batches: Iterator[pa.RecordBatch], sent=sent, pace=rate / (1 + turn)) -> Iterator[dict]:
            start, tables = Weights.of(sent.value), Vocabulary(*vocabulary_sent.value).tables()
            part, now, waiting = None, None, []

            def step() -> None:
                now.learn(Coded(waiting, tables), pace)
                waiting.clear()

            def finish() -> Iterator[dict]:
                if waiting:
                    step()
                for block, change in _changes(start, now):
                    yield {"block": [block], "salt": [part % salts], "part": [part], "change": [change]}

            for batch in batches:
                for text, own in zip(batch.column("text").to_pylist(), batch.column("part").to_pylist()):
                    if own != part:
                        if part is not None:
                            yield from finish()
                        part, now = own, Weights.of(sent.value)
                        now.tables, now.squares = [t.copy() for t in start.tables], [s.copy() for s in start.squares]
                        now.used = [np.zeros_like(u) for u in start.used]
                    waiting.append(text)
                    if len(waiting) == 256:
                        step()
            if part is not None:
                yield from finish()

        # A few partitions for each part, so that few tasks get more than one.
        dealt = hashed.filter(F.pmod("part", F.lit(rounds)) == turn).repartition(3 * -(-parts // rounds), "part").sortWithinPartitions("part", "hash")
        changes = rows_of(dealt.select("text", "part"), schema, learn)
        once = rows_of(changes.repartition("block", "salt").sortWithinPartitions("block", "salt", "part"), schema, lambda batches: _added(batches, True))
        for row in written(rows_of(once.repartition("block").sortWithinPartitions("block", "salt"), schema, _added), "weights").collect():
            rows = slice(row["block"] * BLOCK_ROWS, (row["block"] + 1) * BLOCK_ROWS)
            change = np.frombuffer(row["change"], np.float32).reshape(BLOCK_ROWS, -1)
            low = 0
            for which in range(2):
                wide = weights.tables[which].shape[1]
                used = np.maximum(change[:, low + wide + 1 : low + wide + 2], 1e-9)
                weights.tables[which][rows] += change[:, low : low + wide] / used
                weights.squares[which][rows] += (change[:, low + wide : low + wide + 1] / used)[:, 0]
                low += wide + 2
    return weights


def score(df: DataFrame, counts: DataFrame, words: Vocabulary, weights: Weights) -> DataFrame:
    """Model and unigram log10 probabilities of every whole text of ``df(doc_id, text)``.

    Result, one row per input row: doc_id, n_tokens (with the end), n_known (tokens seen in training),
    train_tokens, base_score (unigram, half a count added to each of the distinct tokens and one more),
    score (the model).  A null text is empty: its only token is the end.  Repeated rows are scored each;
    other columns are ignored; an empty table gives an empty result.  A model of no training tokens
    gives every token the same base probability.
    """
    spark = df.sparkSession
    ident = df.schema["doc_id"].dataType.simpleString()
    sent = spark.sparkContext.broadcast((words.plain(), weights.__dict__))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        words, weights = Vocabulary(*sent.value[0]), Weights.of(sent.value[1])
        tables, log_mass = words.tables(), np.log10(words.ending_mass)
        frequent = CLASSES * CLASS_WORDS
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                coded = Coded(part.column(1), tables)
                n = part.num_rows
                chance = weights.log10(coded)
                tail = coded.target >= frequent
                chance[tail] -= log_mass[coded.target[tail] - frequent]
                logs = tables["log"][coded.place]  # 0 for tokens whose count is not here
                chance[tail] += logs[tail]
                known = np.bincount(coded.document, coded.place >= 0, n).astype(np.int64)
                # Each document's distinct tokens whose count is not here, and how often it has them.
                rest, times = np.unique(coded.document[coded.rare] * len(coded.tokens) + coded.number[coded.rare], return_counts=True)
                owner, token = np.divmod(rest, len(coded.tokens))
                rows = np.arange(number + 1, number + n + 1)
                number += n
                blank = [None] * len(rest)
                yield {
                    "row": np.concatenate([rows, rows[owner]]),
                    "doc_id": [*part.column(0).to_pylist(), *blank],
                    "n_tokens": [*coded.lengths.tolist(), *blank],
                    "known": [*known.tolist(), *blank],
                    "base": [*np.bincount(coded.document, logs, n).tolist(), *blank],
                    "model": [*np.bincount(coded.document, chance, n).tolist(), *blank],
                    "token": [*[None] * n, *(coded.tokens[t] for t in token.tolist())],
                    "n": [*[None] * n, *times.tolist()],
                }

    schema = f"row long, doc_id {ident}, n_tokens long, known long, base double, model double, token binary, n int"
    # Written once, so the row numbers of both parts agree whatever is computed again.
    parts = written(rows_of(df.select("doc_id", "text"), schema, run), "lm_parts")
    c = F.coalesce("c", F.lit(0))
    tail = (
        parts.filter(F.col("token").isNotNull())
        .select("row", "token", "n")
        .join(counts, "token", "left")
        .groupBy("row")
        .agg(F.sum(F.col("n") * F.log10(c + 0.5)).alias("tail"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("tail_known"))
    )
    more = F.coalesce("tail", F.lit(0.0))
    whole = parts.filter(F.col("token").isNull()).drop("token", "n")
    return whole.join(tail, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("tail_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(words.total).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * F.lit(words.log_norm())).alias("base_score"),
        (F.col("model") + more).alias("score"),
    )
