"""Token ids as Arrow files of equal-length sequences.

Documents are dealt into ranges of ascending id; each task encodes its range, appends the end id to
every document and packs the ids one after another into sequences of one length, written as an Arrow
file whose batches hold a fixed-size list of ids and a fixed-size list of mask bits.  A reader maps
the file into memory and reaches any sequence, or any run of ids, without copying or parsing.  Only
the last sequence of a file is padded; its mask says how far it is real.  A Parquet index holds each
document's place.  Files are written under another name and renamed, so a task that runs twice leaves
one whole file.
"""

import os
import re
import sys
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import rows_of, shared_folder, worker_memory, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Ids of one sequence, and sequences of one Arrow batch.
SEQUENCE = 2048
BATCH_SEQUENCES = 128
#: Pieces of text a worker remembers with their ids (two generations of this many), and the longest one in characters.
PIECE_CACHE = 300_000
PIECE_LENGTH = 64
#: Index rows passed on at once.
FLUSH = 5_000

# Without İ, whose lower case is a letter and a combining mark, which joins the mark that follows.
_LATIN = "[A-Za-zÀ-ÖØ-öø-įı-ɏ]"
# A run of Latin letters that white space or another ASCII character ends, or else all up to white space.
_PIECE = re.compile(rf"{_LATIN}++(?=[\x00-@\[-`{{-\x7f]|\Z)|[^ \t-\r]+")
_BEYOND_LATIN = re.compile("[^\x00-ɏ]|İ")
_WORD = re.compile(f"{_LATIN}+")


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: visible Latin-1 bytes stand for themselves, the others follow from 256 on in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) if b in own else chr(256 + others.index(b)) for b in range(256)}


class WordEncoder:
    """Ids of texts under a byte-level tokenizer file whose pre-tokens hold no white space.

    Such a tokenizer encodes the pieces between white space independently, and a run of letters apart
    from the mark that follows it, so a piece is encoded by the library once and remembered.  Texts
    are split at ASCII white space only; every other character is left to the library.  Runs of Latin
    letters go straight to the library's model, after the lower-casing and byte alphabet that the file
    asks for; whether that gives the same ids is tried first, and if not they go the common way.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.letters = byte_letters()
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        trial = ["the", "école", "straße", "ÿ", "œuvre", "ōžą", "international"]
        self.direct = [self._direct(w) for w in trial] == self._common(trial)
        self.lower = self._common(["Word É"]) == self._common(["word é"])

    def _common(self, pieces: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(pieces, add_special_tokens=False)]

    def _direct(self, word: str) -> bytes:
        spelled = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return np.array([t.id for t in self.model.tokenize(spelled)], "<u4").tobytes()

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        found, rest = {}, []
        for piece in pieces:
            if self.direct and piece.islower() and _WORD.fullmatch(piece) and not _BEYOND_LATIN.search(piece):
                found[piece] = self._direct(piece)
            else:
                rest.append(piece)
        found.update(zip(rest, self._common(rest)))
        return found

    def _pieces(self, text: str | None) -> list[str]:
        if not text:
            return []
        # Lower case early only where it means the same before and after the library's own steps.
        if self.lower and "<|" not in text and (text.isascii() or not _BEYOND_LATIN.search(text)):
            text = text.lower()
        return _PIECE.findall(text)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        split = [self._pieces(t) for t in texts]
        young, old = self.young, self.old
        new = [p for p in set().union(*split) if p not in young]
        kept = {p: old[p] for p in new if p in old}
        young.update(kept)
        young.update(self._learn([p for p in new if p not in kept]))
        out = [b"".join(map(young.__getitem__, pieces)) for pieces in split]
        for piece in new:
            if len(piece) > PIECE_LENGTH:
                del young[piece]
        if len(young) > PIECE_CACHE:
            self.young, self.old = {}, young
        return out


def id_type(vocabulary: int) -> pa.DataType:
    return pa.uint16() if vocabulary <= 1 << 16 else pa.uint32()


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class SequenceWriter:
    """Packs runs of ids into sequences and writes them as one Arrow file."""

    def __init__(self, uri: str, ids: pa.DataType, length: int = SEQUENCE, pad: int = 0):
        self.store, self.path = open_store(uri)
        self.temporary = f"{self.path}.{uuid.uuid4().hex}"
        self.length, self.pad, self.ids = length, pad, ids
        self.schema = pa.schema([("input_ids", pa.list_(ids, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.store.create_dir(os.path.dirname(self.path), recursive=True)
        self.out = self.store.open_output_stream(self.temporary)
        self.file = pa.ipc.new_file(self.out, self.schema)
        self.held: list[np.ndarray] = []
        self.n_held = self.total = 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n_held += len(ids)
        self.total += len(ids)
        if self.n_held >= self.length * BATCH_SEQUENCES:
            self._write(False)

    def _write(self, last: bool) -> None:
        flat = np.concatenate(self.held) if self.held else np.empty(0, np.uint32)
        step = self.length * BATCH_SEQUENCES
        stop = len(flat) if last else len(flat) // step * step
        for at in range(0, stop, step):
            part = flat[at : min(at + step, stop)].astype(self.ids.to_pandas_dtype())
            short = -len(part) % self.length
            mask = np.ones(len(part) + short, bool)
            if short:
                mask[len(part) :] = False
                part = np.concatenate([part, np.full(short, self.pad, part.dtype)])
            self.file.write_batch(
                pa.record_batch(
                    [
                        pa.FixedSizeListArray.from_arrays(pa.array(part, self.ids), self.length),
                        pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length),
                    ],
                    schema=self.schema,
                )
            )
        self.held = [] if last else [flat[stop:]]
        self.n_held = len(flat) - stop

    def close(self) -> None:
        self._write(True)
        self.file.close()
        self.out.close()
        self.store.move(self.temporary, self.path)


class SequenceFile:
    """Random access to a written file; a local file is mapped, so ids are views into it."""

    def __init__(self, uri: str):
        store, path = open_store(uri)
        local = isinstance(store, pafs.LocalFileSystem)
        self.reader = pa.ipc.open_file(pa.memory_map(path) if local else store.open_input_file(path))
        self.length = self.reader.schema.field("input_ids").type.list_size
        self._at = -1
        self._ids = self._mask = None

    def _batch(self, number: int) -> None:
        if number != self._at:
            batch = self.reader.get_batch(number)
            self._ids = batch.column("input_ids").flatten().to_numpy(zero_copy_only=True)
            self._mask, self._at = batch.column("mask").flatten(), number

    def __len__(self) -> int:
        batches = self.reader.num_record_batches
        return 0 if not batches else (batches - 1) * BATCH_SEQUENCES + self.reader.get_batch(batches - 1).num_rows

    def sequence(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of one sequence."""
        batch, row = divmod(number, BATCH_SEQUENCES)
        self._batch(batch)
        part = slice(row * self.length, (row + 1) * self.length)
        return self._ids[part], self._mask[part].to_numpy(zero_copy_only=False)

    def run(self, start: int, count: int) -> np.ndarray:
        """``count`` ids from the file's ``start``-th on, whatever sequences they lie in."""
        step = self.length * BATCH_SEQUENCES
        parts = []
        while count > 0:
            batch, at = divmod(start, step)
            self._batch(batch)
            part = self._ids[at : at + count]
            if not len(part):
                raise ValueError("the file ends before the run")
            parts.append(part)
            start, count = start + len(part), count - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, np.uint16)


def write_tokens(df: DataFrame, tokenizer: str, *, end_id: int = 2, length: int = SEQUENCE, folder: str | None = None) -> tuple[DataFrame, str]:
    """Encode ``df(doc_id, text)`` and write the sequence files; returns the index and the folder.

    The index, one row per document: part (file number), doc_id, place (its first id in the file),
    n_tokens (with the end id).  Files ascend by doc_id, null ids first; repeated ids stay separate
    documents in order of text hash.  A null text is empty: its only id is the end id.  How many files there
    are follows ``spark.sql.shuffle.partitions``.
    """
    folder = folder or shared_folder(df.sparkSession, "tokens")
    ident = df.schema["doc_id"].dataType.simpleString()
    end = np.array([end_id], "<u4")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        part = TaskContext.get().partitionId()
        encoder = writer = None
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                if writer is None:
                    memory = worker_memory("token_files")
                    encoder = memory.setdefault(("encoder", tokenizer), None) or WordEncoder(tokenizer)
                    memory["encoder", tokenizer] = encoder
                    writer = SequenceWriter(file_of(folder, part), id_type(encoder.library.get_vocab_size()), length, end_id)
                out: dict[str, list] = {"part": [], "doc_id": batch.column(0).to_pylist(), "place": [], "n_tokens": []}
                for ids in encoder.encode(batch.column(1).to_pylist()):
                    flat = np.concatenate([np.frombuffer(ids, "<u4"), end])
                    out["part"].append(part)
                    out["place"].append(writer.total)
                    out["n_tokens"].append(len(flat))
                    writer.add(flat)
                yield out
        if writer:
            writer.close()

    # One id may hold a third of all rows: the hash of the text lets its rows go to several ranges.
    order = ["doc_id", F.xxhash64("text")]
    ordered = df.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order, "text")
    index = written(rows_of(ordered, f"part int, doc_id {ident}, place long, n_tokens long", write), "token_index")
    return index, folder


def file_of(folder: str, part: int) -> str:
    return f"{folder}/part-{part:06d}.arrow"


def read_tokens(index: DataFrame, folder: str) -> DataFrame:
    """Reads every document's ids back from the files: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before; the checksum is over the ids as unsigned 32-bit
    integers.  Each file is read by the task that gets its index rows, in order of place.
    """
    ident = index.schema["doc_id"].dataType.simpleString()
    totals = index.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    # One row per file; the running sum over them is the only single-task step.
    before = totals.select(
        "part", F.coalesce(F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        at, file = None, None
        for batch in batches:
            cols = batch.to_pydict()
            sums = []
            for part, place, count in zip(cols["part"], cols["place"], cols["n_tokens"]):
                if part != at:
                    at, file = part, SequenceFile(file_of(folder, part))
                sums.append(zlib.crc32(file.run(place, count).astype("<u4").tobytes()))
            yield {"part": cols["part"], "doc_id": cols["doc_id"], "place": cols["place"], "n_tokens": cols["n_tokens"], "ids_crc32": sums}

    rows = index.repartition("part").sortWithinPartitions("part", "place")
    crc = rows_of(rows, f"part int, doc_id {ident}, place long, n_tokens long, ids_crc32 long", read)
    return crc.join(before, "part").select(
        "doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_output(df: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write the files and read every document back from them (see ``write_tokens`` and ``read_tokens``).

    An empty table writes no file and gives an empty result; other columns are ignored.
    """
    index, folder = write_tokens(df, tokenizer, **options)
    return read_tokens(index, folder)


def sequences(spark: SparkSession, folder: str, index: DataFrame) -> DataFrame:
    """The files as a table: part, sequence, n_real (ids that are not padding)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for part in batch.column(0).to_pylist():
                file = SequenceFile(file_of(folder, part))
                real = [int(file.sequence(i)[1].sum()) for i in range(len(file))]
                yield {"part": [part] * len(real), "sequence": list(range(len(real))), "n_real": real}

    return rows_of(index.select("part").distinct(), "part int, sequence long, n_real int", scan)
