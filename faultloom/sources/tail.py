"""Log files that grow: a streaming source whose offset is a map of file to byte position.

A poll lists the folder and finds, for each file, the end of its last whole line; half a line waits for
its rest.  The offset also holds checksums of the file's beginning, so a file that was cut short or
replaced is known by its offset alone and read again from its start.  The new range of a file is read in pieces of bounded size by many tasks.  Offsets go to the
checkpoint of the query: after a restart reading goes on where it ended, and a failed batch is
read again with the same ranges.
"""

import sys
import time
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

# Send the functions of this module with the job: executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FORMAT = "growing_lines"
ENDINGS = (".log", ".txt")
SCHEMA = "path string, piece long, offset long, line string, seen timestamp"
#: Bytes that one task reads of a file, that are read at once, and lines of one batch on their way to Spark.
PIECE_BYTES = 64 << 20
BLOCK = 1 << 16
BATCH_LINES = 4096
#: Bytes of small pieces that share a task at most, and tasks that a batch is dealt over if it holds less.
PACK_BYTES = 8 << 20
FEW_TASKS = 32
#: Lengths of the beginnings whose checksums tell files apart.
HEADS = tuple(1 << i for i in range(4, 13))


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def whole_lines(file: pa.NativeFile, size: int, low: int = 0) -> int:
    """The end of the last whole line in the first ``size`` bytes; ``low`` when there is none after it."""
    end = size
    while end > low:
        start = max(low, end - BLOCK)
        file.seek(start)
        at = file.read(end - start).rfind(b"\n")
        if at >= 0:
            return start + at + 1
        end = start
    return low


def heads(file: pa.NativeFile, position: int) -> list[int]:
    """Checksums of the file's beginnings that lie before ``position``."""
    file.seek(0)
    begin = file.read(min(position, HEADS[-1]))
    return [zlib.crc32(begin[:n]) for n in HEADS if n <= len(begin)]


def follows(before: dict, now: dict) -> bool:
    """Whether a file in state ``now`` can be the one seen as ``before``, grown or unchanged."""
    if now["position"] < before["position"]:
        return False
    return all(a == b for a, b in zip(before["heads"], now["heads"]))


class Piece(InputPartition):
    """Lines that begin at ``start`` or later and before ``end``, of the new range from ``low`` to ``limit``."""

    def __init__(self, path: str, low: int, start: int, end: int, limit: int, seen: int):
        super().__init__(None)
        self.path, self.low, self.start, self.end, self.limit, self.seen = path, low, start, end, limit, seen


def pieces(start: dict, end: dict, size: int = PIECE_BYTES) -> list[Piece]:
    """What has to be read between two offsets; depends on the offsets alone."""
    out = []
    for path, now in sorted(end.items()):
        before = start.get(path)
        low = before["position"] if before and follows(before, now) else 0
        for at in range(low, now["position"], size):
            out.append(Piece(path, low, at, min(at + size, now["position"]), now["position"], now["seen"]))
    return out


class Pack(InputPartition):
    """Pieces that one task reads one after the other."""

    def __init__(self, pieces: list[Piece]):
        super().__init__(None)
        self.pieces = pieces


def packed(found: list[Piece]) -> list[Pack]:
    """Small pieces together, so tasks follow the bytes and not the files."""
    room = min(PACK_BYTES, max(1, sum(p.end - p.start for p in found) // FEW_TASKS))
    packs, held, size = [], [], 0
    for piece in found:
        if held and size + piece.end - piece.start > room:
            packs.append(Pack(held))
            held, size = [], 0
        held.append(piece)
        size += piece.end - piece.start
    return packs + ([Pack(held)] if held else [])


def lines_of(file: pa.NativeFile, piece: Piece) -> Iterator[tuple[int, bytes]]:
    """(byte offset, line without its end) of a piece; a line belongs to the piece in which it begins.

    A carriage return ends a line as well, alone or before the newline.
    """
    file.seek(piece.start)
    at, rest = piece.start, b""
    if piece.start > piece.low:
        # The line that runs into this piece belongs to the one before; it ends at the first newline from one byte earlier on.
        at = piece.start - 1
        file.seek(at)
        while True:
            block = file.read(min(BLOCK, piece.limit - at))
            if not block:
                return
            cut = block.find(b"\n")
            if cut >= 0:
                at, rest = at + cut + 1, block[cut + 1 :]
                break
            at += len(block)
    position = at + len(rest)
    while at < piece.end:
        if b"\n" not in rest:
            block = file.read(min(BLOCK, piece.limit - position))
            position += len(block)
            rest += block
            if block:
                continue
            if not rest:
                return
            rest += b"\n"  # the last line of a file at rest
        whole, _, tail = rest.rpartition(b"\n")
        for line in whole.split(b"\n"):
            if at >= piece.end:
                return
            own = at
            parts = line.removesuffix(b"\r").split(b"\r")
            for part in parts:
                yield own, part
                own += len(part) + 1
            at += len(line) + 1
        rest = tail


class GrowingLinesReader(DataSourceStreamReader):
    def __init__(self, folder: str, settled: float, piece_bytes: int):
        self.folder, self.settled, self.piece_bytes = folder, settled, piece_bytes
        self.known: dict[str, dict] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        store, folder = open_folder(self.folder)
        found = {}
        for info in store.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
            if info.type != pafs.FileType.File or not info.base_name.endswith(ENDINGS):
                continue
            before = self.known.get(info.path)
            whole = before and (not self.settled or before["position"] == before["size"])
            if whole and before["size"] == info.size and before["written"] == info.mtime_ns:
                found[info.path] = before
                continue
            with store.open_input_file(info.path) as file:
                # A file at rest for long has no writer any more: what is left is a line.
                rested = self.settled > 0 and time.time() - (info.mtime_ns or 0) / 1e9 > self.settled
                position = info.size if rested else whole_lines(file, info.size)
                found[info.path] = {
                    "position": position, "heads": heads(file, position), "seen": int(time.time() * 1000), "size": info.size, "written": info.mtime_ns,
                }
        self.known = found
        return found

    def partitions(self, start: dict, end: dict) -> list[Pack]:
        return packed(pieces(start, end, self.piece_bytes))

    def read(self, partition: Pack) -> Iterator[pa.RecordBatch]:
        store, _ = open_folder(self.folder)
        for piece in partition.pieces:
            with store.open_input_file(piece.path) as file:
                waiting: list[tuple[int, bytes]] = []
                for row in lines_of(file, piece):
                    waiting.append(row)
                    if len(waiting) == BATCH_LINES:
                        yield self._batch(piece, waiting)
                        waiting = []
                if waiting:
                    yield self._batch(piece, waiting)

    @staticmethod
    def _batch(piece: Piece, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
        count = len(rows)
        seen = pa.array([piece.seen * 1000] * count, pa.timestamp("us", "UTC"))
        columns = {
            "path": pa.array([piece.path] * count), "piece": pa.array([piece.start] * count, pa.int64()),
            "offset": pa.array([o for o, _ in rows], pa.int64()), "line": pa.array([r.decode("utf-8", "replace") for _, r in rows]), "seen": seen,
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    def commit(self, end: dict) -> None:
        pass


class GrowingLines(DataSource):
    """``spark.readStream.format("growing_lines").load(folder)``.

    Options: ``settled`` (seconds of rest after which a last line without an end counts; 0, the
    default, waits for ever) and ``piece_bytes``.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> GrowingLinesReader:
        return GrowingLinesReader(self.options["path"], float(self.options.get("settled", 0)), int(self.options.get("piece_bytes", PIECE_BYTES)))


def tail_log_lines(spark: SparkSession, directory: str, *, settled: float = 0, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Lines of the .log and .txt files directly in ``directory`` as they are appended, each once.

    (path, piece, offset, line, seen): ``offset`` is where the line begins in its file, ``piece`` the
    start of the task's part of the file (lines come in order within one; 0 begins a new file, or one
    that was cut short or replaced), and ``seen`` when the poll found the line.  Undecodable bytes
    become replacement characters.  A file that is replaced by a longer one with the same first 4096 bytes
    is taken for the same file; what is overwritten before it was read is lost; a file that leaves the folder
    is forgotten.
    """
    spark.dataSource.register(GrowingLines)
    return spark.readStream.format(FORMAT).option("settled", settled).option("piece_bytes", piece_bytes).load(directory)
