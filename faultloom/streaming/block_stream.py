"""Error blocks of log files that grow, over the edges of tasks and micro-batches.

Inside its piece of a file a task assembles blocks on its own; only the piece's edges go to the
state: the continuation lines before its first other line, and the block that is open at its end.  The
state of a file is that open block.  The next edge continues or closes it, and so does a time-out in
event time, for files that are not written to any more.  Blocks leave in parts of bounded size.
"""

import sys
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.blocks import ANCHOR, CONTINUATION, line_class

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Lines of one part of a block.
PART_LINES = 5000
#: Complete blocks of all files are dealt over so many keys; the edges of each file are a key of their own, lane 0.
LANES = 256
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"

CUT = "home string, lane int, path string, piece long, kind int, born long, block long, part int, lines array<string>, done boolean, seen timestamp"
PARTS = "path string, born long, block long, part int, lines array<string>, done boolean"
COLUMNS = ["path", "born", "block", "part", "lines", "done"]
HEAD, TAIL, WHOLE = 0, 1, 2


class Cutter:
    """Blocks of one piece of a file, line by line; edges and parts are put to ``out``."""

    def __init__(self, path: str, piece: int, seen, most: int, out: list):
        self.path, self.piece, self.seen, self.most, self.out = path, piece, seen, most, out
        self.born = int(seen.timestamp() * 1000)
        self.head: list[str] | None = []
        self.block, self.part, self.lines = None, 0, []

    def _put(self, kind: int, block: int, part: int, lines: list[str], done: bool) -> None:
        home, lane = ("", 1 + (zlib.crc32(self.path.encode()) + block) % LANES) if kind == WHOLE else (self.path, 0)
        self.out.append((home, lane, self.path, self.piece, kind, self.born, block, part, lines, done, self.seen))

    def add(self, offset: int, cls: str, line: str) -> None:
        if cls == CONTINUATION:
            if self.head is not None:
                self.head.append(line)
            elif self.block is not None:
                self.lines.append(line)
                if len(self.lines) == self.most:
                    self._put(WHOLE, self.block, self.part, self.lines, False)
                    self.part, self.lines = self.part + 1, []
            return
        if self.head is not None:
            self._put(HEAD, self.piece, 0, self.head, True)
            self.head = None
        if self.block is not None:
            self._put(WHOLE, self.block, self.part, self.lines, True)
        self.block, self.part, self.lines = (offset, 0, [line]) if cls == ANCHOR else (None, 0, [])

    def close(self) -> None:
        if self.head is not None:
            self._put(HEAD, self.piece, 0, self.head, False)
        if self.block is not None:
            self._put(TAIL, self.block, self.part, self.lines, False)


def cut_pieces(lines: DataFrame, most: int = PART_LINES) -> DataFrame:
    """Complete blocks and edges of ``lines(path, piece, offset, line, seen)``, which come in order within a piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        cutter = None

        def give() -> pa.RecordBatch:
            rows = list(zip(*out)) or [[] for _ in arrow]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, arrow)], schema=arrow)

        for batch in batches:
            for path, piece, offset, line, seen, cls in zip(*(c.to_pylist() for c in batch.columns)):
                if cutter is None or (path, piece) != (cutter.path, cutter.piece):
                    if cutter:
                        cutter.close()
                    cutter = Cutter(path, piece, seen, most, out)
                cutter.add(offset, cls, line)
            yield give()
        if cutter:
            cutter.close()
            yield give()

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T._parse_datatype_string(CUT)
    arrow = to_arrow_schema(schema)
    return lines.select("path", "piece", "offset", "line", "seen", line_class(F.col("line")).alias("cls")).mapInArrow(run, schema)


class OpenBlock(StatefulProcessor):
    """The open block of a file between micro-batches."""

    def __init__(self, timeout_ms: int, most: int):
        self.timeout_ms, self.most = timeout_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("open", "born long, block long, part int, lines array<string>, expires long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        path, lane = key
        if lane:
            for frame in rows:
                yield frame[COLUMNS]
            return
        edges = sorted((r for frame in rows for r in frame.to_dict("records")), key=lambda r: (r["piece"], r["kind"]))
        held = self.state.get() if self.state.exists() else None
        born, block, part, lines, expires = held if held else (None, None, 0, [], None)
        lines, out = list(lines), []
        seen = 0
        for edge in edges:
            seen = max(seen, int(pd.Timestamp(edge["seen"]).timestamp() * 1000))
            if edge["kind"] == HEAD:
                if block is not None and edge["piece"] > 0:
                    lines += list(edge["lines"])
                    while len(lines) > self.most:
                        out.append((path, born, block, part, lines[: self.most], False))
                        part, lines = part + 1, lines[self.most :]
                if block is not None and (edge["done"] or edge["piece"] == 0):
                    out.append((path, born, block, part, lines, True))
                    block, part, lines = None, 0, []
            else:
                born, block, part, lines = int(edge["born"]), int(edge["block"]), int(edge["part"]), list(edge["lines"])
        if expires is not None:
            self.handle.deleteTimer(expires)
        if block is None:
            self.state.clear()
        else:
            expires = max(seen, timerValues.getCurrentWatermarkInMs()) + self.timeout_ms
            self.handle.registerTimer(expires)
            self.state.update((born, block, part, lines, expires))
        yield pd.DataFrame(out, columns=COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.state.exists():
            born, block, part, lines, _ = self.state.get()
            out.append((key[0], born, block, part, list(lines), True))
            self.state.clear()
        yield pd.DataFrame(out, columns=COLUMNS)

    def close(self) -> None:
        pass


def stream_blocks(lines: DataFrame, *, timeout_ms: int = 600_000, skew: str = "10 minutes", part_lines: int = PART_LINES) -> DataFrame:
    """Parts of the error blocks of a stream of ``tail.tail_log_lines``: (path, born, block, part, lines, done).

    ``block`` is the byte offset of the anchor line and ``born`` when it was seen (a file that starts anew has the same
    offsets again); a block is its parts in order, up to the one that is ``done``.  An open block waits for the next lines of its file; it is closed when no line came
    for ``timeout_ms`` after the last one, as far as other files show that time has passed, or
    when its file starts anew.  ``skew`` is how far the clocks of drivers may disagree.  Needs the RocksDB state store
    (``with_state_store``).
    """
    cut = cut_pieces(lines, part_lines).withWatermark("seen", skew)
    return cut.groupBy("home", "lane").transformWithStateInPandas(
        statefulProcessor=OpenBlock(timeout_ms, part_lines), outputStructType=T._parse_datatype_string(PARTS), outputMode="Append", timeMode="EventTime"
    )


class with_state_store:
    """Queries that start inside use the RocksDB state store; the session's setting is put back afterwards."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> None:
        self.before = self.spark.conf.get(PROVIDER)
        self.spark.conf.set(PROVIDER, ROCKSDB)

    def __exit__(self, *_) -> None:
        self.spark.conf.set(PROVIDER, self.before)


def joined_blocks(parts: DataFrame) -> DataFrame:
    """(path, born, block, lines) of the blocks whose last part is there.  For blocks that fit into one value."""
    listed = F.array_sort(F.collect_list(F.struct("part", "lines")))
    whole = parts.groupBy("path", "born", "block").agg(listed.alias("p"), F.bool_or("done").alias("done"))
    return whole.filter("done").select("path", "born", "block", F.flatten(F.transform("p", lambda x: x["lines"])).alias("lines"))
