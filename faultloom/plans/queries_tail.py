"""Log files that grow while streams read them: lines as they come, and blocks over the edges of batches.

The files are written three times, each time with more of their bytes, so they end in half lines and
cut blocks; each time a query starts again from its checkpoint.  The SQL is that of the whole files.
"""

import sys
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import checkpoint_folder
from ..sources import tables, tail
from ..streaming import block_stream, streams
from . import pipelines as pl
from . import testviews as tv
from .oracle_views import LOG_EVENTS, with_views
from .oracle_views import stamp as sql_stamp
from .queries_logs import _BLOCKS, _LINES
from .registry import query, stamp

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Shares of each file's bytes that are there when the query starts.
SHARES = (0.37, 0.71, 1.0)
#: Event numbers of one file, and bytes of one piece.
FILE_EVENTS = 20_000
PIECE_BYTES = 1 << 20
CLOSING = b"-- closed\n"


def _write(lines: DataFrame, folder: str) -> DataFrame:
    """One file per ``path`` with its lines in order, and the files' names as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = tail.open_folder(f"{folder}/files")
        store.create_dir(base)
        current, held, names = None, [], []

        def put() -> None:
            names.append(f"{current}.log")
            with store.open_output_stream(f"{base}/{current}.log") as file:
                file.write(b"".join(held))

        for batch in batches:
            for path, line in zip(batch.column("path").to_pylist(), batch.column("line").to_pylist()):
                if path != current:
                    if held:
                        put()
                    current, held = path, []
                held.append(line.encode() + b"\n")
        if held:
            put()
        yield pa.RecordBatch.from_pydict({"name": pa.array(names, pa.string())})

    ordered = lines.repartition("path").sortWithinPartitions("path", "n").select("path", "line")
    ordered.mapInArrow(run, "name string").write.parquet(f"{folder}/names")
    return lines.sparkSession.read.schema("name string").parquet(f"{folder}/names")


def _grow(names: DataFrame, whole: str, folder: str, share: float, closing: bytes = b"") -> None:
    """The first ``share`` of the bytes of each whole file, and ``closing`` at the end of what is there to the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = tail.open_folder(f"{whole}/files")
        target = tail.open_folder(folder)[1]
        store.create_dir(target)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                with store.open_input_file(f"{base}/{name}") as file:
                    content = file.read(file.size() if share == 1.0 else int(file.size() * share))
                with store.open_output_stream(f"{target}/{name}") as file:
                    file.write(content + closing if share == 1.0 else content)
        yield pa.RecordBatch.from_pydict({"done": [True]})

    dealt = names.repartition(names.sparkSession.sparkContext.defaultParallelism)
    dealt.mapInArrow(run, "done boolean").write.format("noop").mode("overwrite").save()


def _file_name(path: str, n: str, per_file: int) -> Column:
    return F.concat(F.col(path), F.lit("-"), F.floor(F.col(n) / per_file).cast("string"))


def _grown(spark: SparkSession, name: str, lines: DataFrame, build: Callable[[DataFrame], DataFrame], closing: bytes = b"") -> DataFrame:
    """What ``build`` makes of the growing files, over all runs of the stream."""
    root = f"{checkpoint_folder(spark, name)}/{uuid.uuid4().hex}"
    names = _write(lines, f"{root}/whole")
    for share in SHARES:
        _grow(names, f"{root}/whole", f"{root}/logs", share, closing)
        stream = build(tail.tail_log_lines(spark, f"{root}/logs", piece_bytes=PIECE_BYTES))
        streams.start(stream, f"{root}/checkpoint", lambda batch, i: tables.append_changes(batch, f"{root}/out", i)).awaitTermination()
    return spark.read.parquet(f"{root}/out").drop(tables.BATCH)


@query(
    "stream_tail",
    f"""WITH {_LINES}
SELECT level, message, {sql_stamp('t')} AS ts, 'scan' AS job_id, 'w' AS workspace_id
FROM parsed WHERE level = 'ERROR'""",
)
def stream_tail(spark, sf_dir):
    """ERROR lines of files that grow between three runs of one stream: each line once, none cut."""
    lines = tv.log_lines(spark, sf_dir).select(_file_name("path", "seq", FILE_EVENTS).alias("path"), F.col("seq").alias("n"), "line")
    events = _grown(spark, "tail", lines, lambda s: pl.collect_logs(s, F.lit("scan"), workspace_id="w", identity=("path", "offset")))
    return events.select("level", "message", stamp(tx.utc_ntz(F.col("ts"))).alias("ts"), "job_id", "workspace_id")


@query(
    "stream_blocks",
    with_views(LOG_EVENTS, _BLOCKS.replace("job_id AS path", f"job_id || '-' || (seq // {FILE_EVENTS}) AS path"), select="""
SELECT path, CAST(count(*) AS BIGINT) AS n_lines, string_agg(line, chr(10) ORDER BY line_no) AS block
FROM marked WHERE cls <> 'O' AND state = 'A' GROUP BY path, block_id"""),
)
def stream_blocks(spark, sf_dir):
    """Error blocks of files that grow between three runs of one stream, cut anywhere."""
    messages = tv.message_lines(spark, sf_dir)
    lines = messages.select(_file_name("path", "line_no", 10 * FILE_EVENTS).alias("path"), F.col("line_no").alias("n"), "line")
    with block_stream.with_state_store(spark):
        parts = _grown(spark, "block-stream", lines, lambda s: block_stream.stream_blocks(s, part_lines=2), CLOSING)
    name = F.regexp_extract("path", r"([^/]+)\.log$", 1)
    return block_stream.joined_blocks(parts).select(
        name.alias("path"), F.size("lines").cast("long").alias("n_lines"), F.array_join("lines", "\n").alias("block")
    )
