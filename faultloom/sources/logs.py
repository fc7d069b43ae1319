"""Log directories and runbook directories, as batch tables and streams."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.positions import with_position

LOG_FILES = "*.{log,txt}"


def read_log_lines(spark: SparkSession, directory: str) -> DataFrame:
    """Lines of the .log and .txt files directly in ``directory``.

    (path, split_start, row_no, line, nth): ``split_start`` is the byte offset of the file split a line
    came from and ``row_no`` grows within a split, so (split_start, row_no) orders a file's lines
    and a file of any size is read in parallel.  Both change with the split size and with what else is
    in the folder; ``nth`` does not: it counts the equal lines of the file up to this one, so (path, line,
    nth) names a line for good.  Undecodable bytes become replacement characters.
    """
    lines = spark.read.option("pathGlobFilter", LOG_FILES).text(directory)
    read = _log_columns(lines).select(
        "path", F.col("_metadata.file_block_start").alias("split_start"),
        F.monotonically_increasing_id().alias("row_no"), "line",
    )
    return with_position(read, ["path", "line"], "row_no", chunk=F.col("split_start"), out="nth")


def stream_log_lines(spark: SparkSession, directory: str, files_per_trigger: int = 1000) -> DataFrame:
    """Lines of files as they arrive; each file is read once, so writers must roll files, not append."""
    lines = (
        spark.readStream.option("pathGlobFilter", LOG_FILES)
        .option("maxFilesPerTrigger", files_per_trigger)
        .text(directory)
    )
    return _log_columns(lines).select("path", "line")


def _log_columns(lines: DataFrame) -> DataFrame:
    return lines.withColumn("path", F.col("_metadata.file_path")).withColumn("line", F.make_valid_utf8("value"))


def read_runbooks(spark: SparkSession, directory: str, workspace_id: str) -> DataFrame:
    """One row per markdown file: (workspace_id, source_file, markdown_text)."""
    files = spark.read.option("pathGlobFilter", "*.md").text(directory, wholetext=True)
    return files.select(
        F.lit(workspace_id).alias("workspace_id"),
        F.col("_metadata.file_name").alias("source_file"),
        F.make_valid_utf8("value").alias("markdown_text"),
    )
