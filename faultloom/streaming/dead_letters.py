"""Records that could not be taken in: kept with reason, attempts and the record's own time, and tried again.

A letter is named by its text and its record's time, so a replayed batch writes the same letter.  The
table is a change log: the row with the most attempts is the letter's state.  A letter is ``waiting``
until an attempt succeeds (``done``) or its attempts are used up (``dead``).
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import payloads
from ..sources.tables import BATCH, append_changes

MOST_ATTEMPTS = 3
WAITING, DONE, DEAD = "waiting", "done", "dead"


def letter_id(value: str, at: str) -> Column:
    micros = F.coalesce(F.unix_micros(F.col(at).cast("timestamp")).cast("string"), F.lit(""))
    return F.sha2(F.concat_ws("|", micros, F.coalesce(F.col(value), F.lit(""))), 256)


def json_letters(
    root: str, *, value: str = "value", at: str = "at", form: str = "log_event", most: int = MOST_ATTEMPTS
) -> Callable[[DataFrame, int], None]:
    """Batch writer for raw JSON with the record's time in ``at``: accepted events to ``root/events``, the others to ``root/letters``.

    Events without a time of their own get the record's, so a replay gives the same rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()
        try:
            first = held.withColumns({"_letter": letter_id(value, at), "_attempts": F.lit(1)})
            _attempt(first, root, batch_id, value, at, form, most)
        finally:
            held.unpersist()

    return write


def _attempt(tried: DataFrame, root: str, number: int, value: str, at: str, form: str, most: int) -> None:
    """Change sets of one attempt at ``tried``, whose columns ``_letter`` and ``_attempts`` name the letter and count this attempt."""
    accepted, rejects = payloads.parse_json(tried, value, form)
    others = [c for c in tried.columns if c not in (value, "_letter", "_attempts")]
    named = [*others, value, F.col("_letter").alias("letter_id"), "reason", F.col("_attempts").alias("attempts")]
    status = F.when(F.col("_attempts") >= most, F.lit(DEAD)).otherwise(F.lit(WAITING))
    failed = rejects.select(*named, status.alias("status"))
    # A record that is taken in at once was never a letter.
    taken = tried.filter(F.col("_attempts") > 1).join(rejects.select("_letter").distinct(), "_letter", "left_anti")
    done = taken.withColumn("reason", F.lit(None).cast("string")).select(*named, F.lit(DONE).alias("status"))
    append_changes(payloads.with_event_time(accepted, F.col(at)).drop("_letter", "_attempts"), f"{root}/events", number)
    append_changes(failed.unionByName(done), f"{root}/letters", number)


#: Change sets of retries are numbered after those of the stream.
_RETRIES = 10**9


def _states(rows: DataFrame) -> DataFrame:
    last = F.max_by(F.struct(*[c for c in rows.columns if c != "letter_id"]), "attempts").alias("l")
    return rows.groupBy("letter_id").agg(last).select("letter_id", "l.*")


def letters(spark: SparkSession, root: str) -> DataFrame:
    """The state of every letter."""
    return _states(spark.read.parquet(f"{root}/letters").drop(BATCH))


def retry(
    spark: SparkSession, root: str, turn: int, repair: Callable[[DataFrame], DataFrame], *, value: str = "value", at: str = "at",
    form: str = "log_event", most: int = MOST_ATTEMPTS,
) -> None:
    """One more attempt at the waiting letters after ``repair`` of their texts; ``turn`` (from 0) numbers the retries.

    Only attempts before this turn decide which letters are tried, so a turn that runs again replaces itself.
    """
    earlier = spark.read.parquet(f"{root}/letters").filter(F.col(BATCH) < _RETRIES + turn).drop(BATCH)
    waiting = _states(earlier).filter(F.col("status") == WAITING).drop("status", "reason")
    tried = repair(waiting).withColumn("_attempts", F.col("attempts") + 1).withColumnRenamed("letter_id", "_letter").drop("attempts")
    held = tried.persist()
    try:
        _attempt(held, root, _RETRIES + turn, value, at, form, most)
    finally:
        held.unpersist()
