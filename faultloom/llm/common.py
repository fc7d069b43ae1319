"""Helpers shared by the training-data operators."""

import re
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Send the functions of this module with the job: executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Words a worker remembers with their hash; beyond this they are hashed again each time.
WORD_CACHE = 100_000
#: Bytes of one Arrow batch on its way to a worker, at most, where a table is written.
BATCH_BYTES = 8 << 20
#: Words of one shingle, and the similarity from which two texts count as near duplicates.
SHINGLE_WORDS = 5
NEAR = 0.8

_WORD = re.compile(r"\w+")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which every machine sees.

    A local session without that setting (tests) gets one temporary base folder; a cluster without
    it is an error, since executors could not see each other's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        base = tempfile.mkdtemp(prefix="faultloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder: computed once, lineage cut, safe when an executor is lost.

    Meanwhile Arrow batches are kept small, since a batch is held by the JVM and by its worker.
    """
    spark = df.sparkSession
    folder = shared_folder(spark, name)
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, str(BATCH_BYTES))
    try:
        df.write.parquet(folder)
    finally:
        if before is None:
            spark.conf.unset(setting)
        else:
            spark.conf.set(setting, before)
    return spark.read.schema(df.schema).parquet(folder)


def rows_of(df: DataFrame, schema: T.StructType | str, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[dict]]) -> DataFrame:
    """``mapInArrow`` over a function that yields dictionaries of columns (one per output batch)."""
    spark_schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(spark_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in fn(batches):
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in arrow], schema=arrow)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, spark_schema)


def worker_memory(owner: str) -> dict:
    """What a Python worker keeps from task to task for ``owner`` (models, caches of bounded size).

    A worker serves one operator after the other; what the one before kept is dropped.
    """
    kept = sys.modules.setdefault("_faultloom_worker", types.ModuleType("_faultloom_worker")).__dict__
    if kept.get("owner") != owner:
        kept["owner"], kept["memory"] = owner, {}
    return kept["memory"]


def words(text: str | None) -> list[str]:
    """Lower-cased runs of letters, digits and underscores; a text that has none gives its whitespace pieces."""
    if not text:
        return []
    text = text.lower()
    return _WORD.findall(text) or text.split()


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a fixed number of words."""

    def __missing__(self, word: str) -> int:
        value = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) < WORD_CACHE:
            self[word] = value
        return value

    def of(self, tokens: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens))


_STEPS = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64
)


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingles(hashes: np.ndarray, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Hash of every run of ``size`` words in order; fewer words make one shingle, none make none."""
    n = len(hashes)
    if n == 0:
        return hashes
    size = min(size, n)
    out = np.zeros(n - size + 1, np.uint64)
    for j in range(size):
        out += hashes[j : n - size + 1 + j] * _STEPS[j % len(_STEPS)]
    return mixed(out + np.uint64(size))


def frequent(counts: DataFrame, word: str, count: str, *, rows: int, word_bytes: int, size: int) -> pa.Table:
    """The most frequent words of ``counts`` on the driver: at most ``rows``, each at most ``word_bytes`` long, ``size`` bytes in all.

    A histogram of counts, whose length does not depend on the data, gives the least count for which
    all words fit; nothing is sorted across the cluster.  Words are ordered by falling count.
    """
    short = counts.filter(F.octet_length(word) <= word_bytes)
    c = F.col(count)
    level = F.when(c < 1024, c).otherwise(F.lit(1024) + F.floor(64 * F.log2(c / 1024))).cast("long")
    histogram = short.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(word)).alias("bytes"))
    least, taken, used = None, 0, 0
    for row in sorted(histogram.collect(), key=lambda r: -r["level"]):
        taken, used = taken + row["n"], used + row["bytes"]
        if taken > rows or used > size:
            break
        least = row["level"]
    chosen = short.filter(level >= (least if least is not None else 1 << 62)).select(word, count, *[x for x in counts.columns if x not in (word, count)])
    return chosen.toArrow().sort_by([(count, "descending"), (word, "ascending")])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))
