"""Training-data pipeline over ``documents``: quality, near duplicates, benchmark passages, source mix, token files.

``run(spark, sf_dir)`` applies STAGES in order.  Each stage takes the Parquet table its predecessor
wrote to the shared folder and works on all of it; all but the last return the columns of
``documents``.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultloom.llm import decontamination, mixing, ngram_join, quality, token_files
from faultloom.llm.common import table, written
from faultloom.llm.queries import tokenizer_file


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, learned from the labels of the input documents.

    A null text scores as an empty one.  The row travels as one struct, so columns named like the scores stay.
    """
    model = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    rows = docs.select("text", F.struct("*").alias("row"))
    return quality.score(rows, model).filter(F.col("predicted") == 1).select("row.*")


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return ngram_join.keep_one(docs).select(docs.columns)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source mix takes them."""
    return mixing.taken(docs).select(docs.columns)


def write_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of equal-length sequences; returns each document's place in them, read back from the files."""
    return token_files.token_output(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_distinct),
    ("decontamination", keep_clean),
    ("mixing", mix_sources),
    ("token_files", write_sequences),
]

# The classifier is learned, MinHash and the cube method draw at random and a tokenizer is applied: no SQL gives these rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
