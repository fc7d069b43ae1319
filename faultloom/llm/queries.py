"""Queries of the training-data operators over the test tables, and their SQL where there is any."""

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, cover_tree, decontamination, hard_negatives, line_dedup, lm, mixing, ngram_join, quality, sharding, token_counts, token_files, vector_codes
from .common import table

QUERIES = {}
ORACLES = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


def tokenizer_file(name: str) -> str:
    """A file of the installed public vocabularies; ``FAULTLOOM_TOKENIZERS`` names another folder."""
    folder = os.environ.get("FAULTLOOM_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_quality")
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(quality.remainder("doc_id", 3) != 1)
    scored = quality.score(docs, quality.fit(docs, labels))
    return scored.select("doc_id", (quality.remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


@query("op2_lm_scoring")
def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = quality.remainder("doc_id", 5) == 1
    training = docs.filter(~held_out)
    counts = lm.count_tokens(training)
    words = lm.vocabulary(counts)
    scored = lm.score(docs, counts, words, lm.fit(training, words))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op3_token_files")
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_output(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


@query("op4_token_counts")
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


@query("op5_line_dedup", line_dedup.oracle())
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


@query("op6_ann")
def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


@query("op7_ngram_join", ngram_join.oracle())
def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = ngram_join.near_duplicates(table(spark, sf_dir, "documents"))
    return grouped.select("doc_id", "class_id", "copies", "n_links")


@query("op8_decontamination", decontamination.oracle())
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op9_mixing")
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query("op10_sharding", sharding.oracle())
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents"))


@query("op11_hard_negatives", hard_negatives.oracle())
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return hard_negatives.mine(vectors, lambda ident: ident % 50 == 0)


@query("op12_vector_codes", vector_codes.oracle())
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


@query("op13_near_dedup", cover_tree.oracle())
def op13_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_duplicates(table(spark, sf_dir, "embeddings"))
