"""A training corpus from raw documents: toxicity, line dedup, near-duplicate join, source mix, token ids.

Each stage reads what its predecessor kept, as Parquet, and its decisions take effect in what it returns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegrain.llm import bpe, jaccard_join, line_chunks, mixing, toxicity
from tracegrain.session import coarse, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels, does not reject."""
    return toxicity.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated passages; documents of which nothing is left go."""
    return coarse(line_chunks.without_repeats(docs, run_words=line_chunks.RUN_WORDS), docs.count())


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of linked ones."""
    return coarse(jaccard_join.one_of_each(docs), docs.count())


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix."""
    return mixing.ordered(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts, digests of token ids and of what they decode to, and each row's position in the mix."""
    place = mixing.mix(docs).groupBy(F.col("doc_id").alias("_key")).agg(F.min("position").alias("position"))
    return coarse(bpe.digests(docs).join(place, F.col("doc_id").eqNullSafe(F.col("_key")), "left").drop("_key"), docs.count())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", drop_near_copies),
    ("source_mix", mix_sources),
    ("byte_bpe", encode),
]

ORACLE_SQL = None  # a learned model and near-duplicate groups; tests/llm compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
