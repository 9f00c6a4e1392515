"""From documents to training tokens: five stages, each of which writes what the next one reads.

Toxic documents go, then those of poor quality, then all but one of each group of near copies. What is left is mixed
to the sources' target weights, each document as often as the mix takes it, and encoded. Both classifiers learn
from the labels beside the documents, from no more rows of either class than their `per_class` says.

Every stage works on all rows that the one before kept. Rows with null texts are not toxic and pass the first
stage; the second judges them like empty texts. An empty table passes through as an empty table.

Stages with Python tasks hand them the texts in small Arrow batches; the setting stays with the session, as Spark reads
it when a stage's rows are asked for."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.llm import bpe, mixing, ngram_join, quality, toxicity
from linkweave.session import small_batches, staged

#: No SQL twin: learned models, components and merges are beyond SQL. The stages are tested against brute force.
ORACLE_SQL = None


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return toxicity.drop_toxic(docs, toxicity.fit_lexicon(docs, _labels(spark, sf_dir), F.lit(True)))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return quality.keep_good(docs, quality.fit(docs, _labels(spark, sf_dir), F.lit(True)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return ngram_join.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_good),
    ("near copies", drop_near_copies),
    ("mix", mix),
    ("tokens", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents after all stages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
