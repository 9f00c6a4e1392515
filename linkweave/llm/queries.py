"""Registered queries of the llm operators, with SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from linkweave.llm import bpe, codes, licenses, media, metric_join, mixing, ngram_join, prefix_trie, quality, sharding, topk, toxicity, warc

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents"))


def op2_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.query(_table(spark, sf_dir, "embeddings"))


def op3_entropy_balanced_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.query(_table(spark, sf_dir, "documents"))


def op4_zstd_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.query(_table(spark, sf_dir, "pages"))


def op5_virtual_slot_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.query(_table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.query(_table(spark, sf_dir, "documents"))


def op7_toxicity_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.query(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.query(_table(spark, sf_dir, "embeddings"))


def op9_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.query(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op11_grid_cell_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.query(_table(spark, sf_dir, "embeddings"))


def op12_metric_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.query(_table(spark, sf_dir, "embeddings"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.query(_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Query] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_bit_sliced_top_k": op2_bit_sliced_top_k,
    "op3_entropy_balanced_mix": op3_entropy_balanced_mix,
    "op4_zstd_warc": op4_zstd_warc,
    "op5_virtual_slot_shards": op5_virtual_slot_shards,
    "op6_license_scan": op6_license_scan,
    "op7_toxicity_lexicon": op7_toxicity_lexicon,
    "op8_chroma_fingerprints": op8_chroma_fingerprints,
    "op9_quality_nbsvm": op9_quality_nbsvm,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_grid_cell_codes": op11_grid_cell_codes,
    "op12_metric_range_join": op12_metric_range_join,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLES: dict[str, str] = {
    "op2_bit_sliced_top_k": topk.SQL,
    "op3_entropy_balanced_mix": mixing.SQL,
    "op11_grid_cell_codes": codes.SQL,
    "op12_metric_range_join": metric_join.SQL,
    "op13_prefix_trie": prefix_trie.SQL,
}
