"""The registered queries of this subpackage and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import embedding_dedup, exact_dedup, merkle, minhash_dedup, mixing, packing, quality, secrets, sharding, suffix_dedup, tokens, url_filter
from .common import documents


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(documents(spark, sf_dir), percent=85)


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), least=0.98)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(documents(spark, sf_dir))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(documents(spark, sf_dir))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(documents(spark, sf_dir))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(documents(spark, sf_dir))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        op1_minhash_dedup, op2_embedding_dedup, op3_mix_sources, op4_token_counts, op5_exact_dedup, op6_sharding,
        op7_secret_scan, op8_packing, op9_url_filter, op10_quality, op11_merkle_manifest, op12_suffix_dedup,
    )
}


def oracles() -> dict[str, str]:
    return {
        "op1_minhash_dedup": minhash_dedup.SQL,
        "op2_embedding_dedup": embedding_dedup.SQL,
        "op3_mix_sources": mixing.SQL,
        "op5_exact_dedup": exact_dedup.SQL,
        "op6_sharding": sharding.SQL,
        "op9_url_filter": url_filter.sql(),
        "op11_merkle_manifest": merkle.SQL,
        "op12_suffix_dedup": suffix_dedup.SQL,
    }
