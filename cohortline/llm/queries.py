"""One query per operator, over whole tables and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortline.llm import (
    alignment,
    bpe,
    embeddings,
    exact_dedup,
    fingerprints,
    language,
    licenses,
    line_dedup,
    manifest,
    packing,
    quality,
    simhash,
    toxicity,
)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.classify(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    done = line_dedup.dedup_lines(_table(spark, folder, "documents"), blocks=True)
    return done.select(
        "doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), "text"
    )


def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(_table(spark, folder, "documents"))


def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classify(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    path = _tokenizer("byte_bpe_50k.json")
    return packing.pack_documents(_table(spark, folder, "documents"), path)


def op6_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path, pattern = _tokenizer("byte_bpe_50k.tiktoken"), _pattern()
    encoded = bpe.encode_documents(_table(spark, folder, "documents"), path, pattern)
    return bpe.decode_documents(encoded, path, pattern).drop("decoded")


def op7_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, folder, "documents"), licenses.built_in(spark))


def op8_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.near_vectors(_table(spark, folder, "embeddings"))


def op9_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprint_documents(_table(spark, folder, "documents"))


def op10_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, folder, "documents"))


def op11_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    paths = _tokenizer("byte_bpe_50k.json"), _tokenizer("piece_bpe_32k.model")
    return alignment.align_tokens(_table(spark, folder, "documents"), *paths)


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    tampered = manifest.without_breaks(F.col("doc_id"), F.col("text"))
    return manifest.manifest(_table(spark, folder, "documents"), tampered)


def op13_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_line_dedup": op2_line_dedup,
    "op3_language_id": op3_language_id,
    "op4_quality": op4_quality,
    "op5_packing": op5_packing,
    "op6_bpe": op6_bpe,
    "op7_license_scan": op7_license_scan,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_fingerprints": op9_fingerprints,
    "op10_simhash_dedup": op10_simhash_dedup,
    "op11_token_alignment": op11_token_alignment,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_exact_dedup": op13_exact_dedup,
    "pipeline": corpus_pipeline.run,
}
