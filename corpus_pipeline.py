"""From raw documents to packed sequences: each stage works on what the one before kept.

Every stage is called as ``stage(spark, docs, folder)`` and returns a DataFrame, which is
stored and read again as the next one's ``docs``. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortline.core.skew import measured
from cohortline.core.workspace import materialise
from cohortline.llm import language, line_dedup, packing, simhash, toxicity
from cohortline.llm.common import text_key

#: Documents whose language is recognised with less than this probability go.
LEAST_LANGUAGE_SCORE = 0.4


def _without(docs: DataFrame, judged: DataFrame, rejected) -> DataFrame:
    """``docs`` but for the rows rejected, found by their text: ids may be null or repeat."""
    name = "_rejected"
    while name in map(str.lower, docs.columns):
        name += "_"
    gone = judged.filter(rejected).select(F.col("text_key").alias(name)).distinct()
    gone = measured(materialise(gone, "rejected"), name)
    return gone.join(docs.withColumn(name, text_key(F.col("text"))), "left_anti").drop(name)


def language_id(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Rejects documents without a recognisable language; learns from ``docs`` itself."""
    judged = materialise(language.identify(docs, with_key=True), "languages")
    unknown = (F.col("lang_pred") == language.UNKNOWN) | (F.col("score") < LEAST_LANGUAGE_SCORE)
    return _without(docs, judged, unknown)


def toxicity_filter(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Rejects documents predicted to be toxic; learns from the labels of ``docs``."""
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    judged = materialise(toxicity.classify(docs, labels, with_key=True), "toxicity")
    return _without(docs, judged, F.col("predicted") == 1)


def dedup_lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Removes later near-duplicate lines; ``n_chars`` follows the text."""
    done = line_dedup.dedup_lines(docs, blocks=True)
    changed = F.when(F.col("_n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return done.withColumn("n_chars", changed.cast("long")).select(docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Keeps one document of each SimHash group."""
    return simhash.one_per_group(docs).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Sequences of at most 2048 tokens, one row per piece."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxicity_filter),
    ("line_dedup", dedup_lines),
    ("simhash_dedup", dedup_documents),
    ("packing", pack),
]

#: No stage but the joins between them can be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, folder), name)
    return STAGES[-1][1](spark, docs, folder)
