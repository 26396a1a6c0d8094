"""From raw documents to packed sequences: language, near duplicates, secrets, packing.

Each stage works on all that its predecessor kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stationlake.llm import language_id, ngram_join, packing, secret_scan
from stationlake.llm.common import remainder_of_id, settle, table


def learned_from() -> Column:
    """The labelled rows that the language model may learn from: four fifths, by a hash of the id."""
    return F.coalesce(remainder_of_id("doc_id", 5), F.lit(1)) != 0


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is near a centroid of some language; those without a letter go, too."""
    return language_id.keep_known(docs, language_id.fit(docs, learn=learned_from()))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the rows that have its least id: one, where ids are unique. Where they aren't, of
    the rows with that id those stay whose text is in the group, and of rows that are equal in all columns one stays."""
    joined = ngram_join.join(docs).filter(F.col("class_id").eqNullSafe(F.col("doc_id")))
    kept = joined.groupBy(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash")).agg(F.count(F.lit(1)).alias("rows"))
    kept = settle(kept, "near-duplicates")
    same = docs["doc_id"].eqNullSafe(kept["kept_id"]) & (F.xxhash64(docs["text"]) == kept["kept_hash"])
    single = docs.join(kept.filter("rows = 1"), same, "left_semi")
    return single.union(docs.join(kept.filter("rows > 1"), same, "left_semi").distinct())


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts masked."""
    return secret_scan.redact(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", known_languages),
    ("near_duplicates", without_near_duplicates),
    ("secret_scan", without_secrets),
    ("packing", packed),
]

#: SQL can't express these stages; tests compare them with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
