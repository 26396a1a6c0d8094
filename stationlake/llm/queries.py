"""The queries of this subpackage: thin calls of the operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversation_repair, html_template, language_id, language_model, license_scan, mtree, ngram_join, packing, resampling, rp_forest, secret_scan, warc
from .common import remainder_of_id, table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = remainder_of_id("doc_id", 10)
    scored = language_model.score(docs, train=fold != 0)
    return scored.withColumn("held_out", F.coalesce(remainder_of_id("doc_id", 10) == 0, F.lit(False)))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op3_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_products(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def _joined(spans):
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return found.select(
        "doc_id",
        *(F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in secret_scan.BASE),
        F.sha2(_joined(of(*secret_scan.BASE)), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )


def op7_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp_forest.nearest_rows(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.coalesce(remainder_of_id("doc_id", 5), F.lit(1))
    model = language_id.fit(docs, learn=fold != 0)
    return language_id.predict(docs, model).select("doc_id", (fold == 0).alias("held_out"), "lang_pred", "score", "rejected")


def op9_html_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_template.extract(table(spark, sf_dir, "pages"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = conversation_repair.damage(table(spark, sf_dir, "conversations"))
    return conversation_repair.repair(damaged, copies=F.col("copies"), texts=False).withColumnRenamed("digest", "repaired_sha256")


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_model": op1_language_model,
        "op2_license_scan": op2_license_scan,
        "op3_mtree": op3_mtree,
        "op4_byte_bpe": op4_byte_bpe,
        "op5_ngram_join": op5_ngram_join,
        "op6_secret_scan": op6_secret_scan,
        "op7_rp_forest": op7_rp_forest,
        "op8_language_id": op8_language_id,
        "op9_html_template": op9_html_template,
        "op10_packing": op10_packing,
        "op11_conversation_repair": op11_conversation_repair,
        "op12_resampling": op12_resampling,
        "op13_warc": op13_warc,
    }


def oracle_sql() -> dict[str, str]:
    exact_top_k = """
    WITH whole AS (
        SELECT DISTINCT vec_id AS id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS vec FROM embeddings
        WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (
        SELECT q.id AS query_id, q.vec, v.id AS vec_id, list_dot_product(q.vec, v.vec)::BIGINT AS score
        FROM whole q JOIN whole v ON q.id <> v.id AND len(q.vec) = len(v.vec) WHERE q.id % 100 = 0)
    SELECT query_id, (row_number() OVER (PARTITION BY query_id, vec ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
    FROM scored QUALIFY rank <= 10
    """
    return {
        "op2_license_scan": license_scan.oracle(),
        "op3_mtree": exact_top_k,
        "op11_conversation_repair": conversation_repair.oracle(),
        "op12_resampling": resampling.oracle(),
        "op13_warc": warc.oracle(),
    }
