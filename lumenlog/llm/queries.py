"""The queries of the training-data operators, as the driver runs them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat, clustering, decontaminate, exact_dedup, jaccard_join, licenses, media, packing, quality, repair, secrets, sharding, toxicity
from .common import table
from .oracles import COPIES_SQL, clustering_sql, repair_sql


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_media(media.media_documents(table(spark, sf_dir, "documents")))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_digest(spark, table(spark, sf_dir, "conversations"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_digest(table(spark, sf_dir, "documents"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_classes(table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster_vectors(table(spark, sf_dir, "embeddings"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repaired(repair.damaged(table(spark, sf_dir, "conversations")))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.copies(table(spark, sf_dir, "documents"))


# The columns of the same results that SQL can give.


def base_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_sharding(spark, sf_dir).select("doc_id", "size", "law")


def base_shard_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = op1_sharding(spark, sf_dir).groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.min("slot").alias("first"), F.max("slot").alias("last"), F.countDistinct("slot").alias("slots"))
    return slots.select(F.col("shard").cast("long").alias("shard"), "n", "first", "last", "slots")


def base_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_media_columns(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def base_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base")


def base_shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_ngram_jaccard_join(spark, sf_dir).select("doc_id", "n_shingles")


def base_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
PHRASE = "len(list_filter(range(1, len(w) + 1), lambda i: list_slice(w, i, i + {n} - 1) = {words}))"
PHRASES = (["under", "the", "mit", "license"], ["apache", "license", "version", "2"], ["cc", "by", "nc"])
SQL = {
    "op11_centroid_clustering": clustering_sql(),
    "op12_conversation_repair": repair_sql(),
    "op13_exact_dedup": COPIES_SQL,
    "base_sharding": "SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, 'rows' AS law FROM documents",
    "base_shard_rows": "SELECT shard, n, 0 AS first, n - 1 AS last, n AS slots FROM (SELECT s AS shard, c * (s + 1) // 8 - c * s // 8 AS n FROM range(8) r(s), (SELECT count(*) AS c FROM documents))",
    "base_media": "SELECT doc_id, n_bytes, n_bytes + pad AS payload_bytes, sha256(t || repeat(chr(0), pad)) AS payload_sha256 FROM (SELECT doc_id, t, n_bytes, CAST(CASE WHEN n_bytes = 0 THEN 64 ELSE (64 - n_bytes % 64) % 64 END AS INTEGER) AS pad FROM (SELECT doc_id, coalesce(text, '') AS t, strlen(coalesce(text, '')) AS n_bytes FROM documents))",
    "base_licenses": f"SELECT doc_id, len(w) AS n_words, {' + '.join(PHRASE.format(n=len(p), words=p) for p in PHRASES)} AS n_base FROM (SELECT doc_id, regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents)",
    "base_shingles": f"SELECT doc_id, CASE WHEN len(w) = 0 THEN 0 WHEN len(w) < 5 THEN 1 ELSE len(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')))) END AS n_shingles FROM (SELECT doc_id, regexp_extract_all({LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents)",
    "base_secrets": """SELECT doc_id, len(list_filter(regexp_extract_all(t, '(?i:(password|passwd|secret|token|api_?key))["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 8)) AS n_assign,
        len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 16)) AS n_access, len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 32)) AS n_hex FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_sharding, op2_media_columns, op3_chat_formatting, op4_license_scan, op5_ngram_jaccard_join, op6_best_fit_packing, op7_secret_scan, op8_quality, op9_toxicity, op10_decontamination, op11_centroid_clustering, op12_conversation_repair, op13_exact_dedup, base_sharding, base_shard_rows, base_media, base_licenses, base_shingles, base_secrets)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
