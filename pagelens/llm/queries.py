"""The queries of the corpus operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.llm import centroid_clusters, conversation_repair, embedding_dedup, html_main, license_scan, line_dedup, media, mixing, near_dedup, packing, substring_dedup, toxicity, url_filters
from pagelens.llm.common import read

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept", "n_shingles")


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(read(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract_main_text(read(spark, sf_dir, "pages"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(read(spark, sf_dir, "embeddings"))


def op5_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    found = url_filters.filter_urls(url_filters.dated_captures(pages), url_filters.dated_entries(pages))
    return found.withColumns({c: F.col(c).cast("string") for c in ("fetched_on", "valid_from")})


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path())


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(read(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(read(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read(spark, sf_dir, "conversations")
    return conversation_repair.repair_report(conversation_repair.damaged(conversations), conversations)


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(read(spark, sf_dir, "documents"))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters.cluster_vectors(read(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_minhash_near_dedup, op2_media_columns, op3_html_extraction, op4_embedding_near_dedup, op5_mixing_sources, op6_toxicity, op7_url_filters, op8_packing, op9_license_scans, op10_substring_dedup, op11_conversation_repair, op12_line_dedup, op13_centroid_clusters)
    return {q.__name__: q for q in named}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_embedding_near_dedup": embedding_dedup.ORACLE,
        "op5_mixing_sources": mixing.ORACLE,
        "op7_url_filters": url_filters.ORACLE,
        "op9_license_scans": license_scan.ORACLE,
        "op10_substring_dedup": substring_dedup.ORACLE,
        "op11_conversation_repair": conversation_repair.ORACLE,
        "op12_line_dedup": line_dedup.ORACLE,
        "op13_centroid_clusters": centroid_clusters.ORACLE,
    }
