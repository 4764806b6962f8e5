"""The queries over the given tables, by name, and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillstone.llm import chats, language, leaks, license_scan, merkle, packing, pages, quality, repeats
from tillstone.llm import token_files, url_filter, vector_codes
from tillstone.llm.near_dedup import near_duplicates
from tillstone.llm.oracle import ORACLE_SQL  # noqa: F401
from tillstone.operators.storage import WorkTables


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Component and verdict of every document, see ``near_dedup``."""
    documents = table(spark, folder, "documents").select("doc_id", "text")
    found = near_duplicates(documents, WorkTables(spark)).groups
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    return found.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of every document with its sequence and offset, see ``packing``."""
    return packing.packed(table(spark, folder, "documents"), WorkTables(spark))


def op3_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark windows found in every document, see ``leaks``."""
    found = leaks.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"), WorkTables(spark))
    return found.select(
        F.col("key").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op4_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """License phrases and labels of every document, see ``license_scan``."""
    return license_scan.license_scan(table(spark, folder, "documents"), WorkTables(spark))


def op5_chats(spark: SparkSession, folder: str) -> DataFrame:
    """Every message as canonical JSON with its tool calls linked and checked, see ``chats``."""
    return chats.formatted(table(spark, folder, "conversations"), WorkTables(spark))


def op6_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page, see ``pages``."""
    return pages.extracted(table(spark, folder, "pages"), WorkTables(spark))


def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Measures and verdict of every document, see ``quality``."""
    held, rows = quality.judged(table(spark, folder, "documents").select("doc_id", "text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lost_words"]
    return rows.select(F.col(held["doc_id"]).alias("doc_id"), *names)


#: The rules of ``op8_urls``.
URL_RULES = [
    url_filter.Rule("block", "net"),
    url_filter.Rule("allow", "example.net", "/en/"),
    url_filter.Rule("block", "example.com", "/de/"),
    url_filter.Rule("allow", "org", "/fr/"),
]


def op8_urls(spark: SparkSession, folder: str) -> DataFrame:
    """Rule and verdict of every page's url, see ``url_filter``."""
    return url_filter.judged(table(spark, folder, "pages"), URL_RULES)


def op9_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every document without repeated passages, and where these stay, see ``repeats``."""
    return repeats.repeats_report(table(spark, folder, "documents"), WorkTables(spark))


def op10_language(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted language of every document, see ``language``."""
    documents = table(spark, folder, "documents")
    return language.predicted(documents, language.learned(documents))


def op11_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as it is read back from flat files of token ids, see ``token_files``."""
    manifest = token_files.write_tokens(table(spark, folder, "documents"), WorkTables(spark))
    return token_files.read_tokens(manifest)


def op12_merkle(spark: SparkSession, folder: str) -> DataFrame:
    """Digests and proof of every document, some of them tampered with before they are verified, see ``merkle``."""
    grown = {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    where = F.col("n_chars").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0)
    found = merkle.manifest(table(spark, folder, "documents"), WorkTables(spark), grown, where)
    return found.proofs.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Code and error of every vector, and the digest of the codebooks, see ``vector_codes``."""
    found = vector_codes.coded(table(spark, folder, "embeddings"), WorkTables(spark))
    digest = found.codebook.digest if found.codebook else None
    return found.rows.select("vec_id", "code", "error", "label_error", F.lit(digest).cast("string").alias("codebooks_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        op1_near_dedup,
        op2_packing,
        op3_leaks,
        op4_licenses,
        op5_chats,
        op6_pages,
        op7_quality,
        op8_urls,
        op9_repeats,
        op10_language,
        op11_token_files,
        op12_merkle,
        op13_codes,
    )
}
