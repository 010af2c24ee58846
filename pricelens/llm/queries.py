"""The corpus operators over the driver tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.llm import (
    centroids, checks, chunk_dedup, decontaminate, html_text, license_scan, merkle, near_dup, packing, pii, quality_rules, shards, token_count,
    window_dedup,
)
from pricelens.llm.common import table, tokenizer_file
from pricelens.session import configure, cut_lineage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, check: str | None = None):
    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(configure(spark), sf_dir)
        if check is not None:
            ORACLES[name] = check
        return fn

    return add


@query("op1_license_scan", checks.license_scan())
def license_scan_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


@query("op2_quality_rules")
def quality_rules_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    assessed = cut_lineage(quality_rules.assess(table(spark, sf_dir, "documents")))
    rules = quality_rules.fit_rules(assessed, table(spark, sf_dir, "labels"))
    return assessed.select(
        "doc_id", F.col("q_n_words").alias("n_words"), F.col("q_word_chars").alias("word_chars"),
        F.col("q_n_symbols").alias("n_symbols"), F.col("q_n_dup_lines").alias("n_dup_lines"),
        F.col("q_n_repeat_words").alias("n_repeat_words"), quality_rules.base_failed().alias("base_failed"),
        (~quality_rules.base_failed() & quality_rules.verdict(rules)).alias("kept"),
    )


@query("op7_interleaved_shards")
def interleaved_shards_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``rows``: counts at most one apart."""
    return shards.interleave(table(spark, sf_dir, "documents"), shards=24).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "source",
    )


@query("op10_simhash_ring")
def simhash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id", "representative")


@query("op5_string_tiling")
def string_tiling_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a benchmark item, one row per document and item."""
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("row_key")


@query("op6_chunk_dedup")
def chunk_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages that stand in several documents, one row per place."""
    return chunk_dedup.repeated_passages(table(spark, sf_dir, "documents")).drop("row_key")


@query("op3_token_count")
def token_count_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts under the public piece vocabulary and its scores."""
    return token_count.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model")).drop("row_key")


@query("op4_packing")
def packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json")).drop("row_key")


@query("op8_personal_data")
def personal_data_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))

    def n(kind: str):
        return F.size(F.filter("plain", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *(n(k) for k in pii.KINDS), F.sha2("base_text", 256).alias("base_sha256"), F.col("spans_text").alias("spans"))


@query("op9_tag_path_text")
def tag_path_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract_main_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.col("main_chars").alias("n_chars"))


@query("op11_radix_windows", checks.repeated_windows())
def radix_windows_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes under repeated strings of 100 bytes removed."""
    found = window_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op12_merkle_manifest", checks.merkle())
def merkle_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five columns a leaf; a verifier sees every fifth text, by its id's checksum, in lower case."""
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return merkle.manifest(
        table(spark, sf_dir, "documents"), seen={"text": merkle.ascii_lowered(F.col("text"))}, seen_where=changed)


@query("op13_bisector_clusters", checks.centroids())
def bisector_clusters_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 centroids, five rounds."""
    found = centroids.cluster(table(spark, sf_dir, "embeddings"))
    return found.select(
        "vec_id", "cluster", *(F.col(c).try_cast("bigint").alias(c) for c in ("distance", "cluster_inertia", "inertia")), "centroid_sha256")
