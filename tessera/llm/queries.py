"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, line_dedup, lm_scoring, near_dedup, packing, pii, quality_gam, quality_rules, spotsigs, suffix_dedup, vector_codes, warc
from .common import materialise, sized


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_docs(spark, sf_dir), capacity=2048).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    model = quality_gam.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_gam.score(docs, model).withColumn("held_out", quality_gam.held_out()).select("doc_id", "held_out", "score", "predicted")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(_docs(spark, sf_dir), copies_vote=True).select("doc_id", "n_lines", "n_removed", "text")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_encode(_docs(spark, sf_dir), digests=True)


def op5_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edited_likeness(_docs(spark, sf_dir))


def spotsigs_near_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search over all fingerprints of operator 5: length partitions, shared rare signatures, pruned Jaccard."""
    return spotsigs.near_classes(_docs(spark, sf_dir))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(_docs(spark, sf_dir), digest=True).withColumnRenamed("kept", "kept_sha256")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(_docs(spark, sf_dir))
    counts = (F.size(F.filter("base_spans", lambda x, i=i: x["k"] == i)).cast("long").alias(f"n_{kind}") for i, kind in enumerate(pii.KINDS))
    return found.select("doc_id", *counts, F.sha2(pii.spelled(F.col("base_spans")), 256).alias("base_sha256"), pii.spelled(F.col("spans")).alias("spans"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_docs(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target is what labels mark as good and not toxic."""
    docs = _docs(spark, sf_dir)
    good = materialise(spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1 AND toxic = 0 AND doc_id IS NOT NULL").select("doc_id", F.lit(True).alias("good")).distinct(), "good")
    marked = docs.join(sized(good), "doc_id", "left")
    return lm_scoring.score(marked, F.col("good"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_docs(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "kept")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))[0]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_quality_gam,
        op3_line_dedup,
        op4_bpe,
        op5_spotsigs,
        op6_suffix_dedup,
        op7_pii,
        op8_quality_rules,
        op9_lm_scoring,
        op10_near_dedup,
        op11_vector_codes,
        op12_warc,
        op13_centroids,
        spotsigs_near_classes,
    )
}

ORACLE_SQL: dict[str, str] = {"op3_line_dedup": line_dedup.ORACLE, "op11_vector_codes": vector_codes.oracle(), "op12_warc": warc.ORACLE, "op13_centroids": centroids.oracle()}
