"""A corpus pipeline of five stages over `documents`; every stage's decisions take effect in the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import line_dedup, near_dedup, packing, pii, quality_gam
from tessera.llm.common import fresh, materialise, sized


def _resized(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of `like`, with n_chars as the new text has it."""
    return docs.withColumn("n_chars", F.length("text").cast(like.schema["n_chars"].dataType)).select(*like.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    model = quality_gam.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality_gam.score(docs, model, keep=tuple(docs.columns))
    return scored.filter(F.col(scored.columns[-1]) == 1).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that many sites share in different texts, however much of a text they are."""
    return _resized(line_dedup.line_dedup(docs), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that with the smallest id, a null id after all others.

    Each row is judged by its own text: null and repeated ids are rows like any other.
    """
    (row,) = fresh(docs, "_row")
    rows = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = near_dedup.near_duplicates(rows, row).select(row, "component_id")
    ids = rows.select(F.col(row), F.struct(F.col("doc_id").isNull(), "doc_id", row).alias("_order"))
    first = found.join(ids.hint("merge"), row).groupBy("component_id").agg(F.min("_order").alias("_order"))
    kept = materialise(first.select(F.col("_order")[row].alias(row)), "kept")
    return rows.join(sized(kept), row, "left_semi").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    return _resized(pii.redact(docs), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all token pieces in sequences of 2048."""
    return packing.pack_documents(docs, capacity=2048).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packed", packed),
]

#: Trained models and tokens are beyond SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, name)
    return docs
