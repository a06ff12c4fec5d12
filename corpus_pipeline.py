"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it to the shared folder
as Parquet and rereads it as the next stage's docs. All stages but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinemill.llm import decontaminate, packing, pii, quality, simhash
from cinemill.llm.common import stage, table
from cinemill.llm.tokens import tokenizer_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on labelled rows of docs, does not reject."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, the one with the smallest id and then text hash, of each group linked by five-word shingles.

    Three differing bits of 64 would only link texts that share nearly all shingles; texts whose
    shingles' exact Jaccard is 0.8 or more are linked here, and no others. A null id comes last; rows
    of one id, or none, stay side by side where their texts are no copies.
    """
    found = simhash.copy_groups(docs)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("first"))
    first = first.select(F.col("first.doc_id").alias("_first"), F.col("first.th").alias("_hash"))
    rows = docs.withColumn("_th", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    kept = rows.join(first, F.col("doc_id").cast("long").eqNullSafe(F.col("_first")) & (F.col("_th") == F.col("_hash")), "left_semi")
    return kept.dropDuplicates(["doc_id", "_th"]).drop("_th")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def pii_sanitisation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data and disclosing terms replaced; n_chars follows the text."""
    return pii.sanitised(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def vector_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, with their ids."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), 2)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pii_sanitisation", pii_sanitisation),
    ("vector_packing", vector_packing),
]

#: SQL can express neither the trained classifier nor the tokenizer; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
