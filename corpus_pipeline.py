"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and read again for the
next. All but the last return the columns of ``documents``.

Rows are judged one by one, also where ids are null or repeated. Null and empty texts have no words, so
the quality rules reject them; a stage that gets them nevertheless (they are near copies of each other,
hold no item and no secret, and are one token) does not fail. Ties and repeated rows are near copies of
which one stays. An empty table gives an empty result in every stage. Columns besides those of
``documents``, whatever their names, are not read.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm import decontam, packing, quality, secrets, simhash
from tallyweave.scratch import remove, scratch_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the rules keep, each judged by its own text and language."""
    return quality.quality_rules(docs, keep=COLUMNS).where("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.near_dedup(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item."""
    benchmark = spark.read.parquet(os.path.join(sf_dir, "benchmark.parquet"))
    return decontam.without_items(docs.select(*COLUMNS), benchmark)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by marks; ``n_chars`` counts the new texts."""
    clean = secrets.scan_secrets(docs, keep=("doc_id", "lang", "source"), redact="text_")
    return clean.select("doc_id", F.col("text_").alias("text"), "lang", "source", F.char_length("text_").cast("long").alias("n_chars"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("best-fit packing", best_fit_packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(os.path.join(sf_dir, "documents.parquet")), None
    for k, (_, stage) in enumerate(STAGES[:-1]):
        path = scratch_path(spark, f"pipeline-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if last:
            remove(spark, last)
        docs, last = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
