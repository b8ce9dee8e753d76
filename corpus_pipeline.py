"""The training corpus pipeline: stages that each take what the one before kept, written in between."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kveil.llm.common import scratch, table
from kveil.llm.exact import keep_first
from kveil.llm.packing import pack_documents
from kveil.llm.pii import mask_documents
from kveil.llm.quality import keep_clean
from kveil.llm.simhash import keep_one

STAGES = [
    ("quality_rules", keep_clean),
    ("exact_dedup", keep_first),
    ("simhash_near_dedup", keep_one),
    ("personal_data", mask_documents),
    ("best_fit_packing", pack_documents),
]

# Tokens and fingerprints are beyond SQL; the tests hold every stage against a brute-force form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written as Parquet and read again.

    The last stage's rows are token pieces with their places in sequences.
    """
    docs = table(spark, sf_dir, "documents")
    folder = scratch(spark, "pipeline")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
