"""The corpus pipeline: quality, near-duplicates, contamination, secrets, packing.

Each stage is written as Parquet and read again as the next one's documents.  All but the last keep the columns of
documents: the first three drop rows, the fourth rewrites texts that hold secrets, and the last returns the pieces of
the packed sequences.

Defined cases, as the operators have them.  Null and empty texts: the classifier scores them like texts without features;
equal empty texts are one class and every null text is one of its own; they hold no benchmark words and no secrets, and are
packed as the end id alone.  Very long texts count whole.  Of rows that repeat a text one stays after near_dedup, the one
with the smallest id (of rows that also share that, any one).  Empty tables pass as empty tables.  Extra columns of any name
are kept up to packing and don't take part; packing keeps doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verisect.llm import decontam, minhash_dedup, packing, quality, secrets
from verisect.llm.common import materialize


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least 0.3; learned from the labels of the documents' training folds."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id."""
    return minhash_dedup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth are benchmark passages."""
    return decontam.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every found secret replaced."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.packing_report(docs)


STAGES = [("quality", quality_filter), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("secrets", hide_secrets), ("packing", pack)]

#: SQL can't express the classifier, the signatures or the tokenizer; tests/llm/test_pipeline.py has the brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
