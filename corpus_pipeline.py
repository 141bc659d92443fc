"""The corpus pipeline: toxicity, exact duplicates, near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. Rejected documents go, all but one of each group of copies go, live secrets are replaced in the texts, and
the rest is packed into windows of 2048 ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattspan.llm.common import discard, materialise
from wattspan.llm.exact_dedup import keep_one
from wattspan.llm.near_dedup import keep_representatives
from wattspan.llm.packing import pack_documents
from wattspan.llm.secrets import redact
from wattspan.llm.toxicity import fit_toxicity, keep_clean


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model doesn't call toxic; it learns from labelled documents outside the held-out fifth."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_toxicity(docs, labels, learn=F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    return keep_clean(docs, model)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id."""
    return keep_one(docs, keep="largest")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the smallest doc_id."""
    return keep_representatives(docs, percent=80)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with live secrets replaced."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents."""
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("secret_scans", secret_scans), ("packing", packing)]

#: SQL cannot express the learned scores and the tokenizer; tests/llm/test_pipeline.py compares with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage is written to the shared folder and read again, and deleted once the next is written."""
    docs, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        if written is not None:
            discard(written)
        written = docs
    return docs
