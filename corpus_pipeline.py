"""A training-data pipeline: five stages, each a decision of one operator on all documents that are left.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next stage's ``docs``. All but the last return the columns of ``documents``.

* quality: documents that the compression classifier scores below its threshold go;
* near_duplicates: of documents whose SimHash fingerprints are linked the one with the smallest id stays;
* decontamination: documents with a share of benchmark words that counts as contaminated go;
* secrets: live-looking credentials are masked, widely copied examples stay, no document goes;
* packing: the pieces of all documents with their places in sequences of 2048 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfmark.llm import decontaminate, packing, quality, secret_scan, simhash
from shelfmark.llm.queries import QUALITY_THRESHOLD, quality_model, table
from shelfmark.runtime import cut_lineage


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality_model(spark, docs, sf_dir), QUALITY_THRESHOLD)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs, simhash.DISTANCE, simhash.SHINGLE)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.mask(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("quality", good_quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("secrets", secrets), ("packing", packed)]

#: Compression, fingerprints by XXH64 and token ids are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        docs = out if name == STAGES[-1][0] else cut_lineage(out)
    return docs
