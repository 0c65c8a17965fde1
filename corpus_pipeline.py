"""The training-data pipeline: quality rules, near-dedup, decontamination, PII, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobloom.llm import decontaminate, packing, pii, quality, simhash
from jobloom.llm.common import saved, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go.  A null or empty text has no words and goes; repeated rows stay or go
    together; without labels the base rules alone decide; an empty table stays empty."""
    return quality.keep(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest doc_id, of several rows with
    that id one.  Null and empty texts have fingerprint zero and are one group; an empty table stays empty."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a benchmark item, edited or not, go.  Null and empty texts hold none and stay;
    repeated rows stay or go together; with an empty benchmark all stay."""
    return decontaminate.keep_clean(docs, decontaminate.each_block(docs, table(spark, sf_dir, "benchmark")))


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind, n_chars follows; every document stays.  A null text
    stays null; repeated rows are changed alike; an empty table stays empty."""
    return pii.redact(docs, pii.fit(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of the documents with their sequences and places.  A null or empty text is one piece, the
    end id; repeated rows are packed each; an empty table gives no piece."""
    return packing.pack_documents(docs)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("decontamination", decontamination),
          ("redaction", redaction), ("best_fit_packing", best_fit_packing)]

# a forest, connected components, alignment, boosted trees and packing are beyond SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
