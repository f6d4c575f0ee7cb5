"""The training-data pipeline over ``documents``: each stage works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leadloom.llm.common import table, tune
from leadloom.llm.decontaminate import drop_contaminated
from leadloom.llm.language_id import keep_identified
from leadloom.llm.packing import pack
from leadloom.llm.secrets import redact_secrets
from leadloom.llm.shingles import keep_one_similar
from leadloom.llm.tokens import vocabulary
from leadloom.scratch import Scratch


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or far from every language's centroids, go."""
    tune(spark)
    return keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (five-word shingles, similarity 0.8) stays, the one with the smallest doc_id."""
    tune(spark)
    return keep_one_similar(docs, Scratch(spark, "dedup"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, within its edits, go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in place; every document stays."""
    tune(spark)
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences that training reads: a row per piece."""
    tune(spark)
    return pack(docs, vocabulary("word_bpe_49k.json"), 1, Scratch(spark, "packing"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

#: SQL can express neither centroids, edit matching nor packing; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what each stage returns is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        done = docs
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        scratch.drop(done)
    return STAGES[-1][1](spark, docs, sf_dir)
