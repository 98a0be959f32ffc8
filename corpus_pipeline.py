"""From raw documents to packed sequences, in stages that each call one operator of placelens.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; each result is
written as Parquet and read again as the next stage's docs. All stages but the
last return the columns of documents.

Cases: a null or empty text has no words and goes with the quality rules; a
null id stays where a stage compares documents, and repeated rows are one
document there; a text that line dedup empties stays, of several the least id;
columns that a stage does not know are handed on; empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placelens.llm import common, decontaminate, host_rules, lines, near_copies, packing

#: Packing needs a tokenizer, which SQL cannot express; tests hold the operator of each stage against a brute-force version, and run the stages one by one.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the host rules reject go."""
    return host_rules.passing(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of three lines, or of 50 words in fewer, go; n_chars follows the text."""
    return lines.remove_runs(docs, passages=True).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by 0.8 or more of their five-word shingles the document with the least id stays; a null id stays.

    Op4's fingerprints and its index of positional bytes link first, and each link is decided by the whole sets; as
    copies at 0.8 differ in too many bits of a SimHash for four of them to find, prefixes of the shingle sets
    (llm/near_copies.py) complete the links, so that none is missed.
    """
    return near_copies.distinct_documents(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces and their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
