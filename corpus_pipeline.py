"""From documents to a mix: identified, without repeated lines, near copies and test items, then weighed by source.

Each stage takes the documents that its predecessor kept, and is written before the next one reads them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orelayer.llm import decontaminate, jaccard, language, line_dedup, mixing
from orelayer.llm.text import table
from orelayer.session import written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose languages with a tenth of the text or more make up less than half together, go."""
    return language.keep_identified(docs, language.learn(docs, F.lit(True)))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that at least three documents have stay in the last of them only."""
    return line_dedup.without_repeated_lines(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies the document with the smallest id stays."""
    return jaccard.keep_one_per_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    return decontaminate.without_items(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes."""
    return mixing.mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("mixing", mixing_stage),
]

# SQL can express neither the language model nor the retrieval; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
