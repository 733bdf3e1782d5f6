"""The training-corpus pipeline: each stage reads what its predecessor wrote and applies its decisions.

Defined results, for every stage: columns beyond those of documents are dropped, also where they are named like one an
operator adds; a null id is a document like others, last in order; a null source is a source; repeated rows are judged
alike until near duplicates leave one of them; texts of any length are read whole; an empty table gives an empty table
of the stage's columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finloom.llm import decontam, linededup, mixing, neardup, quality
from finloom.llm.common import materialise, table
from finloom.llm.registry import pipeline_sql

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go; null and empty texts have too few words."""
    return quality.keep(docs).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; n_chars follows the text, which is empty where all lines went or it was null."""
    done = linededup.dedup_lines(docs.select(*COLUMNS))
    return done.withColumns({"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")}).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document of smallest id stays; equal texts, empty ones too, are one class."""
    return neardup.keep_first(docs.select(*COLUMNS)).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; none do where the benchmark is empty."""
    found = decontam.find_overlap(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return found.filter(F.size("hit_runs") == 0).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, in words; documents it does not take go."""
    return mixing.mix(docs.select(*COLUMNS)).filter("taken > 0").select(*COLUMNS, "size", "source_size", "target", "taken")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near-duplicate removal", near_dedup),
    ("benchmark decontamination", decontamination),
    ("source mix", source_mix),
]

ORACLE_SQL = pipeline_sql()


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, f"stage{i}")
    return docs
