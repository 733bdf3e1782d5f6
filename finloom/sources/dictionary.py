"""Dictionaries as dimensions: nomenclature, sections, corrections and account trees from JSON (or parsed YAML)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.match import dimension

TERM = "canonical string, section string, statement string, variations array<string>, ord int, account_code string, field string"


def terms_of(spark: SparkSession, entries: list[dict]) -> DataFrame:
    """Terms in file order from parsed entries."""
    rows = [(e["canonical"], e.get("section"), e.get("statement"), list(e.get("variations", [])), i, e.get("account_code"), e.get("field")) for i, e in enumerate(entries)]
    return spark.createDataFrame(rows, TERM)


def terms(spark: SparkSession, path: str) -> DataFrame:
    """Terms of a JSON file {"entries": [...]}, in order."""
    entry = "struct<canonical:string,section:string,statement:string,variations:array<string>,account_code:string,field:string>"
    read = spark.read.schema(f"entries array<{entry}>").option("multiLine", True).json(path)
    return read.select(F.posexplode("entries").alias("ord", "e")).select("e.canonical", "e.section", "e.statement", F.coalesce("e.variations", F.expr("cast(array() as array<string>)")).alias("variations"), "ord", "e.account_code", "e.field")


def corrections(spark: SparkSession, path: str, standard: str) -> DataFrame:
    """(wrong, correction) of a standard from JSON {"standard": {"wrong": "right"}}; metadata is skipped."""
    read = spark.read.schema("standard string, pairs map<string,string>").json(path)
    return read.filter(F.col("standard") == standard).select(F.explode("pairs").alias("wrong", "correction")).filter("wrong <> 'metadata'")


def accounts(spark: SparkSession, path: str) -> DataFrame:
    """(code, label, parent) of an account tree: a parent's code is the code less its last digit."""
    read = spark.read.schema("accounts map<string,string>").option("multiLine", True).json(path)
    rows = read.select(F.explode("accounts").alias("code", "label"))
    return rows.withColumn("parent", F.when(F.length("code") > 1, F.expr("substring(code, 1, length(code) - 1)")))


def of_statement(found: DataFrame, statement: str) -> DataFrame:
    return found.filter(F.col("statement") == statement)


def prompt_vocabulary(found: DataFrame, statement: str | None = None) -> DataFrame:
    """One text of `- term` lines in order, each term once."""
    rows = found if statement is None else of_statement(found, statement)
    first = rows.groupBy("canonical").agg(F.min("ord").alias("ord"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ord", "canonical"))), lambda x: F.concat(F.lit("- "), x["canonical"]))
    return first.agg(F.array_join(ordered, "\n").alias("prompt"))


def side_keywords(found: DataFrame, sections: DataFrame) -> DataFrame:
    """(side, keyword): lower-case terms and variations of the balance sheet's sides, each once."""
    rows = found.join(dimension(sections.select("section", "side")), "section")
    words = rows.select("side", F.explode(F.concat(F.array("canonical"), "variations")).alias("w"))
    return words.select("side", F.lower("w").alias("keyword")).distinct()


def unmatched_table(cells: DataFrame) -> DataFrame:
    """Rows where no dictionary is at hand: everything unrecognized."""
    return cells.filter("col_idx = 0").select("doc_id", "source", "table_idx", "row_idx", F.col("raw_value").alias("label"), F.lit(None).cast("string").alias("canonical"), F.lit("unrecognized").alias("match_type"), F.lit(0.0).alias("match_confidence"))
