"""Sources and sinks: logs, rules, dictionaries, nested results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VARIATIONS = "raw_text string, matched_to string, match_type string, approved boolean, ts timestamp"
RULE = "struct<rule_id:string,tier:string,severity:string,tolerance:double,active:boolean,standards:array<string>>"


def variation_log(spark: SparkSession, path: str, schema: str = VARIATIONS) -> DataFrame:
    """JSON lines; broken lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def last_events(log: DataFrame, n: int = 100, order: str = "ts") -> DataFrame:
    return log.orderBy(F.col(order).desc()).limit(n)


def rules(spark: SparkSession, path: str, standard: str) -> DataFrame:
    """Active rules of a standard from a JSON file {"rules": [...]}."""
    read = spark.read.schema(f"rules array<{RULE}>").option("multiLine", True).json(path)
    return read.select(F.explode("rules").alias("r")).select("r.*").filter(F.col("active") & F.array_contains("standards", standard))


def rules_of_tier(found: DataFrame, tier: str) -> DataFrame:
    return found.filter(F.col("tier") == tier)


def vocabulary(corrections: DataFrame, function_words: list[str]) -> DataFrame:
    """Words of all corrections and the function words, upper-case, each once."""
    words = corrections.select(F.explode(F.split("correction", r"\s+")).alias("w")).select(F.upper(F.regexp_replace("w", r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")).alias("word"))
    extra = corrections.sparkSession.createDataFrame([(w.upper(),) for w in function_words], "word string")
    return words.unionByName(extra).filter("word <> ''").distinct()


def binary_documents(spark: SparkSession, path: str) -> DataFrame:
    """Uploaded files with their kind by extension; unknown kinds are left out."""
    from ..operators.filters import EXTENSIONS

    files = spark.read.format("binaryFile").load(path)
    return files.withColumn("kind", F.lower(F.regexp_extract("path", r"\.(\w+)$", 1))).filter(F.col("kind").isin(*EXTENSIONS))


def nested_rows(cells: DataFrame, keys) -> DataFrame:
    """One map of column to raw value for each row, columns in order."""
    pairs = F.array_sort(F.collect_list(F.struct("col_idx", "col_name", "raw_value")))
    return cells.groupBy(*keys, "row_idx").agg(F.map_from_entries(F.transform(pairs, lambda p: F.struct(p["col_name"], p["raw_value"]))).alias("cells"))


def result_json(rows: DataFrame, keys) -> DataFrame:
    """One JSON document a key."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.to_json(F.array_sort(F.collect_list(F.struct(*rest)))).alias("result"))


def report_of_json(stored: DataFrame, column: str = "report") -> DataFrame:
    """Counters of stored reports, made anew from their checks."""
    checks = F.explode(F.from_json(column, "struct<checks:array<struct<name:string,passed:boolean,severity:string>>>").getField("checks"))
    return stored.select("doc_id", checks.alias("c")).groupBy("doc_id").agg(F.count("*").alias("total"), F.count_if("c.passed").alias("passed"), F.count_if(~F.col("c.passed") & (F.col("c.severity") == "CRITICAL")).alias("critical"))


def validated_checks(checks: DataFrame, overrides: DataFrame) -> DataFrame:
    """Automatic verdicts under the reviewer's."""
    given = overrides.select("doc_id", "check_name", F.col("passed").alias("override"))
    return checks.join(given, ["doc_id", "check_name"], "left").withColumn("passed", F.coalesce("override", "passed")).drop("override")


def upload_key(org, name):
    return F.concat_ws("/", org, F.expr("uuid()"), name)
