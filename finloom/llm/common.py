"""What the corpus operators share: table access, shared-storage cuts of lineage, text rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import stored

#: A word of a text: a run of anything but blank, tab, line feed, vertical tab, form feed and return.
WORD = r"[^\x20\x09-\x0D]++"
#: A word of the folded form: letters and digits of any script. As positive ranges the pattern runs four times as fast
#: as the same set written by what it leaves out.
FOLDED_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]++"
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, lost executors cost nothing."""
    return stored(df, name)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z and nothing else; the built-in lower() does so for text without wider characters."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def digest(name: str = "text") -> Column:
    """Tells apart the texts of rows that share an id."""
    return F.coalesce(F.xxhash64(F.col(name)), F.lit(0))


def once(df: DataFrame, name: str, value: Column | str) -> DataFrame:
    """df with a column that is computed once a row: a generator of one row, through which the optimizer neither
    pushes filters nor copies the expression into lambdas (where it would run again for every element)."""
    return df.withColumn(name, F.explode(F.array(F.expr(value) if isinstance(value, str) else value)))
