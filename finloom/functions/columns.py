"""Small helpers on frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """A column behind a one-row generator: filters and lambdas above it see a value, not the expression."""
    return df.withColumn(name, F.explode(F.array(value)))


def rank_flag(flag: Column) -> Column:
    return F.when(flag == "red", 2).when(flag == "yellow", 1).otherwise(0)


def flag_of(rank: Column) -> Column:
    return F.when(rank == 2, "red").when(rank == 1, "yellow").otherwise("green")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files are too few to keep them busy (one row group is one task); else df itself."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() * 2 <= cores else df
