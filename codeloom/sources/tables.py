"""Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str, spread_by: str | None = None) -> DataFrame:
    """A Parquet table. Text work costs far more per byte than reading, so a table that
    Spark would read in fewer tasks than the session has cores is spread over them by
    ``spread_by``; a larger one is read as it lies.
    """
    table = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    if spread_by and table.rdd.getNumPartitions() < cores:
        table = table.repartition(cores, spread_by)
    return table
