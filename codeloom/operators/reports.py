"""Counts over corpora and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def corpus_counts(records: DataFrame) -> DataFrame:
    """Records per (language, split), per language and in total; null marks a total."""
    return records.rollup("language", "split").agg(
        F.count("*").alias("n"), F.grouping_id().cast("bigint").alias("level")
    )


def progress_counts(chunks: DataFrame) -> DataFrame:
    """Files, chunks and repositories per mode."""
    return chunks.groupBy("mode").agg(
        F.count("*").alias("n_chunks"),
        F.countDistinct("repo", "path").alias("n_files"),
        F.countDistinct("repo").alias("n_repos"),
    )
