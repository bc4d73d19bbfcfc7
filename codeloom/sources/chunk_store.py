"""Persisted chunks by (repo, mode) or in order of a key, and the nested result document."""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.workspace import fresh_dir, materialize

#: Rows of a file of a sorted store, about.
ROWS_PER_FILE = 20_000
#: Fewer rows are not divided, however many tasks could read them.
LEAST_ROWS = 256
#: So few keys are named to the scan, which then skips row groups too.
NAMED_KEYS = 1000


def write_chunk_store(chunks: DataFrame, path: str) -> None:
    """Replace the stores of the (repo, mode) pairs that ``chunks`` holds.

    Spark rebalances the writers by the size of the stores: one with most of the chunks is
    cut into several files, small ones share a writer and are a file each.
    """
    (
        chunks.hint("rebalance", "repo", "mode")
        .write.partitionBy("repo", "mode")
        .option("partitionOverwriteMode", "dynamic")
        .mode("overwrite")
        .parquet(path)
    )


def read_chunk_store(
    spark: SparkSession, path: str, repo: str | None = None, mode: str | None = None
) -> DataFrame:
    """Chunks of one store; the partition filters skip the other folders."""
    chunks = spark.read.option("basePath", path).parquet(path)
    if repo is not None:
        chunks = chunks.where(F.col("repo") == repo)
    if mode is not None:
        chunks = chunks.where(F.col("mode") == mode)
    return chunks


def result_document(results: DataFrame) -> DataFrame:
    """One row per repository: query number -> nested result.

    A repository has a handful of questions, the columns of its sheet row.
    """
    def metrics(mode: str):
        return F.struct(
            F.col(f"{mode}_bleu").alias("bleu"),
            F.col(f"{mode}_rouge_l").alias("rougeL"),
            F.col(f"{mode}_ter").alias("ter"),
        ).alias(mode)

    body = F.struct(
        F.col("question").alias("query"),
        F.col("reference").alias("documentation_reference"),
        "smart_response",
        "naive_response",
        F.struct(metrics("smart"), metrics("naive")).alias("metrics"),
        F.col("chosen_mode").alias("llm_chosen_mode"),
    )
    entry = F.struct(F.concat(F.lit("query_"), F.col("n")).alias("key"), body.alias("value"))
    return results.groupBy("repo").agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("queries")
    )


def write_results(document: DataFrame, path: str) -> None:
    """JSON, one folder per repository, each replaced as a whole."""
    (
        document.write.partitionBy("repo")
        .option("partitionOverwriteMode", "dynamic")
        .mode("overwrite")
        .json(path)
    )


def read_results(spark: SparkSession, path: str, schema) -> DataFrame:
    """The document back as flat rows."""
    nested = spark.read.schema(schema).json(path)
    flat = nested.select("repo", F.explode("queries").alias("key", "r"))
    return flat.select(
        "repo",
        F.regexp_extract("key", r"(\d+)$", 1).cast("bigint").alias("n"),
        F.col("r.query").alias("question"),
        F.col("r.documentation_reference").alias("reference"),
        "r.smart_response",
        "r.naive_response",
        F.col("r.metrics.smart.bleu").alias("smart_bleu"),
        F.col("r.metrics.naive.bleu").alias("naive_bleu"),
        F.col("r.metrics.smart.ter").alias("smart_ter"),
        F.col("r.metrics.naive.ter").alias("naive_ter"),
        F.col("r.llm_chosen_mode").alias("chosen_mode"),
    )


def write_sorted(rows: DataFrame, key: str, rows_per_file: int = ROWS_PER_FILE, path: str | None = None) -> str:
    """Write rows in order of a unique string ``key``, in files of a bounded size, and beside them
    the range of keys of each file. Rows are worked out once. A small store is as many files as the
    session has cores, as work on its texts costs far more than reading. Returns the path."""
    spark = rows.sparkSession
    path = path or fresh_dir(spark, "sorted")
    staged = materialize(rows, "staged")
    n_rows = staged.count()
    parts = max(1, math.ceil(n_rows / rows_per_file), min(spark.sparkContext.defaultParallelism, n_rows // LEAST_ROWS))
    dealt = staged.repartitionByRange(parts, key).sortWithinPartitions(key)
    dealt.write.option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(f"{path}/rows")
    stored = spark.read.schema(rows.schema).parquet(f"{path}/rows")
    ranges = stored.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min(key).alias("low"), F.max(key).alias("high"))
    ranges.coalesce(1).write.parquet(f"{path}/ranges")
    return path


def read_sorted(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/rows")


def fetch(spark: SparkSession, path: str, keys: DataFrame, key: str) -> DataFrame:
    """The rows of a sorted store whose key is in ``keys``, a column of that name. Only files
    whose range holds a key are opened; for few keys only their row groups are read."""
    ranges = sorted(spark.read.parquet(f"{path}/ranges").collect(), key=lambda r: r["low"])
    lows, highs = [r["low"] for r in ranges], [r["high"] for r in ranges]

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[int] = set()
        for batch in batches:
            for value in batch.column(0).to_pylist():
                at = bisect_right(lows, value) - 1 if value is not None else -1
                if at >= 0 and value <= highs[at]:
                    found.add(at)
        yield pa.RecordBatch.from_pydict({"file": pa.array(sorted(found), pa.int32())})

    chosen = keys.select(key)
    files = [ranges[r["file"]]["file"] for r in chosen.mapInArrow(wanted, "file int").distinct().collect()]
    stored = read_sorted(spark, path)
    if not files:
        return stored.where("false")
    opened = spark.read.schema(stored.schema).parquet(*files)
    few = chosen.distinct().limit(NAMED_KEYS + 1).collect()
    if len(few) <= NAMED_KEYS:
        opened = opened.where(F.col(key).isin([r[0] for r in few]))
    return opened.join(chosen.distinct(), key, "left_semi")
