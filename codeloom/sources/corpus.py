"""JSON-lines corpus laid out as ``<language>/final/jsonl/<split>/unzipped/*.jsonl``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.functions.repos import clone_url

# Default languages and splits, in scan order.
CORPUS_LANGUAGES = ["python", "javascript", "java", "ruby", "php", "go"]
CORPUS_SPLITS = ["train", "test", "valid"]

CORRUPT = "_corrupt_record"
RECORD_SCHEMA = T.StructType([T.StructField("repo", T.StringType())])


def corpus_glob(base_dir: str, languages=None, splits=None, file_glob: str = "*.jsonl") -> str:
    """One glob over the chosen directories; absent ones are simply not matched."""
    langs = ",".join(languages or CORPUS_LANGUAGES)
    parts = ",".join(splits or CORPUS_SPLITS)
    return f"{base_dir.rstrip('/')}/{{{langs}}}/final/jsonl/{{{parts}}}/unzipped/{file_glob}"


def reader_schema(record_schema: T.StructType = RECORD_SCHEMA) -> T.StructType:
    return T.StructType([*record_schema.fields, T.StructField(CORRUPT, T.StringType())])


def path_language(path: Column) -> Column:
    return F.regexp_extract(path, r"/([^/]+)/final/jsonl/[^/]+/unzipped/", 1)


def path_split(path: Column) -> Column:
    return F.regexp_extract(path, r"/final/jsonl/([^/]+)/unzipped/", 1)


def with_path_columns(raw: DataFrame) -> DataFrame:
    """Language, split and clone URL of every record."""
    path = F.col("_metadata.file_path")
    return raw.select(
        *raw.columns,
        path_language(path).alias("language"),
        path_split(path).alias("split"),
        clone_url(F.col("repo")).alias("github_repo"),
    )


def read_corpus(
    spark: SparkSession,
    base_dir: str,
    languages=None,
    splits=None,
    record_schema: T.StructType = RECORD_SCHEMA,
    file_glob: str = "*.jsonl",
) -> DataFrame:
    """All lines of the chosen files; a line that is no JSON object keeps its text
    in ``_corrupt_record`` and has null fields.
    """
    raw = spark.read.json(
        corpus_glob(base_dir, languages, splits, file_glob),
        schema=reader_schema(record_schema),
        mode="PERMISSIVE",
        columnNameOfCorruptRecord=CORRUPT,
    )
    return with_path_columns(raw)


def good_records(corpus: DataFrame) -> DataFrame:
    return corpus.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def quarantined_lines(corpus: DataFrame) -> DataFrame:
    """Malformed lines with the directory they came from.

    The record's columns stay, since Spark refuses to read the corrupt text alone.
    """
    return corpus.where(F.col(CORRUPT).isNotNull())


def numbered_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, line_no, line) of text files. Numbers count from 0 in each file, however the files
    are cut into blocks for reading, so any other reading gives the same ones.

    The lines of every block are counted first, a row a block; a line's number is the sum of the
    blocks before it in its file and its place in its own, which the task that reads the block counts.
    """
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line")
    )
    counts = lines.groupBy("file", "block").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("file", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    fields = "file string, block long, line string, place long"

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None
        upto = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            files, blocks = batch.column(0).dictionary_encode(), batch.column(1).to_numpy()
            codes = files.indices.to_numpy()
            cuts = np.flatnonzero((codes[1:] != codes[:-1]) | (blocks[1:] != blocks[:-1])) + 1
            places = np.empty(batch.num_rows, np.int64)
            bounds = [0, *cuts.tolist(), batch.num_rows]
            for low, high in zip(bounds[:-1], bounds[1:], strict=True):
                here = files.dictionary[int(codes[low])].as_py(), int(blocks[low])
                upto = upto if here == at else 0
                places[low:high] = np.arange(upto, upto + high - low)
                at, upto = here, upto + high - low
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places)], names=["file", "block", "line", "place"])

    numbered = lines.mapInArrow(placed, fields).join(bases, ["file", "block"])
    return numbered.select("file", (F.col("base") + F.col("place")).alias("line_no"), "line")


def scan_corpus(
    spark: SparkSession,
    base_dir: str,
    languages=None,
    splits=None,
    record_schema: T.StructType = RECORD_SCHEMA,
    file_glob: str = "*.jsonl",
) -> DataFrame:
    """As ``read_corpus``, with ``at``, a key that sorts records in scan order: language, split,
    file, then line. It is the same in every reading. Empty lines are no records, but count."""
    lines = numbered_lines(spark, corpus_glob(base_dir, languages, splits, file_glob)).where("line <> ''")
    path = F.col("file")
    langs = F.array(*[F.lit(x) for x in (languages or CORPUS_LANGUAGES)])
    parts = F.array(*[F.lit(x) for x in (splits or CORPUS_SPLITS)])
    at = F.struct(
        F.array_position(langs, path_language(path)).alias("language_rank"),
        F.array_position(parts, path_split(path)).alias("split_rank"),
        "file",
        "line_no",
    )
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    parsed = lines.select(F.from_json("line", reader_schema(record_schema), options).alias("r"), at.alias("at"), "file")
    return parsed.select(
        "r.*", "at", path_language(path).alias("language"), path_split(path).alias("split"), clone_url(F.col("r.repo")).alias("github_repo")
    )


def write_corpus(records: DataFrame, base_dir: str, body_col: str = "line", order_col: str | None = None) -> None:
    """Write lines into the corpus layout. One job writes all; with ``order_col`` files
    hold them in that order, and follow each other by name.

    Every language and split of the records gets its folder, whether or not it is one of
    the defaults. Folders are moved into the layout once all are written.
    """
    spark = records.sparkSession
    rows = records.select("language", "split", *([order_col] if order_col else []), body_col)
    if order_col:
        rows = rows.repartitionByRange("language", "split", order_col).sortWithinPartitions("language", "split", order_col)
        rows = rows.drop(order_col)
    loose = f"{base_dir.rstrip('/')}/_written"
    rows.write.partitionBy("language", "split").mode("append").text(loose)
    Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = Path(loose).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for folder in fs.globStatus(Path(f"{loose}/language=*/split=*")):
        lang, split = (part.getName().split("=", 1)[1] for part in (folder.getPath().getParent(), folder.getPath()))
        target = Path(f"{base_dir.rstrip('/')}/{lang}/final/jsonl/{split}/unzipped")
        fs.mkdirs(target)
        for file in fs.listStatus(folder.getPath()):
            fs.rename(file.getPath(), Path(target, file.getPath().getName()))
    fs.delete(Path(loose), True)
