"""Source trees and evaluation sheets."""

from __future__ import annotations

from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.sources.languages import extensions_of, file_extension

QUESTIONS_PER_PROJECT = 5

SHEET_SCHEMA = T.StructType(
    [
        T.StructField("Project Name", T.StringType()),
        T.StructField("Github URL", T.StringType()),
        *[
            T.StructField(f"{kind} {i}", T.StringType())
            for kind in ("Query", "Doc")
            for i in range(1, QUESTIONS_PER_PROJECT + 1)
        ],
    ]
)


def _whole_files(reader, paths) -> DataFrame:
    return reader.text(paths, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")
    )


def read_source_tree(
    spark: SparkSession, root: str, language: str = "python", exts: list[str] | None = None
) -> DataFrame:
    """(path, text) of every file below ``root`` with one of the extensions."""
    exts = exts or extensions_of(language)
    glob = "*{" + ",".join(exts) + "}"
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    return _whole_files(reader, root)


def read_source_files(
    spark: SparkSession, paths: str | list[str], language: str = "python", exts: list[str] | None = None
) -> DataFrame:
    """(path, text) of the files named (globs are fine), as a list or separated by commas."""
    names = paths.split(",") if isinstance(paths, str) else paths
    exts = exts or extensions_of(language)
    files = _whole_files(spark.read, [n.strip() for n in names])
    return files.where(file_extension(F.col("path")).isin(exts))


def read_eval_sheet(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation sheet; quoted cells may hold line breaks and doubled quotes."""
    return spark.read.csv(
        path,
        schema=SHEET_SCHEMA,
        header=True,
        multiLine=True,
        quote='"',
        escape='"',
    )


def write_eval_sheet(sheet: DataFrame, path: str) -> None:
    sheet.write.csv(path, header=True, quote='"', escape='"', quoteAll=True)


def local_path(uri: str) -> str:
    """Path part of a file URI."""
    return urlparse(uri).path if "://" in uri or uri.startswith("file:") else uri
