"""Languages and their file extensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# File extensions of each known language.
LANGUAGE_EXTENSIONS = {
    "python": [".py"],
    "java": [".java"],
    "javascript": [".js", ".jsx"],
    "typescript": [".ts"],
    "c": [".c"],
    "cpp": [".cpp", ".cc", ".cxx", ".hpp"],
    "go": [".go"],
    "ruby": [".rb"],
    "php": [".php"],
}


def language_table(spark: SparkSession) -> DataFrame:
    """(language, ext), a table of fixed size."""
    rows = [(lang, ext) for lang, exts in LANGUAGE_EXTENSIONS.items() for ext in exts]
    return spark.createDataFrame(rows, "language string, ext string")


def extensions_of(language: str) -> list[str]:
    found = LANGUAGE_EXTENSIONS.get(language.lower())
    if not found:
        raise ValueError(f"no extensions known for {language!r}; known are {', '.join(LANGUAGE_EXTENSIONS)}")
    return found


def file_extension(path: Column) -> Column:
    """From the last dot of the last path part, or an empty string."""
    return F.regexp_extract(path, r"(\.[^./]+)$", 1)


def with_known_language(df: DataFrame, language_col: str = "language") -> tuple[DataFrame, DataFrame]:
    """Rows whose language is known (case-folded), and rows whose language is not."""
    known = F.broadcast(language_table(df.sparkSession).select("language").distinct())
    folded = df.withColumn(language_col, F.lower(language_col))
    if language_col != "language":
        known = known.withColumnRenamed("language", language_col)
    return (
        folded.join(known, language_col, "left_semi"),
        folded.join(known, language_col, "left_anti"),
    )


def require_known_language(df: DataFrame, language_col: str = "language") -> DataFrame:
    """All rows, their language case-folded; an unknown language of any row is an error
    that names a few of them."""
    known, unknown = with_known_language(df, language_col)
    bad = [str(r[0]) for r in unknown.select(language_col).distinct().limit(5).collect()]
    if bad:
        raise ValueError(f"no extensions known for {', '.join(sorted(bad))}; known are {', '.join(LANGUAGE_EXTENSIONS)}")
    return known


def files_of_language(files: DataFrame, path_col: str = "path") -> DataFrame:
    """Files with a known extension, one row per (file, language) that owns it."""
    langs = F.broadcast(language_table(files.sparkSession))
    return files.withColumn("ext", file_extension(F.col(path_col))).join(langs, "ext")
