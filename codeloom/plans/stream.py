"""Queries that drain streams over the corpus."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.plans import sql as S
from codeloom.plans import flows, views
from codeloom.plans.registry import query
from codeloom.streaming import ingest
from codeloom.workspace import fresh_dir


def corpus_stream(spark: SparkSession, sf: str, files: int = 40) -> DataFrame:
    return ingest.stream_corpus(
        spark,
        views.corpus_folder(spark, sf),
        record_schema=views.RECORD,
        max_files_per_batch=files,
        file_glob=views.WRITTEN,
    )


@query(
    "stream_corpus",
    f"WITH {S.CORPUS} SELECT seq, repo, path, language, split, md5(text) AS text_md5 FROM corpus",
)
def stream_corpus(spark: SparkSession, sf: str) -> DataFrame:
    drained = ingest.drain_to_table(
        corpus_stream(spark, sf), fresh_dir(spark, "drained"), fresh_dir(spark, "progress")
    )
    return drained.select("seq", "repo", "path", "language", "split", F.md5("text").alias("text_md5"))


@query(
    "stream_dedup",
    f"WITH {S.CORPUS} SELECT repo, arg_min(path, seq) AS path, min(seq) AS seq FROM corpus GROUP BY repo",
)
def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """The first record of each repository in scan order, whichever of its files comes first: three files a batch."""
    records = corpus_stream(spark, sf, files=3).select("repo", "path", "seq")
    corrections = ingest.drain_to_table(
        ingest.first_seen(records, order="seq"), fresh_dir(spark, "firsts"), fresh_dir(spark, "progress")
    )
    return ingest.resolve_firsts(corrections)


#: Files a batch of the streams that index.
INDEX_FILES = 8


def _collected(spark: SparkSession, sf: str, mode: str) -> DataFrame:
    """The corpus as a stream, indexed into a collection batch by batch."""
    name = f"c_{uuid.uuid4().hex}"
    files = corpus_stream(spark, sf, files=INDEX_FILES).select("repo", "path", "language", "text")
    return flows.index_stream_files(files, mode, name, fresh_dir(spark, "progress"))


@query(
    "stream_index",
    f"WITH {S.CORPUS},{S.windowed(source='corpus', key='seq')} "
    "SELECT substr(sha256(repo || '|' || path || '|' || win || '|naive|' || w.text), 1, 36) AS id, split_part(repo, '/', 2) AS repo_name, "
    "language, path AS chunk_file, md5(w.text) AS code_md5, 1024::BIGINT AS dim FROM windows w JOIN corpus USING (seq)",
)
def stream_index(spark: SparkSession, sf: str) -> DataFrame:
    return _collected(spark, sf, "naive").select(
        "id", "repo_name", "language", "chunk_file", F.md5("chunk_code").alias("code_md5"),
        F.size("embedding").cast("bigint").alias("dim"),
    )


@query(
    "stream_index_smart",
    f"""WITH RECURSIVE {S.CORPUS},{S.structural()},
    cut AS (SELECT doc_id || ':' || s AS chunk_id, * FROM chunks),{S.summarized('summaries', 'cut', 'chunk_id')}
    SELECT substr(sha256(repo || '|' || path || '|' || s || '|structural|' || c.text), 1, 36) AS id, split_part(repo, '/', 2) AS repo_name,
           language, path AS chunk_file, start_line || '-' || end_line AS chunk_lines, md5(c.text) AS code_md5, md5(summary) AS summary_md5
    FROM cut c JOIN summaries USING (chunk_id) JOIN corpus ON seq = doc_id""",
)
def stream_index_smart(spark: SparkSession, sf: str) -> DataFrame:
    """Structural chunks, summed up, their summaries embedded."""
    return _collected(spark, sf, "structural").select(
        "id", "repo_name", "language", "chunk_file", "chunk_lines", F.md5("chunk_code").alias("code_md5"),
        F.md5("summary").alias("summary_md5"),
    )
