"""Queries over sources, names, first records and collections."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import repos, text, vectors
from codeloom.operators import firsts, reports
from codeloom.operators.enrich import chunk_records, telling_sentences
from codeloom.plans import sql as S
from codeloom.plans import views
from codeloom.plans.registry import query
from codeloom.sources import chunk_store, collection, corpus, files, languages
from codeloom.workspace import fresh_dir


@query(
    "corpus_scan",
    f"WITH {S.CORPUS} SELECT seq, repo, path, language, split, 'https://github.com/' || repo || '.git' "
    "AS github_repo, md5(text) AS text_md5 FROM corpus",
)
def corpus_scan(spark: SparkSession, sf: str) -> DataFrame:
    scanned = corpus.read_corpus(
        spark, views.corpus_folder(spark, sf), record_schema=views.RECORD, file_glob=views.WRITTEN
    )
    return corpus.good_records(scanned).select(
        "seq", "repo", "path", "language", "split", "github_repo", F.md5("text").alias("text_md5")
    )


@query(
    "corpus_quarantine",
    f"""WITH {S.CORPUS} SELECT language, split, '{{"seq": ' || seq || ', "repo": "cut' AS bad_line,
    NULL::VARCHAR AS path FROM corpus WHERE seq % 50 = 0""",
)
def corpus_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    scanned = corpus.read_corpus(
        spark, views.corpus_folder(spark, sf), record_schema=views.RECORD, file_glob=views.WRITTEN
    )
    return corpus.quarantined_lines(scanned).select(
        "language", "split", F.col(corpus.CORRUPT).alias("bad_line"), "path"
    )


@query(
    "source_tree_scan",
    f"WITH {S.CODE} SELECT path AS file, count(*) AS n_lines, sum(length(line) + 1)::BIGINT AS n_chars, "
    "md5(string_agg(line || chr(10), '' ORDER BY ln)) AS text_md5 FROM code_lines GROUP BY path",
)
def source_tree_scan(spark: SparkSession, sf: str) -> DataFrame:
    root = fresh_dir(spark, "tree")
    views.code_files(spark, sf).select(F.col("path").alias("file"), "text").repartition(
        "file"
    ).write.partitionBy("file").text(root)
    found = files.read_source_tree(spark, root, exts=[".txt"])
    return found.select(
        F.regexp_extract("path", r"/file=([^/]+)/", 1).alias("file"),
        text.line_count(F.col("text")).alias("n_lines"),
        text.char_length(F.col("text")).alias("n_chars"),
        F.md5("text").alias("text_md5"),
    )


@query(
    "source_files_scan",
    f"WITH {S.CODE} SELECT path AS file, count(*) AS n_lines, md5(string_agg(line || chr(10), '' ORDER BY ln)) AS text_md5 "
    "FROM code_lines GROUP BY path",
)
def source_files_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The files named in a list of two groups: brands whose number begins with 1, and all others."""
    root = fresh_dir(spark, "listed")
    views.code_files(spark, sf).select(F.col("path").alias("file"), "text").repartition("file").write.partitionBy(
        "file"
    ).text(root)
    named = f"{root}/file=brand_1*/*.txt, {root}/file=brand_[!1]*/*.txt"
    return files.read_source_files(spark, named, exts=[".txt"]).select(
        F.regexp_extract("path", r"/file=([^/]+)/", 1).alias("file"),
        text.line_count(F.col("text")).alias("n_lines"),
        F.md5("text").alias("text_md5"),
    )


EVAL_WIDE = (
    "SELECT repo || '-' || ((n - 1) // 5) AS project, "
    + ", ".join(
        f"max({c}) FILTER ((n - 1) % 5 + 1 = {i}) AS {k}_{i}" for k, c in (("query", "question"), ("doc", "reference")) for i in range(1, 6)
    )
    + " FROM eval_long GROUP BY ALL"
)


@query("eval_sheet", f"WITH {S.CONVERSATIONS} {EVAL_WIDE}")
def eval_sheet(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_dir(spark, "sheet")
    files.write_eval_sheet(views.eval_wide(spark, sf), path)
    sheet = files.read_eval_sheet(spark, path)
    cells = [F.col(f"{k} {i}").alias(f"{k.lower()}_{i}") for k in ("Query", "Doc") for i in range(1, 6)]
    return sheet.select(F.col("Project Name").alias("project"), *cells)


@query(
    "chunk_store_roundtrip",
    f"WITH {S.CORPUS},{S.windowed(source='corpus', key='seq')} "
    "SELECT repo, 'naive' AS mode, seq || ':' || win AS chunk_id, md5(w.text) AS text_md5 "
    "FROM windows w JOIN corpus USING (seq)",
)
def chunk_store_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_dir(spark, "chunks")
    chunks = views.naive_chunks(views.corpus(spark, sf)).select("chunk_id", "repo", "mode", "text")
    chunk_store.write_chunk_store(chunks, path)
    # A second write replaces the same stores instead of adding to them.
    chunk_store.write_chunk_store(chunks, path)
    return chunk_store.read_chunk_store(spark, path, mode="naive").select(
        "repo", "mode", "chunk_id", F.md5("text").alias("text_md5")
    )


def document_records(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents as collection records."""
    whole = views.corpus(spark, sf).withColumns(
        {"part": F.lit(0), "start_line": F.lit(1), "end_line": text.line_count(F.col("text"))}
    )
    return chunk_records(
        whole,
        "whole",
        summary=telling_sentences(F.col("text")),
        embedding=vectors.embed_text(F.col("text"), collection.VECTOR_DIM),
    )


RECORDS = (
    S.CORPUS
    + ","
    + S.summarized("summaries", "corpus", "seq")
    + """,
whole AS (
  SELECT *, '1-' || (length(text) - length(replace(text, chr(10), '')) +
         CASE WHEN text <> '' AND NOT ends_with(text, chr(10)) THEN 1 ELSE 0 END) AS lines FROM corpus),
records AS (
  SELECT substr(sha256(repo || '|' || path || '|0|whole|' || text), 1, 36) AS id,
         split_part(repo, '/', 2) AS repo_name, repo, language, path AS chunk_file, lines AS chunk_lines,
         text AS chunk_code, summary, seq
  FROM whole JOIN summaries USING (seq))"""
)


@query(
    "chunk_records",
    f"WITH {RECORDS} SELECT id, repo_name, repo, language, chunk_file, chunk_lines, chunk_code, summary FROM records",
)
def records(spark: SparkSession, sf: str) -> DataFrame:
    return document_records(spark, sf).drop("embedding")


_WIDTHS = ", ".join(f"('{f}', {w})" for f, w in collection.FIELD_WIDTHS.items())
_OBSERVED = " UNION ALL ".join(
    f"SELECT '{f}' AS field, {w}::BIGINT AS width, count({f}) AS n, max(strlen({f})) AS widest, "
    f"count(*) FILTER (strlen({f}) > {w}) AS n_too_wide FROM records"
    for f, w in collection.FIELD_WIDTHS.items()
)


@query("collection_schema", f"WITH {RECORDS} {_OBSERVED}")
def collection_schema(spark: SparkSession, sf: str) -> DataFrame:
    """Per declared field of a created collection: its width and what the records hold."""
    name = f"c_{uuid.uuid4().hex}"
    collection.create_collection(spark, name, fresh_dir(spark, name))
    collection.append(document_records(spark, sf), name)
    wide = []
    for field, width in collection.FIELD_WIDTHS.items():
        size = F.octet_length(field)
        wide += [
            F.struct(
                F.lit(field).alias("field"),
                F.lit(width).cast("bigint").alias("width"),
                F.count(field).alias("n"),
                F.max(size).cast("bigint").alias("widest"),
                F.count_if(size > width).alias("n_too_wide"),
            )
        ]
    return collection.read(spark, name).agg(F.array(*wide).alias("fields")).select(F.inline("fields"))


@query(
    "collection_validate",
    f"WITH {RECORDS} SELECT id, CASE "
    + " ".join(f"WHEN strlen({f}) > {w} THEN '{f} is too long'" for f, w in collection.FIELD_WIDTHS.items())
    + " ELSE 'ok' END AS verdict FROM records",
)
def collection_validate(spark: SparkSession, sf: str) -> DataFrame:
    good, rejected = collection.validate(document_records(spark, sf))
    return good.select("id", F.lit("ok").alias("verdict")).unionByName(
        rejected.select("id", F.col("reason").alias("verdict"))
    )


@query(
    "collection_append",
    f"WITH {RECORDS} SELECT id, repo_name, language, chunk_file, chunk_lines, md5(chunk_code) AS code_md5, "
    "md5(summary) AS summary_md5, 1024::BIGINT AS dim, (row_number() OVER (ORDER BY seq) - 1) // 10 AS batch_no FROM records",
)
def collection_append(spark: SparkSession, sf: str) -> DataFrame:
    """Append all records, then read them back beside their batch number."""
    name = f"c_{uuid.uuid4().hex}"
    collection.create_collection(spark, name, fresh_dir(spark, name))
    collection.append(document_records(spark, sf), name)
    order = F.regexp_extract("chunk_file", r"(\d+)", 1).cast("bigint")
    stored = collection.read(spark, name).withColumn("seq", order)
    return collection.with_batch_number(stored, "seq", batch_size=10).select(
        "id",
        "repo_name",
        "language",
        "chunk_file",
        "chunk_lines",
        F.md5("chunk_code").alias("code_md5"),
        F.md5("summary").alias("summary_md5"),
        F.size("embedding").cast("bigint").alias("dim"),
        "batch_no",
    )


@query(
    "collection_delete",
    "SELECT vec_id, label::BIGINT AS label FROM embeddings WHERE label NOT IN (0, 3) OR label IS NULL",
)
def collection_delete(spark: SparkSession, sf: str) -> DataFrame:
    name = f"c_{uuid.uuid4().hex}"
    vecs = views.table(spark, sf, "embeddings")
    collection.create_collection(spark, name, fresh_dir(spark, name), vecs.schema, cluster=("label",))
    collection.append(vecs, name)
    collection.delete_where(spark, name, F.col("label").isin(0, 3))
    return collection.read(spark, name).select("vec_id", F.col("label").cast("bigint").alias("label"))


@query("repo_url", f"WITH {S.CORPUS} SELECT seq, 'https://github.com/' || repo || '.git' AS url FROM corpus")
def repo_url(spark: SparkSession, sf: str) -> DataFrame:
    return views.corpus(spark, sf).select("seq", repos.clone_url(F.col("repo")).alias("url"))


@query(
    "repo_name",
    f"""WITH {S.CORPUS},{S.URLS}
    SELECT url, split_part(string_split(url, '/')[-1], '.', 1) AS repo_name, string_split(url, '/')[-1] AS base
    FROM urls""",
)
def repo_name(spark: SparkSession, sf: str) -> DataFrame:
    url = F.col("url")
    return views.repo_urls(spark, sf).select(
        "url", repos.repo_name(url).alias("repo_name"), repos.base_name(url).alias("base")
    )


@query(
    "raw_url",
    f"""WITH {S.CORPUS},{S.URLS}
    SELECT url, CASE WHEN contains(url, 'github.com') AND contains(url, '/blob/')
      THEN 'https://raw.githubusercontent.com' || regexp_extract(url, '^https://[^/]*(/.*?)/blob/', 1)
           || '/' || regexp_extract(url, '^.*?/blob/(.*)$', 1)
      ELSE url END AS raw_url FROM urls""",
)
def raw_url(spark: SparkSession, sf: str) -> DataFrame:
    return views.repo_urls(spark, sf).select("url", repos.raw_url(F.col("url")).alias("raw_url"))


_EXTS = ", ".join(f"('{lang}', '{e}')" for lang, exts in languages.LANGUAGE_EXTENSIONS.items() for e in exts)


@query(
    "language_extensions",
    f"""WITH {S.CORPUS}, exts(language, ext) AS (VALUES {_EXTS})
    SELECT seq, path, e.ext, e.language AS file_language, lower(c.language) = e.language AS agrees
    FROM corpus c JOIN exts e ON e.ext = regexp_extract(c.path, '(\\.[^./]+)$', 1)""",
)
def language_extensions(spark: SparkSession, sf: str) -> DataFrame:
    known = languages.require_known_language(views.corpus(spark, sf).select("seq", "path", "language"))
    owned = languages.files_of_language(known.withColumnRenamed("language", "said"))
    return owned.select(
        "seq", "path", "ext", F.col("language").alias("file_language"),
        (F.col("said") == F.col("language")).alias("agrees"),
    )


@query(
    "text_lengths",
    r"SELECT doc_id, length(text) AS chars, length(regexp_replace(text, '\s', '', 'g')) AS non_blank FROM documents",
)
def text_lengths(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return views.documents(spark, sf).select(
        "doc_id", text.char_length(t).alias("chars"), text.non_blank_length(t).alias("non_blank")
    )


_PIPELINE_COUNTS = (
    f"WITH {S.CORPUS},{S.windowed(source='corpus', key='seq')} "
    "SELECT 'naive' AS mode, count(*) AS n_chunks, count(DISTINCT seq) AS n_files, count(DISTINCT repo) AS n_repos "
    "FROM windows JOIN corpus USING (seq)"
)


@query("progress_counts", _PIPELINE_COUNTS)
@query("pipeline_counts", _PIPELINE_COUNTS)
def pipeline_counts(spark: SparkSession, sf: str) -> DataFrame:
    return reports.progress_counts(views.naive_chunks(views.corpus(spark, sf)))


def _firsts_sql(limit: int | None) -> str:
    cap = "" if limit is None else f" ORDER BY seq LIMIT {limit}"
    return (
        f"WITH {S.CORPUS}, firsts AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY seq) AS i FROM corpus) "
        f"SELECT seq, repo, language, path FROM firsts WHERE i = 1{cap}"
    )


@query("first_per_repo", _firsts_sql(None))
def first_per_repo(spark: SparkSession, sf: str) -> DataFrame:
    records_ = views.corpus(spark, sf).select("seq", "repo", "language", "path")
    return firsts.first_per_key(records_)


_SCAN_ORDER = "CASE language " + " ".join(
    f"WHEN '{x}' THEN {i}" for i, x in enumerate(corpus.CORPUS_LANGUAGES)
) + " END, CASE split " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(corpus.CORPUS_SPLITS)) + " END, seq"


@query(
    "first_scanned",
    f"WITH {S.CORPUS}, firsts AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY {_SCAN_ORDER}) AS i FROM corpus) "
    "SELECT seq, repo, language, split, path FROM firsts WHERE i = 1",
)
def first_scanned(spark: SparkSession, sf: str) -> DataFrame:
    """The first record of each repository in the order in which the files are scanned."""
    scanned = corpus.scan_corpus(spark, views.corpus_folder(spark, sf), record_schema=views.RECORD, file_glob=views.WRITTEN)
    placed = corpus.good_records(scanned).select("at", "seq", "repo", "language", "split", "path")
    # Positions hold for any reading, so the files are simply read again for the records themselves.
    return firsts.first_per_key(placed, order="at").drop("at")


@query("first_n_repos", _firsts_sql(20))
def first_n_repos(spark: SparkSession, sf: str) -> DataFrame:
    records_ = views.corpus(spark, sf).select("seq", "repo", "language", "path")
    return firsts.first_n_keys(records_, 20)


@query("batch_rounded_limit", _firsts_sql(50))
def batch_rounded_limit(spark: SparkSession, sf: str) -> DataFrame:
    records_ = views.corpus(spark, sf).select("seq", "repo", "language", "path")
    return firsts.batch_rounded_limit(records_, 20, 50)


@query(
    "corpus_counts",
    f"WITH {S.CORPUS}, lines AS (SELECT language, split FROM corpus UNION ALL SELECT language, split FROM corpus WHERE seq % 50 = 0) "
    "SELECT language, split, count(*) AS n, GROUPING(language, split)::BIGINT AS level "
    "FROM lines GROUP BY ROLLUP (language, split)",
)
def corpus_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of the scanned files, malformed ones too."""
    lines = spark.read.text(corpus.corpus_glob(views.corpus_folder(spark, sf), file_glob=views.WRITTEN))
    path = F.col("_metadata.file_path")
    placed = lines.select(corpus.path_language(path).alias("language"), corpus.path_split(path).alias("split"))
    return reports.corpus_counts(placed)
