"""Queries over embeddings, search, contexts, summaries and prompts."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import prompts, vectors
from codeloom.operators import clusters, context, enrich, lookup
from codeloom.operators.search import top_k
from codeloom.plans import sql as S
from codeloom.plans import flows, views
from codeloom.plans.chunks import LINKS, SCOPE_CHUNKS, scope_chunks_sql, scope_links, small_scope_chunks
from codeloom.plans.registry import query
from codeloom.sources import chunk_store, collection
from codeloom.workspace import materialize

_SCORES = {
    "cosine": ("list_cosine_similarity(e.embedding::DOUBLE[], q.qv)", "DESC"),
    "l2": ("list_distance(e.embedding::DOUBLE[], q.qv)", "ASC"),
    "ip": ("list_inner_product(e.embedding::DOUBLE[], q.qv)", "DESC"),
}


def _topk_sql(metric: str, on: str = "true") -> str:
    score, order = _SCORES[metric]
    return f"""WITH {S.LABEL_QUERIES}
    SELECT q_id, rank, vec_id, round(score, 6) AS score, label::BIGINT AS label FROM (
      SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score {order}, vec_id) AS rank
      FROM (SELECT q.q_id, e.vec_id, e.label, round({score}, 9) AS score FROM queries q JOIN embeddings e ON {on}))
    WHERE rank <= 5"""


def _topk(spark: SparkSession, sf: str, metric: str, match_on: str | None = None) -> DataFrame:
    hits = top_k(
        views.table(spark, sf, "embeddings"),
        views.label_queries(spark, sf),
        metric=metric,
        id_col="vec_id",
        match_on=match_on,
        output_fields=["label"],
    )
    return hits.select(
        "q_id", "rank", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"),
        F.col("label").cast("bigint").alias("label"),
    )


@query("topk_cosine", _topk_sql("cosine"))
def topk_cosine(spark: SparkSession, sf: str) -> DataFrame:
    return _topk(spark, sf, "cosine")


@query("topk_l2", _topk_sql("l2"))
def topk_l2(spark: SparkSession, sf: str) -> DataFrame:
    return _topk(spark, sf, "l2")


@query("topk_ip", _topk_sql("ip"))
def topk_ip(spark: SparkSession, sf: str) -> DataFrame:
    return _topk(spark, sf, "ip")


@query("topk_filtered", _topk_sql("cosine", "q.label = e.label"))
def topk_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """Each label's mean searched among the vectors of that label alone."""
    return _topk(spark, sf, "cosine", match_on="label")


NPROBE = 3

_IVF = f"""{S.LABEL_QUERIES},
centroids AS (SELECT q_id AS cid, qv AS centroid FROM queries),
assigned AS (
  SELECT vec_id, embedding, cid FROM (
    SELECT e.vec_id, e.embedding, c.cid, row_number() OVER (PARTITION BY e.vec_id
      ORDER BY round(list_cosine_similarity(c.centroid, e.embedding::DOUBLE[]), 9) DESC, c.cid) AS i
    FROM embeddings e CROSS JOIN centroids c) WHERE i = 1),
asked AS (SELECT vec_id AS q_id, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 20 = 0),
probes AS (
  SELECT q_id, qv, cid FROM (
    SELECT a.q_id, a.qv, c.cid, row_number() OVER (PARTITION BY a.q_id
      ORDER BY round(list_cosine_similarity(c.centroid, a.qv), 9) DESC, c.cid) AS i
    FROM asked a CROSS JOIN centroids c) WHERE i <= {NPROBE}),
probed AS (
  SELECT q_id, rank, id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, id) AS rank
    FROM (SELECT p.q_id, v.vec_id AS id, round(list_cosine_similarity(v.embedding::DOUBLE[], p.qv), 9) AS score
          FROM probes p JOIN assigned v USING (cid))) WHERE rank <= 5),
exact AS (
  SELECT q_id, rank, id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, id) AS rank
    FROM (SELECT a.q_id, e.vec_id AS id, round(list_cosine_similarity(e.embedding::DOUBLE[], a.qv), 9) AS score
          FROM asked a CROSS JOIN embeddings e)) WHERE rank <= 5)"""


def _index(spark: SparkSession, sf: str) -> clusters.ClusteredIndex:
    """Embeddings clustered around the means of their labels."""
    means = views.label_queries(spark, sf).select(F.col("q_id").alias("cid"), F.col("qv").alias("centroid"))
    return clusters.build_index(views.table(spark, sf, "embeddings"), id_col="vec_id", centroids=means)


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    """Every twentieth vector, searched among all."""
    vecs = views.table(spark, sf, "embeddings").where("vec_id % 20 = 0")
    return vecs.select(F.col("vec_id").alias("q_id"), F.col("embedding").cast("array<double>").alias("qv"))


def _probed(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.probed_top_k(_index(spark, sf), _asked(spark, sf), nprobe=NPROBE, id_col="vec_id")


@query("ivf_build", f"WITH {_IVF} SELECT cid, count(*) AS n_vectors, sum(vec_id)::BIGINT AS ids FROM assigned GROUP BY cid")
def ivf_build(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors by cluster, as written."""
    written = _index(spark, sf).collection
    return written.groupBy(F.col("cid").cast("bigint").alias("cid")).agg(
        F.count("*").alias("n_vectors"), F.sum("vec_id").alias("ids")
    )


def _hits(found: DataFrame) -> DataFrame:
    return found.select("q_id", "rank", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


@query("ivf_search", f"WITH {_IVF} SELECT q_id, rank, id AS vec_id, round(score, 6) AS score FROM exact")
def ivf_search(spark: SparkSession, sf: str) -> DataFrame:
    """Through the index, with its guarantee: the rows of the exact search."""
    return _hits(clusters.search_index(_index(spark, sf), _asked(spark, sf), nprobe=NPROBE, id_col="vec_id"))


@query("ivf_probed", f"WITH {_IVF} SELECT q_id, rank, id AS vec_id, round(score, 6) AS score FROM probed")
def ivf_probed(spark: SparkSession, sf: str) -> DataFrame:
    """The three nearest clusters alone."""
    return _hits(_probed(spark, sf))


KMEANS_LISTS, KMEANS_STEPS = 16, 6


def _kmeans_sql() -> str:
    """``steps`` of k-means, each unrolled: nearest centroids, then means of unit vectors."""
    parts = [f"""
unit AS MATERIALIZED (
  SELECT vec_id, embedding::DOUBLE[] AS e, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS u
  FROM embeddings WHERE embedding IS NOT NULL),
centroids_0 AS (
  SELECT row_number() OVER (ORDER BY md5(vec_id::VARCHAR), vec_id) - 1 AS cid, e AS centroid FROM unit
  ORDER BY md5(vec_id::VARCHAR), vec_id LIMIT {KMEANS_LISTS})"""]
    for i in range(KMEANS_STEPS + 1):
        parts.append(f"""
assigned_{i} AS MATERIALIZED (
  SELECT vec_id, e, u, cid FROM (
    SELECT v.*, c.cid, row_number() OVER (PARTITION BY v.vec_id ORDER BY round(list_cosine_similarity(c.centroid, v.e), 9) DESC, c.cid) AS i
    FROM unit v CROSS JOIN centroids_{i} c) WHERE i = 1)""")
        if i < KMEANS_STEPS:
            parts.append(f"""
centroids_{i + 1} AS MATERIALIZED (
  SELECT c.cid, coalesce(m.centroid, c.centroid) AS centroid
  FROM centroids_{i} c LEFT JOIN (
    SELECT cid, list(v ORDER BY pos) AS centroid FROM (
      SELECT cid, pos, sum(v) AS v FROM (SELECT cid, unnest(u) AS v, unnest(range(len(u))) AS pos FROM assigned_{i}) GROUP BY cid, pos)
    GROUP BY cid) m USING (cid))""")
    return ",".join(parts)


def _kmeans_index(spark: SparkSession, sf: str) -> clusters.ClusteredIndex:
    table = views.table(spark, sf, "embeddings")
    return clusters.build_index(table, KMEANS_LISTS, id_col="vec_id", max_iter=KMEANS_STEPS)


@query(
    "kmeans_build",
    f"WITH {_kmeans_sql()} SELECT cid::BIGINT AS cid, count(*) AS n_vectors, sum(vec_id)::BIGINT AS ids, "
    f"round(max(acos(least(list_cosine_similarity(c.centroid, e), 1.0))), 6) AS radius "
    f"FROM assigned_{KMEANS_STEPS} a JOIN centroids_{KMEANS_STEPS} c USING (cid) GROUP BY cid",
)
def kmeans_build(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters found by k-means from hashed seeds, as written, with their radii."""
    index = _kmeans_index(spark, sf)
    written = index.collection.groupBy("cid").agg(F.count("*").alias("n_vectors"), F.sum("vec_id").alias("ids"))
    return written.join(index.centroids, "cid").select(
        F.col("cid").cast("bigint").alias("cid"), "n_vectors", "ids", F.round("radius", 6).alias("radius")
    )


@query("kmeans_search", f"WITH {_IVF} SELECT q_id, rank, id AS vec_id, round(score, 6) AS score FROM exact")
def kmeans_search(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of the exact search, through the clusters of k-means."""
    return _hits(clusters.search_index(_kmeans_index(spark, sf), _asked(spark, sf), nprobe=NPROBE, id_col="vec_id"))


@query(
    "ivf_recall",
    f"WITH {_IVF} SELECT e.q_id, round(count(p.id) / count(*)::DOUBLE, 6) AS recall "
    "FROM exact e LEFT JOIN probed p ON p.q_id = e.q_id AND p.id = e.id GROUP BY e.q_id",
)
def ivf_recall(spark: SparkSession, sf: str) -> DataFrame:
    exact = top_k(views.table(spark, sf, "embeddings"), _asked(spark, sf), id_col="vec_id")
    return clusters.recall(_probed(spark, sf), exact).select("q_id", F.round("recall", 6).alias("recall"))


@query(
    "embed_text",
    f"WITH {S.hashed('hashed', 'documents', 'doc_id', 'text')} SELECT doc_id, bucket, round(w, 6) AS weight FROM hashed",
)
def embed_text(spark: SparkSession, sf: str) -> DataFrame:
    embedded = views.documents(spark, sf).select("doc_id", vectors.embed_text(F.col("text")).alias("v"))
    entries = F.transform(
        "v",
        lambda w, i: F.struct(
            i.cast("bigint").alias("bucket"), F.round(w.cast("double"), 6).alias("weight")
        ),
    )
    return embedded.select("doc_id", F.inline(F.filter(entries, lambda e: e["weight"] > 0)))


@query(
    "l2_normalize",
    """SELECT label::BIGINT AS label, pos, round(v / norm, 6) AS v FROM (
      SELECT label, pos, v, sqrt(sum(v * v) OVER (PARTITION BY label)) AS norm
      FROM (SELECT label, pos, sum(v) AS v FROM (
        SELECT label, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS pos FROM embeddings)
        GROUP BY label, pos))""",
)
def l2_normalize(spark: SparkSession, sf: str) -> DataFrame:
    """Unit vectors of the per-label sums, which are far from unit length."""
    means = views.label_queries(spark, sf)
    counts = views.table(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    sums = means.join(counts, "label").select(
        F.col("label").cast("bigint").alias("label"), F.transform("qv", lambda x: x * F.col("n")).alias("v")
    )
    unit = sums.select("label", F.posexplode(vectors.l2_normalize(F.col("v"))).alias("pos", "v"))
    return unit.select("label", F.col("pos").cast("bigint").alias("pos"), F.round("v", 6).alias("v"))


@query(
    "summarize_chunks",
    f"WITH {S.windowed()}, w AS (SELECT doc_id || ':' || win AS chunk_id, text FROM windows),"
    f"{S.summarized('summaries', 'w', 'chunk_id')} SELECT chunk_id, summary FROM summaries",
)
def summarize_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.summarize(views.naive_chunks(views.corpus(spark, sf))).select("chunk_id", "summary")


def _checked_digest(frame: pd.DataFrame) -> pd.Series:
    """A caller's function that fails on some rows: texts with an ``@``."""
    if frame["text"].str.contains("@").any():
        raise ValueError("unexpected @")
    return frame["text"].str.len()


@query(
    "enrich_errors",
    "SELECT doc_id, CASE WHEN contains(text, '@') THEN NULL ELSE length(text) END AS value, "
    "CASE WHEN contains(text, '@') THEN 'ValueError: unexpected @' END AS error FROM documents",
)
def enrich_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that worked and rows that failed, through a function that fails on some."""
    done = enrich.batch_map(views.documents(spark, sf), _checked_digest, ["text"], "value", "bigint")
    good, failed = enrich.split_errors(done)
    return good.withColumn("error", F.lit(None).cast("string")).unionByName(failed).select("doc_id", "value", "error")


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return views.table(spark, sf, "benchmark").select(
        F.col("item_id").alias("q_id"), F.col("text").alias("question")
    )


def embedded_questions(spark: SparkSession, sf: str) -> DataFrame:
    return flows.embed_questions(questions(spark, sf))


def window_hits(spark: SparkSession, sf: str, k: int = 5) -> DataFrame:
    """Best token windows for every question."""
    return mode_hits(views.corpus(spark, sf), embedded_questions(spark, sf), "naive", k)


def mode_hits(files: DataFrame, asked: DataFrame, mode: str, k: int = 5) -> DataFrame:
    """(q_id, mode, rank, chunk_id, score, summary, chunk_code) of the best chunks for
    embedded questions (q_id, qv).

    Chunks are cut once and stored in order of their ids. Only ids and vectors take part in
    the search; the texts of the hits are fetched from the files that hold them.
    """
    spark = files.sparkSession
    summary = F.col("text") if mode == "naive" else enrich.telling_sentences(F.col("text"))
    store = chunk_store.write_sorted(views.chunk_texts(files, mode), "chunk_id")
    embedded = chunk_store.read_sorted(spark, store).select("chunk_id", vectors.embed_text(summary).alias("embedding"))
    # The hits, k to a query, serve twice: to fetch their texts, and to rank them.
    found = top_k(embedded, asked.select("q_id", "qv"), k=k, id_col="chunk_id").withColumnRenamed("id", "chunk_id")
    hits = materialize(found, "hits")
    texts = chunk_store.fetch(spark, store, hits, "chunk_id").select("chunk_id", "text")
    return hits.join(texts, "chunk_id").select(
        "q_id", F.lit(mode).alias("mode"), "rank", "chunk_id", "score",
        summary.alias("summary"), F.col("text").alias("chunk_code"),
    )


QUESTIONS = "questions AS (SELECT item_id AS q_id, text AS question FROM benchmark)"
NAIVE = (
    S.windowed()
    + ", naive_chunks AS (SELECT doc_id || ':' || win AS chunk_id, text FROM windows),"
    + S.hashed("naive_vectors", "naive_chunks", "chunk_id", "text")
)
QVECTORS = S.hashed("question_vectors", "questions", "q_id", "question")
NAIVE_HITS = (
    f"{QUESTIONS},{NAIVE},{QVECTORS},"
    + S.nearest("naive_top", "question_vectors", "naive_vectors", "q_id", "chunk_id", "naive_chunks")
    + """,
naive_hits AS (
  SELECT q_id, 'naive' AS mode, rank, chunk_id, score, text AS summary, text AS chunk_code
  FROM naive_top JOIN naive_chunks USING (chunk_id))"""
)
SMART_HITS = (
    S.structural()
    + ", smart_chunks AS (SELECT doc_id || ':' || s AS chunk_id, text FROM chunks),"
    + S.summarized("smart_summaries", "smart_chunks", "chunk_id")
    + ","
    + S.hashed("smart_vectors", "smart_summaries", "chunk_id", "summary")
    + ","
    + S.nearest("smart_top", "question_vectors", "smart_vectors", "q_id", "chunk_id", "smart_chunks")
    + """,
smart_hits AS (
  SELECT q_id, 'smart' AS mode, rank, chunk_id, score, summary, text AS chunk_code
  FROM smart_top JOIN smart_chunks USING (chunk_id) JOIN smart_summaries USING (chunk_id))"""
)
CONTEXTS = f"""{NAIVE_HITS},{SMART_HITS},
contexts AS (
  SELECT q_id, string_agg(summary, chr(10) ORDER BY rank) AS naive FROM naive_hits GROUP BY q_id),
smart_contexts AS (
  SELECT q_id, string_agg(summary || chr(10) || chr(10) || chunk_code, chr(10) ORDER BY rank) AS smart
  FROM smart_hits GROUP BY q_id),
both_contexts AS (SELECT q_id, question, smart, naive FROM questions JOIN contexts USING (q_id)
                  JOIN smart_contexts USING (q_id))"""


@query(
    "assemble_context",
    f"WITH {NAIVE_HITS} SELECT q_id, count(*) AS n_hits, string_agg(summary, chr(10) ORDER BY rank) AS context, "
    "string_agg(chunk_id || '=' || printf('%.6f', score), ' ' ORDER BY rank) AS hits FROM naive_hits GROUP BY q_id",
)
def assemble_context(spark: SparkSession, sf: str) -> DataFrame:
    """The five best windows for every question, with their joined text."""
    hit = F.concat_ws("=", "chunk_id", F.format_string("%.6f", "score"))
    listed = context.in_rank_order(hit, " ").alias("hits")
    return context.assemble_context(window_hits(spark, sf), ["q_id"], "\n", listed)


def both_contexts(spark: SparkSession, sf: str) -> DataFrame:
    """(q_id, question, smart, naive): contexts of both modes side by side."""
    asked = embedded_questions(spark, sf)
    files = views.corpus(spark, sf)
    hits = mode_hits(files, asked, "smart").unionByName(mode_hits(files, asked, "naive"))
    wide = context.side_by_side(context.assemble_context(hits, ["q_id", "mode"]))
    return asked.select("q_id", "question").join(wide, "q_id")


@query("compare_retrieval", f"WITH RECURSIVE {CONTEXTS} SELECT q_id, smart, naive FROM both_contexts")
def compare_retrieval(spark: SparkSession, sf: str) -> DataFrame:
    return both_contexts(spark, sf).select("q_id", "smart", "naive")


def _words_sql(column: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({column}), '({S.WORD})', 1))"


def _overlap_sql(side: str) -> str:
    return f"len(list_intersect({_words_sql('question')}, {_words_sql(side)}))"


@query(
    "choose_context",
    f"WITH RECURSIVE {CONTEXTS} SELECT q_id, smart_overlap, naive_overlap, "
    "CASE WHEN smart_overlap >= naive_overlap THEN 'smart' ELSE 'naive' END AS choice "
    f"FROM (SELECT q_id, {_overlap_sql('smart')} AS smart_overlap, {_overlap_sql('naive')} AS naive_overlap FROM both_contexts)",
)
def choose_context(spark: SparkSession, sf: str) -> DataFrame:
    return context.choose_context(both_contexts(spark, sf)).select(
        "q_id", "smart_overlap", "naive_overlap", context.clean_choice(F.col("choice")).alias("choice")
    )


@query(
    "answer_queries",
    f"WITH {NAIVE_HITS} SELECT q_id, question, summary AS answer FROM questions LEFT JOIN naive_hits h USING (q_id) "
    "WHERE h.rank = 1 OR h.rank IS NULL",
)
def answer_queries(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.answer(questions(spark, sf), window_hits(spark, sf, k=1))


@query(
    "index_and_ask",
    f"""WITH {S.CORPUS},{S.windowed(source='corpus', key='seq')},
    stored AS (
      SELECT substr(sha256(repo || '|' || path || '|' || win || '|naive|' || w.text), 1, 36) AS id, path AS chunk_file, w.text
      FROM windows w JOIN corpus USING (seq)),
    {QUESTIONS},{S.hashed('stored_vectors', 'stored', 'id', 'text')},{QVECTORS},
    {S.nearest('stored_top', 'question_vectors', 'stored_vectors', 'q_id', 'id', 'stored')}
    SELECT q_id, question, string_agg(text, chr(10) ORDER BY rank) AS context,
           max(text) FILTER (rank = 1) AS answer
    FROM stored_top JOIN stored USING (id) JOIN questions USING (q_id) GROUP BY q_id, question""",
)
def index_and_ask(spark: SparkSession, sf: str) -> DataFrame:
    """All windows of the corpus stored in a collection, and all questions asked of it."""
    name = f"c_{uuid.uuid4().hex}"
    flows.index_files(views.corpus(spark, sf), "naive", name)
    answers = flows.ask(spark, questions(spark, sf), name, "naive")
    collection.drop_collection(spark, name, files=True)  # the hits have been written
    return answers.drop("error")


# Code files under the file names' own ids, chunked at the default sizes, as two collections.
_STORED = f"""{scope_chunks_sql(5000, 50)},
code_texts AS (SELECT repo, path, string_agg(line, chr(10) ORDER BY ln) AS text FROM code_lines GROUP BY repo, path),
{S.windowed(source='code_texts', key='path')},
smart_stored AS (
  SELECT substr(sha256(repo || '|' || path || '|' || scope || ':' || part || '|smart|' || c.text), 1, 36) AS id, repo, c.text
  FROM scope_chunks c JOIN code_texts t USING (path)),
naive_stored AS (
  SELECT substr(sha256(repo || '|' || path || '|' || win || '|naive|' || w.text), 1, 36) AS id, repo, w.text
  FROM windows w JOIN code_texts USING (path)),
{S.summarized('smart_summaries', 'smart_stored', 'id')},
{S.hashed('smart_vectors', 'smart_summaries', 'id', 'summary')},
{S.hashed('naive_vectors', 'naive_stored', 'id', 'text')},
questions AS (SELECT DISTINCT p_type AS q_id, 'price of one ' || p_type AS question FROM part),{QVECTORS}"""
_STORED_TOPS = (
    S.nearest("smart_top", "question_vectors", "smart_vectors", "q_id", "id", "smart_stored")
    + ","
    + S.nearest("naive_top", "question_vectors", "naive_vectors", "q_id", "id", "naive_stored")
    + """,
smart_contexts AS (
  SELECT q_id, string_agg(summary || chr(10) || chr(10) || text, chr(10) ORDER BY rank) AS smart
  FROM smart_top JOIN smart_stored USING (id) JOIN smart_summaries USING (id) GROUP BY q_id),
naive_contexts AS (
  SELECT q_id, string_agg(text, chr(10) ORDER BY rank) AS naive FROM naive_top JOIN naive_stored USING (id) GROUP BY q_id),
both_contexts AS (SELECT * FROM questions JOIN smart_contexts USING (q_id) JOIN naive_contexts USING (q_id))"""
)


def _type_questions(spark: SparkSession, sf: str) -> DataFrame:
    types = views.table(spark, sf, "part").select(F.col("p_type").alias("q_id")).distinct()
    return types.withColumn("question", F.concat(F.lit("price of one "), "q_id"))


def _stored_code(spark: SparkSession, sf: str, mode: str) -> str:
    """The name of a new collection of the code files."""
    name = f"c_{uuid.uuid4().hex}"
    files = views.code_files(spark, sf).withColumn("language", F.lit("python"))
    flows.index_files(files, mode, name)
    return name


@query(
    "index_and_compare",
    f"WITH RECURSIVE {_STORED},{_STORED_TOPS} SELECT q_id, md5(smart) AS smart_md5, md5(naive) AS naive_md5, "
    f"CASE WHEN {_overlap_sql('smart')} >= {_overlap_sql('naive')} THEN 'smart' ELSE 'naive' END AS choice FROM both_contexts",
)
def index_and_compare(spark: SparkSession, sf: str) -> DataFrame:
    """Code files stored by scopes and by windows, and both asked the same questions."""
    names = [_stored_code(spark, sf, mode) for mode in ("smart", "naive")]
    compared = flows.compare(spark, _type_questions(spark, sf), *names)
    for name in names:
        collection.drop_collection(spark, name, files=True)  # the hits have been written
    return compared.select("q_id", F.md5("smart").alias("smart_md5"), F.md5("naive").alias("naive_md5"), "choice")


@query(
    "ask_one_repo",
    "WITH RECURSIVE "
    + _STORED
    + ", one_repo AS (SELECT * FROM smart_stored WHERE split_part(repo, '/', 2) = 'brand_13'), "
    + "one_vectors AS (SELECT * FROM smart_vectors WHERE id IN (SELECT id FROM one_repo)),"
    + S.nearest("one_top", "question_vectors", "one_vectors", "q_id", "id", "one_repo")
    + " SELECT q_id, md5(string_agg(summary || chr(10) || chr(10) || text, chr(10) ORDER BY rank)) AS context_md5, "
    "max(summary) FILTER (rank = 1) AS answer FROM one_top JOIN one_repo USING (id) JOIN smart_summaries USING (id) GROUP BY q_id",
)
def ask_one_repo(spark: SparkSession, sf: str) -> DataFrame:
    """The stored scopes of one repository alone, named by a literal filter."""
    name = _stored_code(spark, sf, "smart")
    found = flows.ask(spark, _type_questions(spark, sf), name, "smart", repo_name="brand_13")
    collection.drop_collection(spark, name, files=True)  # the hits have been written
    return found.select("q_id", F.md5("context").alias("context_md5"), "answer")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _filled(template: str, *columns: str) -> str:
    """SQL concatenation of a template whose places are ``%s``."""
    parts = template.split("%s")
    out = [_quoted(parts[0])]
    for column, part in zip(columns, parts[1:]):
        out += [column, _quoted(part)]
    return " || ".join(out)


@query(
    "build_prompts",
    f"WITH {S.CONVERSATIONS} SELECT repo, n, "
    + f"{_quoted(prompts.SUMMARY_PROMPT)} || reference AS summary_prompt, "
    + _quoted(prompts.ANSWER_PROMPT) + " || 'Query: ' || question || chr(10) || chr(10) || 'Context: ' || reference AS answer_prompt, "
    + _quoted(prompts.CHOICE_PROMPT) + " || 'Query: ' || question || chr(10) || chr(10) || 'Smart Context: ' || smart_response"
    " || chr(10) || chr(10) || 'Naive Context: ' || naive_response AS choice_prompt, "
    + _filled(prompts.SHORT_ANSWER_HEAD, "question", f"concat_ws({_quoted(prompts.CONTEXT_SEPARATOR)}, smart_response, reference)")
    + f" || {_quoted(prompts.SHORT_ANSWER_TAIL)} AS short_answer_prompt, "
    + _filled(prompts.QUESTION_PROMPT, "question") + " AS question_prompt, "
    + _filled(prompts.PREFERENCE_PROMPT, "question", "smart_response", "naive_response")
    + " AS preference_prompt FROM eval_long",
)
def build_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """All prompt texts; a prompt that lacks a part is null."""
    q, ref = F.col("question"), F.col("reference")
    smart, naive = F.col("smart_response"), F.col("naive_response")
    return views.eval_long(spark, sf).select(
        "repo",
        "n",
        prompts.summary_prompt(ref).alias("summary_prompt"),
        prompts.answer_prompt(q, ref).alias("answer_prompt"),
        prompts.choice_prompt(q, smart, naive).alias("choice_prompt"),
        prompts.short_answer_prompt(q, F.array(smart, ref)).alias("short_answer_prompt"),
        prompts.question_prompt(q).alias("question_prompt"),
        prompts.preference_prompt(q, smart, naive).alias("preference_prompt"),
    )


@query(
    "scope_lookup",
    f"""WITH RECURSIVE {SCOPE_CHUNKS},{LINKS},
    asked AS (SELECT DISTINCT p_name AS q_id FROM part),
    asked_terms AS (SELECT DISTINCT q_id, unnest(regexp_extract_all(lower(q_id), '({S.WORD})', 1)) AS term FROM asked),
    name_terms AS (
      SELECT DISTINCT chunk_id, unnest(string_split(lower(name), '_')) AS term
      FROM scope_chunks WHERE part = 0 AND name IS NOT NULL),
    hits AS (
      SELECT q_id, rank, chunk_id, score FROM (
        SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, chunk_id) AS rank
        FROM (SELECT q_id, chunk_id, count(*) AS score FROM asked_terms JOIN name_terms USING (term) GROUP BY ALL))
      WHERE rank <= 5)
    SELECT q_id, rank, chunk_id, score, 'self' AS relation, chunk_id AS related FROM hits
    UNION ALL
    SELECT q_id, rank, chunk_id, score, relation, target FROM hits JOIN links USING (chunk_id)
    WHERE relation IN ('parent', 'child')""",
)
def scope_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Part names asked for, among the scopes of the code files."""
    asked = views.table(spark, sf, "part").select(F.col("p_name").alias("q_id")).distinct()
    chunks = materialize(small_scope_chunks(spark, sf), "scope-chunks")
    return lookup.scope_lookup(asked.withColumn("question", F.col("q_id")), chunks, scope_links(chunks))
