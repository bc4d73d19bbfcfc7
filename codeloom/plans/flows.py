"""From files to a stored collection, and from questions to answers.

The steps a user runs: ``index_files`` once per mode, then ``ask`` and ``compare`` for
a table of questions at a time, and ``evaluate_answers`` where references are known.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.vectors import embed_text
from codeloom.operators import context, enrich, evaluate
from codeloom.operators.nodes import prose_nodes
from codeloom.operators.packing import MAX_CHARS, structural_chunks
from codeloom.operators.scopes import scope_chunks
from codeloom.operators.search import TOP_K, top_k
from codeloom.operators.windows import token_windows
from codeloom.sources import collection
from codeloom.streaming import ingest
from codeloom.workspace import fresh_dir, materialize, remove

BatchFunction = Callable[[pd.DataFrame], pd.Series]
HIT_FIELDS = ["summary", "chunk_code", "chunk_file"]


FILE_COLUMNS = ["repo", "path", "language"]


def with_file_id(files: DataFrame) -> DataFrame:
    """Different files (repo, path, language, text), each with an id of its own. JSON spells
    nulls out, so files without a path are told apart by their text.
    """
    content = F.to_json(F.struct(*FILE_COLUMNS, "text"))
    return files.select(*FILE_COLUMNS, "text", F.sha2(content, 256).alias("file_id")).dropDuplicates(["file_id"])


def chunk_files(files: DataFrame, mode: str) -> DataFrame:
    """Chunks of files (repo, path, language, text): ``smart`` by scopes, ``structural``
    by packed nodes, ``naive`` by token windows. Equal rows are one file.
    """
    keyed = with_file_id(files)
    if mode == "structural":
        # Nodes, texts and the files' columns each take them: told apart and written once, files are not read again for it.
        keyed = materialize(keyed, "files")
    no_line = F.lit(None).cast("bigint")
    if mode == "naive":
        cut = token_windows(keyed, id_col="file_id", keep=FILE_COLUMNS)
        cut = cut.withColumns({"part": F.col("win").cast("string"), "start_line": no_line, "end_line": no_line})
    elif mode == "smart":
        cut = scope_chunks(keyed, id_col="file_id", language_col="language").withColumn("part", F.concat_ws(":", "scope", "part"))
    elif mode == "structural":
        tree = prose_nodes(keyed, "file_id", sentences_over=MAX_CHARS)
        cut = structural_chunks(tree, keyed, id_col="file_id").withColumn("part", F.col("start").cast("string"))
    else:
        raise ValueError(f"Unknown mode: {mode}")
    if mode != "naive":
        cut = cut.select("file_id", "part", "start_line", "end_line", "text")
        cut = cut.join(keyed.select("file_id", *FILE_COLUMNS), "file_id")
    # Ids of chunks are made of path and part: without a path, the part names the file.
    return cut.withColumn("part", F.when(F.col("path").isNull(), F.concat_ws(":", "file_id", "part")).otherwise(F.col("part")))


def _embedded(rows: DataFrame, text_col: str, fn: BatchFunction | None, value_col: str, error_col: str) -> DataFrame:
    if fn is None:
        return rows.withColumns(
            {value_col: embed_text(F.col(text_col), collection.VECTOR_DIM), error_col: F.lit(None).cast("string")}
        )
    return enrich.batch_map(rows, fn, [text_col], value_col, "array<float>", error_col)


def index_files(
    files: DataFrame,
    mode: str,
    name: str,
    path: str | None = None,
    summarize_fn: BatchFunction | None = None,
    embed_fn: BatchFunction | None = None,
    skip_known: bool = True,
    reject_wide: bool = False,
    batch: str | None = None,
) -> DataFrame:
    """Chunk, summarise, embed and append to collection ``name``, made if missing.

    A naive chunk is its own summary. Chunks that the collection has already are left out
    (unless ``skip_known`` is off) before anything costly is done to them, so an index can
    be taken up again or brought up to date. Returns the chunks with a ``reason``, and
    whether they are ``stored``: a failed summary or embedding keeps a chunk out; a field
    beyond its declared width is reported, and keeps it out only with ``reject_wide``. A
    ``batch`` is stored once, whatever it is called with.
    """
    spark = files.sparkSession
    collection.create_collection(spark, name, path or fresh_dir(spark, name))
    chunks = chunk_files(files, mode)
    cut = fresh_dir(spark, "chunks")
    if skip_known:
        # Written once: ids are compared first, and files are not read and cut again for it.
        keyed = chunks.withColumn("id", enrich.record_id(mode))
        keyed.write.parquet(cut)
        chunks = collection.new_records(spark.read.schema(keyed.schema).parquet(cut), name).drop("id")
    no_error = F.lit(None).cast("string")
    if mode == "naive":
        told = chunks.withColumns({"summary": F.col("text"), "summary_error": no_error})
    elif summarize_fn is None:
        told = enrich.summarize(chunks).withColumn("summary_error", no_error)
    else:
        told = enrich.batch_map(chunks, summarize_fn, ["text"], "summary", "string", "summary_error")
    vectors = _embedded(told, "summary", embed_fn, "embedding", "embed_error")
    ready = vectors.withColumn("error", F.coalesce("summary_error", "embed_error"))
    records = enrich.chunk_records(ready, mode, F.col("summary"), F.col("embedding"), ["error"])
    barred = F.coalesce("error", collection.fault(), collection.too_wide() if reject_wide else no_error)
    # Written once: the records are read for storing and again for the report.
    records = materialize(
        records.withColumns({"stored": barred.isNull(), "reason": F.coalesce(barred, collection.too_wide())}).drop("error"),
        "records",
    )
    remove(spark, cut)
    collection.append(records.where("stored"), name, batch, staged=True)
    return records.where(F.col("reason").isNotNull()).select(
        "id", "repo", "chunk_file", "chunk_lines", "reason", "stored"
    )


def index_stream_files(
    stream: DataFrame, mode: str, name: str, checkpoint: str, path: str | None = None, compact_after: int = 50, **options
) -> DataFrame:
    """Index the files of a stream (repo, path, language, text) batch by batch into collection
    ``name``, made if missing, by ``index_files`` and its ``options``; the collection. Every
    batch is stored once, and chunks that are there already are left out before anything costly."""
    spark = stream.sparkSession
    collection.create_collection(spark, name, path or fresh_dir(spark, name))
    ingest.into_collection(
        stream, name, checkpoint, lambda batch, tag: index_files(batch, mode, name, batch=tag, **options), compact_after
    )
    return collection.read(spark, name)


def embed_questions(questions: DataFrame, embed_fn: BatchFunction | None = None) -> DataFrame:
    """(q_id, question, qv, question_error), worked out once: a search reads its questions
    more than once."""
    asked = _embedded(questions.select("q_id", "question"), "question", embed_fn, "qv", "question_error")
    return materialize(asked, "questions")


def find(
    spark: SparkSession,
    questions: DataFrame,
    name: str,
    mode: str,
    repo_name: str | None = None,
    k: int = TOP_K,
    embed_fn: BatchFunction | None = None,
) -> DataFrame:
    """Best chunks of collection ``name`` for questions (q_id, question), or for embedded ones."""
    stored = collection.read(spark, name, repo_name)
    asked = questions if "qv" in questions.columns else embed_questions(questions, embed_fn)
    asked = asked.where(F.col("qv").isNotNull()).select("q_id", "qv")
    return top_k(stored, asked, k=k, output_fields=HIT_FIELDS).withColumn("mode", F.lit(mode))


def ask(
    spark: SparkSession,
    questions: DataFrame,
    name: str,
    mode: str,
    repo_name: str | None = None,
    k: int = TOP_K,
    answer_fn: BatchFunction | None = None,
    embed_fn: BatchFunction | None = None,
) -> DataFrame:
    """(q_id, question, context, answer, error): by ``answer_fn`` over question and
    context, else the summary of the best chunk. ``error`` is what kept a question from
    being embedded, or its answer from being made.
    """
    asked = embed_questions(questions, embed_fn)
    hits = materialize(find(spark, asked, name, mode, repo_name, k), "hits")
    contexts = context.assemble_context(hits, ["q_id"]).select("q_id", "context")
    with_context = asked.select("q_id", "question", "question_error").join(contexts, "q_id", "left")
    if answer_fn is not None:
        answered = enrich.answer(with_context, hits, answer_fn)
    else:
        answered = enrich.answer(with_context, hits).join(with_context.drop("question"), "q_id", "left").withColumn(
            "error", F.lit(None).cast("string")
        )
    return answered.select(
        "q_id", "question", "context", "answer", F.coalesce("question_error", "error").alias("error")
    )


def compare(
    spark: SparkSession,
    questions: DataFrame,
    smart_name: str,
    naive_name: str,
    k: int = TOP_K,
    embed_fn: BatchFunction | None = None,
    judge_fn: BatchFunction | None = None,
) -> DataFrame:
    """(q_id, question, smart, naive, choice, error): both contexts and the better one, as
    ``judge_fn`` over question, smart and naive says, else by word overlap.
    """
    asked = embed_questions(questions, embed_fn)
    hits = find(spark, asked, smart_name, "smart", k=k).unionByName(find(spark, asked, naive_name, "naive", k=k))
    wide = context.side_by_side(context.assemble_context(materialize(hits, "hits"), ["q_id", "mode"]))
    pairs = asked.select("q_id", "question", "question_error").join(wide, "q_id", "left")
    if judge_fn is None:
        chosen = context.choose_context(pairs).withColumn("error", F.lit(None).cast("string"))
    else:
        chosen = enrich.batch_map(pairs, judge_fn, ["question", "smart", "naive"], "choice", "string")
    return chosen.select(
        "q_id", "question", "smart", "naive", context.clean_choice(F.col("choice")).alias("choice"),
        F.coalesce("question_error", "error").alias("error"),
    )


def evaluate_answers(asked: DataFrame, answers: DataFrame, judge_fn: BatchFunction | None = None) -> DataFrame:
    """Results of an experiment, a row per (repo, n).

    ``asked`` has question and reference, ``answers`` smart_response and
    naive_response; one that is missing leaves its scores null. ``judge_fn`` answers
    the prompt of a blind pair with A or B (``judge_error`` says why it failed); without
    it the longer response wins.
    """
    keys = ["repo", "n"]
    wide = evaluate.partial_results(asked, answers, keys)
    long = evaluate.long_responses(evaluate.spread(wide, *keys))
    nested = evaluate.nested_metrics(evaluate.score_responses(long), keys)
    scores = nested.select(
        *keys,
        *[
            F.col(f"metrics.{mode}.{field}").alias(f"{mode}_{name}")
            for mode in evaluate.MODES
            for field, name in (("bleu", "bleu"), ("rougeL", "rouge_l"), ("ter", "ter"))
        ],
    )
    pairs = evaluate.ab_pairs(wide.dropna(subset=["question", "smart_response", "naive_response"]), keys)
    if judge_fn is None:
        judged = pairs.withColumns(
            {
                "choice": evaluate.longer_response(F.col("response_a"), F.col("response_b")),
                "judge_error": F.lit(None).cast("string"),
            }
        )
    else:
        judged = enrich.batch_map(pairs, judge_fn, ["prompt"], "choice", "string", "judge_error")
    chosen = judged.select(
        *keys, evaluate.chosen_mode(F.col("choice"), F.col("first_mode")).alias("chosen_mode"), "judge_error"
    )
    return evaluate.partial_results(evaluate.partial_results(wide, scores, keys), chosen, keys)
