"""Views of the given tables that stand in for corpora, source files and sheets."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.operators.evaluate import spread
from codeloom.operators.nodes import prose_nodes
from codeloom.operators.packing import MAX_CHARS, structural_chunks
from codeloom.operators.windows import token_windows
from codeloom.sources.corpus import write_corpus
from codeloom.sources.tables import read_table
from codeloom.workspace import fresh_dir

RECORD = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("repo", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)
# Text files written by Spark end in .txt.
WRITTEN = "*.txt"


def table(spark: SparkSession, sf: str, name: str, spread_by: str | None = None) -> DataFrame:
    return read_table(spark, f"{sf}/{name}.parquet", spread_by)


def _by_lang(values: dict[str, str]):
    expr = F
    for lang, value in values.items():
        expr = expr.when(F.col("lang") == lang, value)
    return expr


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as corpus records: repository, language, split, path, scan order."""
    ext = _by_lang({"en": ".py", "de": ".java", "fr": ".go", "es": ".rb"})
    split_no = F.col("doc_id") % 10
    return table(spark, sf, "documents", "doc_id").select(
        F.col("doc_id").alias("seq"),
        F.concat(F.lit("org"), F.col("doc_id") % 3, F.lit("/"), "source").alias("repo"),
        _by_lang({"en": "python", "de": "java", "fr": "go", "es": "ruby"}).alias("language"),
        F.when(split_no < 8, "train").when(split_no == 8, "test").otherwise("valid").alias("split"),
        F.concat(F.lit("d"), "doc_id", ext).alias("path"),
        "text",
    )


@functools.lru_cache(maxsize=8)
def _corpus_folder(spark: SparkSession, sf: str, application: str) -> str:
    base = fresh_dir(spark, "corpus", keep=True)
    good = F.to_json(F.struct("seq", "repo", "path", "text"))
    bad = F.when(F.col("seq") % 50 == 0, F.concat(F.lit('{"seq": '), "seq", F.lit(', "repo": "cut')))
    lines = corpus(spark, sf).select(
        "language", "split", "seq", F.explode(F.array_compact(F.array(good, bad))).alias("line")
    )
    write_corpus(lines, base, order_col="seq")
    return base


def corpus_folder(spark: SparkSession, sf: str) -> str:
    """The corpus as JSON lines in order of seq, with a truncated line to every fiftieth record."""
    return _corpus_folder(spark, sf, spark.sparkContext.applicationId)


def code_lines(spark: SparkSession, sf: str) -> DataFrame:
    """(repo, path, ln, line): small classes made of parts, a file per brand and
    thousand keys, so files stay small however many parts there are.
    """
    part = table(spark, sf, "part").select(
        "p_partkey",
        "p_type",
        "p_size",
        F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))).alias("brand"),
        F.concat_ws("_", F.replace("p_name", F.lit(" "), F.lit("_")), "p_partkey").alias("fn"),
        F.round(F.col("p_retailprice") * 100).cast("bigint").alias("cents"),
    )
    part = part.withColumn("path", F.concat("brand", F.lit("_"), F.floor(F.col("p_partkey") / 1000), F.lit(".py")))
    first = F.row_number().over(Window.partitionBy("path", "p_type").orderBy("p_partkey")) == 1
    pieces = part.withColumn("first", first).select(
        F.concat(F.lit("shop/"), "brand").alias("repo"),
        "path",
        "p_type",
        "p_partkey",
        F.posexplode(
            F.array(
                F.when(F.col("first"), F.concat(F.lit("class "), F.initcap(F.lower("p_type")), F.lit(":"))),
                F.when(F.col("p_size") % 7 == 0, F.lit("    @traced")),
                F.concat(F.lit("    def "), "fn", F.lit("(self, qty):")),
                F.lit('        """Price of one order."""'),
                F.concat(F.lit("        if qty > "), "p_size", F.lit(":")),
                F.concat(F.lit("            return qty * "), "cents"),
                F.lit(""),
                F.lit("        return 0"),
            )
        ).alias("sub", "line"),
    ).where(F.col("line").isNotNull())
    in_file = Window.partitionBy("path").orderBy("p_type", "p_partkey", "sub")
    return pieces.select("repo", "path", (F.row_number().over(in_file) - 1).alias("ln"), "line")


def code_files(spark: SparkSession, sf: str) -> DataFrame:
    """(repo, path, text)."""
    lines = F.array_sort(F.collect_list(F.struct("ln", "line")))
    return code_lines(spark, sf).groupBy("repo", "path").agg(
        F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text")
    )


def repo_urls(spark: SparkSession, sf: str) -> DataFrame:
    """(url): clone and file URLs of the corpus, and page URLs."""
    repo = F.concat(F.lit("https://github.com/"), "repo")
    urls = F.array(
        F.concat(repo, F.lit(".git")), F.concat(repo, F.lit("/blob/main/"), "seq", F.lit(".py"))
    )
    made = corpus(spark, sf).select(F.explode(urls).alias("url"))
    return made.unionByName(table(spark, sf, "pages").select("url"))


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents", "doc_id").select("doc_id", "text")


def document_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return prose_nodes(documents(spark, sf))


def label_queries(spark: SparkSession, sf: str) -> DataFrame:
    """(q_id, label, qv): the mean vector of each label, as search vectors."""
    parts = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("pos", "v"))
    means = parts.groupBy("label", "pos").agg(F.avg(F.col("v").cast("double")).alias("v"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "v")))
    return means.groupBy("label").agg(F.transform(ordered, lambda x: x["v"]).alias("qv")).select(
        F.col("label").cast("bigint").alias("q_id"), "label", "qv"
    )


FILE_COLUMNS = ("repo", "path", "language")


def naive_chunks(files: DataFrame) -> DataFrame:
    """Token windows of corpus files, with the columns of a chunk."""
    cut = token_windows(files, id_col="seq", keep=FILE_COLUMNS)
    no_line = F.lit(None).cast("bigint")
    return _as_chunks(cut.withColumns({"start_line": no_line, "end_line": no_line}), "naive", "win")


def chunk_texts(files: DataFrame, mode: str) -> DataFrame:
    """(chunk_id, text) alone: token windows (``naive``) or structural chunks (``smart``)."""
    if mode == "naive":
        cut, part = token_windows(files, id_col="seq"), "win"
    else:
        cut, part = structural_chunks(prose_nodes(files, "seq", sentences_over=MAX_CHARS), files, id_col="seq"), "start"
    return cut.select(F.concat_ws(":", "seq", part).alias("chunk_id"), "text")


def _as_chunks(cut: DataFrame, mode: str, part: str) -> DataFrame:
    return cut.select(
        F.concat_ws(":", "seq", part).alias("chunk_id"),
        F.lit(mode).alias("mode"),
        "seq",
        F.col(part).alias("part"),
        *FILE_COLUMNS,
        "start_line",
        "end_line",
        "text",
    )


def eval_long(spark: SparkSession, sf: str) -> DataFrame:
    """(repo, n, question, reference, smart_response, naive_response), a row for each answer
    of a conversation: the question before it, the answer itself, and its neighbours among
    the answers as reference and second response. A user turn that nobody answers is a
    question without answers. ``n`` counts the rows of five conversations.
    """
    spoken = table(spark, sf, "conversations").where(F.col("role").isin("user", "assistant"))
    in_conv = Window.partitionBy("conv_id").orderBy("turn", "role")
    in_role = Window.partitionBy("conv_id", "role").orderBy("turn")
    by_user = F.col("role") == "user"
    asked = F.last(F.when(by_user, F.col("text")), ignorenulls=True).over(
        in_conv.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    before, after = (lambda i: F.lag("text", i).over(in_role)), (lambda i: F.lead("text", i).over(in_role))
    second = F.coalesce(F.when(after(1).isNotNull(), before(1)).otherwise(before(2)), after(2))
    answered = spoken.select(
        "conv_id", "turn", "role", by_user.alias("by_user"), asked.alias("question"), "text",
        F.coalesce(after(1), before(1)).alias("neighbour"), second.alias("second"),
        F.lead("role").over(in_conv).alias("next_role"),
    ).where("NOT by_user OR coalesce(next_role, 'user') = 'user'")
    answer = lambda c: F.when(~F.col("by_user"), F.col(c))
    repo = F.concat(F.lit("proj"), F.floor(F.col("conv_id") / 5))
    rows = answered.withColumn("repo", repo)
    return rows.select(
        "repo",
        F.row_number().over(Window.partitionBy("repo").orderBy("conv_id", "turn", "role")).cast("bigint").alias("n"),
        "question",
        answer("neighbour").alias("reference"),
        answer("text").alias("smart_response"),
        answer("second").alias("naive_response"),
    )


def eval_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """``eval_long`` spread over the tasks, for scoring."""
    return spread(eval_long(spark, sf), "repo", "n")


def eval_wide(spark: SparkSession, sf: str) -> DataFrame:
    """The evaluation sheet: five questions and references to a row, as many rows to a
    project as it needs, which are projects of their own.
    """
    long = eval_long(spark, sf)
    placed = long.select(
        F.concat_ws("-", "repo", F.floor((F.col("n") - 1) / 5)).alias("project"),
        ((F.col("n") - 1) % 5 + 1).alias("i"), "question", "reference",
    )
    cells = [
        F.max(F.when(F.col("i") == i, F.col(source))).alias(f"{kind} {i}")
        for kind, source in (("Query", "question"), ("Doc", "reference"))
        for i in range(1, 6)
    ]
    sheet = placed.groupBy("project").agg(*cells)
    url = F.concat(F.lit("https://github.com/eval/"), "project", F.lit(".git"))
    return sheet.select(
        F.col("project").alias("Project Name"), url.alias("Github URL"), *sheet.columns[1:]
    )
