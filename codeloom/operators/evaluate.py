"""Evaluation of two sets of answers: questions, scores, blind pairs, report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.binding import bind
from codeloom.functions.prompts import preference_prompt
from codeloom.functions.repos import repo_name
from codeloom.operators import metrics
from codeloom.sources.files import QUESTIONS_PER_PROJECT
from codeloom.workspace import small_batches

MODES = ("smart", "naive")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows over as many tasks as the session has, for work that costs time per row
    rather than bytes, which would otherwise be coalesced to a few tasks. Four tasks a core
    are enough: work on the rows of a batch together costs the less a row the more they are.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    n = max(cores, min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * cores))
    return df.repartition(n, *keys)


def unpivot_sheet(sheet: DataFrame) -> DataFrame:
    """(repo, n, question, reference): one row per project and question."""
    rows = ", ".join(
        f"{i}L, `Query {i}`, `Doc {i}`" for i in range(1, QUESTIONS_PER_PROJECT + 1)
    )
    return sheet.select(
        repo_name(F.col("Github URL")).alias("repo"),
        F.expr(f"stack({QUESTIONS_PER_PROJECT}, {rows}) as (n, question, reference)"),
    )


def long_responses(wide: DataFrame) -> DataFrame:
    """(..., mode, response) from a ``smart_response`` and a ``naive_response`` column."""
    rest = [c for c in wide.columns if c not in ("smart_response", "naive_response")]
    return wide.select(
        *rest,
        F.expr("stack(2, 'smart', smart_response, 'naive', naive_response) as (mode, response)"),
    )


def score_responses(
    responses: DataFrame, prediction_col: str = "response", reference_col: str = "reference"
) -> DataFrame:
    """Adds bleu_counts, bleu, rouge_l, word_edit_rate and ter; null where a text is missing."""
    small_batches(responses.sparkSession)
    p, r = F.col(prediction_col), F.col(reference_col)
    both = p.isNotNull() & r.isNotNull()
    p, r = F.coalesce(p, F.lit("")), F.coalesce(r, F.lit(""))
    scored = responses.select(
        "*",
        both.alias("_both"),
        bind(metrics.bleu_counts(p, r), lambda c: F.struct(c.alias("counts"), metrics.bleu_score(c).alias("score"))).alias("_bleu"),
        metrics.rouge_l(p, r).alias("rouge_l"),
        metrics.word_edit_rate(p, r).alias("word_edit_rate"),
        metrics.ter(p, r).alias("ter"),
    )
    found = {"bleu_counts": "_bleu.counts", "bleu": "_bleu.score"} | {n: n for n in ("rouge_l", "word_edit_rate", "ter")}
    return scored.select(
        *responses.columns, *[F.when(F.col("_both"), F.col(c)).alias(n) for n, c in found.items()]
    )


def nested_metrics(scores: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metrics): {smart, naive} -> {bleu, rougeL, ter}; two rows per group."""

    def of(mode: str) -> Column:
        def pick(c: str) -> Column:
            return F.max(F.when(F.col("mode") == mode, F.col(c)))

        return F.struct(
            pick("bleu").alias("bleu"), pick("rouge_l").alias("rougeL"), pick("ter").alias("ter")
        )

    return scores.groupBy(*keys).agg(
        F.struct(of("smart").alias("smart"), of("naive").alias("naive")).alias("metrics")
    )


def ab_pairs(wide: DataFrame, keys: list[str], seed: int = 0) -> DataFrame:
    """Adds both responses in blind order, the mode shown first and the prompt.

    The order is a coin per row from a hash of its keys and the seed, so a rerun
    shows the same order.
    """
    coin = F.conv(
        F.substring(F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))), 1, 8),
        16,
        10,
    ).cast("bigint") % 2
    first = F.when(coin == 0, "smart").otherwise("naive")
    shown = wide.withColumn("first_mode", first)
    smart_first = F.col("first_mode") == "smart"
    shown = shown.withColumn(
        "response_a", F.when(smart_first, F.col("smart_response")).otherwise(F.col("naive_response"))
    ).withColumn(
        "response_b", F.when(smart_first, F.col("naive_response")).otherwise(F.col("smart_response"))
    )
    return shown.withColumn(
        "prompt",
        preference_prompt(F.col("question"), F.col("response_a"), F.col("response_b")),
    )


def chosen_mode(reply: Column, first_mode: Column) -> Column:
    """Mode of the response shown in the position that the reply names, else null."""
    second = F.when(first_mode == "smart", "naive").otherwise("smart")
    said = F.trim(reply)
    return F.when(said == "A", first_mode).when(said == "B", second)


def longer_response(response_a: Column, response_b: Column) -> Column:
    """Built-in judge: names the longer response, A on equal lengths."""
    return F.when(F.length(response_a) >= F.length(response_b), "A").otherwise("B")


def partial_results(questions: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Every question, with its results or, where it failed, nulls."""
    return questions.join(results, keys, "left")


def eval_report(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Per keys and mode: answered questions, mean scores and how often the mode was
    preferred, as a count and as a share of the questions with a preference. ``corpus_bleu``
    is that of all answers as one text, from their summed counts: the mean of scores of
    short answers, most of which are 0, says little.

    ``scores`` has mode, bleu_counts, bleu, rouge_l, word_edit_rate, ter and chosen_mode.
    """
    preferred = F.count_if(F.col("chosen_mode") == F.col("mode"))
    judged = F.count("chosen_mode")
    return scores.groupBy(*keys, "mode").agg(
        F.count("bleu").alias("n_scored"),
        F.avg("bleu").alias("bleu"),
        metrics.pooled_bleu(F.col("bleu_counts")).alias("corpus_bleu"),
        F.avg("rouge_l").alias("rouge_l"),
        F.avg("word_edit_rate").alias("word_edit_rate"),
        F.count("ter").alias("n_ter"),
        F.avg("ter").alias("ter"),
        preferred.alias("n_preferred"),
        F.when(judged > 0, preferred / judged).alias("preference_share"),
    )


def report_by_mode(report: DataFrame, keys: list[str]) -> DataFrame:
    """The report with one column per mode and measure."""
    wide = report.groupBy(*keys).pivot("mode", list(MODES)).agg(
        *[F.first(c).alias(c) for c in report.columns if c not in (*keys, "mode")]
    )
    return wide
