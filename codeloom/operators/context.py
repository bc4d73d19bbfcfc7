"""From hits to contexts, and the choice between two contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import words


def hit_text(mode: Column) -> Column:
    """What a hit shows: summary, blank line and code; in naive mode the summary."""
    return F.when(mode == "naive", F.col("summary")).otherwise(
        F.concat_ws("\n\n", "summary", "chunk_code")
    )


def in_rank_order(text: Column, separator: str) -> Column:
    """Aggregate: the texts of a query's hits, joined in rank order."""
    listed = F.array_sort(F.collect_list(F.struct("rank", text.alias("text"))))
    return F.array_join(F.transform(listed, lambda h: h["text"]), separator)


def assemble_context(
    hits: DataFrame, keys: list[str], separator: str = "\n", *more: Column
) -> DataFrame:
    """(keys, n_hits, context, *more): hit texts in rank order. A group is the k hits
    of a query. ``hits`` has rank, mode, summary and chunk_code; ``more`` are further
    aggregates of them.
    """
    shown = hit_text(F.col("mode"))
    return hits.groupBy(*keys).agg(
        F.count("*").alias("n_hits"), in_rank_order(shown, separator).alias("context"), *more
    )


def side_by_side(contexts: DataFrame) -> DataFrame:
    """(q_id, smart, naive) from one context per (q_id, mode)."""
    wide = contexts.groupBy("q_id").pivot("mode", ["smart", "naive"]).agg(F.first("context"))
    return wide.select("q_id", "smart", "naive")


def term_overlap(query: Column, context: Column) -> Column:
    """Distinct query words that the context holds."""
    return F.size(F.array_intersect(words(query), words(F.coalesce(context, F.lit(""))))).cast("bigint")


def choose_context(pairs: DataFrame, question_col: str = "question") -> DataFrame:
    """Adds the overlaps and ``choice``: the larger overlap, ties to smart."""
    question = F.col(question_col)
    return pairs.withColumn("smart_overlap", term_overlap(question, F.col("smart"))).withColumn(
        "naive_overlap", term_overlap(question, F.col("naive"))
    ).withColumn(
        "choice",
        F.when(F.col("smart_overlap") >= F.col("naive_overlap"), "smart").otherwise("naive"),
    )


def clean_choice(reply: Column) -> Column:
    """``smart`` or ``naive`` if the reply says just one of them, else null."""
    folded = F.lower(reply)
    smart, naive = folded.rlike(r"\bsmart\b"), folded.rlike(r"\bnaive\b")
    return F.when(smart & ~naive, "smart").when(naive & ~smart, "naive")
