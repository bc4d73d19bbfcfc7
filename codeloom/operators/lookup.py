"""Scopes that a question names, with their parent and children."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import words
from codeloom.operators.terms import TermIndex, build_terms, search_terms
from codeloom.workspace import materialize


def name_terms(name):
    """Words of an identifier, split at underscores and case changes."""
    spaced = F.regexp_replace(F.regexp_replace(name, r"([\p{Ll}\p{N}])(\p{Lu})", "$1 $2"), "_", " ")
    return words(spaced)


def index_scopes(chunks: DataFrame, path: str | None = None) -> TermIndex:
    """The inverted index of the words in the names of scopes, by their first chunk."""
    named = chunks.where(F.col("part") == 0).where(F.col("name").isNotNull())
    return build_terms(named.select("chunk_id", name_terms(F.col("name")).alias("terms")), "chunk_id", path=path)


def scope_lookup(
    questions: DataFrame, chunks: DataFrame, links: DataFrame, k: int = 5, index: TermIndex | None = None
) -> DataFrame:
    """(q_id, rank, chunk_id, score, relation, related): the ``k`` scopes whose names
    share most words with the question, each listed with itself, its parent and its
    children. ``links`` are clean and hold the child links.

    The hits are written out, since they serve twice; being k to a question, their
    size then lets Spark decide how to join them with all links. ``index`` is that of
    ``index_scopes``, made here if there is none.
    """
    asked = questions.select("q_id", words(F.col("question")).alias("q_terms"))
    hits = search_terms(index or index_scopes(chunks), asked, k)
    hits = materialize(hits.withColumnRenamed("id", "chunk_id"), "hits")
    family = links.where(F.col("relation").isin("parent", "child")).select("chunk_id", "relation", "target")
    itself = hits.select("q_id", "rank", "chunk_id", "score", F.lit("self").alias("relation"),
                         F.col("chunk_id").alias("related"))
    around = hits.join(family, "chunk_id").select(
        "q_id", "rank", "chunk_id", "score", "relation", F.col("target").alias("related")
    )
    return itself.unionByName(around)
