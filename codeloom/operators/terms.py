"""Exact top-k search over sets of terms, by an inverted index.

Rows score by the number of terms they share with a query. A row that shares ``t`` of a query's
``m`` terms lacks ``m - t`` of them at most, so it has one of any ``m - t + 1``: given ``k``
rows of score ``t`` or more, only the postings of a query's rarest ``m - t + 1`` terms are read.
Terms that most rows have are thus hardly ever followed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.operators.search import TOP_K, rank_hits
from codeloom.workspace import fresh_dir, materialize

#: Rows of a posting list that are stored together, and that the first guess of a query reads.
BLOCK = 4096
#: So few terms are named to the scan, which skips row groups by them.
NAMED_TERMS = 1000


@dataclass
class TermIndex:
    """(term, block, ids) in order of terms, (term, n) how many rows have each, and (id, terms)."""

    postings: DataFrame
    sizes: DataFrame
    rows: DataFrame


def build_terms(collection: DataFrame, id_col: str = "id", terms_col: str = "terms", path: str | None = None) -> TermIndex:
    """Write the index of a collection. A posting list is cut into blocks by a hash of the row,
    so that one of a term that most rows have is many rows of the index and no group's work alone."""
    spark = collection.sparkSession
    path = path or fresh_dir(spark, "terms")
    rows = collection.select(F.col(id_col).alias("id"), F.array_compact(F.array_distinct(terms_col)).alias("terms"))
    rows.where(F.size("terms") > 0).write.parquet(f"{path}/rows")
    stored = spark.read.schema(rows.schema).parquet(f"{path}/rows")
    blocks = max(1, stored.count() // BLOCK)
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    listed = stored.select("id", F.explode("terms").alias("term")).groupBy("term", block.alias("block")).agg(
        F.sort_array(F.collect_list("id")).alias("ids")
    )
    listed.repartitionByRange("term", "block").sortWithinPartitions("term", "block").write.parquet(f"{path}/postings")
    postings = spark.read.parquet(f"{path}/postings")
    postings.groupBy("term").agg(F.sum(F.size("ids")).alias("n")).write.parquet(f"{path}/sizes")
    return open_terms(spark, path)


def open_terms(spark: SparkSession, path: str) -> TermIndex:
    return TermIndex(*(spark.read.parquet(f"{path}/{part}") for part in ("postings", "sizes", "rows")))


def _ranked_terms(index: TermIndex, queries: DataFrame, query_id_col: str, query_terms_col: str) -> DataFrame:
    """(q_id, term, n, place, m): the terms of each query that the index has, rarest first."""
    asked = queries.select(F.col(query_id_col).alias("q_id"), F.explode(F.array_distinct(query_terms_col)).alias("term"))
    known = asked.join(index.sizes, "term")
    rarest = Window.partitionBy("q_id").orderBy("n", "term")
    return known.withColumns({"place": F.row_number().over(rarest), "m": F.count("*").over(Window.partitionBy("q_id"))})


def _postings(index: TermIndex, terms: DataFrame) -> DataFrame:
    """Blocks of the posting lists of (q_id, term, ...)."""
    named = terms.select("term").distinct().limit(NAMED_TERMS + 1).collect()
    lists = index.postings
    if len(named) <= NAMED_TERMS:
        lists = lists.where(F.col("term").isin([r[0] for r in named]))
    return lists.join(terms, "term")


def _scored(index: TermIndex, found: DataFrame, asked: DataFrame) -> DataFrame:
    """(q_id, id, score) of candidate pairs, from the whole rows."""
    shared: Column = F.size(F.array_intersect("terms", "q_terms")).cast("bigint")
    return found.join(index.rows, "id").join(asked, "q_id").select("q_id", "id", shared.alias("score"))


def _pairs(lists: DataFrame) -> DataFrame:
    return lists.select("q_id", F.explode("ids").alias("id")).distinct()


def term_candidates(
    index: TermIndex, queries: DataFrame, k: int = TOP_K, query_id_col: str = "q_id", query_terms_col: str = "q_terms"
) -> DataFrame:
    """(q_id, id): rows that can be among the ``k`` best of each query, all of these among them.

    A block of each of a query's rarest terms, as many as it takes to have ``k`` rows, gives
    ``k`` scores; the least of them tells which posting lists have to be read.
    """
    asked = queries.select(F.col(query_id_col).alias("q_id"), F.col(query_terms_col).alias("q_terms"))
    ranked = materialize(_ranked_terms(index, queries, query_id_col, query_terms_col), "query-terms")
    before = Window.partitionBy("q_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    few = ranked.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("before") < 2 * k)
    first = _postings(index, few.select("q_id", "term")).where("block = 0 OR size(ids) < 64")
    guess = _scored(index, _pairs(first), asked)
    best = Window.partitionBy("q_id").orderBy(F.col("score").desc())
    kth = guess.withColumn("i", F.row_number().over(best)).where(F.col("i") == k).select("q_id", F.col("score").alias("t"))
    needed = ranked.join(kth, "q_id", "left").where(F.col("place") <= F.col("m") - F.coalesce("t", F.lit(1)) + 1)
    return _pairs(_postings(index, needed.select("q_id", "term")))


def search_terms(
    index: TermIndex, queries: DataFrame, k: int = TOP_K, query_id_col: str = "q_id", query_terms_col: str = "q_terms"
) -> DataFrame:
    """(q_id, rank, id, score): the ``k`` rows that share most distinct terms with each query, at
    least one; ties to the smaller id."""
    asked = queries.select(F.col(query_id_col).alias("q_id"), F.col(query_terms_col).alias("q_terms"))
    found = term_candidates(index, queries, k, query_id_col, query_terms_col)
    return rank_hits(_scored(index, found, asked), k)


def top_k_terms(
    collection: DataFrame,
    queries: DataFrame,
    k: int = TOP_K,
    id_col: str = "id",
    terms_col: str = "terms",
    query_id_col: str = "q_id",
    query_terms_col: str = "q_terms",
) -> DataFrame:
    """``search_terms`` over a collection indexed for this once."""
    return search_terms(build_terms(collection, id_col, terms_col), queries, k, query_id_col, query_terms_col)
