"""Connected components by large-star and small-star rounds over tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.joins import match_keys
from codeloom.workspace import materialize


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = _both_ways(edges)
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count_if(F.col("b") > F.col("a")).alias("n"))
    larger = match_keys(both.where("b > a"), least.where("n > 0"), ["a"], "n")
    return larger.select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them. Edges go from larger to smaller."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    return (
        match_keys(edges, least, ["a"], "n")
        .select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        .select(F.col("e.b").alias("a"), F.col("e.m").alias("b"))
        .where("a > b")
        .distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b), where root is the smallest node reachable.

    Nodes are longs. Each round reads and writes edges by joins and grouped minima. The centre
    of a large star is matched by a bounded broadcast (``match_keys``), so its edges stay
    where they are; no component meets in one task. Ends when a round changes nothing, after about log2 of the longest path rounds.
    Null ends, loops and repeated edges are ignored.
    """
    edges = (
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    edges = materialize(edges, "edges")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())

    before = mark(edges)
    while before[0]:
        edges = materialize(_small_star(materialize(_large_star(edges), "stars")), "edges")
        after = mark(edges)
        if after == before:
            break
        before = after
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
