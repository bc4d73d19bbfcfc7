"""Clustered index: k-means, build, probed search, and search with a guarantee.

Centroids are a table of a bounded size (``MAX_CENTROID_BYTES``) that travels with the tasks,
so vectors are assigned, summed and probed where they lie: no vector is shuffled but for the
sizes of the files when the index is written.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from codeloom.operators.search import METRICS, QUERY_BLOCK, TIE_DECIMALS, TOP_K, rank_hits, top_k
from codeloom.workspace import fresh_dir, materialize

NLIST = 128
NPROBE = 10
MAX_ITER = 10
MAX_CENTROID_BYTES = 64 << 20
#: Centroids that move less than this do not move.
STILL = 1e-9


@dataclass
class ClusteredIndex:
    """Collection written by cluster, and (cid, centroid, radius, n) of each cluster."""

    collection: DataFrame
    centroids: DataFrame
    metric: str


@dataclass
class Centroids:
    """Centroids in order of their numbers, as tasks use them; for cosine they are unit vectors."""

    cids: np.ndarray
    vectors: np.ndarray
    metric: str
    radii: np.ndarray | None = None

    def scores(self, vectors: np.ndarray) -> np.ndarray:
        """How near each centroid is to each vector, larger is nearer; equal to nine decimals is equal."""
        near = "cosine" if self.metric == "cosine" else "l2"
        score, larger = METRICS[near]
        found = np.round(score(vectors, self.vectors), TIE_DECIMALS)
        return found if larger else -found

    def distances(self, vectors: np.ndarray, which: np.ndarray) -> np.ndarray:
        """From vectors to one centroid each, by a measure for which the triangle inequality holds:
        the angle for cosine, else the length of the difference. A vector of length zero is infinitely far."""
        chosen = self.vectors[which]
        if self.metric != "cosine":
            return np.linalg.norm(vectors - chosen, axis=1)
        lengths = np.linalg.norm(vectors, axis=1) * np.linalg.norm(chosen, axis=1)
        cosine = np.divide((vectors * chosen).sum(1), lengths, out=np.zeros(len(vectors)), where=lengths > 0)
        return np.where(lengths > 0, np.arccos(np.clip(cosine, -1, 1)), np.inf)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The best score that a vector of each cluster can have for each query (for l2 less is better)."""
        if self.metric == "cosine":
            angles = np.arccos(np.clip(METRICS["cosine"][0](queries, self.vectors), -1, 1))
            found = np.cos(np.maximum(angles - self.radii, 0))
            # All are equally near to a query of length zero.
            found[np.linalg.norm(queries, axis=1) == 0] = 1.0
            return np.where(np.isinf(self.radii), 1.0, found)
        if self.metric == "ip":
            return queries @ self.vectors.T + np.linalg.norm(queries, axis=1, keepdims=True) * self.radii
        return np.maximum(METRICS["l2"][0](queries, self.vectors) - self.radii, 0)


def _held(table: DataFrame, metric: str) -> Centroids:
    """A centroid table (cid, centroid and maybe radius) as tasks use it."""
    size = table.agg(F.sum(F.size("centroid")).alias("n")).first()["n"] or 0
    if size * 8 > MAX_CENTROID_BYTES:
        raise ValueError(f"centroids of {size * 8} bytes, more than a task is to hold: {MAX_CENTROID_BYTES}")
    rows = sorted(table.collect(), key=lambda r: r["cid"])
    vectors = np.array([r["centroid"] for r in rows], np.float64).reshape(len(rows), len(rows[0]["centroid"]) if rows else 0)
    radii = np.array([r["radius"] for r in rows], np.float64) if "radius" in table.columns else None
    return Centroids(np.array([r["cid"] for r in rows], np.int64), vectors, metric, radii)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def seeds(collection: DataFrame, nlist: int, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """(cid, centroid): the vectors of the ``nlist`` least hashes of their ids, numbered in that order."""
    order = F.md5(F.col(id_col).cast("string"))
    some = collection.where(F.col(vector_col).isNotNull()).select(order.alias("h"), F.col(id_col).alias("i"), F.col(vector_col).alias("v"))
    chosen = some.orderBy("h", "i").limit(nlist).collect()
    rows = [(i, [float(x) for x in r["v"]]) for i, r in enumerate(chosen)]
    return collection.sparkSession.createDataFrame(rows, "cid int, centroid array<double>")


def fit_centroids(
    collection: DataFrame,
    nlist: int = NLIST,
    metric: str = "cosine",
    id_col: str = "id",
    vector_col: str = "embedding",
    max_iter: int = MAX_ITER,
) -> DataFrame:
    """(cid, centroid) by k-means: from ``seeds``, vectors go to their nearest centroid (ties to the
    smaller number) and centroids to the mean of their vectors (of unit vectors for cosine) until none
    moves or ``max_iter`` steps are done. A centroid without vectors stays where it is.

    A step reads the vectors once. Each task sums its own, so a row a task and cluster is
    shuffled, and the means, ``nlist`` of them, come back to the driver.
    """
    spark = collection.sparkSession
    rows = collection.where(F.col(vector_col).isNotNull()).select(F.col(vector_col).alias("vector"))
    now = _held(seeds(collection, nlist, id_col, vector_col), metric)
    for _ in range(max_iter if len(now.cids) else 0):
        means = _means(rows, now)
        moved = now.vectors.copy()
        for row in means.collect():
            total = np.array(row["total"])
            moved[row["at"]] = total / (row["n"] if metric != "cosine" else np.linalg.norm(total) or 1.0)
        still = np.abs(moved - now.vectors).max() < STILL
        now = Centroids(now.cids, moved, metric)
        if still:
            break
    table = [(int(c), [float(x) for x in v]) for c, v in zip(now.cids, now.vectors, strict=True)]
    return spark.createDataFrame(table, "cid int, centroid array<double>")


def _means(rows: DataFrame, now: Centroids) -> DataFrame:
    """(at, n, total): vectors of each centroid and their sum."""
    fields = "at int, n long, total array<double>"

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros_like(now.vectors)
        counts = np.zeros(len(now.cids), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _matrix(batch.column(0))
            nearest = now.scores(vectors).argmax(axis=1)
            if now.metric == "cosine":
                lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
                vectors = np.divide(vectors, lengths, out=np.zeros_like(vectors), where=lengths > 0)
            np.add.at(totals, nearest, vectors)
            counts += np.bincount(nearest, minlength=len(counts))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict(
            {"at": pa.array(some, pa.int32()), "n": counts[some], "total": pa.array(list(totals[some]), pa.list_(pa.float64()))}
        )

    def total(table: pa.Table) -> pa.Table:
        sums = _matrix(table["total"].combine_chunks()).sum(axis=0)
        return pa.table({"at": table["at"][:1], "n": [pc.sum(table["n"]).as_py()], "total": pa.array([sums], pa.list_(pa.float64()))})

    return rows.mapInArrow(partial, fields).groupBy("at").applyInArrow(total, fields)


def assign_clusters(collection: DataFrame, centroids: Centroids, vector_col: str = "embedding") -> DataFrame:
    """All columns with ``cid``, the nearest centroid, and ``_distance`` from it, in one pass
    without a shuffle. Rows without a vector are left out."""
    schema = T.StructType([*collection.schema.fields, T.StructField("cid", T.IntegerType()), T.StructField("_distance", T.DoubleType())])
    arrow = to_arrow_schema(schema)
    at = collection.columns.index(vector_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column(at)))
            if not batch.num_rows:
                continue
            vectors = _matrix(batch.column(at))
            nearest = centroids.scores(vectors).argmax(axis=1)
            added = [pa.array(centroids.cids[nearest], pa.int32()), pa.array(centroids.distances(vectors, nearest))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=arrow.names)

    return collection.mapInArrow(run, schema)


def build_index(
    collection: DataFrame,
    nlist: int = NLIST,
    metric: str = "cosine",
    id_col: str = "id",
    vector_col: str = "embedding",
    path: str | None = None,
    max_iter: int = MAX_ITER,
    centroids: DataFrame | None = None,
) -> ClusteredIndex:
    """Cluster the vectors and write the collection partitioned by cluster ``cid``.

    Clusters are those of ``centroids`` (cid, centroid), or ``nlist`` found by ``fit_centroids``;
    each vector goes to the nearest. The radius of each cluster is kept, as ``search_index`` needs it.
    Writers are rebalanced by size, so a hot cluster is several files and no task's work alone.
    """
    spark = collection.sparkSession
    path = path or fresh_dir(spark, "clusters")
    if centroids is None:
        centroids = fit_centroids(collection, nlist, metric, id_col, vector_col, max_iter)
    held = _held(centroids.select("cid", F.col("centroid").cast("array<double>").alias("centroid")), metric)
    clustered = assign_clusters(collection, held, vector_col)
    clustered.hint("rebalance", "cid").write.partitionBy("cid").parquet(f"{path}/vectors")
    sizes = _vectors(spark, path, collection, "_distance double").groupBy("cid").agg(F.max("_distance").alias("radius"), F.count("*").alias("n"))
    table = spark.createDataFrame(
        [(int(c), [float(x) for x in v]) for c, v in zip(held.cids, held.vectors, strict=True)], "cid int, centroid array<double>"
    )
    kept = table.join(sizes, "cid", "left").select(
        "cid", "centroid", F.coalesce("radius", F.lit(0.0)).alias("radius"), F.coalesce("n", F.lit(0)).alias("n")
    )
    kept.coalesce(1).write.parquet(f"{path}/centroids")
    return ClusteredIndex(_vectors(spark, path, collection), spark.read.parquet(f"{path}/centroids"), metric)


def _vectors(spark: SparkSession, path: str, collection: DataFrame, more: str = "") -> DataFrame:
    fields = [*collection.schema.fields, *T.StructType.fromDDL(more).fields] if more else collection.schema.fields
    schema = T.StructType([*fields, T.StructField("cid", T.IntegerType())])
    return spark.read.schema(schema).parquet(f"{path}/vectors")


def open_index(spark: SparkSession, path: str, metric: str = "cosine") -> ClusteredIndex:
    return ClusteredIndex(
        spark.read.parquet(f"{path}/vectors").drop("_distance"), spark.read.parquet(f"{path}/centroids"), metric
    )


def _probed(queries: DataFrame, held: Centroids, choose) -> DataFrame:
    """(q_id, qv, cid) for the clusters that ``choose`` picks of (centroids' scores, queries, kth scores)."""
    fields = [queries.schema["q_id"], queries.schema["qv"], T.StructField("cid", T.IntegerType())]
    arrow = to_arrow_schema(T.StructType(fields))
    columns = ["q_id", "qv", *(["kth"] if "kth" in queries.columns else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column(1)))
            # A query is taken once for each cluster, so that a batch would be many times its size.
            for first in range(0, batch.num_rows if len(held.cids) else 0, QUERY_BLOCK):
                some = batch.slice(first, QUERY_BLOCK)
                kths = some.column(2).to_numpy(zero_copy_only=False) if len(columns) > 2 else None
                q, at = np.nonzero(choose(_matrix(some.column(1)), kths))
                picked = some.take(pa.array(q))
                yield pa.RecordBatch.from_arrays([picked.column(0), picked.column(1), pa.array(held.cids[at], pa.int32())], schema=arrow)

    return queries.select(*columns).mapInArrow(run, T.StructType(fields))


def _nearest(held: Centroids, queries: np.ndarray, nprobe: int) -> np.ndarray:
    """Which ``nprobe`` clusters are nearest to each query, ties to the smaller number."""
    order = np.argsort(-held.scores(queries), axis=1, kind="stable")[:, :nprobe]
    chosen = np.zeros((len(queries), len(held.cids)), bool)
    np.put_along_axis(chosen, order, True, axis=1)
    return chosen


def probe_clusters(index: ClusteredIndex, queries: DataFrame, nprobe: int = NPROBE) -> DataFrame:
    """(q_id, qv, cid) for the ``nprobe`` nearest clusters of each query."""
    held = _held(index.centroids, index.metric)
    return _probed(queries, held, lambda q, _: _nearest(held, q, nprobe))


def _search(index: ClusteredIndex, probes: DataFrame, k: int, id_col: str, vector_col: str) -> DataFrame:
    """Top-k over probed clusters (q_id, qv, cid); files of other clusters are not read."""
    # Every cluster number passes the filter; Spark prunes partitions by another table
    # only if that table is filtered.
    wanted = F.broadcast(probes.where(F.col("cid") >= 0).select("cid").distinct())
    reached = index.collection.join(wanted, "cid", "left_semi")
    return top_k(
        reached, probes, k=k, metric=index.metric, id_col=id_col, vector_col=vector_col, match_on="cid"
    )


def probed_top_k(
    index: ClusteredIndex,
    queries: DataFrame,
    k: int = TOP_K,
    nprobe: int = NPROBE,
    id_col: str = "id",
    vector_col: str = "embedding",
) -> DataFrame:
    """Top-k over the ``nprobe`` nearest clusters alone, which may miss some: see ``recall``.

    The probes, ``nprobe`` to a query, are written out, since they serve twice.
    """
    probes = materialize(probe_clusters(index, queries, nprobe), "probes")
    return _search(index, probes, k, id_col, vector_col)


def search_index(
    index: ClusteredIndex,
    queries: DataFrame,
    k: int = TOP_K,
    nprobe: int = NPROBE,
    id_col: str = "id",
    vector_col: str = "embedding",
) -> DataFrame:
    """The same top-k as the exact search. The ``nprobe`` nearest clusters of a query are opened
    first; its k-th score then shuts out, by the triangle inequality, every cluster whose radius
    does not reach so near, and only the others are opened as well (``opened_share`` tells how many)."""
    first, rest = _opened(index, queries, k, nprobe, id_col, vector_col)
    more = _search(index, rest, k, id_col, vector_col)
    columns = ["q_id", "id", "score"]
    return rank_hits(first.select(columns).unionByName(more.select(columns)), k, METRICS[index.metric][1])


def _opened(index, queries: DataFrame, k: int, nprobe: int, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """Hits of the nearest clusters, and (q_id, qv, cid) of the others that may have better ones."""
    held = _held(index.centroids, index.metric)
    larger = METRICS[index.metric][1]
    slack = 10.0**-TIE_DECIMALS
    hits = materialize(probed_top_k(index, queries, k, nprobe, id_col, vector_col), "first-hits")
    kth = hits.where(F.col("rank") == k).select("q_id", F.col("score").alias("kth"))
    asked = queries.select("q_id", "qv").join(kth, "q_id", "left").withColumn("kth", F.coalesce("kth", F.lit(float("nan"))))

    def reach(vectors: np.ndarray, kths: np.ndarray) -> np.ndarray:
        bounds = held.bounds(vectors)
        # Rounding aside, only what is better than the k-th, or as good, can matter.
        better = bounds >= kths[:, None] - 2 * slack if larger else bounds <= kths[:, None] + 2 * slack
        return (better | np.isnan(kths)[:, None]) & ~_nearest(held, vectors, nprobe)

    return hits, materialize(_probed(asked, held, reach), "more-probes")


def opened_share(
    index: ClusteredIndex, queries: DataFrame, k: int = TOP_K, nprobe: int = NPROBE, id_col: str = "id", vector_col: str = "embedding"
) -> DataFrame:
    """(q_id, clusters, share): how many clusters ``search_index`` opens for a query, and the share
    of all vectors in them."""
    _, rest = _opened(index, queries, k, nprobe, id_col, vector_col)
    every = probe_clusters(index, queries, nprobe).select("q_id", "cid").unionByName(rest.select("q_id", "cid"))
    total = index.centroids.agg(F.sum("n")).first()[0] or 1
    sized = every.join(F.broadcast(index.centroids.select("cid", "n")), "cid")
    return sized.groupBy("q_id").agg(F.count("*").alias("clusters"), (F.sum("n") / total).alias("share"))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact hits that were found, per query."""
    hit = found.select("q_id", "id", F.lit(1).alias("hit"))
    return (
        exact.join(hit, ["q_id", "id"], "left")
        .groupBy("q_id")
        .agg((F.count("hit") / F.count("*")).alias("recall"))
    )
