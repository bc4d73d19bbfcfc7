"""Exact top-k search over vectors.

Both sides are packed into blocks, a few thousand rows to one row of bytes, and
blocks are joined on a cell key. A task scores one collection block against one
query block and emits only the block's k best rows per query, so the pairs
themselves never become rows. Spark ranks the survivors with a window, which it
plans as a group limit before and after the shuffle.

The cell is constant for a plain search, the filter value for a search within
equal values, and the cluster for a probed search. A hot cell only means more
blocks. Query blocks are broadcast when their measured size allows it; past that
bound both sides are shuffled on (cell, salt).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.workspace import small_batches

COLLECTION_BLOCK = 4096
QUERY_BLOCK = 256
BROADCAST_BYTES = 64 * 1024 * 1024
# A hit is two ids, a rank and a score; a generous bound on one row.
HIT_BYTES = 256
TOP_K = 5
# Scores equal to this many decimals count as ties, which the id breaks.
TIE_DECIMALS = 9


def _cosine(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    qn = np.linalg.norm(q, axis=1, keepdims=True)
    cn = np.linalg.norm(c, axis=1)
    denom = qn * cn
    return np.divide(q @ c.T, denom, out=np.zeros(denom.shape), where=denom > 0)


def _inner_product(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    return q @ c.T


def _l2(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    squares = (q * q).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2.0 * (q @ c.T)
    return np.sqrt(np.maximum(squares, 0.0))


# name -> (score of every pair, whether a larger score is better)
METRICS: dict[str, tuple[Callable, bool]] = {
    "cosine": (_cosine, True),
    "ip": (_inner_product, True),
    "l2": (_l2, False),
}


def _vector_bytes(column: pa.Array) -> bytes:
    return np.asarray(column.flatten()).tobytes()


def _vectors(data: bytes, n: int, number: str) -> np.ndarray:
    return np.frombuffer(data, dtype=number).reshape(n, -1).astype(np.float64)


def _numpy_type(vectors: T.DataType) -> str:
    return "f4" if isinstance(vectors.elementType, T.FloatType) else "f8"


def _pack(df: DataFrame, prefix: str, rows_per_block: int) -> DataFrame:
    """(cell, id, vector) rows to one row per block of equal cell.

    Rows without a vector are left out here: as a filter before, a vector that is
    still to be computed would be computed twice.
    """
    schema = T.StructType(
        [
            T.StructField("cell", df.schema["cell"].dataType),
            T.StructField(f"{prefix}_ids", T.ArrayType(df.schema["id"].dataType)),
            T.StructField(f"{prefix}_data", T.BinaryType()),
        ]
    )

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.and_(pc.is_valid(batch.column("vector")), pc.is_valid(batch.column("cell"))))
            if not batch.num_rows:
                continue
            batch = batch.sort_by("cell")
            cells = batch.column("cell").to_numpy(zero_copy_only=False)
            firsts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
            for first, last in zip(firsts, [*firsts[1:], len(cells)]):
                for at in range(first, last, rows_per_block):
                    part = batch.slice(at, min(rows_per_block, last - at))
                    offsets = pa.array([0, part.num_rows], pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("cell").slice(0, 1),
                            pa.ListArray.from_arrays(offsets, part.column("id")),
                            pa.array([_vector_bytes(part.column("vector"))]),
                        ],
                        names=schema.names,
                    )

    return df.select("cell", "id", "vector").mapInArrow(blocks, schema)


def _best(scores: np.ndarray, ids: np.ndarray, k: int, larger: bool) -> np.ndarray:
    """Positions of the k best scores, ties by id."""
    keys = -scores if larger else scores
    if len(keys) > k:
        bound = np.partition(keys, k - 1)[k - 1]
        at = np.flatnonzero(keys <= bound)
    else:
        at = np.arange(len(keys))
    return at[np.lexsort((ids[at], keys[at]))][:k]


def _score_blocks(
    joined: DataFrame, metric: str, k: int, tie_decimals: int, q_number: str, c_number: str
) -> DataFrame:
    score, larger = METRICS[metric]
    schema = T.StructType(
        [
            T.StructField("q_id", joined.schema["q_ids"].dataType.elementType),
            T.StructField("id", joined.schema["c_ids"].dataType.elementType),
            T.StructField("score", T.DoubleType()),
        ]
    )

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                q_ids = one.column("q_ids").flatten()
                c_ids = one.column("c_ids").flatten()
                order = c_ids.to_numpy(zero_copy_only=False)
                order = order.astype(str) if order.dtype == object else order
                scores = np.round(
                    score(
                        _vectors(one.column("q_data")[0].as_py(), len(q_ids), q_number),
                        _vectors(one.column("c_data")[0].as_py(), len(c_ids), c_number),
                    ),
                    tie_decimals,
                )
                picks = [_best(scores[i], order, k, larger) for i in range(len(q_ids))]
                q_at = np.repeat(np.arange(len(q_ids)), [len(p) for p in picks])
                c_at = np.concatenate(picks)
                yield pa.RecordBatch.from_arrays(
                    [q_ids.take(pa.array(q_at)), c_ids.take(pa.array(c_at)), pa.array(scores[q_at, c_at])],
                    names=schema.names,
                )

    return joined.select("q_ids", "q_data", "c_ids", "c_data").mapInArrow(rank, schema)


def _query_size(queries: DataFrame) -> tuple[int, int]:
    """Rows and bytes of a query table."""
    row = queries.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dim")).first()
    return row["n"], row["n"] * int(row["dim"] or 0) * 8


def top_k(
    collection: DataFrame,
    queries: DataFrame,
    k: int = TOP_K,
    metric: str = "cosine",
    id_col: str = "id",
    vector_col: str = "embedding",
    query_id_col: str = "q_id",
    query_vector_col: str = "qv",
    match_on: str | None = None,
    output_fields: list[str] | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
    salts: int | None = None,
    tie_decimals: int = TIE_DECIMALS,
) -> DataFrame:
    """The ``k`` best rows of ``collection`` for each query, as (q_id, rank, id, score).

    ``match_on`` names a column of both sides whose values must be equal; a
    filter with one value for all queries is a plain ``where`` on the collection.
    ``output_fields`` are joined back for the hits alone. Scores are compared
    after rounding to ``tie_decimals``; equal ones are ranked by id.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    spark = collection.sparkSession
    small_batches(spark)
    cell = F.col(match_on) if match_on else F.lit(0)
    c_side = collection.select(
        cell.alias("cell"), F.col(id_col).alias("id"), F.col(vector_col).alias("vector")
    )
    q_side = queries.select(
        cell.alias("cell"), F.col(query_id_col).alias("id"), F.col(query_vector_col).alias("vector")
    )

    n_queries, query_bytes = _query_size(q_side)
    few_queries = query_bytes <= broadcast_bytes
    if few_queries:
        # Full blocks, however many partitions the queries come in.
        parts = math.ceil(max(n_queries, 1) / QUERY_BLOCK)
        q_side = q_side.repartition(parts, "cell") if match_on else q_side.repartition(parts)
    c_blocks = _pack(c_side, "c", COLLECTION_BLOCK)
    q_blocks = _pack(q_side, "q", QUERY_BLOCK)
    if few_queries:
        joined = c_blocks.join(F.broadcast(q_blocks), "cell")
    else:
        salts = salts or int(spark.conf.get("spark.sql.shuffle.partitions"))
        joined = c_blocks.withColumn("salt", F.pmod(F.xxhash64("c_data"), F.lit(salts))).join(
            q_blocks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))),
            ["cell", "salt"],
        )
    numbers = [_numpy_type(side.schema["vector"].dataType) for side in (q_side, c_side)]
    scored = _score_blocks(joined, metric, k, tie_decimals, *numbers)
    best = rank_hits(scored, k, METRICS[metric][1])
    if not output_fields:
        return best
    entities = collection.select(F.col(id_col).alias("id"), *output_fields)
    if n_queries * k * HIT_BYTES <= broadcast_bytes:
        best = F.broadcast(best)
    return best.join(entities, "id").select("q_id", "rank", "id", "score", *output_fields)


def rank_hits(hits: DataFrame, k: int, larger_is_better: bool = True) -> DataFrame:
    """The k best hits of each query, ranked from 1."""
    score = F.col("score").desc() if larger_is_better else F.col("score").asc()
    best_first = Window.partitionBy("q_id").orderBy(score, F.col("id"))
    return (
        hits.withColumn("rank", F.row_number().over(best_first))
        .where(F.col("rank") <= k)
        .select("q_id", F.col("rank").cast("bigint").alias("rank"), "id", "score")
    )
