"""Nearest neighbours by inner product: a forest of random-projection trees, searched
through one priority queue, and the candidates of the leaves ranked exactly."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.vectors import dimension, matrix, takes_part
from codeloom.workspace import materialize

K = 20
TREES = 12
DEPTH = 7
#: Directions drawn for a split, of which the one that spreads its points most is taken.
DRAWS = 8
#: Rows that the forest is fitted on, at most, and queries among them that the budget is set by.
SAMPLE = 16_384
TRIALS = 200
#: Recall that the budget must reach on the sample.
RECALL = 0.95
#: Leaves that are ranked together, and rows and queries of a task.
LEAVES = 16
BLOCK = 8192
QUERIES = 1024
SEED = 7


@dataclass
class Forest:
    """Planes (tree, node, component) and thresholds (tree, node); node i has 2i+1 and 2i+2 below."""

    planes: np.ndarray
    thresholds: np.ndarray
    longest: float
    depth: int

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Rows with one component more that makes all equally long, so that the order of
        inner products is that of distances."""
        rest = np.maximum(self.longest**2 - (x * x).sum(1), 0.0)
        return np.column_stack([x, np.sqrt(rest)])

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree."""
        lifted = self.lifted(x)
        out = np.empty((len(x), len(self.planes)), np.int32)
        for t, (planes, thresholds) in enumerate(zip(self.planes, self.thresholds, strict=True)):
            node = np.zeros(len(x), np.int64)
            side = lifted @ planes.T > thresholds
            for _ in range(self.depth):
                node = 2 * node + 1 + side[np.arange(len(x)), node]
            out[:, t] = node - len(thresholds)
        return out

    def margins(self, queries: np.ndarray) -> np.ndarray:
        """How far each query is beyond each plane: (query, tree, node)."""
        lifted = np.column_stack([queries, np.zeros(len(queries))])
        return np.einsum("qd,tnd->qtn", lifted, self.planes) - self.thresholds

    def search(self, margins: np.ndarray, sizes: np.ndarray, budget: float) -> list[tuple[int, int]]:
        """(tree, leaf) in the order of one queue over all trees, until they hold ``budget`` rows.

        The priority of a node is the least margin on its way, so the nearest doubtful
        side of any tree is opened next.
        """
        inner = margins.shape[1]
        queue = [(-np.inf, t, 0) for t in range(len(margins))]
        found, held = [], 0.0
        planes = margins.tolist()
        while queue and held < budget:
            priority, t, node = heapq.heappop(queue)
            if node >= inner:
                found.append((t, node - inner))
                held += sizes[t, node - inner]
                continue
            margin = planes[t][node]
            heapq.heappush(queue, (max(priority, margin), t, 2 * node + 1))
            heapq.heappush(queue, (max(priority, -margin), t, 2 * node + 2))
        return found


def fit(sample: np.ndarray, longest: float, trees: int = TREES, depth: int = DEPTH, draws: int = DRAWS, seed: int = SEED) -> Forest:
    """Trees over a sample: each node splits its rows at the median along a random direction."""
    rng = np.random.default_rng(seed)
    inner = (1 << depth) - 1
    forest = Forest(np.zeros((trees, inner, sample.shape[1] + 1)), np.zeros((trees, inner)), longest, depth)
    lifted = forest.lifted(sample)
    for t in range(trees):
        node = np.zeros(len(sample), np.int64)
        for k in range(inner):
            rows = np.flatnonzero(node == k)
            lines = rng.standard_normal((draws, lifted.shape[1]))
            lines /= np.linalg.norm(lines, axis=1, keepdims=True)
            along = lifted[rows] @ lines.T
            best = int(along.var(0).argmax()) if len(rows) else 0
            forest.planes[t, k] = lines[best]
            forest.thresholds[t, k] = np.median(along[:, best]) if len(rows) else 0.0
            node[rows] = 2 * k + 1 + (along[:, best] > forest.thresholds[t, k])
    return forest


def calibrated_budget(forest: Forest, sample: np.ndarray, k: int = K, recall: float = RECALL, trials: int = TRIALS, seed: int = SEED) -> float:
    """The share of all leaf entries to open so that sampled queries find ``recall`` of their
    nearest rows in the sample (which lie further apart than those of the whole table)."""
    if len(sample) < 2:
        return 1.0
    tried = np.random.default_rng(seed).choice(len(sample), min(trials, len(sample)), replace=False)
    scores = sample[tried] @ sample.T
    scores[np.arange(len(tried)), tried] = -np.inf
    k = min(k, len(sample) - 1)
    nearest = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    leaf = forest.leaves(sample)
    sizes = np.stack([np.bincount(leaf[:, t], minlength=1 << forest.depth) for t in range(leaf.shape[1])])
    shares = []
    for margins, near in zip(forest.margins(sample[tried]), nearest, strict=True):
        order = forest.search(margins, sizes, np.inf)
        opened = {place: i for i, place in enumerate(order)}
        held = np.cumsum([sizes[place] for place in order])
        first = [min(opened[t, leaf[row, t]] for t in range(leaf.shape[1])) for row in near]
        shares += held[first].tolist()
    return float(np.quantile(shares, recall, method="higher")) / sizes.sum()


FOUND = "query_id long, vec_id long, score double"


def _ranker(k: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """The ``k`` best of a block of rows for each query, among leaves the query opened."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def rank(queries: pa.Table, rows: pa.Table) -> pa.Table:
        if not len(queries) or not len(rows):
            return pa.table({n: [] for n in schema.names}, schema=schema)
        rows = rows.take(pa.array(np.argsort(rows["vec_id"].to_numpy(), kind="stable")))
        q_ids, v_ids = queries["query_id"].to_numpy(), rows["vec_id"].to_numpy()
        q, v = matrix(queries["vector"]), matrix(rows["vector"])
        opened = (queries["opened"].to_numpy()[:, None] >> rows["leaf"].to_numpy()[None, :]) & 1
        out = []
        for low in range(0, len(q), 128):
            some = slice(low, low + 128)
            scores = np.where((opened[some] == 1) & (q_ids[some, None] != v_ids), q[some] @ v.T, -np.inf)
            if len(v) > k:
                # All that are as good as the k-th; the smaller ids of these come first.
                bar = np.partition(scores, len(v) - k, axis=1)[:, len(v) - k]
                at, which = np.nonzero((scores >= bar[:, None]) & np.isfinite(scores))
            else:
                at, which = np.nonzero(np.isfinite(scores))
            value = scores[at, which]
            order = np.lexsort((v_ids[which], -value, at))
            at, which, value = at[order], which[order], value[order]
            place = np.arange(len(at)) - np.searchsorted(at, at)
            out.append((q_ids[some][at[place < k]], v_ids[which[place < k]], value[place < k]))
        return pa.table({n: np.concatenate(c) for n, c in zip(schema.names, zip(*out, strict=True), strict=True)}, schema=schema)

    return rank


def nearest(
    vectors: DataFrame,
    is_query: Column,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    k: int = K,
    trees: int = TREES,
    depth: int = DEPTH,
    sample: int = SAMPLE,
    recall: float = RECALL,
    block: int = BLOCK,
    queries: int = QUERIES,
    seed: int = SEED,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``is_query`` (a condition on vec_id)
    the ``k`` rows found of largest inner product, ties to the smaller vec_id.

    The forest is fitted on at most ``sample`` rows (of the smallest hashed id) and the budget
    of a search on queries among them; every row is then in the index. Rows go to tasks by
    group of leaves, queries to the groups they opened; groups and their queries are cut
    into blocks, so a leaf with a large part of all rows is many tasks. Scores are inner
    products of the given vectors in double precision.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor
    do those of another width than most have, nor rows without an id. Rows of one id are one (the best counts); a query never finds its
    own id. No queries or no other rows: no result.
    """
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").alias("vector"))
    rows = rows.where(takes_part(F.col("vector")) & F.col("vec_id").isNotNull())
    size = dimension(rows, "vector")
    rows = rows.where(F.size("vector") == size)
    longest = rows.agg(F.max(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))).first()[0]
    chosen = rows.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(sample).collect()
    x = np.array([r["vector"] for r in chosen], np.float64).reshape(len(chosen), size)
    forest = fit(x, float(longest or 0.0) ** 0.5, trees, depth, seed=seed)
    share = calibrated_budget(forest, x, k, recall, seed=seed)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = forest.leaves(matrix(batch.column(1)))
                flat = pa.array(found.ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, trees, dtype=np.int32)), flat)
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=["vec_id", "vector", "leaves"])

    kind = dict(rows.dtypes)["vector"]
    placed = materialize(rows.mapInArrow(place, f"vec_id long, vector {kind}, leaves array<int>"), "placed")
    in_leaf = placed.select("vec_id", "vector", F.posexplode("leaves").alias("tree", "leaf"))
    # As many rows as the forest has leaves.
    sizes = np.zeros((trees, 1 << depth), np.int64)
    for r in in_leaf.groupBy("tree", "leaf").count().collect():
        sizes[r["tree"], r["leaf"]] = r["count"]
    budget = share * sizes.sum()
    per_tree = max(1, (1 << depth) // LEAVES)

    def open_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = matrix(batch.column(1))
            for low in range(0, len(asked), 64):
                groups: list[list[int]] = []
                masks: list[list[int]] = []
                for margins in forest.margins(asked[low : low + 64]):
                    opened: dict[int, int] = {}
                    for t, leaf in forest.search(margins, sizes, budget):
                        group = t * per_tree + leaf // LEAVES
                        opened[group] = opened.get(group, 0) | 1 << leaf % LEAVES
                    groups.append(list(opened))
                    masks.append(list(opened.values()))
                part = batch.slice(low, 64)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(groups, pa.list_(pa.int32())), pa.array(masks, pa.list_(pa.int32()))],
                    names=["query_id", "vector", "groups", "masks"],
                )

    asked = placed.where(is_query).select(F.col("vec_id").alias("query_id"), "vector")
    asked = asked.repartition(spread(vectors)).mapInArrow(open_leaves, f"query_id long, vector {kind}, groups array<int>, masks array<int>")
    asked = materialize(asked, "asked").select(
        "query_id", "vector", F.explode(F.arrays_zip("groups", "masks")).alias("o")
    ).select("query_id", "vector", F.col("o.groups").alias("group"), F.col("o.masks").alias("opened"))
    held = in_leaf.select(
        "vec_id", "vector", (F.col("tree") * per_tree + F.floor(F.col("leaf") / LEAVES)).cast("int").alias("group"),
        (F.col("leaf") % LEAVES).alias("leaf"),
    )
    # Blocks by group, of which there are a bounded number.
    cuts = held.groupBy("group").agg(F.ceil(F.count("*") / block).cast("int").alias("v_blocks")).join(
        asked.groupBy("group").agg(F.ceil(F.count("*") / queries).cast("int").alias("q_blocks")), "group"
    )
    cuts = F.broadcast(materialize(cuts, "cuts"))

    def dealt(df: DataFrame, key: str, own: str, other: str) -> DataFrame:
        return (
            df.join(cuts, "group")
            .withColumn(own[0], F.pmod(F.xxhash64(key), F.col(own)).cast("int"))
            .withColumn(other[0], F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        )

    left = dealt(asked, "query_id", "q_blocks", "v_blocks").select("group", "q", "v", "query_id", "vector", "opened")
    right = dealt(held, "vec_id", "v_blocks", "q_blocks").select("group", "q", "v", "vec_id", "vector", "leaf")
    by = ["group", "q", "v"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_ranker(k), FOUND)
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def spread(df: DataFrame) -> int:
    """Partitions for work that is costly beside its few rows."""
    return 4 * df.sparkSession.sparkContext.defaultParallelism
