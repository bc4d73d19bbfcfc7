"""Embedding near-duplicates by collision-counting projections.

Each vector is projected on many random directions. Both far ends of each sorted
projection are kept, where vectors are few; there, two vectors collide if the value of
one lies in a window centred at that of the other. Collisions are counted for each pair;
pairs that reach the calibrated count are verified by their cosine.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.llm.graph import components
from codeloom.llm.vectors import dimension, matrix, takes_part
from codeloom.workspace import materialize

MIN_COSINE = 0.9
#: Where the far ends begin, the reach of a window (both in standard deviations of a projection).
TAIL = 2.8
REACH = 1.0
#: Collisions that a pair needs, and the share of pairs at the least cosine that reach it.
COUNT = 3
RECALL = 0.998
#: Vectors of a list that one task compares with each other.
BLOCK = 1024
SEED = 8


def collision_rate(cosine: float, tail: float = TAIL, reach: float = REACH) -> float:
    """How likely two unit vectors of this cosine collide at one end of one projection: both
    values, normal with that correlation, are beyond ``tail`` and at most ``reach`` apart."""
    spread = math.sqrt(max(1e-12, 1 - cosine**2))
    phi = lambda x: 0.5 * (1 + math.erf(x / math.sqrt(2)))
    step, total = 0.002, 0.0
    for i in range(int(6 / step)):
        z = tail + (i + 0.5) * step
        inside = phi((z + reach - cosine * z) / spread) - phi((max(tail, z - reach) - cosine * z) / spread)
        total += step * math.exp(-z * z / 2) / math.sqrt(2 * math.pi) * max(0.0, inside)
    return total


def calibrated_directions(
    cosine: float = MIN_COSINE, count: int = COUNT, recall: float = RECALL, tail: float = TAIL, reach: float = REACH
) -> int:
    """Directions after which a pair of this cosine has ``count`` collisions with chance ``recall``."""
    rate = 2 * collision_rate(cosine, tail, reach)

    def reached(n: int) -> float:
        mean = n * rate
        return 1 - sum(math.exp(-mean) * mean**k / math.factorial(k) for k in range(count))

    n = 64
    while reached(n) < recall:
        n += 64
    return n


def _projector(size: int, directions: int, tail: float, seed: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = np.random.default_rng(seed).standard_normal((directions, size)).astype(np.float32)
        for batch in batches:
            x = matrix(batch.column(2))
            x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
            for low in range(0, len(x), 512):
                z = x[low : low + 512] @ lines.T
                at, line = np.nonzero(np.abs(z) >= tail)
                value = z[at, line]
                cuts = np.searchsorted(at, np.arange(len(z) + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array((2 * line + (value < 0)).astype(np.int32)))
                values = pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.abs(value)))
                part = batch.slice(low, 512)
                yield pa.RecordBatch.from_arrays([*part.columns, lists, values], names=["id", "copies", "vector", "lists", "at"])

    return run


def collisions(lists: list[np.ndarray], values: list[np.ndarray], reach: float) -> tuple[np.ndarray, ...]:
    """Colliding pairs (i < j) with their number of collisions and the first list of these."""
    sizes = np.array([len(x) for x in lists])
    owner = np.repeat(np.arange(len(lists)), sizes)
    line, value = np.concatenate(lists), np.concatenate(values)
    order = np.lexsort((value, line))
    owner, line, value = owner[order], line[order], value[order]
    pairs, lines = [], []
    left = np.arange(len(line))
    step = 1
    while len(left):
        left = left[left + step < len(line)]
        left = left[(line[left + step] == line[left]) & (value[left + step] - value[left] <= reach)]
        a, b = owner[left], owner[left + step]
        pairs.append(np.minimum(a, b) * len(lists) + np.maximum(a, b))
        lines.append(line[left])
        step += 1
    pairs, lines = np.concatenate(pairs), np.concatenate(lines)
    order = np.lexsort((lines, pairs))
    pairs, lines = pairs[order], lines[order]
    first = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])) if len(pairs) else np.empty(0, int)
    counts = np.diff(np.append(first, len(pairs)))
    return pairs[first] // len(lists), pairs[first] % len(lists), counts, lines[first]


def forest(i: np.ndarray, j: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Of the links i - j, as many as hold together what they link."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


FOUND = "a long, b long, n long"


def _verifier(min_cosine: float, count: int, reach: float) -> Callable[[tuple, pa.Table], pa.Table]:
    """Within one list (or two blocks of it): verified links, each in the first list of its pair."""

    def verify(key: tuple, rows: pa.Table) -> pa.Table:
        line, x_block, y_block = (k.as_py() for k in key)
        empty = pa.table({"a": [], "b": [], "n": []}, schema=schema)
        if len(rows) < 2:
            return empty
        ids, copies, block = (rows[c].to_numpy() for c in ("id", "copies", "block"))
        unpack = lambda c: np.split(
            rows[c].combine_chunks().flatten().to_numpy(), rows[c].combine_chunks().offsets.to_numpy()[1:-1] - rows[c].combine_chunks().offsets.to_numpy()[0]
        )
        i, j, counts, first = collisions(unpack("lists"), unpack("at"), reach)
        mine = (counts >= count) & (first == line)
        if x_block != y_block:
            mine &= block[i] != block[j]
        i, j = i[mine], j[mine]
        vectors = matrix(rows["vector"])
        vectors = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        near = np.empty(len(i), bool)
        for low in range(0, len(i), 1 << 16):
            some = slice(low, low + (1 << 16))
            near[some] = np.einsum("ij,ij->i", vectors[i[some]], vectors[j[some]]) >= min_cosine
        i, j = i[near], j[near]
        if not len(i):
            return empty
        links = np.zeros(len(ids), np.int64)
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        some = np.flatnonzero(links)
        edges = np.array(forest(i, j, len(ids)))
        return pa.table({
            "a": np.concatenate((ids[some], ids[edges[:, 0]])),
            "b": pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(ids[edges[:, 1]])]),
            "n": np.concatenate((links[some], np.zeros(len(edges), np.int64))),
        }, schema=schema)

    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])
    return verify


def near_duplicates(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    min_cosine: float = MIN_COSINE,
    tail: float = TAIL,
    reach: float = REACH,
    count: int = COUNT,
    recall: float = RECALL,
    block: int = BLOCK,
    seed: int = SEED,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row. Vectors link if their cosine is at
    least ``min_cosine``; of pairs just at it, ``recall`` are found, of closer ones more.

    ``n_links`` counts the other rows linked directly, ``component_id`` is the smallest
    vec_id that links reach, ``kept`` marks the rows that are it. Equal vectors are one with
    a number of copies. Null, empty and zero vectors and those with null or non-finite
    components link with nothing, nor do vectors of another width than most have, nor rows
    without an id (whose component is null). Rows of one id are told apart by their vectors only.

    A list is one end of one projection, with a fraction of all vectors. A list longer than
    ``block`` is compared by pairs of blocks, so a group of near copies of any size is spread
    over tasks; tasks return numbers of links and links enough to hold groups together, never all
    pairs. A pair counts in the first list it collides in, so no pair counts twice.
    """
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").alias("vector"))
    sound_row = takes_part(F.col("vector")) & F.col("vec_id").isNotNull()
    width = dimension(rows.where(sound_row), "vector")
    sound_row &= F.size("vector") == width
    sound = rows.where(sound_row)
    classes = materialize(
        sound.groupBy("vector").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")), "vectors"
    )
    directions = calibrated_directions(min_cosine, count, recall, tail, reach)
    projected = classes.select("id", "copies", "vector").mapInArrow(
        _projector(width, directions, tail, seed),
        T.StructType([*classes.select("id", "copies", "vector").schema, *T.StructType.fromDDL("lists array<int>, at array<float>")]),
    )
    projected = materialize(projected, "projected")
    members = projected.select("*", F.explode("lists").alias("line"))
    # A row for each list, of which there are two a direction: a bounded number.
    sizes = members.groupBy("line").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = members.join(F.broadcast(sizes), "line").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    placed = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "line", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"),
        "id", "copies", "vector", "lists", "at", "block",
    )
    found = materialize(placed.groupBy("line", "x", "y").applyInArrow(_verifier(min_cosine, count, reach), FOUND), "links")
    links = found.where("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    roots = components(found.where("b IS NOT NULL").select("a", "b"))
    known = (
        classes.join(links, "id", "left")
        .join(roots.select(F.col("node").alias("id"), "root"), "id", "left")
        .select("vector", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    )
    linked = sound.join(known, "vector").select("vec_id", "n_links", "component_id")
    alone = rows.where(~sound_row).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
