"""Searches over vectors against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.llm import ann_forest, embedding_dedup

SCHEMA = "vec_id long, embedding array<float>, score string, component_id string"


def table(spark, n=600, copies=True):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((n, 24)).astype(np.float32)
    for i in range(0, n, 3):  # near copies of the first rows
        x[i] = x[i % 30] + rng.standard_normal(24).astype(np.float32) * np.float32(0.12)
    x[50:55] = x[49]
    x[60] *= 3
    rows = [(i, v.tolist(), "a", "b") for i, v in enumerate(x)]
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * 24, [nan] * 24, [inf] + [1.0] * 23, [None] + [1.0] * 23]
    odd = [v for v in odd if v is None or len(v) == 24 or copies]
    rows += [(n + i, v, "a", "b") for i, v in enumerate(odd)]
    return spark.createDataFrame(rows + [(None, x[0].tolist(), "a", "b")], SCHEMA).repartition(3), x.astype(np.float64)


def test_forest_recall_and_scores(spark):
    df, x = table(spark)
    out = ann_forest.nearest(df, F.col("vec_id") % 20 == 0, block=100, queries=7).collect()
    scores = x @ x.T
    found = {}
    for r in out:
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(found) == list(range(0, len(x), 20))
    recalls = []
    for q, rows in found.items():
        rows.sort()
        assert [r for r, _, _ in rows] == list(range(1, 21))
        assert all(s == pytest.approx(scores[q, v], rel=1e-12) for _, v, s in rows)
        keys = [(-s, v) for _, v, s in rows]
        assert keys == sorted(keys) and q not in [v for _, v, _ in rows]
        best = sorted((v for v in range(len(x)) if v != q), key=lambda v: (-scores[q, v], v))[:20]
        recalls.append(len(set(best) & {v for _, v, _ in rows}) / 20)
    assert np.mean(recalls) >= 0.9


def test_forest_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], "", ""), (1, [1.0, 2.0], "", ""), (2, [1.0, 2.0], "", "")], SCHEMA)
    out = ann_forest.nearest(df, F.col("vec_id") % 20 == 0).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in out] == [(0, 1, 1, 5.0), (0, 2, 2, 5.0)]
    assert ann_forest.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert ann_forest.nearest(df, F.lit(False)).count() == 0
    assert ann_forest.nearest(df.where("vec_id = 0"), F.lit(True)).count() == 0


@pytest.mark.parametrize("block", [40, 1024])
def test_dedup_equals_brute_force(spark, block):
    df, x = table(spark)
    out = {r.vec_id: r for r in embedding_dedup.near_duplicates(df, block=block).collect()}
    assert len(out) == df.count()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    links = near.sum(1)
    found = np.array([out[i].n_links for i in range(len(x))])
    assert (found <= links).all() and found.sum() >= 0.99 * links.sum() > 1000
    component = list(range(len(x)))
    for i in range(len(x)):
        seen, front = {i}, [i]
        while front:
            for j in np.flatnonzero(near[front.pop()]):
                if j not in seen:
                    seen.add(int(j))
                    front.append(int(j))
        component[i] = min(seen)
    same = [out[i].component_id == component[i] for i in range(len(x))]
    assert np.mean(same) > 0.99
    for i in range(len(x), df.count() - 1):
        assert (out[i].n_links, out[i].component_id, out[i].kept) == (0, i, True)
    assert (out[None].n_links, out[None].component_id, out[None].kept) == (0, None, False)
    assert all(r.kept == (r.vec_id == r.component_id) for i, r in out.items() if i is not None)


def test_dedup_empty(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_calibration_holds():
    rng = np.random.default_rng(0)
    n = embedding_dedup.calibrated_directions()
    a = rng.standard_normal((400, 32))
    b = rng.standard_normal((400, 32))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    b = 0.9 * a + np.sqrt(1 - 0.81) * b
    lines = rng.standard_normal((n, 32))
    x, y = a @ lines.T, b @ lines.T
    hit = (np.abs(x) >= 2.8) & (np.abs(y) >= 2.8) & (np.abs(x - y) <= 1.0)
    assert (hit.sum(1) >= embedding_dedup.COUNT).mean() >= 0.985


def test_vectors_of_another_width_take_no_part(spark):
    df, x = table(spark, n=120)
    odd = spark.createDataFrame([(900 + i, [1.0] * (3 + i), "a", "b") for i in range(20)], SCHEMA)
    mixed = df.unionByName(odd)
    alone = ann_forest.nearest(df, F.col("vec_id") % 20 == 0).collect()
    assert sorted(map(tuple, ann_forest.nearest(mixed, F.col("vec_id") % 20 == 0).collect())) == sorted(map(tuple, alone))
    rows = {r.vec_id: r for r in embedding_dedup.near_duplicates(mixed).where("vec_id >= 900").collect()}
    assert len(rows) == 20 and all((r.n_links, r.component_id, r.kept) == (0, i, True) for i, r in rows.items())
