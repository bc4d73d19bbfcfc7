import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.functions import vectors
from codeloom.operators import clusters, context, lookup, terms
from codeloom.operators.search import top_k

RNG = np.random.default_rng(42)
VECTORS = [list(map(float, v)) for v in RNG.random((100, 16)).astype(np.float32)]
VECTORS[50] = VECTORS[10]  # an exact tie


@pytest.fixture(scope="module")
def collection(spark):
    rows = [(i, v, i % 3) for i, v in enumerate(VECTORS)] + [(100, [0.0] * 16, 0), (101, None, 1)]
    return spark.createDataFrame(rows, "id long, embedding array<float>, grp int").cache()


@pytest.fixture(scope="module")
def queries(spark):
    rows = [(i, v, i % 3) for i, v in enumerate(VECTORS[:20])]
    return spark.createDataFrame(rows, "q_id long, qv array<float>, grp int").cache()


def brute(metric, q, k, ids):
    def score(v):
        a, b = np.array(q, dtype=float), np.array(v, dtype=float)
        if metric == "l2":
            return -np.linalg.norm(a - b)
        if metric == "ip":
            return a @ b
        norm = np.linalg.norm(a) * np.linalg.norm(b)
        return a @ b / norm if norm else 0.0

    every = {**dict(enumerate(VECTORS)), 100: [0.0] * 16}
    scored = sorted((-round(float(score(every[i])), 6), i) for i in ids)
    return [i for _, i in scored[:k]]


def hits_of(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["q_id"], r["rank"])):
        out.setdefault(r["q_id"], []).append(r["id"])
    return out


@pytest.mark.parametrize("metric", ["cosine", "l2", "ip"])
@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
def test_top_k(collection, queries, metric, broadcast_bytes):
    found = hits_of(top_k(collection, queries, 5, metric, broadcast_bytes=broadcast_bytes, tie_decimals=6))
    for q in range(20):
        assert found[q] == brute(metric, VECTORS[q], 5, range(101))


def test_stored_vector_finds_itself(collection, queries):
    found = hits_of(top_k(collection, queries, 1))
    assert found == {q: [q] for q in range(20)}


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
def test_filter_by_equal_column(collection, queries, broadcast_bytes):
    found = hits_of(top_k(collection, queries, 4, match_on="grp", broadcast_bytes=broadcast_bytes, tie_decimals=6))
    for q in range(20):
        ids = [i for i in range(100) if i % 3 == q % 3] + ([100] if q % 3 == 0 else [])
        assert found[q] == brute("cosine", VECTORS[q], 4, ids)


def test_k_larger_than_collection(collection, queries):
    found = top_k(collection.where("id < 3"), queries, 10).groupBy("q_id").count().collect()
    assert {r["count"] for r in found} == {3}
    with pytest.raises(ValueError):
        top_k(collection, queries, 0)


def test_output_fields(collection, queries):
    rows = top_k(collection, queries, 2, output_fields=["grp"]).collect()
    assert all(r["grp"] == r["id"] % 3 for r in rows if r["id"] < 100) and len(rows) == 40


def test_string_ids_rank_like_spark(spark, collection, queries):
    named = collection.withColumn("id", F.concat(F.lit("é"), F.col("id").cast("string")))
    numbers = {f"é{i}": i for i in range(102)}
    found = hits_of(top_k(named, queries, 5))
    plain = hits_of(top_k(collection, queries, 5))
    assert {q: sorted(numbers[i] for i in v) for q, v in found.items()} == {
        q: sorted(v) for q, v in plain.items()
    }


def test_probing_every_cluster_is_exact(collection, queries):
    full = collection.where("embedding IS NOT NULL")
    index = clusters.build_index(full, nlist=8)
    assert index.collection.count() == 101 and index.centroids.count() == 8
    exact = top_k(full, queries, 5)
    everything = clusters.probed_top_k(index, queries, 5, nprobe=8)
    assert hits_of(everything) == hits_of(exact)
    some = clusters.probed_top_k(index, queries, 5, nprobe=2)
    recalls = [r["recall"] for r in clusters.recall(some, exact).collect()]
    assert len(recalls) == 20 and 0 < sum(recalls) / 20 <= 1


def clouds(rng, n=900, dim=12, groups=15):
    """Vectors around a few centres, of any length."""
    centres = rng.normal(size=(groups, dim)) * 4
    return centres[np.arange(n) % groups] + rng.normal(size=(n, dim)) * 0.25


@pytest.mark.parametrize("metric", ["cosine", "l2", "ip"])
def test_guaranteed_search_is_exact_and_opens_few(spark, metric):
    rng = np.random.default_rng(5)
    vectors = clouds(rng)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(2000, [0.0] * 12), (2001, None), (2002, [float(x) for x in vectors[7]])]
    table = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(5)
    asked = [(i, [float(x) for x in vectors[i] + 0.1]) for i in range(30)] + [(90, [0.0] * 12)]
    queries = spark.createDataFrame(asked, "q_id long, qv array<double>")
    index = clusters.build_index(table, nlist=15, metric=metric)
    assert index.collection.count() == 902
    exact = hits_of(top_k(table.where("embedding IS NOT NULL"), queries, 5, metric=metric))
    for nprobe in (1, 3):
        assert hits_of(clusters.search_index(index, queries, 5, nprobe=nprobe)) == exact
    shares = {r["q_id"]: r["share"] for r in clusters.opened_share(index, queries, 5, nprobe=1).collect()}
    assert len(shares) == 31 and 0 < min(shares.values()) and max(shares.values()) <= 1.0000001
    if metric != "ip":
        assert np.median([shares[i] for i in range(30)]) < 0.35
    # More than there are, and an index of nothing.
    assert len(hits_of(clusters.search_index(index, queries.where("q_id = 3"), 1000, nprobe=1))[3]) == 902
    empty = clusters.build_index(table.where("id < 0"), nlist=4, metric=metric)
    assert clusters.search_index(empty, queries, 5).count() == 0


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_k_means_is_a_fixed_point(spark, metric):
    vectors = clouds(np.random.default_rng(6), n=300, groups=6)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    table = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(4)
    found = sorted(clusters.fit_centroids(table, 6, metric, max_iter=50).collect())
    now = np.array([c for _, c in found])
    points = vectors / np.linalg.norm(vectors, axis=1, keepdims=True) if metric == "cosine" else vectors
    near = (points @ now.T).argmax(1) if metric == "cosine" else ((points[:, None] - now) ** 2).sum(2).argmin(1)
    for c in range(6):
        mean = points[near == c].mean(0)
        assert np.allclose(mean / np.linalg.norm(mean) if metric == "cosine" else mean, now[c], atol=1e-7)
    again = sorted(clusters.fit_centroids(table.repartition(7), 6, metric, max_iter=50).collect())
    assert np.allclose([c for _, c in again], now, atol=1e-9)


def test_assignment_shuffles_no_vector(spark, collection):
    held = clusters.Centroids(np.arange(3), np.eye(3, 8), "cosine")
    plan = clusters.assign_clusters(collection, held)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan


def test_too_many_centroids_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(clusters, "MAX_CENTROID_BYTES", 100)
    table = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "id long, embedding array<double>")
    with pytest.raises(ValueError, match="centroids of"):
        clusters.build_index(table, nlist=20)


def test_unprobed_clusters_are_not_read(collection, queries):
    index = clusters.build_index(collection.where("embedding IS NOT NULL"), nlist=8)
    one = queries.where("q_id = 0")
    plan = clusters.probed_top_k(index, one, 5, nprobe=1)._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan.lower()


def test_terms(spark):
    rows = [("a", ["x", "y", "x"]), ("b", ["y", "z"]), ("c", ["x", "y", "z"]), ("d", ["q"]), ("e", []), ("f", None), ("g", [None])]
    c = spark.createDataFrame(rows, "id string, terms array<string>")
    q = spark.createDataFrame([(1, ["x", "y", "y"]), (2, ["none"]), (3, ["z"]), (4, []), (5, None)], "q_id long, q_terms array<string>")
    found = sorted((r["q_id"], r["rank"], r["id"], r["score"]) for r in terms.top_k_terms(c, q, 2).collect())
    assert found == [(1, 1, "a", 2), (1, 2, "c", 2), (3, 1, "b", 1), (3, 2, "c", 1)]


def test_terms_against_all_pairs_with_work_by_postings(spark, monkeypatch):
    """Every row has the same two words; candidates come from the rare ones alone."""
    monkeypatch.setattr(terms, "BLOCK", 100)
    rng = np.random.default_rng(8)
    n = 3000
    sets = [["get", "set", *{f"w{int(x)}" for x in rng.zipf(1.3, 4) if x < 2000}] for _ in range(n)]
    asked = [["get", *{f"w{int(x)}" for x in rng.zipf(1.3, 5) if x < 2000}] for _ in range(25)] + [["get"], ["set", "get", "nowhere"]]
    c = spark.createDataFrame(list(enumerate(sets)), "id long, terms array<string>").repartition(6)
    q = spark.createDataFrame(list(enumerate(asked)), "q_id long, q_terms array<string>")
    index = terms.build_terms(c)
    for k in (1, 5):
        wanted = {}
        for i, a in enumerate(asked):
            scores = sorted(((-len(set(a) & set(s)), j) for j, s in enumerate(sets)))
            wanted[i] = [(j, -x) for x, j in scores[:k] if x < 0]
        found = {}
        for r in terms.search_terms(index, q, k).orderBy("q_id", "rank").collect():
            found.setdefault(r["q_id"], []).append((r["id"], r["score"]))
        assert found == {i: w for i, w in wanted.items() if w}
        counts = {r["q_id"]: r["count"] for r in terms.term_candidates(index, q, k).groupBy("q_id").count().collect()}
        size = {t: sum(t in s for s in sets) for a in asked for t in a}
        # A question with a rare word beside common ones never follows the words that all rows have.
        rare = [i for i, a in enumerate(asked[:25]) if any(k < size[t] < 100 for t in a) and -sorted((-len(set(a) & set(s)) for s in sets))[k - 1] > 1]
        assert rare and all(counts[i] < n for i in rare)


def test_name_terms(spark):
    df = spark.createDataFrame([("getUserById_v2",), ("HTTPServer",)], "n string")
    found = [r[0] for r in df.select(lookup.name_terms(F.col("n"))).collect()]
    assert found == [["get", "user", "by", "id", "v2"], ["httpserver"]]


def test_embedding(spark):
    df = spark.createDataFrame([(0, "a b a"), (1, ""), (2, None), (3, "B A a")], "i int, t string")
    rows = {r["i"]: r["v"] for r in df.select("i", vectors.embed_text(F.col("t"), 64).alias("v")).collect()}
    assert all(len(v) == 64 for v in rows.values())
    assert rows[0] == rows[3] and sum(x * x for x in rows[0]) == pytest.approx(1, abs=1e-6)
    assert not any(rows[1]) and not any(rows[2])


def test_l2_normalize(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    found = [r[0] for r in df.select(vectors.l2_normalize(F.col("v"))).collect()]
    assert found == [[0.6, 0.8], [0.0, 0.0]]


def test_contexts(spark):
    rows = [(1, "smart", 2, "s2", "c2"), (1, "smart", 1, "s1", "c1"), (1, "naive", 1, "n1", "n1")]
    hits = spark.createDataFrame(rows, "q_id long, mode string, rank long, summary string, chunk_code string")
    wide = context.side_by_side(context.assemble_context(hits, ["q_id", "mode"])).first()
    assert wide["smart"] == "s1\n\nc1\ns2\n\nc2" and wide["naive"] == "n1"


def test_choice(spark):
    pairs = spark.createDataFrame(
        [("a b", "a b", "a"), ("a b", "b", "a"), ("a b", "", "a")], "question string, smart string, naive string"
    )
    assert [r["choice"] for r in context.choose_context(pairs).collect()] == ["smart", "smart", "naive"]
    replies = spark.createDataFrame([("Smart.",), ("'naive'",), ("smart or naive",), ("",)], "r string")
    found = [r[0] for r in replies.select(context.clean_choice(F.col("r"))).collect()]
    assert found == ["smart", "naive", None, None]


def test_probes_are_made_of_some_queries_at_a_time(spark):
    queries = spark.range(1000, numPartitions=1).select(F.col("id").alias("q_id"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("qv"))
    held = clusters.Centroids(np.arange(3), np.ones((3, 2)), "cosine")

    def every(vectors, _):
        assert len(vectors) <= 256
        return np.ones((len(vectors), 3), bool)

    found = clusters._probed(queries, held, every)
    assert found.count() == found.distinct().count() == 3000
