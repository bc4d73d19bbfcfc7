"""The pipeline and the queries with SQL."""

import duckdb
import numpy as np
import pytest
from conftest import SMALL
from helpers import documents, no_documents, rows_of
from pyspark.sql import functions as F
from test_texts import Sets, cut, fingerprint

import corpus_pipeline
from codeloom.llm import mixing, queries


@pytest.mark.parametrize("name", sorted(queries.all_oracles()))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = queries.all_queries()[name](spark, SMALL)
    cursor = con.execute(queries.all_oracles()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.select(names)) == sorted(cursor.fetchall(), key=repr)


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_stages_are_as_dealt():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "simhash near-dedup", "substring dedup", "mixing sources", "best-fit packing",
    ]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_edge_rows(spark, name):
    docs = documents(spark)
    out = stage(name)(spark, docs, SMALL)
    assert name == "best-fit packing" or out.columns == docs.columns
    assert out.count() > 0
    assert stage(name)(spark, no_documents(spark), SMALL).count() == 0


def test_one_document_of_each_group_stays(spark):
    docs = documents(spark).where("doc_id IS NOT NULL")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    sets = Sets(len(rows))
    prints = [fingerprint(t) for _, t in rows]
    for i, x in enumerate(prints):
        for j in range(i):
            if (x ^ prints[j]).bit_count() <= 3:
                sets.link(i, j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[sets.find(i)] = min(least.get(sets.find(i), doc_id), doc_id)
    kept = stage("simhash near-dedup")(spark, docs, SMALL)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(least.values())


def test_groups_are_of_rows_not_of_ids(spark):
    """Two texts under one doc_id are two documents, and rows without an id are in groups too."""
    one, two, three, four = (" ".join(f"{w}{i}" for i in range(80)) for w in ("ash", "birch", "cedar", "dogwood"))
    rows = [(1, one), (7, one), (7, two), (8, three), (8, four), (8, four), (None, three), (None, "only here"), (None, "only here"), (9, None), (None, "")]
    rows.append((None, two + " "))
    kept = stage("simhash near-dedup")(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(4), SMALL)
    expected = [(1, one), (7, two), (8, three), (8, four), (None, "only here"), (9, None)]
    assert rows_of(kept) == sorted(expected, key=repr)


def test_repeats_are_cut(spark):
    docs = documents(spark)
    expected = {d: (n, gone) for d, n, gone, _ in cut([(r.doc_id, r.text) for r in docs.collect()]) if d is not None}
    out = {r.doc_id: r for r in stage("substring dedup")(spark, docs, SMALL).collect()}
    for doc_id, (n, gone) in expected.items():
        if n and n == gone:
            assert doc_id not in out
        else:
            assert len((out[doc_id].text or "").split()) == n - gone
            assert out[doc_id].text is None or out[doc_id].n_chars == len(out[doc_id].text)


def test_mixing_meets_targets(spark):
    """Token shares of the sample itself, with topics and sources that the input has too little of."""
    topic = "CASE WHEN id % 100 = 0 THEN ' api_key' WHEN id % 60 = 7 THEN ' phone' WHEN id % 31 = 3 THEN ' license' WHEN id % 40 = 9 THEN ' | x' ELSE '' END"
    docs = spark.range(40_000).selectExpr(
        "id AS doc_id", f"repeat('w ', 5 + CAST(id % 7 AS INT)) || 'end' || {topic} AS text",
        "element_at(array('en', 'en', 'en', 'de', 'fr', 'es', 'it'), CAST(hash(id) & 65535 AS INT) % 7 + 1) AS lang",
        "CASE WHEN hash(id, 1) % 30 = 0 THEN 'small' WHEN hash(id, 1) % 3 = 0 THEN 'middle' ELSE 'large' END AS source",
    )

    def cells_of(df):
        return mixing.with_cells(df, "doc_id", "text", "lang", "source", mixing.LANG_TARGETS)

    power = {r.source: r.n**mixing.SOURCE_POWER for r in cells_of(docs).groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    sources = {s: x / sum(power.values()) for s, x in power.items()}
    sampled = cells_of(stage("mixing sources")(spark, docs, SMALL))
    total = sampled.agg(F.sum("tokens")).first()[0]
    assert total == pytest.approx(mixing.BUDGET * cells_of(docs).agg(F.sum("tokens")).first()[0], rel=0.02)
    for column, targets in (("topic", mixing.TOPIC_TARGETS), ("lang", mixing.LANG_TARGETS), ("source", sources)):
        shares = {r[0]: r.n / total for r in sampled.groupBy(column).agg(F.sum("tokens").alias("n")).collect()}
        assert shares == pytest.approx(targets, abs=0.002)


def test_run(spark):
    packed = corpus_pipeline.run(spark, SMALL).collect()
    n_docs = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    assert 0 < len({r.doc_id for r in packed}) < n_docs
    fill = {}
    for r in packed:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 2048 and np.mean(list(fill.values())) > 1500
