"""Plans that must hold at scale: what is shuffled, read and pushed down."""

import re

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from codeloom.functions import vectors
from codeloom.operators import enrich, firsts, packing, scopes
from codeloom.operators.lines import line_table
from codeloom.operators.nodes import prose_nodes
from codeloom.operators.search import top_k
from codeloom.plans import flows
from codeloom.sources import collection


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def shuffles(plan):
    return sum("Exchange hashpartitioning" in x and "ReusedExchange" not in x for x in plan.splitlines())


def test_structural_chunks_shuffle_texts_once(spark, no_broadcast):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    plan = final_plan(packing.structural_chunks(prose_nodes(docs), docs))
    # The nodes' and the texts', once each.
    assert shuffles(plan) == 2
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_lines_and_nodes_are_cut_in_place(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for made in (line_table(docs), prose_nodes(docs), prose_nodes(docs, sentences_over=100)):
        assert "Exchange" not in final_plan(made)


def test_first_records_shuffle_no_texts_by_key(spark, no_broadcast):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    plan = final_plan(firsts.first_per_key(docs, "source", "doc_id"))
    by_key = [x for x in plan.splitlines() if "Exchange hashpartitioning(source" in x]
    assert by_key and "partial_min" in plan
    assert "ReadSchema: struct<doc_id:bigint,source:string>" in plan


def test_search_filter_reaches_the_scan_and_reads_only_vectors(spark):
    vecs = spark.read.parquet(f"{SMALL}/embeddings.parquet").where("label = 3").withColumn("unused", F.lit("x"))
    queries = vecs.select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("qv")).where("vec_id < 9")
    plan = final_plan(top_k(vecs, queries, id_col="vec_id"))
    assert "EqualTo(label,3)" in plan and "BroadcastHashJoin" in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert plan.count("WindowGroupLimit") == 2


def test_search_embeds_each_text_once(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    made = docs.select("doc_id", vectors.embed_text(F.col("text"), 32).alias("embedding"))
    queries = spark.createDataFrame([(1, [1.0] * 32)], "q_id long, qv array<float>")
    plan = final_plan(top_k(made, queries, id_col="doc_id"))
    assert plan.count("ArrowEvalPython") == 1


def test_records_are_worked_out_once_to_be_checked(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = {c: F.lit("x") for c in collection.FIELD_WIDTHS}
    columns |= {"summary": enrich.telling_sentences(F.col("text")), "embedding": vectors.embed_text(F.col("text"), 32)}
    good, rejected = collection.validate(docs.select(*[e.alias(c) for c, e in columns.items()]), dim=32)
    assert "ArrowEvalPython" not in final_plan(good) + final_plan(rejected)
    assert good.count() + rejected.count() == docs.count()


def test_lines_do_not_carry_their_text(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for made in (prose_nodes(docs, measured=True), scopes._blocks(docs, "doc_id", "text", None, 5)):
        # What each generator passes on of its row.
        kept = re.findall(r"\[([^\[\]]*)\], false, \[", final_plan(made))
        assert kept and not any(re.search(r"\b(_?text|lines)#", x) for x in kept)


def test_nodes_are_made_by_batches_of_texts(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    plan = final_plan(prose_nodes(docs, sentences_over=100))
    # One generator gives the nodes on; lines and sentences are no rows of their own.
    assert plan.count("MapInArrow") == 1 and len(re.findall(r"Generate \w+\(", plan)) == 1


def test_sentences_are_cut_twice_at_most_for_a_summary(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    plan = final_plan(docs.select(enrich.telling_sentences(F.col("text")).alias("summary")))
    assert plan.count("regexp_replace(") in (1, 2)


def test_files_are_read_once_to_be_cut_structurally(spark, tmp_path):
    rows = [("o/a", f"f{i % 4}.py", "python", "one. two\nthree") for i in range(8)]
    spark.createDataFrame(rows, "repo string, path string, language string, text string").write.parquet(f"{tmp_path}/given")
    chunks = flows.chunk_files(spark.read.parquet(f"{tmp_path}/given"), "structural")
    assert f"{tmp_path}/given" not in final_plan(chunks)
    assert sorted(r["path"] for r in chunks.collect()) == [f"f{i}.py" for i in range(4)]
