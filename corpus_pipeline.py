"""Documents to training sequences, a stage at a time.

Each stage takes all that the one before it kept and returns the columns of documents,
only the last one returns packed pieces. Stages read their input where it was written, so
a lost executor costs the work since the last stage and no more.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from codeloom.llm import mixing, packing, quality_classifier, queries, simhash_dedup, substring_dedup  # noqa: E402
from codeloom.llm.common import table  # noqa: E402
from codeloom.llm.joins import match_keys  # noqa: E402
from codeloom.workspace import materialize  # noqa: E402

#: How often a document may be taken where its source, language or topic is scarce.
MAX_COPIES = 4

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels outside its held-out fold, accepts."""
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"), "quality", ~queries.held_out(3, 1))
    text = docs.select(F.struct(*docs.columns).alias("row"), "text")
    scored = quality_classifier.score(text, model, keep=["row"])
    return scored.where("predicted = 1").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: that of the smallest doc_id, rows without an id last. Rows are
    told apart by a hash of all their columns, so texts that share a doc_id, or have none,
    are judged each by its own group; of rows equal in all columns one stays."""
    every = [F.col(f"`{c}`") for c in docs.columns]
    every += [c.isNull() for c in every]
    halves = {f"__row{i}": F.xxhash64(F.lit(i), *every) for i in (1, 2)}
    hashed = docs.withColumns(halves)
    groups = materialize(simhash_dedup.with_components(hashed, keep=list(halves)), "groups")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", *halves)
    best = groups.groupBy("component").agg(F.min(order).alias("best"), F.count("*").alias("n"))
    several = materialize(best.where("n > 1"), "groups-of-several")
    rest = match_keys(groups, several, ["component"], "n").select(*halves, (order != F.col("best")).alias("later"))
    later = rest.where("later").select(*halves).distinct()
    again = rest.where("NOT later").groupBy(*halves).count().where("count > 1").select(*halves)
    once = hashed.join(later.unionByName(again), list(halves), "left_anti")
    first = hashed.join(again, list(halves), "left_semi").dropDuplicates(list(halves))
    return once.unionByName(first).select(docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages that an earlier one has. Texts that lose a
    word are the rest joined by spaces, with n_chars counted anew; those that lose all go."""
    cut = substring_dedup.remove_repeats(docs, keep=docs.columns, with_text=True)
    left = cut.where("n_removed = 0 OR n_removed < n_words")
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("kept_text")).otherwise(F.col("kept.text")).alias("text")
    n_chars = F.when(changed, F.char_length("kept_text").cast("long")).otherwise(F.col("kept.n_chars")).alias("n_chars")
    own = {"text": text, "n_chars": n_chars}
    return left.select(*[own.get(c, F.col(f"kept.`{c}`")) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens have the target shares of sources, languages and topics. Documents
    of shares with too few tokens are repeated, ``MAX_COPIES`` times at most."""
    mixed = mixing.mix(docs, keep=docs.columns, max_copies=MAX_COPIES)
    return mixed.select("kept", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("kept.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, in sequences of 2048 tokens."""
    return packing.pack_documents(docs, queries.tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", keep_quality),
    ("simhash near-dedup", drop_near_duplicates),
    ("substring dedup", cut_repeats),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: A trained classifier and a tokenizer have no SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
