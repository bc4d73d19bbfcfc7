"""The queries of this package: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import ann_forest, chat_format, collocations, conversation_repair, embedding_dedup, license_scan, line_dedup, mixing, packing, quality_classifier, simhash_dedup, substring_dedup, toxicity
from codeloom.llm.common import table
from codeloom.llm.registry import ORACLES, QUERIES, query


def all_queries() -> dict:
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    return dict(ORACLES)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_best_fit_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


@query("op2_license_scan")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"), keep=["doc_id"])


def held_out(modulus: int, remainder: int) -> Column:
    """Whether no label of a row may be learned; a row of null id is held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(True))


def _judged(scored: DataFrame, modulus: int, remainder: int) -> DataFrame:
    return scored.select("doc_id", held_out(modulus, remainder).alias("held_out"), *[c for c in scored.columns if c != "doc_id"])


@query("op3_mixing", mixing.mix_sql())
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.withColumn("probability", F.round("probability", 6))


@query("op4_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, "toxic", ~held_out(5, 0))
    return _judged(toxicity.score(docs, model, keep=["doc_id"]), 5, 0)


@query("op5_simhash_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op6_quality_classifier")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    model = quality_classifier.train(docs, labels, "quality", ~held_out(3, 1))
    return _judged(quality_classifier.score(docs, model, keep=["doc_id"]), 3, 1)


CONTROL_TEXT = "\\### Assistant: </turn> ok"

OP9_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), marked AS (
  SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS learned,
    length(replace(replace(replace(text, '\', '\\'), '#', '\#'), '<', '\<'))
    + length(replace(replace(replace(replace(role, '\', '\\'), '#', '\#'), '<', '\<'), ':', '\:')) + 14 AS chars
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(length(learned)) AS BIGINT) AS loss_chars,
  sha256(string_agg(learned, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""


@query("op9_chat_format", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.createDataFrame(
        [(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)],
        "conv_id long, turn long, role string, text string",
    )
    parts = turns.unionByName(control).withColumn("parts", chat_format.text_part(F.col("text")))
    return chat_format.digest_formatted(chat_format.format_conversations(parts))


@query("op10_substring_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


@query("op8_embedding_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op7_ann_forest")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_forest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op11_line_dedup", line_dedup.drop_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_common_lines(table(spark, sf_dir, "documents"))


@query("op12_conversation_repair", conversation_repair.repair_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_conversations(conversation_repair.damage(table(spark, sf_dir, "conversations")))


@query("op13_phrase_collocations", collocations.mine_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine_collocations(table(spark, sf_dir, "documents"))
