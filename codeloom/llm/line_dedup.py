"""Line deduplication: lines that many documents have go, but for one document that keeps them.

Lines are exploded with their positions, normalised and hashed; the documents of each hash
are counted, and documents are put together again from the positions that stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import map_rows
from codeloom.llm.joins import match_keys
from codeloom.workspace import materialize

MIN_CHARS = 40
MIN_DOCS = 5
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Stands for a doc_id that is null.
NO_ID = -(1 << 63)


def line_key(line: Column) -> Column:
    """A line without white space at its ends, A-Z lowered (other capitals stay)."""
    bare = F.btrim(line, F.lit(BLANKS))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, UPPER.lower()))


def line_postings(rows: DataFrame, min_chars: int) -> DataFrame:
    """(id, t, pos, h1, h2) of the lines of (id, t, text) whose key has ``min_chars`` code points."""
    lines = rows.select("id", "t", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    long_enough = lines.where(F.char_length(F.btrim("line", F.lit(BLANKS))) >= min_chars)
    key = line_key(F.col("line"))
    return long_enough.select("id", "t", "pos", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2"))


def common_lines(postings: DataFrame, min_docs: int) -> DataFrame:
    """(h1, h2, keeper, n): lines of at least ``min_docs`` documents, the largest id that has
    it, and how often it stands. Documents are counted distinctly, combined before shuffles, by (line,
    document) first, so a line that most documents have is dealt out by document."""
    counted = postings.groupBy("h1", "h2").agg(
        F.count_distinct("id").alias("n_docs"), F.max("id").alias("keeper"), F.count("*").alias("n")
    )
    return counted.where(F.col("n_docs") >= min_docs).select("h1", "h2", "keeper", "n")


def remove_common_lines(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
    keep: list[str] | None = None,
    with_text: bool = False,
) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of each row: its text without the lines whose
    key, of at least ``min_chars`` code points, is in at least ``min_docs`` documents; the
    document of largest id that has a line keeps all its places.

    A text is divided at line ends and the lines that stay are joined by them, unchanged.
    Keys are as in ``line_key``. A null or empty text is one empty line; a text that loses all lines
    is empty. Rows of one id are one document, each with its own text; rows
    without an id are one document of an id smaller than any. Repeated rows are repeated.
    With ``with_text`` there are also ``kept_text`` and ``kept``, a struct of the columns ``keep``.

    128 bits of hash stand for a key. Shuffled are the hashes, and texts once to meet their
    positions; frequent lines are matched by a bounded broadcast.
    """
    kept = F.struct(*[F.col(f"`{c}`") for c in keep or []]) if keep else F.lit(None).cast("int")
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(
        F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(value).alias("t"),
        value.alias("text"), kept.alias("kept"),
    )
    postings = materialize(line_postings(rows, min_chars), "lines")
    common = materialize(common_lines(postings, min_docs), "common-lines")
    late = match_keys(postings, common, ["h1", "h2"], "n").where(F.col("id") != F.col("keeper"))
    drops = late.groupBy("id", "t").agg(F.collect_set("pos").alias("drop"))

    def start() -> Callable:
        def compute(values: list) -> dict:
            made: dict[str, list] = {"n_dropped": [], "sha256": [], "left": []}
            for value in values:
                gone = frozenset(value["drop"] or ())
                left = value["text"]
                if gone:
                    left = "\n".join([x for i, x in enumerate(left.split("\n")) if i not in gone])
                made["n_dropped"].append(len(gone))
                made["sha256"].append(hashlib.sha256(left.encode()).hexdigest())
                made["left"].append(left if with_text else None)
            return made

        return compute

    found = rows.join(drops, ["id", "t"], "left").select(
        "id", "kept", F.size(F.split("text", "\n")).cast("long").alias("n_lines"), F.struct("text", "drop").alias("found")
    )
    cut = map_rows(found, "found", "n_dropped long, sha256 string, left string", start, keep=["id", "n_lines", "kept"])
    out = cut.select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "n_lines", "n_dropped",
        F.col("sha256").alias("kept_sha256"), F.col("left").alias("kept_text"), "kept",
    )
    return out if with_text else out.drop("kept_text", "kept")


def drop_sql(min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> str:
    """The SQL of the operator over ``documents``."""
    return rf"""
WITH blanks AS (SELECT ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) AS b),
lines AS (
  SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
keyed AS (
  SELECT *, translate(trim(line, (SELECT b FROM blanks)), '{UPPER}', '{UPPER.lower()}') AS k FROM lines),
common AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= {min_chars}
  GROUP BY k HAVING count(DISTINCT doc_id) >= {min_docs})
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (keeper <> doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (keeper IS NULL OR keeper = doc_id), '')) AS kept_sha256
FROM keyed LEFT JOIN common USING (k) GROUP BY doc_id"""
