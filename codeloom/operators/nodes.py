"""Node tables: nested units of a file as flat rows.

(id, node_id, parent_id, depth, ord, kind, start, end); the root has no parent
and children lie inside their parent, ordered by ``ord``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from codeloom.functions.text import block_span_text, non_blank_length, text_blocks
from codeloom.workspace import small_batches

ROOT = "0"
NODE = "node_id string, parent_id string, depth int, ord int, kind string, start bigint, end bigint"
NON_BLANK = ", non_blank bigint"


def prose_nodes(
    files: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences_over: int = 0, measured: bool = False
) -> DataFrame:
    """Document, its lines, and the sentences of each line; empty ones are left out. If they are
    ``measured``, with ``non_blank``, the characters of each that are not blank.

    Only lines longer than ``sentences_over`` are cut into sentences. Packing enters
    no node within its limit, so with that limit here it gives the same chunks from
    fewer nodes. Lines and sentences are cut and numbered for a batch of texts at a time; nothing is shuffled.
    """
    small_batches(files.sparkSession)
    texts = files.select(id_col, F.col(text_col).alias("_text"))
    schema = T.StructType([texts.schema[0], T.StructField("nodes", T.ArrayType(T.StructType.fromDDL(NODE + NON_BLANK * measured)))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = _nodes_of(batch.column(1).fill_null(""), sentences_over, measured, arrow.field("nodes").type)
            yield pa.RecordBatch.from_arrays([batch.column(0), nodes], schema=arrow).filter(batch.column(1).is_valid())

    return texts.mapInArrow(run, schema).select(id_col, F.inline("nodes"))


def _placed(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lines of texts, and of each its text's number, its own in the text, its start there and its length."""
    found = pc.split_pattern(texts, "\n")
    count = np.asarray(found.value_lengths(), dtype=np.int64)
    parts = found.flatten()
    of = np.repeat(np.arange(len(texts)), count)
    first = np.cumsum(count) - count
    length = np.asarray(pc.utf8_length(parts), dtype=np.int64)
    start = np.cumsum(length + 1) - length - 1
    return parts, of, np.arange(len(parts)) - first[of], start - start[first[of]], length


def _nodes_of(texts: pa.Array, sentences_over: int, measured: bool, made: pa.DataType) -> pa.Array:
    """The nodes of each text, as a list, in the order of the text."""
    line, row, ln, line_start, line_length = _placed(texts)
    cut = np.flatnonzero(line_length > sentences_over)
    marked = pc.replace_substring_regex(line.take(pa.array(cut)), r"([.!?]) ", "\\1\n")
    part, of, sn, part_start, part_length = _placed(marked)
    in_line = cut[of]
    shown_lines, shown_parts = np.flatnonzero(line_length > 0), np.flatnonzero(part_length > 0)
    heads = np.flatnonzero(ln == 0)

    def each(of_document: np.ndarray, of_line: np.ndarray, of_sentence: np.ndarray) -> np.ndarray:
        return np.concatenate([of_document, of_line[shown_lines], of_sentence[shown_parts]])

    # A document stands before its first line, a line before its sentences.
    order = np.lexsort((each(heads * 0 - 2, ln * 0 - 1, sn), each(heads, np.arange(len(line)), in_line)))
    line_id = pc.binary_join_element_wise(ROOT, pa.array(ln).cast(pa.string()), ".")
    sentence_id = pc.binary_join_element_wise(line_id.take(pa.array(in_line)), pa.array(sn).cast(pa.string()), ".")
    roots = pa.array([ROOT] * len(texts), pa.string())
    numbers = np.arange(len(texts))
    depth = each(numbers * 0, ln * 0 + 1, sn * 0 + 2)
    start = each(numbers * 0, line_start, line_start[in_line] + part_start)
    end = start + each(np.asarray(pc.utf8_length(texts), dtype=np.int64), line_length, part_length)
    columns = [
        pa.concat_arrays([roots, line_id.take(pa.array(shown_lines)), sentence_id.take(pa.array(shown_parts))]),
        pa.concat_arrays([
            pa.nulls(len(texts), pa.string()), pa.array([ROOT] * len(shown_lines), pa.string()),
            line_id.take(pa.array(in_line[shown_parts])),
        ]),
        pa.array(depth.astype(np.int32)),
        pa.array(each(numbers * 0, ln, sn).astype(np.int32)),
        pa.array(["document", "line", "sentence"]).take(pa.array(depth)),
        pa.array(start),
        pa.array(end),
    ]
    if measured:
        every = pa.concat_arrays([texts, line.take(pa.array(shown_lines)), part.take(pa.array(shown_parts))])
        columns.append(pc.utf8_length(pc.replace_substring_regex(every, r"[ \t\n\v\f\r]", "")).cast(pa.int64()))
    nodes = pa.StructArray.from_arrays([c.take(pa.array(order)) for c in columns], fields=list(made.value_type))
    count = np.bincount(each(numbers, row, row[in_line]), minlength=len(texts))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), nodes, type=made)


def large_nodes(
    nodes: DataFrame,
    files: DataFrame | None = None,
    min_chars: int = 100,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Nodes with at least ``min_chars`` non-blank characters, labelled ``kind:start-end``.

    A child is never longer than its parent, so leaving out the children of a
    small node equals a plain filter. Nodes that are ``measured`` are just filtered. Of others
    those shorter than the limit go first, and the rest are measured next to their text in
    ``files``, one row per file; that alone takes a shuffle of texts.
    """
    if "non_blank" in nodes.columns:
        label = F.format_string("%s:%d-%d", "kind", "start", "end").alias("label")
        return nodes.where(F.col("non_blank") >= min_chars).select(id_col, "node_id", "depth", label, "non_blank")
    long_enough = nodes.where(F.col("end") - F.col("start") >= min_chars)
    per_file = long_enough.groupBy(id_col).agg(
        F.collect_list(F.struct("node_id", "depth", "kind", "start", "end")).alias("found")
    )
    blocked = per_file.join(files.select(id_col, text_col).repartition(id_col), id_col).select(
        id_col, "found", text_blocks(F.col(text_col)).alias("blocks")
    )
    measured = blocked.select(
        id_col,
        F.inline(
            F.transform(
                "found",
                lambda n: F.struct(
                    n["node_id"].alias("node_id"),
                    n["depth"].alias("depth"),
                    F.format_string("%s:%d-%d", n["kind"], n["start"], n["end"]).alias("label"),
                    non_blank_length(block_span_text(F.col("blocks"), n["start"], n["end"])).alias("non_blank"),
                ),
            )
        ),
    )
    return measured.where(F.col("non_blank") >= min_chars)
