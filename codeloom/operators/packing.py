"""Packing node tables into chunks.

A node longer than the limit is *big*. The units to pack are the children that
are not big, of the root and of big nodes (the ancestors of a big node are big as
well). A big child ends the current chunk and the next one starts at its end, so
the units between two big siblings form a group that is packed on its own, by one
fold over its units in order. Groups are built from their boundaries, one marker
per entered node and per big child, so that groups without units keep their empty
span, which gap filling may stretch later.

All steps partition by file id. Texts are shuffled by id once, where nodes are cut
from them, and Spark reuses that shuffle where spans are joined with their text; there
is no other. Columns besides id and text are best joined to the chunks afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.folds import emitting_fold
from codeloom.functions.text import (
    block_span_text,
    line_count,
    newline_count,
    non_blank_length,
    text_blocks,
)
from codeloom.operators.lines import offset_to_line

MAX_CHARS = 1536
TEXT_MAX_CHARS = 600
COALESCE = 50


def sibling_groups(nodes: DataFrame, max_chars: int, id_col: str = "doc_id") -> DataFrame:
    """(id, parent_id, grp, grp_start, grp_end, units); units are ordered structs
    of start, end and ``next_start``, the start of the next sibling or else the
    parent's end.
    """
    size = F.col("end") - F.col("start")
    is_root = F.col("parent_id").isNull()
    is_big = size > max_chars
    # A node is a child under its parent and, if entered, the head of its own children.
    as_child = F.struct(
        F.col("parent_id").alias("under"), F.lit(1).alias("role"), F.col("ord").alias("at")
    )
    as_head = F.struct(F.col("node_id").alias("under"), F.lit(0).alias("role"), F.lit(0).alias("at"))
    roles = F.array_compact(F.array(F.when(~is_root, as_child), F.when(is_root | is_big, as_head)))
    rows = nodes.select(
        id_col, "start", "end", is_big.alias("big"), F.explode(roles).alias("r")
    ).select(id_col, "start", "end", "big", "r.*")

    ordered = Window.partitionBy(id_col, "under").orderBy("role", "at")
    family = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_head = F.col("role") == 0
    big_child = ~is_head & F.col("big")
    entered = (
        rows.withColumn("head_end", F.max(F.when(is_head, F.col("end"))).over(family))
        .withColumn("grp", F.sum(big_child.cast("int")).over(upto))
        .withColumn("next_start", F.lead("start").over(ordered))
        .withColumn("next_big", F.min(F.when(big_child, F.col("start"))).over(
            ordered.rowsBetween(1, Window.unboundedFollowing)))
        .where(F.col("head_end").isNotNull())
    )
    unit = F.struct(
        "at", "start", "end", F.coalesce("next_start", "head_end").alias("next_start")
    )
    marker_start = F.when(is_head, F.col("start")).when(F.col("big"), F.col("end"))
    return (
        entered.groupBy(id_col, F.col("under").alias("parent_id"), "grp")
        .agg(
            F.max(marker_start).alias("grp_start"),
            F.max(F.when(marker_start.isNotNull(), F.coalesce("next_big", "head_end"))).alias("grp_end"),
            F.array_sort(F.collect_list(F.when(~is_head & ~F.col("big"), unit))).alias("units"),
        )
    )


def greedy_pack(nodes: DataFrame, max_chars: int = MAX_CHARS, id_col: str = "doc_id") -> DataFrame:
    """(id, start, end): spans of at most ``max_chars``, gaps between units included.

    Every group gives at least one span, possibly empty. Sorting by (start, end)
    gives depth-first order.
    """
    now = "array(named_struct('start', acc.start, 'end', acc.end))"
    packed = emitting_fold(
        "units",
        {"start": "grp_start", "end": "grp_start"},
        f"""if(u.end - u.start + acc.end - acc.start > {int(max_chars)},
               named_struct('start', u.start, 'end', u.end, 'done', concat(acc.done, {now})),
               named_struct('start', acc.start, 'end', u.end, 'done', acc.done))""",
        "struct<start: bigint, end: bigint>",
        f"concat(acc.done, {now})",
    )
    return sibling_groups(nodes, max_chars, id_col).select(id_col, F.inline(packed))


def greedy_pack_text(
    nodes: DataFrame,
    files: DataFrame,
    max_chars: int = TEXT_MAX_CHARS,
    keep_gaps: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, seq, text): the same walk, measured on the chunk's own text so far.

    Without gaps a unit adds its own text; with gaps, the text up to the next
    sibling. Empty chunks are kept. ``seq`` counts chunks in depth-first order.
    """
    unit_end = "u.next_start" if keep_gaps else "u.end"
    pieces = "array<struct<start: bigint, end: bigint>>"
    piece = f"array(named_struct('start', u.start, 'end', {unit_end}))"
    packed = emitting_fold(
        "units",
        {"len": "0L", "now": f"cast(array() as {pieces})"},
        f"""if(u.end - u.start + acc.len > {int(max_chars)},
               named_struct('len', {unit_end} - u.start, 'now', {piece},
                            'done', concat(acc.done, array(acc.now))),
               named_struct('len', acc.len + {unit_end} - u.start, 'now', concat(acc.now, {piece}),
                            'done', acc.done))""",
        pieces,
        "concat(acc.done, array(acc.now))",
    )
    chunks = sibling_groups(nodes, max_chars, id_col).select(
        id_col, "grp_start", "grp_end", F.posexplode(packed).alias("i", "pieces")
    )
    in_order = Window.partitionBy(id_col).orderBy("grp_start", "grp_end", "i")
    numbered = chunks.withColumn("seq", F.row_number().over(in_order) - 1)
    per_file = numbered.groupBy(id_col).agg(F.collect_list(F.struct("seq", "pieces")).alias("found"))
    blocked = per_file.join(files.select(id_col, text_col).repartition(id_col), id_col).select(
        id_col, "found", text_blocks(F.col(text_col)).alias("blocks")
    )

    def piece_text(p: Column) -> Column:
        return block_span_text(F.col("blocks"), p["start"], p["end"])

    return blocked.select(
        id_col,
        F.inline(
            F.transform(
                "found",
                lambda c: F.struct(
                    c["seq"].cast("bigint").alias("seq"),
                    F.array_join(F.transform(c["pieces"], piece_text), "").alias("text"),
                ),
            )
        ),
    )


def fill_gaps(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Each span ends where the next one starts; the last stays as it is."""
    in_order = Window.partitionBy(id_col).orderBy("start", "end")
    following = F.lead("start").over(in_order)
    return spans.select(id_col, "start", F.coalesce(following, F.col("end")).alias("end"))


def measured_spans(
    spans: DataFrame, files: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per file: its text, the text as blocks, and its ordered spans, each with
    the character, non-blank and line-break counts since the end of the span before.
    The text is read next to its spans, never per span row.
    """
    per_file = spans.groupBy(id_col).agg(
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans")
    )

    def measure(s: Column, i: Column) -> Column:
        since = F.when(i == 0, F.lit(0).cast("bigint")).otherwise(F.get("spans", i - 1)["end"])
        text = block_span_text(F.col("blocks"), since, s["end"])
        return F.struct(
            s["start"].alias("start"),
            s["end"].alias("end"),
            (s["end"] - since).alias("chars"),
            non_blank_length(text).alias("non_blank"),
            newline_count(text).cast("bigint").alias("breaks"),
        )

    blocked = per_file.join(files.select(id_col, text_col).repartition(id_col), id_col).select(
        id_col, text_col, "spans", text_blocks(F.col(text_col)).alias("blocks")
    )
    return blocked.select(id_col, text_col, "blocks", F.transform("spans", measure).alias("spans"))


def _coalesced(measure: str, limit: int) -> Column:
    """Fold over ordered spans: extend until the merged text, gaps included, has
    more than ``limit`` by ``measure`` and holds a line break. Carries the number
    of line breaks before the merged span, which is its first line.
    """
    full = f"acc.size + u.{measure} > {int(limit)} and acc.breaks + u.breaks > 0"
    folded = emitting_fold(
        "spans",
        {"start": "0L", "end": "0L", "size": "0L", "breaks": "0L", "line": "0L"},
        f"""if({full},
               named_struct('start', u.end, 'end', u.end, 'size', 0L, 'breaks', 0L,
                            'line', acc.line + acc.breaks + u.breaks,
                            'done', concat(acc.done, array(named_struct(
                                'start', acc.start, 'end', u.end, 'line', acc.line,
                                'breaks', acc.breaks + u.breaks)))),
               named_struct('start', acc.start, 'end', u.end, 'size', acc.size + u.{measure},
                            'breaks', acc.breaks + u.breaks, 'line', acc.line, 'done', acc.done))""",
        "struct<start: bigint, end: bigint, line: bigint, breaks: bigint>",
        """concat(acc.done, array(named_struct(
               'start', acc.start, 'end', acc.end, 'line', acc.line, 'breaks', acc.breaks)))""",
    )
    return F.filter(folded, lambda s: s["end"] > s["start"])


def coalesce_spans(
    spans: DataFrame,
    files: DataFrame,
    limit: int = COALESCE,
    count_blanks: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Merge spans until each holds a line break and more than ``limit``
    characters, blanks counted or not. The first starts at 0; empty ones go.
    """
    measure = "chars" if count_blanks else "non_blank"
    return (
        measured_spans(spans, files, id_col, text_col)
        .select(id_col, F.inline(_coalesced(measure, limit)))
        .select(id_col, "start", "end")
    )


def structural_chunks(
    nodes: DataFrame,
    files: DataFrame,
    max_chars: int = MAX_CHARS,
    coalesce: int = COALESCE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, start, end, start_line, end_line, text): pack, fill gaps, merge small
    spans, turn offsets to half-open line ranges and drop the empty ones.
    """
    # Nodes by file, once: all windows and the join with the text run on that.
    spans = fill_gaps(greedy_pack(nodes.repartition(id_col), max_chars, id_col), id_col)
    text = F.col(text_col)
    per_file = measured_spans(spans, files, id_col, text_col).select(
        id_col, "blocks", "spans", F.length(text).alias("size"), line_count(text).alias("n_lines")
    )
    # The chunks are made inside the generator. As a column of their own, Spark would
    # add a filter on their number, and with it make them once more for the filter.
    merged = F.transform(
        _coalesced("non_blank", coalesce),
        lambda s: F.struct(
            s["start"].alias("start"),
            s["end"].alias("end"),
            s["line"].alias("first"),
            (s["line"] + s["breaks"]).alias("last"),
            block_span_text(F.col("blocks"), s["start"], s["end"]).alias("text"),
        ),
    )
    sized = per_file.select(id_col, "size", "n_lines", F.explode(merged).alias("c"))

    def line_at(offset: Column, breaks_before: Column) -> Column:
        return F.when(offset >= F.col("size"), F.col("n_lines")).otherwise(breaks_before)

    return sized.select(
        id_col,
        "c.start",
        "c.end",
        line_at(F.col("c.start"), F.col("c.first")).alias("start_line"),
        line_at(F.col("c.end"), F.col("c.last")).alias("end_line"),
        "c.text",
    ).where(F.col("end_line") > F.col("start_line"))


def line_spans(
    spans: DataFrame, files: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Offset spans as half-open line spans; empty before or after turning are dropped."""
    turned = spans.where(F.col("end") > F.col("start"))
    for side in ("start", "end"):
        turned = offset_to_line(turned, files, id_col, side, text_col).withColumnRenamed("line", f"{side}_line")
    return turned.where(F.col("end_line") > F.col("start_line")).select(id_col, "start_line", "end_line")
