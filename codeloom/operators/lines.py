"""Line tables and offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.folds import placed_parts


def line_table(files: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ln, line, start): lines with 0-based number and start offset. A text lies in
    its row, so it is cut and numbered there; nothing is shuffled.
    """
    lines = placed_parts(f"split(`{text_col}`, '\\n')")
    return files.select(id_col, F.posexplode(lines).alias("ln", "l")).select(
        id_col, F.col("ln").cast("bigint").alias("ln"), F.col("l.part").alias("line"), "l.start"
    )


def offset_to_line(
    offsets: DataFrame,
    files: DataFrame,
    id_col: str = "doc_id",
    offset_col: str = "offset",
    text_col: str = "text",
) -> DataFrame:
    """Adds the 0-based ``line`` that holds each offset.

    Line ends and offsets are merged in one order per file, and the ends seen so
    far are counted: n log n, however many lines and offsets a file has. Offsets
    at or past the end of the text get the line count.
    """
    lines = line_table(files, id_col, text_col)
    is_last = F.lead("ln").over(Window.partitionBy(id_col).orderBy("ln")).isNull()
    # A last line that is empty is only the final line break of the text.
    ends = (
        lines.withColumn("_last", is_last)
        .where(~(F.col("_last") & (F.length("line") == 0)))
        .select(
            id_col,
            (F.col("start") + F.length("line") + F.when(F.col("_last"), 0).otherwise(1))
            .cast("bigint")
            .alias("_at"),
        )
        .withColumn("_is_end", F.lit(1))
    )
    asked = offsets.withColumn("_at", F.col(offset_col).cast("bigint")).withColumn("_is_end", F.lit(0))
    merged = asked.unionByName(ends, allowMissingColumns=True)
    # Equal positions are peers of a range frame, so an end at the offset counts.
    upto = (
        Window.partitionBy(id_col)
        .orderBy("_at")
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        merged.withColumn("line", F.sum("_is_end").over(upto).cast("bigint"))
        .where(F.col("_is_end") == 0)
        .drop("_at", "_is_end")
    )
