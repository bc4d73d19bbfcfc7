"""Lengths, tokens, sentences, lines and spans as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of letters, digits and underscores, or one other visible character.
TOKEN_PATTERN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
WORD_PATTERN = r"[\p{L}\p{N}_]+"
TEXT_BLOCK = 1024


def char_length(text: Column) -> Column:
    return F.length(text).cast("bigint")


def non_blank_length(text: Column) -> Column:
    """Characters of ``text`` that are not blank."""
    return F.length(F.regexp_replace(text, r"\s", "")).cast("bigint")


def tokens(text: Column, pattern: str = TOKEN_PATTERN) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))


def padded_tokens(text: Column, pattern: str = TOKEN_PATTERN) -> Column:
    """Tokens with the blanks that follow them, so that joining gives the text back."""
    return F.regexp_extract_all(text, F.lit(rf"((?:{pattern})\s*)"), F.lit(1))


def words(text: Column) -> Column:
    """Lower-cased words."""
    return tokens(F.lower(text), WORD_PATTERN)


def sentences(text: Column) -> Column:
    """Parts of ``text`` between a sentence mark and the blank behind it.

    Each part is followed in the text by exactly one character, a space or a
    line break, so offsets are running sums of ``length + 1``.
    """
    return F.split(F.regexp_replace(text, r"([.!?]) ", "$1\n"), "\n")


def newline_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def line_count(text: Column) -> Column:
    """Number of lines; a final line break does not open another line."""
    unfinished = (F.length(text) > 0) & ~text.endswith("\n")
    return (newline_count(text) + unfinished.cast("int")).cast("bigint")


def line_of_offset(text: Column, offset: Column) -> Column:
    """0-based line that holds ``offset``; at or past the end, the line count."""
    before = F.substring(text, F.lit(1), offset.cast("int"))
    return F.when(offset >= F.length(text), line_count(text)).otherwise(
        newline_count(before).cast("bigint")
    )


def span_text(text: Column, start: Column, end: Column) -> Column:
    """Characters ``[start, end)``."""
    return F.substring(text, (start + 1).cast("int"), (end - start).cast("int"))


def text_blocks(text: Column) -> Column:
    """The text as an array of blocks of ``TEXT_BLOCK`` characters, for many spans of
    one text: a substring counts its way from the start of its string.
    """
    return F.regexp_extract_all(text, F.lit("((?s).{1,%d})" % TEXT_BLOCK), F.lit(1))


def block_span_text(blocks: Column, start: Column, end: Column) -> Column:
    """Characters ``[start, end)`` of a text given as blocks."""
    first = F.floor(start / TEXT_BLOCK).cast("int")
    last = F.floor((F.greatest(end, start + 1) - 1) / TEXT_BLOCK).cast("int")
    around = F.array_join(F.slice(blocks, first + 1, last - first + 1), "")
    return span_text(around, start - first * TEXT_BLOCK, end - first * TEXT_BLOCK)


def span_lines(text: Column, start: Column, end: Column) -> Column:
    """Lines ``[start, end)``, joined by line breaks."""
    picked = F.slice(
        F.split(text, "\n"), (start + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int")
    )
    return F.array_join(picked, "\n")


def span(start: Column, end: Column) -> Column:
    return F.struct(start.alias("start"), end.alias("end"))


def span_concat(left: Column, right: Column) -> Column:
    """From the start of ``left`` to the end of ``right``."""
    return span(left["start"], right["end"])


def span_shift(one: Column, by: Column) -> Column:
    return span(one["start"] + by, one["end"] + by)


def span_length(one: Column) -> Column:
    return one["end"] - one["start"]
