"""Summaries, answers and other per-row enrichment."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.functions.repos import base_name, content_id
from codeloom.functions.text import sentences, words
from codeloom.workspace import small_batches

SUMMARY_WORDS = 150
#: Texts whose words are counted together.
ROWS_AT_ONCE = 1024
#: What Spark's patterns take for blanks.
_BLANK = r"[ \t\n\v\f\r]"
_BLANKS = re.compile(f"{_BLANK}+")


def batch_map(
    df: DataFrame,
    fn: Callable[[pd.DataFrame], pd.Series],
    in_cols: list[str],
    value_col: str,
    value_type: T.DataType | str,
    error_col: str = "error",
) -> DataFrame:
    """Adds ``fn`` of the columns ``in_cols``, taken batch by batch.

    ``fn`` gets a frame and returns one value per row. A batch that fails is halved until
    the rows that fail are alone; they keep a null value and their error.
    """
    small_batches(df.sparkSession)
    if isinstance(value_type, str):
        value_type = T._parse_datatype_string(value_type)
    schema = T.StructType(
        [
            *df.schema.fields,
            T.StructField(value_col, value_type),
            T.StructField(error_col, T.StringType()),
        ]
    )

    def tried(args: pd.DataFrame) -> tuple[list, list]:
        try:
            values = list(fn(args))
            if len(values) != len(args):
                raise ValueError("the function must return one value per row")
            return values, [None] * len(args)
        except Exception as problem:  # noqa: BLE001 - any failure of the caller's function
            if len(args) == 1:
                return [None], [f"{type(problem).__name__}: {problem}"]
        half = len(args) // 2
        first, rest = tried(args.iloc[:half].reset_index(drop=True)), tried(args.iloc[half:].reset_index(drop=True))
        return first[0] + rest[0], first[1] + rest[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            values, errors = tried(frame[in_cols].reset_index(drop=True)) if len(frame) else ([], [])
            yield frame.assign(**{value_col: pd.Series(values, index=frame.index, dtype=object),
                                  error_col: pd.Series(errors, index=frame.index, dtype=object)})

    return df.mapInPandas(run, schema)


def split_errors(enriched: DataFrame, error_col: str = "error") -> tuple[DataFrame, DataFrame]:
    """Rows that worked, and rows that failed with their error."""
    return (
        enriched.where(F.col(error_col).isNull()).drop(error_col),
        enriched.where(F.col(error_col).isNotNull()),
    )


def _told(parts: pa.Array, words: pa.Array, most: np.ndarray) -> pa.Array:
    """The summaries of some texts, given as sentences and the words of each."""
    row = np.repeat(np.arange(len(parts)), np.asarray(parts.value_lengths()))
    sentence = pc.utf8_trim(parts.flatten(), " ")
    sizes = np.asarray(pc.count_substring_regex(sentence, f"{_BLANK}+")) + 1
    of_sentence = words.flatten()
    n_words = np.asarray(of_sentence.value_lengths())
    # How often each word stands in its text, summed up by sentence.
    coded = of_sentence.flatten().dictionary_encode()
    holder = np.repeat(np.arange(len(sentence)), n_words)
    cells = row[holder] * max(1, len(coded.dictionary)) + np.asarray(coded.indices, dtype=np.int64)
    _, cell, counts = np.unique(cells, return_inverse=True, return_counts=True)
    sums = np.bincount(holder, weights=counts[cell], minlength=len(sentence))
    score = np.divide(sums, n_words, out=np.zeros(len(sentence)), where=n_words > 0)
    # Best first in each text, as many as fit, and the best in any case.
    best = np.lexsort((-score, row))
    best = best[np.asarray(pc.binary_length(sentence))[best] > 0]
    of = row[best]
    is_first = np.diff(of, prepend=-1) > 0
    upto = np.cumsum(sizes[best])
    before = (upto - sizes[best])[is_first]
    kept = np.sort(best[is_first | (upto - np.repeat(before, np.bincount(of)[of[is_first]]) <= most[of])])
    shown = sentence.take(pa.array(kept))
    # Only a sentence that is kept alone can be too long.
    long = sizes[kept] > most[row[kept]]
    if long.any():
        cut = [" ".join(_BLANKS.split(shown[int(i)].as_py())[: most[row[kept[i]]]]) for i in np.flatnonzero(long)]
        shown = pc.replace_with_mask(shown, pa.array(long), pa.array(cut, pa.string()))
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row[kept], minlength=len(parts)))]).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), shown), " ")


@F.arrow_udf(T.StringType())
def _telling(parts: pa.Array, words: pa.Array, limit: pa.Array) -> pa.Array:
    """The sentences to keep, those whose words are most frequent in the text, joined in its order."""
    most = np.asarray(limit)
    cuts = range(0, max(1, len(parts)), ROWS_AT_ONCE)
    some = [slice(at, at + ROWS_AT_ONCE) for at in cuts]
    return pa.concat_arrays([_told(parts[rows], words[rows], most[rows]) for rows in some])


def telling_sentences(text: Column, max_words: int = SUMMARY_WORDS) -> Column:
    """The most telling sentences of the whole text, up to ``max_words`` words in all, in
    the order of the text.

    A sentence tells as much as its words are frequent in the text, on average; of equal
    ones the first goes first. Sentences are taken best first until the next one is too
    long; if the best alone is, its first ``max_words`` words are the summary. Sentences and
    words are cut by Spark and handed over once; the summary comes back as it is.
    """
    parts = sentences(F.coalesce(text, F.lit("")))
    return _telling(parts, F.transform(parts, lambda s: words(s)), F.lit(max_words))


def summarize(
    chunks: DataFrame, text_col: str = "text", fn: Callable[[pd.DataFrame], pd.Series] | None = None
) -> DataFrame:
    """Adds ``summary``: by the caller's function over batches, else the most telling
    sentences. With a function there is an ``error`` column as well.
    """
    if fn is None:
        return chunks.withColumn("summary", telling_sentences(F.col(text_col)))
    return batch_map(chunks, fn, [text_col], "summary", "string")


def answer(
    questions: DataFrame,
    hits: DataFrame,
    fn: Callable[[pd.DataFrame], pd.Series] | None = None,
) -> DataFrame:
    """(q_id, question, answer): by the caller's function over (question, context),
    else the summary of the best hit. ``hits`` has q_id, rank and summary, and
    with a function ``questions`` has the context column as well.
    """
    if fn is not None:
        return batch_map(questions, fn, ["question", "context"], "answer", "string")
    best = hits.where(F.col("rank") == 1).select("q_id", F.col("summary").alias("answer"))
    return questions.select("q_id", "question").join(best, "q_id", "left")


def record_id(mode: str) -> Column:
    """Id of a chunk of repo, path, part and text; the same whenever it is cut again."""
    file = F.coalesce("path", F.lit("unknown"))
    return content_id(F.col("repo"), file, F.col("part"), F.lit(mode), F.col("text"))


def chunk_records(
    chunks: DataFrame,
    mode: str,
    summary: Column | None = None,
    embedding: Column | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Chunks as collection records, with defaults for what is missing; columns named
    in ``keep`` go along.

    Takes repo, language, path, part, start_line, end_line and text; ``part`` tells
    the chunks of a file apart. The owner of the repository is kept beside its base
    name, which several owners may share.
    """
    line = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("?"))
    lines = F.concat_ws("-", line("start_line"), line("end_line"))
    file = F.coalesce("path", F.lit("unknown"))
    columns = [
        record_id(mode).alias("id"),
        base_name(F.col("repo")).alias("repo_name"),
        F.col("repo"),
        F.col("language"),
        file.alias("chunk_file"),
        lines.alias("chunk_lines"),
        F.col("text").alias("chunk_code"),
        (F.col("text") if summary is None else summary).alias("summary"),
    ]
    if embedding is not None:
        columns.append(embedding.alias("embedding"))
    return chunks.select(*columns, *keep)
