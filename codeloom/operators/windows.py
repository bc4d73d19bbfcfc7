"""Overlapping token windows and sentence windows, cut inside each row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.folds import emitting_fold
from codeloom.functions.text import TOKEN_PATTERN, padded_tokens, sentences

CHUNK_SIZE = 512
CHUNK_OVERLAP = 20
BLANKS = " \t\r\n"


def token_windows(
    files: DataFrame,
    chunk_size: int = CHUNK_SIZE,
    chunk_overlap: int = CHUNK_OVERLAP,
    id_col: str = "doc_id",
    text_col: str = "text",
    pattern: str = TOKEN_PATTERN,
    keep: Sequence[str] = (),
) -> DataFrame:
    """(id, *keep, win, first_token, n_tokens, text): windows of ``chunk_size`` tokens
    that share ``chunk_overlap`` with the one before. No shuffle; a row gives its
    windows, with its ``keep`` columns. A text without tokens gives none.
    """
    if not 0 <= chunk_overlap < chunk_size:
        raise ValueError("chunk_overlap must be at least 0 and less than chunk_size")
    step = chunk_size - chunk_overlap
    # A text without tokens is left out inside the generator: a filter on the tokens
    # would be pushed below this projection and cut every text a second time.
    cut = files.select(id_col, *keep, padded_tokens(F.col(text_col), pattern).alias("_t"))
    n = F.size("_t")
    last = F.greatest(F.ceil((n - chunk_overlap) / step).cast("int") - 1, F.lit(0))

    def window(i: Column) -> Column:
        return F.struct(
            i.cast("bigint").alias("win"),
            (i * step).cast("bigint").alias("first_token"),
            F.least(F.lit(chunk_size), n - i * step).cast("bigint").alias("n_tokens"),
            F.rtrim(F.array_join(F.slice("_t", i * step + 1, F.lit(chunk_size)), ""), F.lit(BLANKS)).alias("text"),
        )

    windows = F.transform(F.sequence(F.lit(0), last), window)
    return cut.select(id_col, *keep, F.inline(F.when(n > 0, windows)))


def sentence_windows(
    files: DataFrame,
    chunk_size: int = CHUNK_SIZE,
    chunk_overlap: int = CHUNK_OVERLAP,
    id_col: str = "doc_id",
    text_col: str = "text",
    pattern: str = TOKEN_PATTERN,
    keep: Sequence[str] = (),
) -> DataFrame:
    """(id, *keep, win, n_tokens, text): whole sentences up to ``chunk_size`` tokens.

    A sentence longer than that is cut into pieces of ``chunk_size`` tokens first.
    A window starts with the trailing sentences of the one before that hold at most
    ``chunk_overlap`` tokens together, and always takes one new sentence.
    """
    size, overlap = int(chunk_size), int(chunk_overlap)
    parts = F.filter(sentences(F.col(text_col)), lambda s: F.trim(s) != "")
    padded = F.transform(parts, lambda s: padded_tokens(s, pattern))
    pieces = F.flatten(
        F.transform(
            F.filter(padded, lambda t: F.size(t) > 0),
            lambda t: F.transform(
                F.sequence(F.lit(0), F.ceil(F.size(t) / size).cast("int") - 1),
                lambda i: F.slice(t, i * size + 1, F.lit(size)),
            ),
        )
    )
    cut = files.select(
        id_col,
        *keep,
        F.transform(
            pieces,
            lambda t: F.struct(
                F.size(t).cast("bigint").alias("n"), F.rtrim(F.array_join(t, ""), F.lit(BLANKS)).alias("text")
            ),
        ).alias("_s"),
    )
    counted = cut.select(id_col, *keep, "_s", F.transform("_s", lambda p: p["n"]).alias("_n"))
    # The fold carries numbers alone: where the open window begins, the sentence it has
    # reached and its tokens. Closing it finds how many trailing sentences to repeat.
    trailing = f"""aggregate(reverse(slice(_n, cast(acc.first + 1 as int), cast(acc.i - acc.first as int))),
          named_struct('n', 0L, 'kept', 0L, 'open', true),
          (t, n) -> if(t.open and t.n + n <= {overlap},
              named_struct('n', t.n + n, 'kept', t.kept + 1, 'open', true),
              named_struct('n', t.n, 'kept', t.kept, 'open', false)))"""
    now = "array(named_struct('n', acc.n, 'first', acc.first, 'len', acc.i - acc.first))"
    folded = emitting_fold(
        "_n",
        {"first": "0L", "i": "0L", "n": "0L"},
        f"""if(acc.n > 0 and acc.n + u > {size},
               transform(array({trailing}), t -> named_struct(
                   'first', acc.i - t.kept, 'i', acc.i + 1, 'n', t.n + u, 'done', concat(acc.done, {now})))[0],
               named_struct('first', acc.first, 'i', acc.i + 1, 'n', acc.n + u, 'done', acc.done))""",
        "struct<n: bigint, first: bigint, len: bigint>",
        f"concat(acc.done, {now})",
    )

    def window(w: Column) -> Column:
        held = F.slice("_s", (w["first"] + 1).cast("int"), w["len"].cast("int"))
        text = F.array_join(F.transform(held, lambda p: p["text"]), " ")
        return F.struct(w["n"].alias("n"), text.alias("text"))

    windows = F.when(F.size("_n") > 0, F.transform(folded, window))
    return counted.select(id_col, *keep, F.posexplode(windows).alias("win", "w")).select(
        id_col, *keep, F.col("win").cast("bigint").alias("win"), F.col("w.n").alias("n_tokens"), "w.text"
    )
