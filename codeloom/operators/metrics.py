"""Text metrics between a prediction and a reference, row by row, without shuffles."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.functions.binding import bind

MAX_ORDER = 4
ROUGE_TOKEN = r"[a-z0-9]+"
# Limits of the block-shift search.
MAX_SHIFT_SIZE = 10
MAX_SHIFT_DISTANCE = 50
# Cells of distance tables worked on together.
CELLS = 1 << 21
# Cells of the tables of pairs worked on together; an operation on few costs as much as on many.
GROUP_CELLS = 1 << 25
# Moves of a pair measured at first, then twice as many each time; steps back through pairs between looks at who is done.
AT_FIRST = 2
STEPS = 8


def bleu_tokens(text: Column) -> Column:
    """Words and marks: marks are set apart, dots and commas only off digits, and a
    dash only behind a digit.
    """
    # The rules of the 13a tokenizer.
    rules = [
        (r"([\{-~\[-` -&\(-\+:-@/])", " $1 "),
        (r"([^0-9])([.,])", "$1 $2 "),
        (r"([.,])([^0-9])", " $1 $2"),
        (r"([0-9])(-)", "$1 $2 "),
    ]
    plain = F.replace(F.replace(text, F.lit("-\n"), F.lit("")), F.lit("\n"), F.lit(" "))
    out = F.concat(F.lit(" "), plain, F.lit(" "))
    for pattern, put in rules:
        out = F.regexp_replace(out, pattern, put)
    return F.filter(F.split(out, r"\s+"), lambda t: t != "")


def clipped_matches(left: Column, right: Column) -> Column:
    """Common elements of two arrays, each counted as often as both hold it.

    Both sides are sorted together, an element's copies of the left before those of the
    right, and read once: a right copy takes a left one of the same element, if one is left.
    """

    def of(values: Column, side: int) -> Column:
        return F.transform(values, lambda v: F.struct(v.alias("v"), F.lit(side).alias("side")))

    def read(state: Column, item: Column) -> Column:
        same = item["v"].eqNullSafe(state["v"])
        free = F.when(same, state["free"]).otherwise(F.lit(0))
        taken = (item["side"] == 1) & (free > 0)
        step = F.when(item["side"] == 0, free + 1).when(taken, free - 1).otherwise(free)
        return F.struct(item["v"].alias("v"), step.alias("free"), (state["found"] + taken.cast("int")).alias("found"))

    both = F.array_sort(F.concat(of(left, 0), of(right, 1)))
    start = F.struct(F.lit(None).cast("string").alias("v"), F.lit(0).alias("free"), F.lit(0).alias("found"))
    return F.aggregate(both, start, read, lambda s: s["found"])


def ngram_matches(tokens: list[np.ndarray], sizes: list[np.ndarray]) -> np.ndarray:
    """Clipped n-gram matches, a line for each order, of pairs: the numbers of all tokens of either side,
    and how many of them each pair has. N-grams are numbered from the ones a word shorter."""
    code = np.concatenate(tokens).astype(np.int64)
    n_pairs, n_words = len(sizes[0]), int(code.max(initial=0)) + 1
    pair = np.concatenate([np.repeat(np.arange(n_pairs), n) for n in sizes])
    right = np.repeat([False, True], [len(t) for t in tokens])
    ends = np.cumsum(np.concatenate(sizes))
    left = np.repeat(ends, np.concatenate(sizes)) - np.arange(len(code))
    out = np.zeros((MAX_ORDER, n_pairs), np.int32)
    at, gram = np.arange(len(code)), pair
    for order in range(1, MAX_ORDER + 1):
        on = left[at] >= order
        at = at[on]
        known, gram = np.unique(gram[on] * n_words + code[at + order - 1], return_inverse=True)
        counts = [np.bincount(gram[side], minlength=len(known)) for side in (~right[at], right[at])]
        of_pair = np.empty(len(known), np.int64)
        of_pair[gram] = pair[at]
        out[order - 1] = np.bincount(of_pair, np.minimum(*counts), minlength=n_pairs)
    return out


_COUNTS = T.StructType([T.StructField(n, T.IntegerType()) for n in ("pred_len", "ref_len", *(f"m{n}" for n in range(1, MAX_ORDER + 1)))])


@F.arrow_udf(_COUNTS)
def _matched_tokens(prediction: pa.Array, reference: pa.Array) -> pa.Array:
    lengths = [side.value_lengths() for side in (prediction, reference)]
    flat = [side.flatten() for side in (prediction, reference)]
    codes = pa.concat_arrays(flat).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    matches = ngram_matches(
        [codes[: len(flat[0])], codes[len(flat[0]) :]], [n.fill_null(0).to_numpy(zero_copy_only=False) for n in lengths]
    )
    columns = [n.cast(pa.int32()) for n in lengths] + [pa.array(m) for m in matches]
    return pa.StructArray.from_arrays(columns, names=_COUNTS.names)


def bleu_counts(prediction: Column, reference: Column) -> Column:
    """(pred_len, ref_len, m1..m4): lengths and clipped n-gram matches, counted for the rows of an Arrow
    batch together."""
    return _matched_tokens(bleu_tokens(prediction), bleu_tokens(reference))


def bleu_score(counts: Column) -> Column:
    """Geometric mean of the n-gram precisions, times the brevity penalty; no smoothing."""

    def score(c: Column) -> Column:
        orders = range(1, MAX_ORDER + 1)
        logs = sum(F.log(c[f"m{n}"] / (c["pred_len"] - (n - 1))) for n in orders) / MAX_ORDER
        penalty = F.when(c["pred_len"] > c["ref_len"], F.lit(1.0)).otherwise(
            F.exp(1 - c["ref_len"] / c["pred_len"])
        )
        all_match = F.least(*[c[f"m{n}"] for n in orders]) > 0
        return F.when(all_match, penalty * F.exp(logs)).otherwise(F.lit(0.0))

    return bind(counts, score)


def pooled_bleu(counts: Column) -> Column:
    """The score of a group of pairs as one text: an aggregate of ``bleu_counts``, whose lengths and
    matches add up, in any order and from any parts of the group. Null for a group without counts."""
    orders = range(1, MAX_ORDER + 1)
    found = [F.sum(counts[f"m{n}"]) for n in orders]
    all_grams = [F.sum(F.greatest(counts["pred_len"] - (n - 1), F.lit(0))) for n in orders]
    pred_len, ref_len = F.sum(counts["pred_len"]), F.sum(counts["ref_len"])
    logs = sum(F.log(m / n) for m, n in zip(found, all_grams, strict=True)) / MAX_ORDER
    penalty = F.when(pred_len > ref_len, F.lit(1.0)).otherwise(F.exp(1 - ref_len / pred_len))
    return F.when(F.least(*found) > 0, penalty * F.exp(logs)).when(F.count(counts["pred_len"]) > 0, F.lit(0.0))


def rouge_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({ROUGE_TOKEN})"), F.lit(1))


def _lcs_length(a, b) -> int:
    """Length of the longest common subsequence.

    One machine word per 64 elements: a row of the table is an integer whose zero
    bits are the positions where the length grows.
    """
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & where.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def subsequence_f_score(prediction, reference) -> float:
    """F-score of the longest common subsequence of two token lists."""
    lcs = _lcs_length(prediction, reference)
    if not lcs:
        return 0.0
    precision, recall = lcs / len(prediction), lcs / len(reference)
    return 2.0 * precision * recall / (precision + recall)


@F.pandas_udf(T.DoubleType())
def _subsequence_scores(prediction: pd.Series, reference: pd.Series) -> pd.Series:
    return pd.Series([subsequence_f_score(p, r) for p, r in zip(prediction, reference)], dtype="float64")


def rouge_l(prediction: Column, reference: Column) -> Column:
    return _subsequence_scores(rouge_tokens(prediction), rouge_tokens(reference))


def ter_words(text: Column) -> Column:
    """Lower-cased words between blanks."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != "")


def word_edits(left: Column, right: Column) -> Column:
    """Word edit distance.

    Each distinct word of the pair becomes one character, its number in the pair's
    vocabulary, so the built-in string distance counts words.
    """

    def coded(vocabulary: Column, words: Column) -> Column:
        return F.array_join(
            F.transform(
                words,
                lambda w: F.decode(
                    F.unhex(F.lpad(F.hex(F.array_position(vocabulary, w) + 0xFFFF), 8, "0")), "UTF-32"
                ),
            ),
            "",
        )

    return bind(
        F.array_distinct(F.concat(left, right)),
        lambda v: F.levenshtein(coded(v, left), coded(v, right)),
    ).cast("bigint")


class _Distances:
    """Word edit distances to one reference, a machine word per 64 reference words.

    A column of the distance table is kept as two integers, of the rows where it
    grows and where it falls. Columns after each prefix of a hypothesis are kept,
    so that a variant is measured from its first changed word on.
    """

    def __init__(self, ref: list):
        self.size = len(ref)
        self.full = (1 << self.size) - 1
        self.top = 1 << (self.size - 1) if ref else 0
        self.where: dict = {}
        for j, word in enumerate(ref):
            self.where[word] = self.where.get(word, 0) | (1 << j)
        self.start = (self.full, 0, self.size)

    def step(self, column: tuple[int, int, int], word) -> tuple[int, int, int]:
        grows, falls, score = column
        match = self.where.get(word, 0)
        keeps = (((match & grows) + grows) ^ grows) | match | falls
        up = falls | ~(keeps | grows) & self.full
        down = grows & keeps
        if up & self.top:
            score += 1
        elif down & self.top:
            score -= 1
        up = ((up << 1) | 1) & self.full
        down = (down << 1) & self.full
        return down | ~(keeps | up) & self.full, up & keeps, score

    def columns(self, hyp: list) -> list[tuple[int, int, int]]:
        out = [self.start]
        for word in hyp:
            out.append(self.step(out[-1], word))
        return out

    def __call__(self, hyp: list, column: tuple[int, int, int] | None = None) -> int:
        if not self.size:
            return len(hyp)
        column = column or self.start
        for word in hyp:
            column = self.step(column, word)
        return column[2]


def _cell(columns: list[tuple[int, int, int]], i: int, j: int) -> int:
    """Distance of the first ``i`` hypothesis words to the first ``j`` reference words."""
    grows, falls, _ = columns[i]
    upto = (1 << j) - 1
    return i + (grows & upto).bit_count() - (falls & upto).bit_count()


def _aligned(hyp: list, ref: list, columns: list) -> tuple[list[bool], list[bool], list[int]]:
    """The words of either side that are in error, and for each reference word the
    hypothesis position it is aligned to, walking back through the columns.
    """
    i, j = len(hyp), len(ref)
    hyp_error, ref_error, at = [False] * i, [False] * j, [-1] * j
    here = _cell(columns, i, j)
    while i or j:
        if i and j and here == _cell(columns, i - 1, j - 1) + (hyp[i - 1] != ref[j - 1]):
            i, j = i - 1, j - 1
            hyp_error[i] = ref_error[j] = hyp[i] != ref[j]
            here -= hyp_error[i]
            at[j] = i
        elif i and here == _cell(columns, i - 1, j) + 1:
            i, here = i - 1, here - 1
            hyp_error[i] = True
        else:
            j, here = j - 1, here - 1
            ref_error[j] = True
            at[j] = i - 1
    return hyp_error, ref_error, at


def _possible_moves(hyp: list, ref: list, errors: tuple, max_size: int, max_distance: int) -> dict[int, list]:
    """By size, the moves (start, to) of blocks of wrong words that the reference has elsewhere,
    to where the reference has them. In order of start and place."""
    hyp_error, ref_error, at = errors
    positions: dict = {}
    for j, word in enumerate(ref):
        positions.setdefault(word, []).append(j)
    moves: dict[int, set] = {}
    for start in range(len(hyp)):
        for j in positions.get(hyp[start], ()):
            if abs(j - start) > max_distance:
                continue
            for size in range(1, min(max_size, len(hyp) - start, len(ref) - j) + 1):
                if hyp[start + size - 1] != ref[j + size - 1]:
                    break
                wrong = any(hyp_error[start : start + size]) and any(ref_error[j : j + size])
                if not wrong or start <= at[j] < start + size:
                    continue
                for i in range(j - 1, j + size):
                    to = at[i] + 1 if i >= 0 else 0
                    if not start <= to <= start + size:
                        moves.setdefault(size, set()).add((start, to))
    return {size: sorted(found) for size, found in sorted(moves.items(), reverse=True)}


def _table_rows(columns: list[tuple[int, int, int]], wanted: np.ndarray, size: int, kind: type) -> np.ndarray:
    """Rows of the distance table, after each wanted number of hypothesis words."""
    n_bytes = size // 8 + 1
    rows = np.empty((len(wanted), size + 1), kind)
    for r, i in enumerate(wanted.tolist()):
        grows, falls = (
            np.unpackbits(np.frombuffer(columns[i][side].to_bytes(n_bytes, "little"), np.uint8), bitorder="little")[:size]
            for side in (0, 1)
        )
        rows[r, 0] = i
        np.cumsum(grows.view(np.int8) - falls.view(np.int8), dtype=kind, out=rows[r, 1:])
        rows[r, 1:] += i
    return rows


def _edits_after(hyp: list, moves: list, size: int, costs: tuple, before: list, behind: list, width: int) -> np.ndarray:
    """Edits after each move of ``size`` words, all at once. Only the words between where a
    block was and where it goes are measured anew, from the table's rows before them;
    rows counted from the end give what is left behind them."""
    low = np.array([min(start, to) for start, to in moves])
    high = np.array([max(start + size, to) for start, to in moves])
    order = np.argsort(low - high, kind="stable")  # longest stretch first
    words = []
    for start, to in moves:
        block = hyp[start : start + size]
        words.append(block + hyp[to:start] if to < start else hyp[start + size : to] + block)
    ids, cost_of = costs
    kind = np.int16 if len(hyp) + width < 30_000 else np.int32
    longest = int((high - low).max())
    word_ids = np.array([[ids.get(w, 0) for w in ws] + [0] * (longest - len(ws)) for ws in words])
    out = np.empty(len(moves), np.int64)
    per_block = max(1, CELLS // (width + 1))
    for at in range(0, len(order), per_block):
        some = order[at : at + per_block]
        starts, which = np.unique(low[some], return_inverse=True)
        table = _table_rows(before, starts, width, kind)[which]
        lengths = (high - low)[some]
        slope = np.arange(width + 1, dtype=kind)
        for t in range(int(lengths[0])):
            n = int(np.searchsorted(-lengths, -t, "left"))
            old = table[:n]
            changed = cost_of[word_ids[some[:n], t]]
            changed += old[:, :-1]
            old += 1
            np.minimum(old[:, 1:], changed, out=old[:, 1:])
            old -= slope
            np.minimum.accumulate(old, axis=1, out=old)
            old += slope
        ends, which = np.unique(len(hyp) - high[some], return_inverse=True)
        out[some] = (table + _table_rows(behind, ends, width, kind)[which][:, ::-1]).min(axis=1)
    return out


def _best_shift(hyp: list, ref: list, costs: tuple, distance: _Distances, backward: _Distances, limits: tuple) -> list | None:
    """The block move that lowers the edit distance most, done. Equal gains go to the longer
    block, then to the one further left.
    """
    before, behind = distance.columns(hyp), backward.columns(hyp[::-1])
    edits = before[-1][2]
    moves = _possible_moves(hyp, ref, _aligned(hyp, ref, before), *limits)
    best_gain, best = 0, None
    for size, found in moves.items():
        # Taking out and putting back ``size`` words cannot save more than 2 * size.
        if 2 * size <= best_gain:
            break
        gains = edits - _edits_after(hyp, found, size, costs, before, behind, len(ref))
        if gains.max() > best_gain:
            best_gain = int(gains.max())
            best = (size, *found[int(gains.argmax())])
    return _moved(hyp, *best) if best else None


def _cut_and_put(hyp, size: int, start: int, to: int) -> list:
    """The parts of ``hyp`` in order, with ``size`` words from ``start`` put before word ``to``."""
    block = hyp[start : start + size]
    if to < start:
        return [hyp[:to], block, hyp[to:start], hyp[start + size :]]
    return [hyp[:start], hyp[start + size : to], block, hyp[to:]]


def _moved(hyp: list, size: int, start: int, to: int) -> list:
    return sum(_cut_and_put(hyp, size, start, to), [])


def translation_edits(
    hyp: list, ref: list, max_size: int = MAX_SHIFT_SIZE, max_distance: int = MAX_SHIFT_DISTANCE
) -> int:
    """Word edits, where moving a block counts as one. Blocks of at most ``max_size`` words
    move to words at most ``max_distance`` away, which are part of the published measure."""
    distance, backward = _Distances(ref), _Distances(ref[::-1])
    # Numbers of the reference's words, 0 for others, and what each costs beside each of them.
    ids = {word: i for i, word in enumerate(dict.fromkeys(ref), 1)}
    costs = ids, (np.arange(len(ids) + 1)[:, None] != np.array([ids[w] for w in ref])[None, :]).astype(np.int16)
    shifts = 0
    while ref and (moved := _best_shift(hyp, ref, costs, distance, backward, (max_size, max_distance))):
        hyp = moved
        shifts += 1
    return shifts + distance(hyp)


# --- block moves of many pairs at once: one numpy operation for all pairs, or for all their moves
#
# Columns of distance tables are kept as in ``_Distances``, as machine words (word, hypothesis words
# before, pair). Pairs that can't be bettered leave and others take their place, so that operations
# stay wide; tables are never spelled out: walks and minima are read from the bits.


_ONE, _TOP = np.uint64(1), np.uint64(63)


def _word_steps(grows: np.ndarray, falls: np.ndarray, match: np.ndarray, out: tuple = (None, None)) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``_Distances.step`` for many columns (word, column), and where the row before grows and falls to the new one.
    The new columns are written to ``out``, if that is given, which is not what is read."""
    both = match & grows
    total = np.add(both, grows, out=out[0])
    for w in range(1, len(total)):
        over = ~total[w - 1]
        over &= grows[w - 1]
        over |= both[w - 1]
        over >>= _TOP
        total[w] += over
    total ^= grows
    total |= match
    total |= falls
    up, down = total | grows, np.bitwise_and(grows, total, out=both)
    np.invert(up, out=up)
    up |= falls
    up_shifted, down_shifted = up << _ONE, down << _ONE
    up_shifted[0] |= _ONE
    if len(total) > 1:
        up_shifted[1:] |= up[:-1] >> _TOP
        down_shifted[1:] |= down[:-1] >> _TOP
    falls = np.bitwise_and(up_shifted, total, out=out[1])
    total |= up_shifted
    np.invert(total, out=total)
    total |= down_shifted
    return total, falls, up, down


def _words_of(same: np.ndarray, width: int) -> np.ndarray:
    """The last axis, of at most ``width`` machine words, as bits of them."""
    packed = np.packbits(same, axis=-1, bitorder="little")
    words = np.zeros((*same.shape[:-1], width), "<u8")
    words.view(np.uint8)[..., : packed.shape[-1]] = packed
    return words


class _Batch:
    """The edits of a batch of pairs, and how many of them are still to come."""

    def __init__(self, size: int):
        self.edits, self.open = [0] * size, 0


class _Pair:
    """A pair on its way. Words are numbers, the place in the reference of the first word equal to
    it counted from 1, or 0; ``where`` has the places of each number, and ``back`` those counted from
    the end, moved up so that the last place is the highest bit."""

    def __init__(self, batch: _Batch, at: int, hyp: list, ref: list):
        width = self.width = (len(ref) + 63) // 64
        ids = {word: i for i, word in enumerate(dict.fromkeys(ref), 1)}
        self.batch, self.at, self.shifts = batch, at, 0
        self.hyp = np.array([ids.get(w, 0) for w in hyp], np.int32)
        self.ref = np.array([ids[w] for w in ref], np.int32)
        same = np.zeros((len(ids) + 1, 64 * width), bool)
        same[self.ref, np.arange(len(ref))] = True
        self.where, self.back = _words_of(same, width), _words_of(same[:, ::-1], width)
        #: Where the first column grows: at all places, of ``back`` at those that are places of the reference.
        self.start = _words_of(np.arange(64 * width)[::-1] < len(ref), width)


def _columns_of(start: np.ndarray, match: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Columns (word, words before, pair), where they grow and fall, and where the rows between those of the
    first ``n`` pairs do."""
    width, size, n_all = match.shape
    grows, falls = np.empty((2, width, size + 1, n_all), np.uint64)
    up, down = np.empty((2, width, size, n), np.uint64)
    grows[:, 0], falls[:, 0] = start, 0
    for i in range(size):
        new = grows[:, i + 1], falls[:, i + 1]
        _, _, rises, sinks = _word_steps(grows[:, i], falls[:, i], match[:, i], new)
        up[:, i], down[:, i] = rises[:, :n], sinks[:, :n]
    return grows, falls, up, down


def _aligned_pairs(columns: tuple, match: np.ndarray, n_hyp: np.ndarray, n_ref: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_aligned`` for many pairs, which all walk back together."""
    grows, falls, up, down = columns
    width, size, n = match.shape
    height = 64 * width
    # Bits of a cell by the words before it: a step across, a word removed. Neither is a word inserted, as
    # before the first word of the hypothesis; before that of the reference there is a word more to remove at each.
    across, above = np.empty((2, width + 1, size + 1, n), np.uint64)
    across[0] = across[:, 0] = above[:, 0] = 0
    above[0, 1:], above[1:, 1:] = ~np.uint64(0), up
    # A cell is at most one more than the one across from it: that much it is where the words differ.
    steps = np.invert(falls[:, :-1], out=across[1:, 1:])
    steps &= up
    steps |= match
    steps |= grows[:, :-1] & ~down
    across, above, equal = (x.reshape(-1).view(np.int64) for x in (across, above, match))
    p, i, j = np.arange(n), n_hyp.copy(), n_ref + 63
    path = []
    while len(p):
        for _ in range(STEPS):
            bit, cell = j & 63, ((j >> 6) * (size + 1) + i) * n + p
            diagonal, stays = across.take(cell) >> bit & 1, above.take(cell) >> bit & 1
            path.append((p, i, j, 2 * diagonal + stays))
            i = i - (diagonal | stays)
            # Who has arrived goes on inserting nothing.
            j = np.maximum(j - (diagonal | stays ^ 1), 63)
        more = (i > 0) | (j > 63)
        p, i, j = p[more], i[more], j[more]
    p, i, j, kind = (np.concatenate(x) for x in zip(*path, strict=True))
    i, j = i - 1, j - 64
    diagonal, remove = np.flatnonzero(kind > 1), np.flatnonzero(kind == 1)
    insert = np.flatnonzero((kind == 0) & (j >= 0))
    hyp_error, ref_error, at = np.zeros((n, size), bool), np.zeros((n, height), bool), np.full((n, height), -1)
    q, row, left = p[diagonal], i[diagonal], j[diagonal]
    wrong = (equal.take(((left >> 6) * size + row) * n + q) >> (left & 63) & 1) == 0
    hyp_error[q, row], ref_error[q, left], at[q, left] = wrong, wrong, row
    hyp_error[p[remove], i[remove]] = True
    q, left = p[insert], j[insert]
    ref_error[q, left], at[q, left] = True, i[insert]
    return hyp_error, ref_error, at


def _moves_of_pairs(hyp: np.ndarray, ref: np.ndarray, match: np.ndarray, errors: tuple, max_size: int, max_distance: int) -> np.ndarray:
    """``_possible_moves`` for many pairs: rows (pair, size, start, to), each once, the longest blocks of a
    pair first, then in order of start and place."""
    width, size_of_hyp, n = match.shape
    hyp_errors, ref_errors = (np.pad(np.cumsum(e, axis=1, dtype=np.int32), ((0, 0), (1, 0))) for e in errors[:2])
    at = errors[2]
    near = np.abs(np.arange(size_of_hyp)[:, None] - np.arange(64 * width)[None, :]) <= max_distance
    bits = (match & _words_of(near, width).T[:, :, None]).reshape(-1)
    cells = np.flatnonzero(bits)
    bits = bits[cells]
    parts = []
    while len(cells):
        lowest = bits & (~bits + _ONE)
        parts.append((cells, np.bitwise_count(lowest - _ONE)))
        bits ^= lowest
        cells, bits = cells[bits != 0], bits[bits != 0]
    found = [np.empty((0, 4), np.int64)]
    if parts:
        cells, j = np.concatenate([c for c, _ in parts]), np.concatenate([b for _, b in parts]).astype(np.int64)
        p, start = cells % n, cells // n % size_of_hyp
        j += cells // (n * size_of_hyp) * 64
    for size in range(1, max_size + 1 if parts else 1):
        if size > 1:
            goes_on = (start + size <= hyp.shape[1]) & (j + size <= ref.shape[1])
            p, start, j = p[goes_on], start[goes_on], j[goes_on]
            equal = hyp[p, start + size - 1] == ref[p, j + size - 1]
            p, start, j = p[equal], start[equal], j[equal]
        if not len(p):
            break
        wrong = (hyp_errors[p, start + size] > hyp_errors[p, start]) & (ref_errors[p, j + size] > ref_errors[p, j])
        here = (start <= at[p, j]) & (at[p, j] < start + size)
        q, s, k = (x[wrong & ~here] for x in (p, start, j))
        for i in range(-1, size):
            to = np.where(k + i >= 0, at[q, np.maximum(k + i, 0)] + 1, 0)
            moves = (to < s) | (to > s + size)
            found.append(np.stack([q[moves], np.full(moves.sum(), size), s[moves], to[moves]], axis=1))
    every = np.concatenate(found)
    keys = ((every[:, 0] * (max_size + 1) + max_size - every[:, 1]) * (size_of_hyp + 1) + every[:, 2]) * (size_of_hyp + 1) + every[:, 3]
    return every[np.unique(keys, return_index=True)[1]]


def _quads() -> tuple[np.ndarray, np.ndarray]:
    """For four places of two columns that meet, what they add to the sum of both and the least sum on
    the way: by the bits where the one grows and falls, and the other, whose places run the other way."""
    bits = np.arange(1 << 16)
    one = [(bits >> k & 1) - (bits >> 4 + k & 1) - (bits >> 11 - k & 1) + (bits >> 15 - k & 1) for k in range(4)]
    sums = np.cumsum(one, axis=0)
    return sums[-1].astype(np.int8), sums.min(axis=0).astype(np.int8)


_QUADS = _quads()


def _least_sums(before: tuple, n_before: np.ndarray, behind: tuple, n_behind: np.ndarray) -> np.ndarray:
    """The edits of hypotheses from columns after their beginnings and, backward, after their ends: the
    least sum of both over all places where the reference may be cut."""
    added, least = _QUADS

    def bytes_of(words: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(words.T).view(np.uint8)

    # Past the reference the first only grows and the other does nothing, so all places may count.
    front = bytes_of(before[0]), bytes_of(before[1])
    rear = bytes_of(behind[0])[:, ::-1], bytes_of(behind[1])[:, ::-1]
    index = np.empty((len(n_before), 2 * front[0].shape[1]), np.uint16)
    for half in (0, 1):
        low, high = (lambda b: b & np.uint8(15)), (lambda b: b >> np.uint8(4))
        of_front, of_rear = (low, high) if half == 0 else (high, low)
        first = of_front(front[0]) | of_front(front[1]) << np.uint8(4)
        second = of_rear(rear[0]) | of_rear(rear[1]) << np.uint8(4)
        index[:, half::2] = first | second.astype(np.uint16) << np.uint16(8)
    step = added[index]
    sums = np.cumsum(step, axis=1, dtype=np.int16)
    sums -= step
    sums += least[index]
    whole = np.bitwise_count(behind[0]).sum(axis=0, dtype=np.int64) - np.bitwise_count(behind[1]).sum(axis=0, dtype=np.int64)
    return n_before + n_behind + whole + np.minimum(sums.min(axis=1), 0)


def _taken(table: np.ndarray, rows: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Machine words (word, place) of rows of pairs."""
    width, size, n = table.shape
    return table.reshape(width, size * n).take(rows * n + p, axis=1)


def _gain_bounds(moves: np.ndarray, now: np.ndarray, match: np.ndarray, both: tuple, n_hyp: np.ndarray) -> np.ndarray:
    """What a move can save at most. A block put in saves a word's edit for each of its words at most, beyond
    what taking it out saves; taken out, beyond what putting it in saves."""
    n = len(n_hyp)
    # Moves of a block stand together.
    new = np.append(True, (moves[1:, :3] != moves[:-1, :3]).any(axis=1))
    p, size, start = moves[new, :3].T
    left = n_hyp[p] - start - size
    out = _least_sums(tuple(_taken(b, start, p) for b in both), start, tuple(_taken(b, left, n + p) for b in both), left)
    bounds = (now[p] - out + size)[np.cumsum(new) - 1]
    # Where one edit is all there is to save, the move itself is measured.
    some = np.flatnonzero(bounds > 1)
    p, size, start, to = moves[some].T
    grows, falls = (_taken(b, to, p) for b in both)
    for t in range(int(size.max(initial=0))):
        on = np.flatnonzero(size > t)
        grows[:, on], falls[:, on] = _word_steps(grows[:, on], falls[:, on], _taken(match, start[on] + t, p[on]))[:2]
    left = n_hyp[p] - to
    put = _least_sums((grows, falls), to + size, tuple(_taken(b, left, n + p) for b in both), left)
    bounds[some] = np.minimum(bounds[some], now[p] - put + size)
    return bounds


def _edits_after_moves(moves: np.ndarray, match: np.ndarray, both: tuple, n_hyp: np.ndarray) -> np.ndarray:
    """``_edits_after`` for moves (pair, size, start, to) of many pairs. The stretch between where a block was and
    where it goes is measured from both of its ends at once, which meet in the middle."""
    n, (p, size, start, to) = len(n_hyp), moves.T
    low, high = np.minimum(start, to), np.maximum(start + size, to)
    length = high - low
    # What stands first in the new order of the stretch, how much of it, and what follows.
    back = to < start
    head, n_head, tail = np.where(back, start, start + size), np.where(back, size, to - start - size), np.where(back, to, start)
    rear = length // 2
    steps = np.concatenate([length - rear, rear])
    order = np.argsort(-steps, kind="stable")  # longest first
    steps = steps[order]
    move, turned = order % len(moves), order >= len(moves)
    pair = np.where(turned, n, 0) + p[move]
    done = np.where(turned, n_hyp[p[move]] - high[move], low[move])
    grows, falls = (_taken(b, done, pair) for b in both)
    # The words of all steps, those of a step side by side.
    n_on = np.searchsorted(-steps, -np.arange(int(steps.max(initial=0))), "left")
    lane = np.concatenate([np.arange(k) for k in n_on]) if len(n_on) else np.empty(0, np.int64)
    k = np.repeat(np.arange(len(n_on)), n_on)
    move, turned, pair = move[lane], turned[lane], pair[lane]
    k = np.where(turned, length[move] - 1 - k, k)
    at = np.where(k < n_head[move], head[move] + k, tail[move] + k - n_head[move])
    words = _taken(match, np.where(turned, n_hyp[p[move]] - 1 - at, at), pair)
    begin = 0
    for n_step in n_on.tolist():
        grows[:, :n_step], falls[:, :n_step] = _word_steps(grows[:, :n_step], falls[:, :n_step], words[:, begin : begin + n_step])[:2]
        begin += n_step
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    front, behind = (tuple(b[:, half] for b in (grows, falls)) for half in (place[: len(moves)], place[len(moves) :]))
    return _least_sums(front, high - rear, behind, n_hyp[p] - high + rear)


def _best_moves(moves: np.ndarray, bounds: np.ndarray, n: int, gains_of) -> np.ndarray:
    """Numbers of the moves, one a pair at most, that gain most, of equal gains the first. Those that may gain
    most are measured first, a few of each pair at a time, and others only as long as their bound lets them be
    better: one that gains all it may ends the search among those behind it."""
    gain, best = np.zeros(n, np.int64), np.full(n, len(moves))
    p = moves[:, 0]
    # In order of pairs, in these of bounds.
    open_ = np.flatnonzero(bounds > 0)
    open_ = open_[np.lexsort((open_, -bounds[open_], p[open_]))]
    at_once = AT_FIRST
    while len(open_):
        new = np.append(True, p[open_[1:]] != p[open_[:-1]])
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        top = (np.arange(len(open_)) < first + at_once) & (bounds[open_] == bounds[open_[first]])
        at_once *= 2
        some = open_[top]
        gains = gains_of(some)
        for_pair = np.lexsort((some, -gains, p[some]))
        for_pair = for_pair[np.unique(p[some][for_pair], return_index=True)[1]]
        q, g, o = p[some[for_pair]], gains[for_pair], some[for_pair]
        better = (g > gain[q]) | (g == gain[q]) & (g > 0) & (o < best[q])
        gain[q[better]], best[q[better]] = g[better], o[better]
        open_ = open_[~top]
        of = p[open_]
        open_ = open_[(bounds[open_] > gain[of]) | (bounds[open_] == gain[of]) & (open_ < best[of])]
    return best[best < len(moves)]


def _stacked(tables: list[np.ndarray], width: int, behind: bool) -> np.ndarray:
    """Rows of machine words (word, row) of all pairs, filled up with none before or behind the given ones."""
    out = np.zeros((width, sum(len(t) for t in tables)), np.uint64)
    at = 0
    for table in tables:
        n, own = table.shape
        out[width - own if behind else 0 : width if behind else own, at : at + n] = table.T
        at += n
    return out


def _round(pairs: list[_Pair], max_size: int, max_distance: int) -> tuple[np.ndarray, np.ndarray]:
    """The edits of each pair, and the best move (pair, size, start, to) of those that have one."""
    n_hyp, n_ref = (np.array([len(x) for x in side]) for side in ([p.hyp for p in pairs], [p.ref for p in pairs]))
    n, size = len(pairs), int(n_hyp.max())
    # What stands behind the last word of either side is equal to nothing.
    hyp, ref = np.zeros((n, size), np.int32), np.full((n, int(n_ref.max())), -1, np.int32)
    hyp[np.arange(size) < n_hyp[:, None]] = np.concatenate([p.hyp for p in pairs])
    ref[np.arange(ref.shape[1]) < n_ref[:, None]] = np.concatenate([p.ref for p in pairs])
    turned = np.zeros_like(hyp)
    turned[np.arange(size) < n_hyp[:, None]] = np.concatenate([p.hyp[::-1] for p in pairs])
    first = np.cumsum([0] + [len(p.where) for p in pairs[:-1]])[:, None]
    width = max(p.where.shape[1] for p in pairs)
    match, match_back = (
        _stacked(tables, width, way).take((first + words).T, axis=1)
        for tables, words, way in (([p.where for p in pairs], hyp, False), ([p.back for p in pairs], turned, True))
    )
    # Pairs from their ends follow the pairs.
    match = np.concatenate([match, match_back], axis=2)
    start = np.concatenate([np.full((width, n), ~np.uint64(0)), _stacked([p.start[None, :] for p in pairs], width, True)], axis=1)
    columns = _columns_of(start, match, n)
    both = columns[:2]
    alone = np.arange(n)
    nothing = np.zeros(n, np.int64)
    edits = _least_sums(tuple(_taken(b, nothing, alone) for b in both), nothing, tuple(_taken(b, n_hyp, n + alone) for b in both), n_hyp)
    forward = np.ascontiguousarray(match[:, :, :n])
    errors = _aligned_pairs(tuple(x[:, :, :n] for x in columns), forward, n_hyp, n_ref)
    moves = _moves_of_pairs(hyp, ref, forward, errors, max_size, max_distance)
    at_once = max(1, CELLS // (256 * width))
    parts = [slice(at, at + at_once) for at in range(0, len(moves), at_once)]
    bounds = [_gain_bounds(moves[part], edits, match, both, n_hyp) for part in parts]

    def gains_of(some: np.ndarray) -> np.ndarray:
        parts = [moves[some[at : at + at_once]] for at in range(0, len(some), at_once)]
        return np.concatenate([edits[part[:, 0]] - _edits_after_moves(part, match, both, n_hyp) for part in parts])

    return edits, moves[_best_moves(moves, np.concatenate(bounds), n, gains_of)] if len(moves) else moves


def _done(batches: deque[_Batch]) -> Iterator[list[int]]:
    while batches and not batches[0].open:
        yield batches.popleft().edits


def translation_edits_of_batches(
    batches: Iterable[tuple[list, list]], max_size: int = MAX_SHIFT_SIZE, max_distance: int = MAX_SHIFT_DISTANCE
) -> Iterator[list[int]]:
    """``translation_edits`` of the pairs of each batch, in order. Pairs of similar length go together, as many as
    have ``GROUP_CELLS`` cells in their tables, and one that is done makes room for the next, of a batch behind
    if need be; a pair with far more than most is worked out alone. Batches are read when no pair is left that
    waits, so few are open."""
    coming = iter(batches)
    open_: deque[_Batch] = deque()
    waiting: list[_Pair] = []
    going: list[_Pair] = []
    more = True
    while more or going:
        cells = 0
        # Nothing waits here.
        while more and cells < GROUP_CELLS:
            if (batch := next(coming, None)) is None:
                more = False
                break
            open_.append(_Batch(len(batch[0])))
            for i, (hyp, ref) in enumerate(zip(*batch, strict=True)):
                size = (len(hyp) + 1) * (len(ref) + 1)
                if not len(hyp) or not len(ref):
                    open_[-1].edits[i] = len(hyp) + len(ref)
                elif size > GROUP_CELLS // 64:
                    open_[-1].edits[i] = translation_edits(list(hyp), list(ref), max_size, max_distance)
                else:
                    waiting.append(_Pair(open_[-1], i, hyp, ref))
                    open_[-1].open += 1
                cells += size
            yield from _done(open_)
        waiting.sort(key=lambda p: (p.width, len(p.hyp)), reverse=True)
        while waiting or (going and not more):
            size = max((len(p.hyp) for p in going), default=0), max((p.width for p in going), default=0)
            while waiting:
                larger = max(size[0], len(waiting[-1].hyp)), max(size[1], waiting[-1].width)
                if going and (len(going) + 1) * (larger[0] + 1) * 64 * larger[1] > GROUP_CELLS:
                    break
                going.append(waiting.pop())
                size = larger
            if more and not waiting:
                break
            edits, moves = _round(going, max_size, max_distance)
            moved = np.zeros(len(going), bool)
            moved[moves[:, 0]] = True
            for pair, n in ((going[p], edits[p]) for p in np.flatnonzero(~moved)):
                pair.batch.edits[pair.at] = pair.shifts + int(n)
                pair.batch.open -= 1
            following = []
            for p, *move in moves.tolist():
                pair = going[p]
                pair.hyp = np.concatenate(_cut_and_put(pair.hyp, *move))
                pair.shifts += 1
                following.append(pair)
            going = following
        yield from _done(open_)


def translation_edits_of_pairs(
    hyps: list[list], refs: list[list], max_size: int = MAX_SHIFT_SIZE, max_distance: int = MAX_SHIFT_DISTANCE
) -> list[int]:
    """``translation_edits`` of many pairs."""
    return next(translation_edits_of_batches([(hyps, refs)], max_size, max_distance))


def rate(edits: float, ref_len: int) -> float:
    """Edits per reference word, times 100. An empty reference gives 100 if there
    are edits and else 0.
    """
    if ref_len:
        return 100.0 * edits / ref_len
    return 100.0 if edits else 0.0


def ter(
    prediction: Column, reference: Column, max_size: int = MAX_SHIFT_SIZE, max_distance: int = MAX_SHIFT_DISTANCE
) -> Column:
    """As ``rate``, with block moves. The limits of a move are those of the published
    measure; others give another measure."""

    @F.pandas_udf(T.DoubleType())
    def shifted_edit_rates(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        sizes: deque[list[int]] = deque()

        def words() -> Iterator[tuple[list, list]]:
            for pair in batches:
                hyps, refs = ([list(words) for words in side] for side in pair)
                sizes.append([len(r) for r in refs])
                yield hyps, refs

        for edits in translation_edits_of_batches(words(), max_size, max_distance):
            yield pd.Series([rate(e, n) for e, n in zip(edits, sizes.popleft(), strict=True)], dtype="float64")

    return shifted_edit_rates(ter_words(prediction), ter_words(reference))


def word_edit_rate(prediction: Column, reference: Column) -> Column:
    """As ``rate``, without block moves and without leaving the JVM."""
    pair = F.struct(ter_words(prediction).alias("p"), ter_words(reference).alias("r"))
    return bind(
        pair,
        lambda t: bind(
            word_edits(t["p"], t["r"]),
            lambda edits: F.when(F.size(t["r"]) > 0, 100.0 * edits / F.size(t["r"]))
            .when(edits > 0, F.lit(100.0))
            .otherwise(F.lit(0.0)),
        ),
    )


def bag_error_rate(prediction: Column, reference: Column) -> Column:
    """As ``rate``, of the words that either side has more than the other: what no moving
    of words can mend, so a lower bound of ``ter``.
    """
    pair = F.struct(ter_words(prediction).alias("p"), ter_words(reference).alias("r"))
    return bind(
        pair,
        lambda t: bind(
            F.greatest(F.size(t["p"]), F.size(t["r"])) - clipped_matches(t["p"], t["r"]),
            lambda edits: F.when(F.size(t["r"]) > 0, 100.0 * edits / F.size(t["r"]))
            .when(edits > 0, F.lit(100.0))
            .otherwise(F.lit(0.0)),
        ),
    )
