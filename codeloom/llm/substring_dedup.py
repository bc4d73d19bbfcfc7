"""Substring deduplication with an FM-index per shard.

A window is a run of words. Windows that may repeat are found by their minimizers: of the
shorter runs inside a window the one of least hash, which equal windows share. Stretches
around minimizers of two or more texts go to shards by minimizer. Each shard builds a
compressed FM-index over its stretches; every window of every stretch is searched backward
in it, which gives the smallest document that has the window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from codeloom.llm.common import map_rows, release_memory, small_batches
from codeloom.llm.fm_index import FMIndex
from codeloom.workspace import materialize

WINDOW = 13
#: Words of the runs that minimizers are chosen from.
RUN = 7
#: Stretches of a shard, about; those of one minimizer beyond it are split over shards.
SHARD = 20_000
#: Bytes of text worked on at a time.
BLOCK = 1 << 19
#: The id of rows without one: larger than any.
NO_ID = (1 << 63) - 1

BLANKS = b"\t\n\x0b\x0c\r "
POWERS = np.cumprod(np.full(256, 0x9E3779B97F4A7C15, np.uint64))
CODES = np.arange(1, 257, dtype=np.uint64)
CODES[list(BLANKS)] = 0


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of each text, and how many words each text has."""
    # A blank between texts keeps their words apart.
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    code = CODES[data]
    blank = code == 0
    heads = np.flatnonzero(~blank & np.append(True, blank[:-1]))
    ends = np.cumsum([len(t) + 1 for t in texts])
    upto = np.searchsorted(heads, ends)
    counts = np.diff(np.append(0, upto))
    if not len(heads):
        return np.empty(0, np.uint64), counts
    step = np.arange(len(data)) - np.repeat(np.append(0, heads), np.diff(np.concatenate(([0], heads, [len(data)]))))
    return np.add.reduceat(code * POWERS[step & 255] * (1 + (step >> 8).astype(np.uint64)), heads), counts


def minimizers(texts: list[bytes], window: int, run: int) -> tuple[np.ndarray, ...]:
    """(text, first window, windows, hash) of each minimizer: successive windows of a text
    that share one, with the hash of its run of words."""
    words, counts = word_hashes(texts)
    if len(words) < window:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.int64))
    owner = np.repeat(np.arange(len(texts)), counts)
    begins = np.concatenate(([0], np.cumsum(counts)[:-1]))
    n = len(words) - run + 1
    mixed = np.zeros(n, np.uint64)
    for j in range(run):
        mixed = (mixed ^ words[j : j + n]) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
    across = window - run + 1
    starts = np.arange(len(words) - window + 1)
    least = np.lib.stride_tricks.sliding_window_view(mixed, across).argmin(axis=1) + starts
    inside = owner[: len(starts)] == owner[window - 1 :]
    starts, least = starts[inside], least[inside]
    if not len(starts):
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.int64))
    whose = owner[starts]
    change = np.flatnonzero(np.append(True, (least[1:] != least[:-1]) | (whose[1:] != whose[:-1])))
    sizes = np.diff(np.append(change, len(starts)))
    return whose[change], starts[change] - begins[whose[change]], sizes, mixed[least[change]].view(np.int64)


def _blocks(texts: list[bytes | None]) -> Iterator[tuple[int, list[bytes]]]:
    low = 0
    while low < len(texts):
        high, size = low, 0
        while high < len(texts) and (high == low or size + len(texts[high] or b"") < BLOCK):
            size += len(texts[high] or b"")
            high += 1
        yield low, [t or b"" for t in texts[low:high]]
        low = high


POSTING = "hash long, d1 long, known boolean"


def _postings(window: int, run: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Different minimizers of each text. Of one that a batch has in three or more texts, two
    have to meet those of other batches; the rest are ``known`` to be shared."""
    schema = to_arrow_schema(T.StructType.fromDDL(POSTING))

    def run_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d1 = batch.column(0).to_numpy()
            pairs: list[np.ndarray] = []
            for low, block in _blocks(batch.column(1).cast(pa.binary()).to_pylist()):
                whose, _, _, hashes = minimizers(block, window, run)
                pairs.append(np.stack((hashes, d1[low + whose]), axis=1))
            found = np.unique(np.concatenate(pairs), axis=0) if pairs else np.empty((0, 2), np.int64)
            first = np.flatnonzero(np.append(True, found[1:, 0] != found[:-1, 0])) if len(found) else np.empty(0, np.int64)
            place = np.arange(len(found)) - np.repeat(first, np.diff(np.append(first, len(found))))
            columns = [pa.array(found[:, 0]), pa.array(found[:, 1]), pa.array(place >= 2)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)
            del d1, pairs, found, columns, batch
        release_memory()

    return run_task


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of postings in order of (hash, d1) those whose hash two texts have, and known ones."""

    def chosen(table: np.ndarray, known: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.append(True, table[1:, 0] != table[:-1, 0])) if len(table) else np.empty(0, np.int64)
        ends = np.append(first[1:], len(table))
        shared = table[first, 1] != table[ends - 1, 1] if len(table) else np.empty(0, bool)
        keep = np.repeat(shared, ends - first) | known
        return pa.RecordBatch.from_arrays([pa.array(table[keep, 0]), pa.array(table[keep, 1])], names=["hash", "d1"])

    held, held_known = np.empty((0, 2), np.int64), np.empty(0, bool)
    for batch in batches:
        rows = np.stack([batch.column(i).to_numpy() for i in (0, 1)], axis=1)
        rows = np.concatenate((held, rows))
        known = np.concatenate((held_known, batch.column(2).to_numpy(zero_copy_only=False).astype(bool)))
        # The last hash may go on in the next batch.
        whole = int(np.searchsorted(rows[:, 0], rows[-1, 0])) if len(rows) else 0
        yield chosen(rows[:whole], known[:whole])
        held, held_known = rows[whole:], known[whole:]
    yield chosen(held, held_known)
    release_memory()


def _keyed(docs: DataFrame, doc_id: str, text: str, keep: list[str]) -> DataFrame:
    """Rows with two hashes of the text, which together tell texts apart."""
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    kept = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(None).cast("int").alias("none"))
    return docs.select(
        F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(NO_ID)).alias("id"),
        F.xxhash64(value).alias("d1"), F.xxhash64(F.lit(7), value).alias("d2"),
        F.col(f"`{text}`").alias("text"), kept.alias("kept"),
    )


def _shared(rows: DataFrame, window: int, run: int, shard: int) -> DataFrame:
    """(d1, shared): for texts that share a minimizer with another text, the hashes they
    share and over how many shards each is split.

    Postings meet by hash in one shuffle. A batch sends two postings of a hash at most to
    where it meets, the others anywhere, so a frequent hash is a few rows a batch there.
    """
    postings = rows.select("d1", "text").where("text IS NOT NULL").mapInArrow(_postings(window, run), POSTING)
    target = F.when(F.col("known"), F.xxhash64("hash", "d1")).otherwise(F.col("hash"))
    met = postings.repartition(target).sortWithinPartitions("hash", "d1").mapInArrow(_meeting, "hash long, d1 long")
    met = materialize(met, "shared")
    hot = met.groupBy("hash").count().where(F.col("count") > shard)
    splits = hot.select("hash", F.ceil(F.col("count") / shard).alias("splits"))
    placed = met.join(splits, "hash", "left").withColumn("splits", F.coalesce("splits", F.lit(1)).cast("long"))
    return placed.groupBy("d1").agg(F.collect_set(F.struct("hash", "splits")).alias("shared"))


def _tell(window: int) -> Callable[[], Callable]:
    """Number of words and the hash of all words."""

    def start() -> Callable:
        def compute(texts: list) -> dict:
            words = [(t or b"").split() for t in texts]
            return {
                "n_words": [len(w) for w in words],
                "all_sha256": [hashlib.sha256(b" ".join(w)).hexdigest() for w in words],
            }

        return compute

    return start


STRETCH = "shard long, d1 long, d2 long, id long, starts array<int>, split boolean, stretch binary"


def _stretches(marked: DataFrame, window: int, run: int, n_shards: int) -> DataFrame:
    """The words of all windows around each shared minimizer, and the shard they go to."""
    schema = to_arrow_schema(T.StructType.fromDDL(STRETCH))

    def run_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d1, d2, ids, shared, texts = (c.to_pylist() for c in batch.columns)
            for low, block in _blocks([t.encode() for t in texts]):
                whose, firsts, sizes, hashes = minimizers(block, window, run)
                out: dict[str, list] = {f: [] for f in schema.names}
                cuts = np.searchsorted(whose, np.arange(len(block) + 1)).tolist()
                for i, text in enumerate(block):
                    at = low + i
                    splits = {s["hash"]: s["splits"] for s in shared[at]}
                    words = text.split()
                    mine = slice(cuts[i], cuts[i + 1])
                    starts: dict[tuple[int, bytes], list[int]] = {}
                    for first, size, value in zip(firsts[mine].tolist(), sizes[mine].tolist(), hashes[mine].tolist(), strict=True):
                        if value in splits:
                            stretch = b" ".join(words[first : first + size + window - 1])
                            starts.setdefault((value, stretch), []).append(first)
                    for (value, stretch), places in starts.items():
                        parts = splits[value]
                        out["shard"].append((value + (d1[at] % parts) * 0x9E3779B1) % n_shards)
                        out["d1"].append(d1[at])
                        out["d2"].append(d2[at])
                        out["id"].append(ids[at])
                        out["starts"].append(places)
                        out["split"].append(parts > 1)
                        out["stretch"].append(stretch)
                if out["shard"]:
                    yield pa.RecordBatch.from_pydict(out, schema=schema)
        release_memory()

    return marked.select("d1", "d2", "id", "shared", "text").mapInArrow(run_task, STRETCH)


#: ``windows`` has a bit for each window from each of ``starts`` on; rows of one window with w1, w2 wait for other shards.
FOUND = "d1 long, d2 long, id long, starts array<int>, windows long, w1 long, w2 long"


def smallest_owner(stretches: list[bytes], owners: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of each (different) stretch the smallest owner of a stretch that has
    it; and where the windows of each stretch start in that."""
    ids: dict[bytes, int] = {}
    parts = [s.split() for s in stretches]
    # 0 ends a stretch, so no pattern runs over its end.
    sequence = np.array([i for p in parts for i in (*(ids.setdefault(w, len(ids) + 1) for w in p), 0)], np.int64)
    lengths = np.array([len(p) for p in parts])
    begins = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    n_windows = lengths - window + 1
    at = np.concatenate(([0], np.cumsum(n_windows)[:-1]))
    places = np.repeat(begins - at, n_windows) + np.arange(n_windows.sum())
    index = FMIndex(sequence, len(ids) + 1, window)
    patterns = np.lib.stride_tricks.sliding_window_view(sequence, window)[places]
    low, high = index.search(patterns)
    owner_of = np.repeat(owners, lengths + 1)
    smallest = np.repeat(owners, n_windows)
    several = np.flatnonzero(high - low > 1)
    if len(several):
        ranges, which = np.unique(np.stack((low[several], high[several]), axis=1), axis=0, return_inverse=True)
        by_rank = np.append(owner_of[index.order], NO_ID)
        smallest[several] = np.minimum.reduceat(by_rank, ranges.ravel())[::2][which.ravel()]
    return smallest, at


def _shard_searcher(window: int) -> Callable[[pa.Table], pa.Table]:
    schema = to_arrow_schema(T.StructType.fromDDL(FOUND))

    def search(rows: pa.Table) -> pa.Table:
        d1, d2, ids = (rows[c].to_numpy() for c in ("d1", "d2", "id"))
        split = rows["split"].to_numpy()
        known: dict[bytes, int] = {}
        which = np.array([known.setdefault(s, len(known)) for s in rows["stretch"].to_pylist()])
        stretches = list(known)
        owners = np.full(len(stretches), NO_ID)
        np.minimum.at(owners, which, ids)
        smallest, at = smallest_owner(stretches, owners, window)
        counts = np.diff(np.append(at, len(smallest)))
        masks = np.zeros(len(ids), np.int64)
        for j in range(int(counts.max())):
            has = counts[which] > j
            masks[has] |= (smallest[at[which[has]] + j] < ids[has]).astype(np.int64) << j
        some = np.flatnonzero(masks)
        out = {"d1": d1[some], "d2": d2[some], "id": ids[some], "starts": rows["starts"].take(pa.array(some)), "windows": masks[some]}
        table = pa.table({**out, "w1": pa.nulls(len(some), pa.int64()), "w2": pa.nulls(len(some), pa.int64())})
        # Windows that this shard leaves standing may stand in another shard of their minimizer.
        waiting: list[dict] = []
        for i in np.flatnonzero(split).tolist():
            words = stretches[which[i]].split()
            starts = rows["starts"][i].as_py()
            for j in range(int(counts[which[i]])):
                if not masks[i] >> j & 1:
                    key = hashlib.md5(b" ".join(words[j : j + window])).digest()
                    w1, w2 = (int.from_bytes(key[k : k + 8], "little", signed=True) for k in (0, 8))
                    waiting.append({"d1": d1[i], "d2": d2[i], "id": ids[i], "starts": [s + j for s in starts], "windows": 1, "w1": w1, "w2": w2})
        release_memory()
        return pa.concat_tables([table.cast(schema), pa.Table.from_pylist(waiting, schema=schema)])

    return search


def _find(marked: DataFrame, window: int, run: int, shard: int) -> DataFrame:
    """(d1, d2, places) of the windows to remove: (starts, windows) pairs."""
    total = marked.agg(F.sum(F.size("shared"))).first()[0] or 0
    n_shards = -(-max(1, total) // shard)
    stretches = _stretches(marked, window, run, n_shards)
    found = materialize(stretches.groupBy("shard").applyInArrow(_shard_searcher(window), FOUND), "found")
    waiting = found.where("w1 IS NOT NULL")
    least = waiting.groupBy("w1", "w2").agg(F.min("id").alias("least"))
    late = waiting.join(least, ["w1", "w2"]).where("id > least")
    columns = ["d1", "d2", "starts", "windows"]
    all_found = found.where("w1 IS NULL").select(columns).unionByName(late.select(columns))
    return all_found.groupBy("d1", "d2").agg(F.collect_set(F.struct("starts", "windows")).alias("places"))


def _cover(places: list | None, n_words: int, window: int) -> np.ndarray:
    """Which words are covered by the windows to remove."""
    edge = np.zeros(n_words + 1, np.int64)
    for place in places or ():
        starts, bits = np.array(place["starts"]), place["windows"]
        while bits:
            if bits & 1:
                np.add.at(edge, starts, 1)
                np.add.at(edge, starts + window, -1)
            bits >>= 1
            starts = starts + 1
    return np.cumsum(edge)[:n_words] > 0


RESULT = "n_words long, n_removed long, kept_sha256 string"


def remove_repeats(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
    run: int = RUN,
    shard: int = SHARD,
    keep: list[str] | None = None,
    with_text: bool = False,
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of each row: without every word covered by a
    window of words that also starts in a document of smaller id.

    Words are divided by ASCII white space and unchanged; windows are judged on the input.
    ``kept_sha256`` is over the kept words joined by a space. With ``with_text`` there are
    also ``kept_text``, the text itself if nothing is removed, else the kept words joined
    by a space, and ``kept``, a struct of the columns ``keep``.

    Equal texts are one text of its smallest id: all others of it lose every word (if they
    have a window). Null texts have no words. A null id counts as larger than any. Rows of
    one id are not compared with each other, repeated rows are repeated, short texts kept.

    Minimizers and the texts are shuffled once; of texts that share a minimizer the stretches
    around them and the text once more. A hot passage is one stretch in its shard, and a hot minimizer is
    split over shards whose undecided windows meet by hash; no task holds more than
    about ``shard`` stretches of it.
    """
    if not run <= window <= run + 61:
        raise ValueError("a window has from run to run + 61 words")
    small_batches(docs.sparkSession)
    rows = _keyed(docs, doc_id, text, keep or [])
    shared = _shared(rows, window, run, shard)
    classes = rows.groupBy("d1", "d2").agg(F.min("id").alias("least"))
    known = classes.join(shared, "d1", "left")
    told = map_rows(rows.join(known.hint("shuffle_hash"), ["d1", "d2"]), "text", "n_words long, all_sha256 string",
                    _tell(window), keep=["id", "d1", "d2", "kept", "text", "least", "shared"])
    copy = F.col("id") > F.col("least")
    marked = F.col("shared").isNotNull() & ~copy
    told = materialize(
        told.select(
            "id", "d1", "d2", "n_words", "kept", copy.alias("copy"), F.when(marked, F.col("shared")).alias("shared"),
            F.when(marked, F.lit(None).cast("string")).otherwise(F.col("all_sha256")).alias("all_sha256"),
            F.when(marked | F.lit(with_text), F.col("text")).alias("text"),
        ),
        "told",
    )
    searched = told.where("shared IS NOT NULL")
    places = _find(searched, window, run, shard)

    def start() -> Callable:
        def compute(values: list) -> dict:
            made: dict[str, list] = {"n_removed": [], "kept_sha256": [], "kept_text": []}
            for value in values:
                words = value["text"].encode().split()
                gone = _cover(value["places"], len(words), window)
                left = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                n_gone = int(gone.sum())
                made["n_removed"].append(n_gone)
                made["kept_sha256"].append(hashlib.sha256(left).hexdigest())
                made["kept_text"].append((left.decode() if n_gone else value["text"]) if with_text else None)
            return made

        return compute

    joined = searched.join(places, ["d1", "d2"], "left").select(
        "id", "n_words", "kept", F.struct("text", "places").alias("found")
    )
    cut = map_rows(joined, "found", "n_removed long, kept_sha256 string, kept_text string", start, keep=["id", "n_words", "kept"])
    whole = F.col("copy") & (F.col("n_words") >= window)
    rest = told.where("shared IS NULL").select(
        "id", "n_words", "kept",
        F.when(whole, F.col("n_words")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.col("all_sha256")).alias("kept_sha256"),
        F.when(F.lit(with_text), F.when(whole, F.lit("")).otherwise(F.col("text"))).alias("kept_text"),
    )
    out = cut.unionByName(rest).select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "n_words", "n_removed", "kept_sha256", "kept_text", "kept"
    )
    return out if with_text else out.drop("kept_text", "kept")
