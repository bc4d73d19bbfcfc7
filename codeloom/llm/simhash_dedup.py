"""SimHash near-duplicates by an inverted index over bytes at their positions.

Fingerprints of eight bytes that differ in at most three bits differ in at most three bytes, so
they share at least five positional bytes. The index lists every fingerprint under some choices
of four positions and the bytes there, so chosen that any five positions hold one of them: pairs
with enough bytes in common meet. In a list, whose members share four bytes, shared positional
bytes are tallied for each pair; pairs that reach the guaranteed five are verified bit by bit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import map_rows, release_memory
from codeloom.llm.graph import components
from codeloom.llm.joins import match_keys
from codeloom.workspace import materialize

SHINGLE = 3
MAX_BITS = 3
N_BYTES = 8
SEED = 42
#: Shingles whose bits are counted at a time, and fingerprints compared with each other at a time.
BLOCK = 1 << 16
SIDE = 1024


def fingerprinter(shingle: int, seed: int) -> Callable[[], Callable]:
    def start() -> Callable:
        import xxhash

        hash_of = xxhash.xxh64_intdigest

        def hashes(text: bytes | None) -> list[int]:
            """XXH64 of each run of ``shingle`` words, lowered and joined by spaces."""
            words = (text or b"").lower().split()
            if not words:
                return []
            line = b" ".join(words)
            if len(words) <= shingle:
                return [hash_of(line, seed)]
            stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            starts = np.concatenate(([0], stops[:-shingle]))
            spans = zip(starts.tolist(), (stops[shingle - 1 :] - 1).tolist(), strict=True)
            return [hash_of(line[i:j], seed) for i, j in spans]

        def bits_set(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
            """How often each bit is set in each run of values."""
            counts = np.zeros((len(starts), 64), np.int64)
            ends = np.append(starts[1:], len(values))
            low = 0
            while low < len(starts):
                if ends[low] - starts[low] > BLOCK:  # one long text, by parts
                    for at in range(starts[low], ends[low], BLOCK):
                        part = values[at : min(at + BLOCK, ends[low])]
                        counts[low] += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0)
                    low += 1
                    continue
                high = max(low + 1, int(np.searchsorted(ends, starts[low] + BLOCK, "right")))
                part = values[starts[low] : ends[high - 1]]
                bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1)
                counts[low:high] = np.add.reduceat(bits, starts[low:high] - starts[low], axis=0, dtype=np.int32)
                low = high
            return counts

        def compute(texts: list) -> dict:
            made = np.zeros(len(texts), np.uint64)
            low = 0
            while low < len(texts):
                runs: list[list[int]] = []
                high, total = low, 0
                while high < len(texts) and total < BLOCK:
                    runs.append(hashes(texts[high]))
                    total += len(runs[-1])
                    high += 1
                sizes = np.array([len(r) for r in runs])
                full = np.flatnonzero(sizes)
                if len(full):
                    values = np.fromiter((x for r in runs for x in r), ">u8", total)
                    starts = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
                    over = 2 * bits_set(values, starts) > sizes[full][:, None]
                    made[low + full] = np.packbits(over, axis=1).view(">u8")[:, 0]
                low = high
            return {"fingerprint": made.view(np.int64)}

        return compute

    return start


def fingerprints(
    docs: DataFrame, text: str = "text", keep: list[str] | None = None, shingle: int = SHINGLE, seed: int = SEED
) -> DataFrame:
    """The 64-bit fingerprint of each text (as a signed long) beside the ``keep`` columns.

    A bit is set if more than half of the shingles' hashes have it. A text of fewer words
    than a shingle is one shingle; one without words, or null, has fingerprint zero.
    """
    return map_rows(docs, text, "fingerprint long", fingerprinter(shingle, seed), keep)


def as_hex(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def list_positions(max_bits: int) -> list[tuple[int, ...]]:
    """Choices of one position less than two linked fingerprints surely share, such that any
    choice of as many as they share holds one: greedily, always that which most still lack."""
    least = N_BYTES - max_bits
    if least < 2:
        raise ValueError("fingerprints that far apart need share no two bytes")
    lacking = [frozenset(c) for c in combinations(range(N_BYTES), least)]
    choices = [frozenset(c) for c in combinations(range(N_BYTES), least - 1)]
    chosen: list[tuple[int, ...]] = []
    while lacking:
        best = max(choices, key=lambda c: sum(c <= x for x in lacking))
        chosen.append(tuple(sorted(best)))
        lacking = [x for x in lacking if not best <= x]
    return chosen


def _index_keys(max_bits: int) -> Column:
    """Under which keys a fingerprint is listed: a choice of positions, and the bytes there."""
    keys = []
    for positions in list_positions(max_bits):
        mask = sum(0xFF << 8 * p for p in positions)
        mask -= (mask >> 63) << 64  # as a signed long
        keys.append(F.col("fingerprint").bitwiseAND(F.lit(mask).cast("long")))
    return F.posexplode(F.array(*keys))


def tallied(fps: np.ndarray, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places in ``fps`` with enough positional bytes in common, a block of pairs at a time."""
    by_byte = fps.view(np.uint8).reshape(-1, N_BYTES)
    for i in range(0, len(fps), SIDE):
        for j in range(i, len(fps), SIDE):
            left, right = by_byte[i : i + SIDE], by_byte[j : j + SIDE]
            tally = np.zeros((len(left), len(right)), np.uint8)
            for p in range(N_BYTES):
                tally += left[:, p][:, None] == right[:, p][None, :]
            x, y = np.nonzero(tally >= N_BYTES - max_bits)
            x, y = x + i, y + j
            yield x[x < y], y[x < y]


def links_in_list(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links that hold together what is linked among distinct fingerprints of one list.

    A spanning forest, at most one link for each fingerprint, so a list of near-copies
    gives as many links as it has members and not all its pairs.
    """
    root = np.arange(len(fps))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    links: list[tuple[int, int]] = []

    def link(pairs: Iterator[tuple[int, int]]) -> None:
        for i, j in pairs:
            x, y = find(i), find(j)
            if x != y:
                root[max(x, y)] = min(x, y)
                links.append((int(fps[i]), int(fps[j])))

    unsigned = fps.view(np.uint64)
    for x, y in tallied(fps, max_bits):
        near = np.bitwise_count(unsigned[x] ^ unsigned[y]) <= max_bits
        link(zip(x[near].tolist(), y[near].tolist(), strict=True))
    return links


def fingerprint_links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b) between different fingerprints that differ in at most ``max_bits`` bits,
    as many as hold each linked group together.

    ``distinct`` has each fingerprint once. Exact copies are thus one member of a list; a list of
    many near-copies is compared in blocks.
    """
    listed = distinct.select("fingerprint", _index_keys(max_bits).alias("choice", "bytes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        key: tuple | None = None

        def closed() -> list[tuple[int, int]]:
            fps = np.concatenate(held) if held else np.empty(0, np.int64)
            return links_in_list(fps, max_bits) if len(fps) > 1 else []

        for batch in batches:
            choice, stored, fps = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(fps):
                continue
            cuts = np.flatnonzero((choice[1:] != choice[:-1]) | (stored[1:] != stored[:-1])) + 1
            bounds = [0, *cuts.tolist(), len(fps)]
            links: list[tuple[int, int]] = []
            for low, high in zip(bounds[:-1], bounds[1:], strict=True):
                now = (choice[low], stored[low])
                if now != key:
                    links += closed()
                    held, key = [], now
                held.append(fps[low:high])
            if links:
                found = np.array(links, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])
        if links := closed():
            found = np.array(links, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])
        release_memory()

    list_order = Window.partitionBy("choice", "bytes").orderBy("fingerprint")
    several = (
        listed.withColumn("before", F.lag("fingerprint").over(list_order))
        .withColumn("after", F.lead("fingerprint").over(list_order))
        .where("before IS NOT NULL OR after IS NOT NULL")
        .select("choice", "bytes", "fingerprint")
        .sortWithinPartitions("choice", "bytes", "fingerprint")
    )
    return several.mapInArrow(run, "a long, b long")


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    max_bits: int = MAX_BITS,
    seed: int = SEED,
) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row: ``fingerprint`` in hex, and the
    smallest doc_id that links reach, where texts link whose fingerprints differ in at
    most ``max_bits`` bits.

    Texts of one fingerprint are one node of the graph, so a group of copies of any size
    costs a node. Texts without words, and nulls, have fingerprint zero and link like any
    other. Repeated rows are repeated; a null doc_id is never the smallest unless no other
    is reached (then the component is null). Other columns are ignored.
    """
    grouped = with_components(docs, doc_id, text, [], shingle, max_bits, seed)
    return grouped.select("doc_id", as_hex(F.col("fingerprint")).alias("fingerprint"), "component_id")


def with_components(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    keep: list[str] | None = None,
    shingle: int = SHINGLE,
    max_bits: int = MAX_BITS,
    seed: int = SEED,
) -> DataFrame:
    """doc_id, ``keep`` columns, fingerprint (a long), component_id as in ``near_duplicates``
    and ``component``, a fingerprint of the component, which tells apart components whose
    rows share a doc_id. Rows are as they were, only texts are left out."""
    kept = [F.col(f"`{c}`") for c in keep or []]
    ids = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"), *kept)
    rows = materialize(fingerprints(ids, keep=["doc_id", *(keep or [])], shingle=shingle, seed=seed), "fingerprints")
    nodes = materialize(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "nodes")
    roots = components(fingerprint_links(nodes.select("fingerprint"), max_bits))
    linked = nodes.join(roots, nodes.fingerprint == roots.node)
    groups = linked.groupBy("root").agg(F.min("least").alias("group_least"))
    reached = linked.join(groups, "root").select("fingerprint", "root", "group_least")
    component = nodes.join(reached, "fingerprint", "left").select(
        "fingerprint", "n",
        F.coalesce("group_least", "least").alias("component_id"),
        F.coalesce("root", "fingerprint").alias("component"),
    )
    placed = match_keys(rows, materialize(component, "components"), ["fingerprint"], "n")
    return placed.select("doc_id", *kept, "fingerprint", "component_id", "component")
