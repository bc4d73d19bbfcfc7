"""Best-fit packing with certified bounds.

Pieces of texts are dealt to groups and packed there by best-fit decreasing. Bounds from
dual feasible functions certify the groups that use as few sequences as can be. Groups
with a gap give up their unfilled sequences (certified ones those that are half empty),
which are exchanged between groups and packed again; an exchange that saves nothing is undone.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import map_rows, release_memory
from codeloom.llm.tokens import id_encoder
from codeloom.workspace import materialize

CAPACITY = 2048
#: Pieces that one task packs at a time.
GROUP = 16_384
#: Exchanges between groups with a gap.
ROUNDS = 5
END_ID = b"\0\0\0\0"

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECE}, sequence_id long, offset long, open boolean"


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY, times: np.ndarray | None = None) -> int:
    """Sequences that no packing of these lengths (each so many ``times``, or once) can do without.

    A dual feasible function never gives more than 1 to lengths that fit in one sequence,
    so what it gives to all lengths, rounded up, is a bound. Tried are the plain share, the
    steps floor((k+1)x/C)/k (shares that are whole multiples stay), each also after lengths
    beyond C-e are raised to C and those below e dropped, and the function that counts
    large pieces by what is left beside them in units of e.
    """
    if not len(lengths):
        return 0
    x, at = np.unique(lengths, return_inverse=True)
    n = np.zeros(len(x), np.int64)
    np.add.at(n, at, 1 if times is None else times)
    best = -(-int((x * n).sum()) // capacity)
    thresholds = np.unique(np.concatenate(([0], x[x <= capacity // 2], capacity - x[x > capacity // 2] + 1)))
    thresholds = thresholds[thresholds <= capacity // 2]
    for e in thresholds.tolist():
        raised = np.where(x > capacity - e, capacity, np.where(x < e, 0, x)) if e else x
        best = max(best, -(-int((raised * n).sum()) // capacity))
        for k in (1, 2, 3, 4, 5):
            steps = (k + 1) * raised
            whole = steps % capacity == 0
            # In units of 1/(k * capacity), to stay in whole numbers.
            value = np.where(whole, raised * k, steps // capacity * capacity)
            best = max(best, -(-int((value * n).sum()) // (k * capacity)))
        if e:
            units = capacity // e
            value = np.where(
                2 * x > capacity, units - (capacity - x) // e, np.where(2 * x == capacity, units / 2, np.where(x >= e, 1, 0))
            )
            best = max(best, int(np.ceil((value * n).sum() / units - 1e-9)))
    return best


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence and offset of each piece, and how full each sequence is: longest first, each
    into the sequence that it leaves the least room in."""
    bins = np.empty(len(lengths), np.int64)
    offsets = np.empty(len(lengths), np.int64)
    room: list[int] = []
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set if a sequence has exactly r left
    order = np.argsort(-lengths, kind="stable")
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fitting = rooms >> size
        if fitting and size:
            r = size + (fitting & -fitting).bit_length() - 1
            at = with_room[r].pop()
            if not with_room[r]:
                rooms ^= 1 << r
        else:
            at, r = len(room), capacity
            room.append(capacity)
        bins[i], offsets[i] = at, capacity - r
        left = r - size
        room[at] = left
        if left:
            with_room[left].append(at)
            rooms |= 1 << left
    return bins, offsets, capacity - np.array(room, np.int64)


def pieces(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Pieces of at most ``capacity`` ids of each text's ids and a closing 0."""

    def start() -> Callable:
        encode = id_encoder(tokenizer)

        def compute(texts: list) -> dict:
            sizes, sums = [], []
            for value in texts:
                ids = encode(value) + END_ID
                sizes.append(len(ids) // 4)
                sums.append([zlib.crc32(ids[i : i + 4 * capacity]) for i in range(0, len(ids), 4 * capacity)])
            return {"n_ids": sizes, "crcs": sums}

        return compute

    ids = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    made = map_rows(ids, "text", "n_ids long, crcs array<long>", start, keep=["doc_id"])
    begin = F.col("piece").cast("long") * capacity
    return made.select("doc_id", "n_ids", F.posexplode("crcs").alias("piece", "ids_crc32")).select(
        "doc_id", "piece", begin.alias("start"), F.least(F.lit(capacity), F.col("n_ids") - begin).alias("length"), "ids_crc32"
    )


def _packer(capacity: int, turn: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """Packs one group. Sequences that came along are kept if packing anew needs no fewer."""

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        lengths = rows["length"].to_numpy()
        bins, offsets, fill = best_fit(lengths, capacity)
        before = rows["sequence_id"].to_numpy() if turn else None
        if turn and len(np.unique(before)) <= len(fill):
            _, bins = np.unique(before, return_inverse=True)
            offsets = rows["offset"].to_numpy()
            fill = np.bincount(bins, weights=lengths).astype(np.int64)
        # A certified group has no gap of its own, but others may fill its emptiest sequences.
        certified = len(fill) <= lower_bound(lengths, capacity)
        spare = fill <= capacity // 2 if certified else fill < capacity
        sequence = (turn << 56) + (int(key[0].as_py()) << 24) + bins
        made = {"sequence_id": sequence, "offset": offsets, "open": spare[bins]}
        kept = [rows[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", *made]
        release_memory()
        return pa.table([*kept, *map(pa.array, made.values())], names=names)

    return pack


def pack(items: DataFrame, capacity: int = CAPACITY, group: int = GROUP, rounds: int = ROUNDS) -> DataFrame:
    """``items`` (as PIECE) with ``sequence_id`` and ``offset``; sequences have no gaps.

    Items are numbered once and dealt by that number, so repeated rows and hot documents
    spread evenly; a task holds about ``group`` of them. Exchanged sequences move whole, so
    a round never needs more sequences than before. Lengths must be 1 to ``capacity``.
    """
    numbered = materialize(items.withColumn("row", F.monotonically_increasing_id()), "pieces")
    groups = -(-max(1, numbered.count()) // group)
    dealt = numbered.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)))
    packed = materialize(dealt.groupBy("group").applyInArrow(_packer(capacity, 0), PACKED), "packed")
    done = packed.where("NOT open")
    for turn in range(1, rounds + 1):
        gaps = packed.where("open")
        n = gaps.count()
        if not n:
            break
        groups = -(-n // group)
        dealt = gaps.withColumn("group", F.pmod(F.xxhash64("sequence_id", F.lit(turn)), F.lit(groups)))
        packed = materialize(dealt.groupBy("group").applyInArrow(_packer(capacity, turn), PACKED), "packed")
        done = done.unionByName(packed.where("NOT open"))
        if groups == 1:
            break
    return done.unionByName(packed.where("open")).drop("open")


def pack_documents(
    docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
    group: int = GROUP, rounds: int = ROUNDS,
) -> DataFrame:
    """Every piece of every text, and its place in a sequence of at most ``capacity`` ids.

    A text's ids and a closing 0 are cut only if longer than ``capacity``. ``piece`` counts
    from 0, ``start`` is the ids of the document before it, ``ids_crc32`` that of its ids as
    little-endian unsigned 32-bit numbers. A null or empty text is the closing 0 alone. Rows
    of one or no doc_id are packed row by row. Other columns are ignored.
    """
    return pack(pieces(docs, tokenizer, doc_id, text, capacity), capacity, group, rounds)


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> dict[str, int]:
    """Sequences used, and a bound that no packing can go below. Only the number of pieces
    of each length (at most ``capacity`` rows) reaches the driver."""
    counts = packed.groupBy("length").count().collect()
    lengths = np.array([r["length"] for r in counts], np.int64)
    bound = lower_bound(lengths, capacity, np.array([r["count"] for r in counts], np.int64))
    return {"sequences": packed.select("sequence_id").distinct().count(), "bound": bound}
