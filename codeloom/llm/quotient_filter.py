"""Counting quotient filters over packed word ids, without loss.

A key is up to three word ids of ``bits`` bits each (0: no word), packed and held as two
halves. An invertible permutation mixes the bits evenly; the first bits of the result name
a shard, the next ones (the quotient) a slot, the others (the remainder) are stored whole.
So keys come back exactly, equal keys meet, and every shard gets an even share whatever
the keys are. Entries lie in the order of permuted keys, which makes merging a sorted merge.
"""

from __future__ import annotations

import struct

import numpy as np

ROUNDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)
#: Halves of a key are 64-bit lanes, so ids have at most so many bits.
MAX_BITS = 42
HEAD = "<IIIII"


def _u(value: int) -> np.uint64:
    return np.uint64(value)


def pack(ids: tuple[np.ndarray, np.ndarray, np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Halves of the keys of three columns of ids, each of ``bits`` (an even number of) bits."""
    first, second, third = (x.astype(np.uint64) for x in ids)
    part = bits // 2
    return first << _u(part) | second >> _u(part), (second & _u((1 << part) - 1)) << _u(bits) | third


def unpack(high: np.ndarray, low: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    part = bits // 2
    inner = _u((1 << part) - 1)
    second = (high & inner) << _u(part) | low >> _u(bits)
    ids = high >> _u(part), second, low & _u((1 << bits) - 1)
    return tuple(x.astype(np.int64) for x in ids)


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    x = (x ^ (x >> _u(31)) ^ _u(key)) * _u(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _u(29))) * _u(0x94D049BB133111EB)
    return x ^ (x >> _u(32))


def permute(high: np.ndarray, low: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """A Feistel network over two halves of ``half`` bits: one to one, whatever the mixing does."""
    mask = _u((1 << half) - 1)
    for key in ROUNDS:
        high, low = low, high ^ (_mix(low, key) & mask)
    return high, low


def restore(high: np.ndarray, low: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """What ``permute`` was given."""
    mask = _u((1 << half) - 1)
    for key in reversed(ROUNDS):
        high, low = low ^ (_mix(high, key) & mask), high
    return high, low


def tally(
    high: np.ndarray, low: np.ndarray, counts: np.ndarray | None, half: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different keys in order, with the sums of their counts (one each without ``counts``).
    Runs that are sorted already are merged."""
    if not len(high):
        return high, low, np.empty(0, np.int64)
    if 2 * half <= 64:
        joined = high << _u(half) | low
        if counts is None:
            joined = np.sort(joined)
        else:
            order = np.argsort(joined, kind="stable")
            joined, counts = joined[order], counts[order]
        first = np.flatnonzero(np.append(True, joined[1:] != joined[:-1]))
        high, low = joined >> _u(half), joined & _u((1 << half) - 1)
    else:
        order = np.lexsort((low, high))
        high, low = high[order], low[order]
        counts = None if counts is None else counts[order]
        first = np.flatnonzero(np.append(True, (high[1:] != high[:-1]) | (low[1:] != low[:-1])))
    sums = np.diff(np.append(first, len(high))) if counts is None else np.add.reduceat(counts, first)
    return high[first], low[first], sums


def encode(high: np.ndarray, low: np.ndarray, counts: np.ndarray, half: int, shard_bits: int) -> bytes:
    """The filter of permuted keys of one shard, in order: how many entries each slot has,
    the remainders by whole bytes, and counters of a byte (255: the count stands behind)."""
    n = len(high)
    top = half - shard_bits
    width = -(-max(8, top + half - max(0, n.bit_length() - 1)) // 8)
    quotient_bits = min(top, max(0, top + half - 8 * width))
    rest = top - quotient_bits
    own = high & _u((1 << top) - 1)
    slots = np.bincount((own >> _u(rest)).astype(np.int64), minlength=1 << quotient_bits)
    remainder = own & _u((1 << rest) - 1)
    lanes = np.empty((n, 2), ">u8")
    lanes[:, 0] = remainder >> _u(64 - half)
    lanes[:, 1] = remainder << _u(half) | low
    large = counts >= 255
    loads = slots.astype("<u4" if slots.max() > 65535 else "<u2" if slots.max() > 255 else "<u1")
    head = struct.pack(HEAD, n, quotient_bits, width, loads.itemsize, int(large.sum()))
    stored = lanes.view(np.uint8).reshape(n, 16)[:, 16 - width :]
    small = np.where(large, 255, counts).astype(np.uint8)
    return b"".join((head, loads.tobytes(), stored.tobytes(), small.tobytes(), counts[large].astype("<i8").tobytes()))


def decode(data: bytes, half: int, shard_bits: int, shard: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Permuted keys, in order, and counts of a filter."""
    n, quotient_bits, width, load_bytes, n_large = struct.unpack_from(HEAD, data)
    at = struct.calcsize(HEAD)
    loads = np.frombuffer(data, f"<u{load_bytes}", 1 << quotient_bits, at)
    at += loads.nbytes
    lanes = np.zeros((n, 16), np.uint8)
    lanes[:, 16 - width :] = np.frombuffer(data, np.uint8, n * width, at).reshape(n, width)
    at += n * width
    counts = np.frombuffer(data, np.uint8, n, at).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data, "<i8", n_large, at + n)
    both = lanes.view(">u8").astype(np.uint64)
    top = half - shard_bits
    rest = top - quotient_bits
    remainder = (both[:, 0] << _u(64 - half) | both[:, 1] >> _u(half)) & _u((1 << rest) - 1)
    slot = np.repeat(np.arange(1 << quotient_bits, dtype=np.uint64), loads)
    high = _u(shard) << _u(top) | slot << _u(rest) | remainder
    return high, both[:, 1] & _u((1 << half) - 1), counts


def shards(
    high: np.ndarray, low: np.ndarray, counts: np.ndarray, half: int, shard_bits: int
) -> list[tuple[int, bytes]]:
    """(shard, filter) of permuted keys in order, one for each shard that has keys."""
    which = (high >> _u(half - shard_bits)).astype(np.int64)
    found = np.unique(which)
    cuts = np.searchsorted(which, np.append(found, found[-1] + 1)) if len(found) else []
    return [
        (int(s), encode(high[i:j], low[i:j], counts[i:j], half, shard_bits))
        for s, i, j in zip(found.tolist(), cuts[:-1], cuts[1:], strict=True)
    ]


def merge(filters: list[bytes], half: int, shard_bits: int, shard: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Permuted keys and summed counts of the filters of a shard."""
    parts = [decode(f, half, shard_bits, shard) for f in filters]
    return tally(*(np.concatenate(x) for x in zip(*parts, strict=True)), half)
