"""A compressed FM-index over word ids: backward search on a wavelet matrix, for many
patterns at once.

The index orders suffixes by their first words only, as many as the longest pattern has;
backward search over patterns of up to that length needs no more.
"""

from __future__ import annotations

import numpy as np


class BitRank:
    """Bits in 64-bit words with the count of ones before each word: about 1.5 bits a bit."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int32)))

    def ones(self, upto: np.ndarray) -> np.ndarray:
        at = upto >> 6
        mask = (np.uint64(1) << (upto & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at] + np.bitwise_count(self.words[at] & mask)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.levels: list[tuple[int, BitRank, int]] = []
        rest = symbols
        for level in reversed(range(max(1, int(n_symbols - 1).bit_length()))):
            bit = (rest >> level) & 1 == 1
            zeros = int(len(rest) - np.count_nonzero(bit))
            self.levels.append((level, BitRank(bit), zeros))
            rest = np.concatenate((rest[~bit], rest[bit]))
        every = np.arange(n_symbols)
        self.first = self._walk(every, np.zeros(n_symbols, np.int64))

    def _walk(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, bits, zeros in self.levels:
            ones = bits.ones(at)
            at = np.where((symbols >> level) & 1 == 1, zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place."""
        return self._walk(symbols, upto) - self.first[symbols]


class FMIndex:
    """Over ``sequence`` of ids from 0 to ``n_symbols`` - 1, for patterns of up to ``depth`` ids."""

    def __init__(self, sequence: np.ndarray, n_symbols: int, depth: int):
        self.order = _sorted_suffixes(sequence, depth)
        self.wavelet = WaveletMatrix(sequence[self.order - 1], n_symbols)
        counts = np.bincount(sequence, minlength=n_symbols)
        self.smaller = np.concatenate(([0], np.cumsum(counts)[:-1]))

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes in order that start with each pattern (a row), by backward
        search. A range of one or none is not searched further: it can't come to more."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), len(self.order), np.int64)
        active = np.arange(len(patterns))
        for j in reversed(range(patterns.shape[1])):
            symbols = patterns[active, j]
            ends = self.wavelet.rank(
                np.concatenate((symbols, symbols)), np.concatenate((low[active], high[active]))
            ) + np.tile(self.smaller[symbols], 2)
            low[active], high[active] = ends[: len(active)], ends[len(active) :]
            active = active[high[active] - low[active] > 1]
        return low, high


def _sorted_suffixes(sequence: np.ndarray, depth: int) -> np.ndarray:
    """Places of all suffixes by their first ``depth`` ids at least (cyclic), by prefix doubling."""
    rank = sequence.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    done = 1
    while done < depth:
        key = rank * (int(rank.max()) + 1) + np.roll(rank, -done)
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        rank = np.empty_like(rank)
        rank[order] = np.concatenate(([0], np.cumsum(ranked[1:] != ranked[:-1])))
        done *= 2
    return order
