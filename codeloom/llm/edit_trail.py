"""Persistent strings of edits: nodes that share prefixes, with ancestors by binary lifting
and rolling hashes, so that two of them are compared by a search for their common prefix."""

from __future__ import annotations

PRIME = (1 << 61) - 1
BASE = 0x1F3D5B79A2C4E68
ROOT = 0


class Trail:
    """Nodes are numbers; each adds a piece (of letters) to the string of its parent.

    Equal hashes are always verified letter by letter, up to shared nodes and to pairs that
    were found equal before, so a weak ``prime`` costs time and changes nothing.
    """

    def __init__(self, base: int = BASE, prime: int = PRIME):
        self.base, self.prime = base, prime
        self.pieces = [b""]
        self.sizes = [0]
        self.hashes = [0]
        self.ups: list[list[int]] = [[]]
        self.equal: set[tuple[int, int]] = set()

    def _roll(self, state: int, letters: bytes) -> int:
        for letter in letters:
            state = (state * self.base + letter) % self.prime
        return state

    def add(self, parent: int, piece: bytes) -> int:
        if not piece:
            return parent
        node = len(self.pieces)
        ups = [parent]
        while len(self.ups[ups[-1]]) >= len(ups):
            ups.append(self.ups[ups[-1]][len(ups) - 1])
        self.pieces.append(piece)
        self.sizes.append(self.sizes[parent] + len(piece))
        self.hashes.append(self._roll(self.hashes[parent], piece))
        self.ups.append(ups)
        return node

    def cover(self, node: int, size: int) -> int:
        """The first node on the way to ``node`` whose string has ``size`` letters."""
        while True:
            for up in reversed(self.ups[node]):
                if self.sizes[up] >= size:
                    node = up
                    break
            else:
                return node

    def prefix_hash(self, node: int, size: int) -> int:
        node = self.cover(node, size)
        if self.sizes[node] == size:
            return self.hashes[node]
        parent = self.ups[node][0]
        return self._roll(self.hashes[parent], self.pieces[node][: size - self.sizes[parent]])

    def common(self, a: int, b: int) -> int:
        """Length of the longest common prefix by hashes: found by doubling steps back from the
        end (strings mostly part late), then by halving."""
        high = min(self.sizes[a], self.sizes[b])
        if self.prefix_hash(a, high) == self.prefix_hash(b, high):
            return high
        step, low = 1, max(0, high - 1)
        while low and self.prefix_hash(a, low) != self.prefix_hash(b, low):
            high, step = low, 2 * step
            low = max(0, high - step)
        while high - low > 1:
            middle = (low + high) // 2
            if self.prefix_hash(a, middle) == self.prefix_hash(b, middle):
                low = middle
            else:
                high = middle
        return low

    def _tails(self, a: int, b: int, size: int) -> tuple[bytes, bytes]:
        """What the first ``size`` letters of both hold behind a prefix known to be the same."""
        x, y = self.cover(a, size), self.cover(b, size)
        cut = [self.sizes[x] - size, self.sizes[y] - size]
        left: list[bytes] = []
        right: list[bytes] = []
        while x != y and (min(x, y), max(x, y)) not in self.equal:
            if self.sizes[x] >= self.sizes[y]:
                left.append(self.pieces[x])
                x = self.ups[x][0]
            else:
                right.append(self.pieces[y])
                y = self.ups[y][0]
        tails = b"".join(reversed(left)), b"".join(reversed(right))
        # Where both end in one node that is cut, so are both tails (by as much).
        return tuple(t[: len(t) - c] if t else t for t, c in zip(tails, cut, strict=True))

    def less(self, a: int, b: int) -> bool:
        """Whether the string of ``a`` comes before that of ``b``."""
        if a == b:
            return False
        size = self.common(a, b)
        left, right = self._tails(a, b, size)
        if left != right:  # two hashes collided: the letters decide
            return left < right
        x, y = self.cover(a, size), self.cover(b, size)
        if self.sizes[x] == self.sizes[y] == size:
            self.equal.add((min(x, y), max(x, y)))
        if size == self.sizes[a] or size == self.sizes[b]:
            return self.sizes[a] < self.sizes[b]
        return self._letter(a, size) < self._letter(b, size)

    def _letter(self, node: int, at: int) -> int:
        node = self.cover(node, at + 1)
        return self.pieces[node][at - self.sizes[node]]

    def text(self, node: int) -> bytes:
        out = []
        while node != ROOT:
            out.append(self.pieces[node])
            node = self.ups[node][0]
        return b"".join(reversed(out))
