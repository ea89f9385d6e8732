"""Edit prefixes as linked nodes that share what they have in common.

A node is a label, one or more letters, behind its parent; its text is all labels from the root. Each node knows its
2^k-th ancestors, the length of its text and a rolling hash of it, so the hash of any prefix follows by climbing, and the
longest common prefix of two nodes by halving. What the hashes call equal is compared letter by letter, back to
the node that both share, before it decides anything.
"""

from __future__ import annotations

_MOD = (1 << 61) - 1
_BASE = 0x1F3D5B79


class AuditTree:
    root = 0

    def __init__(self, modulus: int = _MOD):
        self.modulus = modulus
        self.up: list[list[int]] = [[]]
        self.label: list[bytes] = [b""]
        self.size = [0]
        self.hash = [0]
        self.compared = self.collisions = 0

    def grow(self, node: int, label: bytes) -> int:
        above = [node]
        while len(self.up[above[-1]]) >= len(above):
            above.append(self.up[above[-1]][len(above) - 1])
        self.up.append(above)
        self.label.append(label)
        self.size.append(self.size[node] + len(label))
        self.hash.append(self._extend(self.hash[node], label))
        return len(self.size) - 1

    def _extend(self, value: int, letters: bytes) -> int:
        for letter in letters:
            value = (value * _BASE + letter) % self.modulus
        return value

    def _cut(self, node: int, length: int) -> tuple[int, int]:
        """Where the prefix of this length ends: a node and how many letters of its label belong to it."""
        if length <= 0:
            return self.root, 0
        size, up = self.size, self.up
        for k in range(len(up[node]) - 1, -1, -1):
            if k < len(up[node]) and size[up[node][k]] >= length:
                node = up[node][k]
        return node, length - (size[up[node][0]] if up[node] else 0)

    def prefix_hash(self, node: int, length: int) -> int:
        at, letters = self._cut(node, length)
        if letters == len(self.label[at]):
            return self.hash[at]
        return self._extend(self.hash[self.up[at][0]], self.label[at][:letters])

    def common_prefix(self, x: int, y: int) -> int:
        """Length of the longest common prefix, as the hashes have it."""
        low, high = 0, min(self.size[x], self.size[y])
        while low < high:
            middle = (low + high + 1) // 2
            if self.prefix_hash(x, middle) == self.prefix_hash(y, middle):
                low = middle
            else:
                high = middle - 1
        return low

    def agree(self, x: int, y: int, length: int) -> bool:
        """Whether the first letters really are the same."""
        (x, i), (y, j) = self._cut(x, length), self._cut(y, length)
        while length > 0:
            if (x, i) == (y, j):
                return True
            n = min(i, j)
            if self.label[x][i - n : i] != self.label[y][j - n : j]:
                return False
            i, j, length = i - n, j - n, length - n
            while not i and self.up[x]:
                x = self.up[x][0]
                i = len(self.label[x])
            while not j and self.up[y]:
                y = self.up[y][0]
                j = len(self.label[y])
        return True

    def _letter(self, node: int, at: int) -> int:
        """The letter at this place, -1 behind the end."""
        if at >= self.size[node]:
            return -1
        at_node, letters = self._cut(node, at + 1)
        return self.label[at_node][letters - 1]

    def less(self, x: int, y: int) -> bool:
        """Whether the text of ``x`` comes before that of ``y`` by its letters' codes."""
        if x == y:
            return False
        self.compared += 1
        n = self.common_prefix(x, y)
        if self.agree(x, y, n):
            return self._letter(x, n) < self._letter(y, n)
        self.collisions += 1
        return self.text(x) < self.text(y)

    def text(self, node: int) -> bytes:
        parts = []
        while node != self.root:
            parts.append(self.label[node])
            node = self.up[node][0]
        return b"".join(reversed(parts))
