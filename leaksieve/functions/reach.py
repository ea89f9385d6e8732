"""How many characters around its begin a pattern can look at.

Whoever cuts a text has to keep that many on both sides of the cut. The numbers are read off the pattern's parse tree; a
pattern with an open repeat has none.
"""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass

from leaksieve.functions.regex import _sc, _sp


@dataclass(frozen=True)
class Reach:
    """Characters to the left of a match's begin, and to the right of it, the match included."""

    left: int
    right: int


class _Open(Exception):
    """A repeat has no upper bound."""


def pattern_reach(pattern: str, longest_run: int | None = None) -> Reach | None:
    """The reach of a pattern in Python's form, or nothing if it is not bounded.

    With ``longest_run`` an open repeat of a single character or set counts as that many characters: for texts of which it
    is known that no such run is longer.
    """
    if _sp is None:
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", FutureWarning)
            tree = _sp.parse(pattern)
        walk = _Walk(longest_run)
        right = walk.width(tree)
    except (re.error, RecursionError, OverflowError, _Open):
        return None
    return Reach(walk.left + 1, right + 1)  # one more for borders of words and lines


class _Walk:
    def __init__(self, longest_run: int | None):
        self.run = longest_run
        self.left = 0
        self.groups: dict[int, int] = {}

    def width(self, sequence) -> int:
        """Most characters that a sequence and what it looks ahead for take."""
        return sum(self.node(op, arg) for op, arg in sequence)

    def node(self, op, arg) -> int:
        if op in (_sc.LITERAL, _sc.NOT_LITERAL, _sc.ANY, _sc.IN):
            return 1
        if op is _sc.AT:
            return 0
        if op is _sc.BRANCH:
            return max(self.width(branch) for branch in arg[1])
        if op is _sc.SUBPATTERN:
            width = self.width(arg[3])
            if arg[0] is not None:
                self.groups[arg[0]] = width
            return width
        if op is getattr(_sc, "ATOMIC_GROUP", None):
            return self.width(arg)
        if op in (_sc.MAX_REPEAT, _sc.MIN_REPEAT, getattr(_sc, "POSSESSIVE_REPEAT", None)):
            low, high, body = arg
            width = self.width(body)
            if not width:
                return 0
            if high is _sc.MAXREPEAT:
                single = len(body) == 1 and body[0][0] in (_sc.LITERAL, _sc.NOT_LITERAL, _sc.ANY, _sc.IN)
                if self.run is None or not single:
                    raise _Open
                return max(low, self.run)
            return high * width
        if op in (_sc.ASSERT, _sc.ASSERT_NOT):
            direction, body = arg
            width = self.width(body)
            if direction < 0:
                self.left = max(self.left, width)
                return 0
            return width
        if op is _sc.GROUPREF:
            return self.groups[arg]
        raise _Open
