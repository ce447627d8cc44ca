"""Step functions of whole numbers, and the effect of a stretch of an undo log as some of them.

A function here maps 0, 1, 2, ... to whole numbers and rises by 0 or 1 from each number to
the next. It is kept as its pieces ``(x, y, slope)``: only the places where the slope changes
count, however long the log behind it is.

The state of an undo log is the depth reached and the depth that redo can get back to
(``top``). Up to its first execute a stretch shifts the depth and clamps it between two
functions of ``top``; from there on depth and top are functions of the depth the first
execute met. Such effects compose, in any grouping, so a log can be cut anywhere.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable
from dataclasses import dataclass
from typing import NamedTuple


class Piece(NamedTuple):
    x: int
    y: int
    slope: int


class Steps:
    """A function that rises by 0 or 1 per step."""

    def __init__(self, pieces: Iterable[tuple[int, int, int]]):
        kept: list[Piece] = []
        for piece in pieces:
            if not kept or piece[2] != kept[-1].slope:
                kept.append(Piece(*piece))
        self.pieces = kept

    def __call__(self, x: int) -> int:
        piece = self.pieces[bisect_right(self.pieces, x, key=lambda p: p.x) - 1]
        return piece.y + piece.slope * (x - piece.x)

    def plus(self, k: int) -> Steps:
        return Steps((p.x, p.y + k, p.slope) for p in self.pieces)

    def _with(self, other: Steps, choose) -> Steps:
        """Smaller or greater value of two functions at every place."""
        places = sorted({p.x for p in self.pieces} | {p.x for p in other.pieces})
        cuts = []
        for i, x in enumerate(places):
            gap, after = self(x) - other(x), self(x + 1) - other(x + 1)
            cuts.append(x)
            # Inside a stretch the gap changes by one per step or not at all.
            if gap and after != gap and abs(after) < abs(gap):
                meet = x + abs(gap)
                if i + 1 == len(places) or meet < places[i + 1]:
                    cuts.append(meet)
        value = lambda x: choose(self(x), other(x))
        return Steps((x, value(x), value(x + 1) - value(x)) for x in cuts)

    def smaller(self, other: Steps) -> Steps:
        return self._with(other, min)

    def greater(self, other: Steps) -> Steps:
        return self._with(other, max)

    def after(self, inner: Steps) -> Steps:
        """``self(inner(x))``."""
        cuts = {p.x for p in inner.pieces}
        for target in (p.x for p in self.pieces):
            # Where the inner function first reaches a place at which this one bends.
            for i, p in enumerate(inner.pieces):
                if p.slope and target >= p.y:
                    x = p.x + target - p.y
                    if i + 1 == len(inner.pieces) or x < inner.pieces[i + 1].x:
                        cuts.add(x)
        value = lambda x: self(inner(x))
        return Steps((x, value(x), value(x + 1) - value(x)) for x in sorted(cuts))

    def flat(self) -> list[int]:
        return [n for piece in self.pieces for n in piece]

    @staticmethod
    def of(flat: Iterable[int]) -> Steps:
        n = [int(v) for v in flat]
        return Steps(zip(n[::3], n[1::3], n[2::3], strict=True))


ZERO = Steps([(0, 0, 0)])
SAME = Steps([(0, 0, 1)])


@dataclass(frozen=True)
class Effect:
    """What a stretch of executes, undos and redos does to depth and top.

    ``min(high(top), max(low(top), depth + shift))`` is the depth at the first execute, or at
    the end without one. ``depth`` and ``top`` are functions of it, None without an execute.
    """

    shift: int = 0
    low: Steps = ZERO
    high: Steps = SAME
    depth: Steps | None = None
    top: Steps | None = None

    def run(self, op: str, n: int) -> Effect:
        """The same stretch with ``n`` more operations of one kind."""
        if op == "execute":
            depth = (SAME if self.depth is None else self.depth).plus(n)
            return Effect(self.shift, self.low, self.high, depth, depth)
        if self.depth is not None:
            if op == "undo":
                depth = self.depth.plus(-n).greater(ZERO)
            else:
                depth = self.depth.plus(n).smaller(self.top)
            return Effect(self.shift, self.low, self.high, depth, self.top)
        if op == "undo":
            low, high = (f.plus(-n).greater(ZERO) for f in (self.low, self.high))
            return Effect(self.shift - n, low, high)
        low, high = (f.plus(n).smaller(SAME) for f in (self.low, self.high))
        return Effect(self.shift + n, low, high)

    def then(self, other: Effect) -> Effect:
        """This stretch and the one behind it as one."""
        if self.depth is None:
            low, high = (f.plus(other.shift).greater(other.low).smaller(other.high) for f in (self.low, self.high))
            return Effect(self.shift + other.shift, low, high, other.depth, other.top)
        low, high = (f.after(self.top) for f in (other.low, other.high))
        met = self.depth.plus(other.shift).greater(low).smaller(high)
        if other.depth is None:
            return Effect(self.shift, self.low, self.high, met, self.top)
        return Effect(self.shift, self.low, self.high, other.depth.after(met), other.top.after(met))

    def __call__(self, depth: int, top: int) -> tuple[int, int]:
        met = min(self.high(top), max(self.low(top), depth + self.shift))
        return (met, top) if self.depth is None else (self.depth(met), self.top(met))

    def row(self) -> tuple:
        functions = (self.low, self.high, self.depth, self.top)
        return (self.shift, *(None if f is None else f.flat() for f in functions))

    @staticmethod
    def of(shift: int, low, high, depth, top) -> Effect:
        some = lambda f: None if f is None else Steps.of(f)
        return Effect(int(shift), Steps.of(low), Steps.of(high), some(depth), some(top))
