"""Which parts of two texts go together: the blocks that difflib.SequenceMatcher without junk finds, and no others.

The longest common part comes first (the earliest in the first text, then in the second), then the same on both sides of
it. difflib seeks one part at a time, which is quadratic in a line's length and worse. Here all parts of one length are
taken in one pass over a box (a stretch of either text): what lies before a part holds only shorter ones, as the part was
the earliest of its length, so every box that remains has a shorter longest part. The lengths on a path of boxes differ and
fit into the text together, so there are at most about sqrt(2 n) passes over a letter.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np

#: Boxes of up to so many pairs of letters are searched from the longest part down; those with a longer side by ranks,
#: or by a table of pieces while these are short.
SMALL, LONG, SHORT = 512, 1500, 64

Block = tuple[int, int, int]


def blocks(a: str, b: str) -> list[Block]:
    """Starts in a and b and length of each common part, in order."""
    (a, cut), (b, other), ranks, out = foreign(a, b), foreign(b, a), None, []
    boxes = [(0, len(a), 0, len(b), min(len(a), len(b)))]
    while boxes:
        alo, ahi, blo, bhi, most = boxes.pop()
        x, y = a[alo:ahi], b[blo:bhi]
        mine = x.split(cut) if cut else [x]
        most = min(most, max(map(len, mine)), max(map(len, y.split(other))) if other else len(y))
        if most <= 0:
            continue
        if len(x) * len(y) <= SMALL:
            found = downwards(x, y, mine, most)
        elif max(len(x), len(y)) <= LONG:
            found = by_pieces(x, y, mine, most)
        elif not (most <= SHORT and (found := by_table(x, y, mine, most))):
            ranks = ranks or Ranks(a, b)
            found = ranks.parts(alo, ahi, blo, bhi, most)
        if not found:
            continue
        i, j = alo, blo
        for u, v, n in found:
            u, v = u + alo, v + blo
            out.append((u, v, n))
            # two letters alone differ: were they equal, the part beside them would be longer
            if u > i and v > j and (u - i > 1 or v - j > 1):
                boxes.append((i, u, j, v, n - 1))
            i, j = u + n, v + n
        if i < ahi and j < bhi and (ahi - i > 1 or bhi - j > 1):
            boxes.append((i, ahi, j, bhi, n - 1))
    out.sort()
    return out


def foreign(a: str, b: str) -> tuple[str, str]:
    """a with all letters that b lacks made one of them, and that one: no part goes beyond it."""
    odd = list(set(a).difference(b))
    for c in odd[1:]:
        a = a.replace(c, odd[0])
    return a, "".join(odd[:1])


def downwards(a: str, b: str, mine: list[str], most: int) -> list[Block]:
    """All parts of the greatest length, in order, each from where the one before ends."""
    for n in range(most, 0, -1):
        if found := swept(b, mine, n):
            return found
    return []


def by_pieces(a: str, b: str, mine: list[str], most: int) -> list[Block]:
    """`downwards` for longer texts; the longest stretch without a foreign letter is tried first."""
    if found := swept(b, mine, most):
        return found

    def common(n: int) -> bool:
        grams = {b[k : k + n] for k in range(len(b) - n + 1)}
        return not grams.isdisjoint(a[k : k + n] for k in range(len(a) - n + 1))

    return swept(b, mine, longest(common, most - 1)) if most > 1 else []


def swept(b: str, mine: list[str], n: int) -> list[Block]:
    """The parts of a length, the first text given by its stretches."""
    out, start, there, find = [], 0, 0, b.find
    for piece in mine:
        size = len(piece)
        if size == n:
            if (at := find(piece, there)) >= 0:
                out.append((start, at, n))
                there = at + n
        elif size > n:
            k = 0
            while k + n <= size:
                at = find(piece[k : k + n], there)
                if at < 0:
                    k += 1
                    continue
                out.append((start + k, at, n))
                k, there = k + n, at + n
        start += size + 1
    return out


def by_table(a: str, b: str, mine: list[str], n: int) -> list[Block]:
    """`swept` for long texts: a piece that is not there costs no search to the end."""
    places: dict[str, list[int]] = {}
    wanted = {piece[k : k + n] for piece in mine for k in range(len(piece) - n + 1)}
    for k in range(len(b) - n + 1):
        if (gram := b[k : k + n]) in wanted:
            places.setdefault(gram, []).append(k)
    out, start, there = [], 0, 0
    for piece in mine:
        k = 0
        while k + n <= len(piece):
            at = places.get(piece[k : k + n], ())
            if (x := bisect_left(at, there)) == len(at):
                k += 1
                continue
            out.append((start + k, at[x], n))
            k, there = k + n, at[x] + n
        start += len(piece) + 1
    return out


def longest(common, most: int) -> int:
    """The greatest length up to most that common holds for, where it holds for 1."""
    low, high = 1, 2
    while high <= most and common(high):
        low, high = high, 2 * high
    high = min(high, most + 1)
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if common(middle) else (low, middle)
    return low


class Ranks:
    """Numbers for the pieces of two texts, equal for equal pieces; those of a length of 2 ** k from those of half of it."""

    def __init__(self, a: str, b: str):
        # a letter between the texts that neither has keeps pieces from reaching over
        codes = np.concatenate([self.codes(a), [0x110000], self.codes(b)])
        self.second = len(a) + 1
        self.levels = [np.unique(codes, return_inverse=True)[1].astype(np.int64)]

    @staticmethod
    def codes(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)

    def pieces(self, lo: int, hi: int, n: int) -> np.ndarray:
        """A number for the piece of length n at each place of a stretch where it fits in."""
        k = n.bit_length() - 1
        while len(self.levels) <= k:
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            pairs = last[:-half] * (last.max() + 1) + last[half:]
            self.levels.append(np.unique(pairs, return_inverse=True)[1].astype(np.int64))
        level, rest = self.levels[k], n - (1 << k)
        first = level[lo : hi - n + 1]
        return first * (level.max() + 1) + level[lo + rest : hi - n + 1 + rest] if rest else first

    def parts(self, alo: int, ahi: int, blo: int, bhi: int, most: int) -> list[Block]:
        """All parts of the greatest length, as `by_pieces` gives them."""
        sides = lambda n: (self.pieces(alo, ahi, n), self.pieces(self.second + blo, self.second + bhi, n))
        common = lambda n: bool(np.isin(*sides(n)).any())
        if not common(1):
            return []
        n = longest(common, most)
        x, y = sides(n)
        order = np.argsort(y, kind="stable")
        ordered = y[order]
        first, end = np.searchsorted(ordered, x), np.searchsorted(ordered, x, side="right")
        at = np.flatnonzero(end > first)
        places, out, here, there = order.tolist(), [], 0, 0
        for i, lo, hi in zip(at.tolist(), first[at].tolist(), end[at].tolist(), strict=True):
            if i < here:
                continue
            k = bisect_left(places, there, lo, hi)
            if k < hi:
                out.append((i, places[k], n))
                here, there = i + n, places[k] + n
        return out


def one_to_one(a: str, b: str) -> Iterator[tuple[int, int, int, bool]]:
    """Start in a and in b, length, and whether they are equal, of the stretches that have as many letters in both: the
    blocks, and what lies between two of them."""
    i = j = 0
    for x, y, n in blocks(a, b):
        if x - i == y - j and x > i:
            yield i, j, x - i, False
        yield x, y, n, True
        i, j = x + n, y + n
    if len(a) - i == len(b) - j and len(a) > i:
        yield i, j, len(a) - i, False
