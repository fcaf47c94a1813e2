"""Unified diffs of two texts, equal to the standard library's and in bounded time, and texts rebuilt from them.

The standard matcher looks at every pair of equal lines, which is quadratic where lines repeat. Here the longest run of equal
lines is found by its length: whether any run of k lines is in both texts is one look-up of hashes of all runs of k, and a
run of k holds runs of k - 1, so the greatest k is found by halving. Of the runs of that length the first in the old text, and of
its places the first in the new one, is the standard matcher's choice. Runs that hashes bring together are compared line by line; if
they differ, or where few lines are equal, the standard matcher does the step itself.
"""

from __future__ import annotations

import difflib
import re

import numpy as np

#: A step of so many pairs of equal lines for each line is left to the standard matcher.
FEW = 32
CONTEXT = 3
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Numbers as unlike 64-bit hashes."""
    with np.errstate(over="ignore"):
        x = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(_BASE)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def _powers(base: int, n: int) -> np.ndarray:
    step = np.full(n + 1, base, np.uint64)
    step[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(step, dtype=np.uint64)


class _Side:
    """A text's lines as numbers, of which every run has a hash; lines of no number (-1) are in no run."""

    def __init__(self, lines: list[int]):
        self.lines = np.array(lines, np.int64)
        n = len(lines)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(self.lines) * _powers(_BASE, n)[:n], dtype=np.uint64)])
        self.scale = _powers(_INVERSE, n)
        self.none = np.concatenate([[0], np.cumsum(self.lines < 0)])

    def runs(self, lo: int, hi: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, hashes) of runs of k lines within lo:hi."""
        at = np.arange(lo, hi - k + 1)
        at = at[self.none[at + k] == self.none[at]]
        with np.errstate(over="ignore"):
            return at, (self.sums[at + k] - self.sums[at]) * self.scale[at]


class Matcher(difflib.SequenceMatcher):
    """The standard matcher, with its longest matches found by hashes of runs where lines repeat."""

    def __init__(self, a: list[str], b: list[str]):
        super().__init__(None, a, b)
        # popular lines begin no match, as in the standard matcher
        number = {line: i for i, line in enumerate(self.b2j)}
        self._a, self._b = (_Side([number.get(x, -1) for x in lines]) for lines in (a, b))
        self._pairs = np.concatenate([[0], np.cumsum([len(self.b2j.get(x, ())) for x in a])])

    def find_longest_match(self, alo=0, ahi=None, blo=0, bhi=None):
        ahi, bhi = len(self.a) if ahi is None else ahi, len(self.b) if bhi is None else bhi
        if self._pairs[ahi] - self._pairs[alo] <= FEW * (ahi - alo + bhi - blo) + 1000:
            return super().find_longest_match(alo, ahi, blo, bhi)
        found = self._longest(alo, ahi, blo, bhi)
        if found is None:
            return super().find_longest_match(alo, ahi, blo, bhi)
        i, j, k = found
        while i > alo and j > blo and self.a[i - 1] == self.b[j - 1]:
            i, j, k = i - 1, j - 1, k + 1
        while i + k < ahi and j + k < bhi and self.a[i + k] == self.b[j + k]:
            k += 1
        return difflib.Match(i, j, k)

    def _longest(self, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int] | None:
        """The first longest run in both; None if hashes misled."""
        best, least, most = (alo, blo, 0), 1, min(ahi - alo, bhi - blo)
        while least <= most:
            k = (least + most + 1) // 2
            (at, h), (other, g) = self._a.runs(alo, ahi, k), self._b.runs(blo, bhi, k)
            met = np.flatnonzero(np.isin(h, g))
            if len(met):
                i = int(at[met[0]])
                best, least = (i, int(other[np.argmax(g == h[met[0]])]), k), k + 1
            else:
                most = k - 1
        i, j, k = best
        return best if np.array_equal(self._a.lines[i : i + k], self._b.lines[j : j + k]) else None


def _span(lo: int, hi: int) -> str:
    """A hunk's range; one line is told by its number alone, none by the line before."""
    return f"{lo + 1}" if hi - lo == 1 else f"{lo + (hi > lo)},{hi - lo}"


def unified(old: list[str], new: list[str], path: str) -> list[str]:
    """The lines of a unified diff with three of context; none if nothing differs."""
    out: list[str] = []
    for group in Matcher(old, new).get_grouped_opcodes(CONTEXT):
        (_, a, _, b, _), (_, _, c, _, d) = group[0], group[-1]
        out += [] if out else [f"--- a/{path}", f"+++ b/{path}"]
        out.append(f"@@ -{_span(a, c)} +{_span(b, d)} @@")
        for kind, i, k, j, m in group:
            if kind == "equal":
                out += [" " + x for x in old[i:k]]
            else:
                out += ["-" + x for x in old[i:k]] + ["+" + x for x in new[j:m]]
    return out


_HUNK = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def patched(old: str, diff: str) -> str | None:
    """The new text, from the old one and a diff as above whose lines are joined by newlines; None if they don't fit.

    A line keeps its end, so that a line of a text is followed by an empty one in the diff, save where it ends otherwise.
    """
    lines, out, at = old.splitlines(True), [], 0
    rows = diff.split("\n")[2:] if diff else []
    k = 0
    while k < len(rows):
        head = _HUNK.fullmatch(rows[k])
        if not head:
            return None
        first, n_old, n_new = int(head[1]), int(head[2] or 1), int(head[4] or 1)
        start = first - 1 if n_old else first
        out += lines[at:start]
        at, k = start, k + 1
        while n_old or n_new:
            if k >= len(rows) or not rows[k]:
                return None
            mark, text, k = rows[k][0], rows[k][1:], k + 1
            if k < len(rows) and not rows[k]:
                text, k = text + "\n", k + 1
            if mark != "+":
                if at >= len(lines) or lines[at] != text or not n_old:
                    return None
                at, n_old = at + 1, n_old - 1
            if mark != "-":
                out.append(text)
                n_new -= 1
    return "".join(out + lines[at:])
