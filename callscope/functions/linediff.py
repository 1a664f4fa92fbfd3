"""Line diff of two JSON payloads: the per-pair helper of the diff job.

Long payloads mostly differ in few lines. Then the differences are counted
instead of the common lines: for each number of differences, how far from the end each diagonal
gets (the greedy algorithm of Myers 1986, run on the reversed lines). That costs
the lines plus the square of the differences.

Where there are many differences, the longest common subsequence is kept as one bit per column and row
(bit-parallel LCS, Hyyro 2004), in Python integers. Rows are recomputed in
blocks while the result is read off, so a pair of n and m lines needs about
sqrt(n) * m bits and payloads of any length are diffed whole. Both ways give the
same diff.
"""

from __future__ import annotations

import json
from array import array
from decimal import Decimal
from math import isqrt

EQUAL, ADDED, DELETED = "eq", "add", "del"
#: Differences up to which they are counted, at most and for a pair of average length n: n / ``SHARE``.
FEW, SHARE = 1024, 32


def number_text(text: str) -> str:
    """A JSON number as a script prints it: shortest digits of the double, plain from 1e-6 to below 1e21."""
    value = float(text)
    if value == 0 or value != value or value in (float("inf"), float("-inf")):
        return "0" if value == 0 else "null"
    sign, digits, exponent = Decimal(repr(value)).normalize().as_tuple()
    digits, point = "".join(map(str, digits)), len(digits) + exponent
    if point > 21 or point < -5:
        tail = f".{digits[1:]}" if len(digits) > 1 else ""
        out = f"{digits[0]}{tail}e{'+' if point > 0 else '-'}{abs(point - 1)}"
    elif point <= 0:
        out = "0." + "0" * -point + digits
    else:
        out = digits[:point].ljust(point, "0") + ("." + digits[point:] if len(digits) > point else "")
    return "-" * sign + out


class _Number(str):
    """The text of a number."""


def _number(text: str) -> _Number:
    return _Number(number_text(text))


def _printed(value, line: str):
    """The text of a value in parts, members indented by two blanks."""
    if isinstance(value, _Number):
        yield str(value)
    elif isinstance(value, (dict, list)) and value:
        ends, inner = "{}" if isinstance(value, dict) else "[]", line + "  "
        yield ends[0]
        for i, item in enumerate(value):
            yield ("," if i else "") + inner
            if isinstance(value, dict):
                yield json.dumps(item, ensure_ascii=False) + ": "
                item = value[item]
            yield from _printed(item, inner)
        yield line + ends[1]
    else:
        yield json.dumps(value, ensure_ascii=False)


def pretty_lines(payload: str | None) -> list[str]:
    """Lines of the payload printed as JSON with two-space indentation."""
    if payload is None:
        return ["null"]
    try:
        value = json.loads(payload, parse_float=_number, parse_int=_number)
    except ValueError:
        return payload.split("\n")
    return "".join(_printed(value, "\n")).split("\n")


def line_diff(left: list[str], right: list[str]) -> list[tuple[str, str]]:
    """(type, line) pairs that turn ``left`` into ``right``.

    At each difference the left line is deleted first if that keeps at least
    as many common lines as adding the right line.
    """
    start = 0
    while start < len(left) and start < len(right) and left[start] == right[start]:
        start += 1
    out = [(EQUAL, line) for line in left[:start]]
    left, right = left[start:], right[start:]
    n, m = len(left), len(right)

    common = _suffixes(left, right) if n and m else None
    i = j = 0
    while i < n and j < m:
        if left[i] == right[j]:
            out.append((EQUAL, left[i]))
            i, j = i + 1, j + 1
        elif common.delete(i, j):
            out.append((DELETED, left[i]))
            i += 1
        else:
            out.append((ADDED, right[j]))
            j += 1
    out.extend((DELETED, line) for line in left[i:])
    out.extend((ADDED, line) for line in right[j:])
    return out


def _suffixes(left: list[str], right: list[str]):
    numbers: dict[str, int] = {}
    a, b = ([numbers.setdefault(line, len(numbers)) for line in reversed(lines)] for lines in (left, right))
    few = _Distances.of(a, b, min(FEW, isqrt(len(a) * len(b)) // SHARE))
    return few or _CommonSuffixes(left, right)


class _Distances:
    """How many lines two suffixes differ by, along the path of a diff from its start.

    ``reach[e][(k + e) // 2]`` is how far, in reversed lines of the left side, diagonal k (left less right) gets with e
    differences. Suffixes further along a diagonal differ by no less, so those of x left lines on diagonal k differ by
    e at most if x is within reach.
    """

    def __init__(self, n: int, m: int, reach: list[array]):
        self._n, self._m, self._reach = n, m, reach
        self._left = len(reach) - 1

    @classmethod
    def of(cls, a: list[int], b: list[int], most: int) -> _Distances | None:
        n, m, reach = len(a), len(b), []
        for e in range(most + 1):
            now = array("q", bytes(8 * (e + 1)))
            for at in range(e + 1):
                k = 2 * at - e
                x = 0
                if e:
                    before = reach[-1]
                    x = max(before[at] if at < e else -1, before[at - 1] + 1 if at else -1)
                y, step = x - k, 1
                while x < n and y < m and step:  # as far as lines are equal, in growing strides
                    if a[x:x + step] == b[y:y + step] and x + step <= n and y + step <= m:
                        x, y, step = x + step, y + step, 2 * step
                    else:
                        step //= 2
                now[at] = x
            reach.append(now)
            k = n - m
            if abs(k) <= e and (k + e) % 2 == 0 and now[(k + e) // 2] >= n:
                return cls(n, m, reach)
        return None

    def delete(self, i: int, j: int) -> bool:
        """Whether a shortest way on deletes line i; asked where lines i and j differ, and taken."""
        self._left -= 1
        x, y, e = self._n - i - 1, self._m - j, self._left
        k = x - y
        return abs(k) <= e and (k + e) % 2 == 0 and x <= self._reach[e][(k + e) // 2]


class _CommonSuffixes:
    """LCS length of any pair of suffixes, asked in order of rising i."""

    def __init__(self, left: list[str], right: list[str]):
        self._left, self._n, self._m = left, len(left), len(right)
        self._all = (1 << self._m) - 1
        self._places: dict[str, int] = {}
        for position, line in enumerate(reversed(right)):
            self._places[line] = self._places.get(line, 0) | (1 << position)
        self._step = isqrt(self._n) + 1
        # Row r covers the last r left lines; every step-th row is kept.
        self._kept = {0: self._all}
        row = self._all
        for r in range(1, self._n + 1):
            row = self._next(row, r)
            if r % self._step == 0:
                self._kept[r] = row
        self._block: dict[int, int] = {}

    def _next(self, row: int, r: int) -> int:
        hits = row & self._places.get(self._left[self._n - r], 0)
        return ((row + hits) | (row - hits)) & self._all

    def _row(self, r: int) -> int:
        if r in self._kept:
            return self._kept[r]
        if r not in self._block:
            base = r - r % self._step
            row, self._block = self._kept[base], {}
            for s in range(base + 1, min(base + self._step, self._n + 1)):
                row = self._block[s] = self._next(row, s)
        return self._block[r]

    def length(self, i: int, j: int) -> int:
        width = self._m - j
        zeros = ~self._row(self._n - i) & ((1 << width) - 1)
        return zeros.bit_count()

    def delete(self, i: int, j: int) -> bool:
        return self.length(i + 1, j) >= self.length(i, j + 1)
