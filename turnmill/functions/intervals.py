"""The interval algebra of ``spans`` on Python lists, for code that holds a whole row. Ends are exclusive."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable

Pair = tuple[int, int]


def union(spans: Iterable[Pair]) -> list[Pair]:
    """Spans that overlap or touch become one; empty and reversed ones vanish."""
    out: list[Pair] = []
    for s, e in sorted(p for p in spans if p[1] > p[0]):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def minus(spans: Iterable[Pair], excluded: Iterable[Pair]) -> list[Pair]:
    """What of ``spans`` lies outside every excluded span."""
    holes = union(excluded)
    starts, out = [h[0] for h in holes], []
    for s, e in union(spans):
        k = max(bisect_right(starts, s) - 1, 0)
        while s < e and k < len(holes) and holes[k][0] < e:
            a, b = holes[k]
            if a > s:
                out.append((s, a))
            s, k = max(s, b), k + 1
        if s < e:
            out.append((s, e))
    return out


class Cover:
    """Disjoint spans to look up by position."""

    def __init__(self, spans: Iterable[Pair]):
        self.spans = union(spans)
        self.starts = [s for s, _ in self.spans]

    def around(self, span: Pair) -> Pair:
        """The one that holds the whole of ``span``, or ``span`` itself."""
        k = bisect_right(self.starts, span[0]) - 1
        return self.spans[k] if k >= 0 and span[1] <= self.spans[k][1] else span


def first_at(sorted_values: list[int], least: int) -> int | None:
    """The place of the first value from ``least`` on."""
    k = bisect_left(sorted_values, least)
    return k if k < len(sorted_values) else None
