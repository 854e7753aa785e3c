"""Greedy row alignment of one pair of results, replayed in order on postings.

Row i of the shorter side takes the most similar of the longer side's rows still open at places i and up, the first of
equals, which swaps places with row i. Rows of equal value sets form a class. Postings list the classes that
hold a value, so a row meets only classes it shares a value with; the open rows of a class wait in a queue by place,
whose outdated entries are dropped when they come up.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import numpy as np


class OpenRows:
    """The longer side: classes of equal rows, their postings, and where each open row stands."""

    def __init__(self, rows: list[np.ndarray], n_values: int):
        classes: dict[bytes, int] = {}
        self.class_of = np.array([classes.setdefault(r.tobytes(), len(classes)) for r in rows], dtype=np.int64)
        first = {c: i for i, c in reversed(list(enumerate(self.class_of.tolist())))}
        members = [rows[first[c]] for c in range(len(classes))]
        self.size = np.array([len(m) for m in members], dtype=np.int64)
        values = np.concatenate(members) if members else np.zeros(0, np.int64)
        order = np.argsort(values, kind="stable")
        self.holders = np.repeat(np.arange(len(members)), self.size)[order]
        self.bounds = np.searchsorted(values[order], np.arange(n_values + 1))
        self.empty = classes.get(b"", -1)
        self.place = np.arange(len(rows))
        self.at = np.arange(len(rows))
        self.open = np.bincount(self.class_of, minlength=len(classes)) if len(rows) else np.zeros(0, np.int64)
        self.queue: list[list[tuple[int, int]]] = [[] for _ in classes]
        for i, c in enumerate(self.class_of.tolist()):
            self.queue[c].append((i, i))
        for q in self.queue:
            heapify(q)

    def first_place(self, c: int) -> int:
        """The first place of an open row of a class that has one."""
        q = self.queue[c]
        while self.place[q[0][1]] != q[0][0]:
            heappop(q)
        return q[0][0]

    def nearest(self, row: np.ndarray, i: int) -> tuple[int, int]:
        """The place that `row` takes when places below `i` are gone, and how many values it shares there."""
        if not len(row):
            if self.empty >= 0 and self.open[self.empty]:
                return self.first_place(self.empty), 0
            return i, 0
        met = np.concatenate([self.holders[self.bounds[v] : self.bounds[v + 1]] for v in row.tolist()])
        met = met[self.open[met] > 0]
        if not len(met):
            return i, 0
        shared = np.bincount(met)
        some = np.flatnonzero(shared)
        likeness = shared[some] / (len(row) + self.size[some] - shared[some])
        best = some[likeness == likeness.max()]
        place, c = min((self.first_place(c), c) for c in best.tolist())
        return place, int(shared[c])

    def take(self, i: int, place: int) -> None:
        """The row at `place` goes to place `i` and is gone; the one that stood there goes to `place`."""
        taken, other = int(self.at[place]), int(self.at[i])
        self.open[self.class_of[taken]] -= 1
        self.place[taken] = -1
        if taken != other:
            self.at[place], self.place[other] = other, place
            heappush(self.queue[self.class_of[other]], (place, other))


def shared_values(short: list[np.ndarray], long: list[np.ndarray], n_values: int) -> int:
    """Values that the rows share place by place after alignment; rows are sorted value numbers below `n_values`."""
    rows = OpenRows(long, n_values)
    total = 0
    for i, row in enumerate(short):
        place, shared = rows.nearest(row, i)
        rows.take(i, place)
        total += shared
    return total
