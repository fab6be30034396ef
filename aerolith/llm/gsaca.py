"""Suffix sorting by grouping: linear-time construction without recursive renaming.

Suffixes are grouped by their Lyndon prefixes. Groups are taken in descending order; each suffix of a group points to
its previous smaller one, the nearest suffix to its left that no group taken so far holds. A suffix pointed to by k
members of the group is extended k times by the group's prefix, so it moves into a new group just above its own, after
those that fewer members point to. When all groups have been taken, their order is final, and one pass emits the
order inside the groups: each suffix that has its place places the suffix to its left and that one's previous smaller
suffixes in turn.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """The suffix array of an array of non-negative integers; a shorter suffix sorts before one that it begins."""
    n = len(symbols)
    if n == 0:
        return np.zeros(0, np.int64)
    order = np.argsort(symbols, kind="stable")
    ranked = symbols[order]
    cut = np.flatnonzero(np.diff(ranked)) + 1
    bounds = [0, *cut.tolist(), n]
    # groups 1.. by first symbol, 0 below all; lower and upper link their order
    members: list[list[int]] = [[]] + [order[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)]
    group = np.empty(n, np.int64)
    group[order] = np.repeat(np.arange(1, len(bounds)), np.diff(bounds))
    group = group.tolist()
    lower, upper = list(range(-1, len(members) - 1)), list(range(1, len(members) + 1))
    upper[-1] = -1
    previous = [-1] * n
    left = list(range(n))  # union-find: the nearest position at or left of this one that is not taken yet, shifted by one below
    left.append(n)
    # left[p + 1] stands for position p; 0 is the end
    at = len(members) - 1
    while at > 0:
        own = [i for i in members[at] if group[i] == at]
        own.sort()
        for i in own:
            left[i + 1] = i  # taken: look on at position i - 1
        counts: dict[int, int] = {}
        for i in own:
            x = i
            while left[x] != x:
                left[x] = left[left[x]]
                x = left[x]
            if x:
                previous[i] = p = x - 1
                counts[p] = counts.get(p, 0) + 1
        if counts:
            moves: dict[tuple[int, int], list[int]] = {}
            for p, k in counts.items():
                moves.setdefault((group[p], k), []).append(p)
            for g, k in sorted(moves, reverse=True):  # of one group the most often pointed to first, each just above the group
                new = len(members)
                moved = moves[g, k]
                members.append(moved)
                for p in moved:
                    group[p] = new
                above = upper[g]
                upper.append(above)
                lower.append(g)
                upper[g] = new
                if above >= 0:
                    lower[above] = new
        at = lower[at]
    # the groups' final order and places
    size = [0] * len(members)
    for g in group:
        size[g] += 1
    start, place, g = [0] * len(members), 0, 0
    while g >= 0:
        start[g] = place
        place += size[g]
        g = upper[g]
    out, done = [-1] * n, [False] * n

    def put(s: int) -> None:
        while s >= 0 and not done[s]:
            done[s] = True
            g = group[s]
            out[start[g]] = s
            start[g] += 1
            s = previous[s]

    put(n - 1)
    for i in range(n):
        put(out[i] - 1)
    return np.array(out, np.int64)
