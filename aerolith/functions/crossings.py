"""Which points of a grid cell see an odd number of edges on their way to the cell's corner, without testing all pairs."""

from __future__ import annotations

import numpy as np

NEAR = 1e-9  # degrees; far above what rounding does to an edge's place, so only edges this near a point need another look
PAIRS = 1 << 16  # so many pairs of points and edges are tested at once; a cell with no more of them needs no tree


def _first(lo: np.ndarray, hi: np.ndarray, reached) -> np.ndarray:
    """For each range the first number that `reached(rows, numbers)` tells true, `hi` if none; true stays true."""
    lo, hi = lo.copy(), hi.copy()
    rows = np.flatnonzero(lo < hi)
    while len(rows):
        mid = (lo[rows] + hi[rows]) >> 1
        yes = reached(rows, mid)
        hi[rows[yes]] = mid[yes]
        lo[rows[~yes]] = mid[~yes] + 1
        rows = rows[lo[rows] < hi[rows]]
    return lo


def _all_pairs(at, edges: np.ndarray, a: np.ndarray, b: np.ndarray, points: np.ndarray, y: np.ndarray, x: np.ndarray, right: float, n: np.ndarray) -> None:
    """Add to `n` for each of `points` the edges with its row that lie between it and the side, by testing every one."""
    step = max(1, PAIRS // max(1, len(points)))
    for s in range(0, len(edges), step):
        e = edges[s : s + step, None]
        place = at(e, y[points])
        n[points] += ((a[e] <= points) & (points < b[e]) & (place > x[points]) & (place <= right)).sum(0)


def odd_crossings(y1: np.ndarray, x1: np.ndarray, y2: np.ndarray, x2: np.ndarray, lat: np.ndarray, lon: np.ndarray, right: float, low: float) -> np.ndarray:
    """Whether the way from each point to the cell's lower right corner (along its row to the side `right`, then down to
    `low`) crosses an odd number of the edges. Points on a border fall as they do in `registry.point_in_zone`.

    Every edge keeps the rows (points by latitude) in which it can matter, cut into ranges of 1, 2, 4, ... rows. Within a
    range edges that do not cross have one order from left to right, in which a point finds its place by halving. Ranges
    whose edges cross are tested pair by pair."""
    order = np.argsort(lat, kind="stable")
    y, x = lat[order], np.minimum(lon[order], right)

    def at(e, y):
        return (x2[e] - x1[e]) * (y - y1[e]) / (y2[e] - y1[e]) + x1[e]

    a, b = np.searchsorted(y, np.minimum(y1, y2)), np.searchsorted(y, np.maximum(y1, y2))  # rows that an edge passes
    rising = (x2 > x1) == (y2 > y1)

    def past(edges, t):  # the first row of each edge where it is right of t, or no longer; its place never turns along the rows
        return _first(a[edges], b[edges], lambda i, m: (at(edges[i], y[m]) > t) == rising[edges[i]])

    # an edge through the side crosses it above a row if its far end lies above, unless it is right of the side in the row:
    # told by the same places as the rest, so that what rounding does to them is the same everywhere
    turned = np.flatnonzero((x1 > right) != (x2 > right))
    far = np.where(x1 > right, y1, y2)[turned]
    below = turned[(y1[turned] > low) != (y2[turned] > low)]
    n = (far > low).sum() + (at(below, low) > right).sum() + len(far) - np.searchsorted(np.sort(far), y, "right")
    turned = turned[a[turned] < b[turned]]
    side = past(turned, right)
    starts, stops = np.where(rising[turned], side, a[turned]), np.where(rising[turned], b[turned], side)
    n += np.cumsum(np.bincount(starts, minlength=len(y) + 1) - np.bincount(stops, minlength=len(y) + 1))[:-1]
    edges = np.flatnonzero(a < b)
    if len(edges) * len(y) <= PAIRS:
        _all_pairs(at, edges, a, b, np.arange(len(y)), y, x, right, n)
    else:  # only rows where the edge is left of the side and right of the first point
        left, side = past(edges, x.min()), past(edges, right)
        a[edges], b[edges] = np.where(rising[edges], left, side), np.where(rising[edges], side, left)
        _by_ranges(at, edges[a[edges] < b[edges]], a, b, y, x, right, n)
    out = np.empty(len(lat), bool)
    out[order] = n % 2 == 1
    return out


def _by_ranges(at, edges: np.ndarray, a: np.ndarray, b: np.ndarray, y: np.ndarray, x: np.ndarray, right: float, n: np.ndarray) -> None:
    """Add to `n` for each row the edges to the right of its point; rows a to b of an edge are cut into aligned ranges."""
    size = 1 << max(1, int(len(y) - 1).bit_length())
    lo, hi = a[edges] + size, b[edges] + size
    for level in range(size.bit_length()):
        heads, tails = (lo < hi) & (lo & 1 == 1), (lo < hi) & (hi & 1 == 1)
        own, e = np.concatenate([lo[heads], hi[tails] - 1]), np.concatenate([edges[heads], edges[tails]])
        lo, hi = (lo + heads) >> 1, (hi - tails) >> 1
        if not len(e):
            continue
        top = (own << level) - size
        ends = [np.round(at(e, y[r]), 10) for r in (top, top + (1 << level) - 1)]
        by = np.lexsort((ends[1], ends[0], own))
        own, e, end = own[by], e[by], ends[1][by]
        crossed = np.unique(own[1:][(own[1:] == own[:-1]) & (end[1:] < end[:-1])])
        range_of = (np.arange(len(y)) + size) >> level
        start, stop = np.searchsorted(own, range_of), np.searchsorted(own, range_of, "right")
        for r in crossed:
            rows = np.flatnonzero(range_of == r)
            _all_pairs(at, e[start[rows[0]] : stop[rows[0]]], a, b, rows, y, x, right, n)
        rows = np.flatnonzero((start < stop) & ~np.isin(range_of, crossed))
        s, t = start[rows], stop[rows]
        found = _first(s, t, lambda i, m: at(e[m], y[rows[i]]) > x[rows[i]])  # noqa: B023
        n[rows] += t - found
        for step, k in ((-1, found - 1), (1, found.copy())):  # edges too near for their order to be sure are asked one by one
            i = np.flatnonzero((k >= s) & (k < t))
            while len(i):
                place = at(e[k[i]], y[rows[i]])
                seen = place > x[rows[i]]
                n[rows[i]] += seen if step < 0 else -(~seen).astype(np.int64)
                i = i[np.abs(place - x[rows[i]]) <= NEAR]
                k[i] += step
                i = i[(k[i] >= s[i]) & (k[i] < t[i])]
