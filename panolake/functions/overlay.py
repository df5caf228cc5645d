"""Overlay of polygons: repair, union, intersection and buffers of segmentations, a whole Arrow batch at once.

A segmentation is a list of rings, a ring a flat list of coordinates. An overlay cuts all edges of a group where they
meet, on a fine grid so that equal points are equal; counts for each piece how often the area on either side is
covered; and keeps the pieces between what is wanted and what is not, directed so that it lies on their left.
Areas are sums over such pieces; outlines are walks along them. Groups never meet: all steps are array operations over
the rows of a batch, and candidates for a crossing come from a sweep over each group's edges.

Defined results: rings of under three points, null segmentations and those without area are empty; holes and
crossings follow the even-odd rule; parts come out as lists of rings, the outer one first, without the closing point.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, BooleanType, DoubleType

#: Width of the grid, in pixels or metres.
GRID = 2.0**-20
#: Pairs of edges that are looked at together, and bytes of outlines: few enough for a core's cache.
AT_ONCE = 1 << 15
BYTES = 1 << 18
#: How far inside both areas a point must lie to show alone that they share area.
INSIDE = 2.0**-10
SEGMENTATION = ArrayType(ArrayType(DoubleType()))
PARTS = ArrayType(SEGMENTATION)


class Edges(NamedTuple):
    """Directed edges of groups, on the grid; sorted by group."""

    group: np.ndarray
    x1: np.ndarray
    y1: np.ndarray
    x2: np.ndarray
    y2: np.ndarray

    def take(self, which: np.ndarray) -> Edges:
        return Edges(*(c[which] for c in self))


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def _chunks(counts: np.ndarray) -> Iterator[slice]:
    """Slices of rows that have at most ``AT_ONCE`` partners together; a row with more is alone."""
    ends, k = np.cumsum(counts), 0
    while k < len(counts):
        base = ends[k - 1] if k else 0
        stop = max(k + 1, int(np.searchsorted(ends, base + AT_ONCE, side="right")))
        yield slice(k, stop)
        k = stop


class Rings(NamedTuple):
    """Rings one after another: the row each belongs to, its number of vertices, and the vertices."""

    row: np.ndarray
    size: np.ndarray
    x: np.ndarray
    y: np.ndarray

    def edges(self, group: np.ndarray | None = None) -> Edges:
        """Their edges, grouped by ``group`` of each row (the row itself if None)."""
        after = np.arange(1, len(self.x) + 1)
        ends = np.cumsum(self.size)
        after[ends - 1] = ends - self.size
        x, y = (np.rint(c / GRID).astype(np.int64) for c in (self.x, self.y))
        row = np.repeat(self.row if group is None else group[self.row], self.size)
        order = np.argsort(row, kind="stable")
        return Edges(row, x, y, x[after], y[after]).take(order)


def rings_of(segmentations: pa.Array) -> Rings:
    """The rings of each row of a list of lists of numbers that have three points and more."""
    counts = np.diff(segmentations.offsets.to_numpy()) if len(segmentations) else np.zeros(0, np.int64)
    counts = np.where(segmentations.is_valid().to_numpy(zero_copy_only=False), counts, 0)
    rings = segmentations.flatten()
    numbers, offsets = rings.flatten().to_numpy(zero_copy_only=False), rings.offsets.to_numpy().astype(np.int64)
    offsets, valid = offsets - (offsets[0] if len(offsets) else 0), rings.is_valid().to_numpy(zero_copy_only=False)
    size = np.where(valid, np.diff(offsets) // 2, 0)
    kept = size >= 3
    row, size, first = np.repeat(np.arange(len(counts)), counts)[kept], size[kept], offsets[:-1][kept]
    at = np.repeat(first, size) + 2 * _spread(np.zeros(len(size), np.int64), size)
    return Rings(row, size, numbers[at], numbers[at + 1])


def _after(r: Rings) -> np.ndarray:
    ends, after = np.cumsum(r.size), np.arange(1, len(r.x) + 1)
    after[ends - 1] = ends - r.size
    return after


def _before(r: Rings) -> np.ndarray:
    ends, before = np.cumsum(r.size), np.arange(-1, len(r.x) - 1)
    before[ends - r.size] = ends - 1
    return before


def _on_grid(r: Rings) -> tuple[Rings, np.ndarray]:
    """Rings of whole numbers that run to the left, without repeated points; and whether each is its row's only one and convex.

    That is, it turns left by over two steps of the grid at each vertex, once around in all: it meets itself nowhere.
    """
    x, y = (np.rint(c / GRID).astype(np.int64) for c in (r.x, r.y))
    ring, before = np.repeat(np.arange(len(r.size)), r.size), _before(r)
    new = (x != x[before]) | (y != y[before])
    new[(np.cumsum(r.size) - r.size)[np.bincount(ring[new], minlength=len(r.size)) == 0]] = True
    r = Rings(r.row, np.bincount(ring[new], minlength=len(r.size)), x[new], y[new])
    right = np.repeat(_signed(r) < 0, r.size) if len(r.x) else np.zeros(0, bool)
    first = np.repeat(np.cumsum(r.size) - r.size, r.size)
    at = np.where(right, 2 * first + np.repeat(r.size, r.size) - 1 - np.arange(len(r.x)), np.arange(len(r.x)))
    r = r._replace(x=r.x[at], y=r.y[at])
    before, after = _before(r), _after(r)
    ax, ay, bx, by = ((p - q).astype(float) for p, q in ((r.x, r.x[before]), (r.y, r.y[before]), (r.x[after], r.x), (r.y[after], r.y)))
    left = ax * by - ay * bx > 2 * np.hypot(ax + bx, ay + by)
    up = (by > 0) | ((by == 0) & (bx > 0))
    ring = np.repeat(np.arange(len(r.size)), r.size)
    lowest = np.bincount(ring[up & ~up[before]], minlength=len(r.size))
    return r, (r.size >= 3) & (np.bincount(ring[~left], minlength=len(r.size)) == 0) & (lowest == 1) & (np.bincount(r.row, minlength=1)[r.row] == 1)


def _some(r: Rings, which: np.ndarray) -> Rings:
    own = np.repeat(which, r.size)
    return Rings(r.row[which], r.size[which], r.x[own], r.y[own])


def _by_row(r: Rings) -> Rings:
    order = np.argsort(r.row, kind="stable")
    at = _spread((np.cumsum(r.size) - r.size)[order], r.size[order])
    return Rings(r.row[order], r.size[order], r.x[at], r.y[at])


def _both_by_row(one: Rings, other: Rings) -> Rings:
    return _by_row(Rings(*(np.concatenate(c) for c in zip(one, other, strict=True))))


def _bordered(r: Rings, group: np.ndarray | None = None) -> Edges:
    """``even_odd`` of the edges of each row, or of ``group`` of each row; a convex ring has no need of cuts."""
    found, convex = _on_grid(r)
    after = _after(found)
    row = np.repeat(found.row if group is None else group[found.row], found.size)
    own = np.repeat(convex, found.size)
    plain = Edges(row[own], found.x[own], found.y[own], found.x[after][own], found.y[after][own])
    rest = even_odd(_some(r, ~convex).edges())
    return _joined(plain, rest if group is None else rest._replace(group=group[rest.group]))


def _cut(e: Edges) -> tuple[Edges, np.ndarray]:
    """The edges in pieces that meet only at their ends, and the edge that each is a piece of."""
    of = np.arange(len(e.group))
    for _ in range(8):
        edge, px, py = _meetings(e)
        if not len(edge):
            break
        n = len(e.group)
        edge = np.concatenate([np.arange(n), np.arange(n), edge])
        px, py = np.concatenate([e.x1, e.x2, px]), np.concatenate([e.y1, e.y2, py])
        along = (px - e.x1[edge]) * (e.x2 - e.x1)[edge].astype(float) + (py - e.y1[edge]) * (e.y2 - e.y1)[edge].astype(float)
        order = np.lexsort((along, edge))
        edge, px, py = edge[order], px[order], py[order]
        piece = (edge[1:] == edge[:-1]) & ((px[1:] != px[:-1]) | (py[1:] != py[:-1]))
        of = of[edge[:-1][piece]]
        e = Edges(e.group[edge[:-1][piece]], px[:-1][piece], py[:-1][piece], px[1:][piece], py[1:][piece])
    return e, of


def _meetings(e: Edges) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edge, x, y): points inside edges where another edge of the group crosses, touches or ends."""
    low, high = np.minimum(e.x1, e.x2), np.maximum(e.x1, e.x2)
    order = np.lexsort((low, e.group))
    s, low, high = e.take(order), low[order], high[order]
    base = low[np.searchsorted(s.group, s.group)]  # each group's own, as groups may lie far apart
    key = lambda x: s.group * (1 << 43) + (x - base)
    counts = np.searchsorted(key(low), key(high), side="right") - np.arange(len(low)) - 1
    found = []
    for part in _chunks(counts):
        i = np.repeat(np.arange(part.start, part.stop), counts[part])
        j = _spread(np.arange(part.start, part.stop) + 1, counts[part])
        near = (np.maximum(s.y1[i], s.y2[i]) >= np.minimum(s.y1[j], s.y2[j])) & (np.maximum(s.y1[j], s.y2[j]) >= np.minimum(s.y1[i], s.y2[i]))
        i, j = i[near], j[near]
        ax, ay, bx, by = ((s.x2 - s.x1)[i].astype(float), (s.y2 - s.y1)[i].astype(float), (s.x2 - s.x1)[j].astype(float), (s.y2 - s.y1)[j].astype(float))
        ox, oy = (s.x1[j] - s.x1[i]).astype(float), (s.y1[j] - s.y1[i]).astype(float)
        turn = ax * by - ay * bx
        p, q = ox * by - oy * bx, ox * ay - oy * ax
        with np.errstate(divide="ignore", invalid="ignore"):
            t, u = p / turn, q / turn
        cross = (t > 0) & (t < 1) & (u > 0) & (u < 1)
        x, y = (np.rint(s.x1[i] + t * ax)[cross].astype(np.int64), np.rint(s.y1[i] + t * ay)[cross].astype(np.int64))
        found += [(i[cross], x, y), (j[cross], x, y)]
        # How far the other's ends lie from an edge's line, times its length, comes from the same products.
        for at, other, long, starts, ends in ((i, j, np.hypot(ax, ay), q, q - turn), (j, i, np.hypot(bx, by), p, p - turn)):
            for away, x, y in ((starts, s.x1, s.y1), (ends, s.x2, s.y2)):
                k = np.flatnonzero(np.abs(away) <= 0.75 * long)
                m, x, y = at[k], x[other[k]], y[other[k]]
                dx, dy, vx, vy = ((c - d).astype(float) for c, d in ((s.x2[m], s.x1[m]), (s.y2[m], s.y1[m]), (x, s.x1[m]), (y, s.y1[m])))
                on = (vx * dx + vy * dy > 0) & (vx * dx + vy * dy < dx * dx + dy * dy)
                found.append((m[on], x[on], y[on]))
    edge, x, y = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in range(3))
    inner = ((x != s.x1[edge]) | (y != s.y1[edge])) & ((x != s.x2[edge]) | (y != s.y2[edge]))
    return order[edge[inner]], x[inner], y[inner]


def _borders(pieces: Edges, wanted) -> Edges:
    """Pieces between area whose number of turns is ``wanted`` and area whose is not, the wanted one on their left."""
    forward = (pieces.x1 < pieces.x2) | ((pieces.x1 == pieces.x2) & (pieces.y1 < pieces.y2))
    a = Edges(pieces.group, *(np.where(forward, p, q) for p, q in ((pieces.x1, pieces.x2), (pieces.y1, pieces.y2), (pieces.x2, pieces.x1), (pieces.y2, pieces.y1))))
    order = np.lexsort((a.y2, a.x2, a.y1, a.x1, a.group))
    a, sign = a.take(order), np.where(forward, 1, -1)[order]
    new = np.concatenate([[True], np.any([c[1:] != c[:-1] for c in a], axis=0)]) if len(sign) else np.zeros(0, bool)
    net = np.add.reduceat(sign, np.flatnonzero(new)) if len(sign) else sign
    e = a.take(new)
    steep = np.abs(e.y2 - e.y1) >= np.abs(e.x2 - e.x1)
    right, left = np.zeros(len(net), np.int64), np.zeros(len(net), np.int64)
    of = _chains(e, net)
    for which, f, turned in ((steep, e, 1), (~steep, Edges(e.group, e.y1, e.x1, e.y2, e.x2), -1)):
        rows = np.flatnonzero(which & (of == np.arange(len(of))))
        ups = net * np.sign(f.y2 - f.y1)
        right[rows] = _turns(f, ups, rows)
        left[rows] = right[rows] + ups[rows]
        right[rows], left[rows] = turned * right[rows], turned * left[rows]
    # ``right`` is the side of larger x of steep pieces, of larger y of flat ones; e runs up or to the right.
    up = np.where(steep, e.y2 > e.y1, e.x2 > e.x1)
    # What lies on the left along the way is the same for a whole chain.
    ahead = (up == steep) == (net > 0)
    on_left = np.where(ahead, left, right)[of]
    rest = of != np.arange(len(of))
    left[rest], right[rest] = (on_left - ~ahead)[rest], (on_left - ahead)[rest]
    in_right, in_left = wanted(right), wanted(left)
    kept = in_right != in_left
    back = kept & np.where(steep, in_left != up, in_right != up)
    out = Edges(e.group, *(np.where(back, q, p) for p, q in ((e.x1, e.x2), (e.y1, e.y2), (e.x2, e.x1), (e.y2, e.y1))))
    return out.take(kept)


def _chains(e: Edges, net: np.ndarray) -> np.ndarray:
    """For each piece one of its chain, which stands for itself: pieces gone once, one after another, where no others meet."""
    n = len(net)
    if not n:
        return np.zeros(0, np.int64)
    back = net < 0
    x1, y1, x2, y2 = (np.where(back, q, p) for p, q in ((e.x1, e.x2), (e.y1, e.y2), (e.x2, e.x1), (e.y2, e.y1)))
    _, vertex = np.unique(np.concatenate([_names(e.group, x1, y1), _names(e.group, x2, y2)]), return_inverse=True)
    start, end = vertex[:n], vertex[n:]
    met = [np.bincount(v, minlength=2 * n) for v in (start, end, vertex[np.tile(np.abs(net) != 1, 2)])]
    simple = (met[0] == 1) & (met[1] == 1) & (met[2] == 0)
    into = np.zeros(2 * n, np.int64)
    into[end] = np.arange(n)
    before = into[start]
    joined = simple[start] & (e.group[before] == e.group) & (x2[before] == x1) & (y2[before] == y1)
    before = np.where(joined, before, np.arange(n))
    jump, least = before, np.arange(n)
    for _ in range(int(n).bit_length()):
        least, after = np.minimum(least, least[jump]), jump[jump]
        if (after == jump).all():
            break
        jump = after
    return np.where(before[jump] == jump, jump, least)


def _turns(e: Edges, ups: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """How often the area just right of the middle of each of ``rows`` is gone around: net crossings of the ray to the right.

    A group's height is cut into bands, about one for four edges; a ray is tested against the edges of its band.
    """
    out = np.zeros(len(rows), np.int64)
    if not len(rows):
        return out
    low, high = np.minimum(e.y1, e.y2), np.maximum(e.y1, e.y2)
    groups, of = np.unique(e.group, return_inverse=True)
    bottom, top = np.full(len(groups), np.iinfo(np.int64).max), np.full(len(groups), np.iinfo(np.int64).min)
    np.minimum.at(bottom, of, low)
    np.maximum.at(top, of, high)
    bands = np.maximum(np.bincount(of) // 4, 1)
    tall = (top - bottom) // bands + 1
    first_band = np.cumsum(bands) - bands
    own = np.flatnonzero(low != high)
    b_low, b_high = (low[own] - bottom[of[own]]) // tall[of[own]], (high[own] - bottom[of[own]]) // tall[of[own]]
    edge, band = np.repeat(own, b_high - b_low + 1), _spread(first_band[of[own]] + b_low, b_high - b_low + 1)
    order = np.argsort(band, kind="stable")
    edge, band = edge[order], band[order]
    twice = e.y1[rows] + e.y2[rows]
    mine = first_band[of[rows]] + (twice // 2 - bottom[of[rows]]) // tall[of[rows]]
    first, last = np.searchsorted(band, mine), np.searchsorted(band, mine, side="right")
    for part in _chunks(last - first):
        m = np.repeat(np.arange(part.start, part.stop), (last - first)[part])
        k = edge[_spread(first[part], (last - first)[part])]
        over = (2 * low[k] <= twice[m]) & (2 * high[k] > twice[m]) & (k != rows[m])
        m, k = m[over], k[over]
        x = e.x1[k] + (twice[m] / 2 - e.y1[k]) * ((e.x2[k] - e.x1[k]) / (e.y2[k] - e.y1[k]))
        beyond = x > (e.x1[rows[m]] + e.x2[rows[m]]) / 2
        np.add.at(out, m[beyond], ups[k[beyond]])
    return out


def even_odd(e: Edges) -> Edges:
    """Borders of what an odd number of rings surrounds."""
    return _borders(_cut(e)[0], lambda turns: turns % 2 != 0)


def covered(e: Edges, times: int = 1) -> Edges:
    """Borders of what is covered so often by areas that lie on the left of their edges."""
    return _borders(_cut(e)[0], lambda turns: turns >= times)


def areas(e: Edges, rows: int) -> np.ndarray:
    """Area of each group's bordered region."""
    low = np.full(rows, np.iinfo(np.int64).max)
    np.minimum.at(low, e.group, e.x1)
    x1, x2 = (e.x1 - low[e.group]) * GRID, (e.x2 - low[e.group]) * GRID
    return np.bincount(e.group, (x1 + x2) / 2 * ((e.y2 - e.y1) * GRID), rows).astype(float)


def outlines(e: Edges) -> Rings:
    """The borders as rings: each walk turns as sharply as it can, so areas that touch in a point are rings of their own."""
    n = len(e.group)
    if not n:
        return _walked(e)
    # Where one edge leaves each vertex, walks are the cycles of one following the other.
    order = np.argsort(leaving := _names(e.group, e.x1, e.y1), kind="stable")
    follow = order[np.minimum(np.searchsorted(leaving[order], _names(e.group, e.x2, e.y2)), n - 1)]
    odd = (e.group[follow] != e.group) | (e.x1[follow] != e.x2) | (e.y1[follow] != e.y2)
    odd[order[1:][leaving[order[1:]] == leaving[order[:-1]]]] = True
    odd |= np.bincount(follow, minlength=n) != 1
    some = np.zeros(e.group.max() + 1, bool)
    some[e.group[odd]] = True
    walked, which = some[e.group], ~some[e.group]
    if walked.any():
        place = np.cumsum(which) - 1
        follow = place[follow[which]]
    plain = e.take(which)
    at, size = _cycles(follow)
    first = at[np.cumsum(size) - size]
    rings = Rings(plain.group[first], size, plain.x1[at] * GRID, plain.y1[at] * GRID)
    rings = _straightened(_some(rings, size > 2))
    if not walked.any():
        return rings
    others = _walked(e.take(walked))
    return _both_by_row(rings, others)


def _names(*columns: np.ndarray) -> np.ndarray:
    """A number for each row of whole numbers; the same for equal rows, and for others by rare chance."""
    out = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + c.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    return out


def _cycles(follow: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cycles of a permutation one after another, each from its least member on, and their sizes."""
    every = np.arange(len(follow))
    least, jump = every, follow
    while (least != least[follow]).any():
        least, jump = np.minimum(least, least[jump]), jump[jump]
    ahead, jump = np.where(least == every, 0, 1), np.where(least == every, every, follow)
    while (jump != least).any():
        ahead, jump = ahead + ahead[jump], jump[jump]
    size = np.bincount(least, minlength=len(follow))
    start = np.cumsum(size) - size
    at = np.empty(len(follow), np.int64)
    at[start[least] + (size[least] - ahead) % np.maximum(size[least], 1)] = every
    return at, size[size > 0]


def _walked(e: Edges) -> Rings:
    """The same rings edge by edge."""
    n = len(e.group)
    starts = np.lexsort((np.arctan2((e.y2 - e.y1).astype(float), (e.x2 - e.x1).astype(float)), e.y1, e.x1, e.group))
    leaving: dict[tuple, list[int]] = {}
    for i, at in zip(starts.tolist(), zip(e.group[starts].tolist(), e.x1[starts].tolist(), e.y1[starts].tolist(), strict=True), strict=True):
        leaving.setdefault(at, []).append(i)
    angle = np.arctan2((e.y2 - e.y1).astype(float), (e.x2 - e.x1).astype(float)).tolist()
    ends = list(zip(e.group.tolist(), e.x2.tolist(), e.y2.tolist(), strict=True))
    used, walks = [False] * n, []
    for first in range(n):
        if used[first]:
            continue
        walk, i = [], first
        while not used[i]:
            used[i] = True
            walk.append(i)
            out = [k for k in leaving.get(ends[i], ()) if not used[k] or k == first]
            if not out:
                break
            back = angle[i] + np.pi
            i = out[0] if len(out) == 1 else min(out, key=lambda k: (back - angle[k]) % (2 * np.pi) or 2 * np.pi)
        if i == first and len(walk) > 2:
            walks.append(walk)
    at = np.array([i for w in walks for i in w], np.int64)
    size = np.array([len(w) for w in walks], np.int64)
    row = e.group[[w[0] for w in walks]] if walks else np.zeros(0, np.int64)
    return _straightened(Rings(row, size, e.x1[at] * GRID, e.y1[at] * GRID))


def _straightened(r: Rings) -> Rings:
    """Without vertices in the middle of a straight side."""
    if not len(r.size):
        return r
    ends = np.cumsum(r.size)
    after, before = np.arange(1, len(r.x) + 1), np.arange(-1, len(r.x) - 1)
    after[ends - 1], before[ends - r.size] = ends - r.size, ends - 1
    ax, ay, bx, by = r.x - r.x[before], r.y - r.y[before], r.x[after] - r.x, r.y[after] - r.y
    corner = np.abs(ax * by - ay * bx) > 2 * GRID * np.hypot(ax + bx, ay + by)
    ring = np.repeat(np.arange(len(r.size)), r.size)
    size = np.bincount(ring[corner], minlength=len(r.size))
    whole = size >= 3
    kept = corner & whole[ring]
    return Rings(r.row[whole], size[whole], r.x[kept], r.y[kept])


def _signed(r: Rings) -> np.ndarray:
    ends, after = np.cumsum(r.size), _after(r)
    first = np.repeat(ends - r.size, r.size)
    x, y = (r.x - r.x[first]).astype(float), (r.y - r.y[first]).astype(float)
    return np.bincount(np.repeat(np.arange(len(r.size)), r.size), (x * y[after] - x[after] * y) / 2, len(r.size)) if len(ends) else np.zeros(0)


def buffered_rings(r: Rings, by: np.ndarray, quarter: int = 16, sound: np.ndarray | None = None) -> Rings:
    """Rings of the area within ``by`` of each row's area, or for a negative one of the points that far inside.

    Every side moves to its right, corners that open give arcs of ``quarter`` steps a right angle. What of these, cut where they
    meet, is nowhere nearer to the rings than ``by`` is the outline; so a negative distance may split a row's area or leave none.
    A convex ring that grows is that outline as it stands. Rows are ``sound`` whose rings are known to be borders of an area.
    """
    easy = by[r.row] > 1024 * GRID
    if easy.any():
        whole, convex = _on_grid(r)
        easy &= convex
    if easy.any():
        grown = _grown(_some(whole, easy), by, quarter)
        return grown if easy.all() else _both_by_row(grown, buffered_rings(_some(r, ~easy), by, quarter, sound))
    own = np.zeros(len(r.row), bool) if sound is None else sound[r.row]
    if not own.all():
        r = _both_by_row(_some(r, own), outlines(_bordered(_some(r, ~own))))
    ends = np.cumsum(r.size)
    after, before = np.arange(1, len(r.x) + 1), np.arange(-1, len(r.x) - 1)
    after[ends - 1], before[ends - r.size] = ends - r.size, ends - 1
    row, d = np.repeat(r.row, r.size), np.repeat(by[r.row], r.size)
    dx, dy = r.x[after] - r.x, r.y[after] - r.y
    long = np.hypot(dx, dy)
    nx, ny = dy / long, -dx / long
    turn = np.arctan2(dx[before] * dy - dy[before] * dx, dx[before] * dx + dy[before] * dy)
    corner = np.flatnonzero(turn * d > 0)
    steps = np.maximum(1, np.ceil(np.abs(turn[corner]) / (np.pi / 2 / quarter) - 1e-9)).astype(np.int64)
    at, k = np.repeat(corner, steps), _spread(np.zeros(len(steps), np.int64), steps)
    angle = np.arctan2(ny[before], nx[before])[at]
    step = turn[at] / np.repeat(steps, steps)
    # The ends of an arc are the very ends of the sides beside it.
    first, last = k == 0, k + 1 == np.repeat(steps, steps)
    ax, ay = (np.where(first, c[at] + d[at] * n[before][at], c[at] + d[at] * f(angle + step * k)) for c, n, f in ((r.x, nx, np.cos), (r.y, ny, np.sin)))
    bx, by_ = (np.where(last, c[at] + d[at] * n[at], c[at] + d[at] * f(angle + step * (k + 1))) for c, n, f in ((r.x, nx, np.cos), (r.y, ny, np.sin)))
    group, one = np.concatenate([row, row[at]]), np.concatenate([np.arange(len(r.x)), at])
    ends_of = [np.concatenate(c) for c in ((r.x + d * nx, ax), (r.y + d * ny, ay), (r.x[after] + d * nx, bx), (r.y[after] + d * ny, by_))]
    seen = ~_hidden(ends_of, one, r, np.abs(by))
    group, one, ends_of = group[seen], one[seen], [c[seen] for c in ends_of]
    moved = Edges(group, *(np.rint(c / GRID).astype(np.int64) for c in ends_of))
    moved = moved.take(order := np.argsort(group, kind="stable"))
    pieces, of = _cut(moved)
    clear = _clear(pieces, one[order][of], r, row, np.abs(by), (at, ax, ay, bx, by_))
    return outlines(_single(pieces.take(clear)))


def _grown(r: Rings, by: np.ndarray, quarter: int) -> Rings:
    """Convex rings of whole numbers, their sides moved outward, with an arc at each corner."""
    x, y, d = r.x * GRID, r.y * GRID, np.repeat(by[r.row], r.size)
    before, after = _before(r), _after(r)
    dx, dy = x[after] - x, y[after] - y
    long = np.hypot(dx, dy)
    nx, ny = dy / long, -dx / long
    turn = np.arctan2(dx[before] * dy - dy[before] * dx, dx[before] * dx + dy[before] * dy)
    steps = np.maximum(1, np.ceil(turn / (np.pi / 2 / quarter) - 1e-9)).astype(np.int64)
    at, k = np.repeat(np.arange(len(x)), steps + 1), _spread(np.zeros(len(x), np.int64), steps + 1)
    angle = np.arctan2(ny[before], nx[before])[at] + (turn / steps)[at] * k
    first, last = k == 0, k == steps[at]
    px, py = (c[at] + d[at] * np.where(first, n[before][at], np.where(last, n[at], f(angle))) for c, n, f in ((x, nx, np.cos), (y, ny, np.sin)))
    size = np.add.reduceat(steps + 1, np.cumsum(r.size) - r.size)
    return _straightened(Rings(r.row, size, np.rint(px / GRID) * GRID, np.rint(py / GRID) * GRID))


#: Sides before and after a side's own that are looked at first.
NEAR = (-6, -5, -4, -3, -2, -1, 1, 2, 3, 4, 5, 6)


def _hidden(ends_of: list[np.ndarray], one: np.ndarray, r: Rings, least: np.ndarray) -> np.ndarray:
    """Moved sides that lie wholly in the strips along the sides near their own: what the strips cover of them is put together."""
    ends, after = np.cumsum(r.size), _after(r)
    start, size, wide = np.repeat(ends - r.size, r.size), np.repeat(r.size, r.size), least[np.repeat(r.row, r.size)] - 4 * GRID
    dx, dy = r.x[after] - r.x, r.y[after] - r.y
    long = np.hypot(dx, dy)
    ux, uy = dx / long, dy / long
    out = np.zeros(len(one), bool)

    def seen_from(m: np.ndarray, away: int) -> tuple[np.ndarray, ...]:
        """Both ends of moved sides along and across another side, its length and the half width of its strip."""
        at = one[m]
        k = start[at] + (at - start[at] + away) % size[at]
        x, y, cx, cy = r.x[k], r.y[k], ux[k], uy[k]
        x1, y1, x2, y2 = (c[m] - o for c, o in zip(ends_of, (x, y, x, y), strict=True))
        return x1 * cx + y1 * cy, x2 * cx + y2 * cy, x1 * cy - y1 * cx, x2 * cy - y2 * cx, long[k], wide[at]

    left = np.flatnonzero(size[one] > len(NEAR))
    # The sides of an arc are hidden by those beside them; others only where a strip holds their middle.
    for ways in ((-1, 1), NEAR):
        if ways is NEAR:
            some = np.zeros(len(left), bool)
            for away in NEAR:
                a1, a2, b1, b2, most, broad = seen_from(left, away)
                some |= (a1 + a2 >= -1e-9) & (a1 + a2 <= 2 * most + 1e-9) & (np.abs(b1 + b2) <= 2 * broad + 1e-9)
            left = left[some]
        if not len(left):
            break
        from_, to = (np.full((len(ways), len(left)), v) for v in (2.0, -1.0))
        for j, away in enumerate(ways):
            a1, a2, b1, b2, most, broad = seen_from(left, away)
            low, high = np.zeros(len(left)), np.ones(len(left))
            for p, q, least_v, most_v in ((a1, a2, 0.0, most), (b1, b2, -broad, broad)):
                slope = q - p
                with np.errstate(divide="ignore", invalid="ignore"):
                    t, u = (least_v - p) / slope, (most_v - p) / slope
                level, within = np.abs(slope) < 1e-12, (p >= least_v) & (p <= most_v)
                low = np.maximum(low, np.where(level, np.where(within, 0.0, 2.0), np.minimum(t, u)))
                high = np.minimum(high, np.where(level, np.where(within, 1.0, -1.0), np.maximum(t, u)))
            met = low <= high
            from_[j, met], to[j, met] = low[met], high[met]
        order = np.argsort(from_, axis=0)
        from_, to = np.take_along_axis(from_, order, 0), np.maximum.accumulate(np.take_along_axis(to, order, 0), axis=0)
        gap = (from_[1:] > to[:-1]) & (to[:-1] < 1.0)
        gone = (from_[0] <= 0) & (to[-1] >= 1.0) & ~gap.any(axis=0)
        out[left[gone]] = True
        left = left[~gone]
    return out


def _clear(e: Edges, one: np.ndarray, r: Rings, row: np.ndarray, least: np.ndarray, fans: tuple[np.ndarray, ...]) -> np.ndarray:
    """Whether the middle of each piece lies in no strip along a side and in no triangle of a corner's arc (corner, both ends of its step)."""
    ends = np.cumsum(r.size)
    after = np.arange(1, len(r.x) + 1)
    after[ends - 1] = ends - r.size
    mx, my = (e.x1 + e.x2) * (GRID / 2), (e.y1 + e.y2) * (GRID / 2)
    out = np.ones(len(mx), bool)

    def strips(m: np.ndarray, k: np.ndarray) -> np.ndarray:
        dx, dy = r.x[after[k]] - r.x[k], r.y[after[k]] - r.y[k]
        vx, vy, long = mx[m] - r.x[k], my[m] - r.y[k], np.hypot(dx, dy)
        along = vx * dx + vy * dy
        return (along >= 0) & (along <= long * long) & (np.abs(vx * dy - vy * dx) < long * (least[e.group[m]] - 4 * GRID))

    def triangles(m: np.ndarray, k: np.ndarray) -> np.ndarray:
        at, ax, ay, bx, by = (c[k] for c in fans)
        ax, ay, bx, by, vx, vy = ax - r.x[at], ay - r.y[at], bx - r.x[at], by - r.y[at], mx[m] - r.x[at], my[m] - r.y[at]
        way = np.sign(ax * by - ay * bx)
        below = way * ((bx - ax) * (vy - ay) - (by - ay) * (vx - ax)) > 4 * GRID * np.hypot(bx - ax, by - ay)
        return below & (way * (ax * vy - ay * vx) >= 0) & (way * (vx * by - vy * bx) >= 0)

    # Most pieces are too near to a side close to their own.
    start, size = np.repeat(ends - r.size, r.size)[one], np.repeat(r.size, r.size)[one]
    for away in (-1, 1, -2, 2):
        m = np.flatnonzero(out)
        out[m[strips(m, start[m] + (one[m] - start[m] + away) % size[m])]] = False
    # Each other strip and triangle meets the pieces whose middles lie between its ends in x.
    at, ax, ay, bx, by = fans
    low, high, bottom, top = (f(c, c[after]) + s * least[row] for c in (r.x, r.y) for f, s in ((np.minimum, -1), (np.maximum, 1)))
    corners = [f(f(p, q), c[at]) for p, q, c in ((ax, bx, r.x), (ay, by, r.y)) for f in (np.minimum, np.maximum)]
    if not len(mx):
        return out
    base = np.full(max(e.group.max(), row.max()) + 1, np.inf)
    np.minimum.at(base, e.group, mx)
    np.minimum.at(base, row, low)
    wide = max((mx - base[e.group]).max(), (high - base[row]).max()) + 1
    slack = 8 * GRID + 1e-15 * wide * len(base)
    for of_row, test, low, high, bottom, top in ((row, strips, low, high, bottom, top), (row[at], triangles, *corners)):
        left = np.flatnonzero(out)
        place = e.group[left] * wide + (mx[left] - base[e.group[left]])
        left = left[order := np.argsort(place)]
        first, last = (np.searchsorted(place[order], of_row * wide + (c - base[of_row]), side=side) for c, side in ((low - slack, "left"), (high + slack, "right")))
        counts = last - first
        for part in _chunks(counts):
            k, m = np.repeat(np.arange(part.start, part.stop), counts[part]), left[_spread(first[part], counts[part])]
            near = (my[m] >= bottom[k]) & (my[m] <= top[k])
            k, m = k[near], m[near]
            out[m[test(m, k)]] = False
    return out


def _single(e: Edges) -> Edges:
    """Each edge once, and none that is gone both ways."""
    order = np.lexsort((e.y2, e.x2, e.y1, e.x1, e.group))
    e = e.take(order)
    e = e.take(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in e], axis=0)]) if len(order) else order)
    some = np.flatnonzero(np.isin(_names(*e), _names(e.group, e.x2, e.y2, e.x1, e.y1)))
    back = {*zip(*(c[some].tolist() for c in (e.group, e.x2, e.y2, e.x1, e.y1)), strict=True)}
    kept = np.ones(len(e.group), bool)
    kept[some] = [k not in back for k in zip(*(c[some].tolist() for c in e), strict=True)]
    return e.take(kept)


def _lists(r: Rings, rows: int) -> pa.Array:
    """A segmentation for each row."""
    if (r.row[1:] < r.row[:-1]).any():
        r = _by_row(r)
    numbers = np.stack([r.x, r.y], axis=1).reshape(-1)
    rings = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(2 * r.size)]).astype(np.int32)), pa.array(numbers, pa.float64()))
    ends = np.concatenate([[0], np.cumsum(np.bincount(r.row, minlength=rows))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), rings)


def _parts(r: Rings, rows: int) -> pa.Array:
    """Parts for each row: an outer ring and the holes that lie in it and in no smaller one."""
    ends = np.cumsum(r.size)
    signed = _signed(r)
    out: list[list[list[list[float]]]] = [[] for _ in range(rows)]
    flat = lambda i: np.stack([r.x[ends[i] - r.size[i] : ends[i]], r.y[ends[i] - r.size[i] : ends[i]]], axis=1).reshape(-1).tolist()
    outer: dict[int, list[tuple[float, int, int]]] = {}
    for i in np.flatnonzero(signed > 0).tolist():
        outer.setdefault(int(r.row[i]), []).append((float(signed[i]), i, len(out[r.row[i]])))
        out[r.row[i]].append([flat(i)])
    for i in np.flatnonzero(signed < 0).tolist():
        lo = ends[i] - r.size[i]
        x, y = (r.x[lo] + r.x[lo + 1]) / 2, (r.y[lo] + r.y[lo + 1]) / 2
        for _, k, place in sorted(outer.get(int(r.row[i]), [])):
            own = slice(ends[k] - r.size[k], ends[k])
            px, py = r.x[own], r.y[own]
            qx, qy = np.roll(px, -1), np.roll(py, -1)
            crossed = (py > y) != (qy > y)
            if (crossed & (x < px + (y - py) * (qx - px) / np.where(qy == py, 1, qy - py))).sum() % 2:
                out[r.row[i]][place].append(flat(i))
                break
    return pa.array(out, pa.list_(pa.list_(pa.list_(pa.float64()))))


def _both(left: pa.Array, right: pa.Array) -> tuple[Edges, Edges]:
    """Borders of either side's areas, row by row."""
    return _bordered(rings_of(left)), _bordered(rings_of(right))


def _joined(*sides: Edges) -> Edges:
    every = Edges(*(np.concatenate(c) for c in zip(*sides, strict=True)))
    return every.take(np.argsort(every.group, kind="stable"))


def _in_slices(f):
    """``f`` over rows a few at a time, so that what is worked out on the way stays small."""

    @functools.wraps(f)
    def over(*columns: pa.Array) -> pa.Array:
        rows = len(columns[0])
        each = max(1, rows * BYTES // max(1, sum(c.nbytes for c in columns)))
        if each >= rows:
            return f(*columns)
        return pa.concat_arrays([f(*(c.slice(k, each) for c in columns)) for k in range(0, rows, each)])

    return over


def _common(left: pa.Array, right: pa.Array) -> np.ndarray:
    return areas(covered(_joined(*_both(left, right)), 2), len(left))


@arrow_udf(DoubleType())
@_in_slices
def shared_area(left: pa.Array, right: pa.Array) -> pa.Array:
    """Area that two segmentations have in common."""
    return pa.array(_common(left, right))


@arrow_udf(BooleanType())
@_in_slices
def share_area(left: pa.Array, right: pa.Array) -> pa.Array:
    """Whether two segmentations have area in common: the middle of the boxes' common part shows it where it lies well inside both, the overlay else."""
    one, other = rings_of(left), rings_of(right)
    low, high = np.full((2, len(left)), -np.inf), np.full((2, len(left)), np.inf)
    for r in (one, other):
        box = np.full((2, len(left)), np.inf), np.full((2, len(left)), -np.inf)
        for axis, c in enumerate((r.x, r.y)):
            if len(r.size):
                starts, of = (np.cumsum(r.size) - r.size), r.row
                np.minimum.at(box[0][axis], of, np.minimum.reduceat(c, starts))
                np.maximum.at(box[1][axis], of, np.maximum.reduceat(c, starts))
        low, high = np.maximum(low, box[0]), np.minimum(high, box[1])
    apart = (low > high + 4 * GRID).any(axis=0)
    with np.errstate(invalid="ignore"):
        x, y = np.where(apart, 0.0, (low + high) / 2)
    out = _well_inside(one, x, y) & _well_inside(other, x, y) & ~apart
    open_ = np.flatnonzero(~out & ~apart)
    if len(open_):
        out[open_] = _common(left.take(pa.array(open_)), right.take(pa.array(open_))) > 0
    return pa.array(out)


def _well_inside(r: Rings, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether each row's point lies in its area, over ``INSIDE`` from all sides."""
    row, after, rows = np.repeat(r.row, r.size), _after(r), len(x)
    ax, ay = r.x - x[row], r.y - y[row]
    dx, dy = r.x[after] - r.x, r.y[after] - r.y
    cross, square = dx * ay - dy * ax, dx * dx + dy * dy
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.clip(np.where(square > 0, -(ax * dx + ay * dy) / square, 0.0), 0.0, 1.0)
    near = (ax + t * dx) ** 2 + (ay + t * dy) ** 2 <= INSIDE * INSIDE
    over = ((ay > 0) != (ay + dy > 0)) & ((cross > 0) != (dy > 0))
    return (np.bincount(row[over], minlength=rows) % 2 == 1) & (np.bincount(row[near], minlength=rows) == 0)


@arrow_udf(DoubleType())
@_in_slices
def iou(left: pa.Array, right: pa.Array) -> pa.Array:
    """Intersection over union of two segmentations; 0 for an empty union."""
    return pa.array(shares(rings_of(left), rings_of(right), len(left)))


def shares(left: Rings, right: Rings, rows: int) -> np.ndarray:
    """Intersection over union, row by row."""
    one, other = _bordered(left), _bordered(right)
    common = areas(covered(_joined(one, other), 2), rows)
    union = areas(one, rows) + areas(other, rows) - common
    return np.where(union > 0, common / np.where(union > 0, union, 1), 0.0)


def _partners(r: Rings, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """First side and number of sides of each row."""
    n = np.bincount(np.repeat(r.row, r.size), minlength=rows)
    return np.cumsum(n) - n, n


def touching(one: Rings, other: Rings, rows: int) -> np.ndarray:
    """Whether the areas of both sides share a point, row by row: sides that meet, or a ring that lies in the other's area."""
    out = np.zeros(rows, bool)
    for a, b, sides in ((one, other, True), (one, other, False), (other, one, False)):
        start, n = _partners(b, rows)
        mine = np.arange(len(a.x)) if sides else (np.cumsum(a.size) - a.size)
        row = np.repeat(a.row, a.size)[mine]
        to, by = _after(a)[mine], _after(b)
        odd = np.zeros(len(mine), np.int64)
        for part in _chunks(n[row]):
            i, k = np.repeat(np.arange(part.start, part.stop), n[row[part]]), _spread(start[row[part]], n[row[part]])
            px, py, cx, cy, dx, dy = a.x[mine[i]], a.y[mine[i]], b.x[k], b.y[k], b.x[by[k]], b.y[by[k]]
            turn = lambda ax, ay, bx, by, x, y: np.sign((bx - ax) * (y - ay) - (by - ay) * (x - ax))
            if sides:
                qx, qy = a.x[to[i]], a.y[to[i]]
                near = (np.minimum(px, qx) <= np.maximum(cx, dx)) & (np.minimum(cx, dx) <= np.maximum(px, qx)) & (np.minimum(py, qy) <= np.maximum(cy, dy)) & (np.minimum(cy, dy) <= np.maximum(py, qy))
                meet = near & (turn(px, py, qx, qy, cx, cy) * turn(px, py, qx, qy, dx, dy) <= 0) & (turn(cx, cy, dx, dy, px, py) * turn(cx, cy, dx, dy, qx, qy) <= 0)
                out[row[i[meet]]] = True
            else:
                crossed = ((cy > py) != (dy > py)) & (turn(cx, cy, dx, dy, px, py) * np.where(dy > cy, 1, -1) > 0)
                np.add.at(odd, i[crossed], 1)
        out[row[odd % 2 == 1]] = True
    return out


@arrow_udf(BooleanType())
def touch(left: pa.Array, right: pa.Array) -> pa.Array:
    """Whether two segmentations, as closed areas, share a point; an empty one touches nothing."""
    return pa.array(touching(rings_of(left), rings_of(right), len(left)))


@arrow_udf(DoubleType())
@_in_slices
def area(segmentations: pa.Array) -> pa.Array:
    return pa.array(areas(_bordered(rings_of(segmentations)), len(segmentations)))


@arrow_udf(PARTS)
def repaired(segmentations: pa.Array) -> pa.Array:
    """The parts of a segmentation whose rings may cross or touch themselves and each other."""
    return _parts(outlines(even_odd(rings_of(segmentations).edges())), len(segmentations))


@arrow_udf(SEGMENTATION)
@_in_slices
def buffered(segmentations: pa.Array, by: pa.Array) -> pa.Array:
    """The rings of an area grown (or for a negative distance shrunk) by ``by``, corners rounded by 16 steps a quarter turn."""
    return _lists(buffered_rings(rings_of(segmentations), by.to_numpy(zero_copy_only=False).astype(float)), len(segmentations))


def _flattened(groups: pa.Array) -> tuple[pa.Array, np.ndarray]:
    counts = np.where(groups.is_valid().to_numpy(zero_copy_only=False), np.diff(groups.offsets.to_numpy()), 0)
    return groups.flatten(), np.repeat(np.arange(len(groups)), counts)


def _union(groups: pa.Array) -> tuple[Rings, np.ndarray]:
    """The union of each row's list of segmentations, and in which rows its rings have all the cut pieces as their sides, so that they meet at ends only."""
    members, row = _flattened(groups)
    borders = covered(_bordered(rings_of(members), row))
    r = outlines(borders)
    return r, np.bincount(borders.group, minlength=len(groups)) == np.bincount(np.repeat(r.row, r.size), minlength=len(groups))


@arrow_udf(SEGMENTATION)
@_in_slices
def united(groups: pa.Array) -> pa.Array:
    """The rings of the union of each row's list of segmentations, holes too."""
    return _lists(_union(groups)[0], len(groups))


@arrow_udf(SEGMENTATION)
@_in_slices
def united_buffered(groups: pa.Array, by: pa.Array) -> pa.Array:
    """``buffered`` of the union of each row's list of segmentations."""
    r, sound = _union(groups)
    return _lists(buffered_rings(r, by.to_numpy(zero_copy_only=False).astype(float), sound=sound), len(groups))


@arrow_udf(PARTS)
def parts_of(segmentations: pa.Array) -> pa.Array:
    """Outer rings with their holes."""
    return _parts(outlines(even_odd(rings_of(segmentations).edges())), len(segmentations))
