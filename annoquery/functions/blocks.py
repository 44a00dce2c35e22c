"""Masks as blocks in numpy: rows y to y1 - 1 with the run x0 to x1 - 1. A column of masks holds y, y1, x0, x1 of its blocks one after the other.

Each function takes the masks of a slice of a batch at once; ``owner`` is the place of a block's mask in it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Row runs that are laid out at once, a few MB; a single larger mask is laid out alone.
SLICE = 1 << 18


def spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All numbers of ranges, one range after the other."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def ordered(*keys: np.ndarray) -> np.ndarray:
    """Places in the order of whole numbers, the last key first as in ``np.lexsort``; equal rows in any order. Keys that fit in one number are sorted as one."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    low = [int(k.min()) for k in keys]
    span = [int(k.max()) - a + 1 for k, a in zip(keys, low)]
    if math.prod(span) >= 1 << 62:
        return np.lexsort(keys)
    line = keys[-1] - low[-1]
    for k, a, n in list(zip(keys, low, span))[-2::-1]:
        line = line * n + (k - a)
    return np.arange(len(line)) if (line[1:] >= line[:-1]).all() else np.argsort(line)


def of_lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of the lists; a null one is empty."""
    lengths = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), lengths


def read(column: pa.Array) -> tuple[np.ndarray, ...]:
    """(owner, y, y1, x0, x1) of a column of masks."""
    values, lengths = of_lists(column)
    return (np.repeat(np.arange(len(column)), lengths // 4), *values.reshape(-1, 4).T.astype(np.int64))


def column_of(n: int, owner: np.ndarray, *block: np.ndarray) -> pa.Array:
    """A column of n masks; blocks come by owner."""
    offsets = np.searchsorted(owner, np.arange(n + 1)) * 4
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.stack(block, axis=1).astype(np.int32).ravel()))


def opened(owner: np.ndarray, y: np.ndarray, y1: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row runs (owner, y, x0, x1) of blocks."""
    n = y1 - y
    return np.repeat(owner, n), spread(y, n), np.repeat(x0, n), np.repeat(x1, n)


def _lines(wide: int, low: int, line: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return line * wide + x0 - low, line * wide + x1 - low


def united(owner: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row runs merged where they meet or touch."""
    if not len(owner):
        return owner, y, x0, x1
    order = ordered(x0, y, owner)
    owner, y, x0, x1 = owner[order], y[order], x0[order], x1[order]
    line = np.cumsum(np.append(False, (owner[1:] != owner[:-1]) | (y[1:] != y[:-1])))
    low, high = int(x0.min()), int(x1.max())
    a, b = _lines(high - low + 2, low, line, x0, x1)  # one place more than a row has, so that rows never touch
    reach = np.maximum.accumulate(b)
    first = np.flatnonzero(np.append(True, a[1:] > reach[:-1]))
    last = np.append(first[1:], len(a)) - 1
    return owner[first], y[first], x0[first], reach[last] - line[last] * (high - low + 2) + low


def stacked(owner: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> tuple[np.ndarray, ...]:
    """Blocks (owner, y, y1, x0, x1) of row runs that do not meet: equal runs of rows that follow each other become one."""
    order = ordered(y, x1, x0, owner)
    owner, y, x0, x1 = owner[order], y[order], x0[order], x1[order]
    same = (owner[1:] == owner[:-1]) & (x0[1:] == x0[:-1]) & (x1[1:] == x1[:-1]) & (y[1:] == y[:-1] + 1)
    first = np.flatnonzero(np.append(True, ~same)) if len(owner) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(owner)) - 1 if len(owner) else first
    return owner[first], y[first], y[last] + 1, x0[first], x1[first]


def pixels(n: int, owner: np.ndarray, y: np.ndarray, y1: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> np.ndarray:
    return np.bincount(owner, (y1 - y) * (x1 - x0), n).astype(np.int64)


def slices(rows: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of masks with about ``SLICE`` row runs together."""
    total, at = np.cumsum(rows), 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + SLICE, "right")))
        yield at, to
        at = to


def _cut(mask: tuple, lo: int, hi: int) -> tuple:
    a, b = np.searchsorted(mask[0], [lo, hi])
    return (mask[0][a:b] - lo, *(c[a:b] for c in mask[1:]))


def shared(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Pixels that the two masks of each row have in common; blocks of one mask do not meet.

    Pairs of few blocks are compared block by block, the others as row runs on one line of all pixels.
    """
    n, l, r = len(left), read(left), read(right)
    out = np.zeros(n, np.int64)
    nl, nr = (np.bincount(m[0], minlength=n) for m in (l, r))
    rows = sum(np.bincount(m[0], m[2] - m[1], n) for m in (l, r)) * ((nl > 0) & (nr > 0))
    few = nl * nr <= np.minimum(rows, 1024)
    own = few[l[0]]
    count = nr[l[0]] * own
    for lo, hi in slices(count):
        i = np.repeat(np.arange(lo, hi), count[lo:hi])
        j = spread((np.cumsum(nr) - nr)[l[0][lo:hi]], count[lo:hi])
        high = np.minimum(l[2][i], r[2][j]) - np.maximum(l[1][i], r[1][j])
        wide = np.minimum(l[4][i], r[4][j]) - np.maximum(l[3][i], r[3][j])
        out += np.bincount(l[0][i], np.maximum(high, 0) * np.maximum(wide, 0), n).astype(np.int64)
    for lo, hi in slices(np.where(few, 0, rows)):
        if few[lo:hi].all():
            continue
        sides = []
        for m in (l, r):
            part = _cut(m, lo, hi)
            keep = ~few[lo:hi][part[0]]
            sides.append(opened(*(c[keep] for c in part)))
        (po, py, p0, p1), (qo, qy, q0, q1) = sides
        top, low = min(py.min(), qy.min()), min(p0.min(), q0.min())
        tall, wide = max(py.max(), qy.max()) - top + 1, max(p1.max(), q1.max()) - low + 1
        a, b = _lines(wide, low, po * tall + py - top, p0, p1)
        c, d = _lines(wide, low, qo * tall + qy - top, q0, q1)
        order = np.argsort(c)
        c, d = c[order], d[order]
        total = np.append(0, np.cumsum(d - c))

        def before(t):
            k = np.searchsorted(c, t, "right")
            return total[k] - np.where(k > 0, np.maximum(0, d[k - 1] - t), 0)

        out[lo:hi] += np.bincount(po, before(b) - before(a), hi - lo).astype(np.int64)
    return out


def joined(mask: tuple) -> tuple[np.ndarray, ...]:
    """Blocks of the union of each owner's blocks (sorted by owner), which may meet.

    Blocks are cut at the upper and lower ends of their owner's blocks, not into rows: a cut never has more parts than the block has rows.
    """
    owner, y, y1, x0, x1 = mask
    n = len(owner)
    if not n:
        return mask
    of, at = np.append(owner, owner), np.append(y, y1)
    order = ordered(at, of)
    of, at = of[order], at[order]
    new = np.append(True, (of[1:] != of[:-1]) | (at[1:] != at[:-1]))
    ends = at[new]
    place = np.empty(2 * n, np.int64)
    place[order] = np.cumsum(new) - 1
    cuts = (owner, place[:n], place[n:], x0, x1)
    parts = []
    for lo, hi in slices(np.bincount(owner, cuts[2] - cuts[1])):
        own, first, last, *side = stacked(*united(*opened(*_cut(cuts, lo, hi))))
        parts.append((own + lo, ends[first], ends[last], *side))
    return tuple(np.concatenate(c) for c in zip(*parts))


def patches(column: pa.Array, size: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(owner, patch_x, patch_y, pixels) of the size x size patches that masks cover, in slices of masks."""
    mask = read(column)
    across, down = (mask[4] - 1) // size - mask[3] // size + 1, (mask[2] - 1) // size - mask[1] // size + 1
    for lo, hi in slices(np.bincount(mask[0], across * down, len(column))):
        owner, y, y1, x0, x1 = _cut(mask, lo, hi)
        a, b = np.searchsorted(mask[0], [lo, hi])
        n = (across * down)[a:b]
        i, at = np.repeat(np.arange(b - a), n), spread(np.zeros(b - a, np.int64), n)
        wide = across[a:b][i]
        px, py = x0[i] // size + at % wide, y[i] // size + at // wide
        covered = (np.minimum(x1[i], (px + 1) * size) - np.maximum(x0[i], px * size)) * (np.minimum(y1[i], (py + 1) * size) - np.maximum(y[i], py * size))
        order = ordered(px, py, owner[i])
        own, px, py, covered = owner[i][order] + lo, px[order], py[order], covered[order]
        if len(own):
            first = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (py[1:] != py[:-1]) | (px[1:] != px[:-1])))
            yield own[first], px[first], py[first], np.add.reduceat(covered, first)


def scanned(column: pa.Array) -> tuple[np.ndarray, ...]:
    """Row runs (owner, y, x0, x1), united, of rows of polygons (x, y, x, y ...): pixels whose centre is inside, by the even-odd rule in each polygon. Edges with a coordinate that is no number are left out."""
    values, parts = of_lists(column)
    polygons = column.flatten()
    points, sizes = of_lists(polygons)
    points = points.astype(np.float64)
    mask = np.repeat(np.arange(len(column)), parts)
    n_edges = sizes // 2
    part = np.repeat(np.arange(len(polygons)), n_edges)
    i, n, base = spread(np.zeros(len(n_edges), np.int64), n_edges), sizes[part], (np.cumsum(sizes) - sizes)[part]
    xa, ya, xb, yb = (points[base + (2 * i + k) % n] for k in range(4)) if len(part) else (np.zeros(0),) * 4
    fit = np.isfinite(xa) & np.isfinite(ya) & np.isfinite(xb) & np.isfinite(yb)
    part, xa, ya, xb, yb = part[fit], xa[fit], ya[fit], xb[fit], yb[fit]
    # the edge is crossed by the rows whose middle lies from its lower end on and before its upper one
    low = np.ceil(np.minimum(ya, yb) - 0.5).astype(np.int64)
    n = np.ceil(np.maximum(ya, yb) - 0.5).astype(np.int64) - low
    found = [np.zeros((4, 0), np.int64)]
    rows = np.bincount(part, n, len(polygons))
    for lo, hi in slices(rows):
        a, b = np.searchsorted(part, [lo, hi])
        e = np.repeat(np.arange(a, b), n[a:b])
        y = spread(low[a:b], n[a:b])
        place = np.ceil(xa[e] + (y + 0.5 - ya[e]) * (xb[e] - xa[e]) / (yb[e] - ya[e]) - 0.5).astype(np.int64)
        order = ordered(place, y, part[e])
        of, y, place = part[e][order], y[order], place[order]
        new = np.append(True, (of[1:] != of[:-1]) | (y[1:] != y[:-1])) if len(of) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        even = (np.arange(len(of)) - np.repeat(first, np.diff(np.append(first, len(of))))) % 2 == 0
        at = np.flatnonzero(even & np.append(~new[1:], False)[: len(of)])
        at = at[place[at + 1] > place[at]]
        found.append(np.stack([mask[of[at]], y[at], place[at], place[at + 1]]))
    return united(*np.concatenate(found, axis=1))
