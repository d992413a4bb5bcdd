"""Work on the buckets of two tables as arrays: what lies in one bucket is compared by numpy, not pair by pair as rows.

``bucketed`` brings the rows of two tables that share a bucket together and streams what a function makes of them. Arithmetic
follows the column expressions of ``functions.geo`` operation for operation, so both give the same bits. Null coordinates are NaN
and lie nowhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pairs, or sides of pairs, that are held at a time; pairs in a batch of results.
MANY, BATCH = 400_000, 200_000

Work = Callable[[pa.Table, pa.Table], Iterator[pa.Table]]


def bucketed(left: DataFrame, right: DataFrame, keys: Sequence[str], work: Work, schema: T.StructType, lone: bool = False) -> DataFrame:
    """``work`` on the rows of both tables of each value of ``keys`` that both have, with ``lone`` that the left one has; the tables
    it is given lack the keys."""
    sides = [[c for c in df.columns if c not in keys] for df in (left, right)]
    packed = [df.select(*keys, F.struct(*names).alias(side)) for df, names, side in zip((left, right), sides, ("__l", "__r"))]
    both = packed[0].unionByName(packed[1], allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        first, second = _part(table, "__l"), _part(table, "__r")
        del table
        if first.num_rows and (second.num_rows or lone):
            for made in work(first, second):
                yield from made.combine_chunks().to_batches()

    # The annotations are read by the caller of the function, and postponed ones are only texts there.
    run.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return both.groupBy(*keys).applyInArrow(run, schema)


def _part(table: pa.Table, side: str) -> pa.Table:
    column = table.column(side)
    column = _whole(column.filter(column.is_valid()))
    return pa.table({column.type.field(i).name: column.field(i) for i in range(column.type.num_fields)})


def by_side(batches: Iterator[pa.RecordBatch], key: str, work: Callable[[pa.Table, pa.Table], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """``work`` on the rows of both tables (``__l``, ``__r``) of each value of ``key`` that both have."""
    held = list(batches)
    if not held:
        return
    table = pa.Table.from_batches(held)
    values = pc.unique(table.column(key))
    sides = []
    for value in values:
        own = table if len(values) == 1 else table.filter(pc.equal(table.column(key), value))
        sides.append(tuple(_part(own, side) for side in ("__l", "__r")))
    # Only what the work itself holds on to stays in memory.
    del held, table, own
    while sides:
        if all(side.num_rows for side in sides[-1]):
            yield from work(*sides.pop())
        else:
            sides.pop()


def numbers(table: pa.Table, *names: str) -> np.ndarray:
    """Columns as rows of doubles, nulls as NaN."""
    return np.stack([_whole(table.column(n)).cast(pa.float64()).to_numpy(zero_copy_only=False) for n in names])


def _whole(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of the given lengths one after another: the run and the place in it of each entry."""
    run = np.repeat(np.arange(len(counts)), counts)
    return run, np.arange(len(run)) - np.repeat(np.cumsum(counts) - counts, counts)


def chunks(sizes: np.ndarray, most: int = MANY) -> Iterator[slice]:
    """Slices of entries whose sizes sum up to ``most`` at most (one entry at least)."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield slice(at, upto)
        at = upto


class Rings:
    """Rings as flat sides (corner and the corner before it)."""

    def __init__(self, rings: pa.Array) -> None:
        self.count = pc.fill_null(pc.list_value_length(rings), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        points = rings.flatten()
        self.x, self.y = (pc.struct_field(points, c).to_numpy(zero_copy_only=False).astype(np.float64) for c in "xy")
        self.start = np.cumsum(self.count) - self.count
        before = np.arange(-1, len(self.x) - 1)
        some = self.count > 0
        before[self.start[some]] = (self.start + self.count - 1)[some]
        self.bx, self.by = self.x[before], self.y[before]

    def contain(self, ring: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Even-odd test of each point against the ring of its number."""
        found = np.zeros(len(ring), np.bool_)
        for some in chunks(self.count[ring]):
            r, px, py = ring[some], x[some], y[some]
            n = self.count[r]
            run, place = spread(n)
            side, tx, ty = self.start[r][run] + place, px[run], py[run]
            ay, by = self.y[side], self.by[side]
            over = np.flatnonzero((ay > ty) != (by > ty))
            side, tx, ty, ay, by, run = side[over], tx[over], ty[over], ay[over], by[over], run[over]
            ax, bx = self.x[side], self.bx[side]
            left = tx < (bx - ax) * (ty - ay) / (by - ay) + ax
            found[some] = np.bincount(run[left], minlength=len(r)) % 2 == 1
        return found


class Areas:
    """Areas (``shell, holes``) and their bounds."""

    def __init__(self, table: pa.Table) -> None:
        holes = _whole(table.column("holes"))
        self.shell, self.hole = Rings(_whole(table.column("shell"))), Rings(holes.flatten())
        self.holes = pc.fill_null(pc.list_value_length(holes), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.first = np.cumsum(self.holes) - self.holes
        # Without a list of holes an area covers nothing, as in the column expression.
        self.known = holes.is_valid().to_numpy(zero_copy_only=False)
        n = len(self.holes)
        self.w, self.e, self.s, self.n = (np.full(n, v) for v in (np.inf, -np.inf, np.inf, -np.inf))
        owner = np.repeat(np.arange(n), self.shell.count)
        for to, pick, values in ((self.w, np.fmin, self.shell.x), (self.e, np.fmax, self.shell.x), (self.s, np.fmin, self.shell.y), (self.n, np.fmax, self.shell.y)):
            pick.at(to, owner, values)

    def cover(self, area: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether each point lies in the area of its number."""
        found = self.known[area] & self.shell.contain(area, x, y)
        inside = np.flatnonzero(found)
        for k in range(int(self.holes[area[inside]].max(initial=0))):
            asked = inside[self.holes[area[inside]] > k]
            found[asked[self.hole.contain(self.first[area[asked]] + k, x[asked], y[asked])]] = False
            inside = inside[found[inside]]
        return found


def segment_distance(x, y, x0, y0, x1, y1) -> np.ndarray:
    dx, dy = x1 - x0, y1 - y0
    length2 = dx * dx + dy * dy
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.where(length2 > 0, np.minimum(np.maximum(((x - x0) * dx + (y - y0) * dy) / length2, 0.0), 1.0), 0.0)
    ex, ey = x - (x0 + t * dx), y - (y0 + t * dy)
    return np.sqrt(ex * ex + ey * ey)


class Segments:
    """Segments (``x0, y0, x1, y1``) of a half width each."""

    def __init__(self, ends: np.ndarray, half: np.ndarray) -> None:
        self.ends, self.half = ends, half
        x0, y0, x1, y1 = ends
        # Rounding of the distance may bring a point in that the bounds just miss.
        reach = half + 1e-12
        self.w, self.e, self.s, self.n = np.minimum(x0, x1) - reach, np.maximum(x0, x1) + reach, np.minimum(y0, y1) - reach, np.maximum(y0, y1) + reach

    def cover(self, which: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return segment_distance(x, y, *self.ends[:, which]) <= self.half[which]


def covering(shapes: Areas | Segments, x: np.ndarray, y: np.ndarray, once: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of shapes and of points they cover; with ``once`` each point comes with one shape only."""
    order = np.argsort(y, kind="stable")
    ys, xs = y[order], x[order]
    held, size = [], 0
    for k in range(len(shapes.w)):
        low, high = np.searchsorted(ys, shapes.s[k], "left"), np.searchsorted(ys, shapes.n[k], "right")
        near = low + np.flatnonzero((xs[low:high] >= shapes.w[k]) & (xs[low:high] <= shapes.e[k]))
        held.append((k, near))
        size += len(near)
        if size < BATCH and k < len(shapes.w) - 1:
            continue
        which, points = np.repeat([h[0] for h in held], [len(h[1]) for h in held]), np.concatenate([h[1] for h in held])
        hit = shapes.cover(which, xs[points], ys[points])
        which, points, held, size = which[hit], points[hit], [], 0
        if once:
            points, at = np.unique(points, return_index=True)
            which = which[at]
        if len(points):
            yield which, order[points]
        if once:
            left = np.ones(len(order), np.bool_)
            left[points] = False
            order, xs, ys = order[left], xs[left], ys[left]
            if not len(order):
                return


def first_covering(shapes: Areas | Segments, order: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each point the place in ``order`` (numbers of shapes, the first to win) of the first shape that covers it, or -1."""
    best = np.full(len(x), -1, np.int64)
    open_, at = np.arange(len(x)), 0
    while at < len(order) and len(open_):
        block = order[at : at + max(8, MANY // len(open_))]
        px, py = x[open_], y[open_]
        near = (px >= shapes.w[block][:, None]) & (px <= shapes.e[block][:, None]) & (py >= shapes.s[block][:, None]) & (py <= shapes.n[block][:, None])
        k, p = np.nonzero(near)
        hit = shapes.cover(block[k], px[p], py[p])
        k, p = k[hit], p[hit]
        # Pairs come in the order of the shapes, so the first of a point is its best.
        points, first = np.unique(p, return_index=True)
        best[open_[points]] = at + k[first]
        left = np.ones(len(open_), np.bool_)
        left[points] = False
        open_, at = open_[left], at + len(block)
    return best


def near_segments(ends: np.ndarray, x: np.ndarray, y: np.ndarray, radius: float, slack: float | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Numbers of segments and points within ``radius``, and their distances; with ``slack`` only segments at most that much
    further from a point than its nearest one.

    Squares that hold the points are quartered; a square keeps the segments that may be near any of its points.
    """
    found, size = [], 0
    # Those without a place are near nothing.
    there = np.flatnonzero(np.isfinite(x) & np.isfinite(y))
    squares = [(there, np.flatnonzero(np.isfinite(ends).all(axis=0)))] if len(there) else []
    while squares:
        points, parts = squares.pop()
        px, py = x[points], y[points]
        west, east, south, north = px.min(), px.max(), py.min(), py.max()
        cx, cy, half = (west + east) / 2, (south + north) / 2, float(np.hypot(east - west, north - south)) / 2
        away = segment_distance(cx, cy, *ends[:, parts])
        reach = radius + half
        if slack is not None and len(away):
            reach = min(reach, float(away.min()) + 2 * half + slack)
        parts = parts[away <= reach + 1e-12]
        if not len(parts):
            continue
        if len(points) > 1 and half > 0 and len(points) * len(parts) > 2000 and half > radius / 4:
            split = px > cx if east - west >= north - south else py > cy
            if split.any() and not split.all():
                squares += [(points[split], parts), (points[~split], parts)]
                continue
        for some in chunks(np.full(len(points), len(parts))):
            distance = segment_distance(px[some][:, None], py[some][:, None], *ends[:, parts])
            near = distance <= radius
            if slack is not None:
                near &= distance <= distance.min(axis=1)[:, None] + slack
            i, j = np.nonzero(near)
            if len(i):
                found.append((parts[j], points[some][i], distance[i, j]))
                size += len(i)
            if size >= BATCH:
                yield tuple(map(np.concatenate, zip(*found)))
                found, size = [], 0
    if found:
        yield tuple(map(np.concatenate, zip(*found)))


#: Points that a step along a segment should find, about.
FEW = 4.0


def along_segments(ends: np.ndarray, x: np.ndarray, y: np.ndarray, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """What ``near_segments`` gives without slack, for many points along many segments: points lie in the cells of strips, and a
    segment asks in each strip it crosses for the few cells next to it. Batches are in the order of the segments, those that are
    steep before the others.
    """
    there = np.flatnonzero(np.isfinite(x) & np.isfinite(y))
    known = np.isfinite(ends).all(axis=0)
    if not len(there) or not known.any():
        return
    flat = np.abs(ends[2] - ends[0]) > np.abs(ends[3] - ends[1])
    # Rounding of the strips' and the line's places may bring a point in that the bounds just miss.
    pad = radius + 1e-9 * max(1.0, float(np.abs(ends[:, known]).max()))
    # The grid covers the part of the unit square that has points; what lies beyond is held by its border.
    grid = [(float(np.clip(v.min(), 0, 1)), float(np.clip(v.max(), 0, 1))) for v in (x[there], y[there])]
    spans = [max(high - low, 1e-6) for low, high in grid]
    step = float(np.sqrt(radius * radius + FEW * spans[0] * spans[1] / len(there))) - radius
    for level in (False, True):
        # Strips lie across the axis that the segments follow: v is the place in a strip.
        (u, u_axis), (v, v_axis) = ((x, 0), (y, 1)) if level else ((y, 1), (x, 0))
        own = np.flatnonzero(known & (flat == level))
        if not len(own):
            continue
        strips, cells = (int(np.clip(spans[axis] / size, 1, 2048)) for axis, size in ((u_axis, step), (v_axis, step / 2)))
        place = lambda at, axis, n: np.clip(np.floor((at - grid[axis][0]) * (n / spans[axis])), 0, n - 1).astype(np.int64)  # noqa: E731, B023
        cell = place(u[there], u_axis, strips) * cells + place(v[there], v_axis, cells)
        order = np.argsort(cell, kind="stable")
        begin = np.concatenate(([0], np.cumsum(np.bincount(cell, minlength=strips * cells))))
        points = there[order]
        px, py = x[points], y[points]
        edges = grid[u_axis][0] + np.arange(strips + 1) * (spans[u_axis] / strips)
        edges[0], edges[-1] = -np.inf, np.inf
        u0, v0, u1, v1 = ends[[0, 1, 2, 3] if level else [1, 0, 3, 2]][:, own]
        low, high = np.minimum(u0, u1) - pad, np.maximum(u0, u1) + pad
        slope = np.divide(v1 - v0, u1 - u0, out=np.zeros(len(own)), where=u1 != u0)
        reach = pad * np.sqrt(1 + slope * slope)
        first = place(low, u_axis, strips)
        steps = place(high, u_axis, strips) - first + 1
        for some in chunks(steps, BATCH):
            run, at = spread(steps[some])
            k = run + some.start
            strip = first[k] + at
            a = v0[k] + (np.maximum(edges[strip], low[k]) - u0[k]) * slope[k]
            b = v0[k] + (np.minimum(edges[strip + 1], high[k]) - u0[k]) * slope[k]
            from_, upto = begin[strip * cells + place(np.minimum(a, b) - reach[k], v_axis, cells)], begin[strip * cells + place(np.maximum(a, b) + reach[k], v_axis, cells) + 1]
            k, from_, upto = (each[upto > from_] for each in (own[k], from_, upto))
            for part in chunks(upto - from_, BATCH):
                run, at = spread((upto - from_)[part])
                i, j = k[part][run], from_[part][run] + at
                distance = segment_distance(px[j], py[j], *ends[:, i])
                near = np.flatnonzero(distance <= radius)
                if len(near):
                    yield i[near], points[j[near]], distance[near]


def rounded(values: np.ndarray, digits: int) -> np.ndarray:
    """Positive values rounded half up."""
    scaled = values * 10.0**digits
    whole = np.floor(scaled)
    return (whole + (scaled - whole >= 0.5)) / 10.0**digits


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal entries (of equal columns in a table)."""
    rows = np.atleast_2d(values)
    starts = np.flatnonzero(np.concatenate(([True], (rows[:, 1:] != rows[:, :-1]).any(axis=0)))) if rows.shape[1] else np.zeros(0, np.int64)
    return starts, np.diff(starts, append=rows.shape[1])


#: Entries of a list in a row of ``products``; a row stands for its square of pairs at most.
SIDE = 256

Lists = tuple[np.ndarray, np.ndarray]


def products(first: Lists, second: Lists) -> Iterator[tuple[Lists, Lists]]:
    """Pairs of runs (starts and lengths), one of each a row, cut into rows of ``SIDE`` entries of each at most: for either side the
    offsets of its lists and the entries in them."""
    pieces = [-(-lengths // SIDE) for _, lengths in (first, second)]
    row, place = spread(pieces[0] * pieces[1])
    begins, sizes = [], []
    for (starts, lengths), piece in zip((first, second), (place // pieces[1][row], place % pieces[1][row])):
        begins.append(starts[row] + piece * SIDE)
        sizes.append(np.minimum(lengths[row] - piece * SIDE, SIDE))
    for some in chunks(sizes[0] + sizes[1]):
        made = []
        for begin, size in zip(begins, sizes):
            run, at = spread(size[some])
            made.append((np.concatenate(([0], np.cumsum(size[some]))), begin[some][run] + at))
        yield made[0], made[1]


def overlapping(w: np.ndarray, e: np.ndarray, s: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of boxes that overlap or touch, each once."""
    order = np.argsort(w, kind="stable")
    w, e, s, n = w[order], e[order], s[order], n[order]
    upto = np.searchsorted(w, e, "right")
    counts = np.maximum(upto - np.arange(1, len(w) + 1), 0)
    for some in chunks(counts, 4 * MANY):
        run, place = spread(counts[some])
        i = run + some.start
        j = i + 1 + place
        meet = np.flatnonzero((s[j] <= n[i]) & (s[i] <= n[j]))
        yield order[i[meet]], order[j[meet]]


def joined(left: pa.Table, right: pa.Table, i: np.ndarray, j: np.ndarray, names: Sequence[str], **more: np.ndarray) -> pa.Table:
    """Columns of rows ``i`` of one table and rows ``j`` of the other, and further ones."""
    made = {n: pa.array(more[n]) if n in more else left.column(n).take(pa.array(i)) if n in left.column_names else right.column(n).take(pa.array(j)) for n in names}
    return pa.table(made)
