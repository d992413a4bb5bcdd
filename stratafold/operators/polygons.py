"""Booleans, ribbons and triangulations of arbitrary polygons, by horizontal slabs.

The plane is cut at the height of every corner and every crossing of two sides. Within a slab no two sides cross, so the sides in
it have one order from left to right, and what lies between two neighbours is inside or outside of each shape as a
whole (even-odd for the rings of one shape, so rings within rings are holes). The result of any boolean is a set of trapezoids
that do not overlap; cut once across, they are a triangulation that keeps every side.

Sides of one group are compared with each other, so a group is a bounded unit: the shapes over one piece of a model, or two shapes
that meet. Groups are rows or groups of a DataFrame and spread over tasks.

Defined cases. Rings may run either way, cross themselves (even-odd), repeat their first point or have points on one line. Rings
of fewer than three points and slabs thinner than 1e-12 are empty. Shapes that only touch share no area.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratafold.operators import kernels as K
from stratafold.operators import spatial

Ring = Sequence[tuple[float, float]]
#: Height below which a slab is empty; sides of a circle that rounds a ribbon's joints.
THIN, ROUND = 1e-12, 16


def _sides(shapes: Sequence[Sequence[Ring]]) -> tuple[np.ndarray, np.ndarray]:
    """Sides (x0, y0, x1, y1) that are not level, from low to high, and the shape of each."""
    sides, owners = [], []
    for owner, rings in enumerate(shapes):
        for ring in rings:
            points = np.asarray(ring, np.float64).reshape(-1, 2)
            if len(points) > 2:
                sides.append(np.concatenate([points, np.roll(points, -1, axis=0)], axis=1))
                owners.append(np.full(len(points), owner))
    if not sides:
        return np.zeros((0, 4)), np.zeros(0, int)
    found, owner = np.concatenate(sides), np.concatenate(owners)
    slanted = found[:, 1] != found[:, 3]
    found, owner = found[slanted], owner[slanted]
    down = found[:, 1] > found[:, 3]
    found[down] = found[down][:, [2, 3, 0, 1]]
    return found, owner


def _crossings(sides: np.ndarray) -> np.ndarray:
    """Heights at which two sides cross."""
    d = sides[:, 2:] - sides[:, :2]
    cross = d[:, None, 0] * d[None, :, 1] - d[:, None, 1] * d[None, :, 0]
    between = sides[None, :, :2] - sides[:, None, :2]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (between[..., 0] * d[None, :, 1] - between[..., 1] * d[None, :, 0]) / cross
        u = (between[..., 0] * d[:, None, 1] - between[..., 1] * d[:, None, 0]) / cross
    i, j = np.nonzero((cross != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1))
    return sides[i, 1] + t[i, j] * d[i, 1]


def combine(shapes: Sequence[Sequence[Ring]], keep: Callable[[np.ndarray], bool]) -> np.ndarray:
    """Trapezoids (low, high, left and right at the low, left and right at the high) of the points for which ``keep`` holds; it is
    given the truth of lying in each shape."""
    sides, owner = _sides(shapes)
    if not len(sides):
        return np.zeros((0, 6))
    heights = np.unique(np.concatenate([sides[:, 1], sides[:, 3], _crossings(sides)]))
    slope = (sides[:, 2] - sides[:, 0]) / (sides[:, 3] - sides[:, 1])
    out = []
    for low, high in zip(heights, heights[1:]):
        if high - low < THIN:
            continue
        middle = (low + high) / 2
        here = np.flatnonzero((sides[:, 1] <= middle) & (sides[:, 3] >= middle))
        at = lambda y: sides[here, 0] + slope[here] * (y - sides[here, 1])  # noqa: E731, B023
        order = np.argsort(at(middle), kind="stable")
        bottom, top = at(low)[order], at(high)[order]
        inside = np.zeros(len(shapes), np.bool_)
        left = None
        for k, side in enumerate(here[order]):
            inside[owner[side]] ^= True
            kept = bool(keep(inside))
            if kept and left is None:
                left = k
            elif not kept and left is not None:
                out.append((low, high, bottom[left], bottom[k], top[left], top[k]))
                left = None
    return np.array(out).reshape(-1, 6)


def area_of(trapezoids: np.ndarray) -> float:
    low, high, a, b, c, d = trapezoids.T
    return float(((high - low) * (b - a + d - c) / 2).sum())


def union(shapes: Sequence[Sequence[Ring]]) -> np.ndarray:
    return combine(shapes, np.any)


def intersection(shapes: Sequence[Sequence[Ring]]) -> np.ndarray:
    return combine(shapes, np.all)


def difference(shape: Sequence[Ring], others: Sequence[Sequence[Ring]]) -> np.ndarray:
    return combine([shape, *others], lambda inside: inside[0] and not inside[1:].any())


def triangles_of(trapezoids: np.ndarray) -> np.ndarray:
    """The trapezoids as triangles (n, 3, 2) that run anticlockwise; those without extent are left out."""
    low, high, a, b, c, d = trapezoids.T
    first = np.stack([np.stack([a, low], 1), np.stack([b, low], 1), np.stack([d, high], 1)], 1)
    second = np.stack([np.stack([a, low], 1), np.stack([d, high], 1), np.stack([c, high], 1)], 1)
    return np.concatenate([first[b - a > THIN], second[d - c > THIN]])


def ribbon(points: Ring, half: float) -> list[list[Ring]]:
    """The shapes whose union is a line of a width, rounded at ends and joints."""
    line = np.asarray(points, np.float64).reshape(-1, 2)
    angle = np.arange(ROUND) * (2 * np.pi / ROUND)
    circle = np.stack([np.cos(angle), np.sin(angle)], 1) * half
    shapes = [[(p + circle).tolist()] for p in line]
    for p, q in zip(line, line[1:]):
        length = np.hypot(*(q - p))
        if length > 0:
            side = np.array([p[1] - q[1], q[0] - p[0]]) / length * half
            shapes.append([[tuple(p + side), tuple(q + side), tuple(q - side), tuple(p - side)]])
    return shapes


def clip_to(shapes: Sequence[Sequence[Ring]], window: Sequence[Ring], cut: Sequence[Sequence[Ring]] = ()) -> np.ndarray:
    """The union of shapes within a window and outside of what is cut away."""
    n = len(shapes)
    return combine([*shapes, window, *cut], lambda inside: inside[:n].any() and inside[n] and not inside[n + 1 :].any())


_POINTS = "array<struct<x: double, y: double>>"


def _rings(shell: list | None, holes: list | None) -> list[Ring]:
    return [[(p["x"], p["y"]) for p in ring if p is not None] for ring in [shell, *(holes or [])] if ring]


def _per_row(df: DataFrame, keys: Sequence[str], work: Callable[[dict], tuple], schema: str) -> DataFrame:
    """``work`` on each row; its values under ``schema`` beside the keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A row at a time: its shapes are all that is held as Python objects.
            done = [work({n: batch.column(i)[r].as_py() for i, n in enumerate(batch.schema.names)}) for r in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(k)) for k in keys), *(pa.array([d[i] for d in done], kind) for i, kind in enumerate(kinds))], names=[*keys, *names])

    made = T._parse_datatype_string(schema)
    arrow = {"bigint": pa.int64(), "double": pa.float64()}
    names, kinds = [f.name for f in made], [arrow[f.dataType.simpleString()] for f in made]
    return df.mapInArrow(run, T.StructType([*(df.schema[k] for k in keys), *made]))


def pair_areas(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, union, shared, first_only`` areas of two shapes a row (``shell, holes, other_shell, other_holes``)."""

    def work(row: dict) -> tuple:
        a, b = _rings(row["shell"], row["holes"]), _rings(row["other_shell"], row["other_holes"])
        return area_of(union([a, b])), area_of(intersection([a, b])), area_of(difference(a, [b]))

    return _per_row(pairs, keys, work, "union double, shared double, first_only double")


def triangulations(shapes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, triangles, covered`` of each shape's triangulation (``shell, holes``)."""

    def work(row: dict) -> tuple:
        made = triangles_of(combine([_rings(row["shell"], row["holes"])], np.any))
        d1, d2 = made[:, 1] - made[:, 0], made[:, 2] - made[:, 0]
        return len(made), float((d1[:, 0] * d2[:, 1] - d1[:, 1] * d2[:, 0]).sum() / 2)

    return _per_row(shapes, keys, work, "triangles bigint, covered double")


#: Obstacles that a window may have before it is quartered, and how often it may be.
FEW, DEPTH = 3, 8


def kept_area(shapes: Sequence[Sequence[Ring]], keep: Callable[[np.ndarray], np.ndarray]) -> float:
    """The area where ``keep`` holds, which is given rows of truths of lying in each shape. All slabs are worked out at once."""
    sides, owner = _sides(shapes)
    if not len(sides):
        return 0.0
    heights = np.unique(np.concatenate([sides[:, 1], sides[:, 3], _crossings(sides)]))
    heights = np.concatenate([heights[:-1][np.diff(heights) >= THIN], heights[-1:]])
    thick, middle = np.diff(heights), (heights[:-1] + heights[1:]) / 2
    slab, side = np.nonzero((sides[:, 1] <= middle[:, None]) & (sides[:, 3] >= middle[:, None]))
    x = sides[side, 0] + (sides[side, 2] - sides[side, 0]) / (sides[side, 3] - sides[side, 1]) * (middle[slab] - sides[side, 1])
    order = np.lexsort((side, x, slab))
    slab, side, x = slab[order], side[order], x[order]
    # Rings are closed, so every slab ends outside of all shapes and the next begins there.
    inside = np.cumsum(owner[side] == np.arange(len(shapes))[:, None], axis=1) % 2 == 1
    between = np.flatnonzero(keep(inside)[:-1] & (slab[1:] == slab[:-1]))
    return float(((x[between + 1] - x[between]) * thick[slab[between]]).sum())


def _free_areas(lines: Sequence[tuple[Ring, float]], obstacles: K.Rings, window: tuple[float, float, float, float]) -> np.ndarray:
    """Area of each ribbon (points, half) in a window (west, south, east, north) and outside of all obstacles.

    A window is quartered while many obstacles cross it; one that an obstacle covers has no free area.
    """
    total, made = np.zeros(len(lines)), {}
    box = np.array([(min(xs) - h, min(ys) - h, max(xs) + h, max(ys) + h) for (xs, ys), h in ((tuple(zip(*p)), h) for p, h in lines)]).reshape(-1, 4)
    owner = np.repeat(np.arange(len(obstacles.count)), obstacles.count)
    ax, ay, bx, by = obstacles.x, obstacles.y, obstacles.bx, obstacles.by
    low_x, high_x, low_y, high_y = np.minimum(ax, bx), np.maximum(ax, bx), np.minimum(ay, by), np.maximum(ay, by)
    windows = [(window, np.arange(len(lines)), np.arange(len(obstacles.count)), np.arange(len(ax)), 0)]
    while windows:
        (w, s, e, n), own, near, sides, depth = windows.pop()
        own = own[(box[own, 0] < e) & (box[own, 2] > w) & (box[own, 1] < n) & (box[own, 3] > s)]
        if not len(own):
            continue
        sides = sides[(low_x[sides] <= e) & (high_x[sides] >= w) & (low_y[sides] <= n) & (high_y[sides] >= s)]
        turns = np.stack([(bx[sides] - ax[sides]) * (y - ay[sides]) - (by[sides] - ay[sides]) * (x - ax[sides]) for x, y in ((w, s), (e, s), (e, n), (w, n))])
        sides = sides[(turns.max(axis=0, initial=-np.inf) >= 0) & (turns.min(axis=0, initial=np.inf) <= 0)]
        crossing = np.unique(owner[sides])
        # What has no side here holds all of the window or nothing of it.
        rest = np.setdiff1d(near, crossing, assume_unique=True)
        if obstacles.contain(rest, np.full(len(rest), (w + e) / 2), np.full(len(rest), (s + n) / 2)).any():
            continue
        if len(crossing) > FEW and depth < DEPTH:
            x, y = (w + e) / 2, (s + n) / 2
            windows += [(part, own, crossing, sides, depth + 1) for part in ((w, s, x, y), (x, s, e, y), (w, y, x, n), (x, y, e, n))]
            continue
        cut = [[list(zip(obstacles.x[at], obstacles.y[at]))] for at in (slice(obstacles.start[o], obstacles.start[o] + obstacles.count[o]) for o in crossing)]
        for k in own:
            if k not in made:
                shapes = ribbon(*lines[k])
                made[k] = shapes, np.array([(*np.min(r[0], axis=0), *np.max(r[0], axis=0)) for r in shapes])
            shapes, bounds = made[k]
            here = np.flatnonzero((bounds[:, 0] < e) & (bounds[:, 2] > w) & (bounds[:, 1] < n) & (bounds[:, 3] > s))
            if m := len(here):
                total[k] += kept_area([*(shapes[i] for i in here), [[(w, s), (e, s), (e, n), (w, n)]], *cut], lambda inside: inside[:m].any(axis=0) & inside[m] & ~inside[m + 1 :].any(axis=0))  # noqa: B023
    return total


def ribbons(lines: DataFrame, key: str, obstacles: DataFrame, buckets: int) -> DataFrame:
    """``key, area`` of each line (``key, points, half``) as a ribbon inside the unit square, cut back where obstacles (``shell``)
    are.

    The square is cut into buckets, and a ribbon's area is the sum of its areas in those it touches, so that a line needs the
    obstacles of one bucket at a time and never takes copies of them along.
    """
    reach = F.col("half")
    xs, ys = F.transform("points", lambda p: p["x"]), F.transform("points", lambda p: p["y"])
    asked = spatial.by_bounds(lines.select(key, "points", "half"), F.array_min(xs) - reach, F.array_max(xs) + reach, F.array_min(ys) - reach, F.array_max(ys) + reach, buckets)
    asked = asked.withColumns({"__x": F.col("bx"), "__y": F.col("by")})
    held = spatial.ring_bounds(obstacles.select("shell"), "shell", buckets=buckets)
    schema = T.StructType([lines.schema[key], T.StructField("area", T.DoubleType())])

    def work(left: pa.Table, right: pa.Table) -> Iterator[pa.Table]:
        x, y = left.column("__x")[0].as_py(), left.column("__y")[0].as_py()
        rings = K.Rings(right.column("shell").combine_chunks()) if right.num_rows else K.Rings(pa.array([], pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))
        own = [([(p["x"], p["y"]) for p in points], half) for points, half in zip(left.column("points").to_pylist(), left.column("half").to_pylist())]
        yield pa.table({key: left.column(key), "area": _free_areas(own, rings, (x / buckets, y / buckets, (x + 1) / buckets, (y + 1) / buckets))})

    parts = K.bucketed(asked, held, ["bx", "by"], work, schema, lone=True).groupBy(key).agg(F.sum("area").alias("area"))
    return lines.select(key).join(parts, key, "left").select(key, F.coalesce("area", F.lit(0.0)).alias("area"))
