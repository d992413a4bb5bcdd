"""Rings, chains and coasts: convex clipping, polygon checks, chain joining and the sea beside a coastline.

Work on one ring or one tile's coast is sequential; a group is one tile's lines.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Point = tuple[float, float]
#: Ends closer than this meet.
JOIN = 1e-5


def clip_convex(ring: Sequence[Point], window: Sequence[Point]) -> list[Point]:
    """The part of a ring inside a convex window that runs anticlockwise (Sutherland-Hodgman)."""
    out = list(ring)
    for (ax, ay), (bx, by) in zip(window, [*window[1:], window[0]]):
        side = lambda p: (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax)  # noqa: E731, B023
        held, out = out, []
        for p, q in zip(held, [*held[1:], *held[:1]]):
            sp, sq = side(p), side(q)
            if sp >= 0:
                out.append(p)
            if (sp > 0 > sq) or (sp < 0 < sq):
                t = sp / (sp - sq)
                out.append((p[0] + (q[0] - p[0]) * t, p[1] + (q[1] - p[1]) * t))
    return out


def simplify(ring: Sequence[Point], tolerance: float = 1e-4) -> list[Point]:
    """A ring without the vertices that go forward along the line between their neighbours, within ``tolerance`` of it.

    Vertices are judged against the neighbours they have when it is their turn, so no part of the result strays from what it
    replaces by more than the tolerance at a time; one at which the ring turns back (a spike) stays. Neighbours of a dropped vertex
    get another turn. At least three vertices are left.
    """
    n = len(ring)
    ahead, behind = [(i + 1) % n for i in range(n)], [(i - 1) % n for i in range(n)]
    turns, waiting, held, gone = deque(range(n)), [True] * n, n, [False] * n
    while turns and held > 3:
        i = turns.popleft()
        waiting[i] = False
        if gone[i]:
            continue
        (ax, ay), (bx, by), (cx, cy) = ring[behind[i]], ring[i], ring[ahead[i]]
        length = math.dist((ax, ay), (cx, cy))
        away = abs((bx - ax) * (cy - ay) - (by - ay) * (cx - ax)) / length if length else math.dist((ax, ay), (bx, by))
        if (bx - ax) * (cx - bx) + (by - ay) * (cy - by) > 0 and away <= tolerance:
            gone[i], held = True, held - 1
            ahead[behind[i]], behind[ahead[i]] = ahead[i], behind[i]
            for k in (behind[i], ahead[i]):
                if not waiting[k]:
                    waiting[k] = True
                    turns.append(k)
    return [p for i, p in enumerate(ring) if not gone[i]]


class EndIndex:
    """Ends of lines by cells of the join distance, so that a meeting end is looked up and not searched for."""

    def __init__(self, near: float) -> None:
        self.near = near
        self.cells: dict[tuple[int, int], dict[int, Point]] = {}

    def _cell(self, p: Point) -> tuple[int, int]:
        return math.floor(p[0] / self.near), math.floor(p[1] / self.near)

    def add(self, line: int, p: Point) -> None:
        self.cells.setdefault(self._cell(p), {})[line] = p

    def drop(self, line: int, p: Point) -> None:
        self.cells.get(self._cell(p), {}).pop(line, None)

    def least(self, p: Point) -> int | None:
        """The first line with an end nearer than the join distance."""
        x, y = self._cell(p)
        found = [line for i in (x - 1, x, x + 1) for j in (y - 1, y, y + 1) for line, q in self.cells.get((i, j), {}).items() if math.dist(p, q) < self.near]
        return min(found, default=None)


def join_chains(lines: Sequence[Sequence[Point]]) -> list[list[Point]]:
    """Lines joined end to start wherever those meet; of several that start there the first is taken.

    Starts are indexed by place. Each line that none leads into begins a walk from start to start; what is left then are circles,
    which begin with their first line.
    """
    held = [list(x) for x in lines if len(x) > 1]
    starts = EndIndex(JOIN)
    for i, line in enumerate(held):
        starts.add(i, line[0])
    ends = EndIndex(JOIN)
    for i, line in enumerate(held):
        ends.add(i, line[-1])
    led = [ends.least(line[0]) not in (None, i) for i, line in enumerate(held)]
    free = [True] * len(held)
    chains = []
    for i in sorted(range(len(held)), key=lambda k: (led[k], k)):
        if not free[i]:
            continue
        chain, free[i] = list(held[i]), False
        starts.drop(i, held[i][0])
        while math.dist(chain[0], chain[-1]) >= JOIN and (k := starts.least(chain[-1])) is not None:
            chain += held[k][1:]
            free[k] = False
            starts.drop(k, held[k][0])
        chains.append((i, chain))
    return [chain for _, chain in sorted(chains, key=lambda c: c[0])]


def assemble_rings(lines: Sequence[Sequence[Point]], near: float = 1e-7) -> tuple[list[list[Point]], int]:
    """Rings of lines that join at either end, without their repeated first point, and the number of chains that do not close."""
    held = [list(x) for x in lines if len(x) > 1]
    ends = EndIndex(near)
    # A line's two ends are 2 i and 2 i + 1.
    for i, line in enumerate(held):
        ends.add(2 * i, line[0])
        ends.add(2 * i + 1, line[-1])
    rings, open_chains, free = [], 0, [True] * len(held)
    for i in reversed(range(len(held))):
        if not free[i]:
            continue
        chain, k = [], 2 * i
        while k is not None:
            line = held[k // 2]
            free[k // 2] = False
            ends.drop(2 * (k // 2), line[0])
            ends.drop(2 * (k // 2) + 1, line[-1])
            step = line if k % 2 == 0 else line[::-1]
            chain += step[1:] if chain else step
            if len(chain) > 3 and math.dist(chain[0], chain[-1]) < near:
                break
            k = ends.least(chain[-1])
        if len(chain) > 3 and math.dist(chain[0], chain[-1]) < near:
            rings.append(chain[:-1])
        else:
            open_chains += 1
    return rings, open_chains


def ring_covers(ring: Sequence[Point], p: Point) -> bool:
    """Even-odd test of a point against a ring without its repeated first point."""
    inside = False
    for (ax, ay), (bx, by) in zip(ring, [*ring[1:], *ring[:1]]):
        if (ay > p[1]) != (by > p[1]) and p[0] < (bx - ax) * (p[1] - ay) / (by - ay) + ax:
            inside = not inside
    return inside


def ring_holds(ring: Sequence[Point], other: Sequence[Point]) -> bool:
    """Whether every point of another ring lies in a ring."""
    return bool(other) and all(ring_covers(ring, p) for p in other)


def _cut(a: Point, b: Point) -> tuple[float, float] | None:
    """Where a segment runs inside the unit square, as shares of its length."""
    lo, hi = 0.0, 1.0
    for start, step in ((a[0], b[0] - a[0]), (a[1], b[1] - a[1])):
        if step == 0:
            if not 0 <= start <= 1:
                return None
            continue
        t0, t1 = sorted((-start / step, (1 - start) / step))
        lo, hi = max(lo, t0), min(hi, t1)
    return (lo, hi) if lo < hi else None


def clip_chain(chain: Sequence[Point]) -> list[list[Point]]:
    """The parts of a chain inside the unit square; a closed chain's first and last part are one if they meet inside."""
    parts: list[list[Point]] = []
    whole = True
    for a, b in zip(chain, chain[1:]):
        inside = _cut(a, b)
        if inside is None:
            whole = False
            continue
        p, q = ((a[0] + (b[0] - a[0]) * t, a[1] + (b[1] - a[1]) * t) for t in inside)
        if parts and inside[0] == 0 and math.dist(parts[-1][-1], p) < 1e-12:
            parts[-1].append(q)
        else:
            parts.append([p, q])
        whole = whole and inside == (0.0, 1.0)
    closed = len(chain) > 3 and math.dist(chain[0], chain[-1]) < JOIN
    if closed and not whole and len(parts) > 1 and math.dist(parts[-1][-1], parts[0][0]) < 1e-12:
        parts[0] = parts.pop() + parts[0][1:]
    return parts


def boundary_place(p: Point) -> float | None:
    """Place on the square's border, clockwise from (0, 0) over (0, 1); None inside."""
    x, y = p
    for near, place in ((abs(x), y), (abs(1 - y), 1 + x), (abs(1 - x), 3 - y), (abs(y), 4 - x)):
        if near < 1e-9:
            return place % 4
    return None


def sea(lines: Sequence[Sequence[Point]]) -> tuple[list[list[Point]], list[list[Point]]] | None:
    """Outer rings of the sea and islands in it, in the unit square, from coastlines with water on their right; None where the
    data is broken (a line ends inside the square) or has no coast."""
    open_parts, islands = [], []
    for chain in join_chains(lines):
        for part in clip_chain(chain):
            if len(part) > 3 and math.dist(part[0], part[-1]) < JOIN:
                islands.append(part)
            elif boundary_place(part[0]) is None or boundary_place(part[-1]) is None:
                return None
            else:
                open_parts.append(part)
    corners = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0)]
    if not open_parts:
        return ([list(corners)], islands) if islands else None
    outers, left = [], list(range(len(open_parts)))
    while left:
        first = here = left.pop(0)
        ring = list(open_parts[here])
        while True:
            at = boundary_place(open_parts[here][-1])
            ahead = lambda i: (boundary_place(open_parts[i][0]) - at) % 4  # noqa: E731, B023
            nxt = min([*left, first], key=ahead)
            ring += [corners[k % 4] for k in range(math.floor(at) + 1, math.floor(at + ahead(nxt)) + 1) if k > at]
            if nxt == first:
                break
            left.remove(nxt)
            here = nxt
            ring += open_parts[here]
        outers.append(ring)
    return outers, islands


def seas(points: DataFrame, tile: str, way: str, order: str) -> DataFrame:
    """``tile, role, ring, area``: rings of each tile's sea (role outer or island) from its coastline points (``x, y``); a
    tile whose coast is broken gives one row with role ``broken``."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([(way, "ascending"), (order, "ascending")])
        ways: dict = {}
        for w, x, y in zip(*(table.column(c).to_pylist() for c in (way, "x", "y"))):
            ways.setdefault(w, []).append((x, y))
        found = sea(list(ways.values()))
        rows = [("broken", 0, 0.0)] if found is None else [(role, i, abs(shoelace(r))) for role, rings in zip(("outer", "island"), found) for i, r in enumerate(rings)]
        return pa.table({"tile": pa.array([str(key[0].as_py())] * len(rows)), "role": [r[0] for r in rows], "ring": pa.array([r[1] for r in rows], pa.int32()), "area": [r[2] for r in rows]})

    return points.select(tile, way, order, "x", "y").groupBy(tile).applyInArrow(run, "tile string, role string, ring int, area double")


def shoelace(ring: Sequence[Point]) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, [*ring[1:], *ring[:1]])) / 2


def _orient(a: Column, b: Column, c: Column) -> Column:
    return (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])


def outline_problems(rings: DataFrame, key: str, ring: str, least_area: float) -> DataFrame:
    """``key, problem`` per ring: too few or many points (3 to 128), a point outside the unit square, points in one place,
    crossing edges, too small; null if it is valid. Edges of one ring are paired within their row."""
    n = F.size(ring)
    nxt = lambda i: F.element_at(ring, i % n + 1)
    edges = F.transform(ring, lambda p, i: F.struct(i.alias("i"), p.alias("p"), nxt(i + 1).alias("q")))
    outside = F.exists(ring, lambda p: ~(p["x"].between(0, 1) & p["y"].between(0, 1)))
    same = F.exists(edges, lambda e: (e["p"]["x"] - e["q"]["x"]) * (e["p"]["x"] - e["q"]["x"]) + (e["p"]["y"] - e["q"]["y"]) * (e["p"]["y"] - e["q"]["y"]) < 1e-8)

    def cross(e: Column, f: Column) -> Column:
        apart = (f["i"] > e["i"] + 1) & ~((e["i"] == 0) & (f["i"] == n - 1))
        return apart & (_orient(e["p"], e["q"], f["p"]) * _orient(e["p"], e["q"], f["q"]) < 0) & (_orient(f["p"], f["q"], e["p"]) * _orient(f["p"], f["q"], e["q"]) < 0)

    crossing = F.exists(edges, lambda e: F.exists(edges, lambda f: cross(e, f)))
    area2 = F.aggregate(F.transform(edges, lambda e: e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"]), F.lit(0.0), lambda a, x: a + x)
    problem = F.when(~n.between(3, 128), "points").when(outside, "outside").when(same, "same place").when(crossing, "crossing").when(F.abs(area2) / 2 < least_area, "small")
    return rings.select(key, problem.alias("problem"))
