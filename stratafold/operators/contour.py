"""Contour lines of dense rasters: two triangles a cell, linear interpolation, then chains of segments.

Segments come from windows and generators alone. Chaining is sequential along a line, so it runs once per (grid, level); the
rows of one level of one raster are what a task holds (a raster is a model's, of 2,048 samples across at most; many rasters
are told apart by ``grid``).
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratafold.operators import focal


def segments(cells: DataFrame, value: str, levels: Column, grid: Sequence[str] = ()) -> DataFrame:
    """``*grid, level, x0, y0, x1, y1, r, c, half``: the crossing of each triangle (lower and upper half of each square of cells) by
    each level of the array ``levels``; a corner at the level counts as above."""
    squares = focal.with_square(cells, value, grid)
    # Most squares lie between two levels: they end here, before any triangle is built.
    least, most = F.least(value, "z1", "z2", "z3"), F.greatest(value, "z1", "z2", "z3")
    corners = squares.withColumn("__levels", F.filter(levels, lambda v: (v > least) & (v <= most))).where(F.size("__levels") > 0)

    def point(i: int, j: int, z: str) -> Column:
        return F.struct((F.col("c") + i).cast("double").alias("x"), (F.col("r") + j).cast("double").alias("y"), F.col(z).alias("z"))

    p = (point(0, 0, value), point(1, 0, "z1"), point(1, 1, "z2"), point(0, 1, "z3"))
    halves = F.explode(F.array(F.struct(F.lit(0).alias("half"), F.array(p[0], p[1], p[2]).alias("t")), F.struct(F.lit(1).alias("half"), F.array(p[0], p[2], p[3]).alias("t"))))
    triangles = corners.select(*grid, "r", "c", "__levels", halves.alias("h")).select(*grid, "r", "c", "__levels", "h.half", "h.t")
    low, high = F.array_min(F.transform("t", lambda q: q["z"])), F.array_max(F.transform("t", lambda q: q["z"]))
    cut = triangles.withColumn("level", F.explode(F.filter("__levels", lambda v: (v > low) & (v <= high))))

    def crossing(q: Column, i: Column) -> Column:
        n = F.element_at("t", (i + 1) % 3 + 1)
        f = (F.col("level") - q["z"]) / (n["z"] - q["z"])
        return F.when((q["z"] >= F.col("level")) != (n["z"] >= F.col("level")), F.struct((q["x"] + (n["x"] - q["x"]) * f).alias("x"), (q["y"] + (n["y"] - q["y"]) * f).alias("y")))

    ends = F.array_compact(F.transform("t", crossing))
    found = cut.withColumn("e", ends)
    return found.select(*grid, "level", F.col("e")[0]["x"].alias("x0"), F.col("e")[0]["y"].alias("y0"), F.col("e")[1]["x"].alias("x1"), F.col("e")[1]["y"].alias("y1"), "r", "c", "half")


def chain(ends: list[tuple[tuple[float, float], tuple[float, float]]]) -> list[list[tuple[float, float]]]:
    """Chains of segments that meet within a thousandth, each segment once: first from points where not just two segments meet
    (open ends and branches), then around loops; straight on at branches. Segments shorter than that are dropped, and so are
    chains of two points, as a line of contour has three at least."""
    key = lambda p: (round(p[0] * 1000), round(p[1] * 1000))
    ends = [e for e in ends if key(e[0]) != key(e[1])]
    at: dict[tuple[int, int], list[int]] = defaultdict(list)
    for i, (a, b) in enumerate(ends):
        at[key(a)].append(i)
        at[key(b)].append(i)
    used = [False] * len(ends)
    inner = lambda p: len(at[key(p)]) == 2
    order = sorted(range(len(ends)), key=lambda i: inner(ends[i][0]) and inner(ends[i][1]))
    out = []
    for first in order:
        if used[first]:
            continue
        used[first] = True
        a, b = ends[first]
        if inner(a) and not inner(b):
            a, b = b, a
        line = [a, b]
        while key(line[-1]) != key(a):
            here, before = np.array(line[-1]), np.array(line[-2])
            best = None
            for i in at[key(line[-1])]:
                if used[i]:
                    continue
                p, q = ends[i] if key(ends[i][0]) == key(line[-1]) else ends[i][::-1]
                step, came = np.array(q) - here, here - before
                straight = float(step @ came / (np.linalg.norm(step) * np.linalg.norm(came) or 1.0))
                if best is None or straight > best[0]:
                    best = (straight, i, q)
            if best is None:
                break
            used[best[1]] = True
            line.append(best[2])
        if len(line) > 2:
            out.append(line)
    return out


def lines(parts: DataFrame, grid: Sequence[str] = ()) -> DataFrame:
    """``*grid, level, line, points, closed, length`` of the chains of ``segments``, by raster (``grid``) and level."""
    kinds = {g: parts.schema[g].dataType for g in grid}

    def stitch(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("r", "c", "half", "x0", "y0", "x1", "y1"))))
        found = chain([((x0, y0), (x1, y1)) for _, _, _, x0, y0, x1, y1 in rows])
        closed = [round(line[0][0] * 1000) == round(line[-1][0] * 1000) and round(line[0][1] * 1000) == round(line[-1][1] * 1000) for line in found]
        heads = {name: pa.array([value.as_py()] * len(found), value.type) for name, value in zip((*grid, "level"), key)}
        return pa.table(heads | {"line": pa.array(range(len(found)), pa.int32()), "points": pa.array([len(x) for x in found], pa.int32()), "closed": pa.array(closed, pa.bool_()), "length": pa.array([float(np.linalg.norm(np.diff(np.array(x), axis=0), axis=1).sum()) for x in found], pa.float64())})

    schema = T.StructType([*(T.StructField(g, kind) for g, kind in kinds.items()), *T._parse_datatype_string("level double, line int, points int, closed boolean, length double")])
    return parts.groupBy(*grid, "level").applyInArrow(stitch, schema)
