"""Spatial joins in the unit square by bucketing: both sides are spread over grid cells, so every join has an equality.

A shape lands in each bucket its bounds touch, a point in one, so point-in-shape joins need no later deduplication. The number
of buckets per axis is a parameter; a bucket that is hot splits by choosing a finer grid (or by the planner's skew handling,
as the join is an ordinary equi-join). Nothing is compared outside its bucket, and no side is collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratafold.functions import geo as G
from stratafold.operators import kernels as K

BUCKETS = 32


def bucket(x: Column, buckets: int = BUCKETS) -> Column:
    return F.least(F.greatest(F.floor(x * buckets), F.lit(0)), F.lit(buckets - 1)).cast("int")


def by_bounds(shapes: DataFrame, west: Column, east: Column, south: Column, north: Column, buckets: int = BUCKETS) -> DataFrame:
    """A row per bucket that the bounds touch (``bx, by``)."""
    return shapes.withColumn("bx", F.explode(F.sequence(bucket(west, buckets), bucket(east, buckets)))).withColumn("by", F.explode(F.sequence(bucket(south, buckets), bucket(north, buckets))))


def ring_bounds(shapes: DataFrame, ring: str, margin: float = 0.0, buckets: int = BUCKETS) -> DataFrame:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return by_bounds(shapes, F.array_min(xs) - margin, F.array_max(xs) + margin, F.array_min(ys) - margin, F.array_max(ys) + margin, buckets)


def at_points(points: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    return points.withColumns({"bx": bucket(F.col("x"), buckets), "by": bucket(F.col("y"), buckets)})


def _levels(buckets: int) -> list[int]:
    """Grids of 2 ** level cells a side, from the finest of at most ``buckets`` to one of a few cells."""
    return list(range(max(buckets.bit_length() - 1, 2), 1, -2))


def points_in_areas(points: DataFrame, areas: DataFrame, buckets: int = BUCKETS, once: bool = False) -> DataFrame:
    """Points (``x, y``) joined with the areas (``shell, holes``) that cover them; other column names must not clash.

    An area lies in the finest grid of at most ``buckets`` cells a side of which it touches few cells, so wide areas spread over few
    cells as well; a point looks into its cell of each grid. With ``once`` a point's row comes at most once a grid, with any one of
    the areas that cover it.
    """
    levels = _levels(buckets)
    cell = lambda x, level: F.least(F.greatest(F.floor(x * F.pow(F.lit(2.0), level)), F.lit(0)), F.pow(F.lit(2.0), level).cast("long") - 1)
    xs, ys = F.transform("shell", lambda p: p["x"]), F.transform("shell", lambda p: p["y"])
    bounds = areas.withColumns({"__w": F.array_min(xs), "__e": F.array_max(xs), "__s": F.array_min(ys), "__n": F.array_max(ys)})
    extent, level = F.greatest(F.col("__e") - F.col("__w"), F.col("__n") - F.col("__s")), F.lit(levels[-1])
    for finer in reversed(levels[:-1]):
        level = F.when(extent * float(1 << finer) <= 2.0, F.lit(finer)).otherwise(level)
    spread = bounds.withColumn("__level", level)
    spread = spread.withColumn("bx", F.explode(F.sequence(cell(F.col("__w"), F.col("__level")), cell(F.col("__e"), F.col("__level")))))
    spread = spread.withColumn("by", F.explode(F.sequence(cell(F.col("__s"), F.col("__level")), cell(F.col("__n"), F.col("__level"))))).drop("__w", "__e", "__s", "__n")
    asked = points.where("x IS NOT NULL AND y IS NOT NULL").withColumn("__level", F.explode(F.array(*map(F.lit, levels))))
    asked = asked.withColumns({"bx": cell(F.col("x"), F.col("__level")), "by": cell(F.col("y"), F.col("__level"))})
    schema = T.StructType([*points.schema, *(f for f in areas.schema if f.name not in ("shell", "holes"))])
    names = schema.names

    def work(left: pa.Table, right: pa.Table) -> Iterator[pa.Table]:
        x, y = K.numbers(left, "x", "y")
        for area, point in K.covering(K.Areas(right), x, y, once):
            yield K.joined(left, right, point, area, names)

    return K.bucketed(asked, spread, ["__level", "bx", "by"], work, schema)


def segments(points: DataFrame, line: str, order: str) -> DataFrame:
    """Consecutive points of each line: ``line, seg, x0, y0, x1, y1`` (seg from 0)."""
    w = Window.partitionBy(line).orderBy(order)
    ahead = points.select(line, F.row_number().over(w).alias("seg"), F.col("x").alias("x0"), F.col("y").alias("y0"), F.lead("x").over(w).alias("x1"), F.lead("y").over(w).alias("y1"))
    return ahead.where("x1 IS NOT NULL").withColumn("seg", F.col("seg") - 1)


#: Buckets a side for long segments, each of which lies in those along it.
LONG = 16


def points_near_segments(points: DataFrame, parts: DataFrame, radius: float, buckets: int = LONG, slack: float | None = None) -> DataFrame:
    """Points within ``radius`` of segments, with the distance; with ``slack`` only the segments at most that much further from a
    point than its nearest one."""
    spread = by_bounds(parts, F.least("x0", "x1") - radius, F.greatest("x0", "x1") + radius, F.least("y0", "y1") - radius, F.greatest("y0", "y1") + radius, buckets)
    # A long segment's bounds touch many buckets that the segment itself stays away from. Those at the border hold what lies beyond.
    middle = ((F.col("bx") + 0.5) / buckets, (F.col("by") + 0.5) / buckets)
    border = F.col("bx").isin(0, buckets - 1) | F.col("by").isin(0, buckets - 1)
    close = spread.where(border | (G.segment_distance(*middle, *(F.col(c) for c in ("x0", "y0", "x1", "y1"))) <= radius + 0.7072 / buckets))
    schema = T.StructType([*points.schema, *parts.schema, T.StructField("distance", T.DoubleType())])
    names = schema.names

    def work(left: pa.Table, right: pa.Table) -> Iterator[pa.Table]:
        x, y = K.numbers(left, "x", "y")
        for part, point, distance in K.near_segments(K.numbers(right, "x0", "y0", "x1", "y1"), x, y, radius, slack):
            yield K.joined(left, right, point, part, names, distance=distance)

    return K.bucketed(at_points(points, buckets).where("bx IS NOT NULL AND by IS NOT NULL"), close, ["bx", "by"], work, schema)


def pairs_near_segments(points: DataFrame, parts: DataFrame, radius: float, digits: int, bands: int, splits: int) -> DataFrame:
    """Points within ``radius`` of segments, as ``points_near_segments`` gives them, without the coordinates and with the distance
    rounded to ``digits``: for results that are far larger than both tables.

    Points lie in ``bands`` across the square and segments in those they touch, where either of ``splits`` partitions has all
    points of its band and its own share of the segments, those in the same place together. Segments in the same place are compared
    once, and a row of the comparison holds the points near a place beside the segments in it: pairs are made of that at the end
    only, so they are neither moved nor handed over by a worker.
    """
    # In the order of their places neighbours repeat each other, so the files of the shuffle are smaller.
    held = parts.dropna(subset=["x0", "y0", "x1", "y1"]).sortWithinPartitions("x0", "y0", "x1", "y1").withColumn("__band", F.explode(F.sequence(bucket(F.least("y0", "y1") - radius, bands), bucket(F.greatest("y0", "y1") + radius, bands))))
    held = held.withColumn("__part", F.col("__band") * splits + F.pmod(F.hash("x0", "y0", "x1", "y1"), F.lit(splits))).drop("__band")
    asked = points.dropna(subset=["x", "y"]).withColumn("__part", F.explode(F.sequence(bucket(F.col("y"), bands) * splits, (bucket(F.col("y"), bands) + 1) * splits - 1)))
    fields = [[f for f in df.schema if f.name not in at] for df, at in ((points, ("x", "y")), (parts, ("x0", "y0", "x1", "y1")))]
    fields[0].append(T.StructField("distance", T.DoubleType()))
    schema = T.StructType([T.StructField(side, T.ArrayType(T.StructType(own))) for side, own in zip(("__near", "__same"), fields)])
    kept = [[f.name for f in own if f.name != "distance"] for own in fields]

    def lists(table: pa.Table, offsets: np.ndarray, names: list[str], entries: np.ndarray, **more: np.ndarray) -> pa.Array:
        entries = pa.array(entries)
        columns = {n: table.column(n).take(entries).combine_chunks() for n in names} | {n: pa.array(v).take(entries) for n, v in more.items()}
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(list(columns.values()), list(columns)))

    def work(left: pa.Table, right: pa.Table) -> Iterator[pa.RecordBatch]:
        x, y = K.numbers(left, "x", "y")
        ends = K.numbers(right, "x0", "y0", "x1", "y1")
        order = np.lexsort(ends)
        left, right, ends = left.select(kept[0]), right.select(kept[1]).take(pa.array(order)), ends[:, order]
        first, count = K.runs(ends)
        ends = ends[:, first]
        for place, point, distance in K.along_segments(ends, x, y, radius):
            starts, lengths = K.runs(place)
            found, distance = left.take(pa.array(point)), K.rounded(distance, digits)
            for (to, near), (upto, same) in K.products((starts, lengths), (first[place[starts]], count[place[starts]])):
                yield pa.RecordBatch.from_arrays([lists(found, to, kept[0], near, distance=distance), lists(right, upto, kept[1], same)], ["__near", "__same"])

    packed = [df.select("__part", F.struct(*(c for c in df.columns if c != "__part")).alias(side)) for df, side in ((asked, "__l"), (held, "__r"))]
    both = packed[0].unionByName(packed[1], allowMissingColumns=True).repartitionById(bands * splits, F.col("__part"))
    return both.mapInArrow(lambda batches: K.by_side(batches, "__part", work), schema).select(F.inline("__near"), "__same").select(*kept[0], "distance", F.inline("__same"))


def crossings(parts: DataFrame, buckets: int) -> DataFrame:
    """Pairs of segments (``line, seg, x0, y0, x1, y1``) of different lines of which each has the other's ends on both its sides:
    ``line1, seg1, line2, seg2``, of the lines the lower first.

    A pair meets in every bucket that both bounds touch and counts in the one of its bounds' common south-western corner, so pairs
    are neither moved nor compared again.
    """
    w, e, s, n = F.least("x0", "x1"), F.greatest("x0", "x1"), F.least("y0", "y1"), F.greatest("y0", "y1")
    held = by_bounds(parts.select("line", "seg", "x0", "y0", "x1", "y1").dropna(subset=["x0", "y0", "x1", "y1"]), w, e, s, n, buckets)
    line, seg = parts.schema["line"].dataType, parts.schema["seg"].dataType
    schema = T.StructType([T.StructField("line1", line), T.StructField("seg1", seg), T.StructField("line2", line), T.StructField("seg2", seg)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        lines, segs = table.column("line"), table.column("seg")
        x0, y0, x1, y1 = K.numbers(table, "x0", "y0", "x1", "y1")
        # Lines by number, so that they are compared in their own order whatever their type is.
        number = pc.rank(lines.combine_chunks(), sort_keys="ascending", tiebreaker="min").to_numpy()
        bx, by = table.column("bx")[0].as_py(), table.column("by")[0].as_py()
        own = lambda v: np.minimum(np.maximum(np.floor(v * buckets), 0), buckets - 1)
        west, south = np.minimum(x0, x1), np.minimum(y0, y1)
        turn = lambda q, x, y: (x1[q] - x0[q]) * (y - y0[q]) - (y1[q] - y0[q]) * (x - x0[q])
        for i, j in K.overlapping(west, np.maximum(x0, x1), south, np.maximum(y0, y1)):
            here = (number[i] != number[j]) & (own(np.maximum(west[i], west[j])) == bx) & (own(np.maximum(south[i], south[j])) == by)
            i, j = i[here], j[here]
            i, j = np.where(number[i] < number[j], i, j), np.where(number[i] < number[j], j, i)
            over = np.flatnonzero(turn(j, x0[i], y0[i]) * turn(j, x1[i], y1[i]) < 0)
            i, j = i[over], j[over]
            over = turn(i, x0[j], y0[j]) * turn(i, x1[j], y1[j]) < 0
            i, j = pa.array(i[over]), pa.array(j[over])
            if len(i):
                yield from pa.table({"line1": lines.take(i), "seg1": segs.take(i), "line2": lines.take(j), "seg2": segs.take(j)}).combine_chunks().to_batches()

    run.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return held.groupBy("bx", "by").applyInArrow(run, schema)


def rasterize(areas: DataFrame, columns: int, rows: int) -> DataFrame:
    """Cells whose centre an area covers: the areas' columns with ``r, c``."""
    xs, ys = F.transform("shell", lambda p: p["x"]), F.transform("shell", lambda p: p["y"])
    low = lambda v, n: F.greatest(F.floor(F.array_min(v) * n), F.lit(0))
    high = lambda v, n: F.least(F.floor(F.array_max(v) * n), F.lit(n - 1))
    cells = areas.withColumn("c", F.explode(F.sequence(low(xs, columns), high(xs, columns)))).withColumn("r", F.explode(F.sequence(low(ys, rows), high(ys, rows))))
    return cells.where(G.area_covers(F.col("shell"), F.col("holes"), (F.col("c") + 0.5) / columns, (F.col("r") + 0.5) / rows)).drop("shell", "holes")


def nearest(points: DataFrame, sites: DataFrame, key: str, cutoff_km: float, degrees: float) -> DataFrame:
    """The nearest site (``site, slon, slat``) of each point (``key, lon, lat``) within ``cutoff_km``; ties to the least site.

    Both sides are bucketed by ``degrees`` of longitude and latitude; a point looks into the cells that the cutoff can reach.
    """
    reach = cutoff_km / G.KM_PER_LATITUDE_DEGREE
    wide = cutoff_km / G.LEAST_KM_PER_LONGITUDE_DEGREE
    cells = int(360 / degrees)
    half_width = F.least(cutoff_km / G.longitude_scale(F.least(F.abs(F.col("lat")) + reach, F.lit(89.0))), F.lit(min(wide, 180.0)))
    asked = points.withColumn("by", F.explode(F.sequence(F.floor((F.col("lat") - reach) / degrees), F.floor((F.col("lat") + reach) / degrees))))
    asked = asked.withColumn("bx", F.explode(F.array_distinct(F.transform(F.sequence(F.floor((F.col("lon") - half_width) / degrees), F.floor((F.col("lon") + half_width) / degrees)), lambda b: F.pmod(b, F.lit(cells))))))
    held = sites.withColumns({"bx": F.pmod(F.floor(F.col("slon") / degrees), F.lit(cells)), "by": F.floor(F.col("slat") / degrees)})
    near = asked.join(held, ["bx", "by"])
    east = G.normalize_longitude(F.col("slon") - F.col("lon")) * G.longitude_scale(F.col("lat"))
    north = (F.col("slat") - F.col("lat")) * G.KM_PER_LATITUDE_DEGREE
    measured = near.withColumn("km", F.sqrt(east * east + north * north)).where(F.col("km") <= cutoff_km)
    return measured.groupBy(key).agg(F.min(F.struct("km", "site")).alias("best")).select(key, "best.site", "best.km")


def clip_segments(parts: DataFrame) -> DataFrame:
    """Segments clipped to the unit square (Liang-Barsky): those that touch it, with their ends inside (``cx0 .. cy1``)."""
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    enter, leave, inside = F.lit(0.0), F.lit(1.0), F.lit(True)
    for p, q in ((-dx, F.col("x0")), (dx, 1 - F.col("x0")), (-dy, F.col("y0")), (dy, 1 - F.col("y0"))):
        enter = F.when(p < 0, F.greatest(enter, q / p)).otherwise(enter)
        leave = F.when(p > 0, F.least(leave, q / p)).otherwise(leave)
        inside = inside & ~((p == 0) & (q < 0))
    cut = parts.withColumns({"__t0": enter, "__t1": leave, "__in": inside}).where("__in AND __t0 <= __t1")
    return cut.select(*parts.columns, *((F.col(a) + (F.col(b) - F.col(a)) * F.col(t)).alias(n) for n, a, b, t in (("cx0", "x0", "x1", "__t0"), ("cy0", "y0", "y1", "__t0"), ("cx1", "x0", "x1", "__t1"), ("cy1", "y0", "y1", "__t1"))))


def first_layer(candidates: DataFrame, key: str) -> DataFrame:
    """Priority overlay: of each key's candidates (``layer, seq, class``) the lowest layer, within it the last painted."""
    return candidates.groupBy(key).agg(F.min(F.struct("layer", (-F.col("seq")).alias("order"), "class")).alias("top")).select(key, "top.layer", "top.class")
