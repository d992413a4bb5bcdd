"""Sampling and resampling of rasters by equi-joins on computed cell addresses.

The raster is packed into blocks with a halo, one row each; a sample finds its block by address and reads all its cells from
the block's array, so a sample of 16 cells is one row of one equi-join. At scale both sides are partitioned by block (Spark
picks the join; a small raster is broadcast only within the planner's size limit). Cells that a raster lacks read as null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratafold.functions.geo import catmull_rom_weights
from stratafold.operators import kernels as K


def nearest(samples: DataFrame, raster: DataFrame, row: Column, column: Column, value: str) -> DataFrame:
    """``samples`` with the raster's value at the given cell."""
    return samples.withColumns({"r": row, "c": column}).join(raster.select("r", "c", value), ["r", "c"]).drop("r", "c")


#: Cells along a block's side, and those around it that its samples may read (before, after).
BLOCK, BEFORE, AFTER = 32, 1, 2


def _blocks(raster: DataFrame, value: str, rows: int, columns: int) -> DataFrame:
    """The raster as one row a block, with the values of its cells and halo: in row order (``__a``), or by place (``__m``) where
    the block has gaps."""

    def holders(at: str) -> Column:
        return F.explode(F.sequence(F.greatest(F.floor((F.col(at) - AFTER) / BLOCK), F.lit(0)), F.floor((F.col(at) + BEFORE) / BLOCK)))

    side = BLOCK + BEFORE + AFTER
    spread = raster.select("r", "c", F.col(value).alias("__v")).withColumn("__br", holders("r")).withColumn("__bc", holders("c"))
    place = (F.col("r") - F.col("__br") * BLOCK + BEFORE) * side + F.col("c") - F.col("__bc") * BLOCK + BEFORE
    held = spread.groupBy("__br", "__bc").agg(F.sort_array(F.collect_list(F.struct(place.cast("int").alias("p"), "__v"))).alias("__h"))
    height = F.least(F.lit(rows - 1), F.col("__br") * BLOCK + BLOCK - 1 + AFTER) - F.greatest(F.lit(0), F.col("__br") * BLOCK - BEFORE) + 1
    width = F.least(F.lit(columns - 1), F.col("__bc") * BLOCK + BLOCK - 1 + AFTER) - F.greatest(F.lit(0), F.col("__bc") * BLOCK - BEFORE) + 1
    whole = F.size("__h") == height * width
    return held.select("__br", "__bc", width.alias("__wide"), F.when(whole, F.col("__h.__v")).alias("__a"), F.when(~whole, F.map_from_entries("__h")).alias("__m"))


def windows(samples: DataFrame, raster: DataFrame, row: Column, column: Column, value: str, rows: int, columns: int) -> tuple[DataFrame, Callable[[int, int], Column]]:
    """``samples`` with the block of the raster around each, by one equi-join on the block's address, and the expression of the
    value at a (row, column) offset from the sample's cell, clamped at the borders."""
    clamp = lambda x, n: F.least(F.greatest(x, F.lit(0)), F.lit(n - 1))
    at = samples.withColumns({"__r": row, "__c": column})
    at = at.withColumns({"__br": F.floor(clamp(F.col("__r"), rows) / BLOCK), "__bc": F.floor(clamp(F.col("__c"), columns) / BLOCK)})
    joined = at.join(_blocks(raster, value, rows, columns), ["__br", "__bc"])
    south, west = F.greatest(F.lit(0), F.col("__br") * BLOCK - BEFORE), F.greatest(F.lit(0), F.col("__bc") * BLOCK - BEFORE)

    def got(i: int, j: int) -> Column:
        r, c = clamp(F.col("__r") + i, rows), clamp(F.col("__c") + j, columns)
        place = (r - F.col("__br") * BLOCK + BEFORE) * (BLOCK + BEFORE + AFTER) + c - F.col("__bc") * BLOCK + BEFORE
        return F.when(F.col("__a").isNotNull(), F.get("__a", ((r - south) * F.col("__wide") + c - west).cast("int"))).otherwise(F.try_element_at("__m", place.cast("int")))

    return joined, got


def done(df: DataFrame) -> DataFrame:
    return df.drop("__y", "__x", "__r", "__c", "__br", "__bc", "__wide", "__a", "__m", "__window")


def bilinear(samples: DataFrame, raster: DataFrame, y: Column, x: Column, value: str, rows: int, columns: int) -> DataFrame:
    """Bilinear value at fractional cell coordinates (clamped to the raster), as column ``value``."""
    held = samples.withColumns({"__y": F.least(F.greatest(y, F.lit(0.0)), F.lit(float(rows - 1))), "__x": F.least(F.greatest(x, F.lit(0.0)), F.lit(float(columns - 1)))})
    got, v = windows(held, raster, F.floor("__y"), F.floor("__x"), value, rows, columns)
    ty, tx = F.col("__y") - F.floor("__y"), F.col("__x") - F.floor("__x")
    low, high = v(0, 0) * (1 - tx) + v(0, 1) * tx, v(1, 0) * (1 - tx) + v(1, 1) * tx
    return done(got.withColumn("value", low * (1 - ty) + high * ty))


def bicubic(samples: DataFrame, raster: DataFrame, y: Column, x: Column, value: str, rows: int, columns: int) -> DataFrame:
    """Catmull-Rom value over 4 x 4 cells, clamped to their range; cell centres lie at half-way coordinates."""
    held = samples.withColumns({"__y": y - 0.5, "__x": x - 0.5})
    got, read = windows(held, raster, F.floor("__y"), F.floor("__x"), value, rows, columns)
    got = got.withColumn("__window", F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: read(F.floor(k / 4) - 1, k % 4 - 1)))
    wy, wx = (catmull_rom_weights(F.col(c) - F.floor(c)) for c in ("__y", "__x"))
    weights = F.array(*(a * b for a in wy for b in wx))
    cubic = F.aggregate(F.zip_with("__window", weights, lambda v, w: v * w), F.lit(0.0), lambda total, v: total + v)
    return done(got.withColumn("value", F.least(F.greatest(cubic, F.array_min("__window")), F.array_max("__window"))))


def class_vote(samples: DataFrame, raster: DataFrame, y: Column, x: Column, value: str, rows: int, columns: int) -> DataFrame:
    """The class with the greatest bilinear weight; ties go to the highest class."""
    held = samples.withColumns({"__y": F.least(F.greatest(y, F.lit(0.0)), F.lit(float(rows - 1))), "__x": F.least(F.greatest(x, F.lit(0.0)), F.lit(float(columns - 1)))})
    got, v = windows(held, raster, F.floor("__y"), F.floor("__x"), value, rows, columns)
    ty, tx = F.col("__y") - F.floor("__y"), F.col("__x") - F.floor("__x")
    corners = [(v(i, j), (ty if i else 1 - ty) * (tx if j else 1 - tx)) for i in (0, 1) for j in (0, 1)]
    entries = [F.struct(F.round(sum((F.when(c == k, w).otherwise(0.0) for k, w in corners), F.lit(0.0)), 9).alias("w"), c.alias("k")) for c, _ in corners]
    return done(got.withColumn("value", F.array_max(F.array(*entries))["k"]))


#: Least cells along the side of a tile in which lines read their stations; stations that are worked on at a time.
TILE, AT_ONCE = 64, 50_000


def highest_across(lines: DataFrame, key: str, raster: DataFrame, value: str, rows: int, columns: int, last: int, ahead: float, across: int) -> DataFrame:
    """``key, station, value``: the highest of ``2 * across + 1`` cells across each line (``key, half, x0, y0, x1, y1, x2, y2``: two
    segments) at its stations 0 to ``last``, which part its length evenly.

    The cells lie evenly from ``half`` on one side to ``half`` on the other; a station's direction is that from ``ahead`` (a share
    of the length) before it to as much after it. Places are clamped to the unit square. Stations without any cell are left out.

    Lines go to the tiles that their bounds touch. A tile holds the cells around it that the widest line reads across, so it gives
    the stations in it as a whole and no sample becomes a row.
    """
    lines = lines.dropna(subset=["half", *(f"{c}{i}" for c in "xy" for i in range(3))])
    widest = lines.agg(F.max(F.abs("half"))).first()[0] or 0.0
    halo_r, halo_c = (min(int(widest * (n - 1)) + 2, n) for n in (rows, columns))
    tall, wide = max(TILE, 4 * halo_r), max(TILE, 4 * halo_c)

    def touched(c: str, n: int, side: int) -> Column:
        # A cell more on each side, for what rounding moves.
        at = lambda v, more: F.floor((F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)) * (n - 1) + 0.5 + more) / side)
        corners = [F.col(f"{c}{i}") for i in range(3)]
        return F.explode(F.sequence(at(F.least(*corners), -1), at(F.greatest(*corners), 1)))

    def holders(c: str, halo: int, side: int) -> Column:
        return F.explode(F.sequence(F.floor((F.col(c) - halo) / side), F.floor((F.col(c) + halo) / side)))

    asked = lines.withColumn("__tr", touched("y", rows, tall)).withColumn("__tc", touched("x", columns, wide))
    asked = asked.withColumns({"__r": F.col("__tr") * tall, "__c": F.col("__tc") * wide})
    cells = raster.select("r", "c", F.col(value).cast("double").alias("z")).withColumn("__tr", holders("r", halo_r, tall)).withColumn("__tc", holders("c", halo_c, wide))
    steps, shifts = np.arange(last + 1) / float(last), np.arange(-across, across + 1)
    schema = T.StructType([lines.schema[key], T.StructField("station", T.IntegerType()), T.StructField(value, T.DoubleType())])

    def cell(v: np.ndarray, n: int) -> np.ndarray:
        v = np.minimum(np.maximum(v, 0.0), 1.0) * (n - 1)
        low = np.floor(v)
        return (low + (v - low >= 0.5)).astype(np.int64)

    def place(line: np.ndarray, progress: np.ndarray) -> np.ndarray:
        half, x0, y0, x1, y1, x2, y2 = line
        l0, l1 = np.sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2), np.sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2)
        gone = progress * (l0 + l1)
        with np.errstate(divide="ignore", invalid="ignore"):
            first = np.where(l0 > 0, np.minimum(gone / l0, 1.0), 1.0)
            second = np.where(l1 > 0, np.minimum(np.maximum((gone - l0) / l1, 0.0), 1.0), 0.0)
        return np.stack([np.where(gone <= l0, a + (b - a) * first, b + (d - b) * second) for a, b, d in ((x0, x1, x2), (y0, y1, y2))])

    def work(left: pa.Table, right: pa.Table) -> Iterator[pa.Table]:
        south, west = (int(left.column(n)[0].as_py()) for n in ("__r", "__c"))
        high, broad = tall + 2 * halo_r, wide + 2 * halo_c
        r, c, z = K.numbers(right, "r", "c", "z")
        at = (r.astype(np.int64) - south + halo_r) * broad + c.astype(np.int64) - west + halo_c
        known = right.column("z").is_valid().to_numpy()
        there, held, top = np.zeros(high * broad, np.bool_), np.zeros(high * broad, np.bool_), np.full(high * broad, -np.inf)
        there[at], held[at[known]] = True, True
        np.maximum.at(top, at[known], z[known])
        numbers = K.numbers(left, "half", *(f"{c}{i}" for i in range(3) for c in "xy"))
        for some in K.chunks(np.full(left.num_rows, last + 1), AT_ONCE):
            x, y = place(numbers[:, some][..., None], steps)
            sr, sc = cell(y, rows) - south, cell(x, columns) - west
            line, station = np.nonzero((sr >= 0) & (sr < tall) & (sc >= 0) & (sc < wide))
            own, p = numbers[:, some][:, line], steps[station]
            (ax, ay), (bx, by) = place(own, np.minimum(p + ahead, 1.0)), place(own, np.maximum(p - ahead, 0.0))
            dx, dy = ax - bx, ay - by
            long = np.sqrt(dx * dx + dy * dy)
            with np.errstate(divide="ignore", invalid="ignore"):
                ux, uy = np.where(long > 1e-9, dx / long, 1.0), np.where(long > 1e-9, dy / long, 0.0)
            half = own[0][:, None]
            u = x[line, station][:, None] - uy[:, None] * half * shifts / across
            v = y[line, station][:, None] + ux[:, None] * half * shifts / across
            read = (cell(v, rows) - south + halo_r) * broad + cell(u, columns) - west + halo_c
            got = np.flatnonzero(there[read].any(axis=1))
            read = read[got]
            yield pa.table({
                key: left.column(key).take(pa.array(line[got] + some.start)),
                "station": pa.array(station[got].astype(np.int32)),
                value: pa.array(top[read].max(axis=1), mask=~held[read].any(axis=1)),
            })

    return K.bucketed(asked, cells, ["__tr", "__tc"], work, schema)
