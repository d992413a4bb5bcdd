"""Neighbourhood operators on dense long-form rasters (one row per cell, coordinates in two columns).

A raster is cut into square tiles with a halo of one cell: a cell at a tile's edge also goes to the tiles beside it. The tiles
are the unit of the one shuffle; the windows down the columns and along the rows of a tile need no other, and a window
partition is ``TILE`` + 2 cells long whatever the raster's shape. There is no self-join and no window over a whole raster.
``grid`` names the columns that tell rasters apart. Borders reflect unless said otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratafold.session import materialize, release

COLUMN, ROW = "c", "r"
#: Cells along a tile's side.
TILE = 64
KEYS = ("__tr", "__tc")


def with_halo(df: DataFrame, grid: Sequence[str] = ()) -> DataFrame:
    """Cells by tile (``__tr, __tc``), with copies of those around it; ``__own`` marks the tile's own."""

    def beside(at: str) -> Column:
        place = F.pmod(F.col(at), F.lit(TILE))
        return F.explode(F.when(place == 0, F.array(F.lit(0), F.lit(-1))).when(place == TILE - 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))

    spread = df.withColumn("__dr", beside(ROW)).withColumn("__dc", beside(COLUMN))
    tiled = spread.withColumns({"__tr": F.floor(F.col(ROW) / TILE) + F.col("__dr"), "__tc": F.floor(F.col(COLUMN) / TILE) + F.col("__dc"), "__own": (F.col("__dr") == 0) & (F.col("__dc") == 0)})
    return tiled.drop("__dr", "__dc").repartition(*grid, *KEYS)


def own(df: DataFrame) -> DataFrame:
    """The cells without the copies of the halo."""
    return df.where("__own").drop("__own", *KEYS)


def _along(grid: Sequence[str], fixed: str, moving: str):
    return Window.partitionBy(*grid, *KEYS, fixed).orderBy(moving)


def _ringed(tiled: DataFrame, value: str, grid: Sequence[str], reflect: bool = True) -> DataFrame:
    down, across = _along(grid, COLUMN, ROW), _along(grid, ROW, COLUMN)

    def pair(x: Column, window) -> tuple[Column, Column]:
        before, after = F.lag(x).over(window), F.lead(x).over(window)
        return (F.coalesce(before, after), F.coalesce(after, before)) if reflect else (F.coalesce(before, x), F.coalesce(after, x))

    south, north = pair(F.col(value), down)
    columns = tiled.withColumns({"__s": south, "__n": north})
    west, east = pair(F.struct(F.col("__s").alias("s"), F.col(value).alias("m"), F.col("__n").alias("n")), across)
    sides = columns.withColumns({"__w": west, "__e": east})
    ring = F.array(*(F.col(x) for x in ("__w.s", "__s", "__e.s", "__w.m", "__e.m", "__w.n", "__n", "__e.n")))
    return sides.withColumn("ring", ring).drop("__s", "__n", "__w", "__e")


def with_ring(df: DataFrame, value: str, grid: Sequence[str] = (), reflect: bool = True) -> DataFrame:
    """Adds ``ring``: the 8 neighbours' values, from the row below to the row above, reflected (or else clamped) at borders."""
    return own(_ringed(with_halo(df, grid), value, grid, reflect))


def despike_once(df: DataFrame, value: str, threshold: float, grid: Sequence[str] = (), frozen_border: bool = False) -> DataFrame:
    """One synchronous pass: a value that leaves the middle of its sorted ring by ``threshold`` or more becomes the ring's
    median. Adds ``replaced``. ``frozen_border`` leaves the outermost cells as they are."""
    ringed = _ringed(with_halo(df, grid), value, grid).withColumn("ring", F.sort_array("ring"))
    low, high = F.col("ring")[2], F.col("ring")[5]
    spike = F.greatest(low - F.col(value), F.col(value) - high) >= threshold
    if frozen_border:
        edge = F.lit(False)
        for fixed, moving in ((COLUMN, ROW), (ROW, COLUMN)):
            w = _along(grid, fixed, moving)
            edge = edge | F.lag(moving).over(w).isNull() | F.lead(moving).over(w).isNull()
        spike = spike & ~edge
    return own(ringed.withColumn("replaced", spike)).withColumn(value, F.when(F.col("replaced"), (F.col("ring")[3] + F.col("ring")[4]) / 2).otherwise(F.col(value))).drop("ring")


def despike(df: DataFrame, value: str, threshold: float, grid: Sequence[str] = (), most: int = 32) -> tuple[DataFrame, list[int]]:
    """Passes until one replaces nothing, and the number each pass replaced. Each pass is written, so lineage stays short."""
    counts: list[int] = []
    before = None
    for _ in range(most):
        after = materialize(despike_once(df, value, threshold, grid))
        counts.append(after.where("replaced").count())
        if before is not None:
            release(before)
        before, df = after, after.drop("replaced")
        if not counts[-1]:
            break
    return df, counts


def gradient(df: DataFrame, value: str, spacing: float, grid: Sequence[str] = ()) -> DataFrame:
    """Adds ``dx, dy, slope``: central differences, one-sided at the borders."""
    df = with_halo(df, grid)
    for name, (fixed, moving) in {"dx": (ROW, COLUMN), "dy": (COLUMN, ROW)}.items():
        w = _along(grid, fixed, moving)
        before, after = F.lag(value).over(w), F.lead(value).over(w)
        steps = before.isNotNull().cast("int") + after.isNotNull().cast("int")
        df = df.withColumn(name, F.when(steps > 0, (F.coalesce(after, F.col(value)) - F.coalesce(before, F.col(value))) / (steps * spacing)).otherwise(0.0))
    return own(df).withColumn("slope", F.hypot("dx", "dy"))


def matching_neighbours(df: DataFrame, value: str, grid: Sequence[str] = ()) -> DataFrame:
    """Adds ``same``: how many of a cell's 4 neighbours have its value."""
    tiled = with_halo(df, grid)
    same = [F.coalesce((f(value).over(w) == F.col(value)).cast("int"), F.lit(0)) for f in (F.lag, F.lead) for w in (_along(grid, COLUMN, ROW), _along(grid, ROW, COLUMN))]
    return own(tiled.withColumn("same", same[0] + same[1] + same[2] + same[3]))


def with_square(df: DataFrame, value: str, grid: Sequence[str] = ()) -> DataFrame:
    """Cells with the values to their right (``z1``), across (``z2``) and above (``z3``); those without all three are left out."""
    across, up = _along(grid, ROW, COLUMN), _along(grid, COLUMN, ROW)
    right = with_halo(df, grid).withColumn("z1", F.lead(value).over(across))
    return own(right.withColumns({"z2": F.lead("z1").over(up), "z3": F.lead(value).over(up)})).where("z1 IS NOT NULL AND z2 IS NOT NULL AND z3 IS NOT NULL")


def hillshade(df: DataFrame, value: str, spacing: float, azimuth: float = 315.0, altitude: float = 45.0, grid: Sequence[str] = ()) -> DataFrame:
    """Adds ``shade``: the cosine between surface normal and light, 0 at least."""
    import math

    east, north, up = math.cos(math.radians(altitude)) * math.sin(math.radians(azimuth)), math.cos(math.radians(altitude)) * math.cos(math.radians(azimuth)), math.sin(math.radians(altitude))
    shaded = gradient(df, value, spacing, grid)
    dot = -F.col("dx") * east - F.col("dy") * north + up
    return shaded.withColumn("shade", F.greatest(dot / F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + 1.0), F.lit(0.0)))


def drops(df: DataFrame, value: str, least: float, grid: Sequence[str] = ()) -> DataFrame:
    """Cells that lie ``least`` or more below the median of their clamped ring, with that depth."""
    ringed = with_ring(df, value, grid, reflect=False).withColumn("ring", F.sort_array("ring"))
    return ringed.withColumn("depth", (F.col("ring")[3] + F.col("ring")[4]) / 2 - F.col(value)).where(F.col("depth") >= least).drop("ring")


def curvature(df: DataFrame, value: str, grid: Sequence[str] = ()) -> DataFrame:
    """Adds ``bend``: the second difference along the row, null at its ends."""
    w = Window.partitionBy(*grid, ROW).orderBy(COLUMN)
    return df.withColumn("bend", F.lead(value).over(w) - 2 * F.col(value) + F.lag(value).over(w))


def run_lengths(df: DataFrame, value: str, grid: Sequence[str] = ()) -> DataFrame:
    """Runs of equal values along each row: their value, first column and length."""
    w = Window.partitionBy(*grid, ROW).orderBy(COLUMN)
    fresh = F.coalesce((F.lag(value).over(w) != F.col(value)).cast("int"), F.lit(1))
    return df.withColumn("__run", fresh).withColumn("__run", F.sum("__run").over(w)).groupBy(*grid, ROW, "__run").agg(F.first(value).alias(value), F.min(COLUMN).alias("start"), F.count(F.lit(1)).alias("length")).drop("__run")
