"""Ordinary indicator kriging of class borders from a coarser native lattice."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafold.operators.sampling import done, windows

#: Steps of the fractional position within a native cell; the table has (STEPS + 1) squared stencils.
STEPS = 16
_NODES = np.array([(i, j) for i in range(-1, 3) for j in range(-1, 3)], float)


def variogram(distance: np.ndarray, reach: float, nugget: float) -> np.ndarray:
    """Spherical: 0 at 0, rising from the nugget to nugget + 1 at the reach."""
    t = np.minimum(distance / reach, 1.0)
    return np.where(distance > 0, nugget + 1.5 * t - 0.5 * t**3, 0.0)


def stencils(reach: float, nugget: float) -> np.ndarray:
    """Weights (STEPS + 1, STEPS + 1, 16) of the 4 x 4 nodes by fractional row and column; each stencil sums to 1."""
    gaps = np.linalg.norm(_NODES[:, None] - _NODES[None], axis=2)
    system = np.ones((17, 17))
    system[:16, :16] = variogram(gaps, reach, nugget)
    system[16, 16] = 0.0
    steps = np.arange(STEPS + 1) / STEPS
    targets = np.stack(np.meshgrid(steps, steps, indexing="ij"), -1).reshape(-1, 1, 2)
    right = np.ones((len(targets), 17))
    right[:, :16] = variogram(np.linalg.norm(_NODES[None] - targets, axis=2), reach, nugget)
    return np.linalg.solve(system, right.T).T[:, :16].reshape(STEPS + 1, STEPS + 1, 16)


def smooth(samples: DataFrame, native: DataFrame, y: Column, x: Column, value: str, rows: int, columns: int, reach: float = 3.0, nugget: float = 0.1) -> DataFrame:
    """``samples`` with ``value``, the class of greatest kriged indicator at fractional native coordinates; ties go to the highest
    class.

    The 289 stencils are a fixed table, solved here and broadcast. A sample reads its nodes from one block of the lattice and is
    scored in its own row.
    """
    table = stencils(reach, nugget)
    rows_of = [(i, j, [float(w) for w in table[i, j]]) for i in range(STEPS + 1) for j in range(STEPS + 1)]
    weights = samples.sparkSession.createDataFrame(rows_of, "oy int, ox int, weights array<double>")
    cell = lambda v, n: F.least(F.greatest(F.floor(v), F.lit(0)), F.lit(n - 2))
    step = lambda v, n: F.round(F.least(F.greatest(v - cell(v, n), F.lit(0.0)), F.lit(1.0)) * STEPS).cast("int")
    placed = samples.withColumns({"__y": cell(y, rows), "__x": cell(x, columns), "oy": step(y, rows), "ox": step(x, columns)})
    got, node = windows(placed, native, F.col("__y"), F.col("__x"), value, rows, columns)
    got = got.withColumn("__window", F.array(*(node(i, j) for i in range(-1, 3) for j in range(-1, 3)))).join(F.broadcast(weights), ["oy", "ox"])
    share = lambda k: F.aggregate(F.zip_with("__window", "weights", lambda c, w: F.when(c == k, w).otherwise(0.0)), F.lit(0.0), lambda total, w: total + w)
    scored = F.transform(F.array_distinct("__window"), lambda k: F.struct(F.round(share(k), 9).alias("w"), k.alias("k")))
    return done(got.withColumn("value", F.array_max(scored)["k"])).drop("oy", "ox", "weights")
