"""Priority overlay: what a sample of the printed surface shows of the features drawn over it.

Candidates are rows (sample, role, sequence, class): the features that cover a sample, found by any spatial join. One
aggregation a sample keeps the best of them, so samples under many features cost their rows and no more, and partial
aggregation comes before the shuffle.

The first of ``ROLES`` that a sample has wins. Of buildings the highest does, of plain areas and other lines the last painted; of
equals the last painted. Line roles and aviation areas count only with ``roads``, buildings only with ``buildings``. Standing
water (an area of class ``WATER``) is refused where the sample is steep or paved, that is under an aviation line or area,
drawn or not; ground of that class that is paved shows as ``ROCK``.

Defined cases. A sample without candidates shows its ground class. A null ``steep`` means it is not. Candidates of unknown
samples are dropped. Repeated candidates change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratafold.operators import kernels as K
from stratafold.operators import spatial

ROLES = ("marker", "building", "trail", "aerial", "rail", "ferry", "road", "aviation", "area", "line")
ROCK, WATER, AVIATION = 0, 3, 26


def paint(samples: DataFrame, candidates: DataFrame, key: str, roads: bool = True, buildings: bool = True) -> DataFrame:
    """``key, class, height`` of every sample (``key, ground, steep``) under its candidates (``key, role, seq, class, height``).

    ``height`` is that of the highest building over the sample, shown or not, 0 without one.
    """
    role, aviation_area = F.col("role"), (F.col("role") == "area") & (F.col("class") == AVIATION)
    lines = ROLES[2:8]
    allowed = F.when(role == "building", F.lit(buildings)).when(role.isin(*lines) | aviation_area, F.lit(roads)).otherwise(F.lit(True))
    standing = (role == "area") & (F.col("class") == WATER)
    rank = F.array_position(F.array(*map(F.lit, ROLES)), role)
    order = F.struct(rank.alias("rank"), F.when(role == "building", -F.col("height")).otherwise(0.0).alias("low"), (-F.col("seq")).alias("late"), F.col("class"))
    best = candidates.where(role.isin(*ROLES)).groupBy(key).agg(
        F.min(F.when(allowed & ~standing, order)).alias("dry"),
        F.min(F.when(allowed & standing, order)).alias("wet"),
        F.max((role == "aviation") | aviation_area).alias("paved"),
        F.max(F.when(role == "building", F.col("height"))).alias("height"),
    )
    joined = samples.join(best, key, "left")
    paved, steep = F.coalesce("paved", F.lit(False)), F.coalesce("steep", F.lit(False))
    top = F.when(F.col("wet").isNull() | steep | paved, F.col("dry")).otherwise(F.least("dry", "wet"))
    ground = F.when((F.col("ground") == WATER) & paved, F.lit(ROCK)).otherwise(F.col("ground"))
    return joined.select(key, F.coalesce(top["class"], ground).alias("class"), F.coalesce("height", F.lit(0.0)).alias("height"))


def paint_shapes(samples: DataFrame, areas: DataFrame, lines: DataFrame, key: str, roads: bool = True, buildings: bool = True, buckets: int = spatial.BUCKETS) -> DataFrame:
    """``paint`` of samples (``key, x, y, ground, steep``) under the areas (``shell, holes, role, seq, class, height``) and segments
    (``x0, y0, x1, y1, half, role, seq, class, height``) themselves.

    A bucket's samples and the shapes over it meet as arrays. Shapes come from the top down, and a sample that has what it needs
    is asked no more, so what lies below costs nothing. A segment of half width covers what is at most that far from it.
    """
    rank = F.array_position(F.array(*map(F.lit, ROLES)), F.col("role")).cast("double").alias("rank")
    shown = [rank, *(F.col(c).cast("double").alias(c) for c in ("seq", "class", "height"))]
    none, nowhere = F.lit(None).cast("double"), F.lit(None).cast("array<struct<x: double, y: double>>")
    known = F.col("role").isin(*ROLES)
    flat = spatial.ring_bounds(areas.where(known), "shell", buckets=buckets).select("bx", "by", "shell", "holes", *(none.alias(c) for c in ("x0", "y0", "x1", "y1", "half")), *shown)
    reach = F.col("half") + 1e-12
    thin = spatial.by_bounds(lines.where(known), F.least("x0", "x1") - reach, F.greatest("x0", "x1") + reach, F.least("y0", "y1") - reach, F.greatest("y0", "y1") + reach, buckets)
    thin = thin.select("bx", "by", nowhere.alias("shell"), F.array(nowhere).alias("holes"), "x0", "y0", "x1", "y1", "half", *shown)
    schema = T.StructType([samples.schema[key], T.StructField("class", T.IntegerType()), T.StructField("height", T.DoubleType())])

    def work(left: pa.Table, right: pa.Table) -> Iterator[pa.Table]:
        x, y, ground, steep = K.numbers(left, "x", "y", "ground", "steep")
        if not right.num_rows:
            yield pa.table({key: left.column(key), "class": left.column("ground").cast(pa.int32()), "height": pa.array(np.zeros(len(x)))})
            return
        drawn = right.filter(right.column("half").is_valid())
        filled = right.filter(right.column("half").is_null())
        shapes = (K.Areas(filled), K.Segments(K.numbers(drawn, "x0", "y0", "x1", "y1"), K.numbers(drawn, "half")[0]))
        rank, seq, kind, height = (np.concatenate(v) for v in zip(*(K.numbers(t, "rank", "seq", "class", "height") for t in (filled, drawn))))
        is_role = lambda *roles: np.isin(rank, [ROLES.index(r) + 1 for r in roles])
        order = np.lexsort((kind, -seq, np.where(is_role("building"), -height, 0.0), rank))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        beyond, split = len(order), filled.num_rows

        def top(which: np.ndarray, asked: np.ndarray) -> np.ndarray:
            """Places in the order of the first of some shapes over each of the asked samples, or ``beyond``."""
            best = np.full(len(asked), beyond)
            for role in np.unique(rank[which]):
                left_ = np.flatnonzero(best == beyond)
                for shape, low, high in ((shapes[0], 0, split), (shapes[1], split, beyond)):
                    own = order[(which & (rank == role))[order] & (order >= low) & (order < high)]
                    if len(own) and len(left_):
                        found = K.first_covering(shape, own - low, x[asked[left_]], y[asked[left_]])
                        best[left_] = np.minimum(best[left_], np.where(found < 0, beyond, place[own[found]]))
            return best

        every = np.arange(len(x))
        aviation_area = is_role("area") & (kind == AVIATION)
        allowed = np.where(is_role("building"), buildings, np.where(is_role(*ROLES[2:8]) | aviation_area, roads, True)).astype(np.bool_)
        standing = is_role("area") & (kind == WATER)
        paved = top(is_role("aviation") | aviation_area, every) < beyond
        highest = top(is_role("building"), every)
        best = top(allowed & ~standing, every)
        # Standing water is asked for only where what is best so far does not come before it.
        area = ROLES.index("area") + 1
        open_ = np.flatnonzero(~paved & ~(steep == 1) & ((best == beyond) | (rank[order[np.minimum(best, beyond - 1)]] >= area)))
        best[open_] = np.minimum(best[open_], top(allowed & standing, open_))
        base = np.where((ground == WATER) & paved, float(ROCK), ground)
        shows = np.where(best < beyond, kind[order[np.minimum(best, beyond - 1)]], base)
        tall = np.where(highest < beyond, height[order[np.minimum(highest, beyond - 1)]], 0.0)
        yield pa.table({key: left.column(key), "class": pa.array(shows, from_pandas=True).cast(pa.int32()), "height": pa.array(tall)})

    return K.bucketed(spatial.at_points(samples, buckets), flat.unionByName(thin), ["bx", "by"], work, schema, lone=True)
