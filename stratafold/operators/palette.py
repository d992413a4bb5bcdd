"""Deterministic colour palettes: shading correction, diversity, k-means with fixed seeds, merging and assignment.

Points are rows ``id, grp, l, a, b`` (OKLab). Centroids are a handful of rows by definition (a palette has at most a few
entries a group), so they are held on the driver and enter the plans as literals; every pass over the points is an ordinary
aggregation with partial sums. Ties go to the lower cluster index, seeds are quantiles of the distinct sorted colours, and
the number of rounds is bounded, so equal inputs give equal palettes.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafold.functions.colour import hex_of
from stratafold.operators.ranking import ranked
from stratafold.session import materialize

ROUNDS = 32
#: Colours closer than this are one.
SAME = 0.01
AXES = ("l", "a", "b")


def normalize_lightness(points: DataFrame, strength: float) -> DataFrame:
    """Each point scaled towards its group's mean lightness, by a factor of 2 at most in either direction."""
    means = points.groupBy(F.col("grp").alias("__grp")).agg(F.avg("l").alias("__mean"))
    factor = F.when(F.col("l") > 1.2e-7, F.least(F.greatest(1 + strength * (F.col("__mean") / F.col("l") - 1), F.lit(0.5)), F.lit(2.0))).otherwise(1.0)
    scaled = points.join(means, F.col("grp").eqNullSafe(F.col("__grp"))).withColumn("__f", factor)
    return scaled.withColumns({x: F.col(x) * F.col("__f") for x in AXES}).drop("__f", "__grp", "__mean")


def diversity(points: DataFrame) -> DataFrame:
    """Per group its size and the summed population variance of the axes."""
    return points.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), sum((F.var_pop(x) for x in AXES), F.lit(0.0)).alias("variance"))


def seeds(points: DataFrame, counts: dict[int, int]) -> dict[int, list[tuple[float, ...]]]:
    """Evenly spaced distinct colours of each group in sorted order, both ends included."""
    placed = ranked(points.select("grp", *AXES).distinct(), ["grp"], AXES).withColumnsRenamed({"__k": "k", "__n": "n"})
    wanted = F.lit(False)
    for grp, count in counts.items():
        k = F.least(F.lit(count), F.col("n"))
        spread = F.exists(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: (i < k) & (F.col("k") == F.when(k == 1, F.floor((F.col("n") - 1) / 2)).otherwise(F.floor(i * (F.col("n") - 1) / (k - 1)))))
        wanted = wanted | ((F.col("grp") == grp) & spread)
    out: dict[int, list[tuple[float, ...]]] = {g: [] for g in counts}
    for row in placed.where(wanted).select("grp", "k", *AXES).orderBy("grp", "k").collect():
        out[row["grp"]].append(tuple(row[x] for x in AXES))
    return out


def nearest(centroids: dict[int, list[tuple[float, ...]]]) -> Column:
    """Index of the nearest centroid of the point's group; the lower index on a tie, null for a group without any."""
    out = None
    for grp, entries in centroids.items():
        if not entries:
            continue
        ranks = [F.struct(sum(((F.col(x) - F.lit(float(v))) * (F.col(x) - F.lit(float(v))) for x, v in zip(AXES, c)), F.lit(0.0)).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(entries)]
        best = (F.least(*ranks) if len(ranks) > 1 else ranks[0])["i"]
        out = (F.when if out is None else out.when)(F.col("grp") == grp, best)
    return F.lit(None).cast("int") if out is None else out


def cluster(points: DataFrame, counts: dict[int, int], rounds: int = ROUNDS) -> dict[int, list[tuple[float, ...]]]:
    """Lloyd rounds from the quantile seeds; a cluster that loses all points keeps its place."""
    points = materialize(points.select("grp", *AXES))
    centroids = seeds(points, counts)
    for _ in range(rounds):
        sums = points.withColumn("k", nearest(centroids)).groupBy("grp", "k").agg(*(F.avg(x).alias(x) for x in AXES)).collect()
        moved = {g: list(c) for g, c in centroids.items()}
        for row in sums:
            if row["k"] is not None:
                moved[row["grp"]][row["k"]] = tuple(row[x] for x in AXES)
        if all(np.allclose(moved[g], centroids[g], rtol=0, atol=1e-12) for g in moved if moved[g]):
            return moved
        centroids = moved
    return centroids


def shares_of(points: DataFrame, centroids: dict[int, list[tuple[float, ...]]]) -> dict[tuple[int, int], float]:
    """The share of all points that is nearest to each centroid."""
    counts = {(r["grp"], r["k"]): r["n"] for r in points.withColumn("k", nearest(centroids)).groupBy("grp", "k").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values()) or 1
    return {at: n / total for at, n in counts.items()}


def closest_pair(entries: list[tuple[float, ...]]) -> tuple[int, int] | None:
    """The closest two entries that print as one: closer than ``SAME``, or of the same hex colour at any distance."""
    pairs = [(math.dist(a, b), i, j) for i, a in enumerate(entries) for j, b in enumerate(entries) if i < j]
    close = [p for p in pairs if p[0] < SAME or hex_of(entries[p[1]]) == hex_of(entries[p[2]])]
    return min(close)[1:] if close else None


def merge_close(entries: list[tuple[float, ...]], shares_now: Callable[[list[tuple[float, ...]]], list[float]], least_share: float) -> list[tuple[float, ...]]:
    """Merges the closest pair that prints as one (weighted by share) until there is none, then drops entries of less than the
    least share, the smallest first, while more than one is left. Shares are taken anew before every step."""
    held = list(entries)
    while pair := closest_pair(held):
        shares = shares_now(held)
        i, j = pair
        a, b = max(shares[i], 1e-9), max(shares[j], 1e-9)
        held[i] = tuple((x * a + y * b) / (a + b) for x, y in zip(held[i], held[j]))
        del held[j]
    while len(held) > 1:
        shares = shares_now(held)
        least = min(range(len(held)), key=shares.__getitem__)
        if shares[least] >= least_share:
            break
        del held[least]
    return held


def discover(points: DataFrame, counts: dict[int, int], least_share: float) -> dict[int, list[tuple[float, ...]]]:
    """Clusters, merged and without those too small, by group; ordered by lightness and the other axes."""
    points = materialize(points)
    found = cluster(points, counts)
    for g in sorted(found):

        def shares_now(entries: list[tuple[float, ...]], g: int = g) -> list[float]:
            shares = shares_of(points, found | {g: entries})
            return [shares.get((g, i), 0.0) for i in range(len(entries))]

        found[g] = merge_close(found[g], shares_now, least_share)
    return {g: sorted(entries) for g, entries in found.items()}


def assign(points: DataFrame, palette: dict[int, list[tuple[float, ...]]], valid: Column) -> DataFrame:
    """Each valid point's palette entry; a group without entries takes the nearest of all. Numbers run through the groups."""
    flat = [(g, i, c) for g, entries in sorted(palette.items()) for i, c in enumerate(entries)]
    if not flat:
        return points.withColumn("entry", F.lit(None).cast("int"))
    number = {(g, i): n for n, (g, i, _) in enumerate(flat)}
    own = nearest(palette)
    offset = None
    for g, entries in palette.items():
        if entries:
            offset = (F.when if offset is None else offset.when)(F.col("grp") == g, number[g, 0])
    ranks = [F.struct(sum(((F.col(x) - F.lit(float(v))) * (F.col(x) - F.lit(float(v))) for x, v in zip(AXES, c)), F.lit(0.0)).alias("d"), F.lit(n).alias("i")) for n, (_, _, c) in enumerate(flat)]
    anywhere = (F.least(*ranks) if len(ranks) > 1 else ranks[0])["i"]
    return points.withColumn("entry", F.when(valid, F.coalesce(own + offset, anywhere)))
