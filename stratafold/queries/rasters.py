"""Queries of focal, zonal, resampling and connectivity operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafold.operators import focal, graph, sampling
from stratafold.operators.ranking import ranked
from stratafold.plans import fixtures as fx
from stratafold.plans.fixtures import with_views
from stratafold.session import materialize

THRESHOLD = 80.0


def fx00_height_frame(s: SparkSession, d: str) -> DataFrame:
    """One repair pass, elevation bounds, and each cell's height within them."""
    # Written once: the bounds and the heights both read it.
    repaired = materialize(focal.despike_once(fx.cells(s, d), "z", THRESHOLD).select("r", "c", "z"))
    bounds = repaired.agg(F.min("z").alias("low"), F.max("z").alias("high"))
    return repaired.join(F.broadcast(bounds)).select("r", "c", F.round(F.greatest((F.col("z") - F.col("low")) / F.greatest(F.col("high") - F.col("low"), F.lit(1.0)), F.lit(0.0)), 6).alias("height"))


def w01_ring(s: SparkSession, d: str) -> DataFrame:
    ringed = focal.with_ring(fx.cells(s, d), "z").withColumn("ring", F.sort_array("ring"))
    return ringed.select("r", "c", *(F.col("ring")[i].alias(f"n{i}") for i in range(8)))


def w02_spikes(s: SparkSession, d: str) -> DataFrame:
    return focal.despike_once(fx.cells(s, d), "z", THRESHOLD).where("replaced").select("r", "c")


def w03_despike(s: SparkSession, d: str) -> DataFrame:
    return focal.despike_once(fx.cells(s, d), "z", THRESHOLD).select("r", "c", F.round("z", 6).alias("z"), "replaced")


def w04_despike_fixed_point(s: SparkSession, d: str) -> DataFrame:
    repaired, _ = focal.despike(fx.cells(s, d), "z", THRESHOLD)
    return repaired.select("r", "c", F.round("z", 6).alias("z"))


def w05_gradient(s: SparkSession, d: str) -> DataFrame:
    return focal.gradient(fx.cells(s, d), "z", 10.0).select("r", "c", *(F.round(x, 5).alias(x) for x in ("dx", "dy", "slope")))


def w06_slope_gates(s: SparkSession, d: str) -> DataFrame:
    """Forest too steep becomes rock, or snow from the snowline up (if there is one); snow too steep becomes rock; steep water becomes rock."""
    slopes = focal.gradient(fx.cells(s, d), "z", 10.0).select("r", "c", "z", "slope")
    gated = slopes.join(fx.class_cells(s, d), ["r", "c"]).join(F.broadcast(a21_snowline(s, d)))
    forest = F.when((F.col("class") == 1) & (F.col("slope") > 4.0), F.when(F.col("z") >= F.col("snowline"), 2).otherwise(0)).otherwise(F.col("class"))
    snow = F.when((F.col("k") == 2) & (F.col("slope") > 6.0), 0).otherwise(F.col("k"))
    return gated.withColumn("k", forest).withColumn("k", snow).selectExpr("r", "c", "CASE WHEN k = 3 AND slope > 2 THEN 0 ELSE k END AS class", "class = 3 AND slope > 2 AS steep_water")


def _shape(s: SparkSession, d: str) -> tuple[int, int]:
    return fx.cells(s, d).agg(F.max("r") + 1, F.max("c") + 1).first()


def w07_catmull(s: SparkSession, d: str) -> DataFrame:
    rows, columns = _shape(s, d)
    got = sampling.bicubic(fx.spots(s, d), fx.cells(s, d), F.col("y") * rows, F.col("x") * columns, "z", rows, columns)
    return got.select("id", F.round("value", 5).alias("value"))


def w08_bilinear(s: SparkSession, d: str) -> DataFrame:
    rows, columns = _shape(s, d)
    got = sampling.bilinear(fx.spots(s, d), fx.cells(s, d), F.col("y") * (rows - 1), F.col("x") * (columns - 1), "z", rows, columns)
    return got.select("id", F.round("value", 5).alias("value"))


def w09_class_vote(s: SparkSession, d: str) -> DataFrame:
    rows, columns = _shape(s, d)
    got = sampling.class_vote(fx.spots(s, d), fx.class_cells(s, d), F.col("y") * (rows - 1), F.col("x") * (columns - 1), "class", rows, columns)
    return got.select("id", "value")


def w12_native(s: SparkSession, d: str) -> DataFrame:
    """Nearest down-sample to every fourth cell and back."""
    native = fx.class_cells(s, d).where("r % 4 = 0 AND c % 4 = 0").selectExpr("r DIV 4 AS nr", "c DIV 4 AS nc", "class AS native")
    return fx.class_cells(s, d).selectExpr("r", "c", "r DIV 4 AS nr", "c DIV 4 AS nc").join(native, ["nr", "nc"]).select("r", "c", "native")


def w13_hillshade(s: SparkSession, d: str) -> DataFrame:
    return focal.hillshade(fx.cells(s, d), "z", 30.0).select("r", "c", F.round("shade", 5).alias("shade"))


def w14_drops(s: SparkSession, d: str) -> DataFrame:
    return focal.drops(fx.cells(s, d), "z", 20.0).select("r", "c", F.round("depth", 6).alias("depth"))


def w16_edge_ring(s: SparkSession, d: str) -> DataFrame:
    """The border cells in perimeter order: first row, last column, last row backwards, first column backwards."""
    cells = fx.class_cells(s, d)
    size = cells.agg((F.max("r") + 1).alias("h"), (F.max("c") + 1).alias("w"))
    place = F.expr("CASE WHEN r = 0 THEN c WHEN c = w - 1 THEN w - 1 + r WHEN r = h - 1 THEN w + h - 2 + (w - 1 - c) WHEN c = 0 THEN 2 * w + h - 3 + (h - 1 - r) END")
    return cells.join(F.broadcast(size)).select(place.alias("place"), "class").where("place IS NOT NULL")


def a01_bounds(s: SparkSession, d: str) -> DataFrame:
    return fx.cells(s, d).agg(F.min("z").alias("low"), F.max("z").alias("high"))


def a02_coverage(s: SparkSession, d: str) -> DataFrame:
    """Percent of cells by class; classes of the dimension without any give 0."""
    counted = fx.class_cells(s, d).groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    classes = s.range(0, 13).select(F.col("id").cast("int").alias("class"))
    return classes.join(counted, "class", "left").join(F.broadcast(total)).select("class", F.round(F.coalesce("n", F.lit(0)) * 100.0 / F.col("total"), 6).alias("percent"))


def a03_contained_classes(s: SparkSession, d: str) -> DataFrame:
    overlays = fx.areas(s, d).selectExpr("CAST(class + 4 AS INT) AS class")
    return fx.class_cells(s, d).select("class").unionByName(overlays).distinct()


def a04_demotions(s: SparkSession, d: str) -> DataFrame:
    gates = focal.gradient(fx.cells(s, d), "z", 10.0).join(fx.class_cells(s, d), ["r", "c"])
    return gates.agg(F.count_if(F.expr("class = 1 AND slope > 4")).alias("forest"), F.count_if(F.expr("class = 2 AND slope > 6")).alias("snow"), F.count_if(F.expr("class = 3 AND slope > 2")).alias("water"), F.count(F.lit(1)).alias("cells"))


def a17_stitch_mean(s: SparkSession, d: str) -> DataFrame:
    """Two tiles that share a border column: shared samples are averaged."""
    left = fx.cells(s, d).where("c < 51").select("r", "c", "z")
    right = fx.cells(s, d).where("c >= 50").selectExpr("r", "c", "z + 1 AS z")
    return left.unionByName(right).groupBy("r", "c").agg(F.round(F.avg("z"), 6).alias("z"))


def a18_shared_frame(s: SparkSession, d: str) -> DataFrame:
    tiles = fx.cells(s, d).groupBy((F.col("c") / 25).cast("int").alias("tile")).agg(F.min("z").alias("low"), F.max("z").alias("high"))
    frame = tiles.agg(F.min("low").alias("datum"), F.max("high").alias("top"))
    return tiles.join(F.broadcast(frame)).select("tile", "low", "high", "datum", "top", (F.col("low") + 0.01 < F.col("datum")).alias("violates"))


def a21_snowline(s: SparkSession, d: str) -> DataFrame:
    """The 10th-percentile elevation of snow, null where snow covers less than a hundredth."""
    joined = fx.cells(s, d).join(fx.class_cells(s, d), ["r", "c"])
    share = joined.agg((F.count_if(F.expr("class = 2")) * 100 >= F.count(F.lit(1))).alias("enough"))
    ranks = ranked(joined.where("class = 2").select("class", "z"), ["class"], ["z"])
    # The value at the truncated index; the ranks come from range partitions, so no task sorts all snow.
    line = ranks.where("__k = (__n - 1) * 10 DIV 100").agg(F.max("z").alias("z"))
    return share.join(F.broadcast(line)).select(F.when(F.col("enough"), F.col("z")).alias("snowline"))


def a22_trunc_percentiles(s: SparkSession, d: str) -> DataFrame:
    """Percentiles at the truncated index (n - 1) * p, per class, with mean and greatest."""
    joined = fx.cells(s, d).join(fx.class_cells(s, d), ["r", "c"])
    ranks = ranked(joined.select("class", "z"), ["class"], ["z"])
    at = [F.max(F.when(F.col("__k") == F.floor((F.col("__n") - 1) * p / 100), F.col("z"))).alias(f"p{p}") for p in (1, 50, 90, 99)]
    return ranks.groupBy("class").agg(*at, F.round(F.avg("z"), 6).alias("mean"), F.max("z").alias("top"))


def a23_curvature(s: SparkSession, d: str) -> DataFrame:
    bent = focal.curvature(fx.cells(s, d), "z").where("bend IS NOT NULL").withColumn("boundary", (F.col("c") % 10 == 0))
    return bent.groupBy("boundary").agg(F.round(F.avg(F.abs("bend")), 6).alias("mean_bend"), F.round(F.max(F.abs("bend")), 6).alias("peak_bend"), F.count(F.lit(1)).alias("n"))


def a23_run_histogram(s: SparkSession, d: str) -> DataFrame:
    return focal.run_lengths(fx.class_cells(s, d), "class").groupBy(F.least("length", F.lit(11)).alias("length")).agg(F.count(F.lit(1)).alias("runs"))


def x09_repair_tally(s: SparkSession, d: str) -> DataFrame:
    tiles = focal.despike_once(fx.cells(s, d), "z", THRESHOLD).groupBy(F.expr("c DIV 20").alias("tile")).agg(F.count_if("replaced").alias("n"))
    return tiles.agg(F.count_if(F.expr("n > 0")).alias("tiles"), F.sum("n").alias("readings"), F.max("n").alias("worst"))


def x10_exaggeration(s: SparkSession, d: str) -> DataFrame:
    tiles = fx.cells(s, d).groupBy(F.expr("c DIV 20").alias("tile")).agg((F.max("z") - F.min("z")).alias("span"))
    return tiles.select("tile", F.round(F.when(F.col("span") > 0, (40.0 / F.col("span")) / (200.0 / 18000.0)).otherwise(1.0), 6).alias("exaggeration"))


def fn13_frame(s: SparkSession, d: str) -> DataFrame:
    bounds = fx.cells(s, d).agg(F.min("z").alias("low"), F.max("z").alias("high"))
    modes = F.explode(F.array(*(F.struct(F.lit(a).alias("datum_mode"), F.lit(b).alias("height_mode")) for a in ("area_minimum", "sea_level", "custom") for b in ("overall", "multiplier")))).alias("m")
    datum = F.when(F.col("m.datum_mode") == "area_minimum", F.col("low")).when(F.col("m.datum_mode") == "sea_level", F.least(F.lit(0.0), F.col("low"))).otherwise(F.least(F.lit(-12.5), F.col("low")))
    span = F.greatest(F.col("high") - F.col("datum"), F.lit(1.0))
    scale = F.when(F.col("height_mode") == "overall", span / 40.0).otherwise(1.0 / (2.0 * (200.0 / 18000.0)))
    framed = bounds.select("low", "high", modes).select("high", "m.datum_mode", "m.height_mode", datum.alias("datum"))
    return framed.select("datum_mode", "height_mode", "datum", F.round(scale, 6).alias("metres_per_mm"), F.round(F.when(F.col("height_mode") == "overall", span).otherwise(scale * 40.0), 6).alias("span_m"))


def fn14_normal_height(s: SparkSession, d: str) -> DataFrame:
    return fx.cells(s, d).selectExpr("r", "c", "round(greatest((z - 10D) / 490D, 0D), 6) AS height")


def j15_neighbours(s: SparkSession, d: str) -> DataFrame:
    """How many of a cell's 4 neighbours share its class."""
    return focal.matching_neighbours(fx.class_cells(s, d), "class").select("r", "c", "same")


def j16_nearest_sample(s: SparkSession, d: str) -> DataFrame:
    rows, columns = _shape(s, d)
    return sampling.nearest(fx.spots(s, d), fx.class_cells(s, d), F.round(F.col("y") * (rows - 1)).cast("long"), F.round(F.col("x") * (columns - 1)).cast("long"), "class").select("id", "class")


FLOOD_LEVEL = 52.43


def g02_flood(s: SparkSession, d: str) -> DataFrame:
    """Cells at or below the level that the border's water reaches."""
    rows, columns = _shape(s, d)
    cells = fx.cells(s, d).selectExpr("r", "c", f"z <= {FLOOD_LEVEL}D AS open", f"z <= {FLOOD_LEVEL}D AND (r = 0 OR c = 0 OR r = {rows - 1} OR c = {columns - 1}) AS seed")
    return graph.flood(cells, "open", "seed").select("r", "c")


def g01_sieve(s: SparkSession, d: str) -> DataFrame:
    return graph.sieve(fx.class_cells(s, d), "class", 4).select("r", "c", "class")


def g01_components(s: SparkSession, d: str) -> DataFrame:
    """Number of patches and size of the largest, by class."""
    sizes = graph.label_cells(fx.class_cells(s, d), "class").groupBy("class", "component").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("class").agg(F.count(F.lit(1)).alias("patches"), F.max("n").alias("largest"))


def pr22_print_material(s: SparkSession, d: str) -> DataFrame:
    """Land-cover classes take the discovered ground colour where there is one."""
    ground = fx.pixels(s, d).selectExpr("id AS cell", "IF(valid, grp, NULL) AS material")
    cells = fx.class_cells(s, d).selectExpr("r", "c", "r * 100 + c AS cell", "CASE WHEN c % 9 = 0 THEN 7 ELSE class END AS class")
    return cells.join(ground, "cell", "left").selectExpr("r", "c", "CASE WHEN class IN (0, 1, 2, 3) THEN coalesce(13 + material, class) ELSE class END AS material")


_FOLD = "CASE WHEN {0} < 0 THEN -({0}) WHEN {0} >= {1} THEN 2 * {1} - 2 - ({0}) ELSE {0} END"
_RING = f"""size AS (SELECT max(r) + 1 AS h, max(c) + 1 AS w FROM cells),
off AS (SELECT * FROM (VALUES (-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)) o(i, j)),
ring AS (SELECT a.r, a.c, a.z, list_sort(list(b.z)) AS n FROM cells a, size, off JOIN cells b ON b.r = {_FOLD.format("a.r + i", "h")} AND b.c = {_FOLD.format("a.c + j", "w")} GROUP BY a.r, a.c, a.z)"""
_RING = _RING.replace("FROM cells a, size, off JOIN cells b ON", "FROM cells a CROSS JOIN size CROSS JOIN off JOIN cells b ON")
_HIT = f"greatest(n[3] - z, z - n[6]) >= {THRESHOLD}"


def _passes(k: int) -> str:
    out, source = [], "cells"
    for i in range(k):
        ring = f"(SELECT a.r, a.c, a.z, list_sort(list(b.z)) AS n FROM {source} a CROSS JOIN size CROSS JOIN off JOIN {source} b ON b.r = {_FOLD.format('a.r + i', 'h')} AND b.c = {_FOLD.format('a.c + j', 'w')} GROUP BY a.r, a.c, a.z)"
        out.append(f"pass{i} AS MATERIALIZED (SELECT r, c, CASE WHEN {_HIT} THEN (n[4] + n[5]) / 2 ELSE z END AS z FROM {ring})")
        source = f"pass{i}"
    return "WITH size AS (SELECT max(r) + 1 AS h, max(c) + 1 AS w FROM cells), off AS (SELECT * FROM (VALUES (-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)) o(i, j)), " + ", ".join(out) + f" SELECT r, c, round(z, 6) AS z FROM {source}"


_SLOPE = """g AS (SELECT a.r, a.c, a.z, coalesce((coalesce(e.z, a.z) - coalesce(w.z, a.z)) / nullif(((e.z IS NOT NULL)::INT + (w.z IS NOT NULL)::INT) * 10.0::DOUBLE, 0), 0) AS dx,
  coalesce((coalesce(n.z, a.z) - coalesce(s.z, a.z)) / nullif(((n.z IS NOT NULL)::INT + (s.z IS NOT NULL)::INT) * 10.0::DOUBLE, 0), 0) AS dy
  FROM cells a LEFT JOIN cells e ON e.r = a.r AND e.c = a.c + 1 LEFT JOIN cells w ON w.r = a.r AND w.c = a.c - 1 LEFT JOIN cells n ON n.c = a.c AND n.r = a.r + 1 LEFT JOIN cells s ON s.c = a.c AND s.r = a.r - 1)"""
_CORNERS = """size AS (SELECT max(r) + 1 AS h, max(c) + 1 AS w FROM {0}), p AS (SELECT id, least(greatest(y * (h - 1), 0), h - 1) AS y, least(greatest(x * (w - 1), 0), w - 1) AS x, h, w FROM spots, size),
k AS (SELECT id, y - floor(y) AS ty, x - floor(x) AS tx, i, j, least(CAST(floor(y) AS BIGINT) + i, h - 1) AS r, least(CAST(floor(x) AS BIGINT) + j, w - 1) AS c FROM p, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j))"""

def _sieve(passes: int, least: int) -> str:
    """Patches by flooding from every cell, votes of the cells beside small ones, pass after pass."""
    steps = "CROSS JOIN (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) d(i, j)"
    beside = "b.r = a.r + d.i AND b.c = a.c + d.j"
    out, source = [], "class_cells"
    for i in range(passes):
        out.append(f"f{i} AS (SELECT r, c, class, r * 100 + c AS seed FROM {source} UNION SELECT b.r, b.c, b.class, a.seed FROM f{i} a {steps} JOIN {source} b ON b.class = a.class AND {beside})")
        out.append(f"l{i} AS MATERIALIZED (SELECT r, c, class, min(seed) AS label FROM f{i} GROUP BY r, c, class)")
        out.append(f"n{i} AS (SELECT label FROM l{i} GROUP BY label HAVING count(*) < {least})")
        out.append(f"v{i} AS (SELECT a.label, b.class FROM l{i} a JOIN n{i} ON n{i}.label = a.label {steps} JOIN l{i} b ON {beside} WHERE b.label <> a.label GROUP BY a.label, b.class QUALIFY row_number() OVER (PARTITION BY a.label ORDER BY count(*) DESC, b.class) = 1)")
        out.append(f"p{i} AS MATERIALIZED (SELECT r, c, coalesce(v{i}.class, l{i}.class) AS class FROM l{i} LEFT JOIN v{i} ON v{i}.label = l{i}.label)")
        source = f"p{i}"
    return "WITH " + ", ".join(out) + f" SELECT r, c, class::INT AS class FROM {source}"


QUERIES = {f.__name__: f for f in (fx00_height_frame, w01_ring, w02_spikes, w03_despike, w04_despike_fixed_point, w05_gradient, w06_slope_gates, w07_catmull, w08_bilinear, w09_class_vote, w12_native, w13_hillshade, w14_drops, w16_edge_ring, a01_bounds, a02_coverage, a03_contained_classes, a04_demotions, a17_stitch_mean, a18_shared_frame, a21_snowline, a22_trunc_percentiles, a23_curvature, a23_run_histogram, x09_repair_tally, x10_exaggeration, fn13_frame, fn14_normal_height, j15_neighbours, j16_nearest_sample, g02_flood, g01_sieve, g01_components, pr22_print_material)}
_CR = "((((-0.5 * {0} + 1.5 * {1} - 1.5 * {2} + 0.5 * {3}) * {4} + ({0} - 2.5 * {1} + 2.0 * {2} - 0.5 * {3})) * {4} + (-0.5 * {0} + 0.5 * {2})) * {4} + {1})"
ORACLES = {
    "fx00_height_frame": with_views(f"WITH {_RING}, one AS (SELECT r, c, CASE WHEN {_HIT} THEN (n[4] + n[5]) / 2 ELSE z END AS z FROM ring), b AS (SELECT min(z) AS low, max(z) AS high FROM one) SELECT r, c, round(greatest((z - low) / greatest(high - low, 1), 0), 6) AS height FROM one, b", "cells"),
    "w01_ring": with_views(f"WITH {_RING} SELECT r, c, " + ", ".join(f"n[{i + 1}] AS n{i}" for i in range(8)) + " FROM ring", "cells"),
    "w02_spikes": with_views(f"WITH {_RING} SELECT r, c FROM ring WHERE {_HIT}", "cells"),
    "w03_despike": with_views(f"WITH {_RING} SELECT r, c, round(CASE WHEN {_HIT} THEN (n[4] + n[5]) / 2 ELSE z END, 6) AS z, {_HIT} AS replaced FROM ring", "cells"),
    "w04_despike_fixed_point": with_views(_passes(5), "cells"),
    "w05_gradient": with_views(f"WITH {_SLOPE} SELECT r, c, round(dx, 5) AS dx, round(dy, 5) AS dy, round(sqrt(dx * dx + dy * dy), 5) AS slope FROM g", "cells"),
    "w06_slope_gates": with_views(f"""WITH {_SLOPE}, q AS (SELECT g.r, g.c, z, sqrt(dx * dx + dy * dy) AS slope, class FROM g JOIN class_cells k ON k.r = g.r AND k.c = g.c), n AS (SELECT z, row_number() OVER (ORDER BY z) AS k, count(*) OVER () AS n FROM q WHERE class = 2),
        f AS (SELECT *, CASE WHEN class = 1 AND slope > 4 THEN CASE WHEN z >= (SELECT max(z) FILTER (k = (n - 1) * 10 // 100 + 1 AND n * 100 >= (SELECT count(*) FROM q)) FROM n) THEN 2 ELSE 0 END ELSE class END AS k1 FROM q), t AS (SELECT *, CASE WHEN k1 = 2 AND slope > 6 THEN 0 ELSE k1 END AS k2 FROM f)
        SELECT r, c, (CASE WHEN k2 = 3 AND slope > 2 THEN 0 ELSE k2 END)::INT AS class, class = 3 AND slope > 2 AS steep_water FROM t""", "cells", "class_cells"),
    "w07_catmull": with_views("""WITH size AS (SELECT max(r) + 1 AS h, max(c) + 1 AS w FROM cells), p AS (SELECT id, y * h - 0.5 AS y, x * w - 0.5 AS x, h, w FROM spots, size),
        k AS (SELECT p.id, y - floor(y) AS ty, x - floor(x) AS tx, i, j, z FROM p CROSS JOIN (VALUES (-1), (0), (1), (2)) a(i) CROSS JOIN (VALUES (-1), (0), (1), (2)) b(j)
          JOIN cells ON r = least(greatest(CAST(floor(y) AS BIGINT) + i, 0), h - 1) AND c = least(greatest(CAST(floor(x) AS BIGINT) + j, 0), w - 1)),
        l AS (SELECT id, ty, tx, i, max(z) FILTER (j = -1) AS p0, max(z) FILTER (j = 0) AS p1, max(z) FILTER (j = 1) AS p2, max(z) FILTER (j = 2) AS p3, min(z) AS lo, max(z) AS hi FROM k GROUP BY ALL),
        m AS (SELECT id, ty, i, lo, hi, """ + _CR.format("p0", "p1", "p2", "p3", "tx") + """ AS v FROM l),
        n AS (SELECT id, ty, max(v) FILTER (i = -1) AS p0, max(v) FILTER (i = 0) AS p1, max(v) FILTER (i = 1) AS p2, max(v) FILTER (i = 2) AS p3, min(lo) AS lo, max(hi) AS hi FROM m GROUP BY ALL)
        SELECT id, round(least(greatest(""" + _CR.format("p0", "p1", "p2", "p3", "ty") + ", lo), hi), 5) AS value FROM n", "cells", "spots"),
    "w08_bilinear": with_views("WITH " + _CORNERS.format("cells") + " SELECT id, round(sum(z * (CASE WHEN i = 1 THEN ty ELSE 1 - ty END) * (CASE WHEN j = 1 THEN tx ELSE 1 - tx END)), 5) AS value FROM k JOIN cells ON cells.r = k.r AND cells.c = k.c GROUP BY id", "cells", "spots"),
    "w09_class_vote": with_views("WITH " + _CORNERS.format("class_cells") + ", v AS (SELECT id, class, round(sum((CASE WHEN i = 1 THEN ty ELSE 1 - ty END) * (CASE WHEN j = 1 THEN tx ELSE 1 - tx END)), 9) AS wt FROM k JOIN class_cells q ON q.r = k.r AND q.c = k.c GROUP BY id, class) SELECT id, class::INT AS value FROM v QUALIFY row_number() OVER (PARTITION BY id ORDER BY wt DESC, class DESC) = 1", "class_cells", "spots"),
    "w12_native": with_views("SELECT a.r, a.c, b.class::INT AS native FROM class_cells a JOIN class_cells b ON b.r = a.r // 4 * 4 AND b.c = a.c // 4 * 4", "class_cells"),
    "w13_hillshade": with_views(f"WITH {_SLOPE.replace('10.0::DOUBLE', '30.0::DOUBLE')} SELECT r, c, round(greatest((-dx * cos(radians(45)) * sin(radians(315)) - dy * cos(radians(45)) * cos(radians(315)) + sin(radians(45))) / sqrt(dx * dx + dy * dy + 1), 0), 5) AS shade FROM g", "cells"),
    "w14_drops": with_views("WITH size AS (SELECT max(r) + 1 AS h, max(c) + 1 AS w FROM cells), off AS (SELECT * FROM (VALUES (-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)) o(i, j)), ring AS (SELECT a.r, a.c, a.z, list_sort(list(b.z)) AS n FROM cells a CROSS JOIN size CROSS JOIN off JOIN cells b ON b.r = least(greatest(a.r + i, 0), h - 1) AND b.c = least(greatest(a.c + j, 0), w - 1) GROUP BY a.r, a.c, a.z) SELECT r, c, round((n[4] + n[5]) / 2 - z, 6) AS depth FROM ring WHERE (n[4] + n[5]) / 2 - z >= 20", "cells"),
    "w16_edge_ring": with_views("""WITH size AS (SELECT max(r) + 1 AS h, max(c) + 1 AS w FROM class_cells)
        SELECT * FROM (SELECT CASE WHEN r = 0 THEN c WHEN c = w - 1 THEN w - 1 + r WHEN r = h - 1 THEN w + h - 2 + (w - 1 - c) WHEN c = 0 THEN 2 * w + h - 3 + (h - 1 - r) END AS place, class::INT AS class FROM class_cells, size) WHERE place IS NOT NULL""", "class_cells"),
    "a01_bounds": with_views("SELECT min(z) AS low, max(z) AS high FROM cells", "cells"),
    "a02_coverage": with_views("SELECT k.class::INT AS class, round(count(q.class) * 100.0::DOUBLE / (SELECT count(*) FROM class_cells), 6) AS percent FROM range(0, 13) k(class) LEFT JOIN class_cells q ON q.class = k.class GROUP BY 1", "class_cells"),
    "a03_contained_classes": with_views("SELECT class::INT AS class FROM class_cells UNION SELECT (class + 4)::INT FROM areas", "class_cells", "areas"),
    "a04_demotions": with_views(f"WITH {_SLOPE}, q AS (SELECT sqrt(dx * dx + dy * dy) AS slope, class FROM g JOIN class_cells k ON k.r = g.r AND k.c = g.c) SELECT count(*) FILTER (class = 1 AND slope > 4) AS forest, count(*) FILTER (class = 2 AND slope > 6) AS snow, count(*) FILTER (class = 3 AND slope > 2) AS water, count(*) AS cells FROM q", "cells", "class_cells"),
    "a17_stitch_mean": with_views("SELECT r, c, round(avg(z), 6) AS z FROM (SELECT r, c, z FROM cells WHERE c < 51 UNION ALL SELECT r, c, z + 1 FROM cells WHERE c >= 50) GROUP BY r, c", "cells"),
    "a18_shared_frame": with_views("WITH t AS (SELECT (c // 25)::INT AS tile, min(z) AS low, max(z) AS high FROM cells GROUP BY 1) SELECT *, min(low) OVER () AS datum, max(high) OVER () AS top, low + 0.01 < min(low) OVER () AS violates FROM t", "cells"),
    "a21_snowline": with_views("WITH q AS (SELECT z, class FROM cells JOIN class_cells USING (r, c)), n AS (SELECT z, row_number() OVER (ORDER BY z) AS k, count(*) OVER () AS n FROM q WHERE class = 2) SELECT max(z) FILTER (k = (n - 1) * 10 // 100 + 1 AND n * 100 >= (SELECT count(*) FROM q)) AS snowline FROM n", "cells", "class_cells"),
    "a22_trunc_percentiles": with_views("WITH q AS (SELECT class::INT AS class, z FROM cells JOIN class_cells USING (r, c)), n AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY z) - 1 AS k, count(*) OVER (PARTITION BY class) AS n FROM q) SELECT class, " + ", ".join(f"max(z) FILTER (k = (n - 1) * {p} // 100) AS p{p}" for p in (1, 50, 90, 99)) + ", round(avg(z), 6) AS mean, max(z) AS top FROM n GROUP BY class", "cells", "class_cells"),
    "a23_curvature": with_views("SELECT a.c % 10 = 0 AS boundary, round(avg(abs(e.z - 2 * a.z + w.z)), 6) AS mean_bend, round(max(abs(e.z - 2 * a.z + w.z)), 6) AS peak_bend, count(*) AS n FROM cells a JOIN cells e ON e.r = a.r AND e.c = a.c + 1 JOIN cells w ON w.r = a.r AND w.c = a.c - 1 GROUP BY 1", "cells"),
    "a23_run_histogram": with_views("WITH g AS (SELECT r, class, c - row_number() OVER (PARTITION BY r, class ORDER BY c) AS k FROM class_cells), n AS (SELECT count(*) AS length FROM g GROUP BY r, class, k) SELECT least(length, 11) AS length, count(*) AS runs FROM n GROUP BY 1", "class_cells"),
    "x09_repair_tally": with_views(f"WITH {_RING}, t AS (SELECT c // 20 AS tile, count(*) FILTER ({_HIT}) AS n FROM ring GROUP BY 1) SELECT count(*) FILTER (n > 0) AS tiles, sum(n)::BIGINT AS readings, max(n) AS worst FROM t", "cells"),
    "x10_exaggeration": with_views("WITH t AS (SELECT c // 20 AS tile, max(z) - min(z) AS span FROM cells GROUP BY 1) SELECT tile, round(CASE WHEN span > 0 THEN (40 / span) / (200::DOUBLE / 18000) ELSE 1 END, 6) AS exaggeration FROM t", "cells"),
    "fn13_frame": with_views("""WITH b AS (SELECT min(z) AS low, max(z) AS high FROM cells), m AS (SELECT * FROM b, (VALUES ('area_minimum'), ('sea_level'), ('custom')) a(datum_mode), (VALUES ('overall'), ('multiplier')) h(height_mode)),
        f AS (SELECT *, CASE datum_mode WHEN 'area_minimum' THEN low WHEN 'sea_level' THEN least(0, low) ELSE least(-12.5, low) END::DOUBLE AS datum FROM m)
        SELECT datum_mode, height_mode, datum, round(CASE height_mode WHEN 'overall' THEN greatest(high - datum, 1) / 40 ELSE 1 / (2 * (200::DOUBLE / 18000)) END, 6) AS metres_per_mm, round(CASE height_mode WHEN 'overall' THEN greatest(high - datum, 1) ELSE 40 / (2 * (200::DOUBLE / 18000)) END, 6) AS span_m FROM f""", "cells"),
    "fn14_normal_height": with_views("SELECT r, c, round(greatest((z - 10) / 490, 0), 6) AS height FROM cells", "cells"),
    "j15_neighbours": with_views("SELECT a.r, a.c, count(b.class)::INT AS same FROM class_cells a LEFT JOIN class_cells b ON b.class = a.class AND ((b.r = a.r AND (b.c = a.c + 1 OR b.c = a.c - 1)) OR (b.c = a.c AND (b.r = a.r + 1 OR b.r = a.r - 1))) GROUP BY a.r, a.c", "class_cells"),
    "j16_nearest_sample": with_views("WITH size AS (SELECT max(r) + 1 AS h, max(c) + 1 AS w FROM class_cells) SELECT id, class::INT AS class FROM spots CROSS JOIN size JOIN class_cells ON r = CAST(round(y * (h - 1)) AS BIGINT) AND c = CAST(round(x * (w - 1)) AS BIGINT)", "class_cells", "spots"),
    "g02_flood": with_views(f"WITH size AS (SELECT max(r) AS h, max(c) AS w FROM cells), o AS (SELECT r, c FROM cells WHERE z <= {FLOOD_LEVEL}), f AS (SELECT o.r, o.c FROM o, size WHERE r = 0 OR c = 0 OR r = h OR c = w UNION SELECT o.r, o.c FROM f JOIN (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) d(i, j) ON true JOIN o ON o.r = f.r + i AND o.c = f.c + j) SELECT r, c FROM f", "cells").replace("WITH cells", "WITH RECURSIVE cells", 1),
    "g01_sieve": with_views(_sieve(2, 4), "class_cells").replace("WITH class_cells", "WITH RECURSIVE class_cells", 1),
    "g01_components": with_views("""WITH f AS (SELECT r, c, class, r * 100 + c AS seed FROM class_cells UNION SELECT b.r, b.c, b.class, f.seed FROM f JOIN class_cells b ON b.class = f.class AND ((b.r = f.r AND (b.c = f.c + 1 OR b.c = f.c - 1)) OR (b.c = f.c AND (b.r = f.r + 1 OR b.r = f.r - 1)))),
        l AS (SELECT r, c, class, min(seed) AS label FROM f GROUP BY ALL), n AS (SELECT class, label, count(*) AS n FROM l GROUP BY ALL) SELECT class::INT AS class, count(*) AS patches, max(n) AS largest FROM n GROUP BY class""", "class_cells").replace("WITH class_cells", "WITH RECURSIVE class_cells", 1),
    "pr22_print_material": with_views("SELECT r, c, (CASE WHEN k IN (0, 1, 2, 3) THEN coalesce(13 + CASE WHEN valid THEN grp END, k) ELSE k END)::BIGINT AS material FROM (SELECT r, c, CASE WHEN c % 9 = 0 THEN 7 ELSE class END AS k FROM class_cells) q LEFT JOIN pixels ON id = r * 100 + c", "class_cells", "pixels"),
}
