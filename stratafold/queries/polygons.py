"""Queries over concave areas with holes and short lines, whose number grows with the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafold.functions import geo as G
from stratafold.operators import focal, overlay, polygons, spatial
from stratafold.plans import fixtures as fx
from stratafold.plans.fixtures import with_views

#: Buckets a side: a blob or a line touches a few of them.
FINE = 64
#: Roles of the layers of lines and of the kinds of areas, and the classes they show.
LINE_ROLES = ("trail", "aerial", "rail", "ferry", "road", "aviation", "line", "line", "road")
LINE_CLASSES = (21, 22, 23, 24, 25, overlay.AVIATION, overlay.WATER, 27, 25)
AREA_ROLES = ("marker", "building", "building", "area", "area")
AREA_CLASSES = (20, 28, 29, overlay.WATER, overlay.AVIATION)


def _pick(values: tuple, at: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), F.col(at).cast("int") + 1)


def _areas(s: SparkSession, d: str) -> DataFrame:
    return fx.blob_rings(s, d).withColumnRenamed("id", "area")


def _hits(points: DataFrame, s: SparkSession, d: str, *keep: str) -> DataFrame:
    return spatial.points_in_areas(points, _areas(s, d).select("area", "shell", "holes", *keep), FINE)


def _samples(s: SparkSession, d: str) -> DataFrame:
    """Centres of the raster's cells: ``cell, x, y`` and their ground."""
    rows, columns = fx.cells(s, d).agg(F.max("r") + 1, F.max("c") + 1).first()
    slopes = focal.gradient(fx.cells(s, d), "z", 10.0).select("r", "c", "slope")
    ground = slopes.join(fx.class_cells(s, d), ["r", "c"])
    return ground.select((F.col("r") * 100 + F.col("c")).alias("cell"), ((F.col("c") + 0.5) / float(columns or 1)).alias("x"), ((F.col("r") + 0.5) / float(rows or 1)).alias("y"), F.col("class").alias("ground"), ((F.col("class") == 3) & (F.col("slope") > 2)).alias("steep"))


def _painted(s: SparkSession, d: str, roads: bool, buildings: bool) -> DataFrame:
    areas = _areas(s, d).select("shell", "holes", _pick(AREA_ROLES, "kind").alias("role"), F.col("area").alias("seq"), _pick(AREA_CLASSES, "kind").alias("class"), "height")
    lines = fx.path_parts(s, d).select("x0", "y0", "x1", "y1", "half", _pick(LINE_ROLES, "layer").alias("role"), F.col("id").alias("seq"), _pick(LINE_CLASSES, "layer").alias("class"), F.lit(0.0).alias("height"))
    return overlay.paint_shapes(_samples(s, d), areas, lines, "cell", roads, buildings)


def j06_painted(s: SparkSession, d: str) -> DataFrame:
    """What each cell of the raster shows of all areas and lines over it, and the building there."""
    return _painted(s, d, True, True)


def j06_terrain(s: SparkSession, d: str) -> DataFrame:
    """The same for the ground below roads and buildings."""
    return _painted(s, d, False, False)


def a02_painted_coverage(s: SparkSession, d: str) -> DataFrame:
    """Percent of cells by the class they show."""
    counted = _painted(s, d, True, True).groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    return counted.join(F.broadcast(total)).select("class", F.round(F.col("n") * 100.0 / F.col("total"), 6).alias("percent"))


def j03_points_in_blobs(s: SparkSession, d: str) -> DataFrame:
    return _hits(fx.spots(s, d), s, d).select("id", "area")


def j09_covered_paths(s: SparkSession, d: str) -> DataFrame:
    """Lines of which every point lies in some area, that is a duplicate of pavement drawn as areas."""
    points = fx.paths(s, d).select(F.col("id").alias("path"), F.posexplode("points").alias("i", "p")).select("path", "i", F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    held = spatial.points_in_areas(points, _areas(s, d).select("shell", "holes"), FINE, once=True).select("path", "i").distinct()
    return held.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n = 3").select("path")


def j10_owned_holes(s: SparkSession, d: str) -> DataFrame:
    """The areas whose shells contain every corner of another area's hole."""
    corners = _areas(s, d).select(F.col("area").alias("owner"), F.posexplode(F.flatten("holes")).alias("i", "p")).select("owner", "i", F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    shells = _areas(s, d).select("area", "shell", F.expr("CAST(array() AS array<array<struct<x: double, y: double>>>)").alias("holes"))
    inside = spatial.points_in_areas(corners, shells, FINE).groupBy("owner", "area").agg(F.count(F.lit(1)).alias("n"))
    return inside.where(f"n = {len(fx.HOLE)} AND owner <> area").select("owner", "area")


def j18_marker_owner(s: SparkSession, d: str) -> DataFrame:
    """The piece of a 10 by 10 puzzle of sheared cells that owns each spot: of the nominal cell and its eight neighbours the first
    in row-major order whose outline contains the spot, else the nominal cell."""
    n = 10
    spots = fx.spots(s, d).selectExpr("id", "x", "y", f"CAST(least(greatest(floor(y * {n}), 0), {n - 1}) AS INT) AS row", f"CAST(least(greatest(floor(x * {n}), 0), {n - 1}) AS INT) AS col")
    around = spots.withColumn("pr", F.explode(F.sequence(F.greatest(F.col("row") - 1, F.lit(0)), F.least(F.col("row") + 1, F.lit(n - 1))))).withColumn("pc", F.explode(F.sequence(F.greatest(F.col("col") - 1, F.lit(0)), F.least(F.col("col") + 1, F.lit(n - 1)))))
    corner = lambda i, j: F.struct(((F.col("pc") + j) / 10.0 + (F.col("pr") + i) * 0.003).alias("x"), ((F.col("pr") + i) / 10.0).alias("y"))
    outline = F.array(corner(0, 0), corner(0, 1), corner(1, 1), corner(1, 0))
    inside = around.where(G.ring_contains(outline, F.col("x"), F.col("y"))).groupBy("id").agg(F.min(F.struct("pr", "pc")).alias("own"))
    return spots.join(inside, "id", "left").select("id", F.coalesce("own.pr", "row").alias("piece_row"), F.coalesce("own.pc", "col").alias("piece_column"))


def a26_top_blob(s: SparkSession, d: str) -> DataFrame:
    """The highest area over each spot; ties to markers, then to the lower id."""
    hits = _hits(fx.spots(s, d), s, d, "kind", "height")
    return hits.groupBy("id").agg(F.max(F.struct("height", (F.col("kind") == 0).alias("marked"), (-F.col("area")).alias("order"), "area")).alias("top")).select("id", "top.area", "top.height")


def g11_blob_raster(s: SparkSession, d: str) -> DataFrame:
    """The last painted area of each covered cell of a 256 by 192 raster."""
    cells = spatial.rasterize(fx.blob_rings(s, d).select("id", "shell", "holes"), 256, 192)
    return cells.groupBy("r", "c").agg(F.max("id").alias("area"))


def x20_blob_zonal(s: SparkSession, d: str) -> DataFrame:
    """Highest and mean elevation over the cells whose centre each area covers."""
    samples = fx.cells(s, d).selectExpr("r * 100 + c AS cell", "r", "c", "z")
    rows, columns = fx.cells(s, d).agg(F.max("r") + 1, F.max("c") + 1).first()
    points = samples.select("cell", "z", ((F.col("c") + 0.5) / float(columns or 1)).alias("x"), ((F.col("r") + 0.5) / float(rows or 1)).alias("y"))
    return _hits(points, s, d).groupBy("area").agg(F.max("z").alias("top"), F.round(F.avg("z"), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


def x22_blob_boundary(s: SparkSession, d: str) -> DataFrame:
    """Distance of each covered spot from the nearest side of its area's shell."""
    hits = spatial.points_in_areas(fx.spots(s, d), _areas(s, d).select("area", "shell", "holes", F.col("shell").alias("ring")), FINE)
    n = F.size("ring")
    sides = F.transform("ring", lambda p, i: F.struct(p.alias("p"), F.element_at("ring", (i + n - 1) % n + 1).alias("q")))
    near = F.array_min(F.transform(sides, lambda e: G.segment_distance(F.col("x"), F.col("y"), e["p"]["x"], e["p"]["y"], e["q"]["x"], e["q"]["y"])))
    return hits.select("id", "area", F.round(near, 6).alias("distance"))


def g22_printable(s: SparkSession, d: str) -> DataFrame:
    """Pieces of a 10 by 10 puzzle with at least one of their 10 by 10 samples in some area."""
    samples = s.range(0, 10000).selectExpr("id AS sample", "id DIV 1000 AS piece_row", "id DIV 100 % 10 AS piece_column", "(id DIV 1000) / 10D + (id % 100 DIV 10 + 0.5) / 100 AS y", "(id DIV 100 % 10) / 10D + (id % 10 + 0.5) / 100 AS x")
    return _hits(samples, s, d).select("piece_row", "piece_column").distinct()


def x16_safe_curves(s: SparkSession, d: str) -> DataFrame:
    """Areas for which all 33 points of a curve across them lie in the area itself; the others get a flat edge."""
    t = F.col("i") / 32.0
    curve = fx.blob_rings(s, d).select(F.col("id").alias("owner"), "cx", "cy", "s", F.explode(F.sequence(F.lit(0), F.lit(32))).alias("i"))
    bulge = F.when(F.col("owner") % 2 == 0, 0.2).otherwise(-0.6)
    points = curve.select("owner", "i", (F.col("cx") + F.col("s") * 0.5 * (t * 2 - 1)).alias("x"), (F.col("cy") + F.col("s") * 0.25 + F.col("s") * bulge * 4 * t * (1 - t)).alias("y"))
    inside = _hits(points, s, d).where("owner = area").groupBy("owner").agg(F.count(F.lit(1)).alias("n"))
    return fx.blob_rings(s, d).select(F.col("id").alias("owner")).join(inside, "owner", "left").select("owner", (F.coalesce("n", F.lit(0)) == 33).alias("safe"))


def u05_booleans(s: SparkSession, d: str) -> DataFrame:
    """Areas of the union, the overlap and the difference of each square and each concave area whose boxes share a bucket."""
    squares = spatial.ring_bounds(fx.area_rings(s, d), "shell", buckets=FINE).select(F.col("id").alias("square"), "shell", "holes", "bx", "by")
    blobs = spatial.ring_bounds(_areas(s, d), "shell", buckets=FINE).select("area", F.col("shell").alias("other_shell"), F.col("holes").alias("other_holes"), "bx", "by")
    pairs = squares.join(blobs, ["bx", "by"]).dropDuplicates(["square", "area"])
    found = polygons.pair_areas(pairs.select("square", "area", "shell", "holes", "other_shell", "other_holes"), ["square", "area"])
    return found.select("square", "area", *(F.round(c, 9).alias(c) for c in ("union", "shared", "first_only")))


def g14_triangulations(s: SparkSession, d: str) -> DataFrame:
    """The area that the triangles of each concave area with its holes cover."""
    made = polygons.triangulations(_areas(s, d).select("area", "shell", "holes"), ["area"])
    return made.toDF("id", "triangles", "covered").select("id", F.round("covered", 9).alias("covered"), (F.col("triangles") > 2).alias("several"))


def g12_ribbons(s: SparkSession, d: str) -> DataFrame:
    """Area of each line as a ribbon in the unit square, cut back at the buildings that it meets."""
    lines = fx.paths(s, d).select("id", "points", "half")
    return polygons.ribbons(lines, "id", _areas(s, d).where("kind IN (1, 2)"), spatial.BUCKETS).select("id", F.round("area", 9).alias("area"))


_CROSS = "(e.ay > p.y) <> (e.by_ > p.y) AND p.x < (e.bx - e.ax) * (p.y - e.ay) / (e.by_ - e.ay) + e.ax"


def _hits_sql(points: str, keys: str, holes: bool = True) -> str:
    """Pairs of points and the areas that cover them."""
    named = ", ".join(f"p.{k}" for k in keys.split(", "))
    free = f" AND count(*) FILTER (ring = 1 AND {_CROSS}) % 2 = 0" if holes else ""
    return f"SELECT {named}, b.id AS area, any_value(b.kind) AS kind, any_value(b.height) AS height FROM {points} p JOIN blobs b ON p.x BETWEEN b.cx - b.s AND b.cx + b.s AND p.y BETWEEN b.cy - b.s AND b.cy + b.s JOIN blob_edges e ON e.id = b.id GROUP BY {named}, b.id HAVING count(*) FILTER (ring = 0 AND {_CROSS}) % 2 = 1{free}"


def _near(x: str, y: str, x0: str, y0: str, x1: str, y1: str) -> str:
    dx, dy = f"({x1} - {x0})", f"({y1} - {y0})"
    t = f"(CASE WHEN {dx} * {dx} + {dy} * {dy} > 0 THEN least(greatest((({x} - {x0}) * {dx} + ({y} - {y0}) * {dy}) / ({dx} * {dx} + {dy} * {dy}), 0), 1) ELSE 0 END)"
    return f"sqrt(({x} - ({x0} + {t} * {dx})) ^ 2 + ({y} - ({y0} + {t} * {dy})) ^ 2)"


def _values(values: tuple, at: str) -> str:
    return f"CASE {at} " + " ".join(f"WHEN {i} THEN {v!r}" for i, v in enumerate(values)) + " END"


_GRADE = "(coalesce({0}.z, a.z) - coalesce({1}.z, a.z)) / nullif((({0}.z IS NOT NULL)::INT + ({1}.z IS NOT NULL)::INT) * 10.0::DOUBLE, 0)"
_GROUND = f"""size AS (SELECT max(r) + 1 AS h, max(c) + 1 AS w FROM cells),
slopes AS (SELECT a.r, a.c, sqrt(coalesce({_GRADE.format("e", "w")}, 0) ^ 2 + coalesce({_GRADE.format("n", "s")}, 0) ^ 2) AS slope FROM cells a LEFT JOIN cells e ON e.r = a.r AND e.c = a.c + 1 LEFT JOIN cells w ON w.r = a.r AND w.c = a.c - 1 LEFT JOIN cells n ON n.c = a.c AND n.r = a.r + 1 LEFT JOIN cells s ON s.c = a.c AND s.r = a.r - 1),
samples AS (SELECT k.r * 100 + k.c AS cell, (k.c + 0.5) / w AS x, (k.r + 0.5) / h AS y, k.class::INT AS ground, k.class = 3 AND slope > 2 AS steep FROM class_cells k JOIN slopes USING (r, c), size)"""


def _painted_sql(roads: bool, buildings: bool) -> str:
    ranks = "CASE role " + " ".join(f"WHEN '{r}' THEN {i}" for i, r in enumerate(overlay.ROLES)) + " END"
    hidden = []
    if not roads:
        hidden.append(f"role IN {overlay.ROLES[2:8]!r} OR (role = 'area' AND class = {overlay.AVIATION})")
    if not buildings:
        hidden.append("role = 'building'")
    return with_views(f"""WITH {_GROUND},
        hits AS ({_hits_sql("samples", "cell")}),
        near AS (SELECT p.cell, q.id, q.layer FROM samples p JOIN path_parts q ON p.x BETWEEN least(q.x0, q.x1) - 0.003 AND greatest(q.x0, q.x1) + 0.003 AND p.y BETWEEN least(q.y0, q.y1) - 0.003 AND greatest(q.y0, q.y1) + 0.003 WHERE {_near("p.x", "p.y", "q.x0", "q.y0", "q.x1", "q.y1")} <= q.half),
        cand AS (SELECT cell, {_values(AREA_ROLES, "kind")} AS role, area AS seq, {_values(AREA_CLASSES, "kind")} AS class, height FROM hits UNION ALL SELECT cell, {_values(LINE_ROLES, "layer")}, id, {_values(LINE_CLASSES, "layer")}, 0 FROM near),
        cells_of AS (SELECT cell, bool_or(role = 'aviation' OR (role = 'area' AND class = {overlay.AVIATION})) AS paved, max(height) FILTER (role = 'building') AS tall FROM cand GROUP BY cell),
        kept AS (SELECT c.*, {ranks} AS rank FROM cand c JOIN samples USING (cell) JOIN cells_of USING (cell) WHERE NOT ({" OR ".join(hidden) or "false"}) AND NOT (role = 'area' AND class = {overlay.WATER} AND (steep OR paved))),
        top AS (SELECT cell, class FROM kept QUALIFY row_number() OVER (PARTITION BY cell ORDER BY rank, CASE WHEN role = 'building' THEN -height ELSE 0 END, seq DESC) = 1)
        SELECT s.cell, coalesce(top.class, CASE WHEN ground = {overlay.WATER} AND coalesce(paved, false) THEN {overlay.ROCK} ELSE ground END)::INT AS class, coalesce(tall, 0)::DOUBLE AS height FROM samples s LEFT JOIN cells_of USING (cell) LEFT JOIN top USING (cell)""", "cells", "class_cells", "blob_edges", "path_parts")


QUERIES = {f.__name__: f for f in (j06_painted, j06_terrain, a02_painted_coverage, j03_points_in_blobs, j09_covered_paths, j10_owned_holes, j18_marker_owner, a26_top_blob, g11_blob_raster, x20_blob_zonal, x22_blob_boundary, g22_printable, x16_safe_curves, u05_booleans, g14_triangulations, g12_ribbons)}
_SHEAR = [(0, 0), (0, 1), (1, 1), (1, 0)]
_SIDES = ", ".join(f"({i}, {j}, {_SHEAR[k - 1][0]}, {_SHEAR[k - 1][1]})" for k, (i, j) in enumerate(_SHEAR))
ORACLES = {
    "j06_painted": _painted_sql(True, True),
    "j06_terrain": _painted_sql(False, False),
    "a02_painted_coverage": f"WITH painted AS ({_painted_sql(True, True)}) SELECT class, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM painted), 6) AS percent FROM painted GROUP BY class",
    "j03_points_in_blobs": with_views(f"SELECT id, area FROM ({_hits_sql('spots', 'id')})", "spots", "blob_edges"),
    "j09_covered_paths": with_views(f"WITH turns AS (SELECT id AS path, 0 AS i, x0 AS x, y0 AS y FROM paths UNION ALL SELECT id, 1, x1, y1 FROM paths UNION ALL SELECT id, 2, x2, y2 FROM paths) SELECT path FROM (SELECT DISTINCT path, i FROM ({_hits_sql('turns', 'path, i')})) GROUP BY path HAVING count(*) = 3", "paths", "blob_edges"),
    "j10_owned_holes": with_views(f"WITH corners AS (SELECT id AS owner, ax AS x, ay AS y FROM blob_edges WHERE ring = 1) SELECT owner, area FROM ({_hits_sql('corners', 'owner, x, y', holes=False)}) WHERE owner <> area GROUP BY owner, area HAVING count(*) = {len(fx.HOLE)}", "blob_edges"),
    "j18_marker_owner": with_views(f"""WITH p AS (SELECT id, x, y, least(floor(y * 10), 9)::INT AS row, least(floor(x * 10), 9)::INT AS col FROM spots),
        a AS (SELECT p.*, pr, pc FROM p, range(10) r(pr), range(10) c(pc) WHERE abs(pr - row) <= 1 AND abs(pc - col) <= 1),
        e AS (SELECT a.*, (pc + j0) / 10 + (pr + i0) * 0.003::DOUBLE AS ax, (pr + i0) / 10 AS ay, (pc + j1) / 10 + (pr + i1) * 0.003::DOUBLE AS bx, (pr + i1) / 10 AS by_ FROM a, (VALUES {_SIDES}) v(i0, j0, i1, j1)),
        o AS (SELECT id, pr, pc FROM e GROUP BY id, pr, pc HAVING count(*) FILTER ((ay > y) <> (by_ > y) AND x < (bx - ax) * (y - ay) / (by_ - ay) + ax) % 2 = 1 QUALIFY row_number() OVER (PARTITION BY id ORDER BY pr, pc) = 1)
        SELECT p.id, coalesce(pr, row)::INT AS piece_row, coalesce(pc, col)::INT AS piece_column FROM p LEFT JOIN o ON o.id = p.id""", "spots"),
    "a26_top_blob": with_views(f"SELECT id, area, height FROM ({_hits_sql('spots', 'id')}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY height DESC, kind = 0 DESC, area) = 1", "spots", "blob_edges"),
    "g11_blob_raster": with_views(f"WITH points AS (SELECT r, c, (c + 0.5) / 256 AS x, (r + 0.5) / 192 AS y FROM range(192) a(r), range(256) b(c)) SELECT r, c, max(area) AS area FROM ({_hits_sql('points', 'r, c')}) GROUP BY r, c", "blob_edges"),
    "x20_blob_zonal": with_views(f"WITH points AS (SELECT r * 100 + c AS cell, z, (c + 0.5) / (SELECT max(c) + 1 FROM cells) AS x, (r + 0.5) / (SELECT max(r) + 1 FROM cells) AS y FROM cells) SELECT area, max(z) AS top, round(avg(z), 6) AS mean, count(*) AS n FROM ({_hits_sql('points', 'cell, z')}) GROUP BY area", "cells", "blob_edges"),
    "x22_blob_boundary": with_views(f"WITH hits AS ({_hits_sql('spots', 'id, x, y')}) SELECT h.id, h.area, round(min({_near('h.x', 'h.y', 'e.ax', 'e.ay', 'e.bx', 'e.by_')}), 6) AS distance FROM hits h JOIN blob_edges e ON e.id = h.area AND ring = 0 GROUP BY h.id, h.area", "spots", "blob_edges"),
    "g14_triangulations": with_views("SELECT id, round(abs(sum(CASE WHEN ring = 0 THEN bx * ay - ax * by_ ELSE 0 END)) / 2 - abs(sum(CASE WHEN ring = 1 THEN bx * ay - ax * by_ ELSE 0 END)) / 2, 9) AS covered, true AS several FROM blob_edges GROUP BY id", "blob_edges"),
    "g22_printable": with_views(f"WITH grid AS (SELECT i // 1000 AS piece_row, i // 100 % 10 AS piece_column, i // 1000 / 10 + (i % 100 // 10 + 0.5) / 100 AS y, i // 100 % 10 / 10 + (i % 10 + 0.5) / 100 AS x FROM range(10000) t(i)) SELECT DISTINCT piece_row, piece_column FROM ({_hits_sql('grid', 'piece_row, piece_column, x, y')})", "blob_edges"),
    "x16_safe_curves": with_views(f"WITH points AS (SELECT id AS owner, i, cx + s * 0.5 * (i / 32 * 2 - 1) AS x, cy + s * 0.25 + s * CASE WHEN id % 2 = 0 THEN 0.2 ELSE -0.6 END::DOUBLE * 4 * (i / 32) * (1 - i / 32) AS y FROM blobs, range(33) t(i)), n AS (SELECT owner, count(*) AS n FROM ({_hits_sql('points', 'owner, i, x, y')}) WHERE owner = area GROUP BY owner) SELECT id AS owner, coalesce(n = 33, false) AS safe FROM blobs LEFT JOIN n ON n.owner = blobs.id", "blob_edges"),
}
