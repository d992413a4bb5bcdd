"""Queries of spatial joins, lines, overlays and meshes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratafold.functions import geo as G
from stratafold.operators import mesh, spatial
from stratafold.plans import fixtures as fx
from stratafold.plans.fixtures import with_views
from stratafold.session import shuffle_partitions


def j01_tile_join(s: SparkSession, d: str) -> DataFrame:
    """Stations and points of one map tile."""
    tile = lambda df: df.withColumns({"x": G.tile_x(F.col("lon"), 4), "y": G.tile_y(F.col("lat"), 4)})
    return tile(fx.points(s, d)).select("id", "x", "y").join(tile(fx.stations(s, d)).select(F.col("id").alias("station"), "x", "y"), ["x", "y"]).select("id", "station")


def j02_pyramid_fallback(s: SparkSession, d: str) -> DataFrame:
    """The deepest pyramid tile above each point's tile at zoom 8 that exists."""
    spread = fx.points(s, d).select("id", G.tile_x(F.col("lon"), 8).alias("x8"), G.tile_y(F.col("lat"), 8).alias("y8"), F.explode(F.sequence(F.lit(4), F.lit(8))).alias("z"))
    asked = spread.selectExpr("id", "z", "shiftright(x8, 8 - z) AS x", "shiftright(y8, 8 - z) AS y")
    tiles = asked.select("z", "x", "y").distinct().where("z = 4 OR (x * 31 + y * 17 + z) % 3 <> 0")
    return asked.join(tiles, ["z", "x", "y"]).groupBy("id").agg(F.max(F.struct("z", "x", "y")).alias("t")).select("id", "t.z", "t.x", "t.y")


def j03_point_in_polygon(s: SparkSession, d: str) -> DataFrame:
    return spatial.points_in_areas(fx.spots(s, d), fx.area_rings(s, d).withColumnRenamed("id", "area")).select("id", "area")


def j05_within_distance(s: SparkSession, d: str) -> DataFrame:
    parts = spatial.segments(fx.line_pts(s, d), "line", "seq")
    # As many partitions as a shuffle has, filled up so that the cores end together, in two bands.
    cores = s.sparkContext.defaultParallelism
    splits = -(-(-(-shuffle_partitions(s) // cores) * cores) // 2)
    return spatial.pairs_near_segments(fx.spots(s, d), parts, 0.001, 6, 2, splits).select("id", "line", "seg", "distance")


def j06_overlay_priority(s: SparkSession, d: str) -> DataFrame:
    """Per spot: a building, else the last painted other area, else the ground class."""
    spots = fx.spots(s, d)
    hits = spatial.points_in_areas(spots, fx.area_rings(s, d).withColumnRenamed("id", "seq"))
    areas = hits.select("id", F.when(F.col("class") == 3, 0).otherwise(1).alias("layer"), "seq", "class")
    ground = spots.select("id", F.lit(9).alias("layer"), F.lit(0).cast("long").alias("seq"), (F.col("id") % 4 + 10).alias("class"))
    return spatial.first_layer(areas.unionByName(ground), "id")


def j07_member_anti(s: SparkSession, d: str) -> DataFrame:
    """Elements that no relation has as a member."""
    rows = fx.read(s, d, "overpass_ways")
    members = rows.select(F.explode("members").alias("m")).select(F.col("m.member_ref").alias("id"))
    return rows.where("id <> 0").select("id").distinct().join(members, "id", "left_anti")


def j08_member_height(s: SparkSession, d: str) -> DataFrame:
    """Each relation's height: its own, else the greatest of its members but inner ones."""
    from stratafold.functions import tags as T

    rows = fx.read(s, d, "overpass_ways")
    heights = rows.where("id <> 0").select("id", T.explicit_height_m(F.col("tags")).alias("h")).groupBy("id").agg(F.max("h").alias("member_h"))
    relations = rows.where("size(members) > 0").select("delivery_id", T.explicit_height_m(F.col("tags")).alias("own"), F.explode("members").alias("m"))
    outer = relations.select("delivery_id", "own", F.when(F.coalesce(F.col("m.member_role"), F.lit("")) != "inner", F.col("m.member_ref")).alias("id"))
    return outer.join(heights, "id", "left").groupBy("delivery_id").agg(F.round(F.coalesce(F.max("own"), F.max("member_h"), F.lit(8.0)), 6).alias("height_m"))


def j09_covered_lines(s: SparkSession, d: str) -> DataFrame:
    """Lines with a point outside every area (those wholly covered are dropped)."""
    points = fx.line_pts(s, d)
    inside = spatial.points_in_areas(points, fx.area_rings(s, d).select("shell", "holes")).groupBy("line").agg(F.countDistinct("seq").alias("covered"))
    counted = points.groupBy("line").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(inside, "line", "left").where("coalesce(covered, 0) < n").select("line", "n", F.coalesce("covered", F.lit(0)).alias("covered"))


def j10_ring_containment(s: SparkSession, d: str) -> DataFrame:
    """Areas whose centre lies in another area's shell, grown fourfold."""
    inner = fx.areas(s, d).selectExpr("id AS hole", "cx AS x", "cy AS y")
    shells = fx.areas(s, d).selectExpr("id AS shell_id", "array(named_struct('x', cx - 3.7D * h, 'y', cy - 3.7D * h), named_struct('x', cx + 3.7D * h, 'y', cy - 3.7D * h), named_struct('x', cx + 3.7D * h, 'y', cy + 3.7D * h), named_struct('x', cx - 3.7D * h, 'y', cy + 3.7D * h)) AS shell", "CAST(array() AS array<array<struct<x: double, y: double>>>) AS holes")
    return spatial.points_in_areas(inner, shells).where("hole <> shell_id").select("hole", "shell_id")


def j11_nearest(s: SparkSession, d: str) -> DataFrame:
    sites = fx.stations(s, d).selectExpr("id AS site", "lon AS slon", "lat AS slat")
    return spatial.nearest(fx.points(s, d), sites, "id", 1200.0, 15.0).select("id", "site", F.round("km", 4).alias("km"))


def j12_box_overlaps(s: SparkSession, d: str) -> DataFrame:
    """Pairs of areas whose doubled boxes overlap and whose heights differ by at most 10."""
    boxes = fx.areas(s, d).select("id", "height", *((F.col(c) + 2 * sign * F.col("h")).alias(n) for n, c, sign in (("w", "cx", -1), ("e", "cx", 1), ("s", "cy", -1), ("n", "cy", 1))))
    spread = spatial.by_bounds(boxes, F.col("w"), F.col("e"), F.col("s"), F.col("n"), 8)
    left, right = spread.alias("l"), spread.alias("o")
    pairs = left.join(right, (F.col("l.bx") == F.col("o.bx")) & (F.col("l.by") == F.col("o.by")) & (F.col("l.id") < F.col("o.id")) & (F.col("l.w") <= F.col("o.e")) & (F.col("o.w") <= F.col("l.e")) & (F.col("l.s") <= F.col("o.n")) & (F.col("o.s") <= F.col("l.n")) & (F.abs(F.col("l.height") - F.col("o.height")) <= 10))
    return pairs.select(F.col("l.id").alias("a"), F.col("o.id").alias("b")).distinct()


#: Segments this much further than the nearest one may have the same distance of six digits.
TIE = 1.5e-6


def j13_nearest_line(s: SparkSession, d: str) -> DataFrame:
    """The nearest line of each spot within a radius; ties to the lower line."""
    # Of segments in the same place, which have the same distances, the lowest line's counts.
    parts = spatial.segments(fx.line_pts(s, d), "line", "seq").groupBy("x0", "y0", "x1", "y1").agg(F.min("line").alias("line"))
    near = spatial.points_near_segments(fx.spots(s, d), parts, 0.002, slack=TIE).withColumn("distance", F.round("distance", 6))
    return near.groupBy("id").agg(F.min(F.struct("distance", "line")).alias("best")).select("id", "best.line", "best.distance")


def j17_edge_incidence(s: SparkSession, d: str) -> DataFrame:
    """Triangles that share an edge."""
    held = mesh.edges(fx.tris(s, d)).groupBy("u", "v").agg(F.min("tid").alias("t0"), F.max("tid").alias("t1"), F.count(F.lit(1)).alias("n"))
    return held.where("n = 2").select("t0", "t1")


def j18_piece_owner(s: SparkSession, d: str) -> DataFrame:
    """The first area, in row-major order of its centre, that covers each spot; -1 where none does."""
    hits = spatial.points_in_areas(fx.spots(s, d), fx.area_rings(s, d).withColumnRenamed("id", "area"))
    first = hits.groupBy("id").agg(F.min("area").alias("area"))
    return fx.spots(s, d).select("id").join(first, "id", "left").select("id", F.coalesce("area", F.lit(-1).cast("long")).alias("area"))


def j19_versions(s: SparkSession, d: str) -> DataFrame:
    setups = fx.read(s, d, "saved_setups").groupBy(F.col("id").alias("setup_id")).agg(F.max("export_no").alias("last_export"))
    return fx.read(s, d, "saved_setup_versions").join(setups, "setup_id").groupBy("setup_id").agg(F.max("last_export").alias("last_export"), F.count(F.lit(1)).alias("versions"))


def w15_segments(s: SparkSession, d: str) -> DataFrame:
    parts = spatial.segments(fx.line_pts(s, d), "line", "seq")
    return parts.select("line", "seg", F.round(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")), 6).alias("length"))


def a15_path_length(s: SparkSession, d: str) -> DataFrame:
    parts = spatial.segments(fx.line_pts(s, d), "line", "seq")
    return parts.groupBy("line").agg(F.round(F.sum(F.hypot((F.col("x1") - F.col("x0")) * 200, (F.col("y1") - F.col("y0")) * 150)), 4).alias("mm"))


def a16_density(s: SparkSession, d: str) -> DataFrame:
    parts = spatial.segments(fx.line_pts(s, d), "line", "seq")
    covered = F.sum(F.hypot((F.col("x1") - F.col("x0")) * 200, (F.col("y1") - F.col("y0")) * 150) * 0.002) / (200.0 * 150.0)
    return parts.agg(F.round(F.least(F.greatest(0.06 / F.greatest(covered, F.lit(0.06)), F.lit(0.35)), F.lit(1.0)), 6).alias("scale"))


def a26_top_building(s: SparkSession, d: str) -> DataFrame:
    """The highest area over each spot; ties to class 3, then to the lower id."""
    hits = spatial.points_in_areas(fx.spots(s, d), fx.area_rings(s, d).withColumnRenamed("id", "area"))
    return hits.groupBy("id").agg(F.max(F.struct("height", (F.col("class") == 3).alias("marked"), (-F.col("area")).alias("order"), "area")).alias("top")).select("id", "top.area", "top.height")


def g04_clip(s: SparkSession, d: str) -> DataFrame:
    wide = fx.line_pts(s, d).selectExpr("line", "seq", "x * 1.6 - 0.3 AS x", "y * 1.6 - 0.3 AS y")
    cut = spatial.clip_segments(spatial.segments(wide, "line", "seq"))
    return cut.select("line", "seg", *((F.round(c, 6) + 0.0).alias(c) for c in ("cx0", "cy0", "cx1", "cy1")))


def x06_visible_chains(s: SparkSession, d: str) -> DataFrame:
    """Per line the number of connected visible chains after clipping."""
    wide = fx.line_pts(s, d).selectExpr("line", "seq", "x * 1.6 - 0.3 AS x", "y * 1.6 - 0.3 AS y")
    cut = spatial.clip_segments(spatial.segments(wide, "line", "seq"))
    w = Window.partitionBy("line").orderBy("seg")
    joined = (F.lag("seg").over(w) == F.col("seg") - 1) & (F.lag("cx1").over(w) == F.col("x0")) & (F.lag("cy1").over(w) == F.col("y0")) & (F.col("cx0") == F.col("x0")) & (F.col("cy0") == F.col("y0"))
    return cut.withColumn("fresh", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1)).groupBy("line").agg(F.sum("fresh").alias("chains"))


def g11_rasterize(s: SparkSession, d: str) -> DataFrame:
    """The last painted area of each covered cell of a 128 x 96 raster."""
    cells = spatial.rasterize(fx.area_rings(s, d), 128, 96)
    return cells.groupBy("r", "c").agg(F.max("id").alias("area"))


def _zones(s: SparkSession, d: str) -> DataFrame:
    """The cells that each area covers, on the whole raster. Rasterized areas grow with it, which the planner can't see: they are not broadcast."""
    rows, columns = fx.cells(s, d).agg(F.max("r") + 1, F.max("c") + 1).first()
    return spatial.rasterize(fx.area_rings(s, d), columns or 1, rows or 1).hint("merge").join(fx.cells(s, d), ["r", "c"])


def x20_zonal_max(s: SparkSession, d: str) -> DataFrame:
    return _zones(s, d).groupBy("id").agg(F.max("z").alias("top"), F.count(F.lit(1)).alias("n"))


def x22_boundary_distance(s: SparkSession, d: str) -> DataFrame:
    """Distance of each covered spot from its area's shell."""
    hits = spatial.points_in_areas(fx.spots(s, d), fx.area_rings(s, d).select(F.col("id").alias("area"), "shell", "holes", F.col("shell").alias("ring")))
    sides = F.transform("ring", lambda p, i: F.struct(p["x"].alias("x0"), p["y"].alias("y0"), F.element_at("ring", (i + 1) % F.size("ring") + 1)["x"].alias("x1"), F.element_at("ring", (i + 1) % F.size("ring") + 1)["y"].alias("y1")))
    near = F.array_min(F.transform(sides, lambda e: G.segment_distance(F.col("x"), F.col("y"), e["x0"], e["y0"], e["x1"], e["y1"])))
    return hits.select("id", "area", F.round(near, 6).alias("distance"))


def fn20_shoelace(s: SparkSession, d: str) -> DataFrame:
    return fx.area_rings(s, d).select("id", F.round(G.ring_area2(F.col("shell")) / 2, 8).alias("area"))


def fn35_progress(s: SparkSession, d: str) -> DataFrame:
    """How far along its nearest line (as a share of the line's length) each spot's foot lies."""
    parts = spatial.segments(fx.line_pts(s, d), "line", "seq").withColumn("length", F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))
    w = Window.partitionBy("line")
    placed = parts.withColumns({"before": F.sum("length").over(w.orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)), "total": F.sum("length").over(w)})
    # Of segments in the same place, which have the same distances, the lowest line's first one counts.
    first = placed.where("length > 0").groupBy("x0", "y0", "x1", "y1").agg(F.min(F.struct("line", F.coalesce("before", F.lit(0.0)).alias("before"), "total", "length")).alias("p")).select("x0", "y0", "x1", "y1", "p.*")
    near = spatial.points_near_segments(fx.spots(s, d), first, 0.002, slack=TIE)
    t = F.least(F.greatest(((F.col("x") - F.col("x0")) * (F.col("x1") - F.col("x0")) + (F.col("y") - F.col("y0")) * (F.col("y1") - F.col("y0"))) / (F.col("length") * F.col("length")), F.lit(0.0)), F.lit(1.0))
    best = near.withColumn("progress", F.round((F.col("before") + t * F.col("length")) / F.col("total"), 5)).groupBy("id").agg(F.min(F.struct(F.round("distance", 6).alias("distance"), "line", "progress")).alias("b"))
    return best.select("id", "b.line", "b.progress")


def a09_mesh_measures(s: SparkSession, d: str) -> DataFrame:
    return mesh.measures(fx.tris(s, d), fx.verts(s, d)).select("material", "triangles", F.round("area", 3).alias("area"), F.round("volume", 2).alias("volume"))


def a10_edge_uses(s: SparkSession, d: str) -> DataFrame:
    return mesh.edge_defects(fx.tris(s, d))


def _doubled(s: SparkSession, d: str) -> DataFrame:
    """The grid mesh with some faces repeated, some of them turned over."""
    base = fx.tris(s, d)
    again = base.where("tid % 41 = 0").selectExpr("tid + 10000000 AS tid", "a", "b", "d", "material")
    turned = base.where("tid % 59 = 0").selectExpr("tid + 20000000 AS tid", "a", "d AS b", "b AS d", "material")
    return base.unionByName(again).unionByName(turned)


def a11_duplicate_faces(s: SparkSession, d: str) -> DataFrame:
    return mesh.duplicate_faces(_doubled(s, d)).select(F.col("corners")[0].alias("v0"), F.col("corners")[1].alias("v1"), F.col("corners")[2].alias("v2"), "faces", "one_way")


def a13_defect_histogram(s: SparkSession, d: str) -> DataFrame:
    """Faces on open edges by the feature their material names."""
    base = fx.tris(s, d)
    one = mesh.edges(base).groupBy("u", "v").agg(F.min("tid").alias("tid"), F.count(F.lit(1)).alias("n")).where("n = 1")
    label = F.when(F.col("material") == 0, "rock").when(F.col("material") == 1, "forest").when(F.col("material") == 2, "snow").otherwise("water")
    return one.join(base, "tid").groupBy(label.alias("feature")).agg(F.count(F.lit(1)).alias("edges"))


def a12_vertex_fans(s: SparkSession, d: str) -> DataFrame:
    """Vertices whose faces fall apart in the grid mesh with holes in a fixed pattern."""
    return mesh.vertex_fans(fx.tris(s, d).where("(tid DIV 2) % 7 <> 0 AND (tid DIV 2) % 7 <> 3"))


def fn21_normals(s: SparkSession, d: str) -> DataFrame:
    return mesh.normals(fx.tris(s, d), fx.verts(s, d)).select("tid", *(F.round(c, 5).alias(c) for c in ("nx", "ny", "nz")), F.round("area", 5).alias("area"))


def g15_weld(s: SparkSession, d: str) -> DataFrame:
    """Faces after welding vertices whose coordinates agree when halved and rounded."""
    rough = fx.verts(s, d).selectExpr("vid", "floor(x / 2) * 2D AS x", "y", "0D AS z")
    faces, _ = mesh.weld(fx.tris(s, d), rough)
    return faces.select("tid", "a", "b", "d")


def g16_vertex_builder(s: SparkSession, d: str) -> DataFrame:
    """Distinct quantised vertices with the first index of each."""
    return fx.verts(s, d).selectExpr("round(x / 3) AS qx", "round(y / 3) AS qy", "vid").groupBy("qx", "qy").agg(F.min("vid").alias("vid"))


def g23_grid_mesh(s: SparkSession, d: str) -> DataFrame:
    """Triangles, edges, vertices and Euler number of the regular grid over the raster."""
    made = mesh.grid_triangles(fx.cells(s, d), 100).withColumn("tid", F.xxhash64("a", "b", "d"))
    used = mesh.edges(made).select("u", "v").distinct().agg(F.count(F.lit(1)).alias("edges"))
    return made.agg(F.count(F.lit(1)).alias("triangles")).join(used).join(fx.cells(s, d).agg(F.count(F.lit(1)).alias("vertices"))).selectExpr("triangles", "edges", "vertices", "vertices - edges + triangles AS euler")


def x23_roof_owner(s: SparkSession, d: str) -> DataFrame:
    """Roof height over each spot: the greatest ground height under the area plus the area's height."""
    roofs = _zones(s, d).groupBy("id", "height", "class").agg(F.max("z").alias("top")).select(F.col("id").alias("area"), (F.col("top") + F.col("height")).alias("roof"), F.col("class").alias("kind"))
    hits = spatial.points_in_areas(fx.spots(s, d), fx.area_rings(s, d).select(F.col("id").alias("area"), "shell", "holes")).join(roofs, "area")
    return hits.groupBy("id").agg(F.max(F.struct(F.round("roof", 6).alias("roof"), (F.col("kind") == 3).alias("marked"), (-F.col("area")).alias("order"), "area")).alias("b")).select("id", "b.area", "b.roof")


def x25_vertex_pinning(s: SparkSession, d: str) -> DataFrame:
    """Border vertices are lowered by a fixed bleed, each once."""
    border = mesh.edges(fx.tris(s, d)).groupBy("u", "v").count().where("count = 1")
    pinned = border.select(F.explode(F.array("u", "v")).alias("vid")).distinct().withColumn("pinned", F.lit(True))
    return fx.verts(s, d).join(pinned, "vid", "left").select("vid", F.round(F.when(F.col("pinned"), F.col("z") - 0.25).otherwise(F.col("z")), 6).alias("z"))


_IN = "greatest(abs({x} - cx), abs({y} - cy)) < h AND (hole_h IS NULL OR greatest(abs({x} - cx), abs({y} - cy)) >= hole_h)"
_HITS = "hits AS (SELECT p.id, a.id AS area, a.class, a.height FROM spots p JOIN areas a ON greatest(abs(p.x - a.cx), abs(p.y - a.cy)) < a.h AND (a.hole_h IS NULL OR greatest(abs(p.x - a.cx), abs(p.y - a.cy)) >= a.hole_h))"
_SEG = "seg AS (SELECT line, row_number() OVER w - 1 AS seg, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM {0} WINDOW w AS (PARTITION BY line ORDER BY seq)), s AS (SELECT * FROM seg WHERE x1 IS NOT NULL)"
_T = "CASE WHEN (x1 - x0) ^ 2 + (y1 - y0) ^ 2 > 0 THEN least(greatest(((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / ((x1 - x0) ^ 2 + (y1 - y0) ^ 2), 0), 1) ELSE 0 END"
_NEAR = "n AS (SELECT spots.id, s.*, t, sqrt((x - x0 - t * (x1 - x0)) ^ 2 + (y - y0 - t * (y1 - y0)) ^ 2) AS dist FROM spots, s, LATERAL (SELECT " + _T + " AS t) WHERE x BETWEEN least(x0, x1) - 0.003 AND greatest(x0, x1) + 0.003 AND y BETWEEN least(y0, y1) - 0.003 AND greatest(y0, y1) + 0.003)"
_LINES = _SEG.format("line_pts")
_EDGES = "ed AS (SELECT tid, least(p, q) AS u, greatest(p, q) AS v, p < q AS f FROM (SELECT tid, a AS p, b AS q FROM {0} UNION ALL SELECT tid, b, d FROM {0} UNION ALL SELECT tid, d, a FROM {0}))"
_XYZ = "c AS (SELECT t.*, p.x AS ax, p.y AS ay, p.z AS az, q.x AS bx, q.y AS by_, q.z AS bz, r.x AS dx, r.y AS dy, r.z AS dz FROM tris t JOIN verts p ON p.vid = a JOIN verts q ON q.vid = b JOIN verts r ON r.vid = d), n AS (SELECT *, (by_ - ay) * (dz - az) - (bz - az) * (dy - ay) AS nx, (bz - az) * (dx - ax) - (bx - ax) * (dz - az) AS ny, (bx - ax) * (dy - ay) - (by_ - ay) * (dx - ax) AS nz FROM c)"
_RASTER = "ras AS (SELECT a.id, a.height, a.class, r, c FROM areas a, range({h}) y(r), range({w}) x(c) WHERE greatest(abs((c + 0.5) / {w}.0::DOUBLE - cx), abs((r + 0.5) / {h}.0::DOUBLE - cy)) < h AND (hole_h IS NULL OR greatest(abs((c + 0.5) / {w}.0::DOUBLE - cx), abs((r + 0.5) / {h}.0::DOUBLE - cy)) >= hole_h))"
#: The cells of the whole raster, whatever its shape, that each area covers.
_OFF = "greatest(abs((c + 0.5) / columns::DOUBLE - cx), abs((r + 0.5) / rows_::DOUBLE - cy))"
_ZONES = f"shape AS (SELECT max(r) + 1 AS rows_, max(c) + 1 AS columns FROM cells), ras AS (SELECT a.id, a.height, a.class, r, c, z FROM areas a, shape, cells WHERE {_OFF} < h AND (hole_h IS NULL OR {_OFF} >= hole_h))"
_WIDE = "wide AS (SELECT line, seq, x * 1.6 - 0.3 AS x, y * 1.6 - 0.3 AS y FROM line_pts)"
_CLIP = """k AS (SELECT *, x1 - x0 AS dx, y1 - y0 AS dy FROM s), t AS (SELECT *, greatest(0, CASE WHEN dx > 0 THEN -x0 / dx WHEN dx < 0 THEN (1 - x0) / dx ELSE 0 END, CASE WHEN dy > 0 THEN -y0 / dy WHEN dy < 0 THEN (1 - y0) / dy ELSE 0 END) AS t0,
 least(1, CASE WHEN dx > 0 THEN (1 - x0) / dx WHEN dx < 0 THEN -x0 / dx ELSE 1 END, CASE WHEN dy > 0 THEN (1 - y0) / dy WHEN dy < 0 THEN -y0 / dy ELSE 1 END) AS t1 FROM k WHERE (dx <> 0 OR x0 BETWEEN 0 AND 1) AND (dy <> 0 OR y0 BETWEEN 0 AND 1)),
cut AS (SELECT line, seg, x0, y0, x0 + dx * t0 AS cx0, y0 + dy * t0 AS cy0, x0 + dx * t1 AS cx1, y0 + dy * t1 AS cy1 FROM t WHERE t0 <= t1)"""

QUERIES = {f.__name__: f for f in (j01_tile_join, j02_pyramid_fallback, j03_point_in_polygon, j05_within_distance, j06_overlay_priority, j07_member_anti, j08_member_height, j09_covered_lines, j10_ring_containment, j11_nearest, j12_box_overlaps, j13_nearest_line, j17_edge_incidence, j18_piece_owner, j19_versions, w15_segments, a15_path_length, a16_density, a26_top_building, g04_clip, x06_visible_chains, g11_rasterize, x20_zonal_max, x22_boundary_distance, fn20_shoelace, fn35_progress, a09_mesh_measures, a10_edge_uses, a11_duplicate_faces, a12_vertex_fans, a13_defect_histogram, fn21_normals, g15_weld, g16_vertex_builder, g23_grid_mesh, x23_roof_owner, x25_vertex_pinning)}

_TAG_H = "CASE WHEN {0} IS NOT NULL THEN least(greatest({0}, 2.5), 200)::DOUBLE END"
_NUM = r"TRY_CAST(nullif(regexp_extract(trim(tags['{0}']), '^(\d+\.?\d*|\.\d+)(?:[^0-9.]|$)', 1), '') AS DOUBLE)"
_H = _TAG_H.format("coalesce(" + _NUM.format("height") + ", " + _NUM.format("building:levels") + " * 3)")


def _z(lon: str, z: int) -> str:
    return f"CAST(least(greatest(floor(({lon} + 180) / 360 * {float(1 << z)}::DOUBLE), 0), {(1 << z) - 1}) AS BIGINT)"


def _y(z: int) -> str:
    phi = "radians(least(greatest(lat, -85.05112878), 85.05112878))"
    return f"CAST(least(greatest(floor((1 - ln(tan({phi}) + 1 / cos({phi})) / pi()) / 2 * {float(1 << z)}::DOUBLE), 0), {(1 << z) - 1}) AS BIGINT)"


ORACLES = {
    "j01_tile_join": with_views(f"SELECT p.id, q.id AS station FROM (SELECT id, {_z('lon', 4)} AS x, {_y(4)} AS y FROM points) p JOIN (SELECT id, {_z('lon', 4)} AS x, {_y(4)} AS y FROM stations) q USING (x, y)", "points", "stations"),
    "j02_pyramid_fallback": with_views(f"WITH p AS (SELECT id, {_z('lon', 8)} AS x8, {_y(8)} AS y8 FROM points), a AS (SELECT id, z::INT AS z, x8 // (1 << (8 - z)::INT) AS x, y8 // (1 << (8 - z)::INT) AS y FROM p, range(4, 9) t(z)) SELECT id, z, x, y FROM a WHERE z = 4 OR (x * 31 + y * 17 + z) % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY z DESC) = 1", "points"),
    "j03_point_in_polygon": with_views(f"WITH {_HITS} SELECT id, area FROM hits", "spots", "areas"),
    "j05_within_distance": with_views(f"WITH {_LINES}, {_NEAR} SELECT id, line, seg::INT AS seg, round(dist, 6) AS distance FROM n WHERE dist <= 0.001", "spots", "line_pts"),
    "j06_overlay_priority": with_views(f"WITH {_HITS}, c AS (SELECT id, CASE WHEN class = 3 THEN 0 ELSE 1 END AS layer, area AS seq, class FROM hits UNION ALL SELECT id, 9, 0, id % 4 + 10 FROM spots) SELECT id, layer::INT AS layer, class FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY layer, seq DESC) = 1", "spots", "areas"),
    "j07_member_anti": "SELECT DISTINCT id FROM overpass_ways WHERE id <> 0 AND id NOT IN (SELECT m.member_ref FROM (SELECT unnest(members) AS m FROM overpass_ways) WHERE m.member_ref IS NOT NULL)",
    "j08_member_height": f"""WITH h AS (SELECT id, max({_H}) AS mh FROM overpass_ways WHERE id <> 0 GROUP BY id), r AS (SELECT delivery_id, {_H} AS own, unnest(members) AS m FROM overpass_ways),
        o AS (SELECT delivery_id, own, CASE WHEN coalesce(m.member_role, '') <> 'inner' THEN m.member_ref END AS id FROM r) SELECT delivery_id, round(coalesce(max(own), max(mh), 8), 6) AS height_m FROM o LEFT JOIN h USING (id) GROUP BY delivery_id""",
    "j09_covered_lines": with_views("WITH p AS (SELECT * FROM line_pts), k AS (SELECT line, seq, bool_or(coalesce(greatest(abs(x - cx), abs(y - cy)) < h AND (hole_h IS NULL OR greatest(abs(x - cx), abs(y - cy)) >= hole_h), false)) AS cov FROM p, areas GROUP BY line, seq) SELECT line, count(*) AS n, count(*) FILTER (cov) AS covered FROM k GROUP BY line HAVING count(*) FILTER (cov) < count(*)", "line_pts", "areas"),
    "j10_ring_containment": with_views("SELECT i.id AS hole, o.id AS shell_id FROM areas i JOIN areas o ON i.id <> o.id AND abs(i.cx - o.cx) < 3.7::DOUBLE * o.h AND abs(i.cy - o.cy) < 3.7::DOUBLE * o.h", "areas"),
    "j11_nearest": with_views("WITH k AS (SELECT p.id, q.id AS site, sqrt((((q.lon - p.lon) + 180 - 360 * floor(((q.lon - p.lon) + 180) / 360) - 180) * greatest(111.32 * abs(cos(radians(p.lat))), 20)) ^ 2 + ((q.lat - p.lat) * 110.574) ^ 2) AS km FROM points p, stations q) SELECT id, site, round(km, 4) AS km FROM k WHERE km <= 1200 QUALIFY row_number() OVER (PARTITION BY id ORDER BY km, site) = 1", "points", "stations"),
    "j12_box_overlaps": with_views("SELECT a.id AS a, b.id AS b FROM areas a JOIN areas b ON a.id < b.id AND abs(a.cx - b.cx) <= 2 * (a.h + b.h) AND abs(a.cy - b.cy) <= 2 * (a.h + b.h) AND abs(a.height - b.height) <= 10", "areas"),
    "j13_nearest_line": with_views(f"WITH {_LINES}, {_NEAR}, b AS (SELECT id, line, round(dist, 6) AS distance FROM n WHERE dist <= 0.002) SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance, line) = 1", "spots", "line_pts"),
    "j17_edge_incidence": with_views(f"WITH {_EDGES.format('tris')} SELECT x.tid AS t0, y.tid AS t1 FROM ed x JOIN ed y ON x.u = y.u AND x.v = y.v AND x.tid < y.tid", "tris"),
    "j18_piece_owner": with_views(f"WITH {_HITS} SELECT p.id, coalesce(min(area), -1) AS area FROM spots p LEFT JOIN hits ON hits.id = p.id GROUP BY p.id", "spots", "areas"),
    "j19_versions": "SELECT v.setup_id, max(s.export_no) AS last_export, count(DISTINCT v.rid) AS versions FROM (SELECT *, row_number() OVER () AS rid FROM saved_setup_versions) v JOIN saved_setups s ON s.id = v.setup_id GROUP BY 1",
    "w15_segments": with_views(f"WITH {_SEG.format('line_pts')} SELECT line, seg::INT AS seg, round(sqrt((x1 - x0) ^ 2 + (y1 - y0) ^ 2), 6) AS length FROM s", "line_pts"),
    "a15_path_length": with_views(f"WITH {_SEG.format('line_pts')} SELECT line, round(sum(sqrt(((x1 - x0) * 200) ^ 2 + ((y1 - y0) * 150) ^ 2)), 4) AS mm FROM s GROUP BY line", "line_pts"),
    "a16_density": with_views(f"WITH {_SEG.format('line_pts')} SELECT round(least(greatest(0.06 / greatest(sum(sqrt(((x1 - x0) * 200) ^ 2 + ((y1 - y0) * 150) ^ 2) * 0.002) / 30000, 0.06), 0.35), 1), 6) AS scale FROM s", "line_pts"),
    "a26_top_building": with_views(f"WITH {_HITS} SELECT id, area, height FROM hits QUALIFY row_number() OVER (PARTITION BY id ORDER BY height DESC, (class = 3) DESC, area) = 1", "spots", "areas"),
    "g04_clip": with_views(f"WITH {_WIDE}, {_SEG.format('wide')}, {_CLIP} SELECT line, seg::INT AS seg, round(cx0, 6) + 0.0::DOUBLE AS cx0, round(cy0, 6) + 0.0::DOUBLE AS cy0, round(cx1, 6) + 0.0::DOUBLE AS cx1, round(cy1, 6) + 0.0::DOUBLE AS cy1 FROM cut", "line_pts"),
    "x06_visible_chains": with_views(f"WITH {_WIDE}, {_SEG.format('wide')}, {_CLIP} SELECT line, count(*) FILTER (NOT coalesce(joined, false)) AS chains FROM (SELECT line, lag(seg) OVER w = seg - 1 AND lag(cx1) OVER w = x0 AND lag(cy1) OVER w = y0 AND cx0 = x0 AND cy0 = y0 AS joined FROM cut WINDOW w AS (PARTITION BY line ORDER BY seg)) GROUP BY line", "line_pts"),
    "g11_rasterize": with_views("WITH " + _RASTER.format(w=128, h=96) + " SELECT r, c, max(id) AS area FROM ras GROUP BY r, c", "areas"),
    "a12_vertex_fans": with_views("""WITH t AS (SELECT tid, a, b, d FROM tris WHERE (tid // 2) % 7 <> 0 AND (tid // 2) % 7 <> 3), sides AS (SELECT tid, unnest([a, a, b, b, d, d]) AS vid, unnest([b, d, a, d, a, b]) AS other FROM t),
        pairs AS (SELECT DISTINCT p.vid, p.tid AS f, q.tid AS g FROM sides p JOIN sides q ON q.vid = p.vid AND q.other = p.other), reach AS (SELECT DISTINCT vid, tid AS f, tid AS seed FROM sides UNION SELECT r.vid, p.g, r.seed FROM reach r JOIN pairs p ON p.vid = r.vid AND p.f = r.f),
        own AS (SELECT vid, f, min(seed) AS label FROM reach GROUP BY vid, f) SELECT vid, count(DISTINCT label) AS fans FROM own GROUP BY vid HAVING count(DISTINCT label) > 1""", "tris").replace("WITH ", "WITH RECURSIVE ", 1),
    "x20_zonal_max": with_views("WITH " + _ZONES + " SELECT id, max(z) AS top, count(*) AS n FROM ras GROUP BY id", "areas", "cells"),
    "x22_boundary_distance": with_views("SELECT p.id, a.id AS area, round(h - greatest(abs(x - cx), abs(y - cy)), 6) AS distance FROM spots p JOIN areas a ON greatest(abs(p.x - a.cx), abs(p.y - a.cy)) < a.h AND (a.hole_h IS NULL OR greatest(abs(p.x - a.cx), abs(p.y - a.cy)) >= a.hole_h)", "spots", "areas"),
    "fn20_shoelace": with_views("SELECT id, round(4 * h * h, 8) AS area FROM areas", "areas"),
    "fn35_progress": with_views(f"WITH {_LINES}, l AS (SELECT *, sqrt((x1 - x0) ^ 2 + (y1 - y0) ^ 2) AS len FROM s), m AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY line ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(len) OVER (PARTITION BY line) AS total FROM l), {_NEAR.replace('s.*', 'm.*').replace(', s,', ', m,')}, b AS (SELECT id, round(dist, 6) AS dist, line, round((before + t * len) / total, 5) AS progress FROM n WHERE dist <= 0.002 AND len > 0) SELECT id, line, progress FROM b QUALIFY row_number() OVER (PARTITION BY id ORDER BY dist, line, progress) = 1", "spots", "line_pts"),
    "a09_mesh_measures": with_views(f"WITH {_XYZ} SELECT material::INT AS material, count(*) AS triangles, round(sum(sqrt(nx * nx + ny * ny + nz * nz) / 2), 3) AS area, round(sum((ax * (by_ * dz - bz * dy) + ay * (bz * dx - bx * dz) + az * (bx * dy - by_ * dx)) / 6), 2) AS volume FROM n GROUP BY 1", "tris", "verts"),
    "a10_edge_uses": with_views(f"WITH {_EDGES.format('tris')}, k AS (SELECT u, v, count(*) AS n, count(*) FILTER (f) AS f FROM ed GROUP BY u, v) SELECT count(*) AS edges, count(*) FILTER (n = 1) AS open, count(*) FILTER (n > 2) AS overused, count(*) FILTER (f > 1 OR n - f > 1) AS misoriented FROM k", "tris"),
    "a11_duplicate_faces": with_views("""WITH t AS (SELECT a, b, d FROM tris UNION ALL SELECT a, b, d FROM tris WHERE tid % 41 = 0 UNION ALL SELECT a, d, b FROM tris WHERE tid % 59 = 0), k AS (SELECT list_sort([a, b, d]) AS c, CASE WHEN a <= b AND a <= d THEN b < d WHEN b <= a AND b <= d THEN d < a ELSE a < b END AS w FROM t)
        SELECT c[1] AS v0, c[2] AS v1, c[3] AS v2, count(*) AS faces, count(*) FILTER (w) AS one_way FROM k GROUP BY c HAVING count(*) > 1""", "tris"),
    "a13_defect_histogram": with_views(f"WITH {_EDGES.format('tris')}, o AS (SELECT min(tid) AS tid FROM ed GROUP BY u, v HAVING count(*) = 1) SELECT CASE material WHEN 0 THEN 'rock' WHEN 1 THEN 'forest' WHEN 2 THEN 'snow' ELSE 'water' END AS feature, count(*) AS edges FROM o JOIN tris USING (tid) GROUP BY 1", "tris"),
    "fn21_normals": with_views(f"WITH {_XYZ} SELECT tid, round(nx / sqrt(nx * nx + ny * ny + nz * nz), 5) AS nx, round(ny / sqrt(nx * nx + ny * ny + nz * nz), 5) AS ny, round(nz / sqrt(nx * nx + ny * ny + nz * nz), 5) AS nz, round(sqrt(nx * nx + ny * ny + nz * nz) / 2, 5) AS area FROM n", "tris", "verts"),
    "g15_weld": with_views("""WITH m AS (SELECT vid, min(vid) OVER (PARTITION BY floor(x / 2) * 2, y) AS k FROM verts), t AS (SELECT tid, p.k AS a, q.k AS b, r.k AS d FROM tris JOIN m p ON p.vid = a JOIN m q ON q.vid = b JOIN m r ON r.vid = d), w AS (SELECT * FROM t WHERE a <> b AND b <> d AND d <> a),
        c AS (SELECT *, CASE WHEN a <= b AND a <= d THEN [a, b, d] WHEN b <= a AND b <= d THEN [b, d, a] ELSE [d, a, b] END AS turn FROM w) SELECT tid, a, b, d FROM c QUALIFY row_number() OVER (PARTITION BY turn ORDER BY tid) = 1""", "tris", "verts"),
    "g16_vertex_builder": with_views("SELECT round(x / 3) AS qx, round(y / 3) AS qy, min(vid) AS vid FROM verts GROUP BY 1, 2", "verts"),
    "g23_grid_mesh": with_views("WITH s AS (SELECT max(r) + 1 AS h, max(c) + 1 AS w FROM cells) SELECT 2 * (h - 1) * (w - 1) AS triangles, h * (w - 1) + w * (h - 1) + (h - 1) * (w - 1) AS edges, h * w AS vertices, 1::BIGINT AS euler FROM s", "cells"),
    "x23_roof_owner": with_views("WITH " + _ZONES + f", {_HITS}, f AS (SELECT id AS area, max(z) + max(height) AS roof FROM ras GROUP BY id) SELECT id, area, round(roof, 6) AS roof FROM hits JOIN f USING (area) QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(roof, 6) DESC, (class = 3) DESC, area) = 1", "spots", "areas", "cells"),
    "x25_vertex_pinning": with_views(f"WITH {_EDGES.format('tris')}, o AS (SELECT u, v FROM ed GROUP BY u, v HAVING count(*) = 1) SELECT vid, round(CASE WHEN vid IN (SELECT u FROM o UNION SELECT v FROM o) THEN z - 0.25 ELSE z END, 6) AS z FROM verts", "tris", "verts"),
}
