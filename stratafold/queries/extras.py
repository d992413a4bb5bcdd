"""Queries of the smaller pipelines: sources as tables, outlines, kriging, coasts and puzzle grids."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratafold.functions import geo as G
from stratafold.functions import hashing
from stratafold.functions import tags as T
from stratafold.operators import kriging, outlines, selecting, spatial
from stratafold.plans import fixtures as fx
from stratafold.plans.fixtures import with_views


def s08_tile_gaps(s: SparkSession, d: str) -> DataFrame:
    """Tiles that elements were delivered for and no usable response is cached for."""
    wanted = fx.read(s, d, "overpass_ways").select("tile_key").distinct()
    held = fx.read(s, d, "overpass_responses").where("body_json IS NOT NULL").select("tile_key")
    return wanted.where("tile_key IS NOT NULL").join(held, "tile_key", "left_anti")


def s11_pushed_filter(s: SparkSession, d: str) -> DataFrame:
    """Rails in service in a box, by tag pattern and first point."""
    kind, first = T.tag(F.col("tags"), "railway"), F.try_element_at("geometry", F.lit(1))
    return fx.ways(s, d).where(kind.rlike("^(rail|tram|narrow_gauge)$") & first["lat"].between(-45, 55) & first["lon"].between(-120, 140)).select("id", kind.alias("kind"))


def s12_places(s: SparkSession, d: str) -> DataFrame:
    """The places of each cached answer."""
    rows = fx.read(s, d, "place_search_cache").select("cache_id", F.posexplode(F.from_json("response_json", "array<struct<display_name: string, latitude: double, longitude: double, kind: string>>")).alias("pos", "p"))
    return rows.select("cache_id", "pos", F.col("p.display_name").alias("name"), F.col("p.latitude").alias("lat"), F.col("p.longitude").alias("lon"))


def s16_artifacts(s: SparkSession, d: str) -> DataFrame:
    """Files and bytes of complete jobs by kind of file."""
    rows = fx.read(s, d, "jobs").where("status = 'complete'").select("id", "artifacts_json").distinct()
    files = rows.select("id", F.explode(F.from_json("artifacts_json", "array<struct<name: string, bytes: bigint>>")).alias("f"))
    return files.groupBy(F.regexp_extract("f.name", r"\.([a-z0-9]+)$", 1).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum("f.bytes").alias("bytes"))


def s19_synthetic(s: SparkSession, d: str) -> DataFrame:
    grid = s.range(0, 64 * 64).selectExpr("id DIV 64 AS r", "id % 64 AS c").selectExpr("r", "c", "c / 63D AS u", "r / 63D AS v")
    return grid.selectExpr("r", "c", "round(1200 + 900 * sin(4 * pi() * u) + 650 * cos(3 * pi() * v) + 300 * sin(6 * pi() * (u + v)), 4) AS z")


def pr13_box_intersect(s: SparkSession, d: str) -> DataFrame:
    """Lines that really meet a box: a point inside, or a segment through it."""
    parts = spatial.segments(fx.line_pts(s, d), "line", "seq").selectExpr("line", "seg", *(f"({c} - 0.4503D) * 10 AS {c}" for c in ("x0", "y0", "x1", "y1")))
    return spatial.clip_segments(parts).select("line").distinct()


def pr14_detail_filter(s: SparkSession, d: str) -> DataFrame:
    """Buildings wide or high enough on the print, and all marked ones."""
    return fx.areas(s, d).where("2 * h * 20 * (1 + id % 3) >= 4 OR height / 10 >= 2 OR class = 3").select("id")


def pr15_validity(s: SparkSession, d: str) -> DataFrame:
    n = F.coalesce(F.size("geometry"), F.lit(0))
    rows = fx.read(s, d, "overpass_ways").select("layer", F.greatest(n, F.lit(0)).alias("n"))
    return rows.groupBy("layer").agg(F.count_if(F.col("n") >= 2).alias("lines"), F.count_if(F.col("n") >= 4).alias("rings"), F.count_if(F.col("n") < 2).alias("invalid"))


def pr17_outlines(s: SparkSession, d: str) -> DataFrame:
    rings = fx.area_rings(s, d).withColumn("ring", F.when(F.col("id") % 3 == 0, F.array(*(F.col("shell")[i] for i in (0, 2, 1, 3)))).when(F.col("id") % 3 == 1, F.col("shell")).otherwise(F.slice("shell", 1, 2)))
    return outlines.outline_problems(rings, "id", "ring", 1e-4)


def pr18_can_paint(s: SparkSession, d: str) -> DataFrame:
    """Of the class dimension those that the raster has."""
    classes = s.range(0, 13).select(F.col("id").cast("int").alias("class"))
    return classes.join(fx.class_cells(s, d).select("class"), "class", "left_semi")


def pr19_preselect(s: SparkSession, d: str) -> DataFrame:
    """Layers that are not too dense, chosen before their elements are read."""
    rows = fx.read(s, d, "overpass_ways")
    light = rows.groupBy("layer").agg(F.count(F.lit(1)).alias("n")).where("n <= 900").select("layer")
    return rows.join(light, "layer", "left_semi").select("delivery_id", "layer")


def w10_kriging(s: SparkSession, d: str) -> DataFrame:
    """Classes of every fourth cell smoothed back to a finer lattice."""
    native = fx.class_cells(s, d).where("r % 4 = 0 AND c % 4 = 0").selectExpr("r DIV 4 AS r", "c DIV 4 AS c", "class")
    rows, columns = native.agg(F.max("r") + 1, F.max("c") + 1).first()
    got = kriging.smooth(fx.spots(s, d), native, F.col("y") * (rows - 1), F.col("x") * (columns - 1), "class", rows, columns)
    return got.select("id", "value")


def w11_smoothing_gate(s: SparkSession, d: str) -> DataFrame:
    return fx.features(s, d).selectExpr("id", "(area * 40D - 1) / greatest(id % 90 + 10, 1) >= 1.5 AS applies")


def w17_profile(s: SparkSession, d: str) -> DataFrame:
    """The highest of five cells across at each of 17 stations along each row of the raster."""
    stations = F.explode(F.sequence(F.lit(0), F.lit(16)))
    cells = fx.cells(s, d)
    picks = cells.select("r").distinct().select("r", stations.alias("station")).selectExpr("r", "station", "explode(sequence(-2, 2)) AS across").selectExpr("r AS at", "station", "r + across AS r", "CAST(round(station * 99 / 16D) AS BIGINT) AS c")
    return picks.join(cells, ["r", "c"]).groupBy("at", "station").agg(F.max("z").alias("top"))


def w18_ordinals(s: SparkSession, d: str) -> DataFrame:
    """Entries named by their group and their place in it."""
    w = Window.partitionBy("class").orderBy("id")
    name = F.element_at(F.array(*map(F.lit, ("rock", "forest", "snow", "water"))), (F.col("class") + 1).cast("int"))
    return fx.areas(s, d).select("id", F.concat_ws(" ", name, F.row_number().over(w)).alias("name"))


def j04_bucket_candidates(s: SparkSession, d: str) -> DataFrame:
    """Areas whose bounds share a bucket with each spot's bounds of a twentieth."""
    grow = lambda c: (F.col(c) - 0.025, F.col(c) + 0.025)
    asked = spatial.by_bounds(fx.spots(s, d), *grow("x"), *grow("y")).select("id", "bx", "by")
    held = spatial.ring_bounds(fx.area_rings(s, d).select(F.col("id").alias("area"), "shell"), "shell").select("area", "bx", "by")
    return asked.join(held, ["bx", "by"]).select("id", "area").distinct()


def j14_joined_ends(s: SparkSession, d: str) -> DataFrame:
    """Lines whose end meets another line's start, by bucketed end points."""
    ends = fx.line_pts(s, d).groupBy("line").agg(F.min(F.struct("seq", "x", "y")).alias("a"), F.max(F.struct("seq", "x", "y")).alias("b"))
    near = 0.004
    start = ends.selectExpr("line AS second", "a.x AS sx", "a.y AS sy", f"CAST(floor(a.x / {near}) AS INT) AS gx", f"CAST(floor(a.y / {near}) AS INT) AS gy")
    end = ends.selectExpr("line AS first", "b.x AS ex", "b.y AS ey").withColumn("gx", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: F.floor(F.col("ex") / near).cast("int") + i))).withColumn("gy", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: F.floor(F.col("ey") / near).cast("int") + i)))
    return end.join(start, ["gx", "gy"]).where("first <> second AND (ex - sx) * (ex - sx) + (ey - sy) * (ey - sy) < 0.004D * 0.004D").select("first", "second")


def u05_convex_clip(s: SparkSession, d: str) -> DataFrame:
    """Area of each shell inside a window."""
    window = [(0.1, 0.15), (0.7, 0.15), (0.7, 0.8), (0.1, 0.8)]

    @F.pandas_udf("double")
    def clipped(rings: pd.Series) -> pd.Series:
        return rings.map(lambda r: outlines.shoelace(outlines.clip_convex([(p["x"], p["y"]) for p in r], window)) if r is not None else None)

    return fx.area_rings(s, d).select("id", F.round(clipped("shell"), 8).alias("area"))


def g03_seas(s: SparkSession, d: str) -> DataFrame:
    """The sea of each tile whose coast is a straight line across it, in two ways."""
    tiles = fx.read(s, d, "nation").select("n_nationkey", (F.col("n_nationkey") / 30 + 0.1).alias("h")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3))))
    points = tiles.selectExpr("n_nationkey AS tile", "IF(k < 2, 2, 1) AS way", "k AS seq", "IF(k = 0, 0.5D, IF(k = 1, 1.2D, IF(k = 2, -0.3D, 0.5D))) AS x", "IF(n_nationkey % 5 = 4 AND k = 1, 0.9D, h) AS y")
    shifted = points.withColumn("x", F.when((F.col("tile") % 5 == 3) & (F.col("seq") == 1), 0.8).otherwise(F.col("x")))
    return outlines.seas(shifted, "tile", "way", "seq").select("tile", "role", "ring", F.round("area", 6).alias("area"))


def g19_strip_parity(s: SparkSession, d: str) -> DataFrame:
    """Points in shells by edges indexed in horizontal strips."""
    shells = fx.area_rings(s, d).select(F.col("id").alias("area"), F.posexplode("shell").alias("i", "p"), F.col("shell").alias("ring"))
    edges = shells.select("area", F.col("p.x").alias("x0"), F.col("p.y").alias("y0"), F.element_at("ring", (F.col("i") + 1) % 4 + 1).alias("q")).select("area", "x0", "y0", F.col("q.x").alias("x1"), F.col("q.y").alias("y1"))
    strips = edges.withColumn("strip", F.explode(F.sequence(F.floor(F.least("y0", "y1") * 64), F.floor(F.greatest("y0", "y1") * 64))))
    points = fx.spots(s, d).withColumn("strip", F.floor(F.col("y") * 64))
    crossed = points.join(strips, "strip").where("(y0 > y) <> (y1 > y)").where("x < (x1 - x0) * (y - y0) / (y1 - y0) + x0")
    return crossed.groupBy("id", "area").agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 1").select("id", "area")


def g20_puzzle_edges(s: SparkSession, d: str) -> DataFrame:
    """Sides to which the edges of a 12 by 9 puzzle bulge; outer edges are straight."""
    grid = s.range(0, 2).select(F.col("id").alias("orientation"), F.explode(F.sequence(F.lit(0), F.lit(12))).alias("line"), F.lit(0).alias("x")).select("orientation", "line", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("segment"))
    inside = grid.where("(orientation = 0 AND line <= 9 AND segment < 12) OR (orientation = 1 AND line <= 12 AND segment < 9)")
    outer = (F.col("line") == 0) | (F.col("line") == F.when(F.col("orientation") == 0, 9).otherwise(12))
    sign = hashing.edge_sign(F.lit(77), F.col("orientation"), F.col("segment"), F.col("line"))
    return inside.select("orientation", "line", "segment", F.when(outer, 0.0).otherwise(sign).alias("sign"))


def g21_tile_specs(s: SparkSession, d: str) -> DataFrame:
    """Centres of a 2 by 3 mosaic of rotated squares around each station."""
    spots = fx.stations(s, d).select("id", "lat", "lon", F.radians((F.col("id") * 13 % 360).cast("double")).alias("a"), F.explode(F.sequence(F.lit(0), F.lit(1))).alias("tile_row")).withColumn("tile_column", F.explode(F.sequence(F.lit(0), F.lit(2))))
    east, north = (F.col("tile_column") - 1.0) * 18.0, (F.col("tile_row") - 0.5) * 18.0
    lat = F.col("lat") + (-east * F.sin("a") + north * F.cos("a")) / G.KM_PER_LATITUDE_DEGREE
    lon = G.normalize_longitude(F.col("lon") + (east * F.cos("a") + north * F.sin("a")) / G.longitude_scale(F.col("lat")))
    return spots.select("id", "tile_row", "tile_column", F.round(lat, 5).alias("lat"), F.round(lon, 5).alias("lon"))


def g25_retention(s: SparkSession, d: str) -> DataFrame:
    """Centres of the tray's segments of every mosaic: each station's model is cut by its id into 1 to 4 rows and columns."""
    sizes = fx.stations(s, d).selectExpr("id", "CAST(id % 4 + 1 AS INT) AS rows", "CAST(id DIV 4 % 4 + 1 AS INT) AS columns", "100D + id % 7 * 20 AS wide", "80D + id % 5 * 15 AS high")
    cells = sizes.withColumn("segment_row", F.explode(F.sequence(F.lit(0), F.col("rows") - 1))).withColumn("segment_column", F.explode(F.sequence(F.lit(0), F.col("columns") - 1)))
    return cells.selectExpr("id", "segment_row", "segment_column", "round(wide * (segment_column + 0.5D) / columns, 6) AS x", "round(high * (segment_row + 0.5D) / rows, 6) AS y")


def x03_water_budget(s: SparkSession, d: str) -> DataFrame:
    """Water lines by printed size within a budget; rivers and canals always stay."""
    kind = T.tag(F.col("tags"), "waterway")
    lines = fx.ways(s, d).where(T.lookup(kind, T.WATERWAY_SCALES).isNotNull()).select("id", (F.coalesce(F.size("geometry"), F.lit(0)) * 10).cast("long").alias("area"), kind.isin("river", "canal").alias("major"))
    return selecting.greedy_budget(lines.withColumn("area", F.greatest("area", F.lit(0))), "id", "area", "major", 2500.0)


def x05_road_layers(s: SparkSession, d: str) -> DataFrame:
    """Roads of all layers at once; trails stand in only where there is no road at all."""
    ways = fx.ways(s, d).select("id", T.tag(F.col("tags"), "highway").alias("kind"))
    roads = ways.where(F.col("kind").isin(*(k for k in T.ROAD_SCALES if k not in T.TRAILS)))
    none = roads.limit(1).agg((F.count(F.lit(1)) == 0).alias("none"))
    trails = ways.where(F.col("kind").isin(*T.TRAILS)).join(F.broadcast(none)).where("none").drop("none")
    return roads.unionByName(trails).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def x08_grid_points(s: SparkSession, d: str) -> DataFrame:
    """Latitude and longitude of every sample of a rotated 40 by 30 grid."""
    grid = s.range(0, 1200).selectExpr("id DIV 40 AS r", "id % 40 AS c")
    lat, lon = G.from_uv(F.col("c") / 39.0, F.col("r") / 29.0, 46.8, 8.2, 18.0, 25.0)
    return grid.select("r", "c", F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))


def x16_safe_edges(s: SparkSession, d: str) -> DataFrame:
    """Areas for which all 33 samples of the middle line of their box lie in the area itself."""
    samples = fx.areas(s, d).select(F.col("id").alias("owner"), F.explode(F.sequence(F.lit(0), F.lit(32))).alias("i"), "cx", "cy", "h").selectExpr("owner", "cx + h * 0.9 * (i / 16D - 1) AS x", "cy + 0.011 AS y")
    hits = spatial.points_in_areas(samples, fx.area_rings(s, d).select(F.col("id").alias("area"), "shell", "holes")).where("owner = area")
    counted = hits.groupBy("owner").agg(F.count(F.lit(1)).alias("n"))
    return fx.areas(s, d).select(F.col("id").alias("owner")).join(counted, "owner", "left").select("owner", (F.coalesce("n", F.lit(0)) == 33).alias("safe"))


#: Buckets a side for short segments.
SMALL = 64


def x19_crossings(s: SparkSession, d: str) -> DataFrame:
    """Crossings of segments of different lines, by bucketed bounds, each once; lines are drawn small, each at its own place."""
    small = fx.line_pts(s, d).selectExpr("line", "seq", "line * 7919 % 997 / 997D + (x - 0.5) * 0.02 AS x", "line * 104729 % 991 / 991D + (y - 0.5) * 0.02 AS y")
    return spatial.crossings(spatial.segments(small, "line", "seq"), SMALL)


def x28_split_tiles(s: SparkSession, d: str) -> DataFrame:
    """The tiles at zoom 12 that each delivered element's points lie in."""
    points = fx.ways(s, d).select("id", F.explode("geometry").alias("p")).where("p IS NOT NULL AND p.lat IS NOT NULL AND p.lon IS NOT NULL")
    return points.select("id", G.tile_x(F.col("p.lon"), 12).alias("x"), G.tile_y(F.col("p.lat"), 12).alias("y")).distinct()


_GRID = "grid AS (SELECT 0 AS orientation, l AS line, g AS segment FROM range(10) a(l), range(12) b(g) UNION ALL SELECT 1, l, g FROM range(13) a(l), range(9) b(g))"
_M = "18446744073709551616::UHUGEINT"
_mul = lambda x, k: f"(({x})::UHUGEINT * {k}::UHUGEINT % {_M})"
_shift = lambda x, n: f"xor({x}, {x} // {1 << n}::UHUGEINT)"
_SEGS = "s AS (SELECT line, row_number() OVER w - 1 AS seg, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM line_pts WINDOW w AS (PARTITION BY line ORDER BY seq)), "
_T = "((b.x1 - b.x0) * (a.y{0} - b.y0) - (b.y1 - b.y0) * (a.x{0} - b.x0))"
_U = "((a.x1 - a.x0) * (b.y{0} - a.y0) - (a.y1 - a.y0) * (b.x{0} - a.x0))"
_PHI = "radians(least(greatest(lat, -85.05112878), 85.05112878))"

QUERIES = {f.__name__: f for f in (s08_tile_gaps, s11_pushed_filter, s12_places, s16_artifacts, s19_synthetic, pr13_box_intersect, pr14_detail_filter, pr15_validity, pr17_outlines, pr18_can_paint, pr19_preselect, w10_kriging, w11_smoothing_gate, w17_profile, w18_ordinals, j04_bucket_candidates, j14_joined_ends, u05_convex_clip, g03_seas, g19_strip_parity, g20_puzzle_edges, g21_tile_specs, g25_retention, x03_water_budget, x05_road_layers, x08_grid_points, x16_safe_edges, x19_crossings, x28_split_tiles)}
_GREEDY = """WITH RECURSIVE {0}, m AS (SELECT id, area, row_number() OVER (ORDER BY area DESC, id) AS k FROM items WHERE NOT major),
        g(k, room, id, area, fits) AS (SELECT 0::BIGINT, {1} - (SELECT coalesce(sum(area), 0) FROM items WHERE major), NULL::BIGINT, 0::BIGINT, false UNION ALL SELECT m.k, room - CASE WHEN m.area <= room THEN m.area ELSE 0 END, m.id, m.area, m.area <= room FROM g JOIN m ON m.k = g.k + 1)
        SELECT id, area, major FROM items WHERE major UNION ALL SELECT id, area, false FROM g WHERE fits"""
_SINE, _COSINE = math.sin(math.radians(25.0)), math.cos(math.radians(25.0))
_WIDE_KM = max(G.KM_PER_EQUATOR_DEGREE * abs(math.cos(math.radians(46.8))), G.LEAST_KM_PER_LONGITUDE_DEGREE)

ORACLES = {
    "x03_water_budget": _GREEDY.format(f"ways AS ({fx.VIEWS['ways'][0]}), items AS (SELECT id, greatest(coalesce(len(geometry), 0) * 10, 0)::BIGINT AS area, tags['waterway'] IN ('river', 'canal') AS major FROM ways WHERE tags['waterway'] IN {tuple(T.WATERWAY_SCALES)!r})", 2500.0),
    "x08_grid_points": f"SELECT r, c, round(46.8::DOUBLE + (-east * {_SINE!r}::DOUBLE + north * {_COSINE!r}::DOUBLE) / {G.KM_PER_LATITUDE_DEGREE!r}::DOUBLE, 6) AS lat, round(8.2::DOUBLE + (east * {_COSINE!r}::DOUBLE + north * {_SINE!r}::DOUBLE) / {_WIDE_KM!r}::DOUBLE, 6) AS lon FROM (SELECT r, c, (c / 39 - 0.5::DOUBLE) * 18 AS east, (r / 29 - 0.5::DOUBLE) * 18 AS north FROM range(30) a(r), range(40) b(c))",
    # Water lies right of a coast that crosses the square from left to right: below it.
    "g03_seas": "SELECT k::VARCHAR AS tile, CASE WHEN k % 5 = 3 THEN 'broken' ELSE 'outer' END AS role, 0 AS ring, round(CASE k % 5 WHEN 3 THEN 0 WHEN 4 THEN 0.5 * h + 0.25 * (h + h + (0.9::DOUBLE - h) * 5 / 7) ELSE h END, 6) AS area FROM (SELECT n_nationkey AS k, n_nationkey / 30 + 0.1::DOUBLE AS h FROM nation)",
    "s08_tile_gaps": "SELECT DISTINCT tile_key FROM overpass_ways WHERE tile_key IS NOT NULL AND tile_key NOT IN (SELECT tile_key FROM overpass_responses WHERE body_json IS NOT NULL AND tile_key IS NOT NULL)",
    "s11_pushed_filter": with_views("SELECT id, tags['railway'] AS kind FROM ways WHERE tags['railway'] IN ('rail', 'tram', 'narrow_gauge') AND geometry[1].lat BETWEEN -45 AND 55 AND geometry[1].lon BETWEEN -120 AND 140", "ways"),
    "s12_places": "WITH j AS (SELECT cache_id, response_json::JSON AS j FROM place_search_cache WHERE json_valid(response_json) AND json_type(response_json) = 'ARRAY'), p AS (SELECT cache_id, unnest(range(json_array_length(j)::BIGINT)) AS pos, j FROM j) SELECT cache_id, pos::INT AS pos, json_extract_string(j, '$[' || pos || '].display_name') AS name, json_extract_string(j, '$[' || pos || '].latitude')::DOUBLE AS lat, json_extract_string(j, '$[' || pos || '].longitude')::DOUBLE AS lon FROM p",
    "s16_artifacts": "WITH a AS (SELECT DISTINCT id, artifacts_json FROM jobs WHERE status = 'complete' AND json_valid(artifacts_json)), f AS (SELECT unnest(from_json(artifacts_json, '[{\"name\": \"VARCHAR\", \"bytes\": \"BIGINT\"}]')) AS f FROM a) SELECT regexp_extract(f.name, '\\.([a-z0-9]+)$', 1) AS kind, count(*) AS n, sum(f.bytes)::BIGINT AS bytes FROM f GROUP BY 1",
    "s19_synthetic": "SELECT r, c, round(1200 + 900 * sin(4 * pi() * (c / 63)) + 650 * cos(3 * pi() * (r / 63)) + 300 * sin(6 * pi() * (c / 63 + r / 63)), 4) AS z FROM range(64) a(r), range(64) b(c)",
    "pr13_box_intersect": with_views("WITH " + _SEGS + "k AS (SELECT line, (x0 - 0.4503::DOUBLE) * 10 AS x0, (y0 - 0.4503::DOUBLE) * 10 AS y0, (x1 - x0) * 10 AS dx, (y1 - y0) * 10 AS dy FROM s WHERE x1 IS NOT NULL) SELECT DISTINCT line FROM k WHERE (dx <> 0 OR x0 BETWEEN 0 AND 1) AND (dy <> 0 OR y0 BETWEEN 0 AND 1) AND greatest(0, CASE WHEN dx <> 0 THEN least(-x0 / dx, (1 - x0) / dx) ELSE 0 END, CASE WHEN dy <> 0 THEN least(-y0 / dy, (1 - y0) / dy) ELSE 0 END) <= least(1, CASE WHEN dx <> 0 THEN greatest(-x0 / dx, (1 - x0) / dx) ELSE 1 END, CASE WHEN dy <> 0 THEN greatest(-y0 / dy, (1 - y0) / dy) ELSE 1 END)", "line_pts"),
    "pr14_detail_filter": with_views("SELECT id FROM areas WHERE NOT (2 * h * 20 * (1 + id % 3) < 4 AND height / 10 < 2 AND class <> 3)", "areas"),
    "pr15_validity": "SELECT layer, count(*) FILTER (len(geometry) >= 2) AS lines, count(*) FILTER (len(geometry) >= 4) AS rings, count(*) FILTER (coalesce(len(geometry), 0) < 2) AS invalid FROM overpass_ways GROUP BY layer",
    "pr17_outlines": with_views("SELECT id, CASE WHEN id % 3 = 2 THEN 'points' WHEN cx - h < 0 OR cx + h > 1 OR cy - h < 0 OR cy + h > 1 THEN 'outside' WHEN id % 3 = 0 THEN 'crossing' END AS problem FROM areas", "areas"),
    "pr18_can_paint": with_views("SELECT DISTINCT class::INT AS class FROM class_cells WHERE class < 13", "class_cells"),
    "pr19_preselect": "SELECT delivery_id, layer FROM overpass_ways WHERE layer IN (SELECT layer FROM overpass_ways GROUP BY layer HAVING count(*) <= 900)",
    "w11_smoothing_gate": with_views("SELECT id, (area * 40 - 1) / greatest(id % 90 + 10, 1) >= 1.5 AS applies FROM features", "features"),
    "w17_profile": with_views("SELECT a.r AS at, s::INT AS station, max(b.z) AS top FROM (SELECT DISTINCT r FROM cells) a CROSS JOIN range(17) t(s) JOIN cells b ON b.r BETWEEN a.r - 2 AND a.r + 2 AND b.c = CAST(round(s * 99 / 16) AS BIGINT) GROUP BY 1, 2", "cells"),
    "w18_ordinals": with_views("SELECT id, ['rock', 'forest', 'snow', 'water'][class + 1] || ' ' || row_number() OVER (PARTITION BY class ORDER BY id) AS name FROM areas", "areas"),
    "j04_bucket_candidates": with_views("WITH b AS (SELECT id, " + ", ".join(f"least(greatest(floor(({c} {g}) * 32), 0), 31) AS {n}" for c, g, n in (("x", "- 0.025", "w"), ("x", "+ 0.025", "e"), ("y", "- 0.025", "s"), ("y", "+ 0.025", "n"))) + " FROM spots), a AS (SELECT id AS area, " + ", ".join(f"least(greatest(floor(({c} {g} h) * 32), 0), 31) AS {n}" for c, g, n in (("cx", "-", "w"), ("cx", "+", "e"), ("cy", "-", "s"), ("cy", "+", "n"))) + " FROM areas) SELECT id, area FROM b JOIN a ON b.w <= a.e AND a.w <= b.e AND b.s <= a.n AND a.s <= b.n", "spots", "areas"),
    "j14_joined_ends": with_views("WITH e AS (SELECT line, arg_min(x, seq) AS sx, arg_min(y, seq) AS sy, arg_max(x, seq) AS ex, arg_max(y, seq) AS ey FROM line_pts GROUP BY line) SELECT a.line AS first, b.line AS second FROM e a JOIN e b ON a.line <> b.line AND (a.ex - b.sx) * (a.ex - b.sx) + (a.ey - b.sy) * (a.ey - b.sy) < 0.004::DOUBLE * 0.004::DOUBLE", "line_pts"),
    "u05_convex_clip": with_views("SELECT id, round(greatest(least(cx + h, 0.7) - greatest(cx - h, 0.1), 0) * greatest(least(cy + h, 0.8) - greatest(cy - h, 0.15), 0), 8) AS area FROM areas", "areas"),
    "g19_strip_parity": with_views("SELECT p.id, a.id AS area FROM spots p JOIN areas a ON greatest(abs(p.x - a.cx), abs(p.y - a.cy)) < a.h", "spots", "areas"),
    "g20_puzzle_edges": f"""WITH {_GRID}, s AS (SELECT *, xor(xor(xor(xor({_mul('77', hashing.SEED_MULTIPLIER)}, {_mul('orientation', hashing.ORIENTATION_MULTIPLIER)}), {_mul('line', hashing.LINE_MULTIPLIER)}), {_mul('segment', hashing.SEGMENT_MULTIPLIER)}), {7 * hashing.SEED_MULTIPLIER % (1 << 64)}::UHUGEINT) AS v FROM grid),
        a AS (SELECT * REPLACE ({_mul(_shift('v', 30), hashing.MIX_1)} AS v) FROM s), b AS (SELECT * REPLACE ({_mul(_shift('v', 27), hashing.MIX_2)} AS v) FROM a), c AS (SELECT * REPLACE ({_shift('v', 31)} AS v) FROM b)
        SELECT orientation::BIGINT AS orientation, line::INT AS line, segment::INT AS segment, CASE WHEN line = 0 OR line = CASE orientation WHEN 0 THEN 9 ELSE 12 END THEN 0 WHEN (v // {1 << 40}::UHUGEINT)::DOUBLE / 16777215 < 0.5 THEN -1 ELSE 1 END::DOUBLE AS sign FROM c""",
    "g21_tile_specs": with_views("WITH k AS (SELECT *, radians(id * 13 % 360) AS a, (tc - 1) * 18.0::DOUBLE AS e, (tr - 0.5::DOUBLE) * 18 AS n FROM stations, range(2) p(tr), range(3) q(tc)) SELECT id, tr::INT AS tile_row, tc::INT AS tile_column, round(lat + (-e * sin(a) + n * cos(a)) / 110.574, 5) AS lat, round(x + 180 - 360 * floor((x + 180) / 360) - 180, 5) AS lon FROM (SELECT *, lon + (e * cos(a) + n * sin(a)) / greatest(111.32 * abs(cos(radians(lat))), 20) AS x FROM k)", "stations"),
    "g25_retention": with_views("SELECT id, a::INT AS segment_row, b::INT AS segment_column, round(wide * (b + 0.5::DOUBLE) / columns, 6) AS x, round(high * (a + 0.5::DOUBLE) / rows_, 6) AS y FROM (SELECT id, id % 4 + 1 AS rows_, id // 4 % 4 + 1 AS columns, 100::DOUBLE + id % 7 * 20 AS wide, 80::DOUBLE + id % 5 * 15 AS high FROM stations), range(4) r(a), range(4) c(b) WHERE a < rows_ AND b < columns", "stations"),
    "x05_road_layers": with_views("SELECT tags['highway'] AS kind, count(*) AS n FROM ways WHERE tags['highway'] IN (" + ", ".join(f"'{k}'" for k in T.ROAD_SCALES if k not in T.TRAILS) + ") GROUP BY 1", "ways"),
    "x16_safe_edges": with_views("SELECT id AS owner, hole_h IS NULL AS safe FROM areas", "areas"),
    "x19_crossings": with_views("WITH small AS (SELECT line, seq, line * 7919 % 997 / 997 + (x - 0.5) * 0.02 AS x, line * 104729 % 991 / 991 + (y - 0.5) * 0.02 AS y FROM line_pts), " + _SEGS.rstrip(", ").replace("FROM line_pts", "FROM small") + f" SELECT a.line AS line1, a.seg::INT AS seg1, b.line AS line2, b.seg::INT AS seg2 FROM s a JOIN s b ON a.line < b.line AND abs(a.x0 - b.x0) < 0.05 AND abs(a.y0 - b.y0) < 0.05 AND a.x1 IS NOT NULL AND b.x1 IS NOT NULL AND {_T.format(0)} * {_T.format(1)} < 0 AND {_U.format(0)} * {_U.format(1)} < 0", "line_pts"),
    "x28_split_tiles": with_views(f"WITH p AS (SELECT id, g.lat AS lat, g.lon AS lon FROM (SELECT id, unnest(geometry) AS g FROM ways) WHERE g.lat IS NOT NULL AND g.lon IS NOT NULL) SELECT DISTINCT id, CAST(least(greatest(floor((lon + 180) / 360 * 4096.0::DOUBLE), 0), 4095) AS BIGINT) AS x, CAST(least(greatest(floor((1 - ln(tan({_PHI}) + 1 / cos({_PHI})) / pi()) / 2 * 4096.0::DOUBLE), 0), 4095) AS BIGINT) AS y FROM p", "ways"),
}
