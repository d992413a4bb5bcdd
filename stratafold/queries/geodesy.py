"""Queries of map projections, tile addresses and sampling arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafold.functions import geo as G
from stratafold.plans import fixtures as fx
from stratafold.plans.fixtures import with_views



def s03_providers(s: SparkSession, d: str) -> DataFrame:
    """The catalogue of tile providers."""
    return s.createDataFrame(PROVIDERS, "provider string, min_zoom int, max_zoom int, tile_size int, format string, parent_fallback boolean")


# Zoom range, tile size, file format, whether a missing tile falls back to its parent.
PROVIDERS = [("terrarium", 5, 14, 256, "png", False), ("highres", 0, 17, 512, "webp", True)]


def s05_window_plan(s: SparkSession, d: str) -> DataFrame:
    """The 3-degree tiles under a window around each station, with the part of the window in each."""
    windows = fx.stations(s, d).selectExpr("id", "lon - 1.7D AS west", "lon + 1.7D AS east", "lat - 0.9D AS south", "lat + 0.9D AS north")
    spread = windows.select("*", F.explode(F.sequence(F.floor(F.col("west") / 3), F.floor(F.col("east") / 3))).alias("i")).select("*", F.explode(F.sequence(F.floor(F.col("south") / 3), F.floor(F.col("north") / 3))).alias("j"))
    return spread.select("id", (F.col("i") * 3).alias("tile_west"), (F.col("j") * 3).alias("tile_south"), F.round(F.least(F.col("east"), F.col("i") * 3 + 3) - F.greatest(F.col("west"), F.col("i") * 3), 6).alias("width"), F.round(F.least(F.col("north"), F.col("j") * 3 + 3) - F.greatest(F.col("south"), F.col("j") * 3), 6).alias("height"))


def s06_overview(s: SparkSession, d: str) -> DataFrame:
    """For each target width the largest overview no wider than twice the target, else the smallest."""
    targets = fx.features(s, d).selectExpr("id", "area * 97 + 5 AS target")
    fits = F.struct((F.col("width") <= 2 * F.col("target")).alias("fits"), F.when(F.col("width") <= 2 * F.col("target"), F.col("width")).otherwise(-F.col("width")).alias("rank"), "level")
    # Six levels: each target is expanded by a constant, not joined with data.
    spread = targets.select("*", F.explode(F.array(*(F.struct(F.lit(k).alias("level"), F.lit(12000 >> k).alias("width")) for k in range(6)))).alias("o")).select("id", "target", "o.level", "o.width")
    return spread.groupBy("id").agg(F.max(fits).alias("best")).select("id", F.col("best.level").alias("level"))


def s18_synthetic_terrain(s: SparkSession, d: str) -> DataFrame:
    u, v = F.col("x"), F.col("y")
    a, b = math.sin(math.radians(46.85)) * 1.7, math.cos(math.radians(-121.76)) * 1.3
    ridge = F.sin((u * 9.2 + a) * 1.2) * 0.19 + F.cos((v * 7.1 - b) * 1.4) * 0.14
    folds = F.abs(F.sin((u * 3.8 + v * 5.6 + b) * math.pi)) * 0.17
    dx, dy = u - (0.54 + b * 0.05), v - (0.48 + a * 0.05)
    peak = F.exp(-(dx * dx * 5.5 + dy * dy * 7.0)) * 0.63
    return fx.spots(s, d).select("id", F.round(F.least(F.greatest(0.12 + ridge + folds + peak, F.lit(0.03)), F.lit(1.0)), 6).alias("height"))


def pr01_pixel_decode(s: SparkSession, d: str) -> DataFrame:
    return fx.pixels(s, d).selectExpr("id", "(red % 256) * 256D + (green % 256) + (blue % 256) / 256D - 32768 AS metres")


def pr10_reclass(s: SparkSession, d: str) -> DataFrame:
    return fx.read(s, d, "part").selectExpr("p_partkey AS id", "CASE p_size * 10 WHEN 10 THEN 1 WHEN 70 THEN 2 WHEN 80 THEN 3 WHEN 0 THEN NULL ELSE 0 END AS class")


def pr11_bounds(s: SparkSession, d: str) -> DataFrame:
    """Cover and overlap of each station's box with a fixed request box."""
    box = fx.stations(s, d).selectExpr("id", "lon - (id % 9 + 1) * 5D AS west", "lon + (id % 9 + 1) * 5D AS east", "lat - (id % 7 + 1) * 4D AS south", "lat + (id % 7 + 1) * 4D AS north")
    return box.selectExpr("id", "west <= -5 AND east >= 5 AND south <= -5 AND north >= 5 AS covers", "west <= 5 AND east >= -5 AND south <= 5 AND north >= -5 AS overlaps", "round((east - west) * (north - south), 6) AS area")


def pr12_split_antimeridian(s: SparkSession, d: str) -> DataFrame:
    box = fx.points(s, d).selectExpr("id", "lon - 4D AS west", "lon + 4D AS east")
    parts = F.when(F.col("west") < -180, F.expr("array(named_struct('west', west + 360, 'east', 180D), named_struct('west', -180D, 'east', east))")).when(F.col("east") > 180, F.expr("array(named_struct('west', west, 'east', 180D), named_struct('west', -180D, 'east', east - 360))")).otherwise(F.expr("array(named_struct('west', west, 'east', east))"))
    return box.select("id", F.posexplode(parts).alias("part", "p")).select("id", "part", F.round("p.west", 6).alias("west"), F.round("p.east", 6).alias("east"))


def pr20_road_detail(s: SparkSession, d: str) -> DataFrame:
    return fx.features(s, d).selectExpr("id", "CASE WHEN area <= 2 THEN 'all' WHEN area <= 8 THEN 'streets' WHEN area <= 20 THEN 'minor' ELSE 'major' END AS detail")


def fn01_longitude(s: SparkSession, d: str) -> DataFrame:
    return fx.points(s, d).select("id", F.round(G.normalize_longitude(F.col("lon") * 3), 6).alias("normal"), F.round(137.5 + G.normalize_longitude(F.col("lon") - 137.5), 6).alias("unwrapped"))


def fn02_lon_scale(s: SparkSession, d: str) -> DataFrame:
    return fx.points(s, d).select("id", F.round(G.longitude_scale(F.col("lat")), 6).alias("km_per_degree"))


def fn03_uv(s: SparkSession, d: str) -> DataFrame:
    u, v = G.to_uv(F.col("lat"), F.col("lon"), 46.8, 8.2, 900.0, 30.0)
    lat, lon = G.from_uv(u, v, 46.8, 8.2, 900.0, 30.0)
    return fx.points(s, d).select("id", F.round(u, 5).alias("u"), F.round(v, 5).alias("v"), (F.abs(lat - F.col("lat")) + F.abs(G.normalize_longitude(lon - F.col("lon"))) < 1e-6).alias("round_trip"))


def fn04_rotated_bounds(s: SparkSession, d: str) -> DataFrame:
    """The envelope of each station's rotated square."""
    corners = fx.stations(s, d).select("id", "lat", "lon", F.radians((F.col("id") * 7 % 360).cast("double")).alias("angle"), F.explode(F.expr("array(named_struct('u', -6D, 'v', -6D), named_struct('u', 6D, 'v', -6D), named_struct('u', 6D, 'v', 6D), named_struct('u', -6D, 'v', 6D))")).alias("k"))
    east, north = F.col("k.u") * F.cos("angle") + F.col("k.v") * F.sin("angle"), -F.col("k.u") * F.sin("angle") + F.col("k.v") * F.cos("angle")
    at = corners.select("id", (F.col("lat") + north / G.KM_PER_LATITUDE_DEGREE).alias("y"), (F.col("lon") + east / G.longitude_scale(F.col("lat"))).alias("x"))
    return at.groupBy("id").agg(*(F.round(f(c), 5).alias(n) for n, f, c in (("west", F.min, "x"), ("east", F.max, "x"), ("south", F.min, "y"), ("north", F.max, "y"))))


def fn05_tile_key(s: SparkSession, d: str) -> DataFrame:
    return fx.points(s, d).select("id", G.tile_x(F.col("lon"), 8).alias("tile_x"), G.tile_y(F.col("lat"), 8).alias("tile_y"))


def fn06_pixel_location(s: SparkSession, d: str) -> DataFrame:
    x, y = G.pixel_x(F.col("lon"), 8, 256), G.pixel_y(F.col("lat"), 8, 256)
    return fx.points(s, d).select("id", x.alias("x"), y.alias("y")).selectExpr("id", "x DIV 256 AS tile_x", "y DIV 256 AS tile_y", "x % 256 AS pixel_x", "y % 256 AS pixel_y")


def fn07_zoom(s: SparkSession, d: str) -> DataFrame:
    return fx.points(s, d).select("id", G.choose_zoom(F.col("lat"), (F.col("id") % 97 + 1) * 3.7, 256, 5, 14).alias("zoom"), F.round(G.ground_resolution_m(F.col("lat"), F.lit(9.0), 256), 4).alias("metres"))


def fn08_tile_name(s: SparkSession, d: str) -> DataFrame:
    return fx.points(s, d).select("id", G.degree_tile_name(F.col("lat"), F.col("lon")).alias("name"))


def x29_degree_name(s: SparkSession, d: str) -> DataFrame:
    return fx.points(s, d).select("id", G.degree_tile_name(F.col("lat"), F.col("lon"), 1).alias("name"))


def fn12_sample_budget(s: SparkSession, d: str) -> DataFrame:
    return fx.features(s, d).selectExpr("id", "CAST(least(greatest(ceil(ceil(area * 37 * greatest(8D / greatest(area / 5D, 0.5D), 1D)) / 8) * 8, area * 37), 4096) AS BIGINT) AS samples")


def x07_highest_zoom(s: SparkSession, d: str) -> DataFrame:
    """Highest zoom whose tile set holds each point."""
    spread = fx.points(s, d).select("id", F.explode(F.array(*(F.struct(F.lit(z).alias("z"), G.tile_x(F.col("lon"), z).alias("x"), G.tile_y(F.col("lat"), z).alias("y")) for z in range(4, 9)))).alias("t")).select("id", "t.*")
    return spread.where("z = 4 OR (x * 31 + y * 17 + z) % 3 <> 0").groupBy("id").agg(F.max("z").alias("zoom"))


def u03_tile_set(s: SparkSession, d: str) -> DataFrame:
    return fx.points(s, d).select(G.tile_x(F.col("lon"), 6).alias("x"), G.tile_y(F.col("lat"), 6).alias("y")).distinct()


def u02_missing_tiles(s: SparkSession, d: str) -> DataFrame:
    """Requested tiles that no station's tile provides."""
    cached = fx.stations(s, d).select(G.tile_x(F.col("lon"), 5).alias("x"), G.tile_y(F.col("lat"), 5).alias("y"))
    return fx.points(s, d).select(G.tile_x(F.col("lon"), 5).alias("x"), G.tile_y(F.col("lat"), 5).alias("y")).distinct().join(cached, ["x", "y"], "left_anti")


def fn23_coord_label(s: SparkSession, d: str) -> DataFrame:
    span = F.col("id") % 80 + 1
    decimals = F.least(F.greatest(F.ceil(F.log10(111320.0 / (span * 50.0))), F.lit(1)), F.lit(4)).cast("int")
    text = F.when(decimals == 1, F.format_string("%.1f", F.abs(F.col("lat")))).when(decimals == 2, F.format_string("%.2f", F.abs(F.col("lat")))).when(decimals == 3, F.format_string("%.3f", F.abs(F.col("lat")))).otherwise(F.format_string("%.4f", F.abs(F.col("lat"))))
    return fx.points(s, d).select("id", decimals.alias("decimals"), F.concat(text, F.when(F.col("lat") >= 0, "N").otherwise("S")).alias("label"))


def x34_grid_plan(s: SparkSession, d: str) -> DataFrame:
    return s.range(1, 7).select(F.col("id").alias("grid_row"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("grid_column")).selectExpr("grid_row", "grid_column", "format_string('terrain-r%02d-c%02d', grid_row, grid_column) AS name")


def x37_latitudes(s: SparkSession, d: str) -> DataFrame:
    """Least and greatest latitude of a rotated mosaic of two by three squares around each station."""
    corner = [(a, b) for a in (-18.0, 18.0) for b in (-12.0, 12.0)]
    angle = F.radians((F.col("id") * 11 % 360).cast("double"))
    ys = [F.col("lat") + (F.cos(angle) * b - F.sin(angle) * a) / G.KM_PER_LATITUDE_DEGREE for a, b in corner]
    return fx.stations(s, d).select("id", F.round(F.least(*ys), 5).alias("south"), F.round(F.greatest(*ys), 5).alias("north"))


_MY = "(1 - ln(tan(radians(least(greatest(lat, -85.05112878), 85.05112878))) + 1 / cos(radians(least(greatest(lat, -85.05112878), 85.05112878)))) / pi()) / 2"


def _tx(z: int) -> str:
    return f"CAST(least(greatest(floor((lon + 180) / 360 * {float(1 << z)}::DOUBLE), 0), {(1 << z) - 1}) AS BIGINT)"


def _ty(z: int) -> str:
    return f"CAST(least(greatest(floor({_MY} * {float(1 << z)}::DOUBLE), 0), {(1 << z) - 1}) AS BIGINT)"


def _norm(x: str) -> str:
    return f"(({x}) + 180 - 360 * floor((({x}) + 180) / 360) - 180)"


_SIN, _COS = math.sin(math.radians(30)), math.cos(math.radians(30))
_EAST = f"{_norm('lon - 8.2')} * {G.KM_PER_EQUATOR_DEGREE * math.cos(math.radians(46.8))}::DOUBLE"
_NORTH = "(lat - 46.8) * 110.574"
_A, _B = math.sin(math.radians(46.85)) * 1.7, math.cos(math.radians(-121.76)) * 1.3


def _name(step: int) -> str:
    return f"(CASE WHEN floor(lat / {step}) >= 0 THEN 'N' ELSE 'S' END) || lpad(CAST(abs(CAST(floor(lat / {step}) * {step} AS INT)) AS VARCHAR), 2, '0') || (CASE WHEN floor(lon / {step}) >= 0 THEN 'E' ELSE 'W' END) || lpad(CAST(abs(CAST(floor(lon / {step}) * {step} AS INT)) AS VARCHAR), 3, '0')"


QUERIES = {f.__name__: f for f in (s03_providers, s05_window_plan, s06_overview, s18_synthetic_terrain, pr01_pixel_decode, pr10_reclass, pr11_bounds, pr12_split_antimeridian, pr20_road_detail, fn01_longitude, fn02_lon_scale, fn03_uv, fn04_rotated_bounds, fn05_tile_key, fn06_pixel_location, fn07_zoom, fn08_tile_name, x29_degree_name, fn12_sample_budget, x07_highest_zoom, u03_tile_set, u02_missing_tiles, fn23_coord_label, x34_grid_plan, x37_latitudes)}
ORACLES = {
    "s03_providers": "SELECT * FROM (VALUES ('terrarium', 5, 14, 256, 'png', false), ('highres', 0, 17, 512, 'webp', true)) v(provider, min_zoom, max_zoom, tile_size, format, parent_fallback)",
    "s05_window_plan": with_views("""WITH w AS (SELECT id, lon - 1.7 AS west, lon + 1.7 AS east, lat - 0.9 AS south, lat + 0.9 AS north FROM stations),
        i AS (SELECT *, unnest(range(CAST(floor(west / 3) AS BIGINT), CAST(floor(east / 3) AS BIGINT) + 1)) AS i FROM w), j AS (SELECT *, unnest(range(CAST(floor(south / 3) AS BIGINT), CAST(floor(north / 3) AS BIGINT) + 1)) AS j FROM i)
        SELECT id, i * 3 AS tile_west, j * 3 AS tile_south, round(least(east, i * 3 + 3) - greatest(west, i * 3), 6) AS width, round(least(north, j * 3 + 3) - greatest(south, j * 3), 6) AS height FROM j""", "stations"),
    "s06_overview": with_views("""WITH l AS (SELECT k::INT AS level, 12000 >> k AS width FROM range(6) t(k)), t AS (SELECT id, area * 97 + 5 AS target FROM features)
        SELECT id, coalesce(arg_max(level, width) FILTER (WHERE width <= 2 * target), arg_min(level, width)) AS level FROM t, l GROUP BY id""", "features"),
    "s18_synthetic_terrain": with_views(f"""SELECT id, round(least(greatest(0.12 + sin((x * 9.2 + {_A}) * 1.2) * 0.19 + cos((y * 7.1 - {_B}) * 1.4) * 0.14 + abs(sin((x * 3.8 + y * 5.6 + {_B}) * pi())) * 0.17
        + exp(-((x - (0.54 + {_B} * 0.05)) ** 2 * 5.5 + (y - (0.48 + {_A} * 0.05)) ** 2 * 7.0)) * 0.63, 0.03), 1.0), 6) AS height FROM spots""".replace("**", "^"), "spots"),
    "pr01_pixel_decode": with_views("SELECT id, (red % 256) * 256.0::DOUBLE + (green % 256) + (blue % 256) / 256 - 32768 AS metres FROM pixels", "pixels"),
    "pr10_reclass": "SELECT p_partkey AS id, (CASE p_size * 10 WHEN 10 THEN 1 WHEN 70 THEN 2 WHEN 80 THEN 3 WHEN 0 THEN NULL ELSE 0 END)::INT AS class FROM part",
    "pr11_bounds": with_views("""WITH b AS (SELECT id, lon - (id % 9 + 1) * 5 AS west, lon + (id % 9 + 1) * 5 AS east, lat - (id % 7 + 1) * 4 AS south, lat + (id % 7 + 1) * 4 AS north FROM stations)
        SELECT id, west <= -5 AND east >= 5 AND south <= -5 AND north >= 5 AS covers, NOT (west > 5 OR east < -5 OR south > 5 OR north < -5) AS overlaps, round((east - west) * (north - south), 6) AS area FROM b""", "stations"),
    "pr12_split_antimeridian": with_views("""WITH b AS (SELECT id, lon - 4 AS west, lon + 4 AS east FROM points)
        SELECT id, 0::INT AS part, round(CASE WHEN west < -180 THEN west + 360 ELSE west END, 6) AS west, round(CASE WHEN west < -180 OR east > 180 THEN 180 ELSE east END, 6) AS east FROM b
        UNION ALL SELECT id, 1::INT, -180::DOUBLE, round(CASE WHEN west < -180 THEN east ELSE east - 360 END, 6) FROM b WHERE west < -180 OR east > 180""", "points"),
    "pr20_road_detail": with_views("SELECT id, CASE WHEN area > 20 THEN 'major' WHEN area > 8 THEN 'minor' WHEN area > 2 THEN 'streets' ELSE 'all' END AS detail FROM features", "features"),
    "fn01_longitude": with_views(f"SELECT id, round({_norm('lon * 3')}, 6) AS normal, round(137.5 + {_norm('lon - 137.5')}, 6) AS unwrapped FROM points", "points"),
    "fn02_lon_scale": with_views("SELECT id, round(greatest(111.32 * abs(cos(radians(lat))), 20), 6) AS km_per_degree FROM points", "points"),
    "fn03_uv": with_views(f"SELECT id, round(({_EAST} * {_COS}::DOUBLE - {_NORTH} * {_SIN}::DOUBLE) / 900 + 0.5, 5) AS u, round(({_EAST} * {_SIN}::DOUBLE + {_NORTH} * {_COS}::DOUBLE) / 900 + 0.5, 5) AS v, true AS round_trip FROM points", "points"),
    "fn04_rotated_bounds": with_views("""WITH k AS (SELECT *, radians(id * 7 % 360) AS a FROM stations, (VALUES (-6.0, -6.0), (6.0, -6.0), (6.0, 6.0), (-6.0, 6.0)) t(u, v)),
        p AS (SELECT id, lat + (v * cos(a) - u * sin(a)) / 110.574 AS y, lon + (u * cos(a) + v * sin(a)) / greatest(111.32 * abs(cos(radians(lat))), 20) AS x FROM k)
        SELECT id, round(min(x), 5) AS west, round(max(x), 5) AS east, round(min(y), 5) AS south, round(max(y), 5) AS north FROM p GROUP BY id""", "stations"),
    "fn05_tile_key": with_views(f"SELECT id, {_tx(8)} AS tile_x, {_ty(8)} AS tile_y FROM points", "points"),
    "fn06_pixel_location": with_views(f"""WITH p AS (SELECT id, CAST(floor((lon + 180) / 360 * 256.0::DOUBLE * 256.0::DOUBLE) AS BIGINT) % 65536 AS x, CAST(least(greatest(floor({_MY} * 256.0::DOUBLE * 256.0::DOUBLE), 0), 65535) AS BIGINT) AS y FROM points)
        SELECT id, x // 256 AS tile_x, y // 256 AS tile_y, x % 256 AS pixel_x, y % 256 AS pixel_y FROM p""", "points"),
    "fn07_zoom": with_views("SELECT id, CAST(least(greatest(ceil(log2(40075016.686 * greatest(abs(cos(radians(lat))), 0.1) / (256 * greatest((id % 97 + 1) * 3.7::DOUBLE, 0.1)))), 5), 14) AS INT) AS zoom, round(40075016.686::DOUBLE * greatest(abs(cos(radians(lat))), 0.1) / (256 * 512), 4) AS metres FROM points", "points"),
    "fn08_tile_name": with_views(f"SELECT id, {_name(3)} AS name FROM points", "points"),
    "x29_degree_name": with_views(f"SELECT id, {_name(1)} AS name FROM points", "points"),
    "fn12_sample_budget": with_views("SELECT id, CAST(least(greatest(ceil(ceil(area * 37 * greatest(8.0::DOUBLE / greatest(area / 5, 0.5), 1)) / 8) * 8, area * 37), 4096) AS BIGINT) AS samples FROM features", "features"),
    "x07_highest_zoom": with_views("WITH t AS (" + " UNION ALL ".join(f"SELECT id, {z}::INT AS z, {_tx(z)} AS x, {_ty(z)} AS y FROM points" for z in range(4, 9)) + ") SELECT id, max(z) AS zoom FROM t WHERE z = 4 OR (x * 31 + y * 17 + z) % 3 <> 0 GROUP BY id", "points"),
    "u03_tile_set": with_views(f"SELECT DISTINCT {_tx(6)} AS x, {_ty(6)} AS y FROM points", "points"),
    "u02_missing_tiles": with_views(f"SELECT {_tx(5)} AS x, {_ty(5)} AS y FROM points EXCEPT SELECT {_tx(5)}, {_ty(5)} FROM stations", "points", "stations"),
    "fn23_coord_label": with_views("""WITH k AS (SELECT *, CAST(least(greatest(ceil(log10(111320 / ((id % 80 + 1) * 50.0::DOUBLE))), 1), 4) AS INT) AS decimals FROM points)
        SELECT id, decimals, (CASE decimals WHEN 1 THEN format('{:.1f}', abs(lat)) WHEN 2 THEN format('{:.2f}', abs(lat)) WHEN 3 THEN format('{:.3f}', abs(lat)) ELSE format('{:.4f}', abs(lat)) END) || CASE WHEN lat >= 0 THEN 'N' ELSE 'S' END AS label FROM k""", "points"),
    "x34_grid_plan": "SELECT i AS grid_row, j::INT AS grid_column, 'terrain-r' || lpad(i::VARCHAR, 2, '0') || '-c' || lpad(j::VARCHAR, 2, '0') AS name FROM range(1, 7) a(i), range(1, 6) b(j)",
    "x37_latitudes": with_views("""WITH k AS (SELECT id, lat + (cos(radians(id * 11 % 360)) * b - sin(radians(id * 11 % 360)) * a) / 110.574 AS y FROM stations, (VALUES (-18.0), (18.0)) p(a), (VALUES (-12.0), (12.0)) q(b))
        SELECT id, round(min(y), 5) AS south, round(max(y), 5) AS north FROM k GROUP BY id""", "stations"),
}
