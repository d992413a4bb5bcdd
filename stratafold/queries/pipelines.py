"""Queries of the larger pipelines: routes, pavement, profiles, puzzle grids, layers and reports."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafold.functions import geo as G
from stratafold.functions import hashing
from stratafold.functions import tags as T
from stratafold.operators import routes as R
from stratafold.operators import sampling
from stratafold.operators.ranking import ranked
from stratafold.plans import fixtures as fx
from stratafold.plans.fixtures import with_views
from stratafold.queries.extras import _M, _mul, _shift
from stratafold.queries.tagging import _LENGTH, _PLAIN, _case
from stratafold.sources import predicates
from stratafold.streaming import states

SPAN_KM = 45000.0
MODEL = R.Model()
BOXES = ((-35.0, -160.0, 10.0, 20.0), (0.0, -30.0, 60.0, 160.0))


def _shape(s: SparkSession, d: str) -> tuple[int, int]:
    rows, columns = fx.cells(s, d).agg(F.max("r") + 1, F.max("c") + 1).first()
    return rows or 1, columns or 1


def x01_routes(s: SparkSession, d: str) -> DataFrame:
    """Printed width and class of every delivered road and path, and the ground at the ends of bridges."""
    elements = fx.ways(s, d).select("id", "tags", R.model_points(F.col("geometry"), SPAN_KM).alias("points"))
    found = R.routes(elements, "id", fx.cells(s, d), "z", *_shape(s, d), MODEL)
    return found.select("id", "class", *(F.round(c, 5).alias(c) for c in ("width_mm", "bridge_from", "bridge_to")))


def x01_route_counts(s: SparkSession, d: str) -> DataFrame:
    found = x01_routes(s, d)
    return found.agg(F.count_if(F.col("class") == R.ROAD).alias("roads"), F.count_if(F.col("class") == R.ROUTE_TRAIL).alias("trails"), F.count("bridge_from").alias("bridges"))


def x04_pavement(s: SparkSession, d: str) -> DataFrame:
    """Counts of the pavement pipeline, with landuse for paved areas and service ways for centre lines."""
    rows = fx.read(s, d, "overpass_ways")
    members = F.transform("members", lambda m: F.struct(m["member_type"].alias("member_type"), m["member_role"].alias("member_role"), R.model_points(m["geometry"], SPAN_KM).alias("points")))
    kind = F.coalesce(F.lower(F.trim("element_type")), F.lit(""))
    elements = rows.where("tags['landuse'] IS NOT NULL OR tags['highway'] IN ('service', 'track', 'path')").select(F.col("delivery_id").alias("id"), F.when(kind == "", "way").otherwise(kind).alias("kind"), "tags", R.model_points(F.coalesce("geometry", F.expr("CAST(array() AS array<struct<lat: double, lon: double>>)")), SPAN_KM).alias("points"), members.alias("members"))
    return R.pavement(elements, "id", T.tag(F.col("tags"), "landuse").isNotNull(), 20_000)[2]


STATIONS, ACROSS = 256, 5


def w17_stations(s: SparkSession, d: str) -> DataFrame:
    """The highest of five cells across each line at each of its 257 stations, which part its length evenly."""
    rows, columns = _shape(s, d)
    at = lambda i, c: F.element_at("points", i)[c]
    flat = fx.paths(s, d).select("id", "half", *(at(i + 1, c).alias(f"{c}{i}") for i in range(3) for c in "xy"))
    got = sampling.highest_across(flat, "id", fx.cells(s, d), "z", rows, columns, STATIONS, 0.005, ACROSS // 2)
    return got.select("id", "station", F.col("z").alias("top"))


def x08_grid_samples(s: SparkSession, d: str) -> DataFrame:
    """Elevations of a rotated 40 by 30 grid of samples: each is placed on the map and read from the raster there."""
    rows, columns = _shape(s, d)
    lat, lon = G.from_uv(F.col("c") / 39.0, F.col("r") / 29.0, 46.8, 8.2, 18.0, 25.0)
    grid = s.range(0, 1200).selectExpr("id", "id DIV 40 AS r", "id % 40 AS c").select("id", ((lat - 46.6) / 0.4).alias("y"), ((lon - 7.9) / 0.6).alias("x"))
    got = sampling.bilinear(grid, fx.cells(s, d), F.col("y") * (rows - 1), F.col("x") * (columns - 1), "z", rows, columns)
    return got.select("id", F.round("value", 4).alias("metres"))


def x15_jittered_points(s: SparkSession, d: str) -> DataFrame:
    """Grid points of a 4 by 3 puzzle for each station's seed: fixed at the border, else moved by at most 9 % of a piece."""
    points = fx.stations(s, d).select("id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("r")).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(4))))

    def moved(at: str, last: int, piece: float, lane: int):
        shift = (hashing.grid_noise(F.col("r"), F.col("c"), F.col("id"), F.lit(lane)) - 0.5) * piece * 0.18
        return F.round(F.col(at) * piece + F.when((F.col(at) == 0) | (F.col(at) == last), 0.0).otherwise(shift), 6)

    return points.select("id", "r", "c", moved("c", 4, 50.0, 0).alias("x"), moved("r", 3, 45.0, 1).alias("y"))


def a25_fingerprints(s: SparkSession, d: str) -> DataFrame:
    """Fingerprints of all delivered geometries, for cache keys."""
    return fx.ways(s, d).select("id", hashing.geometry_fingerprint("geometry").alias("fingerprint"))


def s11_layers(s: SparkSession, d: str) -> DataFrame:
    """Elements that each layer's request finds in two boxes together."""
    first = F.try_element_at("geometry", F.lit(1))
    rows = fx.ways(s, d).where(predicates.in_boxes(first["lat"], first["lon"], BOXES))
    layers = F.array_compact(F.array(*(F.when(predicates.asked(layer, F.col("tags")), F.lit(layer)) for layer in predicates.LAYERS)))
    return rows.select("id", F.explode(layers).alias("layer"))


def s13_cached_and_missed(s: SparkSession, d: str) -> DataFrame:
    """Distinct searches by whether some cached row of the same text, letter case aside, has an answer."""
    rows = fx.read(s, d, "place_search_cache").select(F.lower(F.trim("query")).alias("asked"), "response_json").where(F.length("asked").between(2, 120))
    hits = rows.where("response_json IS NOT NULL").select("asked").distinct()
    searches = rows.select("asked").distinct()
    return searches.join(hits, "asked", "left_semi").withColumn("hit", F.lit(True)).unionByName(searches.join(hits, "asked", "left_anti").withColumn("hit", F.lit(False)))


def x31_report(s: SparkSession, d: str) -> DataFrame:
    """One line of text about the faces of each material."""
    faces = fx.tris(s, d).groupBy("material").agg(F.count(F.lit(1)).alias("n"), F.min("tid").alias("first"))
    total = faces.agg(F.sum("n").alias("total"))
    return faces.join(F.broadcast(total)).select("material", F.concat(F.lit("material "), F.col("material").cast("string"), F.lit(": "), F.col("n").cast("string"), F.lit(" faces, first "), F.col("first").cast("string"), F.lit(", "), F.floor(F.col("n") * 1000 / F.col("total")).cast("string"), F.lit(" per mille")).alias("line"))


def x35_preview_tiles(s: SparkSession, d: str) -> DataFrame:
    """The requested preview tile of each mosaic, if its row and column lie in it; else the first."""
    asked = fx.stations(s, d).selectExpr("id", "id % 3 + 1 AS rows", "id DIV 3 % 3 + 1 AS columns", "id % 5 - 1 AS row", "id % 4 AS column")
    inside = "row >= 0 AND row < rows AND column >= 0 AND column < columns"
    return asked.selectExpr("id", f"IF({inside}, row, 0) AS tile_row", f"IF({inside}, column, 0) AS tile_column")


def k04_preview(s: SparkSession, d: str) -> DataFrame:
    """Heights, classes and coverage of the raster at every eighth cell, a JSON text for each row of the preview."""
    cells = fx.cells(s, d).where("r % 8 = 0 AND c % 8 = 0").join(fx.class_cells(s, d), ["r", "c"])
    lines = cells.groupBy("r").agg(F.sort_array(F.collect_list(F.struct("c", F.round("z", 2).alias("z"), "class"))).alias("cells"))
    body = F.struct((F.col("r") / 8).cast("int").alias("row"), F.col("cells.z").alias("heights"), F.col("cells.class").alias("classes"))
    return lines.select((F.col("r") / 8).cast("int").alias("row"), F.to_json(body).alias("json"))


def k05_manifest(s: SparkSession, d: str) -> DataFrame:
    """The manifest of a generated model: pieces, their sizes and the classes in them, as one JSON text for each piece."""
    pieces = fx.cells(s, d).join(fx.class_cells(s, d), ["r", "c"]).groupBy(F.expr("c DIV 20").alias("piece")).agg(F.count(F.lit(1)).alias("cells"), F.round(F.min("z"), 2).alias("low"), F.round(F.max("z"), 2).alias("high"), F.sort_array(F.collect_set("class")).alias("classes"))
    return pieces.select("piece", F.to_json(F.struct("piece", "cells", "low", "high", "classes")).alias("json"))


def x29_footprints(s: SparkSession, d: str) -> DataFrame:
    """Names of cached imagery: the one-degree tile of each station and a hash of its footprint, rounded to a thousandth."""
    corner = lambda c, k: F.format_string("%.3f", F.col(c) + k)
    text = F.concat_ws(",", corner("lat", -0.05), corner("lon", -0.05), corner("lat", 0.05), corner("lon", 0.05))
    return fx.stations(s, d).select("id", F.concat_ws("-", G.degree_tile_name(F.col("lat"), F.col("lon"), 1), F.lpad(F.lower(F.hex(hashing.fnv1a64(text))), 16, "0")).alias("name"))


def o05_palette_order(s: SparkSession, d: str) -> DataFrame:
    """Place of every distinct colour by group and channels; ranks come from range partitions, not from one sorted task."""
    colours = fx.pixels(s, d).select("grp", "red", "green", "blue").distinct()
    return ranked(colours, [], ["grp", "red", "green", "blue"]).select("grp", "red", "green", "blue", F.col("__k").alias("place"))


def fn22_quantised(s: SparkSession, d: str) -> DataFrame:
    """Coordinates to five decimals, without a negative zero."""
    shifted = fx.line_pts(s, d).selectExpr("line", "seq", "x / 7 - 0.05 AS x", "(y - 0.5) / 1e6 AS y")
    return shifted.select("line", "seq", *((F.round(F.col(c) * 1e5) / 1e5 + 0.0).alias(c) for c in ("x", "y")))


def t01_feed(s: SparkSession, d: str) -> DataFrame:
    """Each key's events up to its first terminal one."""
    return states.until_terminal(fx.job_events(s, d), "key", ["ts", "event_id"], F.col("kind") == "purchase").select("key", "event_id", "terminal")


QUERIES = {f.__name__: f for f in (x01_routes, x01_route_counts, x04_pavement, w17_stations, x08_grid_samples, x15_jittered_points, a25_fingerprints, s11_layers, s13_cached_and_missed, x31_report, x35_preview_tiles, k04_preview, k05_manifest, x29_footprints, o05_palette_order, fn22_quantised, t01_feed)}

_EAST, _NORTH = max(G.KM_PER_EQUATOR_DEGREE, G.LEAST_KM_PER_LONGITUDE_DEGREE), G.KM_PER_LATITUDE_DEGREE
_SET = "coalesce(tags['{0}'] NOT IN ('no', 'false'), false)"
_ROUTES = f"""size AS (SELECT max(r) + 1 AS h, max(c) + 1 AS w FROM cells),
w AS (SELECT id, {_case("tags['highway']", T.ROAD_SCALES)} AS scale, tags['highway'] AS kind, tags['width'] AS text, {_SET.format("bridge")} AS bridge, list_transform(geometry, lambda p: {{'x': p.lon * {_EAST}::DOUBLE / {SPAN_KM} + 0.5::DOUBLE, 'y': p.lat * {_NORTH}::DOUBLE / {SPAN_KM} + 0.5::DOUBLE}}) AS pts FROM ways WHERE len(geometry) >= 2 AND NOT {_SET.format("tunnel")}),
c AS (SELECT *, {_PLAIN} AS t FROM w WHERE scale IS NOT NULL), m AS (SELECT *, greatest(scale * {MODEL.road_mm}::DOUBLE, 0.4) AS base, {_LENGTH} AS parsed FROM c),
f AS (SELECT *, CASE WHEN parsed > 0 THEN least(greatest(parsed * ({MODEL.width_mm}::DOUBLE / {MODEL.span_km * 1000}), base), greatest(6.0::DOUBLE, base)) ELSE base END AS full_mm, parsed > 0 AS mapped,
  list_sum(list_transform(range(1, len(pts)), lambda i: sqrt(((pts[i + 1].x - pts[i].x) * 200) ^ 2 + ((pts[i + 1].y - pts[i].y) * 150) ^ 2))) AS long FROM m),
thin AS (SELECT least(greatest(0.06 / greatest(coalesce(sum(long * full_mm), 0) / 30000, 0.06), 0.35), 1) AS k FROM f),
e AS (SELECT id, i, least(greatest(p.y * (h - 1), 0), h - 1) AS y, least(greatest(p.x * (w - 1), 0), w - 1) AS x, h, w FROM (SELECT id, unnest([0, 1]) AS i, unnest([pts[1], pts[-1]]) AS p FROM f WHERE bridge), size),
q AS (SELECT e.id, e.i, sum(z * CASE WHEN a = 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END * CASE WHEN b = 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) AS v FROM e, (VALUES (0), (1)) s(a), (VALUES (0), (1)) u(b) JOIN cells ON cells.r = least(CAST(floor(y) AS BIGINT) + a, h - 1) AND cells.c = least(CAST(floor(x) AS BIGINT) + b, w - 1) GROUP BY ALL),
routes AS (SELECT f.id, CASE WHEN kind IN {T.TRAILS!r} THEN {R.ROUTE_TRAIL} ELSE {R.ROAD} END::INT AS class, round(CASE WHEN coalesce(mapped, false) THEN full_mm ELSE greatest(full_mm * k, 0.4) END, 5) AS width_mm, round((SELECT v FROM q WHERE q.id = f.id AND i = 0), 5) AS bridge_from, round((SELECT v FROM q WHERE q.id = f.id AND i = 1), 5) AS bridge_to FROM f, thin)"""
_ROUTES = _ROUTES.replace("FROM e, (VALUES (0), (1)) s(a), (VALUES (0), (1)) u(b) JOIN", "FROM e CROSS JOIN (VALUES (0), (1)) s(a) CROSS JOIN (VALUES (0), (1)) u(b) JOIN")


def _at(progress: str, c: str) -> str:
    gone = f"(({progress}) * (l0 + l1))"
    return f"CASE WHEN {gone} <= l0 THEN {c}0 + ({c}1 - {c}0) * CASE WHEN l0 > 0 THEN least({gone} / l0, 1) ELSE 1 END ELSE {c}1 + ({c}2 - {c}1) * CASE WHEN l1 > 0 THEN least(greatest(({gone} - l0) / l1, 0), 1) ELSE 0 END END"


_SINE, _COSINE = math.sin(math.radians(25.0)), math.cos(math.radians(25.0))
_KM = max(G.KM_PER_EQUATOR_DEGREE * abs(math.cos(math.radians(46.8))), G.LEAST_KM_PER_LONGITUDE_DEGREE)


def _noise_sql(lane: int) -> str:
    key = "(r::UHUGEINT * 4294967296::UHUGEINT + c::UHUGEINT)"
    seed = f"xor(xor({key}, {_mul('id', hashing.SEED_MULTIPLIER)}), {lane * hashing.SEED_MULTIPLIER % 2**64}::UHUGEINT)"
    mixed = _mul(_shift(f"({seed})", 30), hashing.MIX_1)
    mixed = _mul(_shift(f"({mixed})", 27), hashing.MIX_2)
    return f"({_shift(f'({mixed})', 31)} // {1 << 40}::UHUGEINT)::DOUBLE / 16777215"


def _asked_sql(layer: str) -> str:
    parts = []
    for part in predicates.LAYERS[layer]:
        without = "".join(f" AND coalesce(tags['{k}'] <> '{v}', true)" for k, v in part.without)
        parts.append(f"coalesce(regexp_matches(tags['{part.key}'], '{part.pattern}'), false){without}")
    return " OR ".join(f"({p})" for p in parts)


ORACLES = {
    "x01_routes": with_views(f"WITH {_ROUTES} SELECT * FROM routes", "cells", "ways"),
    "x01_route_counts": with_views(f"WITH {_ROUTES} SELECT count(*) FILTER (class = {R.ROAD}) AS roads, count(*) FILTER (class = {R.ROUTE_TRAIL}) AS trails, count(bridge_from) AS bridges FROM routes", "cells", "ways"),
    "w17_stations": with_views(f"""WITH size AS (SELECT max(r) + 1 AS h, max(c) + 1 AS w FROM cells), l AS (SELECT *, sqrt((x1 - x0) ^ 2 + (y1 - y0) ^ 2) AS l0, sqrt((x2 - x1) ^ 2 + (y2 - y1) ^ 2) AS l1 FROM paths),
        st AS (SELECT id, k AS station, half, {_at("k / 256", "x")} AS px, {_at("k / 256", "y")} AS py, ({_at("least(k / 256 + 0.005::DOUBLE, 1)", "x")}) - ({_at("greatest(k / 256 - 0.005::DOUBLE, 0)", "x")}) AS dx, ({_at("least(k / 256 + 0.005::DOUBLE, 1)", "y")}) - ({_at("greatest(k / 256 - 0.005::DOUBLE, 0)", "y")}) AS dy FROM l, range(257) t(k)),
        d AS (SELECT *, CASE WHEN sqrt(dx * dx + dy * dy) > 1e-9 THEN dx / sqrt(dx * dx + dy * dy) ELSE 1 END AS ux, CASE WHEN sqrt(dx * dx + dy * dy) > 1e-9 THEN dy / sqrt(dx * dx + dy * dy) ELSE 0 END AS uy FROM st),
        a AS (SELECT id, station, px - uy * half * j / 2 AS u, py + ux * half * j / 2 AS v FROM d, range(-2, 3) t(j))
        SELECT id, station::INT AS station, max(z) AS top FROM a CROSS JOIN size JOIN cells ON r = CAST(round(least(greatest(v, 0), 1) * (h - 1)) AS BIGINT) AND c = CAST(round(least(greatest(u, 0), 1) * (w - 1)) AS BIGINT) GROUP BY id, station""", "cells", "paths"),
    "x08_grid_samples": with_views(f"""WITH size AS (SELECT max(r) + 1 AS h, max(c) + 1 AS w FROM cells), g AS (SELECT i AS id, (i % 40 / 39 - 0.5::DOUBLE) * 18 AS east, (i // 40 / 29 - 0.5::DOUBLE) * 18 AS north FROM range(1200) t(i)),
        m AS (SELECT id, (46.8::DOUBLE + (-east * {_SINE!r}::DOUBLE + north * {_COSINE!r}::DOUBLE) / {G.KM_PER_LATITUDE_DEGREE!r}::DOUBLE - 46.6) / 0.4 * (h - 1) AS y, (8.2::DOUBLE + (east * {_COSINE!r}::DOUBLE + north * {_SINE!r}::DOUBLE) / {_KM!r}::DOUBLE - 7.9) / 0.6 * (w - 1) AS x, h, w FROM g, size),
        e AS (SELECT id, least(greatest(y, 0), h - 1) AS y, least(greatest(x, 0), w - 1) AS x, h, w FROM m)
        SELECT id, round(sum(z * CASE WHEN a = 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END * CASE WHEN b = 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END), 4) AS metres FROM e CROSS JOIN (VALUES (0), (1)) s(a) CROSS JOIN (VALUES (0), (1)) u(b) JOIN cells ON cells.r = least(CAST(floor(y) AS BIGINT) + a, h - 1) AND cells.c = least(CAST(floor(x) AS BIGINT) + b, w - 1) GROUP BY id""", "cells"),
    "x15_jittered_points": with_views(f"SELECT id, r::INT AS r, c::INT AS c, round(c * 50.0::DOUBLE + CASE WHEN c IN (0, 4) THEN 0 ELSE ({_noise_sql(0)} - 0.5::DOUBLE) * 50 * 0.18::DOUBLE END, 6) AS x, round(r * 45.0::DOUBLE + CASE WHEN r IN (0, 3) THEN 0 ELSE ({_noise_sql(1)} - 0.5::DOUBLE) * 45 * 0.18::DOUBLE END, 6) AS y FROM stations, range(4) a(r), range(5) b(c)", "stations"),
    "s11_layers": with_views(f"WITH b AS (SELECT id, tags FROM ways WHERE {' OR '.join(f'(geometry[1].lat BETWEEN {s} AND {n} AND geometry[1].lon BETWEEN {w} AND {e})' for s, w, n, e in BOXES)}) " + " UNION ALL ".join(f"SELECT id, '{layer}' AS layer FROM b WHERE {_asked_sql(layer)}" for layer in predicates.LAYERS), "ways"),
    "s13_cached_and_missed": "SELECT asked, bool_or(response_json IS NOT NULL) AS hit FROM (SELECT lower(trim(query)) AS asked, response_json FROM place_search_cache) WHERE length(asked) BETWEEN 2 AND 120 GROUP BY asked",
    "x31_report": with_views("WITH f AS (SELECT material, count(*) AS n, min(tid) AS first FROM tris GROUP BY material) SELECT material::INT AS material, 'material ' || material || ': ' || n || ' faces, first ' || first || ', ' || (n * 1000 // (SELECT sum(n)::BIGINT FROM f)) || ' per mille' AS line FROM f", "tris"),
    "x35_preview_tiles": with_views("SELECT id, CASE WHEN ok THEN a ELSE 0 END AS tile_row, CASE WHEN ok THEN b ELSE 0 END AS tile_column FROM (SELECT *, a >= 0 AND a < rows_ AND b < columns AS ok FROM (SELECT id, id % 3 + 1 AS rows_, id // 3 % 3 + 1 AS columns, id % 5 - 1 AS a, id % 4 AS b FROM stations))", "stations"),
    "k04_preview": with_views("WITH k AS (SELECT (r // 8)::INT AS row, c, round(z, 2) AS z, class FROM cells JOIN class_cells USING (r, c) WHERE r % 8 = 0 AND c % 8 = 0) SELECT row, '{\"row\":' || row || ',\"heights\":[' || string_agg(z::VARCHAR, ',' ORDER BY c) || '],\"classes\":[' || string_agg(class::VARCHAR, ',' ORDER BY c) || ']}' AS json FROM k GROUP BY row", "cells", "class_cells"),
    "k05_manifest": with_views("WITH p AS (SELECT c // 20 AS piece, count(*) AS n, round(min(z), 2) AS low, round(max(z), 2) AS high, list_sort(list_distinct(list(class))) AS classes FROM cells JOIN class_cells USING (r, c) GROUP BY 1) SELECT piece, '{\"piece\":' || piece || ',\"cells\":' || n || ',\"low\":' || low || ',\"high\":' || high || ',\"classes\":[' || array_to_string(classes, ',') || ']}' AS json FROM p", "cells", "class_cells"),
    "x29_footprints": with_views(f"WITH t AS (SELECT id, floor(lat)::INT AS south, floor(lon)::INT AS west, printf('%.3f,%.3f,%.3f,%.3f', lat - 0.05, lon - 0.05, lat + 0.05, lon + 0.05) AS text FROM stations), h AS (SELECT *, list_reduce(list_transform(string_split(text, ''), lambda c: ord(c)::UHUGEINT), lambda a, b: xor(a, b) * {hashing.FNV_PRIME}::UHUGEINT % {_M}, {hashing.FNV_OFFSET}::UHUGEINT) AS h FROM t) SELECT id, printf('%s%02d%s%03d', CASE WHEN south >= 0 THEN 'N' ELSE 'S' END, abs(south), CASE WHEN west >= 0 THEN 'E' ELSE 'W' END, abs(west)) || '-' || lpad(lower(to_hex(h::UBIGINT)), 16, '0') AS name FROM h", "stations"),
    "o05_palette_order": with_views("SELECT grp, red, green, blue, row_number() OVER (ORDER BY grp, red, green, blue) - 1 AS place FROM (SELECT DISTINCT grp, red, green, blue FROM pixels)", "pixels"),
    "fn22_quantised": with_views("SELECT line, seq, round((x / 7 - 0.05) * 1e5) / 1e5 + 0.0 AS x, round((y - 0.5) / 1e6 * 1e5) / 1e5 + 0.0 AS y FROM line_pts", "line_pts"),
    "t01_feed": with_views("WITH f AS (SELECT *, kind = 'purchase' AS terminal, coalesce(sum((kind = 'purchase')::INT) OVER (PARTITION BY key ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM job_events) SELECT key, event_id, terminal FROM f WHERE before = 0", "job_events"),
}
