"""Queries of tag predicates, lookups and parsers over the map elements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafold.functions import tags as T
from stratafold.plans import fixtures as fx
from stratafold.plans.fixtures import with_views

TAGS = "tags"


def pr02_tag_filter(s: SparkSession, d: str) -> DataFrame:
    rows = fx.ways(s, d).where(T.tag(TAGS, "surface").isNotNull() & ~T.tag(TAGS, "surface").rlike("^(asphalt|concrete)$") & T.tag(TAGS, "highway").isin("track", "path", "footway"))
    return rows.select("id", T.tag(TAGS, "highway").alias("highway"), T.tag(TAGS, "surface").alias("surface"))


def pr03_road_scale(s: SparkSession, d: str) -> DataFrame:
    return fx.ways(s, d).select("id", T.lookup(T.tag(TAGS, "highway"), T.ROAD_SCALES).alias("scale")).where("scale IS NOT NULL")


def pr04_rail_scale(s: SparkSession, d: str) -> DataFrame:
    return fx.ways(s, d).select("id", T.lookup(T.tag(TAGS, "railway"), T.RAILWAY_SCALES).alias("rail_scale"), T.lookup(T.tag(TAGS, "aerialway"), T.AERIALWAY_SCALES).alias("aerial_scale")).where("rail_scale IS NOT NULL OR aerial_scale IS NOT NULL")


def pr05_waterway(s: SparkSession, d: str) -> DataFrame:
    kind = T.tag(TAGS, "waterway")
    area = F.coalesce((T.tag(TAGS, "natural") == "water") | (kind == "riverbank"), T.tag(TAGS, "natural") == "water", kind == "riverbank", F.lit(False))
    return fx.ways(s, d).select("id", T.lookup(kind, T.WATERWAY_SCALES).alias("scale"), F.coalesce(kind.isin("river", "canal"), F.lit(False)).alias("major"), area.alias("is_area")).where("scale IS NOT NULL OR is_area")


def pr06_tunnel_bridge(s: SparkSession, d: str) -> DataFrame:
    return fx.ways(s, d).select("id", T.is_set(T.tag(TAGS, "tunnel")).alias("tunnel"), T.is_set(T.tag(TAGS, "bridge")).alias("bridge"))


def pr07_trails(s: SparkSession, d: str) -> DataFrame:
    return fx.ways(s, d).where(T.tag(TAGS, "highway").isin(*T.TRAILS)).select("id", T.tag(TAGS, "highway").alias("highway"))


# The delivered railways carry their state in the value; the bare-key form is made from it.
def _lived(s: SparkSession, d: str) -> DataFrame:
    kind = T.tag(TAGS, "railway")
    state = F.when(kind.isin("disused", "abandoned", "razed"), F.create_map(kind, F.lit("yes"))).otherwise(F.create_map(F.lit("x"), F.lit("yes")))
    spaced = F.when(T.tag(TAGS, "gauge") == "760", F.create_map(F.lit("historic:railway"), F.lit("rail"))).when(T.tag(TAGS, "gauge") == "1000", F.create_map(F.lit("disused:railway"), F.lit("rail")))
    return fx.ways(s, d).where(kind.isNotNull()).select("id", F.map_concat(state, F.coalesce(spaced, F.create_map(F.lit("y"), F.lit("no")))).alias("tags"))


_LIVED = """SELECT id, CASE WHEN kind = 'razed' OR gauge = '760' THEN 'gone' WHEN kind = 'abandoned' THEN 'abandoned' WHEN kind = 'disused' OR gauge = '1000' THEN 'disused' ELSE 'in_service' END AS state
FROM (SELECT id, tags['railway'] AS kind, coalesce(tags['gauge'], '') AS gauge FROM ways WHERE tags['railway'] IS NOT NULL)"""


def pr08_lifecycle(s: SparkSession, d: str) -> DataFrame:
    return _lived(s, d).select("id", T.lifecycle(TAGS).alias("state"))


def pr09_lifecycle_accepts(s: SparkSession, d: str) -> DataFrame:
    settings = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("setting")
    return _lived(s, d).select("id", T.lifecycle(TAGS).alias("state"), settings).select("id", "setting", T.accepts(F.col("setting"), F.col("state")).alias("drawn"))


def fn09_length_parse(s: SparkSession, d: str) -> DataFrame:
    texts = fx.ways(s, d).select("id", F.explode(F.array(*(T.tag(TAGS, k) for k in ("width", "height", "maxspeed", "gauge")))).alias("text"))
    part = fx.read(s, d, "part").select(F.col("p_partkey").alias("id"), F.explode(F.array(*(F.concat(F.lit(a), F.col("p_size").cast("string"), F.lit(b)) for a, b in (("", " m"), ("~", " ft"), ("", "'6\""), ("", ";3"), ("ca. ", " cm"), ("approx. ", " kilometres"), ("", " inches"), ("", ".5"))))).alias("text"))
    return texts.where("text IS NOT NULL").unionByName(part).select("id", "text", F.round(T.length_m(F.col("text")), 6).alias("metres"))


def fn10_building_height(s: SparkSession, d: str) -> DataFrame:
    return fx.ways(s, d).where(T.tag(TAGS, "building").isNotNull()).select("id", F.round(T.explicit_height_m(TAGS), 6).alias("mapped_m"), F.round(T.building_height_m(TAGS), 6).alias("height_m"))


def x11_width_rules(s: SparkSession, d: str) -> DataFrame:
    """Line widths of roads: mapped width within bounds where there is one, else the class width scaled by density."""
    scale, mapped = T.lookup(T.tag(TAGS, "highway"), T.ROAD_SCALES), T.length_m(T.tag(TAGS, "width"))
    base = F.greatest(scale * 1.2, F.lit(0.4))
    printed = F.when(mapped.isNotNull(), F.least(F.greatest(mapped * 200 / 18000, base), F.greatest(F.lit(6.0), base)))
    return fx.ways(s, d).where(scale.isNotNull()).select("id", F.round(F.coalesce(printed, F.greatest(base * 0.8, F.lit(0.4))), 6).alias("width_mm"))


def x02_rail_counters(s: SparkSession, d: str) -> DataFrame:
    rails = fx.ways(s, d).where(T.tag(TAGS, "railway").isNotNull()).select(T.tag(TAGS, "railway").alias("kind"), T.is_set(T.tag(TAGS, "tunnel")).alias("t"), T.is_set(T.tag(TAGS, "bridge")).alias("b"), T.lookup(T.tag(TAGS, "railway"), T.RAILWAY_SCALES).alias("scale"))
    return rails.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if("t").alias("tunnels"), F.count_if("b").alias("bridges"), F.count("scale").alias("drawn"))


def _case(value: str, scales: dict) -> str:
    return "CASE " + value + " " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in scales.items()) + " END"


_NUM = r"""CASE WHEN regexp_matches({0}, '^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$') THEN TRY_CAST({0} AS DOUBLE) END"""
_PLAIN = r"trim(regexp_replace(lower(trim(text)), '^(~|approx\.|approx|ca\.|ca)\s*', ''))"
_UNITS = " ".join(f"WHEN suffix(t, '{u}') THEN " + _NUM.format(f"trim(t[:length(t) - {len(u)}])") + f" * {v}::DOUBLE" for u, v in T.LENGTH_UNITS)
_LENGTH = f"""CASE WHEN contains(t, ';') THEN NULL WHEN contains(t, '''') THEN ({_NUM.format("trim(split_part(t, '''', 1))")}) * 0.3048::DOUBLE + coalesce({_NUM.format("trim(regexp_replace(trim(t[position('''' IN t) + 1:]), '[\"in]+$', ''))")}, 0) * 0.0254::DOUBLE {_UNITS} ELSE {_NUM.format('t')} END"""
_HEIGHT = "coalesce(" + _NUM.format(r"regexp_extract(trim(tags['height']), '^([0-9.]+)', 1)") + ", " + _NUM.format(r"regexp_extract(trim(tags['building:levels']), '^([0-9.]+)', 1)") + " * 3)"
_CLAMPED = f"CASE WHEN {_HEIGHT} IS NOT NULL THEN least(greatest({_HEIGHT}, 2.5), 200)::DOUBLE END"
_HIGHWAY, _RAILWAY = "tags['highway']", "tags['railway']"
_SET = "coalesce(tags['{0}'] NOT IN ('no', 'false'), false)"

QUERIES = {f.__name__: f for f in (pr02_tag_filter, pr03_road_scale, pr04_rail_scale, pr05_waterway, pr06_tunnel_bridge, pr07_trails, pr08_lifecycle, pr09_lifecycle_accepts, fn09_length_parse, fn10_building_height, x11_width_rules, x02_rail_counters)}
ORACLES = {
    "pr02_tag_filter": with_views("SELECT id, tags['highway'] AS highway, tags['surface'] AS surface FROM ways WHERE tags['surface'] IS NOT NULL AND NOT regexp_matches(tags['surface'], '^(asphalt|concrete)$') AND tags['highway'] IN ('track', 'path', 'footway')", "ways"),
    "pr03_road_scale": with_views(f"SELECT * FROM (SELECT id, {_case(_HIGHWAY, T.ROAD_SCALES)} AS scale FROM ways) WHERE scale IS NOT NULL", "ways"),
    "pr04_rail_scale": with_views("SELECT * FROM (SELECT id, " + _case("tags['railway']", T.RAILWAY_SCALES) + " AS rail_scale, " + _case("tags['aerialway']", T.AERIALWAY_SCALES) + " AS aerial_scale FROM ways) WHERE rail_scale IS NOT NULL OR aerial_scale IS NOT NULL", "ways"),
    "pr05_waterway": with_views("SELECT * FROM (SELECT id, " + _case("tags['waterway']", T.WATERWAY_SCALES) + " AS scale, coalesce(tags['waterway'] IN ('river', 'canal'), false) AS major, coalesce(tags['natural'] = 'water', false) OR coalesce(tags['waterway'] = 'riverbank', false) AS is_area FROM ways) WHERE scale IS NOT NULL OR is_area", "ways"),
    "pr06_tunnel_bridge": with_views(f"SELECT id, {_SET.format('tunnel')} AS tunnel, {_SET.format('bridge')} AS bridge FROM ways", "ways"),
    "pr07_trails": with_views("SELECT id, tags['highway'] AS highway FROM ways WHERE tags['highway'] IN ('track', 'cycleway', 'path', 'footway', 'bridleway', 'steps')", "ways"),
    "pr08_lifecycle": with_views(_LIVED, "ways"),
    "pr09_lifecycle_accepts": with_views(f"SELECT id, setting, CASE state WHEN 'in_service' THEN true WHEN 'disused' THEN setting >= 1 WHEN 'abandoned' THEN setting >= 2 ELSE false END AS drawn FROM ({_LIVED}), (VALUES (0), (1), (2)) v(setting)", "ways"),
    "fn09_length_parse": with_views(f"""WITH texts AS (SELECT id, unnest([tags['width'], tags['height'], tags['maxspeed'], tags['gauge']]) AS text FROM ways UNION ALL
        SELECT p_partkey, unnest([p_size || ' m', '~' || p_size || ' ft', p_size || '''6"', p_size || ';3', 'ca. ' || p_size || ' cm', 'approx. ' || p_size || ' kilometres', p_size || ' inches', p_size || '.5']) FROM part),
        clean AS (SELECT id, text, {_PLAIN} AS t FROM texts WHERE text IS NOT NULL), parsed AS (SELECT id, text, {_LENGTH} AS m FROM clean)
        SELECT id, text, round(CASE WHEN m > 0 THEN m END, 6) AS metres FROM parsed""", "ways"),
    "fn10_building_height": with_views(f"SELECT id, round({_CLAMPED}, 6) AS mapped_m, round(coalesce({_CLAMPED}, 8), 6) AS height_m FROM ways WHERE tags['building'] IS NOT NULL", "ways"),
    "x11_width_rules": with_views(f"""WITH w AS (SELECT id, {_case("tags['highway']", T.ROAD_SCALES)} AS scale, tags['width'] AS text FROM ways), c AS (SELECT *, {_PLAIN} AS t FROM w WHERE scale IS NOT NULL), m AS (SELECT id, greatest(scale * 1.2::DOUBLE, 0.4) AS base, {_LENGTH} AS m FROM c)
        SELECT id, round(coalesce(CASE WHEN m > 0 THEN least(greatest(m * 200 / 18000, base), greatest(6.0::DOUBLE, base)) END, greatest(base * 0.8::DOUBLE, 0.4)), 6) AS width_mm FROM m""", "ways"),
    "x02_rail_counters": with_views(f"SELECT tags['railway'] AS kind, count(*) AS n, count(*) FILTER (WHERE {_SET.format('tunnel')}) AS tunnels, count(*) FILTER (WHERE {_SET.format('bridge')}) AS bridges, count({_case(_RAILWAY, T.RAILWAY_SCALES)}) AS drawn FROM ways WHERE tags['railway'] IS NOT NULL GROUP BY 1", "ways"),
}
