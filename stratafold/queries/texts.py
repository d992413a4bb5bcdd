"""Queries of text functions, parsers, hashes and JSON checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafold.functions import hashing, text as X
from stratafold.plans import fixtures as fx
from stratafold.plans.fixtures import with_views


def _text(s: SparkSession, d: str) -> DataFrame:
    return fx.read(s, d, "documents").select("doc_id", "text")


def s09_whole_responses(s: SparkSession, d: str) -> DataFrame:
    """Responses that are whole: one JSON object without a remark."""
    body = fx.read(s, d, "overpass_responses").select("response_id", F.try_parse_json("body_json").alias("v"))
    whole = body.where("is_variant_null(v) = false AND schema_of_variant(v) LIKE 'OBJECT%'")
    return whole.where(F.try_variant_get("v", "$.remark", "string").isNull()).select("response_id")


TRKPT = r'<trkpt lat="([-0-9.]+)" lon="([-0-9.]+)">'


def s14_track_points(s: SparkSession, d: str) -> DataFrame:
    """Track points in texts, in document order; comments are stripped first."""
    clean = _text(s, d).select("doc_id", X.strip_comments(F.col("text")).alias("t"))
    found = clean.select("doc_id", F.posexplode(F.arrays_zip(F.regexp_extract_all("t", F.lit(TRKPT), 1).alias("lat"), F.regexp_extract_all("t", F.lit(TRKPT), 2).alias("lon"))).alias("seq", "p"))
    return found.select("doc_id", "seq", F.expr("try_cast(p.lat AS DOUBLE)").alias("lat"), F.expr("try_cast(p.lon AS DOUBLE)").alias("lon")).where("lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180")


def fn24_collapse(s: SparkSession, d: str) -> DataFrame:
    return fx.read(s, d, "place_search_cache").select("cache_id", F.trim(F.regexp_replace("query", "[ \t\n\r]+", " ")).alias("query"))


def fn25_slug(s: SparkSession, d: str) -> DataFrame:
    return fx.read(s, d, "place_search_cache").select("cache_id", X.slug(F.col("query")).alias("slug"))


def fn26_labels(s: SparkSession, d: str) -> DataFrame:
    rows = fx.read(s, d, "orders").select("o_orderkey", F.floor("o_totalprice").alias("p"))
    return rows.select("o_orderkey", X.elapsed_label(F.col("p") % 20000).alias("elapsed"), X.byte_label(F.col("p") * F.when(F.col("o_orderkey") % 3 == 0, 1).when(F.col("o_orderkey") % 3 == 1, 100).otherwise(100000)).alias("size"))


def fn27_entities(s: SparkSession, d: str) -> DataFrame:
    rows = _text(s, d).select("doc_id", F.replace(F.replace("text", F.lit("e"), F.lit("&amp;lt;")), F.lit("a"), F.lit("&gt;")).alias("t"))
    return rows.select("doc_id", X.decode_entities(F.col("t")).alias("text"))


def fn28_clean(s: SparkSession, d: str) -> DataFrame:
    return _text(s, d).select("doc_id", F.left(X.scrub_controls(F.col("text")), F.lit(80)).alias("head"))


def fn29_canonical_json(s: SparkSession, d: str) -> DataFrame:
    """Whether two maps of the same entries in different order agree, and with one entry changed."""
    k, v = F.col("r_name"), F.col("r_regionkey").cast("string")
    one, two, other = F.create_map(F.lit("a"), v, k, F.lit("x")), F.create_map(k, F.lit("x"), F.lit("a"), v), F.create_map(k, F.lit("y"), F.lit("a"), v)
    return fx.read(s, d, "region").select("r_regionkey", (X.canonical_map(one) == X.canonical_map(two)).alias("same"), (X.canonical_map(one) == X.canonical_map(other)).alias("drifted_same"))


def fn30_tide_levels(s: SparkSession, d: str) -> DataFrame:
    """Offsets of low and high water from mean sea level, null where they are implausible."""
    rows = fx.read(s, d, "events").selectExpr("user_id AS station", "CASE event_type WHEN 'view' THEN 'MSL' WHEN 'click' THEN 'MLLW' WHEN 'purchase' THEN 'MHHW' END AS name", "value / 100 AS level")
    levels = rows.groupBy("station").pivot("name", ["MSL", "MLLW", "MHHW"]).agg(F.max("level"))
    low, high = F.col("MLLW") - F.col("MSL"), F.col("MHHW") - F.col("MSL")
    return levels.select("station", F.when((low >= -20) & (low <= 0), F.round(low, 6)).alias("low"), F.when((high >= 0) & (high <= 20), F.round(high, 6)).alias("high"))


def fn31_ids_and_paths(s: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.when(F.col("export_no") % 4 == 0, "../").when(F.col("export_no") % 4 == 1, "/").otherwise("a/"), F.col("id"), F.when(F.col("export_no") % 3 == 0, "//x").otherwise(".json"))
    return fx.read(s, d, "jobs").select("id", "export_no", path.alias("path")).distinct().select("id", "export_no", X.is_uuid(F.col("id")).alias("uuid"), X.safe_path(F.col("path")).alias("safe"))


def fn32_cutoff(s: SparkSession, d: str) -> DataFrame:
    """Jobs by age class at a fixed day."""
    age = F.datediff(F.lit("2025-01-01").cast("date"), F.to_date("created_at"))
    return fx.read(s, d, "jobs").groupBy(F.when(age <= 30, "month").when(age <= 365, "year").otherwise("older").alias("age")).agg(F.count(F.lit(1)).alias("n"))


def fn33_progress(s: SparkSession, d: str) -> DataFrame:
    return fx.job_events(s, d).selectExpr("event_id", "CAST(10 + progress * 80 DIV 100 AS BIGINT) AS shown")


def x33_setup_names(s: SparkSession, d: str) -> DataFrame:
    return fx.read(s, d, "place_search_cache").select("cache_id", X.valid_name(F.col("query"), 30).alias("valid"))


def pr21_error_class(s: SparkSession, d: str) -> DataFrame:
    return fx.read(s, d, "jobs").select("id", "export_no", "error").distinct().where("error IS NOT NULL").select("id", "export_no", X.classify_error(F.col("error")).alias("kind"), X.piece_of(F.col("error"), 1).alias("piece_row"), X.piece_of(F.col("error"), 2).alias("piece_column"))


def o12_semver(s: SparkSession, d: str) -> DataFrame:
    """The newest of the versions offered by each source."""
    rows = fx.read(s, d, "part").select((F.col("p_partkey") % 20).alias("source"), F.concat(F.lit("v"), F.col("p_size") % 3, F.lit("."), F.col("p_partkey") % 11, F.lit("."), F.col("p_partkey") % 13, F.when(F.col("p_size") % 4 == 0, "-rc1").otherwise("")).alias("version"))
    return rows.groupBy("source").agg(F.max(F.struct(X.semver_key(F.col("version")).alias("k"), "version")).alias("m")).select("source", "m.version")


def fn17_edge_sign(s: SparkSession, d: str) -> DataFrame:
    grid = fx.read(s, d, "part").selectExpr("p_partkey AS id", "p_partkey % 40 AS line", "p_partkey DIV 40 AS segment", "p_size % 2 AS orientation")
    return grid.select("id", hashing.edge_sign(F.lit(20240607), F.col("orientation"), F.col("segment"), F.col("line")).alias("sign"))


def fn18_fingerprint(s: SparkSession, d: str) -> DataFrame:
    return fx.read(s, d, "nation").select("n_nationkey", hashing.fnv1a64(F.col("n_name")).alias("hash"))


def x12_line_style(s: SparkSession, d: str) -> DataFrame:
    """Which layer's style a line takes when layers are folded together."""
    return fx.features(s, d).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'separate' WHEN id % 3 = 1 THEN IF(area % 2 = 0, 'with_roads', 'none') ELSE IF(area % 5 < 3, 'with_rail', 'with_roads') END AS style")


def x14_neighbour(s: SparkSession, d: str) -> DataFrame:
    """Whether each edge line of a tile in a mosaic of 4 by 5 tiles has a neighbour."""
    grid = s.range(0, 20).selectExpr("id DIV 5 AS tile_row", "id % 5 AS tile_column").select("*", F.explode(F.array(*(F.lit(x) for x in ("south", "north", "west", "east")))).alias("side"))
    return grid.selectExpr("tile_row", "tile_column", "side", "CASE side WHEN 'south' THEN tile_row > 0 WHEN 'north' THEN tile_row + 1 < 4 WHEN 'west' THEN tile_column > 0 ELSE tile_column + 1 < 5 END AS neighbour")


def x36_mosaic_spec(s: SparkSession, d: str) -> DataFrame:
    return fx.features(s, d).selectExpr("id", "area * 2D AS width_mm", "area % 7 + 1 AS columns", "area % 5 + 1 AS rows").selectExpr("id", "width_mm * 3 AS width_mm", "columns * 3 AS columns", "rows * 2 AS rows", "round(width_mm * 3 / 4, 6) AS span_km")


_M = "18446744073709551616::UHUGEINT"


def _mul(x: str, k: int) -> str:
    return f"(({x})::UHUGEINT * {k}::UHUGEINT % {_M})"


def _shift(x: str, n: int) -> str:
    return f"xor({x}, {x} // {1 << n}::UHUGEINT)"


QUERIES = {f.__name__: f for f in (s09_whole_responses, s14_track_points, fn24_collapse, fn25_slug, fn26_labels, fn27_entities, fn28_clean, fn29_canonical_json, fn30_tide_levels, fn31_ids_and_paths, fn32_cutoff, fn33_progress, x33_setup_names, pr21_error_class, o12_semver, fn17_edge_sign, fn18_fingerprint, x12_line_style, x14_neighbour, x36_mosaic_spec)}
ORACLES = {
    # The bytes of a plain name, folded; the unsigned result as the signed number of the same bits.
    "fn18_fingerprint": f"WITH h AS (SELECT n_nationkey, list_reduce(list_transform(string_split(n_name, ''), lambda c: ord(c)::UHUGEINT), lambda a, b: xor(a, b) * {hashing.FNV_PRIME}::UHUGEINT % 18446744073709551616::UHUGEINT, {hashing.FNV_OFFSET}::UHUGEINT) AS h FROM nation) SELECT n_nationkey, CASE WHEN h >= 9223372036854775808::UHUGEINT THEN (h::HUGEINT - 18446744073709551616::HUGEINT)::BIGINT ELSE h::BIGINT END AS hash FROM h",
    "s09_whole_responses": "SELECT response_id FROM (SELECT response_id, body_json::JSON AS j FROM overpass_responses WHERE json_valid(body_json) AND json_type(body_json) = 'OBJECT') WHERE coalesce(json_type(j, '$.remark'), 'NULL') = 'NULL'",
    "s14_track_points": "WITH c AS (SELECT doc_id, regexp_replace(text, '(?s)<!--.*?-->', '', 'g') AS t FROM documents), m AS (SELECT doc_id, unnest(regexp_extract_all(t, '<trkpt lat=\"([-0-9.]+)\" lon=\"([-0-9.]+)\">', 1)) AS lat, unnest(regexp_extract_all(t, '<trkpt lat=\"([-0-9.]+)\" lon=\"([-0-9.]+)\">', 2)) AS lon, unnest(range(len(regexp_extract_all(t, '<trkpt lat=\"([-0-9.]+)\" lon=\"([-0-9.]+)\">')))) AS seq FROM c) SELECT doc_id, seq::INT AS seq, TRY_CAST(lat AS DOUBLE) AS lat, TRY_CAST(lon AS DOUBLE) AS lon FROM m WHERE TRY_CAST(lat AS DOUBLE) BETWEEN -90 AND 90 AND TRY_CAST(lon AS DOUBLE) BETWEEN -180 AND 180",
    "fn24_collapse": "SELECT cache_id, trim(regexp_replace(query, '[ \\t\\n\\r]+', ' ', 'g')) AS query FROM place_search_cache",
    "fn25_slug": "WITH p AS (SELECT cache_id, query, regexp_replace(lower(regexp_replace(query, '[^A-Za-z0-9]+', '-', 'g')), '^-+|-+$', '', 'g') AS s FROM place_search_cache) SELECT cache_id, CASE WHEN query IS NULL THEN NULL WHEN s = '' THEN 'label' ELSE regexp_replace(s[:40], '-+$', '') END AS slug FROM p",
    "fn26_labels": """WITH r AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS p FROM orders), q AS (SELECT o_orderkey, p % 20000 AS s, p * CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 100 ELSE 100000 END AS b FROM r)
        SELECT o_orderkey, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm ' || lpad((s % 60)::VARCHAR, 2, '0') || 's' ELSE (s // 3600) || 'h ' || lpad((s // 60 % 60)::VARCHAR, 2, '0') || 'm' END AS elapsed,
        CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN format('{:.1f} KB', round(b / 1024, 1)) WHEN b < 1073741824 THEN format('{:.1f} MB', round(b / 1048576, 1)) ELSE format('{:.1f} GB', round(b / 1073741824, 1)) END AS size FROM q""",
    "fn27_entities": "SELECT doc_id, replace(replace(replace(replace(replace(replace(replace(text, 'e', '&amp;lt;'), 'a', '&gt;'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&amp;', '&') AS text FROM documents",
    "fn28_clean": r"SELECT doc_id, regexp_replace(text, '[\p{Cc}\p{Cf}]', '', 'g')[:80] AS head FROM documents",
    "fn29_canonical_json": "SELECT r_regionkey, true AS same, false AS drifted_same FROM region",
    "fn30_tide_levels": "WITH l AS (SELECT user_id AS station, max(value / 100) FILTER (event_type = 'view') AS msl, max(value / 100) FILTER (event_type = 'click') AS mllw, max(value / 100) FILTER (event_type = 'purchase') AS mhhw FROM events GROUP BY 1) SELECT station, CASE WHEN mllw - msl BETWEEN -20 AND 0 THEN round(mllw - msl, 6) END AS low, CASE WHEN mhhw - msl BETWEEN 0 AND 20 THEN round(mhhw - msl, 6) END AS high FROM l",
    "fn31_ids_and_paths": r"WITH j AS (SELECT DISTINCT id, export_no, CASE export_no % 4 WHEN 0 THEN '../' WHEN 1 THEN '/' ELSE 'a/' END || id || CASE WHEN export_no % 3 = 0 THEN '//x' ELSE '.json' END AS p FROM jobs) SELECT id, export_no, regexp_full_match(id, '[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}') AS uuid, NOT starts_with(p, '/') AND NOT contains(p, '..') AND NOT contains(p, '//') AS safe FROM j",
    "fn32_cutoff": "WITH j AS (SELECT date_diff('day', (created_at AT TIME ZONE 'UTC')::DATE, DATE '2025-01-01') AS a FROM jobs) SELECT CASE WHEN a <= 30 THEN 'month' WHEN a <= 365 THEN 'year' ELSE 'older' END AS age, count(*) AS n FROM j GROUP BY 1",
    "fn33_progress": with_views("SELECT event_id, 10 + progress * 80 // 100 AS shown FROM job_events", "job_events"),
    "x33_setup_names": r"SELECT cache_id, trim(query, ' ') <> '' AND length(trim(query, ' ')) <= 30 AND NOT regexp_matches(trim(query, ' '), '\p{Cc}') AS valid FROM place_search_cache",
    "pr21_error_class": r"""WITH e AS (SELECT DISTINCT id, export_no, error, lower(error) AS l, TRY_CAST(regexp_extract(error, 'build piece\s+(\d+)\s*,\s*(\d+)\s*(?::|$)', 1) AS INT) AS pr, TRY_CAST(regexp_extract(error, 'build piece\s+(\d+)\s*,\s*(\d+)\s*(?::|$)', 2) AS INT) AS pc FROM jobs WHERE error IS NOT NULL)
        SELECT id, export_no, CASE WHEN regexp_matches(l, 'flag marker|flag socket') THEN 'markers' WHEN regexp_matches(l, 'wall mount|wall plate|cleat|mount pocket') THEN 'mounting' WHEN regexp_matches(l, 'openstreetmap|overpass') THEN 'surface' WHEN regexp_matches(l, 'elevation|mapzen|mapterhorn') THEN 'elevation'
        WHEN regexp_matches(l, 'shaped outline|shaped tray') AND regexp_matches(l, 'tray|top-lip') THEN 'tray' WHEN pr IS NULL AND regexp_matches(l, 'outline|super-tile mode') THEN 'outline' WHEN pr IS NOT NULL THEN 'piece' WHEN regexp_matches(l, 'write|output directory|3mf|stl') THEN 'output' ELSE 'other' END AS kind, pr AS piece_row, pc AS piece_column FROM e""",
    "o12_semver": "WITH v AS (SELECT p_partkey % 20 AS source, p_size % 3 AS a, p_partkey % 11 AS b, p_partkey % 13 AS c, p_size % 4 <> 0 AS rel FROM part) SELECT source, 'v' || a || '.' || b || '.' || c || CASE WHEN rel THEN '' ELSE '-rc1' END AS version FROM v QUALIFY row_number() OVER (PARTITION BY source ORDER BY a DESC, b DESC, c DESC, rel DESC) = 1",
    "fn17_edge_sign": f"""WITH g AS (SELECT p_partkey AS id, p_partkey % 40 AS line, p_partkey // 40 AS segment, p_size % 2 AS orientation FROM part),
        s AS (SELECT id, xor(xor(xor(xor({_mul('20240607', hashing.SEED_MULTIPLIER)}, {_mul('orientation', hashing.ORIENTATION_MULTIPLIER)}), {_mul('line', hashing.LINE_MULTIPLIER)}), {_mul('segment', hashing.SEGMENT_MULTIPLIER)}), {7 * hashing.SEED_MULTIPLIER % (1 << 64)}::UHUGEINT) AS v FROM g),
        a AS (SELECT id, {_mul(_shift('v', 30), hashing.MIX_1)} AS v FROM s), b AS (SELECT id, {_mul(_shift('v', 27), hashing.MIX_2)} AS v FROM a), c AS (SELECT id, {_shift('v', 31)} AS v FROM b)
        SELECT id, CASE WHEN (v // {1 << 40}::UHUGEINT)::DOUBLE / 16777215 < 0.5 THEN -1 ELSE 1 END::DOUBLE AS sign FROM c""",
    "x12_line_style": with_views("SELECT id, CASE id % 3 WHEN 0 THEN 'separate' WHEN 1 THEN CASE WHEN area % 2 = 0 THEN 'with_roads' ELSE 'none' END ELSE CASE WHEN area % 5 < 3 THEN 'with_rail' ELSE 'with_roads' END END AS style FROM features", "features"),
    "x14_neighbour": "SELECT r AS tile_row, c AS tile_column, side, CASE side WHEN 'south' THEN r <> 0 WHEN 'north' THEN r <> 3 WHEN 'west' THEN c <> 0 ELSE c <> 4 END AS neighbour FROM range(4) a(r), range(5) b(c), (VALUES ('south'), ('north'), ('west'), ('east')) s(side)",
    "x36_mosaic_spec": with_views("SELECT id, area * 6.0::DOUBLE AS width_mm, (area % 7 + 1) * 3 AS columns, (area % 5 + 1) * 2 AS rows, round(area * 6 / 4, 6) AS span_km FROM features", "features"),
}
