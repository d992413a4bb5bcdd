"""Queries of the nested-record, delivery and schema-drift operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafold.operators import deliveries, schema_drift, shredding
from stratafold.session import few_splits

POINT_PATH = "elements[].members[].geometry[].lat"
POSITIONS = ("element_pos", "member_pos", "point_pos")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    responses = read(spark, sf_dir, "overpass_responses")
    return shredding.structure(responses, "response_id", "body_json", POINT_PATH, POSITIONS, few_splits(responses))


def p1_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = ["elements[].id", "elements[].type"]
    shredded = shredding.shred(read(spark, sf_dir, "overpass_responses"), "response_id", "body_json", paths)
    return shredding.assemble(shredded, "response_id", paths, paths, 1, POSITIONS[:1], ("element_id", "element_type")).withColumn("element_id", F.expr("try_cast(element_id AS BIGINT)"))


def p1_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = ["elements[].members[].ref", "elements[].members[].type", "elements[].members[].role"]
    shredded = shredding.shred(read(spark, sf_dir, "overpass_responses"), "response_id", "body_json", paths)
    return shredding.assemble(shredded, "response_id", paths, paths, 2, POSITIONS[:2], ("member_ref", "member_type", "member_role")).withColumn("member_ref", F.expr("try_cast(member_ref AS BIGINT)"))


def p1_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = ["elements[].members[].geometry[].lat", "elements[].members[].geometry[].lon"]
    shredded = shredding.shred(read(spark, sf_dir, "overpass_responses"), "response_id", "body_json", paths)
    return shredding.assemble(shredded, "response_id", paths, paths, 3, POSITIONS, ("lat", "lon")).withColumns({c: F.expr(f"try_cast({c} AS DOUBLE)") for c in ("lat", "lon")})


def _identifier() -> list:
    kind = F.lower(F.trim("element_type"))
    return [F.when(kind.isNull() | (kind == ""), "way").otherwise(kind), F.when(F.col("id") != 0, F.col("id"))]


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deliveries.surplus_deliveries(read(spark, sf_dir, "overpass_ways"), "delivery_id", _identifier())


def p3_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "overpass_ways").select("delivery_id", "element_type", "id", "batch_no", "tile_key")
    return deliveries.deduplicate(rows, "delivery_id", _identifier())


DRIFT_TABLES = ("jobs", "saved_setups", "saved_setup_versions")


def _specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [read(spark, sf_dir, t).select(F.lit(t).alias("table_name"), "export_no", "id", "spec_json") for t in DRIFT_TABLES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_drift.report(_specs(spark, sf_dir), "table_name", "export_no", "id", "spec_json")


def p4_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = schema_drift.inventory(_specs(spark, sf_dir), "table_name", "export_no", "spec_json").where("field <> ''")
    return found.select("table_name", F.col("file_no").cast("int").alias("export_no"), "field", "types")


def _unified(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    specs = _specs(spark, sf_dir).where(F.col("table_name") == table)
    drift = schema_drift.compare_files(specs, "table_name", "export_no", "id", "spec_json")
    keep = ["table_name", "export_no", "id"]
    return schema_drift.unify(specs, drift[table], "export_no", "spec_json", keep) if drift else specs.select(*keep)


def p4_unified_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unified(spark, sf_dir, "jobs")


def p4_unified_setups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unified(spark, sf_dir, "saved_setups")


def p4_unified_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unified(spark, sf_dir, "saved_setup_versions")


_TREE = """
WITH b AS (SELECT response_id, body_json::JSON AS j FROM overpass_responses WHERE json_valid(body_json) AND json_type(body_json) = 'OBJECT'),
e0 AS (SELECT response_id, json_extract(j, '$.elements') AS l FROM b WHERE json_type(j, '$.elements') = 'ARRAY'),
e1 AS (SELECT response_id, l, UNNEST(range(0, json_array_length(l)::BIGINT)) AS element_pos FROM e0),
e AS (SELECT response_id, element_pos::INT AS element_pos, json_extract(l, '$[' || element_pos || ']') AS v FROM e1 WHERE json_type(l, '$[' || element_pos || ']') <> 'NULL'),
m1 AS (SELECT response_id, element_pos, json_extract(v, '$.members') AS l, UNNEST(range(0, json_array_length(v, '$.members')::BIGINT)) AS member_pos FROM e WHERE json_type(v, '$.members') = 'ARRAY'),
m AS (SELECT response_id, element_pos, member_pos::INT AS member_pos, json_extract(l, '$[' || member_pos || ']') AS v FROM m1 WHERE json_type(l, '$[' || member_pos || ']') <> 'NULL'),
g1 AS (SELECT response_id, element_pos, member_pos, json_extract(v, '$.geometry') AS l, UNNEST(range(0, json_array_length(v, '$.geometry')::BIGINT)) AS point_pos FROM m WHERE json_type(v, '$.geometry') = 'ARRAY'),
g AS (SELECT response_id, element_pos, member_pos, point_pos::INT AS point_pos, json_extract(l, '$[' || point_pos || ']') AS v FROM g1 WHERE json_type(l, '$[' || point_pos || ']') <> 'NULL')
"""

_FIRST = """
WITH d AS (SELECT *, row_number() OVER (PARTITION BY CASE WHEN trim(element_type) IS NULL OR trim(element_type) = '' THEN 'way' ELSE lower(trim(element_type)) END, id ORDER BY delivery_id) AS rn FROM overpass_ways WHERE id <> 0)
"""

_FIELDS = """
WITH d AS (SELECT 'jobs' AS table_name, export_no, id, spec_json FROM jobs UNION ALL SELECT 'saved_setups', export_no, id, spec_json FROM saved_setups UNION ALL SELECT 'saved_setup_versions', export_no, id, spec_json FROM saved_setup_versions),
o AS (SELECT DISTINCT table_name, export_no, id, spec_json::JSON AS j FROM d WHERE json_valid(spec_json) AND json_type(spec_json) = 'OBJECT'),
t AS (SELECT o.table_name, o.export_no, o.id, substr(t.fullkey, 3) AS place, t.type AS kind, t.value AS val FROM o, json_tree(o.j) AS t WHERE t.fullkey <> '$'),
f AS (SELECT table_name, export_no, regexp_replace(place, '\\[[0-9]+\\]', '[]', 'g') AS field, bit_or(CASE kind WHEN 'VARCHAR' THEN 1 WHEN 'BOOLEAN' THEN 4 WHEN 'OBJECT' THEN 8 WHEN 'ARRAY' THEN 16 WHEN 'NULL' THEN 0 ELSE 2 END)::INT AS types
  FROM t WHERE NOT ends_with(place, ']') GROUP BY ALL)
"""
_CHANGES = _FIELDS + """,
files AS (SELECT table_name, export_no, lag(export_no) OVER (PARTITION BY table_name ORDER BY export_no) AS before FROM (SELECT DISTINCT table_name, export_no FROM d)),
gone AS (SELECT p.table_name, p.export_no, f.field FROM files p JOIN f ON f.table_name = p.table_name AND f.export_no = p.before ANTI JOIN f g ON g.table_name = p.table_name AND g.export_no = p.export_no AND g.field = f.field),
come AS (SELECT p.table_name, p.export_no, f.field FROM files p JOIN f ON f.table_name = p.table_name AND f.export_no = p.export_no ANTI JOIN f g ON g.table_name = p.table_name AND g.export_no = p.before AND g.field = f.field WHERE p.before IS NOT NULL),
shared AS (SELECT DISTINCT p.table_name, p.export_no, p.before, o.id FROM files p JOIN o ON o.table_name = p.table_name AND o.export_no = p.export_no SEMI JOIN o q ON q.table_name = p.table_name AND q.export_no = p.before AND q.id = o.id),
leaf AS (SELECT table_name, export_no, id, place, CASE WHEN kind IN ('VARCHAR', 'BOOLEAN', 'NULL', 'OBJECT', 'ARRAY') THEN val::VARCHAR ELSE (val::DOUBLE)::VARCHAR END AS val FROM t WHERE (kind NOT IN ('OBJECT', 'ARRAY') OR val::VARCHAR IN ('{}', '[]')) AND (kind <> 'NULL' OR ends_with(place, ']'))),
cut AS (SELECT *, unnest(list_filter(range(1, length(place) + 1), lambda i: i = length(place) OR place[i + 1] = '.' OR place[i + 1] = '[')) AS n FROM leaf),
part AS (SELECT table_name, export_no, id, regexp_replace(place[1:n], '\\[[0-9]+\\]', '[]', 'g') AS field, array_to_string(regexp_extract_all(place[1:n], '\\[[0-9]+\\]'), '') || place[n + 1:] || '=' || val AS held FROM cut WHERE place[n] <> ']'),
own AS (SELECT table_name, export_no, id, field, string_agg(held, chr(31) ORDER BY held) AS sig FROM part GROUP BY ALL),
olds AS (SELECT g.table_name, g.export_no, g.field, string_agg(s.id || chr(30) || own.sig, chr(29) ORDER BY s.id) AS sig FROM gone g JOIN shared s USING (table_name, export_no) JOIN own ON own.table_name = g.table_name AND own.export_no = s.before AND own.id = s.id AND own.field = g.field GROUP BY ALL),
news AS (SELECT c.table_name, c.export_no, c.field, string_agg(s.id || chr(30) || own.sig, chr(29) ORDER BY s.id) AS sig FROM come c JOIN shared s USING (table_name, export_no) JOIN own ON own.table_name = c.table_name AND own.export_no = c.export_no AND own.id = s.id AND own.field = c.field GROUP BY ALL),
renamed AS (SELECT table_name, export_no, olds.field, news.field AS new_field FROM olds JOIN news USING (table_name, export_no, sig))
SELECT table_name, export_no, 'renamed' AS change, field, new_field FROM renamed
UNION ALL SELECT table_name, export_no, 'removed', field, '' FROM gone ANTI JOIN renamed USING (table_name, export_no, field)
UNION ALL SELECT table_name, export_no, 'added', field, '' FROM come ANTI JOIN renamed r ON r.table_name = come.table_name AND r.export_no = come.export_no AND r.new_field = come.field
UNION ALL SELECT p.table_name, p.export_no, 'type_changed', f.field, '' FROM files p JOIN f ON f.table_name = p.table_name AND f.export_no = p.export_no JOIN f g ON g.table_name = p.table_name AND g.export_no = p.before AND g.field = f.field WHERE f.types <> g.types
"""

QUERIES = {"p1_found": p1_found, "p1_elements": p1_elements, "p1_members": p1_members, "p1_points": p1_points, "p3_found": p3_found, "p3_kept": p3_kept, "p4_found": p4_found, "p4_fields": p4_fields, "p4_unified_jobs": p4_unified_jobs, "p4_unified_setups": p4_unified_setups, "p4_unified_versions": p4_unified_versions}
ORACLES = {
    "p1_found": _TREE + "SELECT response_id, element_pos, -1::INT AS member_pos, -1::INT AS point_pos FROM e UNION ALL SELECT response_id, element_pos, member_pos, -1::INT FROM m UNION ALL SELECT response_id, element_pos, member_pos, point_pos FROM g",
    "p1_elements": _TREE + "SELECT response_id, element_pos, TRY_CAST(json_extract_string(v, '$.id') AS BIGINT) AS element_id, json_extract_string(v, '$.type') AS element_type FROM e",
    "p1_members": _TREE + "SELECT response_id, element_pos, member_pos, TRY_CAST(json_extract_string(v, '$.ref') AS BIGINT) AS member_ref, json_extract_string(v, '$.type') AS member_type, json_extract_string(v, '$.role') AS member_role FROM m",
    "p1_points": _TREE + "SELECT response_id, element_pos, member_pos, point_pos, TRY_CAST(json_extract_string(v, '$.lat') AS DOUBLE) AS lat, TRY_CAST(json_extract_string(v, '$.lon') AS DOUBLE) AS lon FROM g",
    "p4_fields": _FIELDS + "SELECT table_name, export_no, field, types FROM f",
    "p4_found": _CHANGES,
    "p3_found": _FIRST + "SELECT delivery_id FROM d WHERE rn > 1",
    "p3_kept": _FIRST + "SELECT delivery_id, element_type, id, batch_no, tile_key FROM d WHERE rn = 1",
}
