"""Rasters, points, lines, areas and meshes derived from the driver's tables, in Spark and as SQL views of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: SQL view bodies by name; ``with_views`` puts those a query needs, and those they need, before it.
VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    "cells": ("SELECT event_id // 100 AS r, event_id % 100 AS c, value AS z FROM events", ()),
    "class_cells": ("SELECT event_id // 100 AS r, event_id % 100 AS c, CASE event_type WHEN 'view' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 ELSE 0 END AS class FROM events", ()),
    "points": ("SELECT c_custkey AS id, (c_custkey * 7919 % 36000) / 100 - 180 AS lon, (c_custkey * 104729 % 16000) / 100 - 80 AS lat FROM customer", ()),
    "stations": ("SELECT s_suppkey AS id, (s_suppkey * 7919 % 36000) / 100 - 180 AS lon, (s_suppkey * 104729 % 16000) / 100 - 80 AS lat FROM supplier", ()),
    "line_pts": ("SELECT o_custkey AS line, o_orderkey AS seq, (o_orderkey * 7919 % 1000) / 1000 AS x, (o_orderkey * 104729 % 1000) / 1000 AS y FROM orders", ()),
    "areas": ("SELECT n_nationkey::BIGINT AS id, (n_nationkey * 7 % 25) / 25 + 0.0213 AS cx, (n_nationkey * 11 % 25) / 25 + 0.0213 AS cy, 0.06::DOUBLE AS h, CASE WHEN n_nationkey % 2 = 0 THEN 0.02::DOUBLE END AS hole_h, (n_nationkey % 4)::BIGINT AS class, 2.5 + n_regionkey * 10.0::DOUBLE AS height FROM nation", ()),
    "spots": ("SELECT id, (id * 7919 % 997) / 997 AS x, (id * 104729 % 991) / 991 AS y FROM points", ("points",)),
    "pixels": ("SELECT vec_id AS id, CAST(round((embedding[1]::DOUBLE + 0.5) * 3000) AS BIGINT) AS red, CAST(round((embedding[2]::DOUBLE + 0.5) * 3000) AS BIGINT) AS green, CAST(round((embedding[3]::DOUBLE + 0.5) * 3000) AS BIGINT) AS blue, (label % 4)::BIGINT AS grp, vec_id % 17 <> 0 AS valid FROM embeddings", ()),
    "tris": ("""SELECT r * 200 + c * 2 + k AS tid, r * 100 + c AS a, CASE WHEN k = 0 THEN r * 100 + c + 1 ELSE (r + 1) * 100 + c + 1 END AS b,
        CASE WHEN k = 0 THEN (r + 1) * 100 + c + 1 ELSE (r + 1) * 100 + c END AS d, class AS material
        FROM class_cells, (VALUES (0), (1)) t(k) WHERE c < 99 AND r < (SELECT max(r) FROM class_cells)""", ("class_cells",)),
    "verts": ("SELECT r * 100 + c AS vid, c::DOUBLE AS x, r::DOUBLE AS y, z FROM cells", ("cells",)),
    "grown": ("SELECT l_returnflag AS type, l_partkey AS id, CAST(l_quantity AS BIGINT) AS richness, l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_shipdate, l_discount, l_tax FROM lineitem", ()),
    "features": ("SELECT p_partkey AS id, p_size::BIGINT AS area, p_type LIKE 'LARGE%' AS major FROM part", ()),
    "timings": ("SELECT l_partkey AS piece, l_linestatus AS phase, CAST(floor(l_extendedprice) AS BIGINT) AS us FROM lineitem", ()),
    "job_rows": ("SELECT o_orderkey AS id, o_custkey AS key, o_orderstatus AS status, o_orderdate AS created_at FROM orders", ()),
    "job_events": ("SELECT event_id, user_id AS key, ts, CAST(floor(value) AS BIGINT) % 101 AS progress, event_type AS kind FROM events", ()),
    "ways": ("SELECT delivery_id AS id, tags, geometry, members FROM overpass_ways", ()),
}


#: Corners of a concave outline and of a hole in it, in eighths of a blob's size.
STAR = ((0, 8), (3, 3), (8, 2), (4, -2), (5, -8), (0, -4), (-5, -8), (-4, -2), (-8, 2), (-3, 3))
HOLE = ((0, 2), (2, 0), (0, -2), (-2, 0))


def _edge_values() -> str:
    rows = [(ring, *at, *corners[i - 1]) for ring, corners in enumerate((STAR, HOLE)) for i, at in enumerate(corners)]
    return ", ".join(f"({ring}, {ax / 8}::DOUBLE, {ay / 8}::DOUBLE, {bx / 8}::DOUBLE, {by / 8}::DOUBLE)" for ring, ax, ay, bx, by in rows)


VIEWS |= {
    # Concave areas with holes, as many as there are suppliers: one tenth of a per cent of the square each.
    "blobs": ("SELECT s_suppkey AS id, (s_suppkey * 7919 % 997) / 997 AS cx, (s_suppkey * 104729 % 991) / 991 AS cy, 0.006::DOUBLE + (s_suppkey % 7) * 0.004::DOUBLE AS s, (s_suppkey % 5)::BIGINT AS kind, 2.5::DOUBLE + (s_suppkey % 4) * 10.0::DOUBLE AS height FROM supplier", ()),
    "blob_edges": (f"SELECT b.id, ring, cx + s * ax AS ax, cy + s * ay AS ay, cx + s * bx AS bx, cy + s * by_ AS by_ FROM blobs b, (VALUES {_edge_values()}) e(ring, ax, ay, bx, by_) WHERE ring = 0 OR b.id % 3 = 0", ("blobs",)),
    # Short lines of two segments, one for each customer.
    "paths": ("SELECT id, (id % 9)::INT AS layer, 0.001::DOUBLE + (id % 3) * 0.0005::DOUBLE AS half, x AS x0, y AS y0, x + (id % 11 - 5) / 200 AS x1, y + (id % 13 - 6) / 200 AS y1, x + (id % 11 - 5) / 200 + (id % 7 - 3) / 200 AS x2, y + (id % 13 - 6) / 200 + (id % 5 - 2) / 200 AS y2 FROM spots", ("spots",)),
    "path_parts": ("SELECT id, layer, half, 0 AS seg, x0, y0, x1, y1 FROM paths UNION ALL SELECT id, layer, half, 1, x1, y1, x2, y2 FROM paths", ("paths",)),
}


def with_views(body: str, *names: str) -> str:
    ordered: dict[str, str] = {}

    def add(name: str) -> None:
        text, needs = VIEWS[name]
        for need in needs:
            add(need)
        ordered.setdefault(name, text)

    for name in names:
        add(name)
    head = ", ".join(f"{n} AS ({t})" for n, t in ordered.items())
    body = body.strip()
    return f"WITH {head}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head} {body}"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def cells(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "events").selectExpr("event_id DIV 100 AS r", "event_id % 100 AS c", "value AS z")


def class_cells(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "events").selectExpr("event_id DIV 100 AS r", "event_id % 100 AS c", "CASE event_type WHEN 'view' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 ELSE 0 END AS class")


def _lonlat(df: DataFrame, key: str) -> DataFrame:
    return df.selectExpr(f"{key} AS id", f"({key} * 7919 % 36000) / 100D - 180 AS lon", f"({key} * 104729 % 16000) / 100D - 80 AS lat")


def points(s: SparkSession, d: str) -> DataFrame:
    return _lonlat(read(s, d, "customer"), "c_custkey")


def stations(s: SparkSession, d: str) -> DataFrame:
    return _lonlat(read(s, d, "supplier"), "s_suppkey")


def spots(s: SparkSession, d: str) -> DataFrame:
    """Points in the unit square."""
    return points(s, d).selectExpr("id", "(id * 7919 % 997) / 997D AS x", "(id * 104729 % 991) / 991D AS y")


def line_pts(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "orders").selectExpr("o_custkey AS line", "o_orderkey AS seq", "(o_orderkey * 7919 % 1000) / 1000D AS x", "(o_orderkey * 104729 % 1000) / 1000D AS y")


def areas(s: SparkSession, d: str) -> DataFrame:
    """Square shells, every other one with a square hole."""
    return read(s, d, "nation").selectExpr("CAST(n_nationkey AS BIGINT) AS id", "(n_nationkey * 7 % 25) / 25D + 0.0213D AS cx", "(n_nationkey * 11 % 25) / 25D + 0.0213D AS cy", "0.06D AS h", "IF(n_nationkey % 2 = 0, 0.02D, NULL) AS hole_h", "CAST(n_nationkey % 4 AS BIGINT) AS class", "2.5D + n_regionkey * 10D AS height")


def area_rings(s: SparkSession, d: str) -> DataFrame:
    """``areas`` with their shell and holes as rings of points."""

    def ring(h: str) -> str:
        corners = ", ".join(f"named_struct('x', cx {sx} {h}, 'y', cy {sy} {h})" for sx, sy in (("-", "-"), ("+", "-"), ("+", "+"), ("-", "+")))
        return f"array({corners})"

    return areas(s, d).selectExpr("id", "class", "height", f"{ring('h')} AS shell", f"IF(hole_h IS NULL, array(), array({ring('hole_h')})) AS holes")


def pixels(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "embeddings").selectExpr("vec_id AS id", *(f"CAST(round((CAST(embedding[{i}] AS DOUBLE) + 0.5D) * 3000) AS BIGINT) AS {n}" for i, n in enumerate(("red", "green", "blue"))), "CAST(label % 4 AS BIGINT) AS grp", "vec_id % 17 <> 0 AS valid")


def tris(s: SparkSession, d: str) -> DataFrame:
    base = class_cells(s, d)
    last = base.agg(F.max("r").alias("last_r"))
    corners = base.join(F.broadcast(last), F.col("r") < F.col("last_r")).where("c < 99").select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    return corners.selectExpr("r * 200 + c * 2 + k AS tid", "r * 100 + c AS a", "IF(k = 0, r * 100 + c + 1, (r + 1) * 100 + c + 1) AS b", "IF(k = 0, (r + 1) * 100 + c + 1, (r + 1) * 100 + c) AS d", "class AS material")


def verts(s: SparkSession, d: str) -> DataFrame:
    return cells(s, d).selectExpr("r * 100 + c AS vid", "CAST(c AS DOUBLE) AS x", "CAST(r AS DOUBLE) AS y", "z")


def grown(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "lineitem").selectExpr("l_returnflag AS type", "l_partkey AS id", "CAST(l_quantity AS BIGINT) AS richness", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_shipdate", "l_discount", "l_tax")


def features(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "part").selectExpr("p_partkey AS id", "CAST(p_size AS BIGINT) AS area", "p_type LIKE 'LARGE%' AS major")


def timings(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "lineitem").selectExpr("l_partkey AS piece", "l_linestatus AS phase", "CAST(floor(l_extendedprice) AS BIGINT) AS us")


def job_rows(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "orders").selectExpr("o_orderkey AS id", "o_custkey AS key", "o_orderstatus AS status", "o_orderdate AS created_at")


def job_events(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "events").selectExpr("event_id", "user_id AS key", "ts", "CAST(floor(value) AS BIGINT) % 101 AS progress", "event_type AS kind")


def ways(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "overpass_ways").selectExpr("delivery_id AS id", "tags", "geometry", "members")


def blob_rings(s: SparkSession, d: str) -> DataFrame:
    """Concave areas, every third with a hole: ``id, cx, cy, s, kind, height, shell, holes``."""

    def ring(corners: tuple) -> str:
        return "array(" + ", ".join(f"named_struct('x', cx + s * {x / 8}D, 'y', cy + s * {y / 8}D)" for x, y in corners) + ")"

    base = read(s, d, "supplier").selectExpr("s_suppkey AS id", "(s_suppkey * 7919 % 997) / 997D AS cx", "(s_suppkey * 104729 % 991) / 991D AS cy", "0.006D + (s_suppkey % 7) * 0.004D AS s", "CAST(s_suppkey % 5 AS BIGINT) AS kind", "2.5D + (s_suppkey % 4) * 10D AS height")
    return base.selectExpr("*", f"{ring(STAR)} AS shell", f"IF(id % 3 = 0, array({ring(HOLE)}), array()) AS holes")


def paths(s: SparkSession, d: str) -> DataFrame:
    """Short lines as ``id, layer, half, points``."""
    ends = spots(s, d).selectExpr("id", "CAST(id % 9 AS INT) AS layer", "0.001D + (id % 3) * 0.0005D AS half", "x AS x0", "y AS y0", "x + (id % 11 - 5) / 200D AS x1", "y + (id % 13 - 6) / 200D AS y1")
    return ends.selectExpr("id", "layer", "half", "array(named_struct('x', x0, 'y', y0), named_struct('x', x1, 'y', y1), named_struct('x', x1 + (id % 7 - 3) / 200D, 'y', y1 + (id % 5 - 2) / 200D)) AS points")


def path_parts(s: SparkSession, d: str) -> DataFrame:
    at = lambda i, c: F.element_at("points", F.col("seg") + i)[c]
    return paths(s, d).withColumn("seg", F.explode(F.array(F.lit(0), F.lit(1)))).select("id", "layer", "half", "seg", at(1, "x").alias("x0"), at(1, "y").alias("y0"), at(2, "x").alias("x1"), at(2, "y").alias("y1"))
