"""Mesh topology and measures on triangle tables (``tid, a, b, d, material``) and vertex tables (``vid, x, y, z``).

Edges, faces and welds are keyed by integers or quantised coordinates, so each operator is one grouped shuffle; the vertex
table joins by id and is never collected.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CORNERS = ("a", "b", "d")


def edges(triangles: DataFrame) -> DataFrame:
    """Directed edges with their undirected key: ``tid, u, v, forward``."""
    pairs = F.explode(F.array(*(F.struct(F.col(p).alias("p"), F.col(q).alias("q")) for p, q in (("a", "b"), ("b", "d"), ("d", "a")))))
    return triangles.select("tid", pairs.alias("e")).select("tid", F.least("e.p", "e.q").alias("u"), F.greatest("e.p", "e.q").alias("v"), (F.col("e.p") < F.col("e.q")).alias("forward"))


def edge_defects(triangles: DataFrame) -> DataFrame:
    """Counts of edges: all, open (used once), overused (more than twice), misoriented (one direction twice)."""
    used = edges(triangles).groupBy("u", "v").agg(F.count(F.lit(1)).alias("n"), F.count_if("forward").alias("f"))
    return used.agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("n") == 1).alias("open"), F.count_if(F.col("n") > 2).alias("overused"), F.count_if((F.col("f") > 1) | (F.col("n") - F.col("f") > 1)).alias("misoriented"))


def with_corners(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    for k in CORNERS:
        triangles = triangles.join(vertices.select(F.col("vid").alias(k), F.struct("x", "y", "z").alias(f"p{k}")), k)
    return triangles


def _cross() -> tuple:
    e = {(k, c): F.col(f"p{k}.{c}") - F.col(f"pa.{c}") for k in ("b", "d") for c in "xyz"}
    return tuple(e["b", p] * e["d", q] - e["b", q] * e["d", p] for p, q in (("y", "z"), ("z", "x"), ("x", "y")))


def measures(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    """Triangles, area and signed volume by material."""
    nx, ny, nz = _cross()
    area = F.sqrt(nx * nx + ny * ny + nz * nz) / 2
    a, b, d = (tuple(F.col(f"p{k}.{c}") for c in "xyz") for k in CORNERS)
    volume = (a[0] * (b[1] * d[2] - b[2] * d[1]) + a[1] * (b[2] * d[0] - b[0] * d[2]) + a[2] * (b[0] * d[1] - b[1] * d[0])) / 6
    return with_corners(triangles, vertices).groupBy("material").agg(F.count(F.lit(1)).alias("triangles"), F.sum(area).alias("area"), F.sum(volume).alias("volume"))


def normals(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    nx, ny, nz = _cross()
    length = F.sqrt(nx * nx + ny * ny + nz * nz)
    unit = [F.when(length > 0, c / length).otherwise(0.0).alias(n) for c, n in ((nx, "nx"), (ny, "ny"), (nz, "nz"))]
    return with_corners(triangles, vertices).select("tid", *unit, (length / 2).alias("area"))


def _canonical() -> Column:
    """The corners turned so that the least comes first; the winding stays."""
    return F.when((F.col("a") <= F.col("b")) & (F.col("a") <= F.col("d")), F.struct(F.col("a").alias("p"), F.col("b").alias("q"), F.col("d").alias("s"))).when((F.col("b") <= F.col("a")) & (F.col("b") <= F.col("d")), F.struct(F.col("b").alias("p"), F.col("d").alias("q"), F.col("a").alias("s"))).otherwise(F.struct(F.col("d").alias("p"), F.col("a").alias("q"), F.col("b").alias("s")))


def duplicate_faces(triangles: DataFrame) -> DataFrame:
    """Per set of corners used more than once: faces, and how many run each way round."""
    faces = triangles.withColumn("turn", _canonical()).select(F.sort_array(F.array(*CORNERS)).alias("corners"), (F.col("turn.q") < F.col("turn.s")).alias("one_way"))
    return faces.groupBy("corners").agg(F.count(F.lit(1)).alias("faces"), F.count_if("one_way").alias("one_way")).where("faces > 1")


def weld(triangles: DataFrame, vertices: DataFrame, decimals: int = 5) -> tuple[DataFrame, DataFrame]:
    """Vertices merged where their rounded coordinates agree (the first index stays), degenerate faces and repeats of one
    winding dropped, vertices numbered densely by first index: the new triangles and vertices."""
    key = [(F.round(F.col(c), decimals) + 0.0).alias(f"q{c}") for c in "xyz"]
    first = Window.partitionBy("qx", "qy", "qz")
    mapped = vertices.select("vid", "x", "y", "z", *key).withColumn("keep", F.min("vid").over(first)).drop("qx", "qy", "qz")
    to = mapped.select("vid", "keep")
    for k in CORNERS:
        triangles = triangles.join(to.select(F.col("vid").alias(k), F.col("keep").alias(f"k{k}")), k).drop(k).withColumnRenamed(f"k{k}", k)
    whole = triangles.where("a <> b AND b <> d AND d <> a").withColumn("turn", _canonical())
    faces = whole.groupBy("turn").agg(F.min(F.struct("tid", "a", "b", "d", "material")).alias("f")).select("f.*")
    kept = mapped.where("vid = keep").select("vid", "x", "y", "z")
    return faces, kept


def _fans(key: tuple, table: pa.Table) -> pa.Table:
    """Components of the faces around one vertex, hanging together by a shared other corner."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for p, q in zip(table.column("p").to_pylist(), table.column("q").to_pylist()):
        parent[root(p)] = root(q)
    return pa.table({"vid": [key[0].as_py()], "fans": pa.array([len({root(x) for x in parent})], pa.int32())})


def vertex_fans(triangles: DataFrame) -> DataFrame:
    """``vid, fans`` of vertices whose faces fall into more than one fan (a group is one vertex's faces)."""
    spread = F.explode(F.array(*(F.struct(F.col(v).alias("vid"), F.col(p).alias("p"), F.col(q).alias("q")) for v, p, q in (("a", "b", "d"), ("b", "d", "a"), ("d", "a", "b")))))
    return triangles.select(spread.alias("s")).select("s.*").groupBy("vid").applyInArrow(_fans, "vid long, fans int").where("fans > 1")


def grid_triangles(cells: DataFrame, columns: int) -> DataFrame:
    """Two triangles for each square of neighbouring cells of a dense raster."""
    here = cells.select((F.col("r") * columns + F.col("c")).alias("p0"), "r", "c")
    size = cells.agg(F.max("r").alias("last_r"), F.max("c").alias("last_c"))
    squares = here.join(F.broadcast(size)).where("r < last_r AND c < last_c")
    two = F.explode(F.array(F.struct(F.col("p0").alias("a"), (F.col("p0") + 1).alias("b"), (F.col("p0") + columns + 1).alias("d")), F.struct(F.col("p0").alias("a"), (F.col("p0") + columns + 1).alias("b"), (F.col("p0") + columns).alias("d"))))
    return squares.select(two.alias("t")).select("t.*")
