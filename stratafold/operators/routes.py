"""Pipelines over map elements: routes with printed widths, classes and bridge ends, and pavement from areas and centre lines.

Elements are rows with a key, their tags and their points in model coordinates (0..1 inside the model). Everything but the
assembly of a relation's rings is a column expression; the one global number, how densely the routes cover the model, is an
aggregate of one row.

Defined cases. Elements with fewer than two points, in tunnels or without a class have no route. Null tags or points count as
empty. Repeated elements are routes of their own. Bridge ends outside the raster read its border. An empty table gives no
routes and the widest lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafold.functions import geo as G
from stratafold.functions import tags as T
from stratafold.operators import outlines, sampling, spatial

ROAD, ROUTE_TRAIL = 25, 27
# Printed widths in millimetres, the share of the model that routes may cover, and the bounds of their thinning.
LEAST_LINE_MM, MOST_MAPPED_MM, COVERAGE, LEAST_THINNING = 0.4, 6.0, 0.06, 0.35


@dataclass(frozen=True)
class Model:
    """Size of the print, what it spans and the width of a road of scale 1."""

    width_mm: float = 200.0
    height_mm: float = 150.0
    span_km: float = 18.0
    road_mm: float = 1.2


def model_points(points: Column, span_km: float, center_lat: float = 0.0, center_lon: float = 0.0, rotation: float = 0.0) -> Column:
    """An array of ``lat, lon`` as an array of model coordinates ``x, y``."""

    def placed(p: Column) -> Column:
        u, v = G.to_uv(p["lat"], p["lon"], center_lat, center_lon, span_km, rotation)
        return F.struct(u.alias("x"), v.alias("y"))

    return F.transform(points, placed)


def printed_length(points: Column, model: Model) -> Column:
    """Millimetres of a line of model coordinates."""
    steps = F.zip_with(F.slice(points, F.lit(1), F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0))), lambda p, q: F.hypot((q["x"] - p["x"]) * model.width_mm, (q["y"] - p["y"]) * model.height_mm))
    return F.aggregate(steps, F.lit(0.0), lambda total, x: total + F.coalesce(x, F.lit(0.0)))


def routes(elements: DataFrame, key: str, raster: DataFrame, value: str, rows: int, columns: int, model: Model) -> DataFrame:
    """``key, class, width_mm, bridge_from, bridge_to`` of every printable way of ``elements`` (``key, tags, points``).

    A mapped width is printed to scale within bounds; others follow their class and are thinned where routes are dense. Ways on
    bridges carry the elevations of their two ends, sampled from ``raster``.
    """
    tags = F.col("tags")
    scale, mapped = T.lookup(T.tag(tags, "highway"), T.ROAD_SCALES), T.length_m(T.tag(tags, "width"))
    usable = elements.where((F.size("points") >= 2) & ~T.is_set(T.tag(tags, "tunnel")) & scale.isNotNull())
    base = F.greatest(scale * model.road_mm, F.lit(LEAST_LINE_MM))
    to_scale = F.least(F.greatest(mapped * (model.width_mm / (model.span_km * 1000)), base), F.greatest(F.lit(MOST_MAPPED_MM), base))
    drawn = usable.select(
        key,
        F.when(T.tag(tags, "highway").isin(*T.TRAILS), ROUTE_TRAIL).otherwise(ROAD).alias("class"),
        F.coalesce(to_scale, base).alias("full_mm"),
        mapped.isNotNull().alias("mapped"),
        printed_length("points", model).alias("length_mm"),
        F.when(T.is_set(T.tag(tags, "bridge")), F.array(F.element_at("points", 1), F.element_at("points", -1))).alias("ends"),
    )
    covered = F.coalesce(F.sum(F.col("length_mm") * F.col("full_mm")), F.lit(0.0)) / (model.width_mm * model.height_mm)
    thinning = drawn.agg(F.least(F.greatest(COVERAGE / F.greatest(covered, F.lit(COVERAGE)), F.lit(LEAST_THINNING)), F.lit(1.0)).alias("thinning"))
    width = F.when(F.col("mapped"), F.col("full_mm")).otherwise(F.greatest(F.col("full_mm") * F.col("thinning"), F.lit(LEAST_LINE_MM)))
    wide = drawn.join(F.broadcast(thinning)).select(key, "class", width.alias("width_mm"))
    ends = drawn.where("ends IS NOT NULL").select(key, F.posexplode("ends").alias("end", "p")).select(key, "end", F.col("p.x").alias("__u"), F.col("p.y").alias("__v"))
    at = sampling.bilinear(ends, raster, F.col("__v") * (rows - 1), F.col("__u") * (columns - 1), value, rows, columns)
    bridges = at.groupBy(key).agg(F.max(F.when(F.col("end") == 0, F.col("value"))).alias("bridge_from"), F.max(F.when(F.col("end") == 1, F.col("value"))).alias("bridge_to"))
    return wide.join(bridges, key, "left")


_RING = "array<struct<x: double, y: double>>"


def relation_areas(relations: DataFrame, key: str) -> DataFrame:
    """``key, part, shell, holes, dropped`` of relations (``key, members`` with ``member_type, member_role, points``): one row for
    each outer ring that its ways close, with the inner rings that lie in it, or one of a null ``part`` without any.

    ``dropped`` counts the relation's chains that do not close, the same in all its rows. A relation's members are joined in
    one row's work.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ring = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
        points = lambda r: [{"x": x, "y": y} for x, y in r]
        for batch in batches:
            rows = []
            for k, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = {}
                dropped = 0
                for role in ("outer", "inner"):
                    lines = [[(p["x"], p["y"]) for p in m["points"] or [] if p is not None] for m in members or [] if m is not None and m["member_type"] == "way" and m["member_role"] == role]
                    found[role], more = outlines.assemble_rings(lines)
                    dropped += more
                for part, shell in enumerate(found["outer"]):
                    own = [h for h in found["inner"] if outlines.ring_holds(shell, h)]
                    rows.append((k, part, points(shell), [points(h) for h in own], dropped))
                if not found["outer"]:
                    rows.append((k, None, None, None, dropped))
            kinds = (batch.schema.field(0).type, pa.int32(), ring, pa.list_(ring), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=[key, "part", "shell", "holes", "dropped"])

    kind = relations.schema[key].dataType.simpleString()
    return relations.select(key, "members").mapInArrow(run, f"{key} {kind}, part int, shell {_RING}, holes array<{_RING}>, dropped int")


def pavement(elements: DataFrame, key: str, is_area: Column, buckets: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Areas (``area, shell, holes``), lines (``key, covered, mapped``) and one row of counts of the pavement that ``elements``
    (``key, kind, tags, points, members``) draw.

    Relations give the rings their members close. Ways for which ``is_area`` holds are rings of three points at least. Of the other
    ways, a line of which some area covers every point repeats that area and is ``covered``. ``buckets`` is the number of cells a
    side of the finest grid in which lines and areas meet.
    """
    tunnel = T.is_set(T.tag(F.col("tags"), "tunnel"))
    open_ = elements.where(~tunnel)
    relations = relation_areas(open_.where("kind = 'relation'"), key)
    ways = open_.where("kind <> 'relation'").withColumn("is_area", F.coalesce(is_area, F.lit(False)))
    closed = F.element_at("points", 1) == F.try_element_at("points", F.lit(-1))
    ring = F.when(F.coalesce(closed, F.lit(False)), F.slice("points", F.lit(1), F.greatest(F.size("points") - 1, F.lit(0)))).otherwise(F.col("points"))
    rings = ways.where("is_area AND size(points) >= 4").select(key, ring.alias("shell")).where(F.size("shell") >= 3)
    none = F.expr(f"CAST(array() AS array<{_RING}>)")
    areas = relations.where("part IS NOT NULL").select(F.concat_ws(":", key, "part").alias("area"), "shell", "holes").unionByName(rings.select(F.col(key).cast("string").alias("area"), "shell", none.alias("holes")))
    lines = ways.where("NOT is_area AND size(points) >= 2").select(key, "tags", "points")
    spots = lines.select(F.col(key).alias("__line"), F.posexplode("points").alias("__i", "p")).select("__line", "__i", F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    held = spatial.points_in_areas(spots, areas.select("shell", "holes"), buckets, once=True).select("__line", "__i").distinct().groupBy("__line").agg(F.count(F.lit(1)).alias("__held"))
    drawn = lines.join(held, F.col(key) == F.col("__line"), "left").select(key, (F.coalesce("__held", F.lit(0)) == F.size("points")).alias("covered"), T.length_m(T.tag(F.col("tags"), "width")).isNotNull().alias("mapped"))
    # A way that is no ring and no line is invalid, and so is every chain of a relation that does not close.
    invalid = ways.agg(F.count_if(F.when(F.col("is_area"), (F.size("points") < 4) | (F.size(ring) < 3)).otherwise(F.size("points") < 2)).alias("ways"))
    dropped = relations.groupBy(key).agg(F.max("dropped").alias("n"), F.max(F.col("part").isNotNull()).alias("kept"), F.sum(F.coalesce(F.size("holes"), F.lit(0))).alias("holes"))
    of_relations = dropped.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("chains"), F.count_if("kept").alias("relations"), F.coalesce(F.sum("holes"), F.lit(0)).alias("holes"))
    of_lines = drawn.agg(F.count_if(~F.col("covered")).alias("lines"), F.count_if("covered").alias("duplicate_lines"), F.count_if(~F.col("covered") & F.col("mapped")).alias("mapped_widths"), F.count_if(~F.col("covered") & ~F.col("mapped")).alias("fallback_widths"))
    counts = elements.agg(F.count_if(tunnel).alias("tunnel_skipped"))
    for part in (areas.agg(F.count(F.lit(1)).alias("areas")), of_relations, of_lines, invalid):
        counts = counts.join(part)
    return areas, drawn, counts.select("relations", "areas", "holes", "lines", "duplicate_lines", "mapped_widths", "fallback_widths", "tunnel_skipped", (F.col("chains") + F.col("ways")).alias("invalid_skipped"))
