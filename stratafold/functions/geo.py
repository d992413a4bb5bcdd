"""Closed-form map projections, tile addresses and planar geometry as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the map frame.
KM_PER_LATITUDE_DEGREE = 110.574
KM_PER_EQUATOR_DEGREE = 111.32
LEAST_KM_PER_LONGITUDE_DEGREE = 20.0
MERCATOR_LIMIT = 85.05112878
EARTH_CIRCUMFERENCE_M = 40075016.686


def normalize_longitude(lon: Column) -> Column:
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def longitude_scale(lat: Column) -> Column:
    """Kilometres per degree of longitude."""
    return F.greatest(KM_PER_EQUATOR_DEGREE * F.abs(F.cos(F.radians(lat))), F.lit(LEAST_KM_PER_LONGITUDE_DEGREE))


def tile_x(lon: Column, zoom: int) -> Column:
    n = 1 << zoom
    return F.least(F.greatest(F.floor((lon + 180.0) / 360.0 * float(n)), F.lit(0)), F.lit(n - 1)).cast("long")


def _mercator_y(lat: Column) -> Column:
    phi = F.radians(F.least(F.greatest(lat, F.lit(-MERCATOR_LIMIT)), F.lit(MERCATOR_LIMIT)))
    return (1.0 - F.ln(F.tan(phi) + 1.0 / F.cos(phi)) / math.pi) / 2.0


def tile_y(lat: Column, zoom: int) -> Column:
    n = 1 << zoom
    return F.least(F.greatest(F.floor(_mercator_y(lat) * float(n)), F.lit(0)), F.lit(n - 1)).cast("long")


def tile_latitude(y: Column, zoom: int) -> Column:
    return F.degrees(F.atan(F.sinh(math.pi * (1.0 - 2.0 * y / float(1 << zoom)))))


def pixel_x(lon: Column, zoom: int, tile_size: int) -> Column:
    """Pixel column on the whole map at a zoom."""
    total = tile_size << zoom
    return F.pmod(F.floor((lon + 180.0) / 360.0 * float(1 << zoom) * float(tile_size)), F.lit(total)).cast("long")


def pixel_y(lat: Column, zoom: int, tile_size: int) -> Column:
    total = tile_size << zoom
    return F.least(F.greatest(F.floor(_mercator_y(lat) * float(1 << zoom) * float(tile_size)), F.lit(0)), F.lit(total - 1)).cast("long")


def ground_resolution_m(lat: Column, zoom: Column, tile_size: int) -> Column:
    return EARTH_CIRCUMFERENCE_M * F.greatest(F.abs(F.cos(F.radians(lat))), F.lit(0.1)) / (float(tile_size) * F.pow(F.lit(2.0), zoom))


def choose_zoom(lat: Column, resolution_m: Column, tile_size: int, low: int, high: int) -> Column:
    """The least zoom at which a pixel is no larger than ``resolution_m``, within the provider's range."""
    wanted = F.ceil(F.log2(EARTH_CIRCUMFERENCE_M * F.greatest(F.abs(F.cos(F.radians(lat))), F.lit(0.1)) / (float(tile_size) * F.greatest(resolution_m, F.lit(0.1)))))
    return F.least(F.greatest(wanted, F.lit(low)), F.lit(high)).cast("int")


def degree_tile_name(lat: Column, lon: Column, step: int = 3) -> Column:
    """Name of the tile's south-west corner, as in ``N45W123``."""
    south, west = (F.floor(lat / step) * step).cast("int"), (F.floor(lon / step) * step).cast("int")
    return F.format_string("%s%02d%s%03d", F.when(south >= 0, "N").otherwise("S"), F.abs(south), F.when(west >= 0, "E").otherwise("W"), F.abs(west))


def to_uv(lat: Column, lon: Column, center_lat: float, center_lon: float, span_km: float, rotation: float) -> tuple[Column, Column]:
    """Model coordinates (0..1 inside) of a point in a rotated square frame."""
    sine, cosine = math.sin(math.radians(rotation)), math.cos(math.radians(rotation))
    scale = max(KM_PER_EQUATOR_DEGREE * abs(math.cos(math.radians(center_lat))), LEAST_KM_PER_LONGITUDE_DEGREE)
    east = (normalize_longitude(lon - center_lon)) * scale
    north = (lat - center_lat) * KM_PER_LATITUDE_DEGREE
    return (east * cosine - north * sine) / span_km + 0.5, (east * sine + north * cosine) / span_km + 0.5


def from_uv(u: Column, v: Column, center_lat: float, center_lon: float, span_km: float, rotation: float) -> tuple[Column, Column]:
    """Latitude and longitude of model coordinates; the inverse of ``to_uv``."""
    sine, cosine = math.sin(math.radians(rotation)), math.cos(math.radians(rotation))
    scale = max(KM_PER_EQUATOR_DEGREE * abs(math.cos(math.radians(center_lat))), LEAST_KM_PER_LONGITUDE_DEGREE)
    east, north = (u - 0.5) * span_km, (v - 0.5) * span_km
    lat = center_lat + (-east * sine + north * cosine) / KM_PER_LATITUDE_DEGREE
    return lat, normalize_longitude(center_lon + (east * cosine + north * sine) / scale)


def ring_area2(ring: Column) -> Column:
    """Twice the signed area of a ring of points ``x, y``."""
    n = F.size(ring)
    terms = F.transform(ring, lambda p, i: p["x"] * F.element_at(ring, (i + 1) % n + 1)["y"] - F.element_at(ring, (i + 1) % n + 1)["x"] * p["y"])
    return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)


def ring_contains(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd test of a point against a ring."""
    n = F.size(ring)

    def crosses(p: Column, i: Column) -> Column:
        q = F.element_at(ring, (i + n - 1) % n + 1)
        straddles = (p["y"] > y) != (q["y"] > y)
        return F.when(straddles, x < (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"]) + p["x"]).otherwise(F.lit(False))

    return F.size(F.filter(F.transform(ring, crosses), lambda b: b)) % 2 == 1


def area_covers(shell: Column, holes: Column, x: Column, y: Column) -> Column:
    """Inside the shell and in none of the holes."""
    return ring_contains(shell, x, y) & ~F.exists(holes, lambda h: ring_contains(h, x, y))


def segment_distance(x: Column, y: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Distance of a point from a segment."""
    dx, dy = x1 - x0, y1 - y0
    length2 = dx * dx + dy * dy
    t = F.when(length2 > 0, F.least(F.greatest(((x - x0) * dx + (y - y0) * dy) / length2, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    ex, ey = x - (x0 + t * dx), y - (y0 + t * dy)
    return F.sqrt(ex * ex + ey * ey)


def catmull_rom(p0: Column, p1: Column, p2: Column, p3: Column, t: Column) -> Column:
    a = -0.5 * p0 + 1.5 * p1 - 1.5 * p2 + 0.5 * p3
    b = p0 - 2.5 * p1 + 2.0 * p2 - 0.5 * p3
    c = -0.5 * p0 + 0.5 * p2
    return ((a * t + b) * t + c) * t + p1


def catmull_rom_weights(t: Column) -> tuple[Column, ...]:
    """What each of the four points counts for in ``catmull_rom``."""
    return (
        ((-0.5 * t + 1.0) * t - 0.5) * t,
        (1.5 * t - 2.5) * t * t + 1.0,
        ((-1.5 * t + 2.0) * t + 0.5) * t,
        (0.5 * t - 0.5) * t * t,
    )
