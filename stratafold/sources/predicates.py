"""What each layer asks the map source for: tag patterns, negated tags and boxes, as filters that a scan can push down."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratafold.functions import tags as T


@dataclass(frozen=True)
class Asked:
    """A key whose value matches a pattern, with no key of ``without`` having one of its values."""

    key: str
    pattern: str = ".+"
    without: tuple[tuple[str, str], ...] = ()


def any_of(values: Sequence[str]) -> str:
    return "^(" + "|".join(values) + ")$"


LAYERS = {
    "roads": (Asked("highway", any_of([k for k in T.ROAD_SCALES if k not in T.TRAILS]), (("area", "yes"),)),),
    "paths": (Asked("highway", any_of(T.TRAILS), (("area", "yes"),)),),
    "rail": (Asked("railway", any_of(list(T.RAILWAY_SCALES))),),
    "aerial": (Asked("aerialway", any_of(list(T.AERIALWAY_SCALES))),),
    "ferry": (Asked("route", "^ferry$"),),
    "water": (Asked("waterway", any_of([*T.WATERWAY_SCALES, "riverbank"]), (("intermittent", "yes"),)), Asked("natural", "^water$", (("intermittent", "yes"),))),
    "coastline": (Asked("natural", "^coastline$"),),
    "buildings": (Asked("building", ".+", (("building", "no"),)),),
}


def in_boxes(lat: Column, lon: Column, boxes: Sequence[tuple[float, float, float, float]]) -> Column:
    """Inside one of the boxes (south, west, north, east)."""
    return reduce(or_, (lat.between(s, n) & lon.between(w, e) for s, w, n, e in boxes), F.lit(False))


def asked(layer: str, tags: Column) -> Column:
    """Whether an element's tags are what a layer asks for; false for null tags."""

    def one(part: Asked) -> Column:
        found = F.coalesce(T.tag(tags, part.key).rlike(part.pattern), F.lit(False))
        for key, value in part.without:
            found = found & F.coalesce(T.tag(tags, key) != value, F.lit(True))
        return found

    return reduce(or_, map(one, LAYERS[layer]))
