"""Column expressions over map-feature tags (``map<string,string>``)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Relative widths by tag value.
ROAD_SCALES = {
    "motorway": 1.4, "trunk": 1.25, "primary": 1.0, "secondary": 0.8, "tertiary": 0.7, "unclassified": 0.62,
    "motorway_link": 0.75, "trunk_link": 0.75, "primary_link": 0.65, "secondary_link": 0.65, "tertiary_link": 0.58,
    "residential": 0.56, "living_street": 0.5, "pedestrian": 0.5, "road": 0.5, "service": 0.45, "track": 0.5,
    "cycleway": 0.45, "bridleway": 0.42, "path": 0.38, "footway": 0.38, "steps": 0.38,
}
RAILWAY_SCALES = {"rail": 1.0, "preserved": 0.8, "light_rail": 0.7, "subway": 0.65, "narrow_gauge": 0.6, "monorail": 0.55, "tram": 0.5, "funicular": 0.5, "miniature": 0.35}
AERIALWAY_SCALES = {"cable_car": 0.5, "gondola": 0.45, "mixed_lift": 0.45, "chair_lift": 0.4, "drag_lift": 0.35, "t-bar": 0.35, "j-bar": 0.35, "platter": 0.35, "rope_tow": 0.3, "magic_carpet": 0.3}
WATERWAY_SCALES = {"river": 1.2, "canal": 0.9, "stream": 0.65}
TRAILS = ("track", "cycleway", "path", "footway", "bridleway", "steps")
# Keys that say a way has left the ground.
GONE_KEYS = ("razed", "demolished", "removed", "proposed", "construction")
GONE_PREFIXES = ("razed:", "demolished:", "removed:", "proposed:", "construction:", "historic:")
# Units of lengths in metres, tried in this order.
LENGTH_UNITS = (
    ("kilometres", 1000.0), ("kilometers", 1000.0), ("km", 1000.0), ("centimetres", 0.01), ("centimeters", 0.01), ("cm", 0.01),
    ("metres", 1.0), ("meters", 1.0), ("meter", 1.0), ("metre", 1.0), ("m", 1.0), ("feet", 0.3048), ("foot", 0.3048), ("ft", 0.3048),
    ("inches", 0.0254), ("inch", 0.0254), ("in", 0.0254),
)


def tag(tags: Column, key: str) -> Column:
    return F.element_at(tags, key)


def lookup(value: Column, scales: Mapping[str, float]) -> Column:
    """The value's entry in a small fixed table, null where it has none."""
    pairs = [x for k, v in scales.items() for x in (F.lit(k), F.lit(float(v)))]
    return F.element_at(F.create_map(*pairs), value)


def is_set(value: Column) -> Column:
    """Present and neither ``no`` nor ``false``."""
    return F.coalesce(~value.isin("no", "false"), F.lit(False))


def lifecycle(tags: Column) -> Column:
    """``gone``, ``abandoned``, ``disused`` or ``in_service``, the first that a bare key or a key prefix says."""

    def says(keys: tuple[str, ...], prefixes: tuple[str, ...]) -> Column:
        found = F.lit(False)
        for key in keys:
            value = tag(tags, key)
            found = found | F.coalesce(is_set(value) & (value != ""), F.lit(False))
        pattern = "^(" + "|".join(prefixes) + ")"
        return found | F.coalesce(F.exists(F.map_keys(tags), lambda k: k.rlike(pattern)), F.lit(False))

    return (
        F.when(says(GONE_KEYS, GONE_PREFIXES), "gone")
        .when(says(("abandoned",), ("abandoned:",)), "abandoned")
        .when(says(("disused",), ("disused:",)), "disused")
        .otherwise("in_service")
    )


def accepts(setting: Column, state: Column) -> Column:
    """Whether a setting (0 operational, 1 disused too, 2 abandoned too) draws a way in this state."""
    rank = F.when(state == "in_service", 0).when(state == "disused", 1).when(state == "abandoned", 2).otherwise(3)
    return rank <= F.least(setting, F.lit(2))


def _number(text: Column) -> Column:
    return F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))


_MEASURE = r"^([+-]?(?:\d+\.?\d*|\.\d+)(?:[e][+-]?\d+)?)\s*(\D+)$"


def length_m(value: Column) -> Column:
    """Metres of a free-text length: approximate marks, feet and inches, unit suffixes; null for lists and non-positive ones."""
    text = F.trim(F.regexp_replace(F.lower(F.trim(value)), r"^(~|approx\.|approx|ca\.|ca)\s*", ""))
    feet = _number(F.trim(F.substring_index(text, "'", 1)))
    rest = F.trim(F.regexp_replace(F.trim(F.regexp_extract(text, "^[^']*'(.*)$", 1)), '["in]+$', ""))
    metres = F.when(F.contains(text, F.lit(";")), F.lit(None).cast("double")).when(F.contains(text, F.lit("'")), feet * 0.3048 + F.coalesce(_number(rest), F.lit(0.0)) * 0.0254)
    # The number and the letters after it: a unit is looked up once, whatever the number of units.
    unit = F.regexp_extract(text, _MEASURE, 2)
    scale = F.element_at(F.create_map(*(F.lit(x) for unit_scale in LENGTH_UNITS for x in unit_scale)), unit)
    metres = metres.when(unit != "", F.regexp_extract(text, _MEASURE, 1).try_cast("double") * scale)
    metres = metres.otherwise(_number(text))
    return F.when(metres > 0, metres)


def first_number(value: Column) -> Column:
    """The number a text begins with."""
    return _number(F.regexp_extract(F.trim(value), r"^([0-9.]+)", 1))


def explicit_height_m(tags: Column) -> Column:
    height = F.coalesce(first_number(tag(tags, "height")), first_number(tag(tags, "building:levels")) * 3)
    return F.when(height.isNotNull(), F.least(F.greatest(height, F.lit(2.5)), F.lit(200.0)))


def building_height_m(tags: Column) -> Column:
    return F.coalesce(explicit_height_m(tags), F.lit(8.0))
