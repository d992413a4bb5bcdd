"""Trails in GPX and KML texts: blocks by regular expression, whatever the namespace prefix, in document order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.functions.text import decode_entities, strip_comments

_POINT = r"""<(?:\w+:)?(?:trkpt|rtept)\b[^>]*>"""


def gpx_points(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, trail, seq, lat, lon``: the points of every track and route; points outside the globe or without numbers are
    skipped but keep their place."""
    clean = df.select(F.col(key), F.regexp_replace(strip_comments(F.col(text)), r"(?s)<!\[CDATA\[.*?\]\]>", "").alias("t"))
    trails = clean.select(key, F.posexplode(F.regexp_extract_all("t", F.lit(r"(?s)<(?:\w+:)?(trk|rte)\b[^>]*>(.*?)</(?:\w+:)?\1>"), 2)).alias("trail", "body"))
    points = trails.select(key, "trail", F.posexplode(F.regexp_extract_all("body", F.lit(_POINT), 0)).alias("seq", "p"))
    number = lambda name: F.regexp_extract("p", rf"""\b{name}\s*=\s*["']\s*([-+0-9.eE]+)\s*["']""", 1).try_cast("double")
    return points.select(key, "trail", "seq", number("lat").alias("lat"), number("lon").alias("lon")).where("lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180")


def gpx_names(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, trail, name``: each trail's own name, entities decoded, or a numbered one."""
    trails = df.select(F.col(key), F.posexplode(F.regexp_extract_all(strip_comments(F.col(text)), F.lit(r"(?s)<(?:\w+:)?(trk|rte)\b[^>]*>(.*?)</(?:\w+:)?\1>"), 2)).alias("trail", "body"))
    raw = F.trim(F.regexp_replace(F.regexp_extract("body", r"(?s)<(?:\w+:)?name>(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?</", 1), r"\s+", " "))
    return trails.select(key, "trail", F.when(raw != "", F.left(decode_entities(raw), F.lit(80))).otherwise(F.format_string("Trail %d", F.col("trail") + 1)).alias("name"))


def kml_points(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, trail, seq, lat, lon`` of the coordinates of every LineString and of gx:coord tracks."""
    clean = df.select(F.col(key), strip_comments(F.col(text)).alias("t"))
    lines = F.transform(F.regexp_extract_all("t", F.lit(r"(?s)<(?:\w+:)?LineString\b.*?<(?:\w+:)?coordinates>(.*?)</"), 1), lambda x: F.split(F.trim(x), r"\s+"))
    tracks = F.transform(F.regexp_extract_all("t", F.lit(r"(?s)<(?:\w+:)?Track>(.*?)</(?:\w+:)?Track>"), 1), lambda x: F.transform(F.regexp_extract_all(x, F.lit(r"<(?:\w+:)?coord>\s*([^<]*?)\s*</"), 1), lambda p: F.regexp_replace(p, r"\s+", ",")))
    points = clean.select(key, F.posexplode(F.concat(lines, tracks)).alias("trail", "points")).select(key, "trail", F.posexplode("points").alias("seq", "p"))
    part = lambda i: F.try_element_at(F.split("p", ","), F.lit(i)).try_cast("double")
    return points.select(key, "trail", "seq", part(2).alias("lat"), part(1).alias("lon")).where("lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180")
