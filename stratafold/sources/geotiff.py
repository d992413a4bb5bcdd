"""Land cover from tiled GeoTIFF files: only the blocks that the asked points fall into are read.

Points are grouped by file; a task reads one file's header and then seeks to the blocks it needs, of the coarsest overview
that is still as fine as asked for. Samples are the nearest pixel's.

Defined cases. Points outside a file, on its nodata value or of a file that is missing or unreadable have no row. Points with
a null coordinate or file have none. Files may be little- or big-endian, with one band of bytes, in tiles that are stored
plainly or deflated; others are an error. Repeated points give repeated rows.
"""

from __future__ import annotations

import os
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Numbers and field types of the format.
WIDTH, HEIGHT, BITS, COMPRESSION, TILE_WIDTH, TILE_HEIGHT, OFFSETS, SIZES, PIXEL_SCALE, TIE_POINT, NODATA = 256, 257, 258, 259, 322, 323, 324, 325, 33550, 33922, 42113
_KINDS = {1: "B", 2: "s", 3: "H", 4: "I", 12: "d", 16: "Q"}
PLAIN, DEFLATED = (1,), (8, 32946)


@dataclass(frozen=True)
class Level:
    """One resolution of a file."""

    width: int
    height: int
    tile: tuple[int, int]
    compression: int
    offsets: tuple[int, ...]
    sizes: tuple[int, ...]


@dataclass(frozen=True)
class Cover:
    """A file's resolutions, finest first, and where it lies."""

    levels: list[Level]
    west: float
    north: float
    pixel: tuple[float, float]
    nodata: int | None


def read_header(file) -> Cover:
    """The header of an open file; ``ValueError`` where it is not of the kind read here."""
    start = file.read(8)
    order = {b"II": "<", b"MM": ">"}.get(start[:2])
    if order is None or len(start) < 8 or struct.unpack(order + "H", start[2:4])[0] != 42:
        raise ValueError("no TIFF")
    at = struct.unpack(order + "I", start[4:8])[0]
    levels, first = [], {}
    while at:
        file.seek(at)
        count = struct.unpack(order + "H", file.read(2))[0]
        entries = [struct.unpack(order + "HHI4s", file.read(12)) for _ in range(count)]
        at = struct.unpack(order + "I", file.read(4))[0]
        tags: dict[int, tuple] = {}
        for number, kind, n, inline in entries:
            if kind not in _KINDS:
                continue
            code = f"{order}{n}{_KINDS[kind]}"
            size = struct.calcsize(code)
            if size > 4:
                file.seek(struct.unpack(order + "I", inline)[0])
                inline = file.read(size)
            tags[number] = struct.unpack(code, inline[:size])
        if tags.get(BITS, (8,)) != (8,) or TILE_WIDTH not in tags:
            raise ValueError("not one band of bytes in tiles")
        compression = tags.get(COMPRESSION, (1,))[0]
        if compression not in PLAIN + DEFLATED:
            raise ValueError(f"compression {compression}")
        levels.append(Level(tags[WIDTH][0], tags[HEIGHT][0], (tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0]), compression, tags[OFFSETS], tags[SIZES]))
        first = first or tags
    scale, tie = first[PIXEL_SCALE], first[TIE_POINT]
    nodata = first.get(NODATA)
    levels.sort(key=lambda level: -level.width)
    return Cover(levels, tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1], (scale[0], scale[1]), int(float(nodata[0].split(b"\0")[0])) if nodata else None)


def choose_level(cover: Cover, degrees: float) -> Level:
    """The coarsest level whose pixels are no wider than asked, the finest if none is."""
    wide = cover.levels[0].width * cover.pixel[0]
    fine = [level for level in cover.levels if wide / level.width <= degrees * (1 + 1e-9)]
    return fine[-1] if fine else cover.levels[0]


def sample(file, cover: Cover, lon: np.ndarray, lat: np.ndarray, degrees: float) -> np.ndarray:
    """Values at points, -1 where there is none; each block that is needed is read once."""
    level = choose_level(cover, degrees)
    full = cover.levels[0]
    x = np.floor((lon - cover.west) / (cover.pixel[0] * full.width) * level.width).astype(np.int64)
    y = np.floor((cover.north - lat) / (cover.pixel[1] * full.height) * level.height).astype(np.int64)
    out = np.full(len(lon), -1, np.int32)
    inside = (x >= 0) & (x < level.width) & (y >= 0) & (y < level.height)
    across = -(-level.width // level.tile[0])
    block = np.where(inside, y // level.tile[1] * across + x // level.tile[0], -1)
    for b in np.unique(block[inside]).tolist():
        file.seek(level.offsets[b])
        data = file.read(level.sizes[b])
        data = zlib.decompress(data) if level.compression in DEFLATED else data
        pixels = np.frombuffer(data, np.uint8, level.tile[0] * level.tile[1]).reshape(level.tile[1], level.tile[0])
        here = block == b
        out[here] = pixels[y[here] % level.tile[1], x[here] % level.tile[0]]
    return np.where(out == cover.nodata, -1, out) if cover.nodata is not None else out


def sample_cover(points: DataFrame, key: str, file: str, folder: str, degrees: float, parts: int = 16) -> DataFrame:
    """``key, class`` at points (``key, lon, lat`` and the name of their ``file`` in a folder that all executors share).

    A file's points are salted over up to ``parts`` tasks, so a file that holds a third of all points is read by several.
    """

    def run(group: tuple, table: pa.Table) -> pa.Table:
        path = os.path.join(folder, group[0].as_py())
        keys = table.column(key).combine_chunks()
        try:
            with open(path, "rb") as opened:
                found = sample(opened, read_header(opened), table.column("lon").to_numpy(), table.column("lat").to_numpy(), degrees)
        except (FileNotFoundError, struct.error, zlib.error):
            found = np.full(len(keys), -1, np.int32)
        held = np.flatnonzero(found >= 0)
        return pa.table({key: keys.take(pa.array(held)), "class": pa.array(found[held], pa.int32())})

    wanted = points.select(F.col(file).alias("__file"), F.pmod(F.xxhash64(key), F.lit(parts)).alias("__part"), key, F.col("lon").cast("double"), F.col("lat").cast("double")).dropna(subset=["__file", "lon", "lat"])
    return wanted.groupBy("__file", "__part").applyInArrow(run, T.StructType([points.schema[key], T.StructField("class", T.IntegerType())]))
