"""Binary sources: elevation tiles (PNG, the height in three colour bytes), zipped source bundles, directory totals."""

from __future__ import annotations

import io
import math
import os
import posixpath
import struct
import urllib.parse
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def decode_png(data: bytes) -> np.ndarray:
    """Pixels (rows, columns, channels) of an 8-bit RGB or RGBA PNG without interlace; ValueError for anything else."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG")
    at, body, header = 8, b"", None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + size]
        if len(chunk) < size:
            raise ValueError("cut off")
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"IDAT":
            body += chunk
        elif kind == b"IEND":
            break
        at += 12 + size
    if header is None or header[2] != 8 or header[3] not in (2, 6) or header[6]:
        raise ValueError("unsupported PNG")
    width, height, channels = header[0], header[1], 3 if header[3] == 2 else 4
    try:
        raw = np.frombuffer(zlib.decompress(body), np.uint8)
    except zlib.error as error:
        raise ValueError("bad PNG data") from error
    stride = width * channels
    if len(raw) != height * (stride + 1):
        raise ValueError("bad PNG size")
    lines = raw.reshape(height, stride + 1)
    out = np.zeros((height, stride), np.uint8)
    above = np.zeros(stride, np.int32)
    for y in range(height):
        mode, line = int(lines[y, 0]), lines[y, 1:].astype(np.int32)
        if mode == 1:
            line = np.cumsum(line.reshape(width, channels), axis=0).reshape(-1) & 255
        elif mode == 2:
            line = (line + above) & 255
        elif mode in (3, 4):
            done = np.zeros(stride + channels, np.int32)
            for x in range(stride):
                left, up = done[x], above[x]
                if mode == 3:
                    guess = (left + up) // 2
                else:
                    corner = above[x - channels] if x >= channels else 0
                    p = left + up - corner
                    guess = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
                done[x + channels] = (line[x] + guess) & 255
            line = done[channels:]
        elif mode:
            raise ValueError("unknown PNG filter")
        out[y] = line
        above = line
    return out.reshape(height, width, channels)


def encode_png(pixels: np.ndarray) -> bytes:
    """An unfiltered 8-bit RGB PNG."""
    height, width, _ = pixels.shape
    raw = np.concatenate([np.zeros((height, 1), np.uint8), pixels.reshape(height, -1)], axis=1).tobytes()
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def heights_of(pixels: np.ndarray) -> np.ndarray:
    p = pixels.astype(np.float64)
    return p[..., 0] * 256 + p[..., 1] + p[..., 2] / 256 - 32768


def _pixels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for z, x, y, size, content in (tuple(c[i].as_py() for c in batch.columns) for i in range(batch.num_rows)):
            try:
                heights = heights_of(decode_png(content))
            except ValueError:
                continue
            if heights.shape != (size, size):
                continue
            n = size * size
            py, px = np.divmod(np.arange(n, dtype=np.int32), size)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, z, np.int32)), pa.array(np.full(n, x, np.int64)), pa.array(np.full(n, y, np.int64)), pa.array(px), pa.array(py), pa.array(heights.ravel())], names=["z", "x", "y", "px", "py", "metres"])


def read_elevation(spark: SparkSession, root: str, tile_size: int = 256) -> DataFrame:
    """``z, x, y, px, py, metres`` of every readable tile under ``root`` (files named ``z/x/y.png``); corrupt tiles and tiles
    of another size give no rows. Filters on z, x and y prune files before their content is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").option("recursiveFileLookup", "true").load(root)
    key = lambda i: F.regexp_extract("path", r"(\d+)/(\d+)/(\d+)\.png$", i)
    tiles = files.select(key(1).cast("int").alias("z"), key(2).cast("long").alias("x"), key(3).cast("long").alias("y"), F.lit(tile_size).alias("size"), "content")
    return tiles.mapInArrow(_pixels, "z int, x long, y long, px int, py int, metres double")


def damaged_tiles(spark: SparkSession, root: str, tile_size: int = 256) -> DataFrame:
    """``path`` of every cached tile that is cut off, no PNG or of another size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bad = []
            for i in range(batch.num_rows):
                try:
                    whole = decode_png(batch.column(1)[i].as_py()).shape[:2] == (tile_size, tile_size)
                except ValueError:
                    whole = False
                bad.append(not whole)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(bad))], names=["path"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").option("recursiveFileLookup", "true").load(root)
    return files.select("path", "content").mapInArrow(run, "path string")


def drop_damaged(spark: SparkSession, root: str, tile_size: int = 256) -> DataFrame:
    """Deletes the damaged tiles where they are found, so that they are fetched again; gives their paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    os.unlink(urllib.parse.unquote(urllib.parse.urlparse(path).path))
                except FileNotFoundError:
                    pass
            yield batch

    return damaged_tiles(spark, root, tile_size).mapInArrow(run, "path string")


def sample_elevation(points: DataFrame, pixels: DataFrame, key: str, zoom: int, least_zoom: int, tile_size: int = 256) -> DataFrame:
    """``key, z, metres``: the pixel under each point (``key, lon, lat``) of the deepest tile from ``zoom`` up to ``least_zoom`` that
    ``pixels`` (as of ``read_elevation``) holds; points without any are left out.

    A point asks for its pixel's address at every zoom, so the fallback to parents is one equi-join.
    """
    side = float(tile_size)
    asked = points.select(key, "lon", "lat", F.explode(F.sequence(F.lit(least_zoom), F.lit(zoom))).alias("z"))
    scale = F.pow(F.lit(2.0), F.col("z"))
    phi = F.radians(F.least(F.greatest(F.col("lat"), F.lit(-85.05112878)), F.lit(85.05112878)))
    u = (F.col("lon") + 180.0) / 360.0 * scale
    v = (1 - F.ln(F.tan(phi) + 1 / F.cos(phi)) / math.pi) / 2 * scale
    inside = lambda c: F.least(F.greatest(c, F.lit(0.0)), scale - 1e-9)
    at = asked.select(key, "z", inside(u).alias("u"), inside(v).alias("v"))
    addressed = at.select(key, "z", F.floor("u").alias("x"), F.floor("v").alias("y"), F.floor((F.col("u") - F.floor("u")) * side).cast("int").alias("px"), F.floor((F.col("v") - F.floor("v")) * side).cast("int").alias("py"))
    found = addressed.join(pixels, ["z", "x", "y", "px", "py"])
    return found.groupBy(key).agg(F.max(F.struct("z", "metres")).alias("best")).select(key, "best.z", "best.metres")


#: Limits of a source bundle: entries, bytes of an entry and of all.
MOST_ENTRIES, MOST_ENTRY_BYTES, MOST_BYTES = 4_096, 256 << 20, 2 << 30


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One batch an entry. A bundle is looked through as a whole first, so that nothing comes of one that turns out bad."""
    kinds = (pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string())

    def row(*values: object) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=["bundle", "name", "bytes", "content", "problem"])

    def problem_of(bundle: zipfile.ZipFile) -> str | None:
        names = bundle.infolist()
        if len(names) > MOST_ENTRIES or sum(i.file_size for i in names) > MOST_BYTES:
            return "too large"
        for info in names:
            if info.filename.startswith("/") or "\\" in info.filename or ":" in info.filename or posixpath.normpath(info.filename).startswith(".."):
                return "unsafe path"
            if info.file_size > MOST_ENTRY_BYTES:
                return "entry too large"
        return "unreadable: BadZipFile" if bundle.testzip() else None

    for batch in batches:
        for path, content in ((batch.column(0)[i].as_py(), batch.column(1)[i].as_py()) for i in range(batch.num_rows)):
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as bundle:
                    problem = problem_of(bundle)
                    for info in bundle.infolist() if problem is None else ():
                        if not info.is_dir():
                            yield row(path, posixpath.normpath(info.filename), info.file_size, bundle.read(info), None)
            except (zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError) as error:
                problem = f"unreadable: {type(error).__name__}"
            if problem:
                yield row(path, None, None, None, problem)


def read_bundles(spark: SparkSession, root: str) -> DataFrame:
    """``bundle, name, bytes, content, problem``: the files in every zip under ``root``; a bundle that is unsafe, too large or
    unreadable gives one row that says so, and none of its files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(root).select("path", "content").mapInArrow(_entries, "bundle string, name string, bytes long, content binary, problem string")


def directory_totals(spark: SparkSession, root: str) -> DataFrame:
    """Bytes and number of the files under ``root``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("files"))
