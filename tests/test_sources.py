"""Binary sources, sinks and streaming operators on files made here."""

import io
import json
import os
import zipfile
import zlib

import numpy as np
import pytest

from stratafold.sources import geotiff, sinks, tiles, trails
from stratafold.streaming import states


def test_png_round_trip_and_filters():
    rng = np.random.default_rng(3)
    pixels = rng.integers(0, 256, (9, 7, 3), dtype=np.uint8)
    assert (tiles.decode_png(tiles.encode_png(pixels)) == pixels).all()
    lines = b""
    flat = pixels.reshape(9, -1).astype(int)
    for y in range(9):
        mode = y % 5
        left = np.concatenate([np.zeros(3, int), flat[y, :-3]])
        up = flat[y - 1] if y else np.zeros(21, int)
        corner = np.concatenate([np.zeros(3, int), up[:-3]])
        p = left + up - corner
        paeth = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
        guess = [0, left, up, (left + up) // 2, paeth][mode]
        lines += bytes([mode]) + ((flat[y] - guess) % 256).astype(np.uint8).tobytes()
    plain = tiles.encode_png(pixels)
    body = zlib.compress(lines)
    at = plain.index(b"IDAT") - 4
    head, tail = plain[:at], plain[plain.index(b"IEND") - 4 :]
    filtered = head + len(body).to_bytes(4, "big") + b"IDAT" + body + zlib.crc32(b"IDAT" + body).to_bytes(4, "big") + tail
    assert (tiles.decode_png(filtered) == pixels).all()
    for bad in (b"", b"junk", plain[:40], filtered[:-30]):
        with pytest.raises(ValueError):
            tiles.decode_png(bad)


def test_elevation_tiles(spark, tmp_path):
    metres = np.arange(16).reshape(4, 4) * 10.5 - 20
    raw = np.round((metres + 32768) * 256).astype(int)
    good = tiles.encode_png(np.stack([raw >> 16, raw >> 8 & 255, raw & 255], -1).astype(np.uint8))
    for name, data in (("5/1/2.png", good), ("5/1/3.png", good[:60]), ("6/0/0.png", tiles.encode_png(np.zeros((2, 2, 3), np.uint8)))):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    rows = tiles.read_elevation(spark, str(tmp_path), 4).collect()
    assert {(r.z, r.x, r.y) for r in rows} == {(5, 1, 2)}
    assert {(r.py, r.px): r.metres for r in rows} == {(i, j): metres[i, j] for i in range(4) for j in range(4)}
    assert tiles.directory_totals(spark, str(tmp_path)).first().files == 3


def test_bundles(spark, tmp_path):
    def bundle(*entries):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, data in entries:
                z.writestr(name, data)
        return out.getvalue()

    (tmp_path / "a.zip").write_bytes(bundle(("x/1.json", "one"), ("y.txt", "two")))
    (tmp_path / "b.zip").write_bytes(bundle(("ok", "1"), ("../evil", "2")))
    (tmp_path / "c.zip").write_bytes(b"no zip")
    rows = tiles.read_bundles(spark, str(tmp_path)).collect()
    assert sorted((r.name, bytes(r.content).decode()) for r in rows if r.problem is None) == [("x/1.json", "one"), ("y.txt", "two")]
    assert sorted(r.problem for r in rows if r.problem) == ["unreadable: BadZipFile", "unsafe path"]
    assert sinks.bundle(iter([("p/a", b"1"), ("p/b", b"2"), ("q", b"3")]), str(tmp_path / "d.zip")) == {"p": 2, "q": 1}


GPX = """<?xml version="1.0"?><gpx><!-- <trk><trkpt lat="1" lon="1"/></trk> --><x:trk><x:name><![CDATA[A &amp; B]]></x:name>
<x:trkpt lon="8.5" lat='47.1'><ele>3</ele></x:trkpt><trkpt lat="91" lon="0"/><trkpt lat="47.2" lon="8.6"/></x:trk><rte><rtept lat="-1" lon="2"/></rte></gpx>"""
KML = """<kml><Placemark><LineString><tessellate>1</tessellate><coordinates> 8.5,47.1,400 bad 8.6,47.2 </coordinates></LineString></Placemark>
<gx:Track><when>t</when><gx:coord>9 48 1</gx:coord></gx:Track></kml>"""


def test_trails(spark):
    df = spark.createDataFrame([(1, GPX), (2, None), (3, "")], "id int, t string")
    assert [tuple(r) for r in trails.gpx_points(df, "id", "t").orderBy("trail", "seq").collect()] == [(1, 0, 0, 47.1, 8.5), (1, 0, 2, 47.2, 8.6), (1, 1, 0, -1.0, 2.0)]
    assert [r.name for r in trails.gpx_names(df, "id", "t").orderBy("trail").collect()] == ["A & B", "Trail 2"]
    kml = spark.createDataFrame([(1, KML)], "id int, t string")
    assert [tuple(r) for r in trails.kml_points(kml, "id", "t").orderBy("trail", "seq").collect()] == [(1, 0, 0, 47.1, 8.5), (1, 0, 2, 47.2, 8.6), (1, 1, 0, 48.0, 9.0)]


def test_stl(spark, tmp_path):
    verts = spark.createDataFrame([("m", i, *p) for i, p in enumerate([(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)])], "mesh string, vid long, x double, y double, z double")
    tris = spark.createDataFrame([("m", 0, 0, 2, 1), ("m", 1, 0, 1, 3)], "mesh string, tid long, a long, b long, d long")
    assert sinks.write_stl(tris, verts, "mesh", str(tmp_path)).first() == ("m", 2, 84 + 100)
    corners = sinks.read_stl((tmp_path / "m.stl").read_bytes())
    assert corners[1].tolist() == [[0, 0, 0], [1, 0, 0], [0, 0, 1]]
    assert not sinks.publish(str(tmp_path / "m.stl"), b"other") and (tmp_path / "m.stl").stat().st_size == 184


def run(stream, tmp_path, name, mode):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return query


def test_streaming(spark, tmp_path):
    events = [{"k": k, "n": n, "v": v, "ts": f"2024-01-01T00:00:{n:02d}Z"} for n, (k, v) in enumerate([("a", 5), ("b", 1), ("a", 3), ("a", 9), ("b", 7), ("a", 2), ("a", 4), ("a", 5)])]
    (tmp_path / "in").mkdir()
    for i in range(2):
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(json.dumps(e) for e in events[4 * i : 4 * i + 4]))
        # Files are taken by their times, which two written at once may share.
        os.utime(tmp_path / "in" / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    source = lambda: spark.readStream.schema("k string, n long, v long, ts timestamp").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    run(states.monotonic(source(), "k", "v"), tmp_path, "mono", "complete")
    assert {tuple(r) for r in spark.table("mono").collect()} == {("a", 9), ("b", 7)}
    run(states.latest(source(), "k", ["n"], ["v"]), tmp_path, "late", "complete")
    assert {tuple(r) for r in spark.table("late").collect()} == {("a", 7, 5), ("b", 4, 7)}
    run(states.newest(source(), "k", "n", "v", 3), tmp_path, "news", "update")
    assert [r["items"] for r in spark.table("news").collect() if r.k == "a"][-1] == [5, 4, 2]
    run(states.once(source(), ["k"], "ts", "1 hour"), tmp_path, "once", "append")
    assert {(r.k, r.n) for r in spark.table("once").collect()} == {("a", 0), ("b", 1)}
    states.events_to_json(source(), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert spark.read.text(str(tmp_path / "out")).count() == 8


def height_tile(metres):
    raw = np.round((np.asarray(metres) + 32768) * 256).astype(int)
    return tiles.encode_png(np.stack([raw >> 16, raw >> 8 & 255, raw & 255], -1).astype(np.uint8))


def test_samples_fall_back_to_parents_and_damaged_tiles_go(spark, tmp_path):
    deep, parent = np.arange(16).reshape(4, 4), np.full((4, 4), 900.0)
    for name, data in (("3/4/2.png", height_tile(deep)), ("2/2/1.png", height_tile(parent)), ("3/5/2.png", height_tile(deep)[:50])):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    # Tile 3/4/2 spans 0..45 degrees of longitude; 3/5/2, its neighbour under the same parent, is cut off.
    lat = np.degrees(np.arctan(np.sinh(np.pi * (1 - 2 * (2 + 0.375) / 8))))
    points = spark.createDataFrame([(1, 45 * 0.625, float(lat)), (2, 45 * 1.5, float(lat)), (3, -100.0, float(lat))], "id int, lon double, lat double")
    pixels = tiles.read_elevation(spark, str(tmp_path), 4)
    got = {r.id: (r.z, r.metres) for r in tiles.sample_elevation(points, pixels, "id", 3, 1, 4).collect()}
    assert got == {1: (3, 6.0), 2: (2, 900.0)}
    assert [r.path.rsplit("/", 3)[1:] for r in tiles.drop_damaged(spark, str(tmp_path), 4).collect()] == [["3", "5", "2.png"]]
    assert not (tmp_path / "3/5/2.png").exists() and (tmp_path / "3/4/2.png").exists()


def tiff(levels, order="<", deflate=True, nodata=b"0"):
    """A tiled GeoTIFF of byte rasters, finest first, with its corner at 10 east, 50 north and 0.5 degrees a pixel."""
    import struct

    out = bytearray({"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HI", 42, 0))
    link = 4
    for raster in levels:
        h, w = raster.shape
        blocks = []
        for y in range(0, h, 16):
            for x in range(0, w, 16):
                block = np.zeros((16, 16), np.uint8)
                part = raster[y : y + 16, x : x + 16]
                block[: part.shape[0], : part.shape[1]] = part
                data = zlib.compress(block.tobytes()) if deflate else block.tobytes()
                blocks.append((len(out), len(data)))
                out += data
        n = len(blocks)
        fields = [(256, 3, [w]), (257, 3, [h]), (258, 3, [8]), (259, 3, [8 if deflate else 1]), (322, 3, [16]), (323, 3, [16]), (324, 4, [b[0] for b in blocks]), (325, 4, [b[1] for b in blocks])]
        if raster is levels[0]:
            fields += [(33550, 12, [0.5, 0.5, 0.0]), (33922, 12, [0.0, 0.0, 0.0, 10.0, 50.0, 0.0]), (42113, 2, [nodata + b"\0"])]
        entries = b""
        for number, kind, values in fields:
            code = {2: f"{len(values[0])}s" if kind == 2 else "", 3: f"{len(values)}H", 4: f"{len(values)}I", 12: f"{len(values)}d"}[kind]
            data = struct.pack(order + code, *values)
            count = len(values[0]) if kind == 2 else len(values)
            if len(data) > 4:
                inline = struct.pack(order + "I", len(out))
                out += data
            else:
                inline = data.ljust(4, b"\0")
            entries += struct.pack(order + "HHI", number, kind, count) + inline
        out[link : link + 4] = struct.pack(order + "I", len(out))
        out += struct.pack(order + "H", len(fields)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


@pytest.mark.parametrize("order, deflate", [("<", True), (">", False)])
def test_land_cover_windows(spark, tmp_path, order, deflate):
    rng = np.random.default_rng(5)
    full = rng.integers(1, 9, (40, 50), dtype=np.uint8)
    full[3, 4] = 0
    half = full[::2, ::2].copy()
    (tmp_path / "a.tif").write_bytes(tiff([full, half], order, deflate))
    rows = [(i, 10 + float(x), 50 - float(y), "a.tif") for i, (x, y) in enumerate(zip(rng.uniform(0, 25, 300), rng.uniform(0, 20, 300)))]
    rows += [(900, 12.2, 48.3, "a.tif"), (901, 9.9, 49.0, "a.tif"), (902, 12.0, 49.0, "none.tif"), (903, None, 49.0, "a.tif"), (904, 12.0, 49.0, None)]
    points = spark.createDataFrame(rows, "id int, lon double, lat double, tile string")
    for degrees, raster, size in ((0.5, full, 0.5), (0.1, full, 0.5), (1.0, half, 1.0), (9.0, half, 1.0)):
        got = {r.id: r["class"] for r in geotiff.sample_cover(points, "id", "tile", str(tmp_path), degrees).collect()}
        expected = {i: int(raster[int((50 - lat) / size), int((lon - 10) / size)]) for i, lon, lat, tile in rows[:301] if lon is not None}
        assert got == {i: k for i, k in expected.items() if k}


def test_zipped_models(spark, tmp_path):
    import xml.etree.ElementTree as tree

    corners = [(10, 0.0, 0.0, 0.0), (20, 1.0, 0.0, 0.0), (30, 0.0, 1.0, 0.0), (40, 0.0, 0.0, 1.123456789)]
    faces = [(0, 10, 30, 20, 1), (1, 10, 20, 40, 0), (2, 20, 30, 40, 2), (3, 30, 10, 40, 1)]
    vertices = spark.createDataFrame([(m, k, *v) for m in ("one", "two") for k in ("a", 'b<"') for v in corners], "model string, mesh string, vid long, x double, y double, z double").repartition(5)
    triangles = spark.createDataFrame([(m, k, *f) for m in ("one", "two") for k in ("a", 'b<"') for f in faces], "model string, mesh string, tid long, a long, b long, d long, material int").repartition(3)
    written = sinks.write_models(triangles, vertices, "model", "mesh", str(tmp_path), ["#112233", "#445566", "#FFFFFF"])
    assert sorted(tuple(r) for r in written.collect()) == [("one", 2, 8), ("two", 2, 8)]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["one.3mf", "two.3mf"]
    with zipfile.ZipFile(tmp_path / "one.3mf") as opened:
        assert set(opened.namelist()) == {"[Content_Types].xml", "_rels/.rels", "3D/3dmodel.model"}
        root = tree.fromstring(opened.read("3D/3dmodel.model"))
    ns = {"m": "http://schemas.microsoft.com/3dmanufacturing/core/2015/02"}
    objects = root.findall("m:resources/m:object", ns)
    assert [o.get("name") for o in objects] == ["a", 'b<"'] and [i.get("objectid") for i in root.findall("m:build/m:item", ns)] == [o.get("id") for o in objects]
    for o in objects:
        assert [tuple(t.get(k) for k in ("v1", "v2", "v3", "p1")) for t in o.findall("m:mesh/m:triangles/m:triangle", ns)] == [("0", "2", "1", "1"), ("0", "1", "3", "0"), ("1", "2", "3", "2"), ("2", "0", "3", "1")]
        assert o.findall("m:mesh/m:vertices/m:vertex", ns)[3].get("z") == "1.12346"
    with pytest.raises(ValueError, match="lacks"):
        writer = sinks.ModelWriter(str(tmp_path / "bad.3mf"), ["#000000"])
        writer.vertices("m", np.array([1, 2]), np.zeros((2, 3)))
        writer.faces(np.array([[1, 2, 3]]), np.array([0]))


def test_feed_ends_with_the_terminal_event(spark, tmp_path):
    schema = "key string, at int, kind string"
    batches = [[("a", 1, "go"), ("a", 2, "done"), ("a", 3, "go"), ("b", 1, "go")], [("a", 4, "go"), ("b", 2, "failed"), ("b", 3, "done")]]
    (tmp_path / "in").mkdir()
    seen = []
    for i, rows in enumerate(batches):
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(json.dumps(dict(zip(("key", "at", "kind"), r))) for r in rows))
        stream = states.feed(spark.readStream.schema(schema).json(str(tmp_path / "in")), "key", "at", "kind", ["done", "failed"])
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
        query.awaitTermination()
        seen.append(sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()))
    assert seen[0] == [("a", 1, "go"), ("a", 2, "done"), ("b", 1, "go")]
    assert seen[1] == [*seen[0], ("b", 2, "failed")]


def test_tagged_jobs_can_be_stopped(spark):
    import threading

    with states.cancellable(spark, "job-7") as stop:
        timer = threading.Timer(2.0, stop)
        timer.start()
        with pytest.raises(Exception, match="(?i)cancel"):
            spark.range(0, 10**13, numPartitions=4).selectExpr("sum(id % 7)").collect()
        timer.join()
    assert spark.range(5).count() == 5
