"""Core operators on small fixtures with known answers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratafold.functions import geo as G
from stratafold.functions import hashing, tags, text
from stratafold.operators import contour, focal, graph, mesh, overlay, palette, ranking, routes, sampling, selecting, spatial, tables
from stratafold.plans import fixtures as fx
from stratafold.queries import bookkeeping, vectors
from tests.parity import DATA, rows, sql_rows


def grid(spark, rows, name="z"):
    return spark.createDataFrame([(r, c, float(v)) for r, line in enumerate(rows) for c, v in enumerate(line)], f"r long, c long, {name} double")


def as_array(df, name="z"):
    out = {(r["r"], r["c"]): r[name] for r in df.collect()}
    return np.array([[out[i, j] for j in range(max(c for _, c in out) + 1)] for i in range(max(r for r, _ in out) + 1)])


def flat(bad, size=7, value=100.0, wrong=0.0):
    a = np.full((size, size), value)
    for r, c in bad:
        a[r, c] = wrong
    return a


@pytest.mark.parametrize("bad, healed", [
    ([(3, 3)], True),
    ([(r, 3) for r in range(7)], True),
    ([(r, c) for r in (2, 3, 4) for c in (2, 3, 4)], False),
    ([(0, 0)], True),
])
def test_despike(spark, bad, healed):
    repaired, counts = focal.despike(grid(spark, flat(bad)), "z", 80.0)
    assert (as_array(repaired) == (100.0 if healed else flat(bad))).all()
    assert counts[-1] == 0


def test_despike_golden_counts(spark):
    assert focal.despike(fx.cells(spark, DATA), "z", 80.0)[1] == [60, 11, 1, 0]


def test_despike_scale_spike_and_frozen_border(spark):
    high = flat([(3, 3)], wrong=250.0)
    assert (as_array(focal.despike_once(grid(spark, high), "z", 80.0)) == 100.0).all()
    assert (as_array(focal.despike_once(grid(spark, high), "z", 200.0)) == high).all()
    edge = flat([(0, 3)])
    assert (as_array(focal.despike_once(grid(spark, edge), "z", 80.0, frozen_border=True)) == edge).all()


def test_despike_keeps_tiles_apart(spark):
    two = grid(spark, flat([(3, 3)])).withColumn("tile", F.lit("a")).unionByName(grid(spark, flat([], value=5.0)).withColumn("tile", F.lit("b")))
    got = focal.despike_once(two, "z", 80.0, grid=["tile"])
    assert {(x.tile, x.z) for x in got.collect()} == {("a", 100.0), ("b", 5.0)}


def test_gradient_of_a_plane(spark):
    plane = [[2.0 * c + 3.0 * r for c in range(5)] for r in range(4)]
    assert {(round(x.dx, 9), round(x.dy, 9)) for x in focal.gradient(grid(spark, plane), "z", 0.5).collect()} == {(4.0, 6.0)}


SNAKE = ["#######", "......#", "#######", "#......", "#######"]


@pytest.mark.parametrize("band_rows", [1, 2, 512])
def test_components_within_and_across_bands(spark, monkeypatch, band_rows):
    monkeypatch.setattr(graph, "BAND_ROWS", band_rows)
    rows = [(r, c, 1) for r, line in enumerate(SNAKE) for c, x in enumerate(line) if x == "#"] + [(8, 0, 1), (8, 1, 2)]
    runs = graph.runs_of(spark.createDataFrame(rows, "r long, c long, k int"), "k")
    edges = graph.run_edges(runs, "k", band=2)
    found = {r.id: r.label for r in graph.components(runs.select(F.col("run_id").alias("id")), edges).collect()}
    assert len(found) == runs.count() and len(set(found.values())) == 3 and set(found.values()) == {0, 8 << 32, (8 << 32) + 1}


def test_components_of_a_long_path_and_text_ids(spark):
    # A path that visits bands in turn: neighbours are never of one partition.
    edges = spark.createDataFrame([(f"{i:04d}", f"{i + 1:04d}", i % 7) for i in range(300) if i != 150], "a string, b string, place int")
    nodes = spark.createDataFrame([(f"{i:04d}",) for i in range(302)], "id string")
    found = {r.id: r.label for r in graph.components(nodes, edges).collect()}
    assert found == {f"{i:04d}": "0000" if i <= 150 else "0151" if i <= 300 else "0301" for i in range(302)}
    assert {r.label for r in graph.components(nodes, edges.drop("place")).collect()} == {"0000", "0151", "0301"}


def test_tiles_give_what_the_whole_raster_gives(spark, monkeypatch):
    rng = np.random.default_rng(3)
    z = rng.integers(0, 5, (11, 13)).astype(float)
    monkeypatch.setattr(focal, "TILE", 4)
    padded = np.pad(z, 1, mode="reflect")
    ring = {(r.r, r.c): list(r.ring) for r in focal.with_ring(grid(spark, z), "z").collect()}
    assert ring == {(i, j): [padded[i + a, j + b] for a, b in ((0, 0), (0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1), (2, 2))] for i in range(11) for j in range(13)}
    dy, dx = np.gradient(z)
    got = {(r.r, r.c): (r.dx, r.dy) for r in focal.gradient(grid(spark, z), "z", 1.0).collect()}
    assert len(got) == z.size and all(got[i, j] == (dx[i, j], dy[i, j]) for i in range(11) for j in range(13))
    squares = {(r.r, r.c): (r.z, r.z1, r.z2, r.z3) for r in focal.with_square(grid(spark, z), "z").collect()}
    assert squares == {(i, j): (z[i, j], z[i, j + 1], z[i + 1, j + 1], z[i + 1, j]) for i in range(10) for j in range(12)}


def test_ranks_within_groups(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["a", "a", "b", None]), rnd.randrange(50), i) for i in range(2000)]
    got = ranking.ranked(spark.createDataFrame(rows, "g string, v int, part int"), ["g"], ["v"]).collect()
    for g in ("a", "b", None):
        values = sorted((r["__k"], r.v) for r in got if r.g == g)
        assert [k for k, _ in values] == list(range(len(values))) and [v for _, v in values] == sorted(v for h, v, _ in rows if h == g)
        assert {r["__n"] for r in got if r.g == g} == {len(values)}
    assert ranking.ranked(spark.createDataFrame([], "g string, v int"), ["g"], ["v"]).count() == 0


def test_samples_of_a_raster_with_gaps(spark):
    cells = [(r, c, 10.0 * r + c) for r in range(40) for c in range(40) if (r, c) != (20, 20)]
    raster = spark.createDataFrame(cells, "r long, c long, z double")
    samples = spark.createDataFrame([(1, 3.25, 4.5), (2, 0.0, 39.0), (3, 20.0, 20.5), (4, 16.5, 15.5), (5, 21.0, 21.0)], "id int, y double, x double")
    got = {r.id: r.value for r in sampling.bilinear(samples, raster, F.col("y"), F.col("x"), "z", 40, 40).collect()}
    assert got == {1: 37.0, 2: 39.0, 3: None, 4: 180.5, 5: 231.0}
    cubic = {r.id: r.value for r in sampling.bicubic(samples, raster, F.col("y") + 0.5, F.col("x") + 0.5, "z", 40, 40).collect()}
    assert cubic[1] == pytest.approx(37.0) and cubic[4] == pytest.approx(180.5)


def test_flood_golden_count(spark):
    cells = fx.cells(spark, DATA).selectExpr("r", "c", "z <= 54.4 AS open", "z <= 54.4 AND (r = 0 OR c = 0 OR r = 9 OR c = 99) AS seed")
    assert cells.where("open").count() == 650
    assert graph.flood(cells, "open", "seed").count() == 642


def test_sieve_removes_small_patches_only(spark):
    k = np.zeros((8, 8))
    k[2, 2] = k[2, 3] = 1
    k[5:8, 4:8] = 2
    got = as_array(graph.sieve(grid(spark, k, "k").withColumn("k", F.col("k").cast("int")), "k", 4), "k")
    k[2, 2] = k[2, 3] = 0
    assert (got == k).all()


def test_points_in_areas_with_holes(spark):
    ring = lambda h: [(0.5 - h, 0.5 - h), (0.5 + h, 0.5 - h), (0.5 + h, 0.5 + h), (0.5 - h, 0.5 + h)]
    areas = spark.createDataFrame([(1, ring(0.4), [ring(0.1)])], "area int, shell array<struct<x: double, y: double>>, holes array<array<struct<x: double, y: double>>>")
    rnd = random.Random(1)
    points = [(i, rnd.random(), rnd.random()) for i in range(500)]
    got = {r.id for r in spatial.points_in_areas(spark.createDataFrame(points, "id int, x double, y double"), areas).collect()}
    assert got == {i for i, x, y in points if 0.1 <= max(abs(x - 0.5), abs(y - 0.5)) < 0.4}


def test_nearest_across_the_date_line(spark):
    points = spark.createDataFrame([(1, 179.9, 0.0), (2, 0.0, 0.0), (3, -179.95, 60.0)], "id long, lon double, lat double")
    sites = spark.createDataFrame([(7, -179.9, 0.0), (8, 179.0, 0.0), (9, 179.9, 60.0)], "site long, slon double, slat double")
    got = {(r.id, r.site) for r in spatial.nearest(points, sites, "id", 200.0, 5.0).collect()}
    assert got == {(1, 7), (3, 9)}


def test_uv_round_trip(spark):
    df = spark.createDataFrame([(46.1, 8.3), (-10.0, 179.99), (84.0, -120.0)], "lat double, lon double")
    u, v = G.to_uv(F.col("lat"), F.col("lon"), 46.0, 179.0, 800.0, 33.0)
    lat, lon = G.from_uv(u, v, 46.0, 179.0, 800.0, 33.0)
    for r in df.select("lat", "lon", lat.alias("a"), lon.alias("b")).collect():
        assert r.a == pytest.approx(r.lat) and math.cos(math.radians(r.b - r.lon)) == pytest.approx(1)


def test_greedy_budget_skips_and_continues(spark):
    df = spark.createDataFrame([(1, 50, True), (2, 40, False), (3, 30, False), (4, 20, False), (5, 10, False), (6, 10, False)], "id long, area long, major boolean")
    got = {r.id for r in selecting.greedy_budget(df, "id", "area", "major", 100.0).collect()}
    assert got == {1, 2, 5}


def test_stride_keeps_both_ends(spark):
    df = spark.range(100).select(F.lit(1).alias("k"), "id")
    assert [r.id for r in selecting.stride(df, ["k"], [F.col("id")], 5).orderBy("id").collect()] == [0, 25, 50, 74, 99]
    assert selecting.stride(df.where("id < 3"), ["k"], [F.col("id")], 5).count() == 3


def test_apportion_gives_each_one(spark):
    df = spark.createDataFrame([(0, 0.0), (1, 1.0), (2, 9.0)], "g int, w double")
    assert {r.g: r.share for r in selecting.apportion(df, "w", "g", 8).collect()} == {0: 1, 1: 2, 2: 5}
    assert {r.share for r in selecting.apportion(df, "w", "g", 2).collect()} == {1}


def test_palette_finds_three_solid_colours(spark):
    rows = [(i, 0, *[(0.2, 0.0, 0.0), (0.5, 0.1, 0.0), (0.9, 0.0, 0.1)][i % 3]) for i in range(300)]
    points = spark.createDataFrame(rows, "id int, grp int, l double, a double, b double")
    found = palette.discover(points, {0: 5}, 0.01)
    assert np.allclose(found[0], [(0.2, 0.0, 0.0), (0.5, 0.1, 0.0), (0.9, 0.0, 0.1)])
    entries = palette.assign(points, found, F.col("id") > 2).collect()
    assert all(r.entry == (r.id % 3 if r.id > 2 else None) for r in entries)


def counted(*points):
    """Shares of the points that lie nearest to each entry, the first on a tie."""

    def shares(entries):
        near = [min(range(len(entries)), key=lambda i: (math.dist(p, entries[i]), i)) for p in points for _ in range(1)]
        return [near.count(i) / len(points) for i in range(len(entries))]

    return shares


def test_merge_close_takes_shares_anew_at_every_step():
    points = [(0.5, 0, 0)] * 50 + [(0.505, 0, 0)] * 49 + [(0.9, 0, 0)]
    assert palette.merge_close([(0.5, 0, 0), (0.505, 0, 0), (0.9, 0, 0)], counted(*points), 0.05) == [pytest.approx((0.502475, 0, 0), abs=1e-6)]
    assert len(palette.merge_close([(0.1, 0, 0), (0.9, 0, 0)], counted((0.1, 0, 0), (0.9, 0, 0)), 0.9)) == 1
    # An entry that inherits the points of a dropped one is no longer too small.
    points = [(0.1, 0, 0)] * 6 + [(0.3, 0, 0)] * 7 + [(0.9, 0, 0)] * 87
    assert palette.merge_close([(0.1, 0, 0), (0.3, 0, 0), (0.9, 0, 0)], counted(*points), 0.1) == [(0.3, 0, 0), (0.9, 0, 0)]


def test_colours_that_print_as_one_merge_at_any_distance():
    from stratafold.functions.colour import hex_of

    a, b = (1.05, 0.0, 0.0), (1.2, 0.0, 0.0)
    assert hex_of(a) == hex_of(b) == "#FFFFFF"
    assert len(palette.merge_close([a, b, (0.5, 0, 0)], counted(a, b, (0.5, 0, 0)), 0.0)) == 2


def test_contour_of_a_cone_is_one_closed_line(spark):
    cone = [[20 - math.hypot(r - 10, c - 10) for c in range(21)] for r in range(21)]
    lines = contour.lines(contour.segments(grid(spark, cone), "z", F.array(F.lit(14.0 + 1e-6)))).collect()
    assert len(lines) == 1 and lines[0].closed and lines[0].length == pytest.approx(2 * math.pi * 6, rel=0.03)


def test_chain_goes_straight_on_at_branches():
    ends = [((0, 0), (1, 0)), ((1, 0), (2, 0)), ((1, 0), (1, 1))]
    assert contour.chain(ends) == [[(0, 0), (1, 0), (2, 0)]]
    # A loop that hangs on a branch starts there and closes; the tail to it is a line of its own.
    loop = [((2, 0), (3, 1)), ((3, 1), (4, 0)), ((4, 0), (3, -1)), ((3, -1), (2, 0)), ((2, 0), (1, 0)), ((1, 0), (0, 0))]
    lines = contour.chain(loop)
    assert sorted(map(len, lines)) == [3, 5] and next(x for x in lines if len(x) == 5)[0] == (2, 0)


def test_contour_lines_keep_rasters_apart(spark):
    cone = [[20 - math.hypot(r - 10, c - 10) for c in range(21)] for r in range(21)]
    two = grid(spark, cone).withColumn("tile", F.lit("a")).unionByName(grid(spark, cone).withColumn("tile", F.lit("b")))
    lines = contour.lines(contour.segments(two, "z", F.array(F.lit(14.0 + 1e-6)), ["tile"]), ["tile"]).collect()
    assert sorted((x.tile, x.closed) for x in lines) == [("a", True), ("b", True)]


TETRAHEDRON = [(0, 0, 2, 1), (1, 0, 1, 3), (2, 1, 2, 3), (3, 0, 3, 2)]
CORNERS = [(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0), (3, 0.0, 0.0, 1.0)]


def test_mesh_volume_edges_and_fans(spark):
    tris = spark.createDataFrame([(*t, 5) for t in TETRAHEDRON], "tid long, a long, b long, d long, material int")
    verts = spark.createDataFrame(CORNERS, "vid long, x double, y double, z double")
    m = mesh.measures(tris, verts).first()
    assert m.volume == pytest.approx(1 / 6) and m.triangles == 4
    assert mesh.edge_defects(tris).first() == (6, 0, 0, 0)
    assert mesh.edge_defects(tris.where("tid > 0")).first().open == 3
    turned = tris.withColumns({"b": F.col("d"), "d": F.col("b")})
    assert mesh.measures(turned, verts).first().volume == pytest.approx(-1 / 6)
    bow = spark.createDataFrame([(0, 9, 1, 2, 0), (1, 9, 3, 4, 0)], "tid long, a long, b long, d long, material int")
    assert [tuple(r) for r in mesh.vertex_fans(bow).collect()] == [(9, 2)]


def test_weld_merges_and_drops(spark):
    tris = spark.createDataFrame([(*t, 5) for t in [*TETRAHEDRON, (9, 4, 2, 1), (10, 0, 4, 3), (11, 1, 2, 0)]], "tid long, a long, b long, d long, material int")
    verts = spark.createDataFrame([*CORNERS, (4, 1e-7, -1e-7, -0.0)], "vid long, x double, y double, z double")
    faces, kept = mesh.weld(tris, verts)
    assert {r.tid for r in faces.collect()} == {0, 1, 2, 3, 11} and {r.vid for r in kept.collect()} == {0, 1, 2, 3}


def test_upsert_keeps_ids(spark):
    schema = "id string, name string, created int, updated int"
    old, new = spark.createDataFrame([("a", "x", 1, 1), ("b", "y", 1, 1)], schema), spark.createDataFrame([("c", "x", 9, 9), ("d", "z", 9, 9)], schema)
    got = {tuple(r) for r in tables.upsert(old, new, "name", ("id", "created")).collect()}
    assert got == {("a", "x", 1, 9, False), ("b", "y", 1, 1, None), ("d", "z", 9, 9, True)}


def test_edge_sign_is_the_same_from_both_sides_and_mixes(spark):
    df = spark.range(400).select(hashing.edge_sign(F.lit(7), F.lit(1), F.col("id"), F.lit(-3)).alias("s"), hashing.edge_sign(F.lit(7), F.lit(1), F.col("id"), F.lit(-3)).alias("t"))
    rows = df.collect()
    assert all(r.s == r.t and abs(r.s) == 1 for r in rows) and 120 < sum(r.s > 0 for r in rows) < 280


def test_fnv_vectors(spark):
    df = spark.createDataFrame([("",), ("a",), ("foobar",), (None,)], "t string")
    got = [r[0] for r in df.select(hashing.fnv1a64("t")).collect()]
    assert [None if v is None else v % 2**64 for v in got] == [0xCBF29CE484222325, 0xAF63DC4C8601EC8C, 0x85944171F73967E8, None]


def fnv(data):
    h = hashing.FNV_OFFSET
    for b in data:
        h = (h ^ b) * hashing.FNV_PRIME % 2**64
    return h - 2**64 if h >> 63 else h


def test_geometry_fingerprints_depend_on_order(spark):
    import struct

    lines = [[], [(1.5, -2.25)], [(1.5, -2.25), (0.1, 7.0)], [(0.1, 7.0), (1.5, -2.25)], None, [(float(i), -float(i)) for i in range(500)]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "id int, points array<struct<lat: double, lon: double>>").repartition(2)
    got = {r.id: r.h for r in df.select("id", hashing.geometry_fingerprint("points").alias("h")).collect()}
    assert got == {i: None if x is None else fnv(struct.pack("<Q", len(x)) + b"".join(struct.pack("<ff", *p) for p in x)) for i, x in enumerate(lines)}
    assert got[2] != got[3]


def test_overlay_by_brute_force(spark):
    rnd = random.Random(4)
    samples = [(i, rnd.choice([0, 1, 3]), rnd.choice([True, False, None])) for i in range(400)]
    found = [(rnd.randrange(400), rnd.choice(overlay.ROLES), rnd.randrange(30), rnd.choice([3, 26, 27, 5]), float(rnd.randrange(3))) for _ in range(1500)]
    for roads in (True, False):
        for buildings in (True, False):
            df = overlay.paint(spark.createDataFrame(samples, "k int, ground int, steep boolean"), spark.createDataFrame(found + found[:50], "k int, role string, seq int, class int, height double"), "k", roads, buildings)
            got = {r.k: (r["class"], r.height) for r in df.collect()}
            for k, ground, steep in samples:
                own = [c for c in found if c[0] == k]
                paved = any(c[1] == "aviation" or (c[1] == "area" and c[3] == 26) for c in own)
                shown = [c for c in own if not (c[1] == "building" and not buildings) and not (not roads and (c[1] in overlay.ROLES[2:8] or (c[1] == "area" and c[3] == 26))) and not (c[1] == "area" and c[3] == 3 and (steep or paved))]
                best = min(((overlay.ROLES.index(c[1]), -c[4] if c[1] == "building" else 0, -c[2], c[3]) for c in shown), default=None)
                expected = best[3] if best else 0 if ground == 3 and paved else ground
                assert got[k] == (expected, max((c[4] for c in own if c[1] == "building"), default=0.0))


def test_pavement_by_hand(spark):
    square = lambda x, y, s: [(x - s, y - s), (x + s, y - s), (x + s, y + s), (x - s, y + s), (x - s, y - s)]
    half = lambda ring: [("way", "outer", ring[:3]), ("way", "outer", ring[2:][::-1])]
    area, line = {"aeroway": "apron"}, {"aeroway": "taxiway"}
    elements = [
        (1, "relation", area, [], [*half(square(0.5, 0.5, 0.1)), ("way", "inner", square(0.5, 0.5, 0.02)), ("way", "outer", [(0.0, 0.0), (0.1, 0.1)]), ("node", "outer", square(0.2, 0.2, 0.1))]),
        (2, "way", area, square(0.8, 0.8, 0.05), None),
        (3, "way", area, [(0.1, 0.1), (0.2, 0.2), (0.1, 0.1)], None),
        (4, "way", line, [(0.45, 0.45), (0.55, 0.45)], None),
        (5, "way", line | {"width": "20 m"}, [(0.45, 0.45), (0.5, 0.5)], None),
        (6, "way", line, [(0.45, 0.45), (0.7, 0.7)], None),
        (7, "way", line, [(0.3, 0.3)], None),
        (8, "way", line | {"tunnel": "yes"}, [(0.3, 0.3), (0.4, 0.4)], None),
        (9, "relation", None, [], None),
        (10, "way", None, [(0.78, 0.8), (0.82, 0.8)], None),
    ]
    kind = "array<struct<x: double, y: double>>"
    df = spark.createDataFrame(elements, f"id long, kind string, tags map<string,string>, points {kind}, members array<struct<member_type: string, member_role: string, points: {kind}>>").repartition(3)
    areas, lines, counts = routes.pavement(df, "id", F.element_at("tags", "aeroway") == "apron", 64)
    assert {r.area: (len(r.shell), len(r.holes)) for r in areas.collect()} == {"1:0": (4, 1), "2": (4, 0)}
    assert {r.id: r.covered for r in lines.collect()} == {4: True, 5: False, 6: False, 10: True}
    assert counts.first().asDict() == {"relations": 1, "areas": 2, "holes": 1, "lines": 2, "duplicate_lines": 2, "mapped_widths": 1, "fallback_widths": 1, "tunnel_skipped": 1, "invalid_skipped": 3}


@pytest.mark.parametrize("value, metres", [("12", 12.0), ("12 m", 12.0), ("~5 ft", 1.524), ("12'6\"", 3.81), ("7'", 2.1336), ("1;2", None), ("ca. 50 cm", 0.5), ("approx 2 km", 2000.0), ("-3", None), ("0", None), ("wide", None), ("", None), (None, None), ("3 inches", 0.0762)])
def test_lengths(spark, value, metres):
    got = spark.createDataFrame([(value,)], "t string").select(tags.length_m(F.col("t"))).first()[0]
    assert got == (None if metres is None else pytest.approx(metres))


def test_versions_order(spark):
    df = spark.createDataFrame([(v,) for v in ("1.2.0", "v1.10.0-rc1", "1.9.9", "v1.10.0", "junk")], "v string")
    assert [r.v for r in df.where(text.semver_key(F.col("v")).isNotNull()).orderBy(text.semver_key(F.col("v"))).collect()] == ["1.2.0", "1.9.9", "v1.10.0-rc1", "v1.10.0"]


@pytest.mark.parametrize("error, kind", [("Flag socket overlaps", "markers"), ("build piece 2,3: elevation tile missing", "elevation"), ("build piece 2,3: thin", "piece"), ("outline crosses itself", "outline"), ("could not write 3MF", "output"), ("?", "other"), (None, None), ("shaped tray top-lip", "tray")])
def test_error_classes(spark, error, kind):
    assert spark.createDataFrame([(error,)], "e string").select(text.classify_error(F.col("e"))).first()[0] == kind


def test_zonal_max_reads_the_whole_raster(spark):
    data = DATA.replace("sf0.001", "sf0.01")
    assert rows(vectors.x20_zonal_max(spark, data)) == sql_rows(vectors.ORACLES["x20_zonal_max"], data)[1]


def test_roof_owner_reads_the_whole_raster(spark):
    data = DATA.replace("sf0.001", "sf0.01")
    assert rows(vectors.x23_roof_owner(spark, data)) == sql_rows(vectors.ORACLES["x23_roof_owner"], data)[1]


def test_upsert_of_all_exports_is_the_fold_of_upserts(spark):
    rows_of = fx.read(spark, DATA, "saved_setups").select("export_no", "name", "id", F.unix_micros("created_at").alias("created"), F.unix_micros("updated_at").alias("updated")).collect()
    table = {}
    for export in sorted({r.export_no for r in rows_of}):
        incoming = {}
        for r in rows_of:
            if r.export_no == export:
                i, c, u = incoming.get(r.name, (r.id, r.created, r.updated))
                incoming[r.name] = min(i, r.id), min(c, r.created), max(u, r.updated)
        table = {n: (*v[:3], None) for n, v in table.items()} | {n: (*(table[n][:2] if n in table else v[:2]), v[2], n not in table) for n, v in incoming.items()}
    got = {r.name: (r.id, r.created, r.updated, r.is_new) for r in bookkeeping.k09_upsert(spark, DATA).collect()}
    assert got == table and len(table) == len({r.name for r in rows_of})
