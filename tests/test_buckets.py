"""Work on buckets as arrays, against brute force."""

import random
from collections import Counter

import duckdb
import numpy as np

from stratafold.operators import kernels, overlay, polygons, sampling, spatial
from stratafold.queries import vectors
from tests import parity

RING = "array<struct<x: double, y: double>>"


def _inside(ring, x, y):
    odd = False
    for i, (ax, ay) in enumerate(ring):
        bx, by = ring[i - 1]
        odd ^= (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax
    return odd


def _shapes(rng, n):
    """Triangles of all sizes, some with a hole, one without any point."""
    made = [(-1, [], [])]
    for k in range(n):
        cx, cy, size = rng.random(), rng.random(), rng.choice([0.003, 0.03, 0.3, 1.2])
        ring = lambda f: [(cx + f * size * rng.uniform(-1, 1), cy + f * size * rng.uniform(-1, 1)) for _ in range(3)]  # noqa: E731, B023
        made.append((k, ring(1), [ring(0.3)] * (k % 3 == 0)))
    return made


def _spots(rng, n):
    return [(i, rng.uniform(-0.2, 1.2), rng.uniform(-0.2, 1.2)) for i in range(n)] + [(n, None, 0.5), (n + 1, 0.5, None)]


def test_points_of_areas_of_all_sizes_and_each_point_once(spark):
    rng = random.Random(5)
    shapes, spots = _shapes(rng, 60), _spots(rng, 400)
    areas, points = spark.createDataFrame(shapes, f"area int, shell {RING}, holes array<{RING}>"), spark.createDataFrame(spots, "id int, x double, y double")
    expected = {(i, k) for i, x, y in spots if None not in (x, y) for k, shell, holes in shapes if _inside(shell, x, y) and not any(_inside(h, x, y) for h in holes)}
    for buckets in (1, 8, 64, 20_000):
        got = [(r.id, r.area) for r in spatial.points_in_areas(points, areas, buckets).select("id", "area").collect()]
        assert len(got) == len(set(got)) and set(got) == expected
    # In one grid of few cells a point has one row, however many areas cover it.
    once = [r.id for r in spatial.points_in_areas(points, areas, 4, once=True).select("id").collect()]
    assert len(once) == len(set(once)) and set(once) == {i for i, _ in expected}


def _distance(x, y, x0, y0, x1, y1):
    dx, dy = x1 - x0, y1 - y0
    t = min(max(((x - x0) * dx + (y - y0) * dy) / (dx * dx + dy * dy), 0.0), 1.0) if dx or dy else 0.0
    return ((x - x0 - t * dx) ** 2 + (y - y0 - t * dy) ** 2) ** 0.5


def _lines(rng, n):
    """Segments of all lengths, some without length, every fifth twice."""
    made = []
    for k in range(n):
        x, y, size = rng.uniform(-0.2, 1.2), rng.uniform(-0.2, 1.2), rng.choice([0.0, 0.01, 0.2, 1.5])
        made += [(k, x, y, x + size * rng.uniform(-1, 1), y + size * rng.uniform(-1, 1))] * (1 + (k % 5 == 0))
    return made


def test_points_near_segments_of_all_lengths_by_brute_force(spark):
    rng = random.Random(6)
    lines, spots = _lines(rng, 150), _spots(rng, 300)
    parts, points = spark.createDataFrame(lines, "line int, x0 double, y0 double, x1 double, y1 double"), spark.createDataFrame(spots, "id int, x double, y double")
    expected = sorted((i, k[0]) for i, x, y in spots if None not in (x, y) for k in lines if _distance(x, y, *k[1:]) <= 0.05)
    for buckets in (1, 16, 64):
        assert sorted((r.id, r.line) for r in spatial.points_near_segments(points, parts, 0.05, buckets).collect()) == expected


def test_pairs_of_points_and_segments_by_brute_force(spark):
    rng = random.Random(12)
    lines, spots = _lines(rng, 150), _spots(rng, 300)
    # Points beyond the square on either side, twice, as dots; segments without an end, along an axis, and many in one place.
    spots += [(400, 7.0, 0.5), (401, -6.0, -6.0), (402, 0.3, 0.3), (402, 0.3, 0.3), (None, 0.31, 0.3), (403, float("nan"), 0.3)]
    lines += [(200, None, 0.1, 0.2, 0.3), (201, 0.1, 0.1, 0.2, None), (202, 6.9, 0.5, 7.1, 0.5), (203, -6.0, -7.0, -6.0, 2.0), (204, -8.0, 0.3, 8.0, 0.3), (205, 0.3, 0.3, 0.3, 0.3), (206, 0.2, float("nan"), 0.3, 0.3)]
    lines += [(300 + k, 0.2, 0.2, 0.8, 0.8) for k in range(5)]
    parts, points = spark.createDataFrame(lines, "line int, x0 double, y0 double, x1 double, y1 double"), spark.createDataFrame(spots, "id int, x double, y double")
    there = [(k, *at) for k, *at in lines if not any(v is None or v != v for v in at)]
    key = lambda row: (row[0] is None, row[0] or 0, *row[1:])
    for radius in (0.001, 0.05, 0.7):
        expected = sorted(((i, k, round(far, 6)) for i, x, y in spots if None not in (x, y) for k, *at in there if (far := _distance(x, y, *at)) <= radius), key=key)
        for bands, splits in ((1, 1), (2, 3), (5, 2)):
            got = sorted(((r.id, r.line, r.distance) for r in spatial.pairs_near_segments(points, parts, radius, 6, bands, splits).collect()), key=key)
            assert got == expected
    assert spatial.pairs_near_segments(points.limit(0), parts, 0.05, 6, 2, 2).count() == spatial.pairs_near_segments(points, parts.limit(0), 0.05, 6, 2, 2).count() == 0


def test_products_of_long_runs_are_cut_and_whole():
    runs = lambda *lengths: (np.cumsum(lengths) - np.array(lengths), np.array(lengths))
    first, second = runs(1, 700, 3, 256), runs(2, 600, 1000, 1)
    expected = {(i + at, j + to) for at, n, to, m in zip(*first, *second) for i in range(n) for j in range(m)}
    got = []
    for (offsets, entries), (others, more) in kernels.products(first, second):
        assert len(offsets) == len(others) and max(np.diff(offsets).max(), np.diff(others).max()) <= kernels.SIDE
        for k in range(len(offsets) - 1):
            got += [(i, j) for i in entries[offsets[k] : offsets[k + 1]] for j in more[others[k] : others[k + 1]]]
    assert len(got) == len(expected) and set(got) == expected


def _handed_over(df):
    """Rows that Python workers gave back while the plan ran."""

    def walk(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if "QueryStage" in name:
            return walk(node.plan())
        own = node.metrics().get("pythonNumRowsReceived")
        return (own.get().value() if own.isDefined() else 0) + sum(walk(node.children().apply(i)) for i in range(node.children().size()))

    return walk(df._jdf.queryExecution().executedPlan())


def test_pairs_within_a_distance_are_not_handed_over_one_by_one(spark, tmp_path):
    # 12 places, each with the segments of 100 lines: whatever is near one is near them all.
    orders = [(1000 * (k + 1) + 37 * at + 500 * end, 100 * at + k) for k in range(100) for at in range(12) for end in (0, 1)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(k,) for k in range(3000)], "c_custkey long").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    df = vectors.j05_within_distance(spark, str(tmp_path))
    got = parity.rows(df)
    with duckdb.connect() as db:
        for table in ("orders", "customer"):
            db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
        expected = db.execute(vectors.ORACLES["j05_within_distance"]).fetchall()
    assert len(expected) > 1000 and got == Counter(repr((distance, i, line, seg)) for i, line, seg, distance in expected)
    assert 0 < _handed_over(df) < len(expected) / 20


def test_segments_nearest_to_points_by_brute_force(spark):
    rng = random.Random(7)
    lines, spots = _lines(rng, 150), _spots(rng, 300)
    parts, points = spark.createDataFrame(lines, "line int, x0 double, y0 double, x1 double, y1 double"), spark.createDataFrame(spots, "id int, x double, y double")
    for radius, slack in ((0.1, 1e-9), (0.02, 0.005)):
        expected = []
        for i, x, y in spots:
            near = [(_distance(x, y, *k[1:]), k[0]) for k in lines if None not in (x, y)]
            least = min(near, default=(1e9, 0))[0]
            expected += [(i, k) for far, k in near if far <= min(radius, least + slack)]
        for buckets in (1, 16):
            # Two buckets never share a point, so none has the segments of another's nearest one.
            assert sorted((r.id, r.line) for r in spatial.points_near_segments(points, parts, radius, buckets, slack).collect()) == sorted(expected)


def test_painting_shapes_gives_what_painting_their_candidates_does(spark):
    rng = random.Random(8)
    shapes, lines = _shapes(rng, 60), _lines(rng, 60)
    shown = lambda k: (rng.choice((*overlay.ROLES, "unknown")), k, rng.choice((3, 26, 28)), float(k % 4))
    what = "role string, seq int, class int, height double"
    areas = spark.createDataFrame([(s, h, *shown(k)) for k, s, h in shapes], f"shell {RING}, holes array<{RING}>, {what}")
    thin = spark.createDataFrame([(*at, rng.choice([0.001, 0.02]), *shown(100 + k)) for k, *at in lines], f"x0 double, y0 double, x1 double, y1 double, half double, {what}")
    samples = spark.createDataFrame([(i, x, y, rng.choice([1, 3]), rng.choice([True, False, None])) for i, x, y in _spots(rng, 300) if None not in (x, y)], "cell int, x double, y double, ground int, steep boolean")
    points = samples.select("cell", "x", "y")
    over = spatial.points_in_areas(points, areas).unionByName(spatial.points_near_segments(points, thin, 0.02).where("distance <= half"), allowMissingColumns=True)
    plain = lambda df: sorted((r.cell, r["class"], r.height) for r in df.collect())
    for roads, buildings in ((True, True), (False, False), (True, False)):
        expected = plain(overlay.paint(samples, over.select("cell", "role", "seq", "class", "height"), "cell", roads, buildings))
        assert plain(overlay.paint_shapes(samples, areas, thin, "cell", roads, buildings)) == expected
    nothing = overlay.paint_shapes(samples, areas.limit(0), thin.limit(0), "cell")
    assert plain(nothing) == sorted((r.cell, r.ground, 0.0) for r in samples.collect())


def test_crossings_by_brute_force(spark):
    rng = random.Random(9)
    lines = [(k % 40, k // 40, *at) for k, *at in _lines(rng, 200)]
    turn = lambda q, x, y: (q[4] - q[2]) * (y - q[3]) - (q[5] - q[3]) * (x - q[2])
    cross = lambda p, q: turn(q, p[2], p[3]) * turn(q, p[4], p[5]) < 0 and turn(p, q[2], q[3]) * turn(p, q[4], q[5]) < 0
    expected = sorted((*p[:2], *q[:2]) for p in lines for q in lines if p[0] < q[0] and cross(p, q))
    parts = spark.createDataFrame([*lines, (99, 0, None, 0.5, 0.5, 0.5)], "line int, seg int, x0 double, y0 double, x1 double, y1 double")
    for buckets in (1, 16):
        assert sorted(map(tuple, spatial.crossings(parts, buckets).collect())) == expected
    # The pairs are not moved again: the only exchange is that of the segments.
    assert spatial.crossings(parts, 16)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_stations_read_the_cells_across_them_whatever_tiles_they_lie_in(spark):
    rng, rows, columns = random.Random(10), 150, 90
    cells = {(r, c): None if rng.random() < 0.1 else rng.uniform(0, 100) for r in range(rows) for c in range(columns) if rng.random() < 0.7}
    # A straight line along one axis: its stations, directions and cells across are known.
    lines = [(0, 0.01, 0.1, 0.3, 0.4, 0.3, 0.9, 0.3), (1, 0.3, 0.9, -0.2, 0.9, 0.3, 0.9, 1.2), (2, 0.02, 0.5, 0.5, 0.5, 0.5, 0.5, 0.5), (3, None, 0.1, 0.1, 0.2, 0.2, 0.3, 0.3)]
    expected = {}
    for k, half, x0, y0, _, _, x2, y2 in lines[:3]:
        for station in range(9):
            x, y, level = x0 + (x2 - x0) * station / 8, y0 + (y2 - y0) * station / 8, y0 == y2
            places = [(x if level else x - half * i / 2, y + half * i / 2 if level else y) for i in range(-2, 3)]
            clamp = lambda v: min(max(v, 0.0), 1.0)
            read = [(int(clamp(v) * (rows - 1) + 0.5), int(clamp(u) * (columns - 1) + 0.5)) for u, v in places]
            if there := [cells[p] for p in read if p in cells]:
                expected[k, station] = max((z for z in there if z is not None), default=None)
    raster = spark.createDataFrame([(*at, z) for at, z in cells.items()], "r long, c long, z double")
    df = spark.createDataFrame(lines, "id int, half double, x0 double, y0 double, x1 double, y1 double, x2 double, y2 double")
    got = sampling.highest_across(df, "id", raster, "z", rows, columns, 8, 0.005, 2).collect()
    assert len(got) == len(expected) and {(r.id, r.station): r.z for r in got} == expected


def test_ribbons_cut_back_window_by_window_have_the_area_of_one_cut(spark):
    rng = random.Random(11)
    walk = lambda: [(rng.uniform(-0.1, 1.1), rng.uniform(-0.1, 1.1)) for _ in range(3)]
    lines = [(k, walk(), rng.choice([0.01, 0.05])) for k in range(12)] + [(12, [(2.0, 2.0), (3.0, 3.0)], 0.1)]
    shells = [shell for _, shell, _ in _shapes(rng, 25) if shell and max(x for x, _ in shell) - min(x for x, _ in shell) < 0.5]
    window = [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]]
    for cut in (shells, [], [[(-1.0, -1.0), (2.0, -1.0), (2.0, 2.0), (-1.0, 2.0)]]):
        df, obstacles = spark.createDataFrame(lines, f"id int, points {RING}, half double"), spark.createDataFrame([(c,) for c in cut], f"shell {RING}")
        got = {r.id: r.area for r in polygons.ribbons(df, "id", obstacles, 4).collect()}
        assert got.keys() == {k for k, _, _ in lines}
        for k, points, half in lines:
            assert abs(got[k] - polygons.area_of(polygons.clip_to(polygons.ribbon(points, half), window, [[c] for c in cut]))) < 1e-9


def test_wide_areas_are_paved_over_in_few_cells_of_a_fine_grid(spark):
    # One grid of 20,000 cells a side would hold this area 400 million times.
    areas = spark.createDataFrame([(0, [(-1.0, -1.0), (2.0, -1.0), (2.0, 2.0), (-1.0, 2.0)], [])], f"area int, shell {RING}, holes array<{RING}>")
    points = spark.createDataFrame([(i, i / 9.0, i / 9.0) for i in range(10)], "id int, x double, y double")
    assert spatial.points_in_areas(points, areas, 20_000).count() == 10
