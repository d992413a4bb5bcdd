"""Kriging stencils, coasts, clipping and outline checks on known answers."""

import numpy as np
import pytest

from stratafold.operators import kriging, outlines, polygons


def test_stencils_sum_to_one_and_hit_their_node():
    table = kriging.stencils(3.0, 0.0)
    assert np.allclose(table.sum(axis=2), 1)
    # Without a nugget a target on a node takes that node's value.
    assert np.allclose(table[0, 0], np.eye(16)[5]) and np.allclose(table[kriging.STEPS, kriging.STEPS], np.eye(16)[10])
    assert np.allclose(table[3, 8].reshape(4, 4), table[3, 8].reshape(4, 4)[:, ::-1])


def area(rings):
    return sum(abs(outlines.shoelace(r)) for r in rings)


def test_water_lies_right_of_the_coast():
    east = [(-0.2, 0.3), (0.5, 0.3), (1.2, 0.3)]
    assert area(outlines.sea([east])[0]) == pytest.approx(0.3)
    assert area(outlines.sea([east[::-1]])[0]) == pytest.approx(0.7)
    split = [east[1:], east[:2]]
    assert area(outlines.sea(split)[0]) == pytest.approx(0.3)


def test_strait_bay_island_and_broken_coast():
    strait = [[(-0.1, 0.7), (1.1, 0.7)], [(1.1, 0.4), (-0.1, 0.4)]]
    outers, islands = outlines.sea(strait)
    assert len(outers) == 1 and area(outers) == pytest.approx(0.3) and not islands
    bay = [[(0.3, -0.1), (0.3, 0.5), (0.6, 0.5), (0.6, -0.1)]]
    assert area(outlines.sea(bay)[0]) == pytest.approx(0.15)
    island = [[(0.4, 0.4), (0.4, 0.6), (0.6, 0.6), (0.6, 0.4), (0.4, 0.4)]]
    outers, islands = outlines.sea(island)
    assert area(outers) == pytest.approx(1) and area(islands) == pytest.approx(0.04)
    assert outlines.sea([[(-0.1, 0.5), (0.5, 0.5)]]) is None
    assert outlines.sea([]) is None


def test_convex_clip_and_simplify():
    window = [(0, 0), (1, 0), (1, 1), (0, 1)]
    assert abs(outlines.shoelace(outlines.clip_convex([(0.5, 0.5), (1.5, 0.5), (1.5, 1.5), (0.5, 1.5)], window))) == pytest.approx(0.25)
    assert outlines.clip_convex([(2, 2), (3, 2), (3, 3)], window) == []
    assert outlines.simplify([(0, 0), (0.5, 0), (1, 0), (1, 1), (0.5, 0.5)]) == [(0, 0), (1, 0), (1, 1)]
    # A spike turns back on its line and stays; so does an arc whose chord would stray.
    assert outlines.simplify([(0, 0), (2, 0), (1, 0), (1, 1)]) == [(0, 0), (2, 0), (1, 0), (1, 1)]
    arc = [(np.cos(t), np.sin(t)) for t in np.linspace(0, 2 * np.pi, 2000, endpoint=False)]
    kept = outlines.simplify(arc)
    assert 3 < len(kept) < 1000 and abs(abs(outlines.shoelace(kept)) - np.pi) < 5e-3


def test_chains_join_end_to_start():
    line = lambda *xs: [(float(x), 0.0) for x in xs]
    assert outlines.join_chains([line(2, 3), line(0, 1), line(1, 2), line(7, 8)]) == [line(0, 1, 2, 3), line(7, 8)]
    assert outlines.join_chains([line(5)]) == []
    circle = [[(0, 0), (1, 0)], [(1, 1), (0, 0)], [(1, 0), (1, 1)]]
    assert outlines.join_chains(circle) == [[(0, 0), (1, 0), (1, 1), (0, 0)]]
    many = [[(float(i), 0.0), (float(i + 1), 0.0)] for i in reversed(range(5000))]
    assert [len(c) for c in outlines.join_chains(many)] == [5001]


def test_rings_assemble_from_either_end():
    a, b, c = [(0, 0), (1, 0)], [(1, 1), (1, 0)], [(1, 1), (0, 1), (0, 0)]
    rings, dropped = outlines.assemble_rings([a, b, c, [(5, 5), (6, 6)], [(9, 9)]])
    assert dropped == 1 and len(rings) == 1 and sorted(rings[0]) == [(0, 0), (0, 1), (1, 0), (1, 1)] and abs(outlines.shoelace(rings[0])) == 1


def test_kriged_classes_against_the_stencils(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(2)
    k = rng.integers(0, 3, (9, 8))
    native = spark.createDataFrame([(r, c, int(k[r, c])) for r in range(9) for c in range(8)], "r long, c long, k int")
    points = [(i, float(y), float(x)) for i, (y, x) in enumerate(zip(rng.uniform(0, 8, 60), rng.uniform(0, 7, 60)))]
    got = {r.id: r.value for r in kriging.smooth(spark.createDataFrame(points, "id int, y double, x double"), native, F.col("y"), F.col("x"), "k", 9, 8).collect()}
    table = kriging.stencils(3.0, 0.1)
    for i, y, x in points:
        r, c = min(int(y), 7), min(int(x), 6)
        near = k[np.clip(np.arange(r - 1, r + 3), 0, 8)][:, np.clip(np.arange(c - 1, c + 3), 0, 7)].ravel()
        w = table[int((y - r) * 16 + 0.5), int((x - c) * 16 + 0.5)]
        assert got[i] == max((round(w[near == v].sum(), 9), v) for v in set(near.tolist()))[1]


def test_outline_problems(spark):
    rings = {"ok": [(0, 0), (1, 0), (1, 1)], "points": [(0, 0), (1, 0)], "outside": [(0, 0), (1.1, 0), (1, 1)], "same place": [(0, 0), (0, 0), (1, 1)], "crossing": [(0, 0), (1, 1), (1, 0), (0, 1)], "small": [(0, 0), (0.01, 0), (0, 0.01)]}
    df = spark.createDataFrame([(k, [(float(x), float(y)) for x, y in r]) for k, r in rings.items()], "id string, ring array<struct<x: double, y: double>>")
    got = {r.id: r.problem for r in outlines.outline_problems(df, "id", "ring", 1e-3).collect()}
    assert got == {k: None if k == "ok" else k for k in rings}


def covers(shape, x, y):
    """Even-odd over all rings of a shape at many points."""
    inside = np.zeros(len(x), bool)
    for ring in shape:
        for (ax, ay), (bx, by) in zip(ring, [*ring[1:], *ring[:1]]):
            with np.errstate(divide="ignore", invalid="ignore"):
                inside ^= ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
    return inside


def test_booleans_against_sampling():
    rng = np.random.default_rng(8)
    x, y = rng.uniform(-1.2, 1.2, (2, 40_000))
    star = lambda n, r, cx, cy: [(cx + (r if k % 2 else r / 3) * np.cos(k * np.pi / n), cy + (r if k % 2 else r / 3) * np.sin(k * np.pi / n)) for k in range(2 * n)]
    for n in range(3, 8):
        a = [star(n, 1.0, 0.05, 0.0), star(3, 0.2, 0.05, 0.0)[::-1]]
        b = [star(5, 0.8, 0.2, 0.1)]
        c = [[(-0.5, -0.5), (0.5, 0.5), (0.5, -0.5), (-0.5, 0.5)]]
        ina, inb, inc = covers(a, x, y), covers(b, x, y), covers(c, x, y)
        for got, expected in ((polygons.union([a, b, c]), ina | inb | inc), (polygons.intersection([a, b]), ina & inb), (polygons.difference(a, [b, c]), ina & ~inb & ~inc)):
            # Every point lies in one trapezoid if it is kept and in none otherwise.
            held = np.zeros(len(x), int)
            for low, high, p, q, r, s in got:
                t = (y - low) / (high - low)
                held += (t > 0) & (t < 1) & (x > p + (r - p) * t) & (x < q + (s - q) * t)
            assert (held == expected).mean() > 0.9999 and held.max() <= 1
            triangles = polygons.triangles_of(got)
            d1, d2 = triangles[:, 1] - triangles[:, 0], triangles[:, 2] - triangles[:, 0]
            parts = (d1[:, 0] * d2[:, 1] - d1[:, 1] * d2[:, 0]) / 2
            assert (parts > 0).all() and parts.sum() == pytest.approx(polygons.area_of(got))
        assert polygons.area_of(polygons.union([a, b])) == pytest.approx(polygons.area_of(polygons.union([a])) + polygons.area_of(polygons.union([b])) - polygons.area_of(polygons.intersection([a, b])))


def test_odd_polygons():
    square = [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)]]
    beside = [[(1.0, 0.0), (2.0, 0.0), (2.0, 1.0), (1.0, 1.0)]]
    assert polygons.area_of(polygons.union([square, square])) == pytest.approx(1) and polygons.area_of(polygons.intersection([square, beside])) == pytest.approx(0)
    assert polygons.area_of(polygons.union([square, beside])) == pytest.approx(2)
    assert len(polygons.union([])) == len(polygons.union([[[(0, 0), (1, 1)]], []])) == 0
    straight = polygons.area_of(polygons.clip_to(polygons.ribbon([(-0.5, 0.5), (1.5, 0.5)], 0.1), [square[0][:4]]))
    assert straight == pytest.approx(0.2)
    bent = polygons.area_of(polygons.union(polygons.ribbon([(0, 0), (1, 0), (1, 1), (0, 0)], 0.05)))
    assert 0.1 * (2 + 2**0.5) * 0.9 < bent < 0.1 * (2 + 2**0.5)
