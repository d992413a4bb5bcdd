"""Queries of colour conversion, palettes, contours and curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratafold.functions import colour as C
from stratafold.functions import geo as G
from stratafold.operators import contour, palette, selecting, spatial
from stratafold.plans import fixtures as fx
from stratafold.plans.fixtures import with_views


def _lab(s: SparkSession, d: str) -> DataFrame:
    lab = C.linear_to_oklab(*(C.stretch(F.col(c)) for c in ("red", "green", "blue")))
    return fx.pixels(s, d).select("id", "grp", "valid", *(x.alias(n) for x, n in zip(lab, palette.AXES)))


def fn15_oklab(s: SparkSession, d: str) -> DataFrame:
    back = C.oklab_to_linear(*(F.col(x) for x in palette.AXES))
    return _lab(s, d).select("id", *(F.round(x, 5).alias(x) for x in palette.AXES), C.hex_colour(*back).alias("hex"))


def fn15_hex(s: SparkSession, d: str) -> DataFrame:
    named = fx.pixels(s, d).select("id", F.format_string("#%02X%02X%02X", F.col("red") % 256, F.col("green") % 256, F.col("blue") % 256).alias("hex"))
    return named.select("id", *(F.round(x, 6).alias(n) for x, n in zip(C.hex_linear(F.col("hex")), ("r", "g", "b"))))


def fn16_stretch(s: SparkSession, d: str) -> DataFrame:
    return fx.pixels(s, d).select("id", *(F.round(C.stretch(F.col(c)), 6).alias(c) for c in ("red", "green", "blue")))


def a05_lightness(s: SparkSession, d: str) -> DataFrame:
    return palette.normalize_lightness(_lab(s, d), 0.6).select("id", *(F.round(x, 5).alias(x) for x in palette.AXES))


def a06_diversity(s: SparkSession, d: str) -> DataFrame:
    return palette.diversity(_lab(s, d)).select("grp", "n", F.round("variance", 6).alias("variance"))


def a07_apportion(s: SparkSession, d: str) -> DataFrame:
    weighted = fx.pixels(s, d).groupBy("grp").agg(F.sum(F.col("red") % 97).cast("double").alias("weight"))
    return selecting.apportion(weighted, "weight", "grp", 11).select("grp", "share")


PALETTE = {0: [(0.5, 0.0, 0.0), (0.8, 0.0, 0.02)], 1: [(0.6, -0.05, 0.05)], 2: [(0.7, 0.02, -0.03), (0.9, 0.0, 0.0), (0.75, 0.05, 0.05)]}


def x32_group_nearest(s: SparkSession, d: str) -> DataFrame:
    """The nearest palette entry within the group, or of all where the group has none; null for invalid points."""
    return palette.assign(_lab(s, d), PALETTE, F.col("valid")).select("id", F.col("entry").cast("long").alias("entry"))


def a08_cluster_shares(s: SparkSession, d: str) -> DataFrame:
    assigned = palette.assign(_lab(s, d), PALETTE, F.col("valid")).where("entry IS NOT NULL")
    total = assigned.agg(F.count(F.lit(1)).alias("total"))
    return assigned.groupBy(F.col("entry").cast("long").alias("entry")).agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(total)).select("entry", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def g08_kmeans(s: SparkSession, d: str) -> DataFrame:
    """Centroids of three clusters a group, from the quantile seeds to convergence (32 rounds at most)."""
    found = palette.cluster(_lab(s, d).where("valid"), {g: 3 for g in range(4)})
    rows = [(g, i, *(round(x, 4) for x in c)) for g, entries in sorted(found.items()) for i, c in enumerate(entries)]
    return s.createDataFrame(rows, "grp long, k long, l double, a double, b double")


def g10_palette(s: SparkSession, d: str) -> DataFrame:
    """Discovery and assignment: colours, their share and group."""
    points = _lab(s, d).where("valid")
    found = palette.discover(points, {g: 3 for g in range(4)}, 0.02)
    assigned = palette.assign(points, found, F.lit(True))
    return assigned.groupBy("entry").agg(F.count(F.lit(1)).alias("n"), F.min("grp").alias("grp"))


LEVELS = (20.0, 60.0, 120.0)


def _levels() -> Column:
    return F.array(*(F.lit(v + 1e-6) for v in LEVELS))


def g05_contours(s: SparkSession, d: str) -> DataFrame:
    found = contour.segments(fx.cells(s, d), "z", _levels())
    ordered = [F.round(F.least("x0", "x1"), 4).alias("x_min"), F.round(F.greatest("x0", "x1"), 4).alias("x_max"), F.round(F.least("y0", "y1"), 4).alias("y_min"), F.round(F.greatest("y0", "y1"), 4).alias("y_max")]
    return found.select(F.round("level", 6).alias("level"), "r", "c", "half", *ordered)


def g06_contour_lines(s: SparkSession, d: str) -> DataFrame:
    return contour.lines(contour.segments(fx.cells(s, d), "z", _levels()))


def g07_class_boundary(s: SparkSession, d: str) -> DataFrame:
    """Boundary of the forest class: contour of its indicator at one half."""
    forest = fx.class_cells(s, d).select("r", "c", F.when(F.col("class") == 1, 1.0).otherwise(0.0).alias("z"))
    return contour.segments(forest, "z", F.array(F.lit(0.5))).groupBy("r").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))), 5).alias("length"))


def fn34_smooth(s: SparkSession, d: str) -> DataFrame:
    """Three Catmull-Rom points on each inner step of each line."""
    w = Window.partitionBy("line").orderBy("seq")
    near = fx.line_pts(s, d).select("line", F.row_number().over(w).alias("seg"), *(f(c, 1).over(w).alias(f"{c}{n}") for c in ("x", "y") for n, f in (("0", F.lag), ("2", F.lead))), "x", "y", F.lead("x", 2).over(w).alias("x3"), F.lead("y", 2).over(w).alias("y3"))
    steps = near.dropna().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(2))))
    t = F.col("i") / 3.0
    return steps.select("line", "seg", "i", *((F.round(G.catmull_rom(F.col(f"{c}0"), F.col(c), F.col(f"{c}2"), F.col(f"{c}3"), t), 6) + 0.0).alias(c) for c in ("x", "y")))


def fn19_bezier(s: SparkSession, d: str) -> DataFrame:
    """Points of a cubic curve over each area's box."""
    t = F.col("i") / 7.0
    u = 1 - t
    steps = fx.areas(s, d).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(7))))
    curve = lambda a, b, c, e: u * u * u * a + 3 * u * u * t * b + 3 * u * t * t * c + t * t * t * e
    west, east, south, north = F.col("cx") - F.col("h"), F.col("cx") + F.col("h"), F.col("cy") - F.col("h"), F.col("cy") + F.col("h")
    return steps.select("id", "i", F.round(curve(west, west, east, east), 6).alias("x"), F.round(curve(south, north, south, north), 6).alias("y"))


def x21_visible_runs(s: SparkSession, d: str) -> DataFrame:
    """Runs of each line's points that lie in the middle of the square."""
    w = Window.partitionBy("line").orderBy("seq")
    inside = fx.line_pts(s, d).withColumn("inside", F.col("x").between(0.2, 0.8) & F.col("y").between(0.1, 0.9))
    numbered = inside.withColumn("run", F.sum(F.when(F.coalesce(F.lag("inside").over(w) == F.col("inside"), F.lit(False)), 0).otherwise(1)).over(w)).where("inside")
    return numbered.groupBy("line", "run").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))


def x24_arc_point(s: SparkSession, d: str) -> DataFrame:
    """The point half-way along each line by length."""
    parts = spatial.segments(fx.line_pts(s, d), "line", "seq").withColumn("length", F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))).where("length > 0")
    w = Window.partitionBy("line")
    placed = parts.withColumns({"end": F.sum("length").over(w.orderBy("seg").rowsBetween(Window.unboundedPreceding, 0)), "half": F.sum("length").over(w) / 2})
    here = placed.where("end >= half").groupBy("line").agg(F.min(F.struct("seg", "x0", "y0", "x1", "y1", "length", "end", "half")).alias("p")).select("line", "p.*")
    t = (F.col("half") - F.col("end") + F.col("length")) / F.col("length")
    return here.select("line", F.round(F.col("x0") + (F.col("x1") - F.col("x0")) * t, 5).alias("x"), F.round(F.col("y0") + (F.col("y1") - F.col("y0")) * t, 5).alias("y"))


def x26_ring_points(s: SparkSession, d: str) -> DataFrame:
    """Sixteen points of the ellipse in each area's box."""
    angle = F.col("i") * (3.141592653589793 / 8)
    return fx.areas(s, d).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(15)))).select("id", "i", F.round(F.col("cx") + F.col("h") * F.cos(angle), 6).alias("x"), F.round(F.col("cy") + F.col("h") / 2 * F.sin(angle), 6).alias("y"))


QUERIES = {f.__name__: f for f in (fn15_oklab, fn15_hex, fn16_stretch, a05_lightness, a06_diversity, a07_apportion, x32_group_nearest, a08_cluster_shares, g08_kmeans, g10_palette, g05_contours, g06_contour_lines, g07_class_boundary, fn34_smooth, fn19_bezier, x21_visible_runs, x24_arc_point, x26_ring_points)}
_ST = "least(greatest({0} / 10000 / 0.3::DOUBLE, 0), 1)"


def _lin(m: tuple, names: tuple) -> str:
    return " + ".join(f"{k}::DOUBLE * {n}" for k, n in zip(m, names))


_LAB = f"lin AS (SELECT id, grp, valid, {_ST.format('red')} AS r, {_ST.format('green')} AS g, {_ST.format('blue')} AS bl FROM pixels), lms AS (SELECT id, grp, valid, " + ", ".join(f"cbrt({_lin(m, ('r', 'g', 'bl'))}) AS m{i}" for i, m in enumerate(C.RGB_TO_LMS)) + " FROM lin), lab AS (SELECT id, grp, valid, " + ", ".join(f"{_lin(m, ('m0', 'm1', 'm2'))} AS {n}" for m, n in zip(C.LMS_TO_LAB, palette.AXES)) + " FROM lms)"
_CUBES = ", ".join(f"(l + {x}::DOUBLE * a + {y}::DOUBLE * b) ^ 3 AS c{i}" for i, (x, y) in enumerate(C.LAB_TO_LMS))
_BYTE = "CAST(round(CASE WHEN {0} <= 0.0031308 THEN greatest({0}, 0) * 12.92 ELSE 1.055 * pow(least({0}, 1), 1 / 2.4::DOUBLE) - 0.055 END * 255) AS INT)"
_FLAT = [(g, c) for g, entries in sorted(PALETTE.items()) for c in entries]
_ENTRY = f"pal AS (SELECT * FROM (VALUES {', '.join(f'({n}, {g}, {c[0]}::DOUBLE, {c[1]}::DOUBLE, {c[2]}::DOUBLE)' for n, (g, c) in enumerate(_FLAT))}) v(entry, pg, pl, pa, pb)), near AS (SELECT id, valid, entry FROM lab, pal WHERE pg = grp OR grp NOT IN (SELECT pg FROM pal) QUALIFY row_number() OVER (PARTITION BY id ORDER BY (l - pl) ^ 2 + (a - pa) ^ 2 + (b - pb) ^ 2, entry) = 1)"
_TRI = """k AS (SELECT a.r, a.c, a.z AS z0, b.z AS z1, e.z AS z2, f.z AS z3 FROM {0} a JOIN {0} b ON b.r = a.r AND b.c = a.c + 1 JOIN {0} e ON e.r = a.r + 1 AND e.c = a.c + 1 JOIN {0} f ON f.r = a.r + 1 AND f.c = a.c),
t AS (SELECT r, c, 0 AS half, c AS xa, r AS ya, z0 AS za, c + 1 AS xb, r AS yb, z1 AS zb, c + 1 AS xc, r + 1 AS yc, z2 AS zc FROM k UNION ALL SELECT r, c, 1, c, r, z0, c + 1, r + 1, z2, c, r + 1, z3 FROM k),
q AS (SELECT *, za >= level AS ua, zb >= level AS ub, zc >= level AS uc FROM t, (VALUES {1}) v(level)),
p AS (SELECT r, c, half, level, list_filter([CASE WHEN ua <> ub THEN [xa + (xb - xa) * (level - za) / (zb - za), ya + (yb - ya) * (level - za) / (zb - za)] END, CASE WHEN ub <> uc THEN [xb + (xc - xb) * (level - zb) / (zc - zb), yb + (yc - yb) * (level - zb) / (zc - zb)] END,
 CASE WHEN uc <> ua THEN [xc + (xa - xc) * (level - zc) / (za - zc), yc + (ya - yc) * (level - zc) / (za - zc)] END], lambda x: x IS NOT NULL) AS e FROM q WHERE NOT (ua = ub AND ub = uc))"""


def _kmeans(rounds: int) -> str:
    out = ["pts AS MATERIALIZED (SELECT id, grp, l, a, b FROM lab WHERE valid)", "dis AS (SELECT grp, l, a, b, row_number() OVER (PARTITION BY grp ORDER BY l, a, b) - 1 AS k, count(*) OVER (PARTITION BY grp) AS n FROM (SELECT DISTINCT grp, l, a, b FROM pts))", "c0 AS (SELECT grp, i AS k, l, a, b FROM dis, range(3) t(i) WHERE dis.k = i * (n - 1) // 2)"]
    for i in range(rounds):
        out.append(f"s{i} AS MATERIALIZED (SELECT p.id, p.grp, p.l, p.a, p.b, c.k FROM pts p JOIN c{i} c ON c.grp = p.grp QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY (p.l - c.l) ^ 2 + (p.a - c.a) ^ 2 + (p.b - c.b) ^ 2, c.k) = 1)")
        out.append(f"c{i + 1} AS MATERIALIZED (SELECT c.grp, c.k, coalesce(avg(s.l), any_value(c.l)) AS l, coalesce(avg(s.a), any_value(c.a)) AS a, coalesce(avg(s.b), any_value(c.b)) AS b FROM c{i} c LEFT JOIN s{i} s ON s.grp = c.grp AND s.k = c.k GROUP BY c.grp, c.k)")
    return ", ".join(out) + f" SELECT grp, k, round(l, 4) AS l, round(a, 4) AS a, round(b, 4) AS b FROM c{rounds}"


ORACLES = {
    "fn15_oklab": with_views(f"WITH {_LAB}, cub AS (SELECT *, {_CUBES} FROM lab), rgb AS (SELECT *, " + ", ".join(f"{_lin(m, ('c0', 'c1', 'c2'))} AS v{i}" for i, m in enumerate(C.LMS_TO_RGB)) + " FROM cub) SELECT id, round(l, 5) AS l, round(a, 5) AS a, round(b, 5) AS b, '#' || " + " || ".join(f"upper(lpad(to_hex({_BYTE.format(f'v{i}')}), 2, '0'))" for i in range(3)) + " AS hex FROM rgb", "pixels"),
    "fn15_hex": with_views("SELECT id, " + ", ".join(f"round(CASE WHEN {c} % 256 / 255 <= 0.04045 THEN {c} % 256 / 255 / 12.92 ELSE pow(({c} % 256 / 255 + 0.055) / 1.055, 2.4) END, 6) AS {n}" for c, n in (("red", "r"), ("green", "g"), ("blue", "b"))) + " FROM pixels", "pixels"),
    "fn16_stretch": with_views("SELECT id, " + ", ".join(f"round({_ST.format(c)}, 6) AS {c}" for c in ("red", "green", "blue")) + " FROM pixels", "pixels"),
    "a05_lightness": with_views(f"WITH {_LAB}, f AS (SELECT *, CASE WHEN l > 1.2e-7 THEN least(greatest(1 + 0.6 * (avg(l) OVER (PARTITION BY grp) / l - 1), 0.5), 2) ELSE 1 END AS k FROM lab) SELECT id, round(l * k, 5) AS l, round(a * k, 5) AS a, round(b * k, 5) AS b FROM f", "pixels"),
    "a06_diversity": with_views(f"WITH {_LAB} SELECT grp, count(*) AS n, round(var_pop(l) + var_pop(a) + var_pop(b), 6) AS variance FROM lab GROUP BY grp", "pixels"),
    "a07_apportion": with_views("WITH w AS (SELECT grp, sum(red % 97)::DOUBLE AS wt FROM pixels GROUP BY grp), i AS (SELECT grp, wt / sum(wt) OVER () * (11 - count(*) OVER ()) AS ideal FROM w), r AS (SELECT *, 1 + floor(ideal) AS base, row_number() OVER (ORDER BY ideal - floor(ideal) DESC, grp) AS k FROM i) SELECT grp, CAST(base + CASE WHEN k <= 11 - sum(base) OVER () THEN 1 ELSE 0 END AS BIGINT) AS share FROM r", "pixels"),
    "x32_group_nearest": with_views(f"WITH {_LAB}, {_ENTRY} SELECT id, CASE WHEN valid THEN entry END::BIGINT AS entry FROM near", "pixels"),
    "a08_cluster_shares": with_views(f"WITH {_LAB}, {_ENTRY} SELECT entry::BIGINT AS entry, round(count(*) / (SELECT count(*) FROM near WHERE valid), 6) AS share FROM near WHERE valid GROUP BY 1", "pixels"),
    "g08_kmeans": with_views(f"WITH {_LAB}, {_kmeans(palette.ROUNDS)}", "pixels"),
    "g05_contours": with_views("WITH " + _TRI.format("cells", ", ".join(f"({v + 1e-6!r}::DOUBLE)" for v in LEVELS)) + " SELECT round(level, 6) AS level, r, c, half, round(least(e[1][1], e[2][1]), 4) AS x_min, round(greatest(e[1][1], e[2][1]), 4) AS x_max, round(least(e[1][2], e[2][2]), 4) AS y_min, round(greatest(e[1][2], e[2][2]), 4) AS y_max FROM p", "cells"),
    "g07_class_boundary": with_views("WITH forest AS (SELECT r, c, (CASE WHEN class = 1 THEN 1 ELSE 0 END)::DOUBLE AS z FROM class_cells), " + _TRI.format("forest", "(0.5::DOUBLE)") + " SELECT r, count(*) AS n, round(sum(sqrt((e[1][1] - e[2][1]) ^ 2 + (e[1][2] - e[2][2]) ^ 2)), 5) AS length FROM p GROUP BY r", "class_cells"),
    "fn34_smooth": with_views("WITH n AS (SELECT line, row_number() OVER w AS seg, lag(x) OVER w AS x0, x, lead(x) OVER w AS x2, lead(x, 2) OVER w AS x3, lag(y) OVER w AS y0, y, lead(y) OVER w AS y2, lead(y, 2) OVER w AS y3 FROM line_pts WINDOW w AS (PARTITION BY line ORDER BY seq)) SELECT line, seg::INT AS seg, i::INT AS i, " + ", ".join(f"round((((-0.5 * {c}0 + 1.5 * {c} - 1.5 * {c}2 + 0.5 * {c}3) * (i / 3) + ({c}0 - 2.5 * {c} + 2 * {c}2 - 0.5 * {c}3)) * (i / 3) + (-0.5 * {c}0 + 0.5 * {c}2)) * (i / 3) + {c}, 6) + 0.0::DOUBLE AS {c}" for c in ("x", "y")) + " FROM n, range(3) t(i) WHERE x0 IS NOT NULL AND x3 IS NOT NULL", "line_pts"),
    "fn19_bezier": with_views("SELECT id, i::INT AS i, round(((1 - i / 7) ^ 3 + 3 * (1 - i / 7) ^ 2 * (i / 7)) * (cx - h) + (3 * (1 - i / 7) * (i / 7) ^ 2 + (i / 7) ^ 3) * (cx + h), 6) AS x, round(((1 - i / 7) ^ 3 + 3 * (1 - i / 7) * (i / 7) ^ 2) * (cy - h) + (3 * (1 - i / 7) ^ 2 * (i / 7) + (i / 7) ^ 3) * (cy + h), 6) AS y FROM areas, range(8) t(i)", "areas"),
    "x21_visible_runs": with_views("WITH i AS (SELECT line, seq, x BETWEEN 0.2 AND 0.8 AND y BETWEEN 0.1 AND 0.9 AS ins FROM line_pts), f AS (SELECT *, sum(CASE WHEN prev IS NOT DISTINCT FROM ins THEN 0 ELSE 1 END) OVER (PARTITION BY line ORDER BY seq) AS run FROM (SELECT *, lag(ins) OVER (PARTITION BY line ORDER BY seq) AS prev FROM i)) SELECT line, run::BIGINT AS run, count(*) AS n, min(seq) AS first FROM f WHERE ins GROUP BY line, run", "line_pts"),
    "x24_arc_point": with_views("WITH s AS (SELECT line, row_number() OVER w AS seg, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM line_pts WINDOW w AS (PARTITION BY line ORDER BY seq)), l AS (SELECT *, sqrt((x1 - x0) ^ 2 + (y1 - y0) ^ 2) AS len FROM s WHERE x1 IS NOT NULL), e AS (SELECT *, sum(len) OVER (PARTITION BY line ORDER BY seg ROWS UNBOUNDED PRECEDING) AS fin, sum(len) OVER (PARTITION BY line) / 2 AS half FROM l WHERE len > 0) SELECT line, round(x0 + (x1 - x0) * (half - fin + len) / len, 5) AS x, round(y0 + (y1 - y0) * (half - fin + len) / len, 5) AS y FROM e WHERE fin >= half QUALIFY row_number() OVER (PARTITION BY line ORDER BY seg) = 1", "line_pts"),
    "x26_ring_points": with_views("SELECT id, i::INT AS i, round(cx + h * cos(i * pi() / 8), 6) AS x, round(cy + h / 2 * sin(i * pi() / 8), 6) AS y FROM areas, range(16) t(i)", "areas"),
}
