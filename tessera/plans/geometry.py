"""Queries on resampling, deformation, lines, differences, morphology and components."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import grid as g
from .bindings import PIX, SIDE, raster
from .grids import COMPONENTS, HISTOGRAM, MASK, RGB, mask, pixels, r, rgb  # noqa: F401

QUERIES, ORACLE_SQL = {}, {}
N = SIDE


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


CUBIC = "CASE WHEN abs({t}) < 1 THEN (1.5 * abs({t}) - 2.5) * {t} * {t} + 1 WHEN abs({t}) < 2 THEN ((-0.5 * abs({t}) + 2.5) * abs({t}) - 4) * abs({t}) + 2 ELSE 0 END"


@query(f"""WITH {PIX}, t AS (SELECT x.i::INT AS x, y.i::INT AS y, x.i * {N - 1} / 44.0 AS sx, y.i * {N - 1} / 19.0 AS sy FROM range(45) x(i), range(20) y(i)),
 k AS (SELECT t.*, floor(sx)::INT + a.i::INT - 1 AS px, floor(sy)::INT + b.i::INT - 1 AS py FROM t, range(4) a(i), range(4) b(i)), w AS (SELECT *, {CUBIC.format(t='(sx - px)')} * {CUBIC.format(t='(sy - py)')} AS w FROM k)
SELECT p.image_id, w.x, w.y, round(sum(w.w * p.v), 4) AS v FROM w JOIN pix p ON p.x = least(greatest(px, 0), {N - 1}) AND p.y = least(greatest(py, 0), {N - 1}) GROUP BY 1, 2, 3""")
def grid_resample_bicubic(spark, d):
    return g.resample_bicubic(raster(spark, d), 45, 20).select("image_id", "x", "y", r("v", 4).alias("v"))


@query(f"""WITH {PIX}, t AS (SELECT x.i::INT AS x, y.i::INT AS y, x.i * {N - 1} / 19.0 AS sx, y.i * {N - 1} / 19.0 AS sy FROM range(20) x(i), range(20) y(i)),
 s AS (SELECT p.image_id, t.x, t.y, sum(p.v * (1 - abs(sx - p.x)) * (1 - abs(sy - p.y))) AS v FROM t JOIN pix p ON p.x > sx - 1 AND p.x < sx + 1 AND p.y > sy - 1 AND p.y < sy + 1 GROUP BY 1, 2, 3),
 c AS (SELECT image_id, x.i::INT AS x, y.i::INT AS y FROM (SELECT DISTINCT image_id FROM pix), range(48) x(i), range(20) y(i))
SELECT c.image_id, c.x, c.y, round(coalesce(s.v, -1), 4) AS v FROM c LEFT JOIN s ON s.image_id = c.image_id AND s.x = c.x - 14 AND s.y = c.y""")
def grid_resample_keeping_aspect(spark, d):
    return g.resample_keeping_aspect(raster(spark, d), N, N, 48, 20, -1.0).select("image_id", "x", "y", r("v", 4).alias("v"))


@query(f"WITH {PIX}, t AS (SELECT x.i::INT AS x, y.i::INT AS y FROM range(45) x(i), range(77) y(i)) SELECT image_id, t.x, t.y, v FROM t JOIN pix p ON p.x = t.x * {N} // 45 AND p.y = t.y * {N} // 77")
def grid_resample_nearest(spark, d):
    return pixels(g.resample_nearest(raster(spark, d), 45, 77))


PLACES = "p AS (SELECT image_id, i.i AS k, (i.i * 0.37 - 3)::DOUBLE AS sx, (i.i * 0.61 - 5)::DOUBLE AS sy FROM (SELECT DISTINCT image_id FROM pix), range(100) i(i))"


def places(spark, d):
    ids = raster(spark, d).select("image_id").distinct()
    return ids.crossJoin(spark.range(100).select(F.col("id").alias("k"))).select("image_id", "k", (F.col("k") * 0.37 - 3).alias("sx"), (F.col("k") * 0.61 - 5).alias("sy"))


@query(f"""WITH {PIX}, {PLACES}, c AS (SELECT *, least(greatest(sx, 0), {N - 1}) AS u, least(greatest(sy, 0), {N - 1}) AS w FROM p)
SELECT c.image_id, k, round(sum(v * (1 - abs(u - x)) * (1 - abs(w - y))), 5) AS v FROM c JOIN pix ON pix.image_id = c.image_id AND abs(u - x) < 1 AND abs(w - y) < 1 GROUP BY 1, 2""")
def grid_interpolate(spark, d):
    """Values between pixels; places beyond the border are moved to it."""
    return g.interpolated_at(raster(spark, d), places(spark, d)).select("image_id", "k", r("v", 5).alias("v"))


@query(f"""WITH {PIX}, {PLACES}, c AS (SELECT *, floor(sx)::INT AS i, floor(sy)::INT AS j, sx - floor(sx) AS a, sy - floor(sy) AS b FROM p), e AS (SELECT c.*, m.i::INT AS mi, n.i::INT AS ni FROM c, range(2) m(i), range(2) n(i))
SELECT e.image_id, k, round(sum(v * (CASE WHEN mi = 1 THEN a ELSE 1 - a END) * (CASE WHEN ni = 1 THEN b ELSE 1 - b END)), 5) AS v FROM e JOIN pix ON pix.image_id = e.image_id AND x = (e.i + mi + {4 * N}) % {N} AND y = (e.j + ni + {4 * N}) % {N} GROUP BY 1, 2""")
def grid_interpolate_periodic(spark, d):
    return g.interpolated_at(raster(spark, d), places(spark, d), "periodic").select("image_id", "k", r("v", 5).alias("v"))


@query(f"WITH {PIX}, l AS (SELECT image_id, x, v FROM pix WHERE y = 5) SELECT p.image_id, p.x, p.y, CASE WHEN p.y = 20 THEN 2 * l.v ELSE p.v END AS v FROM pix p JOIN l ON l.image_id = p.image_id AND l.x = p.x")
def grid_lines(spark, d):
    """A row taken out, doubled and put in the place of another."""
    px = raster(spark, d)
    return pixels(g.with_line(px, "y", 20, g.line(px, "y", 5).withColumn("v", 2 * F.col("v"))))


@query(f"WITH {PIX}, e AS (SELECT max(image_id) AS top FROM pix) SELECT x, y + image_id * {N + 3} AS y, v FROM pix UNION ALL SELECT x.i::INT, (k.i * {N + 3} + {N} + q.i)::INT, -1.0 FROM e, (SELECT DISTINCT image_id AS i FROM pix) k, range({N}) x(i), range(3) q(i) WHERE k.i < top")
def grid_stack(spark, d):
    return g.stacked(raster(spark, d), 3, -1.0).select("x", "y", "v")


@query(f"""WITH {PIX}, s AS (SELECT *, floor(v / 100)::INT AS label FROM pix), b AS (SELECT image_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM s WHERE label = (SELECT max(label) FROM s) GROUP BY 1)
SELECT s.image_id, x - x0 AS x, y - y0 AS y, v FROM s JOIN b ON b.image_id = s.image_id WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1""")
def grid_crop_segment(spark, d):
    """Every image cut to the box of the highest label."""
    px = raster(spark, d)
    labels = px.select("image_id", "x", "y", F.floor(F.col("v") / 100).cast("int").alias("label"))
    return pixels(g.crop_segment(px, labels, labels.agg(F.max("label")).first()[0]))


@query(f"""WITH {PIX}, c AS (SELECT x.i * 4 AS px, y.i * 4 AS py FROM range(7) x(i), range(7) y(i))
SELECT image_id, px::INT AS px, py::INT AS py, round(sum(v * exp(-((x - px - 3.5) ** 2 + (y - py - 3.5) ** 2) / 8)), 5) AS s FROM c JOIN pix ON x BETWEEN px AND px + 7 AND y BETWEEN py AND py + 7 GROUP BY 1, 2, 3""")
def patch_gaussian(spark, d):
    """Patches times a Gaussian, summed."""
    w = [math.exp(-((k % 8 - 3.5) ** 2 + (k // 8 - 3.5) ** 2) / 8) for k in range(64)]
    p = g.weighted_patches(g.patches(raster(spark, d), 8, 4), w)
    return p.select("image_id", "px", "py", r(F.aggregate("p", F.lit(0.0), lambda a, x: a + x), 5).alias("s"))


@query(f"""WITH {PIX}, t AS (SELECT x.i::INT AS x, y.i::INT AS y FROM range({2 * N - 1}) x(i), range({2 * N - 1}) y(i))
SELECT image_id, t.x, t.y, round(sum(v * (1 - abs(t.x / 2.0 - p.x)) * (1 - abs(t.y / 2.0 - p.y))), 5) AS v FROM t JOIN pix p ON abs(t.x / 2.0 - p.x) < 1 AND abs(t.y / 2.0 - p.y) < 1 GROUP BY 1, 2, 3""")
def grid_prolongate(spark, d):
    return g.prolongated(raster(spark, d)).select("image_id", "x", "y", r("v", 5).alias("v"))


@query(f"""WITH {PIX}, t AS (SELECT x.i::INT AS x, y.i::INT AS y FROM range({(N + 1) // 2}) x(i), range({(N + 1) // 2}) y(i))
SELECT image_id, t.x, t.y, round(sum(v * (1 - abs(2 * t.x - p.x) / 2.0) * (1 - abs(2 * t.y - p.y) / 2.0)) / sum((1 - abs(2 * t.x - p.x) / 2.0) * (1 - abs(2 * t.y - p.y) / 2.0)), 5) AS v FROM t JOIN pix p ON abs(2 * t.x - p.x) < 2 AND abs(2 * t.y - p.y) < 2 GROUP BY 1, 2, 3""")
def grid_restrict(spark, d):
    return g.restricted(raster(spark, d)).select("image_id", "x", "y", r("v", 5).alias("v"))


FIELD = "f AS (SELECT image_id, x, y, 1.3 * sin(0.4 * y) AS dx, 0.7 * cos(0.3 * x) AS dy FROM pix)"


def field(px):
    return px.select("image_id", "x", "y", (1.3 * F.sin(0.4 * F.col("y"))).alias("dx"), (0.7 * F.cos(0.3 * F.col("x"))).alias("dy"))


@query(f"""WITH {PIX}, {FIELD}, c AS (SELECT image_id, x, y, least(greatest(x + dx, 0), {N - 1}) AS u, least(greatest(y + dy, 0), {N - 1}) AS w FROM f)
SELECT c.image_id, c.x, c.y, round(sum(p.v * (1 - abs(u - p.x)) * (1 - abs(w - p.y))), 5) AS v FROM c JOIN pix p ON p.image_id = c.image_id AND abs(u - p.x) < 1 AND abs(w - p.y) < 1 GROUP BY 1, 2, 3""")
def grid_deform(spark, d):
    px = raster(spark, d)
    return g.deformed(px, field(px)).select("image_id", "x", "y", r("v", 5).alias("v"))


@query(f"""WITH {PIX}, {FIELD}, c AS (SELECT image_id, x, y, dx, dy, least(greatest(x + dx, 0), {N - 1}) AS u, least(greatest(y + dy, 0), {N - 1}) AS w FROM f)
SELECT c.image_id, c.x, c.y, round(max(c.dx) + sum(p.dx * (1 - abs(u - p.x)) * (1 - abs(w - p.y))), 6) AS dx, round(max(c.dy) + sum(p.dy * (1 - abs(u - p.x)) * (1 - abs(w - p.y))), 6) AS dy
FROM c JOIN f p ON p.image_id = c.image_id AND abs(u - p.x) < 1 AND abs(w - p.y) < 1 GROUP BY 1, 2, 3""")
def grid_concatenate_fields(spark, d):
    """A displacement after itself."""
    px = raster(spark, d)
    f = field(px)
    return g.concatenated_fields(f, f, px.select("image_id", "nx", "ny").distinct()).select("image_id", "x", "y", r("dx").alias("dx"), r("dy").alias("dy"))


def inverse_sql(rounds: int) -> str:
    out, last = f"WITH {PIX}, {FIELD}, e0 AS (SELECT image_id, x, y, 0.0::DOUBLE AS dx, 0.0::DOUBLE AS dy FROM pix)", "e0"
    for k in range(rounds):
        out += f""", c{k} AS (SELECT image_id, x, y, least(greatest(x + dx, 0), {N - 1}) AS u, least(greatest(y + dy, 0), {N - 1}) AS w FROM {last}),
 e{k + 1} AS (SELECT c.image_id, c.x, c.y, -sum(p.dx * (1 - abs(u - p.x)) * (1 - abs(w - p.y))) AS dx, -sum(p.dy * (1 - abs(u - p.x)) * (1 - abs(w - p.y))) AS dy FROM c{k} c JOIN f p ON p.image_id = c.image_id AND abs(u - p.x) < 1 AND abs(w - p.y) < 1 GROUP BY 1, 2, 3)"""
        last = f"e{k + 1}"
    return out + f" SELECT image_id, x, y, round(dx, 6) + 0.0 AS dx, round(dy, 6) + 0.0 AS dy FROM {last}"


@query(inverse_sql(4))
def grid_inverse_field(spark, d):
    """Four rounds towards the inverse of a displacement."""
    px = raster(spark, d)
    return g.inverse_field(field(px), px.select("image_id", "nx", "ny").distinct(), 4).select("image_id", "x", "y", r("dx").alias("dx"), r("dy").alias("dy"))


@query(f"WITH {PIX} SELECT image_id, x, sum(v) AS v FROM pix GROUP BY 1, 2")
def grid_column_sums(spark, d):
    return g.line_sums(raster(spark, d), "y")


@query(f"""WITH {PIX} SELECT image_id, x, y, CASE WHEN x = 0 THEN lead(v) OVER h - v WHEN x = {N - 1} THEN v - lag(v) OVER h ELSE 0.5 * (lead(v) OVER h - lag(v) OVER h) END AS gx,
 CASE WHEN y = 0 THEN lead(v) OVER k - v WHEN y = {N - 1} THEN v - lag(v) OVER k ELSE 0.5 * (lead(v) OVER k - lag(v) OVER k) END AS gy FROM pix WINDOW h AS (PARTITION BY image_id, y ORDER BY x), k AS (PARTITION BY image_id, x ORDER BY y)""")
def grad_one_sided(spark, d):
    return g.gradient_one_sided(raster(spark, d))


AT = "least(greatest({a}, 0), %d)" % (N - 1)


@query(f"""WITH {PIX}, k(dx, dy, xx, xy, yy) AS (VALUES (0, 0, -2, 0, -2), (1, 0, 1, 0, 0), (-1, 0, 1, 0, 0), (0, 1, 0, 0, 1), (0, -1, 0, 0, 1), (1, 1, 0, 0.25, 0), (-1, -1, 0, 0.25, 0), (1, -1, 0, -0.25, 0), (-1, 1, 0, -0.25, 0))
SELECT p.image_id, p.x, p.y, sum(k.xx * q.v)::DOUBLE AS xx, sum(k.xy * q.v)::DOUBLE AS xy, sum(k.yy * q.v)::DOUBLE AS yy FROM pix p CROSS JOIN k JOIN pix q ON q.image_id = p.image_id AND q.x = {AT.format(a='p.x + k.dx')} AND q.y = {AT.format(a='p.y + k.dy')} GROUP BY 1, 2, 3""")
def grid_hessian(spark, d):
    return g.hessian(raster(spark, d))


@query(f"WITH {PIX}, f AS (SELECT p.image_id, p.x, p.y, max(q.v) AS top FROM pix p JOIN pix q ON q.image_id = p.image_id AND abs(q.x - p.x) <= 1 AND abs(q.y - p.y) <= 1 GROUP BY 1, 2, 3) SELECT p.image_id, p.x, p.y, v FROM pix p JOIN f ON f.image_id = p.image_id AND f.x = p.x AND f.y = p.y WHERE v >= top")
def position_local_maxima(spark, d):
    return pixels(g.position_local_maxima(raster(spark, d)))


@query(f"WITH {PIX}, {MASK} SELECT p.image_id, p.x, p.y, bool_or(q.m) AS m FROM mask p JOIN mask q ON q.image_id = p.image_id AND q.y = p.y AND abs(q.x - p.x) <= 1 GROUP BY 1, 2, 3")
def mask_dilate_along(spark, d):
    return g.dilate_along(mask(spark, d), "x").select("image_id", "x", "y", "m")


def upwind_sql(name: str, source: str, speed: float, tau: float) -> str:
    pick = ("greatest", "least") if speed > 0 else ("least", "greatest")
    part = "{a}(v - coalesce(lag(v) OVER {w}, v), 0) ** 2 + {b}(coalesce(lead(v) OVER {w}, v) - v, 0) ** 2"
    both = " + ".join(part.format(a=pick[0], b=pick[1], w=w) for w in "hk")
    return f"{name} AS (SELECT image_id, x, y, v - {tau} * {speed} * sqrt({both}) AS v FROM {source} WINDOW h AS (PARTITION BY image_id, y ORDER BY x), k AS (PARTITION BY image_id, x ORDER BY y))"


@query(f"WITH {PIX}, {upwind_sql('a', 'pix', -1.0, 0.5)}, {upwind_sql('b', 'a', -1.0, 0.5)}, {upwind_sql('c', 'b', 1.0, 0.5)}, {upwind_sql('e', 'c', 1.0, 0.5)} SELECT image_id, x, y, round(v, 5) AS v FROM e")
def gray_closing(spark, d):
    """Dilation by a disc of radius 1, then erosion, each in two upwind steps."""
    return g.gray_morphology(raster(spark, d), "closing", 2).select("image_id", "x", "y", r("v", 5).alias("v"))


@query(f"""{COMPONENTS}, k AS (SELECT image_id, label FROM l GROUP BY 1, 2 HAVING avg(x) BETWEEN 8 AND 23 AND avg(y) BETWEEN 8 AND 23 AND min(least(x, y, {N - 1} - x, {N - 1} - y)) > 0) SELECT l.image_id, x, y, l.label FROM l JOIN k ON k.image_id = l.image_id AND k.label = l.label""")
def components_by_center(spark, d):
    """Components off the border whose centre lies in the middle of the image."""
    labels = g.labelled(mask(spark, d))
    at = labels.groupBy("image_id", "label").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.min(F.least("x", "y", N - 1 - F.col("x"), N - 1 - F.col("y"))).alias("gap"))
    good = at.where("cx BETWEEN 8 AND 23 AND cy BETWEEN 8 AND 23 AND gap > 0")
    return labels.join(good, ["image_id", "label"], "left_semi").select("image_id", "x", "y", F.col("label").cast("long").alias("label"))


@query(f"""{COMPONENTS}, w AS (SELECT image_id, label, k.i AS k, max(cos(pi() * k.i / 18) * x + sin(pi() * k.i / 18) * y) - min(cos(pi() * k.i / 18) * x + sin(pi() * k.i / 18) * y) AS w FROM l, range(36) k(i) GROUP BY 1, 2, 3)
SELECT image_id, label, round(min(w), 6) AS least, round(max(w), 6) AS most FROM w GROUP BY 1, 2""")
def component_diameters(spark, d):
    x = g.component_diameters(g.labelled(mask(spark, d)))
    return x.select("image_id", F.col("label").cast("long").alias("label"), r("least").alias("least"), r("most").alias("most"))


@query(f"""{COMPONENTS}, n AS (SELECT a.image_id, a.label, b.label AS near, min((a.x - b.x) ** 2 + (a.y - b.y) ** 2)::BIGINT AS d2 FROM l a JOIN l b ON b.image_id = a.image_id AND b.label <> a.label AND abs(b.x - a.x) <= 5 AND abs(b.y - a.y) <= 5 GROUP BY 1, 2, 3)
SELECT image_id, label, near, d2 FROM n""")
def component_neighbours(spark, d):
    """Components with a pixel in the square of five pixels around one of the other's, and their squared distance."""
    labels = g.labelled(mask(spark, d)).withColumn("nx", F.lit(N)).withColumn("ny", F.lit(N))
    around = [(a, b, 1.0) for a in range(-5, 6) for b in range(-5, 6)]
    sent = g.sent(labels, around, "zero").select("image_id", "x", "y", F.col("label").alias("near"), (F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).alias("d2"))
    # merged: Spark doesn't count the 121 rows a pixel and would send one of the tables whole
    own = sent.join(labels.select("image_id", "x", "y", "label").hint("merge"), ["image_id", "x", "y"]).where("near <> label")
    return own.groupBy("image_id", F.col("label").cast("long").alias("label"), F.col("near").cast("long").alias("near")).agg(F.min("d2").cast("long").alias("d2"))


TOPS = f"""f AS (SELECT p.image_id, p.x, p.y, max(q.v) AS top FROM pix p JOIN pix q ON q.image_id = p.image_id AND q.x BETWEEN p.x - 2 AND p.x + 2 AND q.y BETWEEN p.y - 2 AND p.y + 2 GROUP BY 1, 2, 3),
 m AS (SELECT p.image_id, p.x, p.y FROM pix p JOIN f ON f.image_id = p.image_id AND f.x = p.x AND f.y = p.y WHERE p.v >= top AND p.x BETWEEN 2 AND {N - 3} AND p.y BETWEEN 2 AND {N - 3})"""


@query(f"WITH {PIX}, {TOPS} SELECT a.image_id, a.x, a.y, min((a.x - b.x) ** 2 + (a.y - b.y) ** 2)::BIGINT AS d2 FROM m a JOIN m b ON b.image_id = a.image_id AND (b.x <> a.x OR b.y <> a.y) GROUP BY 1, 2, 3")
def nearest_neighbour_distance(spark, d):
    """Of each local maximum, the squared distance to the nearest other one in its image, which holds few."""
    m = g.local_maxima(raster(spark, d), 2).select("image_id", "x", "y")
    other = m.select("image_id", F.col("x").alias("u"), F.col("y").alias("w"))
    d2 = (F.col("x") - F.col("u")) * (F.col("x") - F.col("u")) + (F.col("y") - F.col("w")) * (F.col("y") - F.col("w"))
    return m.join(other, "image_id").where("x <> u OR y <> w").groupBy("image_id", "x", "y").agg(F.min(d2).cast("long").alias("d2"))


BINNED = f"""b AS (SELECT p.x, p.y, p.c, least(floor((v - a) * 11 / (e.b - e.a)), 10)::INT AS bin FROM ch p JOIN (SELECT c, min(v) AS a, max(v) AS b FROM ch GROUP BY 1) e ON e.c = p.c), o AS (SELECT i.i::INT - 3 AS i FROM range(7) i(i))"""


@query(f"""WITH {RGB}, ch AS (SELECT x, y, 0 AS c, r AS v FROM rgb UNION ALL SELECT x, y, 1, g FROM rgb UNION ALL SELECT x, y, 2, b FROM rgb), {BINNED}
SELECT p.x, p.y, q.bin + 11 * p.c AS feature, round(count(*) / 49.0, 8) AS share FROM b p CROSS JOIN o dx CROSS JOIN o dy JOIN b q ON q.c = p.c AND q.x = {AT.format(a='p.x + dx.i')} AND q.y = {AT.format(a='p.y + dy.i')} GROUP BY 1, 2, 3""")
def local_histogram_rgb(spark, d):
    """Local histograms of three channels, one after another."""
    made = F.array(*[F.struct(F.lit(k).alias("image_id"), F.col(c).alias("v")) for k, c in enumerate("rgb")])
    px = rgb(spark, d).select("x", "y", F.inline(made)).select("image_id", "x", "y", "v", F.lit(N).alias("nx"), F.lit(N).alias("ny"))
    return g.local_histogram(px, 7, 11).select("x", "y", (F.col("bin") + 11 * F.col("image_id")).alias("feature"), r("share", 8).alias("share"))
