"""Queries on images: geometry, stencils, histograms, components, color."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import color
from ..operators import grid as g
from ..operators import ordering as o
from ..operators import segmentation as sg
from ..operators import vector as v
from .bindings import PIX, SIDE, raster

QUERIES, ORACLE_SQL = {}, {}
N = SIDE


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r(c, n=6):
    return F.round(c, n)


def pixels(df):
    return df.select("image_id", "x", "y", r("v").alias("v"))


def kernel_sql(kernel) -> str:
    return "k(dx, dy, w) AS (VALUES " + ", ".join(f"({a}, {b}, {w!r}::DOUBLE)" for a, b, w in kernel) + ")"


REFLECT = "CASE WHEN {c} < 0 THEN -({c}) WHEN {c} >= %d THEN %d - ({c}) ELSE {c} END" % (N, 2 * (N - 1))
CLIP = "least(greatest({c}, 0), %d)" % (N - 1)
PERIODIC = "(({c}) %% %d + %d) %% %d" % (N, N, N)


def correlation_sql(kernel, rule: str) -> str:
    at = lambda c: rule.replace("%%", "%").format(c=c)
    return f"""WITH {PIX}, {kernel_sql(kernel)}
SELECT p.image_id, p.x, p.y, round(sum(k.w * q.v), 6) AS v FROM pix p CROSS JOIN k JOIN pix q
  ON q.image_id = p.image_id AND q.x = {at('p.x + k.dx')} AND q.y = {at('p.y + k.dy')} GROUP BY 1, 2, 3"""


# ---- geometry ----


@query(f"WITH {PIX} SELECT image_id, x - 4 AS x, y - 6 AS y, v FROM pix WHERE x BETWEEN 4 AND 19 AND y BETWEEN 6 AND 13")
def grid_block(spark, d):
    return pixels(g.crop(raster(spark, d), 4, 6, 16, 8))


@query(f"""WITH {PIX}, t AS (SELECT image_id, x, y, CASE WHEN x < 3 OR y > 27 THEN 0 ELSE v + 1 END AS v FROM pix), b AS (SELECT image_id, min(x) x0, max(x) x1, min(y) y0, max(y) y1 FROM t WHERE v <> 0 GROUP BY 1)
SELECT t.image_id, x - x0 AS x, y - y0 AS y, v FROM t JOIN b ON t.image_id = b.image_id WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1""")
def grid_crop_borders(spark, d):
    px = raster(spark, d).withColumn("v", F.when((F.col("x") < 3) | (F.col("y") > 27), 0.0).otherwise(F.col("v") + 1))
    return pixels(g.crop_borders(px, 0.0))


@query(f"WITH {PIX}, c AS (SELECT i.i::INT AS image_id, x.i::INT AS x, y.i::INT AS y FROM (SELECT DISTINCT image_id AS i FROM pix) i, range(40) x(i), range(20) y(i)) SELECT c.image_id, c.x, c.y, coalesce(p.v, -1.0) AS v FROM c LEFT JOIN pix p ON c.image_id = p.image_id AND p.x = c.x - 4 AND p.y = c.y + 6")
def grid_pad(spark, d):
    return pixels(g.pad(raster(spark, d), 40, 20, -1.0))


@query(f"WITH {PIX} SELECT image_id, {N - 1} - x AS x, y, v FROM pix")
def grid_flip(spark, d):
    return pixels(g.flip(raster(spark, d), "x"))


@query(f"WITH {PIX} SELECT image_id, {N - 1} - y AS x, x AS y, v FROM pix")
def grid_rotate90(spark, d):
    return pixels(g.rotate90(raster(spark, d)))


@query(f"WITH {PIX} SELECT image_id, (x + 5) % {N} AS x, (y + {N} - 3) % {N} AS y, v FROM pix")
def grid_shift_periodic(spark, d):
    return pixels(g.shift_periodic(raster(spark, d), 5, -3))


@query(f"WITH {PIX} SELECT image_id, {N - 1} - x AS x, {N - 1} - y AS y, v FROM pix")
def grid_mirror_center(spark, d):
    return pixels(g.mirror_center(raster(spark, d)))


@query(f"WITH {PIX} SELECT image_id, (x * 2 + i.i)::INT AS x, (y * 2 + j.i)::INT AS y, v FROM pix, range(2) i(i), range(2) j(i)")
def grid_upsample_nearest(spark, d):
    return pixels(g.upsample_nearest(raster(spark, d), 2))


@query(f"""WITH {PIX}, t AS (SELECT x.i::INT AS x, y.i::INT AS y, x.i * {N - 1} / 44.0 AS sx, y.i * {N - 1} / 19.0 AS sy FROM range(45) x(i), range(20) y(i))
SELECT p.image_id, t.x, t.y, round(sum(p.v * (1 - abs(sx - p.x)) * (1 - abs(sy - p.y))), 4) AS v FROM t JOIN pix p ON p.x > sx - 1 AND p.x < sx + 1 AND p.y > sy - 1 AND p.y < sy + 1 GROUP BY 1, 2, 3""")
def grid_resample_bilinear(spark, d):
    return g.resample_bilinear(raster(spark, d), 45, 20).select("image_id", "x", "y", r("v", 4).alias("v"))


@query(f"WITH {PIX} SELECT image_id, y, sum(v) AS v FROM pix GROUP BY 1, 2")
def grid_line_sums(spark, d):
    return g.line_sums(raster(spark, d), "x")


@query(f"WITH {PIX} SELECT image_id, round(sum(x * v) / sum(v), 6) AS cx, round(sum(y * v) / sum(v), 6) AS cy FROM pix GROUP BY 1")
def grid_center_of_mass(spark, d):
    s = F.sum("v")
    return raster(spark, d).groupBy("image_id").agg(r(F.sum(F.col("x") * F.col("v")) / s).alias("cx"), r(F.sum(F.col("y") * F.col("v")) / s).alias("cy"))


@query(f"""WITH {PIX}, c AS (SELECT x.i * 4 AS px, y.i * 4 AS py FROM range(7) x(i), range(7) y(i))
SELECT image_id, px::INT AS px, py::INT AS py, sum(v) AS s, max(v) AS m, count(*) AS n FROM c JOIN pix ON x BETWEEN px AND px + 7 AND y BETWEEN py AND py + 7 GROUP BY 1, 2, 3""")
def patch_extract(spark, d):
    p = g.patches(raster(spark, d), 8, 4)
    return p.select("image_id", "px", "py", F.aggregate("p", F.lit(0.0), lambda a, x: a + x).alias("s"), F.array_max("p").alias("m"), F.size("p").cast("long").alias("n"))


@query(f"WITH {PIX} SELECT image_id, x, y, v FROM pix")
def patch_rebuild(spark, d):
    return pixels(g.rebuilt(g.patches(raster(spark, d), 8, 4), 8))


# ---- stencils ----


def as_kernel(k) -> g.Kernel:
    """A kernel [y, x] as (dx, dy, weight)."""
    o = k.shape[0] // 2
    return [(x - o, y - o, float(k[y, x])) for y in range(k.shape[0]) for x in range(k.shape[1])]


def gaussian(size: int, sigma: float) -> g.Kernel:
    return as_kernel(sg.gaussian(size, sigma))


def gabor(size: int, theta: float) -> g.Kernel:
    return as_kernel(sg.gabor(size, theta))


def formula_sql(size: int, weight: str, rule: str) -> str:
    """Correlation with a kernel that SQL computes by itself from dx and dy; tot is the sum of exp(-r^2 / 2 sigma^2) where a formula needs it."""
    at = lambda c: rule.replace("%%", "%").format(c=c)
    h = size // 2
    return f"""WITH {PIX}, o AS (SELECT a.i - {h} AS dx, b.i - {h} AS dy FROM range({size}) a(i), range({size}) b(i)), k AS (SELECT dx, dy, {weight} AS w FROM o)
SELECT p.image_id, p.x, p.y, round(sum(k.w * q.v), 6) AS v FROM pix p CROSS JOIN k JOIN pix q ON q.image_id = p.image_id AND q.x = {at('p.x + k.dx')} AND q.y = {at('p.y + k.dy')} GROUP BY 1, 2, 3"""


GABOR_SQL = "exp(-(dx * dx + dy * dy) / (2 * {s} * {s})) * cos(2 * pi() / (2 * {s}) * (dy * cos({t}) + dx * sin({t}))) / (2 * pi() * {s} * {s})"


SOBEL = [(-1, -1, -1.0), (1, -1, 1.0), (-1, 0, -2.0), (1, 0, 2.0), (-1, 1, -1.0), (1, 1, 1.0)]


@query(formula_sql(5, "exp(-(dx * dx + dy * dy) / 2.88) / sum(exp(-(dx * dx + dy * dy) / 2.88)) OVER ()", REFLECT))
def conv_reflect_gauss(spark, d):
    return pixels(g.correlate(raster(spark, d), gaussian(5, 1.2), "reflect"))


@query(formula_sql(7, GABOR_SQL.format(s="1.5", t="pi() / 6"), REFLECT))
def conv_gabor(spark, d):
    return pixels(g.correlate(raster(spark, d), gabor(7, math.pi / 6), "reflect"))


@query(formula_sql(5, "-exp(-(dx * dx + dy * dy) / 2.0) / sum(exp(-(dx * dx + dy * dy) / 2.0)) OVER () * (1 - (dx * dx + dy * dy) / 2.0) / pi()", REFLECT))
def conv_log(spark, d):
    return pixels(g.correlate(raster(spark, d), as_kernel(sg.laplacian_of_gaussian(5, 1.0)), "reflect"))


@query(correlation_sql(SOBEL, PERIODIC))
def conv_periodic_kernel(spark, d):
    return pixels(g.correlate(raster(spark, d), SOBEL, "periodic"))


@query(f"""WITH {PIX} SELECT p.image_id, p.x, p.y, round(sum(w * q.v) / sum(w), 6) AS v FROM
 (SELECT p.image_id, p.x, p.y, q.v, exp(-((q.x - p.x) ** 2 + (q.y - p.y) ** 2) / 4.5) * exp(-((q.v - p.v) ** 2) / 20000.0) AS w FROM pix p JOIN pix q ON q.image_id = p.image_id AND q.x BETWEEN p.x - 2 AND p.x + 2 AND q.y BETWEEN p.y - 2 AND p.y + 2) p, (SELECT 1) z GROUP BY 1, 2, 3""".replace("q.v) / sum(w)", "v) / sum(w)"))
def filter_bilateral(spark, d):
    return pixels(g.bilateral(raster(spark, d), 2, 1.5, 100.0))


@query(f"""WITH {PIX}, f AS (SELECT p.image_id, p.x, p.y, list_sort(list(q.v)) AS l FROM pix p JOIN pix q ON q.image_id = p.image_id AND q.x BETWEEN p.x - 1 AND p.x + 1 AND q.y BETWEEN p.y - 1 AND p.y + 1 GROUP BY 1, 2, 3)
SELECT image_id, x, y, l[len(l) // 2 + 1] AS v FROM f""")
def filter_median(spark, d):
    return pixels(g.median_filter(raster(spark, d)))


FORWARD = "SELECT image_id, x, y, coalesce(lead(v) OVER (PARTITION BY image_id, y ORDER BY x) - v, 0) AS gx, coalesce(lead(v) OVER (PARTITION BY image_id, x ORDER BY y) - v, 0) AS gy FROM pix"


@query(f"WITH {PIX} {FORWARD}")
def grad_forward(spark, d):
    return g.gradient_forward(raster(spark, d)).select("image_id", "x", "y", "gx", "gy")


@query(f"""WITH {PIX}, f AS ({FORWARD})
SELECT image_id, x, y, gx - coalesce(lag(gx) OVER (PARTITION BY image_id, y ORDER BY x), 0) + gy - coalesce(lag(gy) OVER (PARTITION BY image_id, x ORDER BY y), 0) AS v FROM f""")
def div_backward(spark, d):
    return pixels(g.divergence_backward(g.gradient_forward(raster(spark, d))))


@query(f"""WITH {PIX} SELECT p.image_id, p.x, p.y, 0.5 * (a.v - b.v) AS gx, 0.5 * (c.v - e.v) AS gy FROM pix p
 JOIN pix a ON a.image_id = p.image_id AND a.y = p.y AND a.x = (p.x + 1) % {N} JOIN pix b ON b.image_id = p.image_id AND b.y = p.y AND b.x = (p.x + {N - 1}) % {N}
 JOIN pix c ON c.image_id = p.image_id AND c.x = p.x AND c.y = (p.y + 1) % {N} JOIN pix e ON e.image_id = p.image_id AND e.x = p.x AND e.y = (p.y + {N - 1}) % {N}""")
def grad_central(spark, d):
    return g.gradient_central(raster(spark, d))


def derivative_kernels(sigma: float, size: int) -> list[g.Kernel]:
    """x, y, xx, xy, yy derivatives of a Gaussian, each without mean."""
    h, s2 = size // 2, sigma * sigma
    e = lambda a, b: math.exp(-(a * a + b * b) / (2 * s2))
    forms = [lambda a, b: -a / s2, lambda a, b: -b / s2, lambda a, b: (a * a - s2) / s2**2, lambda a, b: a * b / s2**2, lambda a, b: (b * b - s2) / s2**2]
    out = []
    for f in forms:
        k = [(a, b, f(a, b) * e(a, b)) for b in range(-h, h + 1) for a in range(-h, h + 1)]
        mean = sum(w for _, _, w in k) / len(k)
        out.append([(a, b, w - mean) for a, b, w in k])
    return out


@query(f"""WITH {PIX}, o AS (SELECT a.i - 2 AS dx, b.i - 2 AS dy, exp(-((a.i - 2) ** 2 + (b.i - 2) ** 2) / 2.0) AS e FROM range(5) a(i), range(5) b(i)),
 n AS (SELECT dx, dy, -dx * e AS kx, -dy * e AS ky, (dx * dx - 1) * e AS kxx, dx * dy * e AS kxy, (dy * dy - 1) * e AS kyy FROM o),
 k AS (SELECT dx, dy, kx - avg(kx) OVER () AS kx, ky - avg(ky) OVER () AS ky, kxx - avg(kxx) OVER () AS kxx, kxy - avg(kxy) OVER () AS kxy, kyy - avg(kyy) OVER () AS kyy FROM n),
 s AS (SELECT p.image_id, p.x, p.y, sum(kx * q.v) AS a, sum(ky * q.v) AS b, sum(kxx * q.v) AS xx, sum(kxy * q.v) AS xy, sum(kyy * q.v) AS yy FROM pix p CROSS JOIN k JOIN pix q ON q.image_id = p.image_id AND q.x = {PERIODIC.replace('%%', '%').format(c='p.x + k.dx')} AND q.y = {PERIODIC.replace('%%', '%').format(c='p.y + k.dy')} GROUP BY 1, 2, 3)
SELECT image_id, x, y, round((xx * a * a + 2 * xy * a * b + yy * b * b) / CASE WHEN a * a + b * b = 0 THEN 1 ELSE a * a + b * b END, 4) AS second, round(sqrt(a * a + b * b), 5) AS gradient FROM s""")
def canny(spark, d):
    """Second derivative along the gradient, 0 where there is none, and the gradient's size."""
    kx, ky, kxx, kxy, kyy = derivative_kernels(1.0, 5)
    s = g.correlate(raster(spark, d), kx, "periodic", ("b", ky), ("xx", kxx), ("xy", kxy), ("yy", kyy))
    a, b = F.col("v"), F.col("b")
    size = a * a + b * b
    second = (F.col("xx") * a * a + 2 * F.col("xy") * a * b + F.col("yy") * b * b) / F.when(size == 0, F.lit(1.0)).otherwise(size)
    return s.select("image_id", "x", "y", r(second, 4).alias("second"), r(F.sqrt(size), 5).alias("gradient"))


@query(f"""WITH {PIX} SELECT p.image_id, p.x, p.y, CASE WHEN p.x < 2 OR p.y < 2 OR p.x > {N - 3} OR p.y > {N - 3} THEN -1.0 ELSE (a.v - b.v) ** 2 + (c.v - e.v) ** 2 END AS v FROM pix p
 LEFT JOIN pix a ON a.image_id = p.image_id AND a.y = p.y AND a.x = p.x + 2 LEFT JOIN pix b ON b.image_id = p.image_id AND b.y = p.y AND b.x = p.x - 2
 LEFT JOIN pix c ON c.image_id = p.image_id AND c.x = p.x AND c.y = p.y + 2 LEFT JOIN pix e ON e.image_id = p.image_id AND e.x = p.x AND e.y = p.y - 2""")
def edge_indicator(spark, d):
    return pixels(g.edge_indicator(raster(spark, d), 2))


@query(f"""WITH {PIX}, f AS (SELECT p.image_id, p.x, p.y, max(q.v) AS top FROM pix p JOIN pix q ON q.image_id = p.image_id AND q.x BETWEEN p.x - 2 AND p.x + 2 AND q.y BETWEEN p.y - 2 AND p.y + 2 GROUP BY 1, 2, 3)
SELECT p.image_id, p.x, p.y, p.v FROM pix p JOIN f ON f.image_id = p.image_id AND f.x = p.x AND f.y = p.y WHERE p.v >= top AND p.x BETWEEN 2 AND {N - 3} AND p.y BETWEEN 2 AND {N - 3}""")
def local_maxima(spark, d):
    return pixels(g.local_maxima(raster(spark, d), 2))


MASK = "mask AS (SELECT p.image_id, p.x, p.y, p.v > a.m AS m FROM pix p JOIN (SELECT image_id, avg(v) + stddev_samp(v) AS m FROM pix GROUP BY 1) a ON a.image_id = p.image_id)"


def mask(spark, d):
    px = raster(spark, d)
    level = px.groupBy("image_id").agg((F.avg("v") + F.stddev_samp("v")).alias("t"))
    return px.join(level, "image_id").select("image_id", "x", "y", "nx", "ny", (F.col("v") > F.col("t")).alias("m"))


@query(f"WITH {PIX}, {MASK} SELECT p.image_id, p.x, p.y, bool_or(q.m) AS m FROM mask p JOIN mask q ON q.image_id = p.image_id AND abs(q.x - p.x) + abs(q.y - p.y) <= 1 GROUP BY 1, 2, 3")
def mask_dilate(spark, d):
    return g.dilate(mask(spark, d)).select("image_id", "x", "y", "m")


@query(f"WITH {PIX}, {MASK}, big AS (SELECT p.image_id, p.x, p.y, p.v > a.m AS m FROM pix p JOIN (SELECT image_id, avg(v) - 2 * stddev_samp(v) AS m FROM pix GROUP BY 1) a ON a.image_id = p.image_id) SELECT p.image_id, p.x, p.y, bool_and(q.m) AS m FROM big p JOIN big q ON q.image_id = p.image_id AND abs(q.x - p.x) + abs(q.y - p.y) <= 1 GROUP BY 1, 2, 3")
def mask_erode(spark, d):
    px = raster(spark, d)
    level = px.groupBy("image_id").agg((F.avg("v") - 2 * F.stddev_samp("v")).alias("t"))
    big = px.join(level, "image_id").select("image_id", "x", "y", "nx", "ny", (F.col("v") > F.col("t")).alias("m"))
    return g.erode(big).select("image_id", "x", "y", "m")


HISTOGRAM = f"""b AS (SELECT p.*, CASE WHEN e.b = e.a THEN 0 ELSE least(floor((v - a) * 11 / (e.b - e.a)), 10)::INT END AS bin FROM pix p JOIN (SELECT image_id, min(v) AS a, max(v) AS b FROM pix GROUP BY 1) e ON e.image_id = p.image_id),
 o AS (SELECT i.i::INT - 3 AS i FROM range(7) i(i))"""


@query(f"""WITH {PIX}, {HISTOGRAM}
SELECT p.image_id, p.x, p.y, q.bin, round(count(*) / 49.0, 8) AS share FROM b p CROSS JOIN o dx CROSS JOIN o dy JOIN b q ON q.image_id = p.image_id AND q.x = {CLIP.format(c='p.x + dx.i')} AND q.y = {CLIP.format(c='p.y + dy.i')} GROUP BY 1, 2, 3, 4""")
def local_histogram(spark, d):
    return g.local_histogram(raster(spark, d), 7, 11).select("image_id", "x", "y", "bin", r("share", 8).alias("share"))


def spectral_sql() -> str:
    kernels = " UNION ALL ".join(f"SELECT {k} AS f, dx, dy, {GABOR_SQL.format(s='1.0', t=f'{k} * pi() / 4')} AS w FROM o0" for k in range(4))
    at = lambda c: REFLECT.format(c=c)
    return f"""WITH {PIX}, o0 AS (SELECT a.i - 2 AS dx, b.i - 2 AS dy FROM range(5) a(i), range(5) b(i)), k AS ({kernels}),
 resp AS (SELECT k.f, p.image_id, p.x, p.y, round(sum(k.w * q.v), 7) AS v FROM pix p CROSS JOIN k JOIN pix q ON q.image_id = p.image_id AND q.x = {at('p.x + k.dx')} AND q.y = {at('p.y + k.dy')} GROUP BY 1, 2, 3, 4),
 b AS (SELECT p.*, least(floor((v - a) * 11 / (e.b - e.a)), 10)::INT AS bin FROM resp p JOIN (SELECT f, image_id, min(v) AS a, max(v) AS b FROM resp GROUP BY 1, 2) e ON e.image_id = p.image_id AND e.f = p.f), o AS (SELECT i.i::INT - 3 AS i FROM range(7) i(i))
SELECT p.image_id, p.x, p.y, q.bin + 11 * p.f AS feature, round(count(*) / 49.0, 8) AS share FROM b p CROSS JOIN o dx CROSS JOIN o dy JOIN b q ON q.f = p.f AND q.image_id = p.image_id AND q.x = {CLIP.format(c='p.x + dx.i')} AND q.y = {CLIP.format(c='p.y + dy.i')} GROUP BY 1, 2, 3, 4"""


@query(spectral_sql())
def spectral_histogram_features(spark, d):
    """Local histograms of the responses to four Gabor filters, one after another."""
    px, out = raster(spark, d), None
    for k in range(4):
        response = g.correlate(px, gabor(5, k * math.pi / 4)).withColumn("v", r("v", 7))  # sums in any order fall into one bin
        part = g.local_histogram(response, 7, 11)
        part = part.select("image_id", "x", "y", (F.col("bin") + 11 * k).alias("feature"), r("share", 8).alias("share"))
        out = part if out is None else out.unionByName(part)
    return out


# ---- histogram of an image, levels, components ----


@query(f"""WITH {PIX} SELECT image_id, bin, count(*) AS n FROM (SELECT p.image_id, least(floor((v - a) * 16 / (b - a)), 15)::INT AS bin FROM pix p JOIN (SELECT image_id, min(v) AS a, max(v) AS b FROM pix GROUP BY 1) e ON e.image_id = p.image_id) GROUP BY 1, 2""")
def image_histogram(spark, d):
    px = v.with_extent(raster(spark, d), "image_id")
    return px.groupBy("image_id", o.bin_of(F.col("v"), F.col("low"), F.col("high"), 16).alias("bin")).agg(F.count("*").alias("n"))


COMPONENTS = f"""WITH RECURSIVE {PIX}, {MASK}, s AS (SELECT image_id, x, y, y * {N} + x AS pos FROM mask WHERE m),
 reach AS (SELECT image_id, pos AS root, x, y FROM s UNION SELECT a.image_id, a.root, b.x, b.y FROM reach a JOIN s b ON b.image_id = a.image_id AND abs(b.x - a.x) <= 1 AND abs(b.y - a.y) <= 1),
 c AS (SELECT image_id, x, y, min(root) AS root FROM reach GROUP BY 1, 2, 3),
 l AS (SELECT image_id, x, y, dense_rank() OVER (PARTITION BY image_id ORDER BY root) AS label FROM c)"""


@query(f"{COMPONENTS} SELECT image_id, x, y, label FROM l")
def components_label(spark, d):
    return g.labelled(mask(spark, d)).select("image_id", "x", "y", F.col("label").cast("long").alias("label"))


@query(f"{COMPONENTS} SELECT image_id, label, count(*) AS size, floor(avg(x) + 0.5)::BIGINT AS cx, floor(avg(y) + 0.5)::BIGINT AS cy, max(x) - min(x) AS width, max(y) - min(y) AS height FROM l GROUP BY 1, 2")
def components_stats(spark, d):
    return g.component_statistics(g.labelled(mask(spark, d))).withColumn("label", F.col("label").cast("long"))


@query(f"{COMPONENTS}, k AS (SELECT image_id, label FROM l GROUP BY 1, 2 HAVING count(*) >= 3 AND min(least(x, y, {N - 1} - x, {N - 1} - y)) > 0) SELECT l.image_id, x, y FROM l JOIN k ON k.image_id = l.image_id AND k.label = l.label")
def clean_mask(spark, d):
    return g.clean_mask(g.labelled(mask(spark, d)), N, N, 3, True)


# ---- color ----

RGB = f"{PIX}, rgb AS (SELECT a.x, a.y, (a.v % 256) / 255.0 AS r, (b.v % 256) / 255.0 AS g, (c.v % 256) / 255.0 AS b FROM pix a JOIN pix b ON a.x = b.x AND a.y = b.y JOIN pix c ON a.x = c.x AND a.y = c.y WHERE a.image_id = 0 AND b.image_id = 1 AND c.image_id = 2)"


def rgb(spark, d):
    px = raster(spark, d)
    at = lambda k: F.max(F.when(F.col("image_id") == k, F.col("v") % 256)) / 255.0
    return px.groupBy("x", "y").agg(at(0).alias("r"), at(1).alias("g"), at(2).alias("b"))


@query(f"""WITH {RGB}, m AS (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM rgb)
SELECT x, y, round(CASE WHEN hi = lo THEN 0 WHEN hi = r THEN ((g - b) / (hi - lo) + 6 - 6 * floor(((g - b) / (hi - lo)) / 6)) % 6 WHEN hi = g THEN (b - r) / (hi - lo) + 2 ELSE (r - g) / (hi - lo) + 4 END / 6, 6) AS h,
 round(CASE WHEN hi = 0 THEN 0 ELSE (hi - lo) / hi END, 6) AS s, round(hi, 6) AS v FROM m""")
def color_rgb_hsv(spark, d):
    h, s, val = color.rgb_to_hsv(F.col("r"), F.col("g"), F.col("b"))
    return rgb(spark, d).select("x", "y", r(h).alias("h"), r(s).alias("s"), r(val).alias("v"))


@query(f"WITH {RGB} SELECT x, y, round(0.2125 * r + 0.7154 * g + 0.072 * b, 6) AS gray, round(0.299 * r + 0.587 * g + 0.114 * b, 6) AS luma, round(-0.169 * r - 0.331 * g + 0.5 * b, 6) AS cb, round(0.5 * r - 0.419 * g - 0.081 * b, 6) AS cr FROM rgb")
def color_ycbcr(spark, d):
    red, green, blue = F.col("r"), F.col("g"), F.col("b")
    luma, cb, cr = color.rgb_to_ycbcr(red, green, blue)
    return rgb(spark, d).select("x", "y", r(color.rgb_to_gray(red, green, blue)).alias("gray"), r(luma).alias("luma"), r(cb).alias("cb"), r(cr).alias("cr"))


LIN = "CASE WHEN {c} > 0.04045 THEN pow(({c} + 0.055) / 1.055, 2.4) ELSE {c} / 12.92 END"
CUBE = "CASE WHEN {c} > 0.008856 THEN pow({c}, 1.0 / 3) ELSE 7.787 * {c} + 16.0 / 116 END"


@query(f"""WITH {RGB}, l AS (SELECT x, y, {LIN.format(c='r')} AS r, {LIN.format(c='g')} AS g, {LIN.format(c='b')} AS b FROM rgb),
 t AS (SELECT x, y, (0.4124 * r + 0.3576 * g + 0.1805 * b) / 0.95047 AS a, 0.2126 * r + 0.7152 * g + 0.0722 * b AS o, (0.0193 * r + 0.1192 * g + 0.9505 * b) / 1.08883 AS c FROM l),
 f AS (SELECT x, y, {CUBE.format(c='a')} AS a, {CUBE.format(c='o')} AS o, {CUBE.format(c='c')} AS c FROM t)
SELECT x, y, round(116 * o - 16, 4) AS lightness, round(500 * (a - o), 4) AS a, round(200 * (o - c), 4) AS b FROM f""")
def color_lab(spark, d):
    light, a, b = color.rgb_to_lab(F.col("r"), F.col("g"), F.col("b"))
    return rgb(spark, d).select("x", "y", r(light, 4).alias("lightness"), r(a, 4).alias("a"), r(b, 4).alias("b"))
