"""Queries on feature tables, label maps, matrices and whole-image operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import grid as g
from ..operators import learning as m
from ..operators import segmentation as sg
from ..operators import variational as va
from .bindings import FEAT, MAPS, PIX, SIDE, features, label_maps, raster

QUERIES, ORACLE_SQL = {}, {}
DIM, K = 64, 5


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r(c, n=6):
    return F.round(c, n)


# ---- label maps ----

DENSE = f"""{MAPS}, d AS (SELECT dense_rank() OVER (ORDER BY gt_gray DESC) - 1 AS gt, dense_rank() OVER (ORDER BY seg_gray DESC) - 1 AS seg FROM maps)"""


def error_rows(spark, d):
    """(seg, gt, n) with labels by descending gray value: ranks come from the few groups."""
    from pyspark.sql import Window

    n = label_maps(spark, d).groupBy("gt_gray", "seg_gray").agg(F.count("*").alias("n"))
    rank = lambda c: (F.dense_rank().over(Window.orderBy(F.desc(c))) - 1).cast("long")  # noqa: E731  of at most classes x segments rows
    return n.select(rank("seg_gray").alias("seg"), rank("gt_gray").alias("gt"), "n")


@query(f"WITH {DENSE} SELECT seg, gt, count(*) AS n FROM d GROUP BY 1, 2")
def error_matrix(spark, d):
    return error_rows(spark, d)


@query(f"""WITH {DENSE}, n AS (SELECT seg, gt, count(*)::DOUBLE AS n FROM d GROUP BY 1, 2), s AS (SELECT seg, sum(n) AS ns FROM n GROUP BY 1), t AS (SELECT gt, sum(n) AS nt FROM n GROUP BY 1)
SELECT t.gt, s.seg, round(ns + nt - 2 * coalesce(n.n, 0), 4) AS cost FROM s CROSS JOIN t LEFT JOIN n ON n.seg = s.seg AND n.gt = t.gt""")
def symmetric_difference_cost(spark, d):
    """Sizes of symmetric differences, from the margins."""
    n = error_rows(spark, d)
    s, t = n.groupBy("seg").agg(F.sum("n").alias("ns")), n.groupBy("gt").agg(F.sum("n").alias("nt"))
    rows = s.crossJoin(F.broadcast(t)).join(n, ["seg", "gt"], "left")
    return rows.select("gt", "seg", (F.col("ns") + F.col("nt") - 2 * F.coalesce("n", F.lit(0))).cast("double").alias("cost"))


def matrix_of(spark, d):
    rows = error_rows(spark, d).collect()  # classes x segments
    out = np.zeros((max(x["seg"] for x in rows) + 1, max(x["gt"] for x in rows) + 1))
    for x in rows:
        out[x["seg"], x["gt"]] = x["n"]
    return out


# three classes and three segments: the best of the six matchings
PERM = f"""WITH {DENSE}, n AS (SELECT seg, gt, count(*)::DOUBLE AS n FROM d GROUP BY 1, 2), s AS (SELECT seg, sum(n) AS ns FROM n GROUP BY 1), t AS (SELECT gt, sum(n) AS nt FROM n GROUP BY 1),
 p AS (SELECT a.seg AS s0, b.seg AS s1, c.seg AS s2, a.ns + b.ns + c.ns AS tot FROM s a, s b, s c WHERE a.seg <> b.seg AND a.seg <> c.seg AND b.seg <> c.seg),
 q AS (SELECT *, coalesce((SELECT n FROM n WHERE seg = s0 AND gt = 0), 0) AS h0, coalesce((SELECT n FROM n WHERE seg = s1 AND gt = 1), 0) AS h1, coalesce((SELECT n FROM n WHERE seg = s2 AND gt = 2), 0) AS h2 FROM p),
 best AS (SELECT * FROM q ORDER BY h0 + h1 + h2 DESC, s0, s1, s2 LIMIT 1),
 x AS (SELECT t.gt, nt, CASE t.gt WHEN 0 THEN h0 WHEN 1 THEN h1 ELSE h2 END AS h, (SELECT ns FROM s WHERE seg = CASE t.gt WHEN 0 THEN s0 WHEN 1 THEN s1 ELSE s2 END) AS ns, tot FROM t, best)"""


@query(f"""{PERM} SELECT 'CO' AS metric, round(sum(h) / max(tot), 8) AS value FROM x UNION ALL SELECT 'CA', round(sum(h * nt / (nt + ns - h)) / max(tot), 8) FROM x UNION ALL SELECT 'CC', round(sum(h * nt / ns) / max(tot), 8) FROM x
UNION ALL SELECT 'O', round(median((nt - h) / nt), 8) FROM x UNION ALL SELECT 'C', round(median((ns - h) / ns), 8) FROM x UNION ALL SELECT 'CS', round(avg(CASE WHEN h >= 0.75 * nt AND h >= 0.75 * ns THEN 1.0 ELSE 0.0 END), 8) FROM x""")
def quality_metrics(spark, d):
    q = m.quality(matrix_of(spark, d))
    return spark.createDataFrame([(k, round(v, 8)) for k, v in q.items()], "metric string, value double")


@query(f"{PERM} SELECT t.gt::INT AS gt, (CASE t.gt WHEN 0 THEN s0 WHEN 1 THEN s1 ELSE s2 END)::INT AS seg FROM t, best")
def segment_assignment(spark, d):
    """The segment of each class; of several best matchings the first class has the least."""
    cost = matrix_of(spark, d)
    rows = m.first_assignment((cost.sum(0)[None, :] + cost.sum(1)[:, None] - 2 * cost).T)
    return spark.createDataFrame(list(enumerate(rows)), "gt int, seg int")


@query(f"""WITH i AS (SELECT l_linenumber % 4 AS image, ascii(l_returnflag) AS g, floor((l_quantity - 1) / 17)::INT AS q FROM lineitem), c AS (SELECT image, avg(CASE WHEN (g = 82 AND q = 2) OR (g = 78 AND q = 1) OR (g = 65 AND q = 0) THEN 1.0 ELSE 0.0 END) AS co FROM i GROUP BY 1)
SELECT round(avg(co), 8) AS mean, round(stddev_samp(co), 8) AS sd FROM c""")
def quality_over_images(spark, d):
    """Mean and standard deviation over images of the share of agreeing labels (both by descending gray value)."""
    from .bindings import table

    i = table(spark, d, "lineitem").select((F.col("l_linenumber") % 4).alias("image"), F.ascii("l_returnflag").alias("g"), F.floor((F.col("l_quantity") - 1) / 17).cast("int").alias("q"))
    same = ((F.col("g") == 82) & (F.col("q") == 2)) | ((F.col("g") == 78) & (F.col("q") == 1)) | ((F.col("g") == 65) & (F.col("q") == 0))
    co = i.groupBy("image").agg(F.avg(F.when(same, 1.0).otherwise(0.0)).alias("co"))
    return co.agg(r(F.avg("co"), 8).alias("mean"), r(F.stddev_samp("co"), 8).alias("sd"))


# ---- clustering ----

CENTERS = f"{FEAT}, c AS (SELECT row_number() OVER (ORDER BY pos) - 1 AS k, features AS f FROM (SELECT * FROM feat ORDER BY pos LIMIT {K}))"
DIST = "list_sum(list_transform(list_zip(p.features, c.f), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
NEAR = f"{CENTERS}, near AS (SELECT p.pos, min({{'d': {DIST}, 'k': c.k}}) AS m FROM feat p CROSS JOIN c GROUP BY 1)"


def five_centers(spark, d):
    return [list(x["features"]) for x in features(spark, d).orderBy("pos").limit(K).collect()]


@query(f"WITH {NEAR} SELECT pos, m.k AS label, round(m.d, 6) AS d2 FROM near")
def nearest_center(spark, d):
    return m.assigned(features(spark, d), five_centers(spark, d)).select("pos", F.col("label").cast("long").alias("label"), r("d2").alias("d2"))


@query(f"WITH {NEAR}, e AS (SELECT near.m.k AS label, unnest(feat.features) AS v, generate_subscripts(feat.features, 1) - 1 AS j FROM near JOIN feat ON feat.pos = near.pos) SELECT label, j, round(avg(v), 6) AS v FROM e GROUP BY 1, 2")
def kmeans_step(spark, d):
    """The new centers after one assignment."""
    c = m.means(m.assigned(features(spark, d), five_centers(spark, d)), K, DIM)
    return spark.createDataFrame([(k, j, round(x, 6)) for k, row in enumerate(c) for j, x in enumerate(row)], "label long, j long, v double")


# ---- principal components ----


@query(f"""WITH {FEAT}, e AS (SELECT pos, unnest(features) AS v, generate_subscripts(features, 1) - 1 AS j FROM feat), a AS (SELECT j, avg(v) AS m FROM e GROUP BY 1), z AS (SELECT pos, e.j, v - m AS v FROM e JOIN a ON a.j = e.j)
SELECT p.j AS i, q.j, round(sum(p.v * q.v), 4) AS v FROM z p JOIN z q ON p.pos = q.pos GROUP BY 1, 2""")
def covariance(spark, d):
    """Scatter matrix of all components."""
    _, s, _ = m.covariance(features(spark, d), DIM)
    return spark.createDataFrame([(i, j, round(float(s[i, j]), 4)) for i in range(DIM) for j in range(DIM)], "i long, j long, v double")


@query()
def pca_energy(spark, d):
    _, values, _ = m.principal_components(features(spark, d), DIM, 0.8)
    return spark.createDataFrame([(k, round(float(x), 6)) for k, x in enumerate(values)], "k int, energy double")


@query()
def pca_project(spark, d):
    p = features(spark, d)
    mean, _, vectors = m.principal_components(p, DIM, 1.0, 4)
    return m.projected(p, mean, vectors).select("pos", F.transform("features", lambda x: F.round(x, 6)).alias("c"))


EDGE = f"""WITH {PIX}, e AS (SELECT p.image_id, p.x, p.y, (a.v - b.v) ** 2 + (c.v - e.v) ** 2 AS v FROM pix p
 JOIN pix a ON a.image_id = p.image_id AND a.y = p.y AND a.x = p.x + 2 JOIN pix b ON b.image_id = p.image_id AND b.y = p.y AND b.x = p.x - 2
 JOIN pix c ON c.image_id = p.image_id AND c.x = p.x AND c.y = p.y + 2 JOIN pix e ON e.image_id = p.image_id AND e.x = p.x AND e.y = p.y - 2)"""


@query(f"{EDGE} SELECT e.image_id, x, y FROM e JOIN (SELECT image_id, sum(v) / {SIDE * SIDE}.0 - {SIDE * SIDE - (SIDE - 4) ** 2} / {SIDE * SIDE}.0 AS m FROM e GROUP BY 1) a ON a.image_id = e.image_id WHERE v > 0 AND v < 0.5 * m")
def low_edgeness_filter(spark, d):
    """Pixels whose edge indicator is positive and below half its mean over the image."""
    e = g.edge_indicator(raster(spark, d), 2)
    return e.join(e.groupBy("image_id").agg(F.avg("v").alias("m")), "image_id").where("v > 0 AND v < 0.5 * m").select("image_id", "x", "y")


# ---- matrices ----

FIVE_POINT = f"""{PIX}, x0 AS (SELECT ((image_id * {SIDE} + y) * {SIDE} + x)::BIGINT AS i, v FROM pix),
 a AS (SELECT i, i AS j, 5.0 AS v FROM x0 UNION ALL SELECT i, i + 1, -1.0 FROM x0 WHERE i % {SIDE} < {SIDE - 1} UNION ALL SELECT i, i - 1, -1.0 FROM x0 WHERE i % {SIDE} > 0
  UNION ALL SELECT i, i + {SIDE}, -1.0 FROM x0 WHERE i % {SIDE * SIDE} < {SIDE * (SIDE - 1)} UNION ALL SELECT i, i - {SIDE}, -1.0 FROM x0 WHERE i % {SIDE * SIDE} >= {SIDE})"""


def five_point(spark, d):
    """Pixels of the images, one after another, and a block of the matrix for each image."""
    x = raster(spark, d).select(((F.col("image_id") * SIDE + F.col("y")) * SIDE + F.col("x")).cast("long").alias("i"), "v")
    i, row, place = F.col("i"), F.col("i") % SIDE, F.col("i") % (SIDE * SIDE)
    near = F.array(
        F.struct(i.alias("j"), F.lit(5.0).alias("v")), F.when(row < SIDE - 1, F.struct((i + 1).alias("j"), F.lit(-1.0).alias("v"))), F.when(row > 0, F.struct((i - 1).alias("j"), F.lit(-1.0).alias("v"))),
        F.when(place < SIDE * (SIDE - 1), F.struct((i + SIDE).alias("j"), F.lit(-1.0).alias("v"))), F.when(place >= SIDE, F.struct((i - SIDE).alias("j"), F.lit(-1.0).alias("v"))),
    )
    return x, x.select("i", F.inline(F.filter(near, lambda s: s.isNotNull())))


@query(f"WITH {FIVE_POINT} SELECT a.i, round(sum(a.v * x0.v), 4) AS v FROM a JOIN x0 ON x0.i = a.j GROUP BY 1")
def spmv_coo(spark, d):
    x, a = five_point(spark, d)
    return m.spmv(a, x).select("i", r("v", 4).alias("v"))


@query(f"WITH {FIVE_POINT}, s AS (SELECT a.i, sum(a.v * x0.v) AS ax FROM a JOIN x0 ON x0.i = a.j GROUP BY 1) SELECT x0.i, round(x0.v + (1 - ax) / 5, 6) AS v FROM x0 JOIN s ON s.i = x0.i")
def jacobi_step(spark, d):
    x, a = five_point(spark, d)
    return m.jacobi_step(a, x, x.withColumn("v", F.lit(1.0))).select("i", r("v").alias("v"))


# ---- whole images ----


def scaled(spark, d):
    from ..operators.vector import scale_to

    return scale_to(raster(spark, d), 0.0, 1.0, "image_id").select("image_id", "x", "y", "v")


@query(f"""WITH {PIX}, f AS (SELECT image_id, x, y, coalesce(lead(v) OVER (PARTITION BY image_id, y ORDER BY x) - v, 0) / 100 AS gx, coalesce(lead(v) OVER (PARTITION BY image_id, x ORDER BY y) - v, 0) / 100 AS gy FROM pix)
SELECT image_id, x, y, round(gx / greatest(1, sqrt(gx * gx + gy * gy)), 6) AS px, round(gy / greatest(1, sqrt(gx * gx + gy * gy)), 6) AS py FROM f""")
def dual_ball_project(spark, d):
    f = g.gradient_forward(raster(spark, d)).withColumn("gx", F.col("gx") / 100).withColumn("gy", F.col("gy") / 100)
    n = F.greatest(F.lit(1.0), F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")))
    return f.select("image_id", "x", "y", r(F.col("gx") / n).alias("px"), r(F.col("gy") / n).alias("py"))


@query(f"""WITH {FEAT}, e AS (SELECT pos, unnest(features) AS v, generate_subscripts(features, 1) - 1 AS j FROM feat), c AS (SELECT pos, v, row_number() OVER w AS k, sum(v) OVER w AS s FROM e WINDOW w AS (PARTITION BY pos ORDER BY v DESC, j ROWS UNBOUNDED PRECEDING)),
 t AS (SELECT pos, max((s - 1) / k) AS t FROM c GROUP BY 1) SELECT e.pos, e.j, round(greatest(v - t, 0), 6) AS u FROM e JOIN t ON t.pos = e.pos""")
def simplex_project(spark, d):
    """The nearest features of at least 0 that sum to 1: what is taken off is the greatest mean excess of the largest ones."""
    u = features(spark, d).select("pos", F.posexplode(m.on_simplex(F.col("features"))).alias("j", "u"))
    return u.select("pos", F.col("j").cast("long").alias("j"), r("u").alias("u"))


@query(f"WITH {FEAT}, e AS (SELECT pos, unnest(features) AS v, generate_subscripts(features, 1) - 1 AS j FROM feat) SELECT pos, j, round(least(greatest(v, -0.1), 0.1), 6) AS u FROM e")
def box_project(spark, d):
    u = features(spark, d).select("pos", F.posexplode(F.transform("features", lambda x: F.least(F.greatest(x, F.lit(-0.1)), F.lit(0.1)))).alias("j", "u"))
    return u.select("pos", F.col("j").cast("long").alias("j"), r("u").alias("u"))


@query()
def ms_multi_phase(spark, d):
    def make(u, k):
        labels, _ = va.piecewise_constant(u[None], np.quantile(u, [0.1, 0.5, 0.9])[:, None], 8.0)
        return va.table_of(k, label=labels.astype(np.int32))

    return va.per_image(scaled(spark, d), make, "label int")


@query()
def segment_texture(spark, d):
    """Texture segmentation with histograms of filter responses, scales and restarts to fit small images."""
    return sg.segment(scaled(spark, d), sg.texture_options(3, (11, 7), restarts=20, gamma=0.005, ghost_cells=4, edgeness=0.5, most=500))


@query()
def segment_crystal(spark, d):
    """Segmentation by local spectra; the number of segments follows from the energy that is left."""
    return sg.segment(scaled(spark, d), sg.periodic_options(7, omega=0.02, restarts=20, gamma=0.002, most=500))
