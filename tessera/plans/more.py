"""Queries on segments, level sets, fidelities and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import grid as g
from .bindings import PIX, SECOND, SIDE, VEC, raster, second_vector, vector
from .grids import COMPONENTS, mask
from .learning import r

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


COEFFICIENTS = (1.0, -2.0, 0.5, 0.25)


@query(f"""WITH {VEC}, x AS (SELECT pos, v / 100000 AS z FROM vec) SELECT pos, round(1 - 2 * z + 0.5 * z * z + 0.25 * z * z * z, 8) AS p, round(-2 + z + 0.75 * z * z, 8) AS dp,
 round((z + 1 + sqrt((z - 1) * (z - 1) + 0.01)) / 2, 8) AS smooth_max, round(0.5 + atan((z - 1) / 0.5) / pi(), 8) AS step, CASE WHEN z > 1 THEN 1::DOUBLE WHEN z < 1 THEN -1::DOUBLE ELSE 0::DOUBLE END AS sign FROM x""")
def scalar_functions(spark, d):
    z = F.col("v") / 100000
    return vector(spark, d).select(
        "pos", r(scalar.polynomial(z, COEFFICIENTS), 8).alias("p"), r(scalar.polynomial(z, scalar.derivative(COEFFICIENTS)), 8).alias("dp"),
        r(scalar.smooth_max(z, F.lit(1.0), 0.1), 8).alias("smooth_max"), r(scalar.heaviside(z - 1, 0.5), 8).alias("step"), scalar.signum(z - 1).alias("sign"),
    )


@query(f"WITH {SECOND} SELECT round(sum(0.5 * (u / 100 - w) * (u / 100 - w)), 4) AS squared, round(sum((1 + u) - w * ln(1 + u)), 4) AS log_fidelity, round(sum((1 + u) - w * ln(1 + u) + lgamma(w + 1)), 3) AS poisson, round(sum(CASE WHEN u > 50 THEN 1 ELSE u / 50 END), 4) AS clamped FROM vec2")
def fidelities(spark, d):
    """Pointwise fidelities, summed: half squares, u - w log u, the same as the Poisson likelihood of whole numbers w, and a clamped penalty."""
    u, w = F.col("u"), F.col("w")
    x = vector(spark, d).join(second_vector(spark, d), "pos")
    e = u / 100 - w
    return x.agg(r(F.sum(0.5 * e * e), 4).alias("squared"), r(F.sum((1 + u) - w * F.log(1 + u)), 4).alias("log_fidelity"), r(F.sum((1 + u) - w * F.log(1 + u) + F.log(F.factorial(w.cast("int")).cast("double"))), 3).alias("poisson"), r(F.sum(F.when(u > 50, F.lit(1.0)).otherwise(u / 50)), 4).alias("clamped"))


LEVELS = f"""{PIX}, p AS (SELECT a.x, a.y, a.v > b.v AS s0, a.v > c.v AS s1, a.v AS v FROM pix a JOIN pix b ON a.x = b.x AND a.y = b.y JOIN pix c ON a.x = c.x AND a.y = c.y WHERE a.image_id = 0 AND b.image_id = 1 AND c.image_id = 2)"""


def level_sets(spark, d):
    at = lambda k: F.max(F.when(F.col("image_id") == k, F.col("v")))
    px = raster(spark, d).groupBy("x", "y").agg(at(0).alias("v"), at(1).alias("b"), at(2).alias("c"))
    return px.select("v", (F.col("v") > F.col("b")).alias("s0"), (F.col("v") > F.col("c")).alias("s1"))


@query(f"WITH {LEVELS} SELECT s0, s1, count(*) AS volume, round(avg(v), 6) AS mean, round(sum(v), 2) AS weighted FROM p GROUP BY 1, 2")
def level_set_volumes(spark, d):
    """Volumes, plain and weighted by value, and mean values of all sign patterns of two level sets."""
    return level_sets(spark, d).groupBy("s0", "s1").agg(F.count("*").alias("volume"), r(F.avg("v")).alias("mean"), r(F.sum("v"), 2).alias("weighted"))


@query(f"WITH {PIX}, h AS (SELECT image_id, v, 0.5 + atan((v - 100) / 50) / pi() AS h FROM pix) SELECT image_id, round(sum(h * v) / sum(h), 6) AS inside, round(sum((1 - h) * v) / sum(1 - h), 6) AS outside, round(sum(h), 4) AS area, round(sum(h * (v - 150) * (v - 150) + (1 - h) * (v - 50) * (v - 50)), 1) AS energy FROM h GROUP BY 1")
def chan_vese_means(spark, d):
    """Mean values inside and outside of a smoothed level set, its area, and the energy for the means 150 and 50."""
    px = raster(spark, d).withColumn("h", scalar.heaviside(F.col("v") - 100, 50.0))
    h, v = F.col("h"), F.col("v")
    return px.groupBy("image_id").agg(r(F.sum(h * v) / F.sum(h)).alias("inside"), r(F.sum((1 - h) * v) / F.sum(1 - h)).alias("outside"), r(F.sum(h), 4).alias("area"), r(F.sum(h * (v - 150) * (v - 150) + (1 - h) * (v - 50) * (v - 50)), 1).alias("energy"))


@query(f"WITH {PIX}, s AS (SELECT image_id, floor(v / 100)::INT AS label, x, y FROM pix) SELECT image_id, label, count(*) AS n, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM s GROUP BY 1, 2")
def segment_boxes(spark, d):
    """Bounding box of every label."""
    s = raster(spark, d).withColumn("label", F.floor(F.col("v") / 100).cast("int"))
    return s.groupBy("image_id", "label").agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))


@query(f"""WITH {PIX}, s AS (SELECT image_id, x, y, floor(v / 100)::INT AS label FROM pix)
SELECT p.image_id, p.x, p.y FROM s p WHERE EXISTS (SELECT 1 FROM s q WHERE q.image_id = p.image_id AND abs(q.x - p.x) + abs(q.y - p.y) = 1 AND q.label <> p.label)""")
def boundary_pixels(spark, d):
    """Pixels with a neighbour of another label."""
    s = raster(spark, d).withColumn("v", F.floor(F.col("v") / 100).cast("int"))
    rows = g.sent(s, [(0, 0, 1.0), (1, 0, 1.0), (-1, 0, 1.0), (0, 1, 1.0), (0, -1, 1.0)], "zero")
    return rows.groupBy("image_id", "x", "y").agg(F.min("v").alias("a"), F.max("v").alias("b")).where("a <> b").select("image_id", "x", "y")


@query(f"WITH {PIX} SELECT x, y, round(sum(v), 4) AS v FROM (SELECT x, y, v FROM pix WHERE image_id = 0 UNION ALL SELECT x + 8, y + 4, v FROM pix WHERE image_id = 1 AND x < 16 AND y < 16) GROUP BY 1, 2")
def grid_paste_add(spark, d):
    """An image with a block of another one added at an offset."""
    px = raster(spark, d)
    block = g.crop(px.where("image_id = 1"), 0, 0, 16, 16).withColumn("x", F.col("x") + 8).withColumn("y", F.col("y") + 4)
    both = px.where("image_id = 0").select("x", "y", "v").unionByName(block.select("x", "y", "v"))
    return both.groupBy("x", "y").agg(r(F.sum("v"), 4).alias("v"))


@query(f"""WITH {PIX}, c AS (SELECT x.i * 4 AS px, y.i * 4 AS py FROM range(7) x(i), range(7) y(i)), n AS (SELECT x, y, count(*) AS n FROM c JOIN (SELECT DISTINCT x, y FROM pix) ON x BETWEEN px AND px + 7 AND y BETWEEN py AND py + 7 GROUP BY 1, 2)
SELECT image_id, pix.x, pix.y, round((2 * v * n.n + 0.5 * v) / (n.n + 0.5), 6) AS v FROM pix JOIN n ON n.x = pix.x AND n.y = pix.y""")
def patch_blend(spark, d):
    """Doubled patches put together again, blended with the image by weight 0.5."""
    px = raster(spark, d)
    p = g.patches(px, 8, 4).select("image_id", "px", "py", F.posexplode(F.transform("p", lambda x: 2 * x)).alias("k", "u"))
    p = p.select("image_id", (F.col("px") + F.col("k") % 8).alias("x"), (F.col("py") + F.floor(F.col("k") / 8).cast("int")).alias("y"), "u")
    s = p.groupBy("image_id", "x", "y").agg(F.sum("u").alias("s"), F.count("*").alias("n"))
    return s.join(px, ["image_id", "x", "y"]).select("image_id", "x", "y", r((F.col("s") + 0.5 * F.col("v")) / (F.col("n") + 0.5)).alias("v"))


@query(f"""{COMPONENTS}, b AS (SELECT l.* FROM l WHERE (SELECT count(*) FROM l q WHERE q.image_id = l.image_id AND abs(q.x - l.x) + abs(q.y - l.y) = 1) < 4)
SELECT image_id, label, count(*) AS boundary FROM b GROUP BY 1, 2""")
def component_boundaries(spark, d):
    """Pixels of each component that lack one of the four neighbours."""
    l = g.labelled(mask(spark, d)).withColumn("nx", F.lit(SIDE)).withColumn("ny", F.lit(SIDE))  # noqa: E741
    near = g.sent(l.select("image_id", "x", "y", "nx", "ny"), [(1, 0, 1.0), (-1, 0, 1.0), (0, 1, 1.0), (0, -1, 1.0)], "zero")
    full = near.groupBy("image_id", "x", "y").agg(F.count("*").alias("n")).where("n = 4")
    edge = l.join(full, ["image_id", "x", "y"], "left_anti")
    return edge.groupBy("image_id", F.col("label").cast("long").alias("label")).agg(F.count("*").alias("boundary"))


_U = "(('0x' || substr(md5('0/' || image_id || '/' || x || '/' || y), 1, 13))::BIGINT / 4503599627370496.0)"


@query(f"WITH {PIX} SELECT image_id, x, y, CASE WHEN {_U} < 0.05 THEN 0.0 WHEN {_U} < 0.1 THEN 255.0 ELSE v END AS v FROM pix")
def noise_salt_pepper(spark, d):
    px = raster(spark, d)
    return px.select("image_id", "x", "y", scalar.salt_and_pepper(F.col("v"), F.concat_ws("/", "image_id", "x", "y"), 0.1, 0.0, 255.0).alias("v"))
