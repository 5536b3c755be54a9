"""Queries on volumes of lineitem sums: stencils, differences, components, slices."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import volume as vol
from .bindings import table
from .grids import r
from .vectors import signal

QUERIES, ORACLE_SQL = {}, {}
NX, NY, NZ = 12, 10, 8


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def voxels(spark, d):
    """image_id, x, y, z, v and sizes: two full volumes of whole values."""
    at = [(F.col("l_linenumber") % 2).cast("int").alias("image_id"), (F.col("l_partkey") % NX).cast("int").alias("x"), (F.col("l_suppkey") % NY).cast("int").alias("y"), (F.col("l_orderkey") % NZ).cast("int").alias("z")]
    sums = table(spark, d, "lineitem").groupBy(*at).agg(F.sum("l_quantity").alias("v"))
    i = F.col("id")
    every = spark.range(2 * NX * NY * NZ).select(
        F.floor(i / (NX * NY * NZ)).cast("int").alias("image_id"), (i % NX).cast("int").alias("x"), (F.floor(i / NX) % NY).cast("int").alias("y"), (F.floor(i / (NX * NY)) % NZ).cast("int").alias("z")
    )
    full = every.join(sums, ["image_id", "x", "y", "z"], "left")
    return full.select("image_id", "x", "y", "z", F.coalesce("v", F.lit(0.0)).alias("v"), F.lit(NX).alias("nx"), F.lit(NY).alias("ny"), F.lit(NZ).alias("nz"))


VOX = f"""vox AS (SELECT a.image_id, a.x, a.y, a.z, coalesce(s.v, 0.0) AS v FROM
  (SELECT i.i::INT AS image_id, x.i::INT AS x, y.i::INT AS y, z.i::INT AS z FROM range(2) i(i), range({NX}) x(i), range({NY}) y(i), range({NZ}) z(i)) a
  LEFT JOIN (SELECT (l_linenumber % 2)::INT AS image_id, (l_partkey % {NX})::INT AS x, (l_suppkey % {NY})::INT AS y, (l_orderkey % {NZ})::INT AS z, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3, 4) s
  ON a.image_id = s.image_id AND a.x = s.x AND a.y = s.y AND a.z = s.z)"""
NEAR = "q.image_id = p.image_id AND abs(q.x - p.x) <= 1 AND abs(q.y - p.y) <= 1 AND abs(q.z - p.z) <= 1"


@query(f"WITH {VOX}, f AS (SELECT p.image_id, p.x, p.y, p.z, list_sort(list(q.v)) AS l FROM vox p JOIN vox q ON {NEAR} GROUP BY 1, 2, 3, 4) SELECT image_id, x, y, z, l[len(l) // 2 + 1] AS v FROM f")
def volume_median(spark, d):
    return vol.median_filter(voxels(spark, d))


KERNEL = [(a, b, c, (2 - abs(a)) * (2 - abs(b)) * (2 - abs(c)) / 64) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]


@query(f"""WITH {VOX}, o AS (SELECT i.i::INT - 1 AS i FROM range(3) i(i))
SELECT p.image_id, p.x, p.y, p.z, round(sum((2 - abs(a.i)) * (2 - abs(b.i)) * (2 - abs(c.i)) / 64.0 * q.v), 6) AS v FROM vox p CROSS JOIN o a CROSS JOIN o b CROSS JOIN o c
 JOIN vox q ON q.image_id = p.image_id AND q.x = (p.x + a.i + {NX}) % {NX} AND q.y = (p.y + b.i + {NY}) % {NY} AND q.z = (p.z + c.i + {NZ}) % {NZ} GROUP BY 1, 2, 3, 4""")
def volume_filter_periodic(spark, d):
    return vol.correlate(voxels(spark, d), KERNEL).select(*vol.VOXEL, r("v").alias("v"))


WINDOWS = "WINDOW a AS (PARTITION BY image_id, y, z ORDER BY x), b AS (PARTITION BY image_id, x, z ORDER BY y), c AS (PARTITION BY image_id, x, y ORDER BY z)"
FORWARD = f"SELECT image_id, x, y, z, coalesce(lead(v) OVER a - v, 0) AS gx, coalesce(lead(v) OVER b - v, 0) AS gy, coalesce(lead(v) OVER c - v, 0) AS gz FROM vox {WINDOWS}"


@query(f"WITH {VOX} {FORWARD}")
def volume_gradient(spark, d):
    return vol.gradient_forward(voxels(spark, d)).select(*vol.VOXEL, "gx", "gy", "gz")


@query(f"WITH {VOX}, f AS ({FORWARD}) SELECT image_id, x, y, z, gx - coalesce(lag(gx) OVER a, 0) + gy - coalesce(lag(gy) OVER b, 0) + gz - coalesce(lag(gz) OVER c, 0) AS v FROM f {WINDOWS}")
def volume_divergence(spark, d):
    return vol.divergence_backward(vol.gradient_forward(voxels(spark, d)))


@query(f"""WITH {VOX} SELECT p.image_id, p.x, p.y, p.z, 0.5 * (a.v - b.v) AS gx, 0.5 * (c.v - e.v) AS gy, 0.5 * (f.v - h.v) AS gz FROM vox p
 JOIN vox a ON a.image_id = p.image_id AND a.y = p.y AND a.z = p.z AND a.x = (p.x + 1) % {NX} JOIN vox b ON b.image_id = p.image_id AND b.y = p.y AND b.z = p.z AND b.x = (p.x + {NX - 1}) % {NX}
 JOIN vox c ON c.image_id = p.image_id AND c.x = p.x AND c.z = p.z AND c.y = (p.y + 1) % {NY} JOIN vox e ON e.image_id = p.image_id AND e.x = p.x AND e.z = p.z AND e.y = (p.y + {NY - 1}) % {NY}
 JOIN vox f ON f.image_id = p.image_id AND f.x = p.x AND f.y = p.y AND f.z = (p.z + 1) % {NZ} JOIN vox h ON h.image_id = p.image_id AND h.x = p.x AND h.y = p.y AND h.z = (p.z + {NZ - 1}) % {NZ}""")
def volume_gradient_central(spark, d):
    return vol.gradient_central(voxels(spark, d))


MASK = "mask AS (SELECT p.image_id, p.x, p.y, p.z, p.v > a.m AS m FROM vox p JOIN (SELECT image_id, avg(v) + 1.3 * stddev_samp(v) AS m FROM vox GROUP BY 1) a ON a.image_id = p.image_id)"


def mask(spark, d):
    vx = voxels(spark, d)
    level = F.broadcast(vx.groupBy("image_id").agg((F.avg("v") + 1.3 * F.stddev_samp("v")).alias("t")))
    return vx.join(level, "image_id").select(*vol.VOXEL, *vol.SIZE, (F.col("v") > F.col("t")).alias("m"))


@query(f"WITH {VOX}, {MASK} SELECT p.image_id, p.x, p.y, p.z, bool_or(q.m) AS m FROM mask p JOIN mask q ON {NEAR} GROUP BY 1, 2, 3, 4")
def volume_dilate(spark, d):
    return vol.dilate(mask(spark, d)).select(*vol.VOXEL, "m")


def components_sql(step: str) -> str:
    return f"""WITH RECURSIVE {VOX}, {MASK}, s AS (SELECT image_id, x, y, z, (z * {NY} + y) * {NX} + x AS pos FROM mask WHERE m),
 reach AS (SELECT image_id, pos AS root, x, y, z FROM s UNION SELECT a.image_id, a.root, b.x, b.y, b.z FROM reach a JOIN s b ON b.image_id = a.image_id AND {step}),
 c AS (SELECT image_id, x, y, z, min(root) AS root FROM reach GROUP BY 1, 2, 3, 4) SELECT image_id, x, y, z, dense_rank() OVER (PARTITION BY image_id ORDER BY root) AS label FROM c"""


@query(components_sql("abs(b.x - a.x) + abs(b.y - a.y) + abs(b.z - a.z) <= 1"))
def volume_components_6(spark, d):
    return vol.labelled(mask(spark, d), 6).withColumn("label", F.col("label").cast("long"))


RING = " AND ".join(f"(abs(b.{c} - a.{c}) <= 1 OR abs(b.{c} - a.{c}) = {n - 1})" for c, n in (("x", NX), ("y", NY), ("z", NZ)))


@query(components_sql(RING))
def volume_components_periodic(spark, d):
    """By 26 neighbours, round the border."""
    return vol.labelled(mask(spark, d), 26, True).withColumn("label", F.col("label").cast("long"))


@query(f"""WITH {VOX}, p AS (SELECT k.i::INT AS image_id, i.i AS k, least(greatest(i.i * 0.171717 - 1, 0), {NX - 1}) AS u, least(greatest(i.i * 0.131313 - 1, 0), {NY - 1}) AS w, least(greatest(i.i * 0.113113 - 1, 0), {NZ - 1}) AS t FROM range(2) k(i), range(80) i(i))
SELECT p.image_id, k, round(sum(v * (1 - abs(u - x)) * (1 - abs(w - y)) * (1 - abs(t - z))), 5) AS v FROM p JOIN vox ON vox.image_id = p.image_id AND abs(u - x) < 1 AND abs(w - y) < 1 AND abs(t - z) < 1 GROUP BY 1, 2""")
def volume_interpolate(spark, d):
    ids = spark.range(160).select(F.floor(F.col("id") / 80).cast("int").alias("image_id"), (F.col("id") % 80).alias("k"))
    places = ids.select("image_id", "k", *[(F.col("k") * a - 1).alias("s" + c) for c, a in (("x", 0.171717), ("y", 0.131313), ("z", 0.113113))])
    return vol.interpolated_at(voxels(spark, d), places).select("image_id", "k", r("v", 5).alias("v"))


@query(f"WITH {VOX} SELECT image_id, x, z AS y, v FROM vox WHERE y = 4")
def volume_slice(spark, d):
    return vol.slab(voxels(spark, d), "y", 4)


# ---- one dimension: series of events ----

SERIES = "s AS (SELECT user_id, event_id, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events)"


def series(spark, d):
    w = Window.partitionBy("user_id")
    return signal(spark, d).withColumn("pos", F.row_number().over(w.orderBy("ts", "event_id")) - 1).withColumn("n", F.count("*").over(w))


@query(f"WITH {SERIES} SELECT p.user_id, p.pos, median(q.v) AS v FROM s p JOIN s q ON q.user_id = p.user_id AND abs(q.pos - p.pos) <= 1 GROUP BY 1, 2")
def series_median(spark, d):
    """The true median of three, of two at the ends."""
    w = Window.partitionBy("user_id").orderBy("pos")
    a, b, c = F.lag("v").over(w), F.col("v"), F.lead("v").over(w)
    three = F.greatest(F.least(a, b), F.least(F.greatest(a, b), c))
    x = series(spark, d).select("user_id", "pos", F.when(a.isNotNull() & c.isNotNull(), three).otherwise((b + F.coalesce(a, c, b)) / 2).alias("v"))
    return x.select("user_id", F.col("pos").cast("long").alias("pos"), "v")


@query(f"""WITH {SERIES}, k(dx, w) AS (VALUES (-2, 0.1::DOUBLE), (-1, 0.2), (0, 0.4), (1, 0.2), (2, 0.1))
SELECT p.user_id, p.pos, round(sum(k.w * q.v), 6) AS v FROM s p CROSS JOIN k JOIN s q ON q.user_id = p.user_id AND q.pos = (p.pos + k.dx + 2 * p.n) % p.n GROUP BY 1, 2""")
def series_filter_periodic(spark, d):
    x = series(spark, d).select("user_id", "pos", "n", "v")
    cells = F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(w).alias("k")) for a, w in ((-2, 0.1), (-1, 0.2), (0, 0.4), (1, 0.2), (2, 0.1))])
    rows = x.select("user_id", "n", "v", "pos", F.inline(cells)).withColumn("pos", F.pmod(F.col("pos") - F.col("dx"), F.col("n")).cast("long"))
    return rows.groupBy("user_id", "pos").agg(r(F.sum(F.col("k") * F.col("v"))).alias("v"))


@query(f"""WITH {SERIES}, w AS (SELECT p.user_id, p.pos, q.v, exp(-((q.pos - p.pos) ** 2) / 4.5) * exp(-((q.v - p.v) ** 2) / 20000.0) AS w FROM s p JOIN s q ON q.user_id = p.user_id AND abs(q.pos - p.pos) <= 2)
SELECT user_id, pos, round(sum(w * v) / sum(w), 6) AS v FROM w GROUP BY 1, 2""")
def series_bilateral(spark, d):
    """The mean of five values, weighted by nearness in place and value; frames end with the series."""
    w = Window.partitionBy("user_id").orderBy("pos").rowsBetween(-2, 2)
    x = series(spark, d).withColumn("f", F.collect_list(F.struct("pos", "v")).over(w))
    weight = lambda e: F.exp(-(e["pos"] - F.col("pos")) * (e["pos"] - F.col("pos")) / 4.5) * F.exp(-(e["v"] - F.col("v")) * (e["v"] - F.col("v")) / 20000.0)
    total = lambda of: F.aggregate(F.transform("f", of), F.lit(0.0), lambda s, e: s + e)
    return x.select("user_id", F.col("pos").cast("long").alias("pos"), r(total(lambda e: weight(e) * e["v"]) / total(weight)).alias("v"))
