"""Queries on vectors: maps, masks, reductions, ranks, histograms, fits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import ordering as o
from ..operators import vector as v
from .bindings import MAPS, SECOND, VEC, label_maps, second_vector, signal, table, vector

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def both(spark, d):
    return v.zipped(vector(spark, d), second_vector(spark, d))


def r(c, n=4):
    return F.round(c, n)


# ---- reductions ----


@query(f"WITH {VEC} SELECT count(*) AS n, round(sum(v), 2) AS s, round(sqrt(sum(v * v)), 4) AS norm, round(sum(w * v) / sum(w), 4) AS wmean, round(avg(v), 4) AS mean FROM vec")
def vec_sum_norm(spark, d):
    x = vector(spark, d)
    return x.agg(F.count("*").alias("n"), r(F.sum("v"), 2).alias("s"), r(F.sqrt(F.sum(F.col("v") * F.col("v")))).alias("norm"), r(F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("wmean"), r(F.avg("v")).alias("mean"))


@query(f"WITH {VEC} SELECT round(pow(sum(pow(abs(v / 1000), 3)), 1.0 / 3), 4) AS l3, round(sum(abs(v)), 2) AS l1 FROM vec")
def vec_lp_norm(spark, d):
    return vector(spark, d).agg(r(v.lp_norm(F.col("v") / 1000, 3.0)).alias("l3"), r(F.sum(F.abs("v")), 2).alias("l1"))


@query(f"WITH {VEC} SELECT min(v) AS low, (SELECT min(pos) FROM vec WHERE v = (SELECT min(v) FROM vec)) AS low_at, max(v) AS high, (SELECT min(pos) FROM vec WHERE v = (SELECT max(v) FROM vec)) AS high_at, max(abs(v)) AS abs_high FROM vec")
def vec_minmax_arg(spark, d):
    x = vector(spark, d).agg(v.arg_min().alias("a"), v.arg_max().alias("b"), F.max(F.abs("v")).alias("abs_high"))
    return x.select(F.col("a.v").alias("low"), F.col("a.pos").alias("low_at"), F.col("b.v").alias("high"), (-F.col("b.neg")).alias("high_at"), "abs_high")


@query(f"WITH {VEC} SELECT median(v) AS median FROM vec")
def vec_median(spark, d):
    return o.median(vector(spark, d))


@query(f"""WITH {VEC}, c AS (SELECT *, sum(w) OVER (ORDER BY v, pos) AS cum, sum(w) OVER () AS total FROM vec)
SELECT round(sum(v * w) / sum(w), 6) AS weighted_median FROM c WHERE cum - w <= total / 2 AND cum >= total / 2""")
def vec_wmedian(spark, d):
    return o.weighted_median(vector(spark, d)).select(r("weighted_median", 6).alias("weighted_median"))


@query(f"WITH {VEC} SELECT status, round(CASE WHEN count(*) = 1 THEN 0 ELSE var_samp(v) END, 2) AS variance, round(CASE WHEN count(*) = 1 THEN 0 ELSE stddev_samp(v) END, 4) AS std FROM vec GROUP BY status")
def vec_var_std(spark, d):
    return vector(spark, d).groupBy("status").agg(r(v.variance(F.col("v")), 2).alias("variance"), r(F.sqrt(v.variance(F.col("v")))).alias("std"))


@query(f"WITH {VEC} SELECT status, round(stddev_samp(v) * (1 - 1 / (4.0 * count(*)) + 7 / (32.0 * count(*) * count(*))), 4) AS std FROM vec GROUP BY status")
def vec_std_unbiased(spark, d):
    return vector(spark, d).groupBy("status").agg(r(v.std_unbiased(F.col("v"))).alias("std"))


@query(f"""WITH {VEC}, s AS (SELECT v, row_number() OVER (ORDER BY v, pos) - 1 AS k, count(*) OVER () AS n FROM vec)
SELECT max(CASE WHEN k = floor(0.01 * (n - 1)) THEN v END) AS low, max(CASE WHEN k = floor((1 - 0.01) * (n - 1)) THEN v END) AS high FROM s""")
def vec_saturated_minmax(spark, d):
    return o.saturated_extent(vector(spark, d), 2.0)


# ---- two vectors ----


@query(f"WITH {SECOND} SELECT round(sum(v * u), 2) AS dot FROM vec2")
def vec_dot(spark, d):
    return both(spark, d).agg(r(F.sum(F.col("v") * F.col("u")), 2).alias("dot"))


@query(f"WITH {SECOND} SELECT pos, round(v + 2.5 * u, 6) AS z FROM vec2")
def vec_axpy(spark, d):
    return both(spark, d).select("pos", r(F.col("v") + 2.5 * F.col("u"), 6).alias("z"))


@query(f"WITH {SECOND} SELECT pos, round(v * u, 4) AS product, round(CASE WHEN u <> 0 THEN v / u END, 6) AS ratio FROM vec2")
def vec_entrywise(spark, d):
    return both(spark, d).select("pos", r(F.col("v") * F.col("u")).alias("product"), r(v.safe_divide(F.col("v"), F.col("u")), 6).alias("ratio"))


@query(f"WITH {SECOND}, e AS (SELECT avg((v - 1000 * u) * (v - 1000 * u)) AS mse, max(v) AS peak FROM vec2) SELECT round(mse, 0) AS mse, round(10 * log10(peak * peak / mse), 6) AS psnr FROM e")
def vec_mse_psnr(spark, d):
    e = F.col("v") - 1000 * F.col("u")
    x = both(spark, d).agg(F.avg(e * e).alias("mse"), F.max("v").alias("peak"))
    return x.select(r("mse", 0).alias("mse"), r(v.psnr(F.col("mse"), F.col("peak")), 6).alias("psnr"))


@query(f"WITH {SECOND} SELECT round(0.5 * sum((u / 100 - v / 100000) * (u / 100 - v / 100000)), 4) AS ssd, round(corr(u, v), 6) AS ncc FROM vec2")
def image_distances(spark, d):
    e = F.col("u") / 100 - F.col("v") / 100000
    return both(spark, d).agg(r(0.5 * F.sum(e * e)).alias("ssd"), r(F.corr("u", "v"), 6).alias("ncc"))


# ---- maps ----


@query(f"WITH {VEC} SELECT pos, least(greatest(v, 50000), 150000) AS clamped, CASE WHEN v > 100000 THEN 1::DOUBLE ELSE 0::DOUBLE END AS high, CASE WHEN v < 50000 THEN 0.0 ELSE v END AS above FROM vec")
def vec_clamp_threshold(spark, d):
    x = F.col("v")
    return vector(spark, d).select("pos", v.clamp(x, 50000.0, 150000.0).alias("clamped"), v.threshold(x, 100000.0, 0.0, 1.0).alias("high"), v.threshold_from_below(x, 50000.0, 0.0).alias("above"))


@query(f"WITH {VEC} SELECT pos, round((v - (SELECT min(v) FROM vec)) / ((SELECT max(v) FROM vec) - (SELECT min(v) FROM vec)), 8) AS v FROM vec")
def vec_scale01(spark, d):
    return v.scale_to(vector(spark, d).select("pos", "v")).select("pos", r("v", 8).alias("v"))


@query(f"WITH {VEC} SELECT pos, status, round(max(v) OVER (PARTITION BY status) - v, 6) AS v FROM vec")
def vec_revert(spark, d):
    return v.revert(vector(spark, d).select("pos", "status", "v"), "status").select("pos", "status", r("v", 6).alias("v"))


@query(f"""WITH {VEC}, n AS (SELECT count(*) AS n FROM vec), j AS (SELECT i AS j, i * (n - 1) / 999.0 AS t0 FROM range(1000) t(i), n)
SELECT j AS pos, round(a.v + (t0 - floor(t0)) * (coalesce(b.v, a.v) - a.v), 2) AS v FROM j JOIN vec a ON a.pos = floor(t0)::BIGINT LEFT JOIN vec b ON b.pos = floor(t0)::BIGINT + 1""")
def vec_resample_linear(spark, d):
    x = vector(spark, d).select("pos", "v")
    return v.resample_linear(x, x.count(), 1000).select("pos", r("v", 2).alias("v"))


@query(f"WITH {VEC}, f AS (SELECT floor(v / 1000)::BIGINT AS k, pos FROM vec) SELECT k, count(*) AS n, min(pos) AS first_at FROM f GROUP BY k HAVING count(*) >= 2")
def vec_num_occurrence(spark, d):
    x = vector(spark, d).select(F.floor(F.col("v") / 1000).alias("k"), "pos")
    return x.groupBy("k").agg(F.count("*").alias("n"), F.min("pos").alias("first_at")).where("n >= 2")


# ---- masks ----


@query(f"WITH {VEC} SELECT round(sum(CASE WHEN status = 'F' THEN v ELSE 0 END), 2) AS inside, round(sum(CASE WHEN status <> 'F' THEN v ELSE 0 END), 2) AS outside, count(*) FILTER (WHERE status = 'F') AS n_true, count(*) FILTER (WHERE status <> 'F') AS n_false FROM vec")
def mask_sum(spark, d):
    m = F.col("status") == "F"
    return vector(spark, d).agg(r(F.sum(F.when(m, F.col("v")).otherwise(0.0)), 2).alias("inside"), r(F.sum(F.when(~m, F.col("v")).otherwise(0.0)), 2).alias("outside"), F.count_if(m).alias("n_true"), F.count_if(~m).alias("n_false"))


@query(f"WITH {VEC} SELECT min(v) FILTER (WHERE status = 'F') AS low, max(v) FILTER (WHERE status = 'F') AS high, max(abs(v)) FILTER (WHERE status <> 'F') AS other FROM vec")
def mask_minmax(spark, d):
    m, x = F.col("status") == "F", F.col("v")
    return vector(spark, d).agg(F.min(F.when(m, x)).alias("low"), F.max(F.when(m, x)).alias("high"), F.max(F.when(~m, F.abs(x))).alias("other"))


@query(f"WITH {SECOND} SELECT pos, CASE WHEN pos % 3 = 0 THEN u ELSE v END AS v FROM vec2")
def mask_assign(spark, d):
    return both(spark, d).select("pos", F.when(F.col("pos") % 3 == 0, F.col("u")).otherwise(F.col("v")).alias("v"))


# ---- histograms and ranks ----


@query(f"""WITH {VEC}, e AS (SELECT min(v) AS a, max(v) AS b FROM vec), k AS (SELECT least(floor((v - a) * 20 / (b - a)), 19)::INT AS bin FROM vec, e)
SELECT i::INT AS bin, round(a + (i + 0.5) / 20 * (b - a), 4) AS center, (SELECT count(*) FROM k WHERE bin = i) AS n FROM range(20) t(i), e""")
def hist_linear(spark, d):
    x = v.with_extent(vector(spark, d))
    n = x.groupBy(o.bin_of(F.col("v"), F.col("low"), F.col("high"), 20).alias("bin")).agg(F.count("*").alias("n"))
    span = x.agg(F.min("low").alias("low"), F.max("high").alias("high"))
    rows = spark.range(20).select(F.col("id").cast("int").alias("bin")).crossJoin(F.broadcast(span)).join(n, "bin", "left")
    return rows.select("bin", r(F.col("low") + (F.col("bin") + 0.5) / 20 * (F.col("high") - F.col("low"))).alias("center"), F.coalesce("n", F.lit(0)).alias("n"))


@query("""WITH h AS (SELECT l_quantity::INT AS g, count(*) AS c FROM lineitem GROUP BY 1), m AS (SELECT g, c, sum(c) OVER (ORDER BY g) AS cum, sum(c) OVER () AS n, max(g) OVER () AS top FROM h)
SELECT g, floor(cum * top / n)::BIGINT AS equalized, c::BIGINT AS n FROM m""")
def hist_equalize(spark, d):
    h = table(spark, d, "lineitem").groupBy(F.col("l_quantity").cast("int").alias("g")).agg(F.count("*").alias("c"))
    w = Window.orderBy("g")  # one row a gray value
    x = h.select("g", "c", F.sum("c").over(w).alias("cum"), F.sum("c").over(Window.partitionBy()).alias("n"), F.max("g").over(Window.partitionBy()).alias("top"))
    return x.select("g", F.floor(F.col("cum") * F.col("top") / F.col("n")).alias("equalized"), F.col("c").alias("n"))


@query(f"""WITH RECURSIVE {VEC}, e AS (SELECT min(v) AS a, max(v) AS b FROM vec), k AS (SELECT least(floor((v - a) * 256 / (b - a)), 255) AS bin, v FROM vec, e),
 l AS (SELECT list({{'m': s / n, 'n': n, 's': s}}) AS l FROM (SELECT bin, count(*) AS n, sum(v) AS s FROM k GROUP BY 1)),
 it AS (SELECT 0 AS k, (SELECT avg(v) FROM vec) AS t UNION ALL SELECT k + 1, 0.5 * (list_sum(list_transform(list_filter(l, lambda z: z.m <= t), lambda z: z.s)) / list_sum(list_transform(list_filter(l, lambda z: z.m <= t), lambda z: z.n)) + list_sum(list_transform(list_filter(l, lambda z: z.m > t), lambda z: z.s)) / list_sum(list_transform(list_filter(l, lambda z: z.m > t), lambda z: z.n))) FROM it, l WHERE k < 100)
SELECT round(t, 3) AS threshold, (SELECT count(*) FROM vec WHERE v > t) AS above FROM it WHERE k = 100""")
def isodata_threshold(spark, d):
    """Iterated mean of the two class means, on a histogram of 256 bins."""
    x = v.with_extent(vector(spark, d))
    bins = x.groupBy(o.bin_of(F.col("v"), F.col("low"), F.col("high"), 256).alias("bin")).agg(F.count("*").alias("n"), F.sum("v").alias("s")).collect()
    rows = sorted((b["s"] / b["n"], b["n"], b["s"]) for b in bins)
    t = sum(s for _, _, s in rows) / sum(n for _, n, _ in rows)
    for _ in range(100):
        low, high = [b for b in rows if b[0] <= t], [b for b in rows if b[0] > t]
        new = sum(sum(s for _, _, s in part) / sum(n for _, n, _ in part) for part in (low, high) if part) / max(1, bool(low) + bool(high))
        if abs(new - t) < 1e-14 * abs(t):
            break
        t = new
    return vector(spark, d).agg(F.lit(round(t, 3)).alias("threshold"), F.count_if(F.col("v") > t).alias("above"))


@query(f"WITH {MAPS}, g AS (SELECT gt_gray, dense_rank() OVER (ORDER BY gt_gray DESC) - 1 AS label FROM (SELECT DISTINCT gt_gray FROM maps)) SELECT g.gt_gray, label, count(*) AS n FROM maps JOIN g ON maps.gt_gray = g.gt_gray GROUP BY 1, 2")
def labels_dense_rank(spark, d):
    return o.descending_dense_rank(label_maps(spark, d), "gt_gray", "label").groupBy("gt_gray", F.col("label").cast("long").alias("label")).agg(F.count("*").alias("n"))


@query("WITH e AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings), m AS (SELECT vec_id, max(v) AS v FROM e GROUP BY 1) SELECT e.vec_id AS pos, min(e.k) AS segment FROM e JOIN m ON e.vec_id = m.vec_id AND e.v = m.v GROUP BY 1")
def argmax_label(spark, d):
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("pos"), (F.array_position("embedding", F.array_max("embedding")) - 1).alias("segment"))


@query(f"WITH {VEC} SELECT pos, v FROM vec ORDER BY v DESC, pos LIMIT 50")
def topk_heap(spark, d):
    return vector(spark, d).select("pos", "v").orderBy(F.desc("v"), "pos").limit(50)


@query(f"WITH {VEC} SELECT floor(v / 20000)::BIGINT AS k, min(pos) AS first_pos, count(*) AS n FROM vec GROUP BY 1 ORDER BY 1 LIMIT 7")
def map_first_entries(spark, d):
    x = vector(spark, d).groupBy(F.floor(F.col("v") / 20000).alias("k")).agg(F.min("pos").alias("first_pos"), F.count("*").alias("n"))
    return x.orderBy("k").limit(7)


# ---- sequences ----


@query("""SELECT user_id, event_id, round(sum(value) OVER w, 6) AS s, max(value) OVER w AS m, round(avg(value) OVER w, 6) AS mean FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 4 PRECEDING)""")
def ring_sum_max_mean(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-4, 0)
    return signal(spark, d).select("user_id", "event_id", r(F.sum("v").over(w), 6).alias("s"), F.max("v").over(w).alias("m"), r(F.avg("v").over(w), 6).alias("mean"))


@query("""WITH a AS (SELECT user_id, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) SELECT user_id, event_id, round(value / (p * p), 6) AS ratio FROM a WHERE p <> 0""")
def convergence_order(spark, d):
    x = signal(spark, d).withColumn("p", F.lag("v").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).where("p <> 0")
    return x.select("user_id", "event_id", r(F.col("v") / (F.col("p") * F.col("p")), 6).alias("ratio"))


# ---- joint histograms, distributions, fits ----

JOINT = f"""{SECOND}, e AS (SELECT min(v) AS a, max(v) AS b, min(u) AS c, max(u) AS d FROM vec2),
 k AS (SELECT floor(9 * (v - a) / (b - a))::INT AS i, floor(9 * (u - c) / (d - c))::INT AS j FROM vec2, e),
 h AS (SELECT i, j, count(*)::DOUBLE / (SELECT count(*) FROM k) AS p FROM k GROUP BY 1, 2)"""


def joint(spark, d):
    x = both(spark, d)
    e = x.agg(F.min("v").alias("a"), F.max("v").alias("b"), F.min("u").alias("c"), F.max("u").alias("e"), F.count("*").alias("n"))
    x = x.crossJoin(F.broadcast(e))
    i = F.floor(9 * (F.col("v") - F.col("a")) / (F.col("b") - F.col("a"))).cast("int")
    j = F.floor(9 * (F.col("u") - F.col("c")) / (F.col("e") - F.col("c"))).cast("int")
    return x.groupBy(i.alias("i"), j.alias("j")).agg((F.count("*") / F.max("n")).alias("p"))


@query(f"WITH {JOINT} SELECT i, j, round(p, 8) AS p FROM h")
def joint_histogram(spark, d):
    return joint(spark, d).select("i", "j", r("p", 8).alias("p"))


@query(f"""WITH {JOINT}, a AS (SELECT i, sum(p) AS p FROM h GROUP BY i), b AS (SELECT j, sum(p) AS p FROM h GROUP BY j)
SELECT round((SELECT -sum(p * ln(p)) FROM h), 6) AS joint_entropy, round((SELECT -sum(p * ln(p)) FROM a), 6) AS entropy_a, round((SELECT -sum(p * ln(p)) FROM b), 6) AS entropy_b,
 round((SELECT -sum(p * ln(p)) FROM a) + (SELECT -sum(p * ln(p)) FROM b) - (SELECT -sum(p * ln(p)) FROM h), 6) AS mutual_information""")
def mutual_information(spark, d):
    h = joint(spark, d)
    ent = lambda x, name: x.agg((-F.sum(F.col("p") * F.log("p"))).alias(name))
    a, b = h.groupBy("i").agg(F.sum("p").alias("p")), h.groupBy("j").agg(F.sum("p").alias("p"))
    x = ent(h, "h").crossJoin(ent(a, "a")).crossJoin(ent(b, "b"))
    return x.select(r("h", 6).alias("joint_entropy"), r("a", 6).alias("entropy_a"), r("b", 6).alias("entropy_b"), r(F.col("a") + F.col("b") - F.col("h"), 6).alias("mutual_information"))


@query("""WITH t AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1), two AS (SELECT min(event_type) AS p, max(event_type) AS q FROM t),
 x AS (SELECT value AS v, sum(CASE WHEN event_type = p THEN 1 ELSE 0 END) AS c0, sum(CASE WHEN event_type = q THEN 1 ELSE 0 END) AS c1 FROM events, two WHERE event_type IN (p, q) GROUP BY 1),
 c AS (SELECT v, c0, c1, sum(c0) OVER (ORDER BY v) AS f0, sum(c1) OVER (ORDER BY v) AS f1, sum(c0) OVER () AS n0, sum(c1) OVER () AS n1, lead(v) OVER (ORDER BY v) AS nv FROM x),
 e AS (SELECT *, f0 / n0 - f1 / n1 AS delta FROM c)
SELECT round(max(abs(delta)), 8) AS sup, round(sqrt(sum(delta * delta * (nv - v))), 6) AS l2, round(sum((c0 + c1) * delta * delta) / max(n0 + n1), 8) AS cvm FROM e WHERE nv IS NOT NULL""")
def cdf_distances(spark, d):
    """Distances of the distributions of two event types."""
    e = signal(spark, d)
    two = F.broadcast(e.agg(F.min("event_type").alias("p"), F.max("event_type").alias("q")))
    x = e.crossJoin(two).where("event_type = p OR event_type = q")
    x = x.groupBy("v").agg(F.count_if(F.col("event_type") == F.col("p")).alias("c0"), F.count_if(F.col("event_type") == F.col("q")).alias("c1"))
    x = o.bucketed(x)
    tot = x.groupBy("bucket").agg(F.sum("c0").alias("s0"), F.sum("c1").alias("s1"), F.min("v").alias("first"))
    w = Window.orderBy("bucket")  # at most as many rows as buckets
    back, all_ = w.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    tot = tot.select("bucket", *[F.coalesce(F.sum(f"s{k}").over(back), F.lit(0)).alias(f"b{k}") for k in (0, 1)], *[F.sum(f"s{k}").over(all_).alias(f"n{k}") for k in (0, 1)], F.lead("first").over(w).alias("after"))
    run = Window.partitionBy("bucket").orderBy("v")
    x = x.join(F.broadcast(tot), "bucket")
    x = x.select("c0", "c1", "n0", "n1", "v", F.coalesce(F.lead("v").over(run), "after").alias("nv"), ((F.col("b0") + F.sum("c0").over(run)) / F.col("n0") - (F.col("b1") + F.sum("c1").over(run)) / F.col("n1")).alias("delta"))
    sq = F.col("delta") * F.col("delta")
    return x.where("nv IS NOT NULL").agg(r(F.max(F.abs("delta")), 8).alias("sup"), r(F.sqrt(F.sum(sq * (F.col("nv") - F.col("v")))), 6).alias("l2"), r(F.sum((F.col("c0") + F.col("c1")) * sq) / F.max(F.col("n0") + F.col("n1")), 8).alias("cvm"))


@query(f"WITH {SECOND}, p AS (SELECT ln(greatest(u, 1e-8)) AS x, ln(greatest(v, 1e-8)) AS y FROM vec2 WHERE u > 0) SELECT round(regr_slope(y, x), 6) AS exponent, round(exp(regr_intercept(y, x)), 2) AS factor FROM p")
def fit_powerlaw(spark, d):
    x = both(spark, d).where("u > 0").select(F.log(F.greatest("u", F.lit(1e-8))).alias("x"), F.log(F.greatest("v", F.lit(1e-8))).alias("y"))
    return x.agg(r(F.regr_slope("y", "x"), 6).alias("exponent"), r(F.exp(F.regr_intercept("y", "x")), 2).alias("factor"))


@query(f"WITH {SECOND}, p AS (SELECT u AS x, ln(greatest(v, 1e-8)) AS y FROM vec2 WHERE u > 0) SELECT round(regr_slope(y, x), 8) AS rate, round(exp(regr_intercept(y, x)), 2) AS factor FROM p")
def fit_exponential(spark, d):
    x = both(spark, d).where("u > 0").select(F.col("u").alias("x"), F.log(F.greatest("v", F.lit(1e-8))).alias("y"))
    return x.agg(r(F.regr_slope("y", "x"), 8).alias("rate"), r(F.exp(F.regr_intercept("y", "x")), 2).alias("factor"))


@query(f"WITH {SECOND} SELECT round(regr_slope(v, u), 6) AS slope, round(regr_intercept(v, u), 4) AS intercept FROM vec2")
def linear_regression(spark, d):
    """Normal equations: sums by one aggregate, solved in place."""
    u, x = F.col("u"), F.col("v")
    s = both(spark, d).agg(F.count("*").alias("n"), F.sum(u).alias("su"), F.sum(x).alias("sv"), F.sum(u * u).alias("suu"), F.sum(u * x).alias("suv"))
    slope = (F.col("n") * F.col("suv") - F.col("su") * F.col("sv")) / (F.col("n") * F.col("suu") - F.col("su") * F.col("su"))
    return s.select(r(slope, 6).alias("slope"), r((F.col("sv") - slope * F.col("su")) / F.col("n")).alias("intercept"))
