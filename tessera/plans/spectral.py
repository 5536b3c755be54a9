"""Queries on transforms of images, with the same sums written out in SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import spectral as sp
from ..operators import variational as va
from ..operators.vector import with_extent
from .bindings import PIX, SIDE, raster
from .grids import MASK, mask, r

QUERIES, ORACLE_SQL = {}, {}
N = SIDE


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def per_image(spark, d, make, n: int = 6):
    """make(image) as a column v of every pixel of the result."""
    px = raster(spark, d).select("image_id", "x", "y", "v")
    return va.per_image(px, lambda u, k: va.table_of(k, v=make(u)), "v double").withColumn("v", r("v", n))


#: The spectrum of every image: along rows, then along columns.
DFT = f"""dr AS (SELECT image_id, y, k.i AS k, sum(v * cos(2 * pi() * k.i * x / {N})) AS re, -sum(v * sin(2 * pi() * k.i * x / {N})) AS im FROM pix, range({N}) k(i) GROUP BY 1, 2, 3),
 df AS (SELECT image_id, k, l.i AS l, sum(re * cos(2 * pi() * l.i * y / {N}) + im * sin(2 * pi() * l.i * y / {N})) AS re, sum(im * cos(2 * pi() * l.i * y / {N}) - re * sin(2 * pi() * l.i * y / {N})) AS im FROM dr, range({N}) l(i) GROUP BY 1, 2, 3)"""


@query(f"WITH {PIX}, {DFT} SELECT image_id, ((k + {N // 2}) % {N})::INT AS x, ((l + {N // 2}) % {N})::INT AS y, round(sqrt(re * re + im * im) / {N}, 5) AS v FROM df")
def dft_modulus(spark, d):
    return per_image(spark, d, sp.dft_modulus, 5)


DCT = f"""cr AS (SELECT image_id, y, k.i AS k, sum(v * cos(pi() * k.i * (x + 0.5) / {N})) AS c FROM pix, range({N}) k(i) GROUP BY 1, 2, 3),
 cf AS (SELECT image_id, k, l.i AS l, sum(c * cos(pi() * l.i * (y + 0.5) / {N})) AS c FROM cr, range({N}) l(i) GROUP BY 1, 2, 3)"""


@query(f"WITH {PIX}, {DCT} SELECT image_id, k::INT AS x, l::INT AS y, round(c * 2 / {N} * (CASE WHEN k = 0 THEN sqrt(0.5) ELSE 1 END) * (CASE WHEN l = 0 THEN sqrt(0.5) ELSE 1 END), 5) AS v FROM cf")
def dct_coefficients(spark, d):
    return per_image(spark, d, sp.dct, 5)


def haar_sql(levels: int) -> str:
    out, last, side = f"WITH {PIX}, h0 AS (SELECT image_id, x, y, v FROM pix)", "h0", N
    for k in range(levels):
        half = side // 2
        out += f""", q{k} AS (SELECT image_id, x // 2 AS i, y // 2 AS j, sum(v) / 2 AS s, sum(CASE WHEN x % 2 = 0 THEN v ELSE -v END) / 2 AS a, sum(CASE WHEN y % 2 = 0 THEN v ELSE -v END) / 2 AS b, sum(CASE WHEN (x + y) % 2 = 0 THEN v ELSE -v END) / 2 AS c FROM {last} WHERE x < {side} AND y < {side} GROUP BY 1, 2, 3),
 h{k + 1} AS (SELECT image_id, i AS x, j AS y, s AS v FROM q{k} UNION ALL SELECT image_id, i + {half}, j, a FROM q{k} UNION ALL SELECT image_id, i, j + {half}, b FROM q{k} UNION ALL SELECT image_id, i + {half}, j + {half}, c FROM q{k} UNION ALL SELECT image_id, x, y, v FROM {last} WHERE x >= {side} OR y >= {side})"""
        last, side = f"h{k + 1}", half
    return out + f" SELECT image_id, x, y, round(v, 6) AS v FROM {last}"


@query(haar_sql(2))
def wavelet_haar(spark, d):
    return per_image(spark, d, lambda u: sp.haar(u, 2))


@query(f"WITH {PIX} SELECT image_id, x, y, round(v, 6) AS v FROM pix")
def transforms_and_back(spark, d):
    """Cosines and wavelets, forth and back."""
    return per_image(spark, d, lambda u: sp.inverse_haar(sp.haar(sp.inverse_dct(sp.dct(u)), 3), 3))


BLUR = [(a, b, (3 - abs(a)) * (2 - abs(b)) / 36 + (0.01 if a > b else 0.0)) for a in (-2, -1, 0, 1, 2) for b in (-1, 0, 1)]
BLUR_SQL = "k(dx, dy, w) AS (SELECT a.i - 2, b.i - 1, (3 - abs(a.i - 2)) * (2 - abs(b.i - 1)) / 36.0 + CASE WHEN a.i - 2 > b.i - 1 THEN 0.01 ELSE 0 END FROM range(5) a(i), range(3) b(i))"


@query(f"WITH {PIX}, {BLUR_SQL} SELECT p.image_id, p.x, p.y, round(sum(w * q.v), 5) AS v FROM pix p CROSS JOIN k JOIN pix q ON q.image_id = p.image_id AND q.x = (p.x - dx + {N}) % {N} AND q.y = (p.y - dy + {N}) % {N} GROUP BY 1, 2, 3")
def circular_convolution(spark, d):
    return per_image(spark, d, lambda u: sp.circular_convolution(u, BLUR), 5)


@query(f"WITH {PIX}, {BLUR_SQL} SELECT p.image_id, p.x, p.y, round(sum(w * q.v), 5) AS v FROM pix p CROSS JOIN k JOIN pix q ON q.image_id = p.image_id AND q.x = p.x - dx AND q.y = p.y - dy GROUP BY 1, 2, 3")
def linear_convolution(spark, d):
    """With zeros beyond the border."""
    return per_image(spark, d, lambda u: sp.linear_convolution(u, BLUR), 5)


MIRROR = "CASE WHEN {c} < 0 THEN -({c}) WHEN {c} >= %d THEN %d - ({c}) ELSE {c} END" % (N, 2 * (N - 1))


@query(f"WITH {PIX}, k(dx, w) AS (SELECT i - 3, 1.0 / 7 FROM range(7) t(i)) SELECT p.image_id, p.x, p.y, round(sum(w * q.v), 5) AS v FROM pix p CROSS JOIN k JOIN pix q ON q.image_id = p.image_id AND q.y = p.y AND q.x = {MIRROR.format(c='(p.x - dx)')} GROUP BY 1, 2, 3")
def motion_blur(spark, d):
    """Seven pixels along the rows, mirrored at the border."""
    return per_image(spark, d, lambda u: sp.linear_convolution(u, sp.motion_blur(7, 0.0), "reflect"), 5)


@query(f"""WITH {PIX}, {DCT}, e AS (SELECT image_id, k, l, c / (1 + 1.5 * (4 - 2 * cos(pi() * k / {N}) - 2 * cos(pi() * l / {N}))) * (CASE WHEN k = 0 THEN 1 ELSE 2 END) * (CASE WHEN l = 0 THEN 1 ELSE 2 END) / {N * N} AS c FROM cf),
 br AS (SELECT image_id, l, x.i AS x, sum(c * cos(pi() * k * (x.i + 0.5) / {N})) AS c FROM e, range({N}) x(i) GROUP BY 1, 2, 3)
SELECT image_id, x::INT AS x, y.i::INT AS y, round(sum(c * cos(pi() * l * (y.i + 0.5) / {N})), 5) AS v FROM br, range({N}) y(i) GROUP BY 1, 2, 3""")
def heat_step(spark, d):
    return per_image(spark, d, lambda u: sp.heat_step(u, 1.5), 5)


@query(f"""WITH {PIX}, {DFT}, m AS (SELECT *, sqrt(re * re + im * im) AS m, max(sqrt(re * re + im * im)) OVER (PARTITION BY image_id) AS top FROM df), kept AS (SELECT image_id, k, l, re, im FROM m WHERE m >= 0.02 * top),
 br AS (SELECT image_id, l, x.i AS x, sum(re * cos(2 * pi() * k * x.i / {N}) - im * sin(2 * pi() * k * x.i / {N})) AS re, sum(im * cos(2 * pi() * k * x.i / {N}) + re * sin(2 * pi() * k * x.i / {N})) AS im FROM kept, range({N}) x(i) GROUP BY 1, 2, 3)
SELECT image_id, x::INT AS x, y.i::INT AS y, round(sum(re * cos(2 * pi() * l * y.i / {N}) - im * sin(2 * pi() * l * y.i / {N})) / {N * N}, 5) AS v FROM br, range({N}) y(i) GROUP BY 1, 2, 3""")
def fourier_threshold(spark, d):
    return per_image(spark, d, lambda u: sp.fourier_threshold(u, 0.02), 5)


def shifted(px):
    """Every image scaled to 0 to 1."""
    rows = with_extent(px, "image_id")
    return rows.select("image_id", "x", "y", ((F.col("v") - F.col("low")) / (F.col("high") - F.col("low"))).alias("v"))


@query(f"WITH {PIX} SELECT image_id, x, y, CASE WHEN x = 5 AND y = 3 THEN 1::DOUBLE ELSE 0::DOUBLE END AS v FROM pix")
def phase_correlation(spark, d):
    """Of each image moved by (5, 3) with itself: one peak at the move."""
    return per_image(spark, d, lambda u: np.abs(va.phase_correlation(np.roll(u, (3, 5), (0, 1)), u)))


REFLECTED = "CASE WHEN {c} < 0 THEN -({c}) WHEN {c} >= %d THEN %d - ({c}) ELSE {c} END" % (N, 2 * (N - 1))


@query(f"""WITH {PIX}, e AS (SELECT image_id, min(v) AS a, max(v) AS b FROM pix GROUP BY 1), u AS (SELECT pix.image_id, x, y, (v - a) / (b - a) AS v FROM pix JOIN e ON e.image_id = pix.image_id),
 row_ AS (SELECT p.image_id, p.x, p.y, k.i AS k, sum(q.v * cos(2 * pi() * (k.i - 2) * i.i / 5)) AS re, -sum(q.v * sin(2 * pi() * (k.i - 2) * i.i / 5)) AS im FROM u p CROSS JOIN range(5) i(i) CROSS JOIN range(5) k(i) JOIN u q ON q.image_id = p.image_id AND q.y = p.y AND q.x = {REFLECTED.format(c='(p.x + i.i - 2)')} GROUP BY 1, 2, 3, 4),
 f AS (SELECT p.image_id, p.x, p.y, l.i * 5 + r.k AS bin, sum(re * cos(2 * pi() * (l.i - 2) * j.i / 5) + im * sin(2 * pi() * (l.i - 2) * j.i / 5)) AS re, sum(im * cos(2 * pi() * (l.i - 2) * j.i / 5) - re * sin(2 * pi() * (l.i - 2) * j.i / 5)) AS im
  FROM u p CROSS JOIN range(5) j(i) CROSS JOIN range(5) l(i) JOIN row_ r ON r.image_id = p.image_id AND r.x = p.x AND r.y = {REFLECTED.format(c='(p.y + j.i - 2)')} GROUP BY 1, 2, 3, 4)
SELECT image_id, x, y, bin::INT AS bin, round(sqrt(re * re + im * im) / 25, 6) AS modulus FROM f""")
def fft_modulus(spark, d):
    """All 25 moduli of the mirrored block around every pixel."""

    def make(u, k):
        f = va.fft_modulus(u, 5)
        y, x, b = np.indices(f.shape)
        return va.pd.DataFrame({"image_id": np.int32(k), "x": x.ravel().astype(np.int32), "y": y.ravel().astype(np.int32), "bin": b.ravel().astype(np.int32), "modulus": f.ravel().round(6)})

    return va.per_image(shifted(raster(spark, d)), make, "bin int, modulus double")


BANDS = ", ".join(f"({a}, {w})" for a, w in va.stockwell_bands(N))


@query(f"""WITH {PIX}, b(start, width) AS (VALUES {BANDS}), s AS (SELECT image_id, y, k.i AS k, sum(v * cos(2 * pi() * (k.i - {N // 2}) * x / {N})) / sqrt({N}) AS re, -sum(v * sin(2 * pi() * (k.i - {N // 2}) * x / {N})) / sqrt({N}) AS im FROM pix, range({N}) k(i) GROUP BY 1, 2, 3),
 o AS (SELECT image_id, y, start + t.i AS x, sum(re * cos(2 * pi() * (k - start) * t.i / width) - im * sin(2 * pi() * (k - start) * t.i / width)) / sqrt(max(width)) AS re, sum(im * cos(2 * pi() * (k - start) * t.i / width) + re * sin(2 * pi() * (k - start) * t.i / width)) / sqrt(max(width)) AS im
  FROM b JOIN s ON k >= start AND k < start + width JOIN range({N}) t(i) ON t.i < width GROUP BY 1, 2, 3)
SELECT pix.image_id, pix.x, pix.y, round(coalesce(sqrt(re * re + im * im), 0), 5) AS v FROM pix LEFT JOIN o ON o.image_id = pix.image_id AND o.x = pix.x AND o.y = pix.y""")
def stockwell(spark, d):
    """Of every row: bands of the spectrum that double in width, each transformed back by itself."""
    return per_image(spark, d, lambda u: np.abs(np.array([va.stockwell(row) for row in u])), 5)


@query(f"""WITH RECURSIVE {PIX}, {MASK}, it AS (SELECT 0 AS k, image_id, x, y, CASE WHEN m THEN 0.0 ELSE 1000000.0 END::DOUBLE AS u FROM mask
 UNION ALL SELECT k + 1, image_id, x, y, least(u, CASE WHEN abs(a - b) >= 1 THEN least(a, b) + 1 ELSE (a + b + sqrt(greatest(2 - (a - b) * (a - b), 0))) / 2 END) FROM
  (SELECT k, image_id, x, y, u, least(coalesce(lag(u) OVER h, 1000000.0), coalesce(lead(u) OVER h, 1000000.0)) AS a, least(coalesce(lag(u) OVER w, 1000000.0), coalesce(lead(u) OVER w, 1000000.0)) AS b FROM it WHERE k < 60
   WINDOW h AS (PARTITION BY image_id, y ORDER BY x), w AS (PARTITION BY image_id, x ORDER BY y)))
SELECT image_id, x, y, round(u, 6) AS v FROM it WHERE k = 60""")
def eikonal_distance(spark, d):
    """First-order travel time from a mask, by sweeps."""
    px = mask(spark, d).select("image_id", "x", "y", F.col("m").cast("double").alias("v"))
    return va.per_image(px, lambda u, k: va.table_of(k, v=sp.distance_transform(u > 0).round(6)), "v double")


@query(f"WITH {PIX}, {MASK} SELECT p.image_id, p.x, p.y, min((p.x - q.x) ** 2 + (p.y - q.y) ** 2)::BIGINT AS d2 FROM mask p JOIN mask q ON q.image_id = p.image_id AND q.m GROUP BY 1, 2, 3")
def squared_distance(spark, d):
    """Exact squared distance to a mask: along rows by windows, then along columns."""
    from ..operators.grid import squared_distance

    return squared_distance(mask(spark, d)).select("image_id", "x", "y", F.col("d2").cast("long").alias("d2"))
