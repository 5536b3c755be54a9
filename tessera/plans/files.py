"""Queries that write tables in file formats and read them back, in the tasks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..operators import variational as va
from ..sources import formats as ff
from ..sources import images as im
from .bindings import PIX, SIDE, VEC, raster, vector
from .grids import r

QUERIES, ORACLE_SQL = {}, {}
N = SIDE


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _bytes(u: np.ndarray) -> np.ndarray:
    return im.to_range(u, "clip")


#: Encoding and decoding by name; those of the first group hold bytes.
BYTE_FORMATS = {
    "png": lambda u: im.decode_png(im.encode_png(_bytes(u))), "pgm": lambda u: im.decode_map(im.encode_map(_bytes(u))), "pgm_text": lambda u: im.decode_map(im.encode_map(_bytes(u), "2")),
    "pgm_211": lambda u: im.decode_map(im.encode_map(_bytes(u), "211")), "tiff_8": lambda u: ff.decode_tiff(ff.encode_tiff(_bytes(u), False)),
}
EXACT_FORMATS = {
    "map_7": lambda u: im.decode_map(im.encode_map(u, "7")), "map_9": lambda u: im.decode_map(im.encode_map(u, "9")), "map_33": lambda u: im.decode_map(im.encode_map(u.astype("<i4"), "33")), "map_34": lambda u: im.decode_map(im.encode_map(u.astype("<u4"), "34")),
    "tiff_64": lambda u: ff.decode_tiff(ff.encode_tiff(u)), "meta": lambda u: im.decode_meta(b"".join(im.encode_meta(u, compressed=True))), "meta_beside": lambda u: im.decode_meta(im.encode_meta(u, "a.raw")[0], lambda _: im.encode_meta(u, "a.raw")[1]),
    "raw": lambda u: ff.decode_raw(ff.encode_raw(u), u.shape), "mrc": lambda u: ff.decode_mrc(ff.encode_mrc(u[None]))[0], "ascii": lambda u: ff.decode_ascii(ff.encode_ascii(u)),
}
_names = lambda names: ", ".join(f"('{n}')" for n in names)


@query(f"WITH {PIX} SELECT image_id, x, y, format, least(v, 255)::DOUBLE AS v FROM pix, (VALUES {_names(BYTE_FORMATS)}) f(format) UNION ALL SELECT image_id, x, y, format, v FROM pix, (VALUES {_names(EXACT_FORMATS)}) f(format)")
def file_formats(spark, d):
    """Every image through fifteen formats and back; those of bytes clip at 255."""

    def make(u, k):
        return pd.concat([va.table_of(k, format=np.full(u.shape, n), v=np.asarray(f(u), float)[..., 0]) for n, f in (BYTE_FORMATS | EXACT_FORMATS).items()])

    return va.per_image(raster(spark, d).select("image_id", "x", "y", "v"), make, "format string, v double")


@query(f"WITH {VEC} SELECT pos, v, trunc(v)::BIGINT AS whole, v > 100000 AS m FROM vec")
def file_vectors(spark, d):
    """Parts of a vector as self-describing files: two vectors in one, the second read as whole numbers, and a mask."""

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf["v"].to_numpy()
        (a, b), (m,) = ff.decode_vectors(ff.encode_vectors([v, v])), ff.decode_vectors(ff.encode_vectors([v > 100000]))
        (c,) = ff.decode_vectors(ff.encode_vectors([b]), "i8")
        return pd.DataFrame({"pos": pdf["pos"], "v": a, "whole": c, "m": m})

    x = vector(spark, d).select("pos", "v", (F.col("pos") % 16).alias("part"))
    return x.groupBy("part").applyInPandas(make, "pos long, v double, whole long, m boolean")


@query(f"WITH {PIX} SELECT image_id, x, y, c.i::INT AS c, CASE WHEN c.i = 3 THEN 255.0 ELSE v END AS v FROM pix, range(4) c(i)")
def file_rgba(spark, d):
    """Gray images as red, green, blue and alpha."""
    px = raster(spark, d).select("image_id", "x", "y", F.lit(0).alias("c"), "v")
    return ff.rgba(px)


NAMED = f"SELECT 'scans/img' || lpad(image_id::VARCHAR, 3, '0') || '.png' AS path, 'mosaics/tm' || (image_id + 1)::VARCHAR || '_' || x::VARCHAR || '_7.png' AS other, image_id, x, y, v FROM pix"


def named(spark, d):
    px = raster(spark, d).select("image_id", "x", "y", "v")
    return px.withColumn("path", F.format_string("scans/img%03d.png", "image_id")).withColumn("other", F.format_string("mosaics/tm%d_%d_7.png", F.col("image_id") + 1, "x"))


@query(f"WITH {PIX} SELECT x, y, image_id - 1 AS z, v FROM pix WHERE image_id BETWEEN 1 AND 3")
def file_slices(spark, d):
    """Numbered images as the slices of a volume."""
    return ff.stacked_slices(named(spark, d).drop("image_id"), "img%03d.png", 1, 3)


@query(f"WITH {PIX} SELECT image_id + 1 AS image_id, count(*) AS n, round(sum(v), 2) AS s FROM pix GROUP BY 1")
def file_ids(spark, d):
    """Ids of images from names that hold several numbers."""
    px = ff.image_ids(named(spark, d).drop("image_id"), ff.pattern_of("tm%d_%d_%d.png"), "other")
    return px.groupBy("image_id").agg(F.count("*").alias("n"), r(F.sum("v"), 2).alias("s"))


@query(f"""WITH {PIX} SELECT image_id, sha256('# vtk DataFile Version 2.0' || chr(10) || 'data' || chr(10) || 'ASCII' || chr(10) || 'DATASET STRUCTURED_POINTS' || chr(10) || 'DIMENSIONS {N} {N} 1' || chr(10) || 'ORIGIN 0 0 0' || chr(10) || 'SPACING 1 1 1' || chr(10)
 || 'POINT_DATA {N * N}' || chr(10) || 'SCALARS data double 1' || chr(10) || 'LOOKUP_TABLE default' || chr(10) || string_agg(v::BIGINT::VARCHAR, chr(10) ORDER BY y, x) || chr(10)) AS sha256 FROM pix GROUP BY 1""")
def sink_vtk(spark, d):
    """The digest of each image's file of structured points."""
    px = raster(spark, d).select("image_id", "x", "y", "v")
    files = px.groupBy("image_id").applyInPandas(lambda p: pd.DataFrame({"image_id": [p["image_id"].iloc[0]], "content": [ff.encode_vtk(va.image_of(p))]}), "image_id int, content binary")
    return files.select("image_id", F.sha2("content", 256).alias("sha256"))


@query(f"WITH {PIX} SELECT image_id, (y * {N} + x)::INT AS vertex, x::DOUBLE AS x, y::DOUBLE AS y, v AS z, v AS value FROM pix")
def mesh_ply(spark, d):
    """Each image as a mesh over its pixels, written and read: vertices with a value each."""

    def make(u: np.ndarray, k: int) -> pd.DataFrame:
        y, x = np.indices(u.shape)
        i = np.arange(u.size).reshape(u.shape)
        faces = np.concatenate([np.stack([i[:-1, :-1], i[:-1, 1:], i[1:, :-1]], 2).reshape(-1, 3), np.stack([i[1:, 1:], i[1:, :-1], i[:-1, 1:]], 2).reshape(-1, 3)])
        vertices, back, more = ff.decode_ply(ff.encode_ply(np.column_stack([x.ravel(), y.ravel(), u.ravel()]), faces, u.ravel()))
        assert np.array_equal(back, faces)
        return pd.DataFrame({"image_id": np.int32(k), "vertex": np.arange(u.size, dtype=np.int32), "x": vertices[:, 0], "y": vertices[:, 1], "z": vertices[:, 2], "value": more["generic_scalar"]})

    px = raster(spark, d).select("image_id", "x", "y", "v")
    return px.groupBy("image_id").applyInPandas(lambda p: make(va.image_of(p), int(p["image_id"].iloc[0])), "image_id int, vertex int, x double, y double, z double, value double")


@query(f"WITH {PIX}, m AS (SELECT image_id, avg(v) AS m FROM pix GROUP BY 1) SELECT printf('%s = %.6f +- %.6f', 'mean', avg(m), stddev_samp(m)) AS value FROM m")
def sink_metrics(spark, d):
    """A metric's mean and standard deviation over images, as a line of text."""
    m = raster(spark, d).groupBy("image_id").agg(F.avg("v").alias("m"))
    return ff.metric_lines(m.agg(F.avg("m").alias("mean"), F.stddev_samp("m").alias("sd")).withColumn("metric", F.lit("mean")))
