"""The provided tables as vectors, images and feature tables, in Spark and as SQL.

orders is a vector (o_orderkey is dense), lineitem sums to small images, and
embeddings is a feature table. FROM gives the same relations to DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 32
#: Orders that make an image; there are four images at least.
PER_IMAGE = 5000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pos, v, w: total prices by order, with small whole weights."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("pos"), F.col("o_totalprice").alias("v"), (1 + F.col("o_orderkey") % 7).cast("double").alias("w"), F.col("o_orderstatus").alias("status"))


def second_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pos, u: quantities by order; 0 where an order has no lines."""
    q = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("pos")).agg(F.sum("l_quantity").alias("u"))
    return vector(spark, sf_dir).select("pos").join(q, "pos", "left").select("pos", F.coalesce("u", F.lit(0.0)).alias("u"))


def image_count(spark: SparkSession, sf_dir: str) -> int:
    return max(4, table(spark, sf_dir, "orders").count() // PER_IMAGE)


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, x, y, v, nx, ny: full grids of whole values, as many as the tables are large."""
    images = image_count(spark, sf_dir)
    sums = (
        table(spark, sf_dir, "lineitem")
        .groupBy((F.col("l_orderkey") % images).cast("int").alias("image_id"), (F.col("l_partkey") % SIDE).cast("int").alias("x"), (F.col("l_suppkey") % SIDE).cast("int").alias("y"))
        .agg(F.sum("l_quantity").alias("v"))
    )
    every = spark.range(images * SIDE * SIDE).select(
        (F.col("id") / (SIDE * SIDE)).cast("int").alias("image_id"), (F.col("id") % SIDE).cast("int").alias("x"), ((F.col("id") / SIDE).cast("long") % SIDE).cast("int").alias("y")
    )
    full = every.join(sums, ["image_id", "x", "y"], "left")
    return full.select("image_id", "x", "y", F.coalesce("v", F.lit(0.0)).alias("v"), F.lit(SIDE).alias("nx"), F.lit(SIDE).alias("ny"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pos, features, label."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("pos"), F.transform("embedding", lambda x: x.cast("double")).alias("features"), "label")


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, ts, event_id, v: one series for each user."""
    return table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.col("value").alias("v"), "event_type")


def label_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gray values gt and seg of each lineitem, as two label maps."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.ascii("l_returnflag").alias("gt_gray"), F.floor((F.col("l_quantity") - 1) / 17).cast("int").alias("seg_gray"))


VEC = "vec AS (SELECT o_orderkey AS pos, o_totalprice AS v, (1 + o_orderkey % 7)::DOUBLE AS w, o_orderstatus AS status FROM orders)"
SECOND = VEC + ", vec2 AS (SELECT vec.pos, vec.v, vec.w, vec.status, coalesce(q.u, 0.0) AS u FROM vec LEFT JOIN (SELECT l_orderkey AS pos, sum(l_quantity) AS u FROM lineitem GROUP BY 1) q ON vec.pos = q.pos)"
PIX = f"""pix AS (
  SELECT a.image_id, a.x, a.y, coalesce(s.v, 0.0) AS v FROM
    (SELECT i.i::INT AS image_id, x.i::INT AS x, y.i::INT AS y FROM (SELECT unnest(range((SELECT greatest(4, count(*) // {PER_IMAGE}) FROM orders)::BIGINT)) AS i) i, range({SIDE}) x(i), range({SIDE}) y(i)) a
  LEFT JOIN (SELECT (l_orderkey % (SELECT greatest(4, count(*) // {PER_IMAGE}) FROM orders))::INT AS image_id, (l_partkey % {SIDE})::INT AS x, (l_suppkey % {SIDE})::INT AS y, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3) s
  ON a.image_id = s.image_id AND a.x = s.x AND a.y = s.y)"""
FEAT = "feat AS (SELECT vec_id AS pos, list_transform(embedding, lambda e: e::DOUBLE) AS features, label FROM embeddings)"
MAPS = "maps AS (SELECT ascii(l_returnflag) AS gt_gray, floor((l_quantity - 1) / 17)::INT AS seg_gray FROM lineitem)"
