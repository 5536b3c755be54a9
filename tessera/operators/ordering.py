"""Ranks and running sums over a whole table without one task that sees it all.

Values are dealt to buckets by approximate quantiles, which travel as literals;
windows run inside buckets, and offsets come from the buckets' totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucketed(df: DataFrame, v: str = "v", buckets: int = 64) -> DataFrame:
    """df with a column bucket that rises with v."""
    at = sorted(set(df.approxQuantile(v, [k / buckets for k in range(1, buckets)], 0.001)))
    if not at:
        return df.withColumn("bucket", F.lit(0))
    return df.withColumn("bucket", F.size(F.filter(F.array(*map(F.lit, at)), lambda q: q <= F.col(v))))


def with_rank(df: DataFrame, v: str = "v", tie: str = "pos", weight: str | None = None) -> DataFrame:
    """df with rank (from 1, by v then tie), n, and with a weight its running sum cum and its total."""
    w = F.col(weight) if weight else F.lit(1.0)
    rows = bucketed(df, v)
    totals = rows.groupBy("bucket").agg(F.count("*").alias("c"), F.sum(w).alias("s"))
    # at most as many rows as buckets
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "bucket", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c0"), F.coalesce(F.sum("s").over(before), F.lit(0.0)).alias("s0"),
        F.sum("c").over(Window.partitionBy()).alias("n"), F.sum("s").over(Window.partitionBy()).alias("total"),
    )
    order = Window.partitionBy("bucket").orderBy(v, tie)
    rows = rows.join(F.broadcast(offsets), "bucket")
    rows = rows.withColumn("rank", F.col("c0") + F.row_number().over(order))
    rows = rows.withColumn("cum", F.col("s0") + F.sum(w).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.drop("bucket", "c0", "s0")


def value_ranks(df: DataFrame, v: str = "v", weight: str | None = None) -> DataFrame:
    """A row for each value: how many are less (c0) and how many there are (c) of
    n in all; with a weight the same sums (s0, s, total), and the weights of its
    first and last position. Equal values are one row before anything is sorted,
    so a value that half of all rows have is no burden to a task."""
    w = F.col(weight) if weight else F.lit(1.0)
    sums = [F.count("*").alias("c"), F.sum(w).alias("s")]
    if weight:
        sums += [F.min_by(w, "pos").alias("first"), F.max_by(w, "pos").alias("last")]
    rows = bucketed(df.groupBy(v).agg(*sums), v)
    totals = rows.groupBy("bucket").agg(F.sum("c").alias("bc"), F.sum("s").alias("bs"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most as many rows as buckets
    offsets = totals.select(
        "bucket", F.coalesce(F.sum("bc").over(before), F.lit(0)).alias("b0"), F.coalesce(F.sum("bs").over(before), F.lit(0.0)).alias("d0"),
        F.sum("bc").over(Window.partitionBy()).alias("n"), F.sum("bs").over(Window.partitionBy()).alias("total"),
    )
    run = Window.partitionBy("bucket").orderBy(v).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(F.broadcast(offsets), "bucket")
    rows = rows.withColumn("c0", F.col("b0") + F.coalesce(F.sum("c").over(run), F.lit(0))).withColumn("s0", F.col("d0") + F.coalesce(F.sum("s").over(run), F.lit(0.0)))
    return rows.drop("bucket", "b0", "d0")


def at_rank(rank: Column) -> Column:
    """Whether a row of value_ranks holds a rank, counted from 1."""
    return (F.col("c0") < rank) & (rank <= F.col("c0") + F.col("c"))


def median(df: DataFrame, v: str = "v") -> DataFrame:
    """The mean of the two middle values."""
    rows = value_ranks(df, v)
    low, high = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    return rows.agg(((F.max(F.when(at_rank(low), F.col(v))) + F.max(F.when(at_rank(high), F.col(v)))) / 2).alias("median"))


def weighted_median(df: DataFrame, v: str = "v", w: str = "w") -> DataFrame:
    """The first value whose running weight passes half; on an exact half, the
    mean of it and the next by their weights. Weights must be positive."""
    rows = value_ranks(df, v, w)
    half, stop = F.col("total") / 2, F.col("s0") + F.col("s")
    hit = rows.where((F.col("s0") <= half) & (stop >= half))
    # half may fall on a value's start or end: then that of its weights counts which lies there
    weight = F.when(F.col("s0") == half, F.col("first")).when(stop == half, F.col("last")).otherwise(F.col("s"))
    return hit.agg((F.sum(F.col(v) * weight) / F.sum(weight)).alias("weighted_median"))


def saturated_extent(df: DataFrame, percent: float, v: str = "v") -> DataFrame:
    """Sorted values at int(p / 200 (n - 1)) from either end."""
    low = F.floor(F.lit(percent / 200) * (F.col("n") - 1)).cast("long") + 1
    high = F.floor((1 - F.lit(percent / 200)) * (F.col("n") - 1)).cast("long") + 1
    return value_ranks(df, v).agg(F.max(F.when(at_rank(low), F.col(v))).alias("low"), F.max(F.when(at_rank(high), F.col(v))).alias("high"))


def sampled(df: DataFrame, n: int, seed: int = 0, key: str = "pos") -> DataFrame:
    """n rows without replacement, the same in every run: those of the smallest digests of the key."""
    order = F.md5(F.concat(F.lit(f"{seed}/"), F.col(key).cast("string")).cast("binary"))
    return df.orderBy(order, key).limit(n)


def descending_dense_rank(df: DataFrame, v: str, name: str) -> DataFrame:
    """df with labels: the greatest value 0, the next 1, and so on. Ranks come
    from the distinct values, which are few in a label map."""
    values = df.select(v).distinct()
    ranks = values.withColumn(name, F.dense_rank().over(Window.orderBy(F.desc(v))) - 1)
    return df.join(F.broadcast(ranks), v) if values.limit(10_001).count() <= 10_000 else df.join(ranks, v)


def bin_of(v: Column, low: Column, high: Column, bins: int) -> Column:
    """Bin from 0; the right end falls into the last one, a constant into the first."""
    width = high - low
    raw = F.floor((v - low) * bins / F.when(width == 0, F.lit(1.0)).otherwise(width))
    return F.when(width == 0, F.lit(0)).otherwise(F.least(raw, F.lit(bins - 1))).cast("int")
