"""Element-wise maps and reductions of vectors (pos, v, ...), one aggregate each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def zipped(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two vectors position by position; a position that one of them lacks is an error."""
    a, b = a.withColumn("__in_a", F.lit(True)), b.withColumn("__in_b", F.lit(True))
    both = F.col("__in_a") & F.col("__in_b")
    place = F.when(both, F.col("pos")).otherwise(F.raise_error(F.lit("vectors of different length")).cast("long"))
    rows = a.join(b, "pos", "full").withColumn("pos", place)
    # the check hangs on a column that is always read, so that no plan leaves it out
    return rows.where(F.col("pos").isNotNull()).drop("__in_a", "__in_b")


def clamp(v: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(v, F.lit(low)), F.lit(high))


def threshold(v: Column, t: float, below: float, above: float) -> Column:
    """above where v is greater than t, else below."""
    return F.when(v > t, F.lit(above)).otherwise(F.lit(below))


def threshold_from_below(v: Column, t: float, value: float) -> Column:
    """value where v is less than t, else v."""
    return F.when(v < t, F.lit(value)).otherwise(v)


def with_extent(df: DataFrame, *keys: str, v: str = "v") -> DataFrame:
    """df with low and high, the least and greatest v of each group: one row of
    aggregates joined back, so no task sorts or holds a group."""
    ends = df.groupBy(*keys).agg(F.min(v).alias("low"), F.max(v).alias("high"))
    return df.join(ends, list(keys)) if keys else df.crossJoin(F.broadcast(ends))


def scale_to(df: DataFrame, a: float = 0.0, b: float = 1.0, *keys: str) -> DataFrame:
    """v mapped linearly so that its extent becomes a to b; a constant becomes a."""
    span = F.col("high") - F.col("low")
    unit = F.when(span == 0, F.lit(0.0)).otherwise((F.col("v") - F.col("low")) / F.when(span == 0, F.lit(1.0)).otherwise(span))
    return with_extent(df, *keys).withColumn("v", a + (b - a) * unit).drop("low", "high")


def revert(df: DataFrame, *keys: str) -> DataFrame:
    """The greatest value minus v."""
    return with_extent(df, *keys).withColumn("v", F.col("high") - F.col("v")).drop("low", "high")


def safe_divide(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / F.when(b != 0, b))


def variance(v: Column) -> Column:
    """With n - 1; 0 for one value, null for none."""
    return F.when(F.count(v) == 1, F.lit(0.0)).otherwise(F.var_samp(v))


def std_unbiased(v: Column) -> Column:
    """Standard deviation times 1 - 1 / 4n + 7 / 32n^2."""
    n = F.count(v).cast("double")
    return F.sqrt(variance(v)) * (1 - 1 / (4 * n) + 7 / (32 * n * n))


def lp_norm(v: Column, p: float) -> Column:
    return F.pow(F.sum(F.pow(F.abs(v), F.lit(p))), F.lit(1.0 / p))


def arg_min(v: str = "v", pos: str = "pos") -> Column:
    """Least value and its first position."""
    return F.min(F.struct(F.col(v).alias("v"), F.col(pos).alias("pos")))


def arg_max(v: str = "v", pos: str = "pos") -> Column:
    """Greatest value and its first position."""
    return F.max(F.struct(F.col(v).alias("v"), (-F.col(pos)).alias("neg")))


def psnr(mse: Column, peak: Column) -> Column:
    return 10 * F.log10(peak * peak / mse)


def resample_linear(df: DataFrame, n: int, m: int) -> DataFrame:
    """A vector of n values as one of m by linear interpolation; the ends coincide.

    Each value goes to the new places next to it: a range of places for every
    pair of neighbours, found from the position alone, then a sum by place."""
    step = (n - 1) / max(1, m - 1)
    i = F.col("pos")
    if step <= 0:
        return df.where(i == 0).select(F.explode(F.sequence(F.lit(0), F.lit(m - 1))).cast("long").alias("pos"), "v")
    first = F.greatest(F.lit(0), F.floor((i - 1) / F.lit(step)).cast("long"))
    last = F.least(F.lit(m - 1), F.ceil((i + 1) / F.lit(step)).cast("long"))
    near = df.select("pos", "v", F.explode(F.sequence(first, last)).alias("j"))
    weight = 1 - F.abs(F.col("j") * F.lit(step) - i)
    return near.withColumn("k", weight).where("k > 0").groupBy(F.col("j").alias("pos")).agg(F.sum(F.col("k") * F.col("v")).alias("v"))


def applied(df: DataFrame, f: Callable[[Column], Column], v: str = "v") -> DataFrame:
    """f of every value, f being any expression of a column."""
    return df.withColumn(v, f(F.col(v)))


def order_reverted(df: DataFrame, n: int) -> DataFrame:
    """The last value first."""
    return df.withColumn("pos", F.lit(n - 1) - F.col("pos"))


def resample_constant(df: DataFrame, n: int, m: int) -> DataFrame:
    """A vector of n cells of equal width as one of m: each new cell gets the mean
    of the old ones that it covers, by the length that they share with it."""
    step = n / m
    i = F.col("pos")
    first = F.floor(i / F.lit(step)).cast("long")
    last = F.least(F.ceil((i + 1) / F.lit(step)).cast("long") - 1, F.lit(m - 1))
    near = df.select("pos", "v", F.explode(F.sequence(first, last)).alias("j"))
    part = F.least(i + 1, (F.col("j") + 1) * F.lit(step)) - F.greatest(i.cast("double"), F.col("j") * F.lit(step))
    return near.withColumn("k", part).where("k > 0").groupBy(F.col("j").alias("pos")).agg((F.sum(F.col("k") * F.col("v")) / F.sum("k")).alias("v"))


def interpolated(df: DataFrame, places: DataFrame, n: int) -> DataFrame:
    """place and v: a vector of n values between its positions, linearly. Places
    (a column place, from 0 to n - 1) go to the one or two values that they need."""
    low = F.least(F.floor("place").cast("long"), F.lit(n - 1))
    rows = places.withColumn("share", F.col("place") - low)
    ends = F.array(F.struct(low.alias("pos"), (1 - F.col("share")).alias("w")), F.struct((low + 1).alias("pos"), F.col("share").alias("w")))
    rows = rows.select("place", F.inline(F.filter(ends, lambda e: e["w"] > 0)))
    return rows.join(df.select("pos", "v"), "pos").groupBy("place").agg(F.sum(F.col("w") * F.col("v")).alias("v"))


def erased(df: DataFrame, at: int, count: int = 1) -> DataFrame:
    """Without the values from a position on; what follows moves up."""
    rows = df.where((F.col("pos") < at) | (F.col("pos") >= at + count))
    return rows.withColumn("pos", F.when(F.col("pos") >= at, F.col("pos") - count).otherwise(F.col("pos")))


def inserted(df: DataFrame, at: int, value: float) -> DataFrame:
    """With a value before that of a position; what follows moves down."""
    rows = df.select(F.when(F.col("pos") >= at, F.col("pos") + 1).otherwise(F.col("pos")).alias("pos"), "v")
    return rows.unionByName(df.sparkSession.range(1).select(F.lit(at).cast("long").alias("pos"), F.lit(value).alias("v")))


def first_of_value_erased(df: DataFrame, value: float) -> DataFrame:
    """Without the first occurrence of a value; unchanged where there is none."""
    first = df.where(F.col("v") == value).agg(F.min("pos").alias("at"))  # one row
    rows = df.crossJoin(F.broadcast(first)).where(F.col("at").isNull() | (F.col("pos") != F.col("at")))
    return rows.withColumn("pos", F.when(F.col("pos") > F.col("at"), F.col("pos") - 1).otherwise(F.col("pos"))).drop("at")


def concatenated(*parts: DataFrame) -> DataFrame:
    """Vectors as the components of one: component, pos, v."""
    out = parts[0].select(F.lit(0).alias("component"), "pos", "v")
    for k, p in enumerate(parts[1:], 1):
        out = out.unionByName(p.select(F.lit(k).alias("component"), "pos", "v"))
    return out


def inverted(pairs: DataFrame, key: str, value: str) -> DataFrame:
    """value -> key of a map whose values differ; one that comes twice is an error."""
    rows = pairs.groupBy(value).agg(F.min(key).alias(key), F.count("*").alias("__n"))
    kind = pairs.schema[key].dataType
    return rows.select(value, F.when(F.col("__n") == 1, F.col(key)).otherwise(F.raise_error(F.lit("a value comes twice")).cast(kind)).alias(key))
