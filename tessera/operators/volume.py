"""Volumes as (image_id, x, y, z, v, nx, ny, nz): stencils, differences, components.

As for images, voxels send their share to the places that see them, and shares
are added up by place with a partial sum before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grid import seen_at
from .storage import checkpointed

VOXEL = ("image_id", "x", "y", "z")
SIZE = ("nx", "ny", "nz")
Kernel = Sequence[tuple[int, int, int, float]]  # dx, dy, dz, weight


def sent(vx: DataFrame, kernel: Kernel, rule: str) -> DataFrame:
    """Each voxel to every target that sees it, by the boundary rules of images: a target p sees p + (dx, dy, dz) with weight k."""
    cells = F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy"), F.lit(c).alias("dz"), F.lit(float(w)).alias("k")) for a, b, c, w in kernel])
    rows = vx
    for k, (c, n) in enumerate(zip("xyz", SIZE, strict=True)):
        reach = max(abs(cell[k]) for cell in kernel)
        rows = rows.withColumn(c, F.explode(seen_at(F.col(c), F.col(n), reach, rule)))
    rows = rows.select("*", F.inline(cells))
    for c in "xyz":
        rows = rows.withColumn(c, F.col(c) - F.col("d" + c))
    inside = [(F.col(c) >= 0) & (F.col(c) < F.col(n)) for c, n in zip("xyz", SIZE, strict=True)]
    return rows.where(inside[0] & inside[1] & inside[2])


def cube(r: int) -> Kernel:
    return [(a, b, c, 1.0) for a in range(-r, r + 1) for b in range(-r, r + 1) for c in range(-r, r + 1)]


CROSS: Kernel = [(0, 0, 0, 1.0), (1, 0, 0, 1.0), (-1, 0, 0, 1.0), (0, 1, 0, 1.0), (0, -1, 0, 1.0), (0, 0, 1, 1.0), (0, 0, -1, 1.0)]


def correlate(vx: DataFrame, kernel: Kernel, rule: str = "periodic") -> DataFrame:
    return sent(vx, kernel, rule).groupBy(*VOXEL, *SIZE).agg(F.sum(F.col("k") * F.col("v")).alias("v"))


def median_filter(vx: DataFrame, r: int = 1) -> DataFrame:
    """The upper median of the frame, which ends at the border."""
    rows = sent(vx, cube(r), "zero").groupBy(*VOXEL).agg(F.array_sort(F.collect_list("v")).alias("f"))
    return rows.select(*VOXEL, F.element_at("f", F.floor(F.size("f") / 2).cast("int") + 1).alias("v"))


def _at(a: int, b: int, c: int, value: str = "v") -> Column:
    return F.max(F.when((F.col("dx") == a) & (F.col("dy") == b) & (F.col("dz") == c), F.col(value)))


def gradient_forward(vx: DataFrame) -> DataFrame:
    """Differences to the next voxel; 0 at the far border."""
    rows = sent(vx, [CROSS[0], CROSS[1], CROSS[3], CROSS[5]], "clip").groupBy(*VOXEL, *SIZE)
    here = _at(0, 0, 0)
    return rows.agg((_at(1, 0, 0) - here).alias("gx"), (_at(0, 1, 0) - here).alias("gy"), (_at(0, 0, 1) - here).alias("gz"))


def divergence_backward(field: DataFrame) -> DataFrame:
    """The negative adjoint of gradient_forward, of a field (gx, gy, gz)."""
    flows = [F.when(F.col(c) < F.col(n) - 1, F.col("g" + c)).otherwise(0.0).alias("g" + c) for c, n in zip("xyz", SIZE, strict=True)]
    rows = sent(field.select(*VOXEL, *SIZE, *flows), [CROSS[0], CROSS[2], CROSS[4], CROSS[6]], "zero")
    part = F.when(F.col("dx") == -1, -F.col("gx")).when(F.col("dy") == -1, -F.col("gy")).when(F.col("dz") == -1, -F.col("gz")).otherwise(F.col("gx") + F.col("gy") + F.col("gz"))
    return rows.groupBy(*VOXEL).agg(F.sum(part).alias("v"))


def gradient_central(vx: DataFrame) -> DataFrame:
    """Half differences of both neighbours, round the border."""
    rows = sent(vx, CROSS[1:], "periodic").groupBy(*VOXEL)
    slope = lambda a, b, c: F.sum(F.when((F.col("dx") == a) & (F.col("dy") == b) & (F.col("dz") == c), 0.5 * F.col("v")).when((F.col("dx") == -a) & (F.col("dy") == -b) & (F.col("dz") == -c), -0.5 * F.col("v")).otherwise(0.0))
    return rows.agg(slope(1, 0, 0).alias("gx"), slope(0, 1, 0).alias("gy"), slope(0, 0, 1).alias("gz"))


def dilate(mask: DataFrame) -> DataFrame:
    """A mask (m) with all neighbours of its voxels in the cube around them, axis by axis."""
    for k in range(3):
        step = [0, 0, 0]
        step[k] = 1
        kernel = [(0, 0, 0, 1.0), (*step, 1.0), (*[-s for s in step], 1.0)]
        mask = sent(mask, kernel, "zero").groupBy(*VOXEL, *SIZE).agg(F.max("m").alias("m"))
    return mask


def interpolated_at(vx: DataFrame, places: DataFrame) -> DataFrame:
    """places (image_id, k, sx, sy, sz) with v, linear between the eight voxels around each; clipped at the border."""
    size = F.broadcast(vx.select("image_id", *SIZE).distinct())  # one row a volume
    rows = places.join(size, "image_id")
    parts = {}
    for c, n in zip("xyz", SIZE, strict=True):
        at = F.least(F.greatest(F.col("s" + c), F.lit(0.0)), F.col(n) - 1.0)
        low = F.floor(at).cast("int")
        ends = F.array(F.struct(low.alias("p"), (1 - (at - low)).alias("w")), F.struct(F.least(low + 1, F.col(n) - 1).alias("p"), (at - low).alias("w")))
        parts[c] = F.filter(ends, lambda e: e["w"] > 0)
    rows = rows.select("image_id", "k", F.explode(parts["x"]).alias("a"), parts["y"].alias("ys"), parts["z"].alias("zs"))
    rows = rows.select("image_id", "k", "a", F.explode("ys").alias("b"), "zs").select("image_id", "k", "a", "b", F.explode("zs").alias("c"))
    rows = rows.select("image_id", "k", F.col("a.p").alias("x"), F.col("b.p").alias("y"), F.col("c.p").alias("z"), (F.col("a.w") * F.col("b.w") * F.col("c.w")).alias("w"))
    return rows.join(vx.select(*VOXEL, "v"), list(VOXEL)).groupBy("image_id", "k").agg(F.sum(F.col("w") * F.col("v")).alias("v"))


def slab(vx: DataFrame, axis: str, at: int) -> DataFrame:
    """A slice across an axis as an image: image_id, x, y, v of the two axes left, in order."""
    left = [c for c in "xyz" if c != axis]
    return vx.where(F.col(axis) == at).select("image_id", F.col(left[0]).alias("x"), F.col(left[1]).alias("y"), "v")


def labelled(mask: DataFrame, neighbours: int = 26, periodic: bool = False) -> DataFrame:
    """(image_id, x, y, z, label): components of set voxels (m) by 6 or 26
    neighbours, round the border if asked, numbered from 1 by their first voxel.

    The least position spreads by steps, and by jumps to where a label leads."""
    pos = ((F.col("z") * F.col("ny") + F.col("y")) * F.col("nx") + F.col("x")).cast("long")
    now = mask.where("m").select(*VOXEL, *SIZE, pos.alias("pos"), pos.alias("label"))
    around = CROSS if neighbours == 6 else cube(1)
    before = None
    while True:
        near = sent(now.select(*VOXEL, *SIZE, "label"), around, "periodic" if periodic else "zero").groupBy(*VOXEL).agg(F.min("label").alias("near"))
        step = now.join(near, list(VOXEL)).withColumn("label", F.least("label", "near")).drop("near")
        used = step.select("image_id", "label").distinct()
        to = used.join(step.select("image_id", F.col("pos").alias("label"), F.col("label").alias("next")), ["image_id", "label"])
        step = step.join(to, ["image_id", "label"]).withColumn("label", F.least("label", "next")).drop("next")
        now = checkpointed(step.select(*VOXEL, *SIZE, "pos", "label"), now)
        state = now.agg(F.sum("label")).first()[0]
        if state == before:
            break
        before = state
    roots = now.select("image_id", "label").distinct()
    names = roots.withColumn("n", F.dense_rank().over(Window.partitionBy("image_id").orderBy("label")))
    return now.join(names, ["image_id", "label"]).select(*VOXEL, F.col("n").alias("label"))
