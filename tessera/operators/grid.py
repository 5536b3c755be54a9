"""Images as (image_id, x, y, v, nx, ny): geometry, boundary rules and stencils.

Everything is keyed by image_id and pixel; there is no step that needs a whole
image in one task. Stencils send each pixel's share to the pixels around it and
add up by target, with a partial sum before the shuffle; border pixels are
first copied to where the boundary rule says they are seen."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import checkpointed

PIXEL = ("image_id", "x", "y")
Kernel = Sequence[tuple[int, int, float]]  # dx, dy, weight


def crop(px: DataFrame, x0: int, y0: int, nx: int, ny: int) -> DataFrame:
    """The block of nx by ny pixels from (x0, y0), moved to the origin."""
    inside = px.where(F.col("x").between(x0, x0 + nx - 1) & F.col("y").between(y0, y0 + ny - 1))
    return inside.withColumn("x", F.col("x") - x0).withColumn("y", F.col("y") - y0).withColumn("nx", F.lit(nx)).withColumn("ny", F.lit(ny))


def crop_borders(px: DataFrame, color: float) -> DataFrame:
    """Each image cut to the bounding box of the pixels that aren't of that color."""
    box = px.where(F.col("v") != color).groupBy("image_id").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    rows = px.join(box, "image_id").where("x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1")
    return rows.select("image_id", (F.col("x") - F.col("x0")).alias("x"), (F.col("y") - F.col("y0")).alias("y"), "v", (F.col("x1") - F.col("x0") + 1).alias("nx"), (F.col("y1") - F.col("y0") + 1).alias("ny"))


def pad(px: DataFrame, nx: int, ny: int, fill: float) -> DataFrame:
    """Each image centred on a canvas of nx by ny, cut where it is larger."""
    ids = px.select("image_id", "nx", "ny").distinct()
    canvas = ids.select("image_id", F.col("nx").alias("mx"), F.col("ny").alias("my"), F.explode(F.sequence(F.lit(0), F.lit(nx - 1))).alias("x"))
    canvas = canvas.select("*", F.explode(F.sequence(F.lit(0), F.lit(ny - 1))).alias("y"))
    shift = lambda n, m: F.when(F.lit(n) >= m, F.floor((F.lit(n) - m) / 2)).otherwise(-F.floor((m - F.lit(n)) / 2)).cast("int")
    canvas = canvas.withColumn("sx", F.col("x") - shift(nx, F.col("mx"))).withColumn("sy", F.col("y") - shift(ny, F.col("my")))
    seen = px.select("image_id", F.col("x").alias("sx"), F.col("y").alias("sy"), "v")
    rows = canvas.join(seen, ["image_id", "sx", "sy"], "left")
    return rows.select("image_id", "x", "y", F.coalesce("v", F.lit(fill)).alias("v"), F.lit(nx).alias("nx"), F.lit(ny).alias("ny"))


def flip(px: DataFrame, axis: str) -> DataFrame:
    return px.withColumn(axis, F.col("n" + axis) - 1 - F.col(axis))


def rotate90(px: DataFrame) -> DataFrame:
    """A quarter turn: (x, y) comes to (ny - 1 - y, x)."""
    return px.select("image_id", (F.col("ny") - 1 - F.col("y")).alias("x"), F.col("x").alias("y"), "v", F.col("ny").alias("nx"), F.col("nx").alias("ny"))


def shift_periodic(px: DataFrame, dx: int, dy: int) -> DataFrame:
    return px.withColumn("x", F.pmod(F.col("x") + dx, F.col("nx"))).withColumn("y", F.pmod(F.col("y") + dy, F.col("ny")))


def mirror_center(px: DataFrame) -> DataFrame:
    return flip(flip(px, "x"), "y")


def upsample_nearest(px: DataFrame, factor: int) -> DataFrame:
    """Every pixel as factor by factor pixels."""
    steps = F.sequence(F.lit(0), F.lit(factor - 1))
    rows = px.select("*", F.explode(steps).alias("i")).select("*", F.explode(steps).alias("j"))
    return rows.select("image_id", (F.col("x") * factor + F.col("i")).alias("x"), (F.col("y") * factor + F.col("j")).alias("y"), "v", (F.col("nx") * factor).alias("nx"), (F.col("ny") * factor).alias("ny"))


def resample_bilinear(px: DataFrame, mx: int, my: int) -> DataFrame:
    """Bilinear values at mx by my places; the corners coincide. Each pixel
    goes to the places that it has a part in, and parts add up there."""

    def places(c: str, n: str, m: int) -> Column:
        step = (F.col(n) - 1) / F.lit(float(max(1, m - 1)))
        low = F.greatest(F.lit(0), F.floor((F.col(c) - 1) / step).cast("int"))
        high = F.least(F.lit(m - 1), F.ceil((F.col(c) + 1) / step).cast("int"))
        part = lambda k: 1 - F.abs(k * step - F.col(c))
        return F.filter(F.transform(F.sequence(low, high), lambda k: F.struct(k.alias("k"), part(k).alias("w"))), lambda s: s["w"] > 0)

    rows = px.select("image_id", "v", F.explode(places("x", "nx", mx)).alias("a"), places("y", "ny", my).alias("bs"))
    rows = rows.select("image_id", "v", "a", F.explode("bs").alias("b"))
    return rows.groupBy("image_id", F.col("a.k").alias("x"), F.col("b.k").alias("y")).agg(F.sum(F.col("v") * F.col("a.w") * F.col("b.w")).alias("v"))


def line_sums(px: DataFrame, axis: str) -> DataFrame:
    """Sums along an axis: a projection profile."""
    along = "y" if axis == "x" else "x"
    return px.groupBy("image_id", along).agg(F.sum("v").alias("v"))


def patches(px: DataFrame, w: int, step: int = 1) -> DataFrame:
    """w by w patches whose corners lie step apart: image_id, px, py and the values row by row."""
    offsets = F.sequence(F.lit(0), F.lit(w - 1))
    rows = px.select("*", F.explode(offsets).alias("i")).select("*", F.explode(offsets).alias("j"))
    rows = rows.withColumn("px", F.col("x") - F.col("i")).withColumn("py", F.col("y") - F.col("j"))
    rows = rows.where((F.col("px") >= 0) & (F.col("py") >= 0) & (F.col("px") + w <= F.col("nx")) & (F.col("py") + w <= F.col("ny")))
    rows = rows.where((F.col("px") % step == 0) & (F.col("py") % step == 0))
    values = F.array_sort(F.collect_list(F.struct((F.col("j") * w + F.col("i")).alias("k"), "v")))
    return rows.groupBy("image_id", "px", "py").agg(values.alias("p")).select("image_id", "px", "py", F.col("p.v").alias("p"))


def rebuilt(patch: DataFrame, w: int) -> DataFrame:
    """The image from its patches, averaged where they overlap."""
    rows = patch.select("image_id", "px", "py", F.posexplode("p").alias("k", "v"))
    rows = rows.select("image_id", (F.col("px") + F.col("k") % w).alias("x"), (F.col("py") + F.floor(F.col("k") / w).cast("int")).alias("y"), "v")
    return rows.groupBy(*PIXEL).agg(F.avg("v").alias("v"))


# ---- boundary rules and stencils ----


def seen_at(c: Column, n: Column, r: int, rule: str) -> Column:
    """All places up to r beyond the border at which coordinate c is seen."""
    if rule == "periodic":
        more = [F.when(c < r, c + n), F.when(c >= n - r, c - n)]
    elif rule == "reflect":  # the border isn't repeated: -1 is 1, n is n - 2
        more = [F.when((c >= 1) & (c <= r), -c), F.when((c <= n - 2) & (c >= n - 1 - r), 2 * (n - 1) - c)]
    elif rule == "clip":
        out = F.array(*[F.lit(k) for k in range(1, r + 1)]) if r else F.array().cast("array<int>")
        left = F.when(c == 0, F.transform(out, lambda k: -k)).otherwise(F.array().cast("array<int>"))
        right = F.when(c == n - 1, F.transform(out, lambda k: n - 1 + k)).otherwise(F.array().cast("array<int>"))
        return F.concat(F.array(c), left, right)
    elif rule == "zero":
        more = []
    else:
        raise ValueError(f"unknown boundary rule {rule}")
    return F.filter(F.array(c, *more), lambda x: x.isNotNull())


def padded(px: DataFrame, rx: int, ry: int, rule: str) -> DataFrame:
    rows = px.withColumn("x", F.explode(seen_at(F.col("x"), F.col("nx"), rx, rule)))
    return rows.withColumn("y", F.explode(seen_at(F.col("y"), F.col("ny"), ry, rule)))


def sent(px: DataFrame, kernel: Kernel, rule: str) -> DataFrame:
    """Each pixel (with all its columns) to every target that sees it: dx, dy, k
    say from where. A target p sees p + (dx, dy) with weight k."""
    rx, ry = max(abs(k[0]) for k in kernel), max(abs(k[1]) for k in kernel)
    cells = F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy"), F.lit(float(w)).alias("k")) for a, b, w in kernel])
    rows = padded(px, rx, ry, rule).select("*", F.inline(cells))
    rows = rows.withColumn("x", F.col("x") - F.col("dx")).withColumn("y", F.col("y") - F.col("dy"))
    return rows.where((F.col("x") >= 0) & (F.col("x") < F.col("nx")) & (F.col("y") >= 0) & (F.col("y") < F.col("ny")))


def correlate(px: DataFrame, kernel: Kernel, rule: str = "reflect", *more: tuple[str, Kernel]) -> DataFrame:
    """The weighted sum around every pixel; more gives further kernels and their columns in the same pass."""
    if not more:
        return sent(px, kernel, rule).groupBy(*PIXEL, "nx", "ny").agg(F.sum(F.col("k") * F.col("v")).alias("v"))
    tables = {"v": kernel, **dict(more)}
    places = sorted({(a, b) for k in tables.values() for a, b, _ in k})
    rows = sent(px, [(a, b, 0.0) for a, b in places], rule)
    weight = {}
    for name, k in tables.items():
        by = {(a, b): w for a, b, w in k}
        e = F.lit(0.0)
        for (a, b), w in by.items():
            e = F.when((F.col("dx") == a) & (F.col("dy") == b), F.lit(float(w))).otherwise(e)
        weight[name] = F.sum(e * F.col("v")).alias(name)
    return rows.groupBy(*PIXEL, "nx", "ny").agg(*weight.values())


def square(r: int) -> Kernel:
    return [(a, b, 1.0) for b in range(-r, r + 1) for a in range(-r, r + 1)]


def median_filter(px: DataFrame, r: int = 1) -> DataFrame:
    """The upper median of the frame, which ends at the border."""
    rows = sent(px, square(r), "zero").groupBy(*PIXEL).agg(F.array_sort(F.collect_list("v")).alias("f"))
    return rows.select(*PIXEL, F.element_at("f", F.floor(F.size("f") / 2).cast("int") + 1).alias("v"))


def bilateral(px: DataFrame, r: int, sigma: float, sigma_value: float) -> DataFrame:
    """The mean of the frame, weighted by nearness in place and value."""
    rows = sent(px.withColumnRenamed("v", "u"), square(r), "zero").join(px.select(*PIXEL, "v"), list(PIXEL))
    d = F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")
    w = F.exp(-d / (2 * sigma * sigma)) * F.exp(-(F.col("u") - F.col("v")) * (F.col("u") - F.col("v")) / (2 * sigma_value * sigma_value))
    return rows.groupBy(*PIXEL).agg((F.sum(w * F.col("u")) / F.sum(w)).alias("v"))


def gradient_forward(px: DataFrame) -> DataFrame:
    """Differences to the next pixel; 0 at the far border."""
    rows = sent(px, [(0, 0, 1.0), (1, 0, 1.0), (0, 1, 1.0)], "clip")
    at = lambda a, b: F.sum(F.when((F.col("dx") == a) & (F.col("dy") == b), F.col("v")))
    return rows.groupBy(*PIXEL, "nx", "ny").agg((at(1, 0) - at(0, 0)).alias("gx"), (at(0, 1) - at(0, 0)).alias("gy"))


def divergence_backward(field: DataFrame) -> DataFrame:
    """The negative adjoint of gradient_forward, of a field (gx, gy)."""
    gx = field.select(*PIXEL, "nx", "ny", F.when(F.col("x") < F.col("nx") - 1, F.col("gx")).otherwise(0.0).alias("gx"), F.when(F.col("y") < F.col("ny") - 1, F.col("gy")).otherwise(0.0).alias("gy"))
    rows = sent(gx, [(0, 0, 1.0), (-1, 0, 1.0), (0, -1, 1.0)], "zero")
    here = (F.col("dx") == 0) & (F.col("dy") == 0)
    part = F.when(here, F.col("gx") + F.col("gy")).when(F.col("dx") == -1, -F.col("gx")).otherwise(-F.col("gy"))
    return rows.groupBy(*PIXEL).agg(F.sum(part).alias("v"))


def gradient_central(px: DataFrame) -> DataFrame:
    """Half differences of both neighbours, round the border."""
    rows = correlate(px, [(1, 0, 0.5), (-1, 0, -0.5)], "periodic", ("gy", [(0, 1, 0.5), (0, -1, -0.5)]))
    return rows.select(*PIXEL, F.col("v").alias("gx"), "gy")


def dilate(mask: DataFrame) -> DataFrame:
    """A mask (m) with the four neighbours of its pixels."""
    rows = sent(mask, [(0, 0, 1.0), (1, 0, 1.0), (-1, 0, 1.0), (0, 1, 1.0), (0, -1, 1.0)], "zero")
    return rows.groupBy(*PIXEL, "nx", "ny").agg(F.max("m").alias("m"))


def erode(mask: DataFrame) -> DataFrame:
    """Dilation of the complement; beyond the border everything counts as set."""
    return dilate(mask.withColumn("m", ~F.col("m"))).withColumn("m", ~F.col("m"))


def local_maxima(px: DataFrame, r: int) -> DataFrame:
    """Pixels at least r from the border that no pixel of their frame exceeds."""
    top = sent(px, square(r), "zero").groupBy(*PIXEL).agg(F.max("v").alias("top"))
    inner = (F.col("x") >= r) & (F.col("y") >= r) & (F.col("x") < F.col("nx") - r) & (F.col("y") < F.col("ny") - r)
    return px.where(inner).join(top, list(PIXEL)).where("v >= top").drop("top")


def local_histogram(px: DataFrame, scale: int, bins: int) -> DataFrame:
    """Shares of the bins among the scale by scale pixels around each, borders
    repeated; bins of equal width over the image's extent.

    The frame is a box, so bins are added up along x, then along y: 2 scale
    rows for each pixel instead of scale squared."""
    from .ordering import bin_of
    from .vector import with_extent

    r = (scale - 1) // 2
    rows = with_extent(px, "image_id").withColumn("bin", bin_of(F.col("v"), F.col("low"), F.col("high"), bins))
    row = sent(rows.select(*PIXEL, "nx", "ny", "bin"), [(a, 0, 1.0) for a in range(-r, r + 1)], "clip").groupBy(*PIXEL, "nx", "ny", "bin").agg(F.count("*").alias("c"))
    both = sent(row, [(0, b, 1.0) for b in range(-r, r + 1)], "clip").groupBy(*PIXEL, "bin").agg(F.sum("c").alias("c"))
    return both.select(*PIXEL, "bin", (F.col("c") / (scale * scale)).alias("share"))


def edge_indicator(px: DataFrame, h: int) -> DataFrame:
    """Squared differences over 2h along x and y; -1 where the frame leaves the image."""
    rows = correlate(px, [(h, 0, 1.0), (-h, 0, -1.0)], "clip", ("w", [(0, h, 1.0), (0, -h, -1.0)]))
    inside = (F.col("x") >= h) & (F.col("y") >= h) & (F.col("x") < F.col("nx") - h) & (F.col("y") < F.col("ny") - h)
    return rows.select(*PIXEL, F.when(inside, F.col("v") * F.col("v") + F.col("w") * F.col("w")).otherwise(-1.0).alias("v"))


# ---- connected components ----


def labelled(mask: DataFrame) -> DataFrame:
    """(image_id, x, y, label): components of set pixels (m), eight neighbours
    connected, numbered from 1 by their first pixel in scan order.

    Smallest positions spread along rows at once (a running minimum over each
    run), then by steps and jumps to the position that a label names.

    Joins with a row for each pixel or component are merged: Spark takes the packed
    size of a written table for that of what is made from it, and would send it whole."""
    px = mask.where("m").select(*PIXEL, "nx", "ny", (F.col("y") * F.col("nx") + F.col("x")).cast("long").alias("pos"))
    run = F.col("x") - F.row_number().over(Window.partitionBy("image_id", "y").orderBy("x"))
    px = px.withColumn("run", run)
    now = px.withColumn("label", F.min("pos").over(Window.partitionBy("image_id", "y", "run")))
    around = [(a, b, 1.0) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    before = None
    while True:
        near = sent(now.select(*PIXEL, "nx", "ny", "label"), around, "zero").groupBy(*PIXEL).agg(F.min("label").alias("near"))
        step = now.join(near.hint("merge"), list(PIXEL)).withColumn("label", F.min("near").over(Window.partitionBy("image_id", "y", "run"))).drop("near")
        # where labels lead: one row for each label in use, few enough to be sent to all tasks once components have formed
        used = step.select("image_id", "label").distinct()
        to = used.join(step.select("image_id", F.col("pos").alias("label"), F.col("label").alias("next")).hint("merge"), ["image_id", "label"])
        step = step.join(to, ["image_id", "label"]).withColumn("label", F.least("label", "next")).drop("next")
        now = checkpointed(step.select("image_id", "x", "y", "nx", "ny", "pos", "run", "label"), now)
        state = now.agg(F.sum("label")).first()[0]
        if state == before:
            break
        before = state
    roots = now.select("image_id", "label").distinct()
    names = roots.withColumn("n", F.dense_rank().over(Window.partitionBy("image_id").orderBy("label")))
    return now.join(names.hint("merge"), ["image_id", "label"]).select(*PIXEL, F.col("n").alias("label"))


def component_statistics(labels: DataFrame) -> DataFrame:
    """Size, rounded centre and extent of each component."""
    rounded = lambda c: F.floor(F.avg(c) + 0.5).cast("long")
    return labels.groupBy("image_id", "label").agg(
        F.count("*").alias("size"), rounded("x").alias("cx"), rounded("y").alias("cy"),
        (F.max("x") - F.min("x")).alias("width"), (F.max("y") - F.min("y")).alias("height"),
    )


def clean_mask(labels: DataFrame, nx: int, ny: int, least: int, drop_boundary: bool) -> DataFrame:
    """Pixels of components of at least that size, and away from the border if asked."""
    stats = labels.groupBy("image_id", "label").agg(F.count("*").alias("n"), F.min(F.least("x", "y", nx - 1 - F.col("x"), ny - 1 - F.col("y"))).alias("gap"))
    good = stats.where((F.col("n") >= least) & ((F.col("gap") > 0) | F.lit(not drop_boundary)))
    return labels.join(good, ["image_id", "label"], "left_semi").select(*PIXEL)


# ---- resampling, interpolation, deformation ----


def resample_bicubic(px: DataFrame, mx: int, my: int) -> DataFrame:
    """Cubic convolution (slope -1/2) at mx by my places; the corners coincide,
    border pixels are repeated. As resample_bilinear, each pixel goes to the
    places that it has a part in."""

    def weight(t: Column) -> Column:
        a = F.abs(t)
        return F.when(a < 1, (1.5 * a - 2.5) * a * a + 1).when(a < 2, ((-0.5 * a + 2.5) * a - 4) * a + 2).otherwise(0.0)

    def places(c: str, n: str, m: int) -> Column:
        step = (F.col(n) - 1) / F.lit(float(max(1, m - 1)))
        low = F.greatest(F.lit(0), F.floor((F.col(c) - 2) / step).cast("int"))
        high = F.least(F.lit(m - 1), F.ceil((F.col(c) + 2) / step).cast("int"))
        span = F.when(low <= high, F.sequence(low, F.greatest(low, high))).otherwise(F.array().cast("array<int>"))
        return F.filter(F.transform(span, lambda k: F.struct(k.alias("k"), weight(k * step - F.col(c)).alias("w"))), lambda s: s["w"] != 0)

    rows = padded(px, 2, 2, "clip")
    rows = rows.select("image_id", "v", F.explode(places("x", "nx", mx)).alias("a"), places("y", "ny", my).alias("bs"))
    rows = rows.select("image_id", "v", "a", F.explode("bs").alias("b"))
    return rows.groupBy("image_id", F.col("a.k").alias("x"), F.col("b.k").alias("y")).agg(F.sum(F.col("v") * F.col("a.w") * F.col("b.w")).alias("v"))


def resample_keeping_aspect(px: DataFrame, nx: int, ny: int, mx: int, my: int, fill: float) -> DataFrame:
    """Images of nx by ny scaled to fit into mx by my, centred there."""
    scale = min(mx / nx, my / ny)
    sx, sy = max(1, round(nx * scale)), max(1, round(ny * scale))
    small = resample_bilinear(px, sx, sy).withColumn("nx", F.lit(sx)).withColumn("ny", F.lit(sy))
    return pad(small, mx, my, fill)


def resample_nearest(px: DataFrame, mx: int, my: int) -> DataFrame:
    """mx by my places, each with the value at floor(place n / m): for labels."""

    def places(c: str, n: str, m: int) -> Column:
        low = F.ceil(F.col(c) * m / F.col(n)).cast("int")
        high = (F.ceil((F.col(c) + 1) * m / F.col(n)) - 1).cast("int")
        return F.when(low <= high, F.sequence(low, F.greatest(low, high))).otherwise(F.array().cast("array<int>"))

    rows = px.select("image_id", "v", F.explode(places("x", "nx", mx)).alias("a"), places("y", "ny", my).alias("bs"))
    return rows.select("image_id", F.col("a").alias("x"), F.explode("bs").alias("y"), "v", F.lit(mx).alias("nx"), F.lit(my).alias("ny"))


def interpolated_at(px: DataFrame, places: DataFrame, rule: str = "clip") -> DataFrame:
    """places (image_id, sx, sy and any other columns) with v, bilinear between
    the four pixels around a place; beyond the border by the rule, clip or periodic."""
    size = px.select("image_id", "nx", "ny").distinct()
    rows = places.withColumn("__place", F.monotonically_increasing_id())
    rows = checkpointed(rows).join(F.broadcast(size), "image_id")  # one row an image
    if rule == "clip":
        rows = rows.withColumn("__u", F.least(F.greatest(F.col("sx"), F.lit(0.0)), F.col("nx") - 1.0)).withColumn("__w", F.least(F.greatest(F.col("sy"), F.lit(0.0)), F.col("ny") - 1.0))
    else:
        rows = rows.withColumn("__u", F.pmod(F.col("sx"), F.col("nx").cast("double"))).withColumn("__w", F.pmod(F.col("sy"), F.col("ny").cast("double")))
    i, j = F.floor("__u").cast("int"), F.floor("__w").cast("int")
    a, b = F.col("__u") - i, F.col("__w") - j
    after = (lambda c, n: F.least(c + 1, F.col(n) - 1)) if rule == "clip" else (lambda c, n: (c + 1) % F.col(n))
    ends = F.array(*[F.struct(p.alias("x"), q.alias("y"), w.alias("k")) for p, q, w in ((i, j, (1 - a) * (1 - b)), (after(i, "nx"), j, a * (1 - b)), (i, after(j, "ny"), (1 - a) * b), (after(i, "nx"), after(j, "ny"), a * b))])
    near = rows.select("__place", "image_id", F.inline(F.filter(ends, lambda e: e["k"] != 0)))
    v = near.join(px.select(*PIXEL, "v"), list(PIXEL)).groupBy("__place").agg(F.sum(F.col("k") * F.col("v")).alias("v"))
    return rows.join(v, "__place").drop("__place", "__u", "__w")


def deformed(px: DataFrame, field: DataFrame) -> DataFrame:
    """The image seen through a displacement (image_id, x, y, dx, dy): v(x + dx, y + dy), clipped at the border."""
    places = field.select(*PIXEL, (F.col("x") + F.col("dx")).alias("sx"), (F.col("y") + F.col("dy")).alias("sy"))
    return interpolated_at(px, places).select(*PIXEL, "v", "nx", "ny")


def _component(field: DataFrame, c: str, size: DataFrame) -> DataFrame:
    return field.select(*PIXEL, F.col(c).alias("v")).join(F.broadcast(size), "image_id")


def concatenated_fields(first: DataFrame, second: DataFrame, size: DataFrame) -> DataFrame:
    """One displacement after another: d1(x) + d2(x + d1(x)). size: image_id, nx, ny."""
    places = first.select(*PIXEL, "dx", "dy", (F.col("x") + F.col("dx")).alias("sx"), (F.col("y") + F.col("dy")).alias("sy"))
    out = interpolated_at(_component(second, "dx", size), places).select(*PIXEL, "dx", "dy", "sx", "sy", F.col("v").alias("ex"))
    out = interpolated_at(_component(second, "dy", size), out).select(*PIXEL, "dx", "dy", "ex", F.col("v").alias("ey"))
    return out.select(*PIXEL, (F.col("dx") + F.col("ex")).alias("dx"), (F.col("dy") + F.col("ey")).alias("dy"))


def inverse_field(field: DataFrame, size: DataFrame, rounds: int = 8) -> DataFrame:
    """e with x + e(x) led back by the field, by the rounds e <- -d(x + e) (for displacements with slopes below 1)."""
    now = field.select(*PIXEL, F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy"))
    for _ in range(rounds):
        places = now.select(*PIXEL, (F.col("x") + F.col("dx")).alias("sx"), (F.col("y") + F.col("dy")).alias("sy"))
        ex = interpolated_at(_component(field, "dx", size), places).select(*PIXEL, "sx", "sy", (-F.col("v")).alias("dx"))
        now = checkpointed(interpolated_at(_component(field, "dy", size), ex).select(*PIXEL, "dx", (-F.col("v")).alias("dy")), now)
    return now


def prolongated(px: DataFrame) -> DataFrame:
    """From n to 2 n - 1 pixels a side: old ones stay, new ones are means of their neighbours."""
    halves = [(a, b, 0.5 ** (abs(a) + abs(b))) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(w).alias("k")) for a, b, w in halves])
    rows = px.select("image_id", "v", "nx", "ny", "x", "y", F.inline(cells))
    rows = rows.select("image_id", (2 * F.col("x") + F.col("a")).alias("x"), (2 * F.col("y") + F.col("b")).alias("y"), "k", "v", (2 * F.col("nx") - 1).alias("nx"), (2 * F.col("ny") - 1).alias("ny"))
    rows = rows.where("x >= 0 AND y >= 0 AND x < nx AND y < ny")
    return rows.groupBy(*PIXEL, "nx", "ny").agg(F.sum(F.col("k") * F.col("v")).alias("v"))


def restricted(px: DataFrame) -> DataFrame:
    """From n to (n + 1) / 2 pixels a side: each new one is the mean of the old ones around it, the near ones twice as heavy an axis."""
    halves = [(a, b, 0.5 ** (abs(a) + abs(b))) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(w).alias("k")) for a, b, w in halves])
    rows = px.select("image_id", "v", "nx", "ny", "x", "y", F.inline(cells))
    rows = rows.withColumn("cx", F.col("x") + F.col("a")).withColumn("cy", F.col("y") + F.col("b")).where("cx % 2 = 0 AND cy % 2 = 0 AND cx >= 0 AND cy >= 0 AND cx < nx AND cy < ny")
    size = [F.floor((F.col(n) + 1) / 2).cast("int").alias(n) for n in ("nx", "ny")]
    rows = rows.select("image_id", (F.col("cx") / 2).cast("int").alias("x"), (F.col("cy") / 2).cast("int").alias("y"), "k", "v", *size)
    return rows.groupBy(*PIXEL, "nx", "ny").agg((F.sum(F.col("k") * F.col("v")) / F.sum("k")).alias("v"))


# ---- lines, joins of images, patches ----


def line(px: DataFrame, axis: str, at: int) -> DataFrame:
    """A row (axis y) or column (axis x) as vectors: image_id, pos, v."""
    along = "x" if axis == "y" else "y"
    return px.where(F.col(axis) == at).select("image_id", F.col(along).alias("pos"), "v")


def with_line(px: DataFrame, axis: str, at: int, values: DataFrame) -> DataFrame:
    """px with a row or column replaced by vectors (image_id, pos, v)."""
    along = "x" if axis == "y" else "y"
    new = values.select("image_id", F.col("pos").alias(along), F.col("v").alias("__new"))
    rows = px.join(new.withColumn(axis, F.lit(at)), ["image_id", "x", "y"], "left")
    return rows.withColumn("v", F.coalesce("__new", "v")).drop("__new")


def stacked(px: DataFrame, gap: int, fill: float) -> DataFrame:
    """Images of one size below each other by their id, with gap rows of fill between them: x, y, v."""
    size = px.agg(F.max("nx").alias("mx"), F.max("ny").alias("my"), F.min("image_id").alias("first"), F.max("image_id").alias("last"))
    rows = px.crossJoin(F.broadcast(size)).select("x", (F.col("y") + (F.col("image_id") - F.col("first")) * (F.col("my") + gap)).alias("y"), "v")
    space = size.select("*", F.explode(F.sequence(F.col("first"), F.col("last"))).alias("k")).where("k < last")
    space = space.select("*", F.explode(F.sequence(F.lit(0), F.lit(gap - 1))).alias("g")).select("*", F.explode(F.sequence(F.lit(0), F.col("mx") - 1)).alias("x"))
    return rows.unionByName(space.select("x", ((F.col("k") - F.col("first")) * (F.col("my") + gap) + F.col("my") + F.col("g")).alias("y"), F.lit(fill).alias("v"))) if gap else rows


def crop_segment(px: DataFrame, labels: DataFrame, label: int) -> DataFrame:
    """Each image cut to the bounding box of a label (labels: image_id, x, y, label)."""
    box = labels.where(F.col("label") == label).groupBy("image_id").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    rows = px.join(F.broadcast(box), "image_id").where("x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1")
    return rows.select("image_id", (F.col("x") - F.col("x0")).alias("x"), (F.col("y") - F.col("y0")).alias("y"), "v", (F.col("x1") - F.col("x0") + 1).alias("nx"), (F.col("y1") - F.col("y0") + 1).alias("ny"))


def weighted_patches(patch: DataFrame, weights: list[float]) -> DataFrame:
    """Patches with each value times the weight of its place."""
    w = F.array(*map(F.lit, weights))
    return patch.withColumn("p", F.zip_with("p", w, lambda v, k: v * k))


# ---- differences inside and at the border ----


def gradient_one_sided(px: DataFrame) -> DataFrame:
    """Half differences of both neighbours, at the border the difference to the one that there is."""
    rows = sent(px, [(0, 0, 1.0), (1, 0, 1.0), (-1, 0, 1.0), (0, 1, 1.0), (0, -1, 1.0)], "zero")
    at = lambda a, b: F.max(F.when((F.col("dx") == a) & (F.col("dy") == b), F.col("v")))
    rows = rows.groupBy(*PIXEL).agg(at(0, 0).alias("c"), at(1, 0).alias("e"), at(-1, 0).alias("w"), at(0, 1).alias("s"), at(0, -1).alias("n"))
    slope = lambda a, b: (F.coalesce(a, F.col("c")) - F.coalesce(b, F.col("c"))) * F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 0.5).otherwise(1.0)
    return rows.select(*PIXEL, slope("e", "w").alias("gx"), slope("s", "n").alias("gy"))


def hessian(px: DataFrame) -> DataFrame:
    """Second differences, border pixels repeated."""
    xx, yy = [(1, 0, 1.0), (0, 0, -2.0), (-1, 0, 1.0)], [(0, 1, 1.0), (0, 0, -2.0), (0, -1, 1.0)]
    xy = [(1, 1, 0.25), (-1, -1, 0.25), (1, -1, -0.25), (-1, 1, -0.25)]
    return correlate(px, xx, "clip", ("yy", yy), ("xy", xy)).select(*PIXEL, F.col("v").alias("xx"), "xy", "yy")


def position_local_maxima(px: DataFrame) -> DataFrame:
    """Pixels that none of their neighbours, up to eight, exceeds."""
    top = sent(px, square(1), "zero").groupBy(*PIXEL).agg(F.max("v").alias("top"))
    return px.join(top, list(PIXEL)).where("v >= top").drop("top")


def dilate_along(mask: DataFrame, axis: str) -> DataFrame:
    """A mask (m) with the two neighbours of its pixels along an axis."""
    step = (1, 0) if axis == "x" else (0, 1)
    rows = sent(mask, [(0, 0, 1.0), (*step, 1.0), (-step[0], -step[1], 1.0)], "zero")
    return rows.groupBy(*PIXEL, "nx", "ny").agg(F.max("m").alias("m"))


def level_set_step(px: DataFrame, tau: float, speed: float) -> DataFrame:
    """One upwind step of u_t + speed |grad u| = 0: forward or backward differences, whichever the front comes from."""
    rows = sent(px, [(0, 0, 1.0), (1, 0, 1.0), (-1, 0, 1.0), (0, 1, 1.0), (0, -1, 1.0)], "clip")
    at = lambda a, b: F.max(F.when((F.col("dx") == a) & (F.col("dy") == b), F.col("v")))
    rows = rows.groupBy(*PIXEL, "nx", "ny").agg(at(0, 0).alias("c"), at(1, 0).alias("e"), at(-1, 0).alias("w"), at(0, 1).alias("s"), at(0, -1).alias("n"))
    zero = F.lit(0.0)

    def squared(before: str, after: str) -> Column:
        back, ahead = F.col("c") - F.col(before), F.col(after) - F.col("c")
        if speed > 0:
            a, b = F.greatest(back, zero), F.least(ahead, zero)
        else:
            a, b = F.least(back, zero), F.greatest(ahead, zero)
        return a * a + b * b

    size = F.sqrt(squared("w", "e") + squared("n", "s"))
    return rows.select(*PIXEL, "nx", "ny", (F.col("c") - tau * speed * size).alias("v"))


def gray_morphology(px: DataFrame, kind: str, steps: int, tau: float = 0.5) -> DataFrame:
    """Gray dilation, erosion, opening or closing by a disc of radius steps tau, as the motion of all level lines."""
    speeds = {"dilation": [-1.0], "erosion": [1.0], "opening": [1.0, -1.0], "closing": [-1.0, 1.0]}[kind]
    for s in speeds:
        for _ in range(steps):
            px = level_set_step(px, tau, s)
    return px


def component_diameters(labels: DataFrame, angles: int = 36) -> DataFrame:
    """The least and greatest width of each component over that many directions, 360 / angles degrees apart."""
    cells = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(math.cos(2 * math.pi * k / angles)).alias("a"), F.lit(math.sin(2 * math.pi * k / angles)).alias("b")) for k in range(angles)])
    rows = labels.select("image_id", "label", "x", "y", F.inline(cells))
    along = F.col("a") * F.col("x") + F.col("b") * F.col("y")
    width = rows.groupBy("image_id", "label", "k").agg((F.max(along) - F.min(along)).alias("w"))
    return width.groupBy("image_id", "label").agg(F.min("w").alias("least"), F.max("w").alias("most"))


def squared_distance(mask: DataFrame) -> DataFrame:
    """d2, the squared distance of every pixel to the nearest set one (m); null in
    an image without any. Along rows from the last set pixel before and the first
    after; then each column, as an array, takes the least of what its rows offer."""
    row = Window.partitionBy("image_id", "y").orderBy("x")
    at = F.when(F.col("m"), F.col("x"))
    before = F.max(at).over(row.rowsBetween(Window.unboundedPreceding, 0))
    after = F.min(at).over(row.rowsBetween(0, Window.unboundedFollowing))
    d = F.least(F.col("x") - before, after - F.col("x"))
    rows = mask.select(*PIXEL, (d * d).alias("d2"))
    column = F.array_sort(F.collect_list(F.struct("y", "d2")))
    columns = rows.groupBy("image_id", "x").agg(column.alias("c"))
    offers = F.filter("c", lambda e: e["d2"].isNotNull())
    least = F.transform("c", lambda e: F.struct(e["y"].alias("y"), F.array_min(F.transform(F.col("o"), lambda q: q["d2"] + (q["y"] - e["y"]) * (q["y"] - e["y"]))).alias("d2")))
    return columns.withColumn("o", offers).select("image_id", "x", F.inline(least))
