"""Clustering, principal components, label maps and their quality."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Centers = list[list[float]]


def literal(center: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in center])


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def assigned(points: DataFrame, centers: Centers) -> DataFrame:
    """points with label and d2, the nearest center (the first on ties) and the
    squared distance. Centers are k literals; no join, no shuffle."""
    near = F.array_min(F.array(*[F.struct(squared_distance(F.col("features"), literal(c)).alias("d2"), F.lit(k).alias("label")) for k, c in enumerate(centers)]))
    return points.withColumn("near", near).withColumn("label", F.col("near.label")).withColumn("d2", F.col("near.d2")).drop("near")


def means(labelled: DataFrame, k: int, dim: int) -> Centers:
    """Mean of each cluster (an empty one gives the zero vector): one aggregate with a partial sum per component."""
    sums = labelled.groupBy("label").agg(F.count("*").alias("n"), *[F.sum(F.col("features")[j]).alias(f"s{j}") for j in range(dim)]).collect()
    out = [[0.0] * dim for _ in range(k)]
    for row in sums:
        out[row["label"]] = [row[f"s{j}"] / row["n"] for j in range(dim)]
    return out


def first_centers(points: DataFrame, k: int, seed: int = 0) -> Centers:
    """k points in the order of a hash: the same whatever the partitions."""
    rows = points.select("pos", "features").orderBy(F.xxhash64(F.lit(seed), "pos"), "pos").limit(k).collect()
    return [list(r["features"]) for r in rows]


def farthest_centers(points: DataFrame, k: int) -> Centers:
    """Greedy: the longest vector first, then the point farthest from those chosen."""
    norm = F.aggregate(F.transform("features", lambda x: x * x), F.lit(0.0), lambda s, x: s + x)
    best = points.agg(F.max_by("features", F.struct(norm, -F.col("pos"))).alias("c")).first()
    out = [list(best["c"])]
    while len(out) < k:
        out.append(list(assigned(points, out).agg(F.max_by("features", F.struct("d2", -F.col("pos"))).alias("c")).first()["c"]))
    return out


def lloyd_round(points: DataFrame, passes: list[Centers]) -> tuple[list[Centers], list[float]]:
    """One round of several runs at once: the new centers of each and the sum of
    squared distances to its old ones. Tasks assign whole batches and send sums
    by run and cluster, dim + 2 numbers each."""
    old = np.array(passes)
    runs, k, dim = old.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((runs, k, dim + 2))
        for b in batches:
            x = np.array(b["features"].tolist(), float).reshape(len(b), dim)
            for p in range(runs):
                d2 = np.stack([((x - c) ** 2).sum(1) for c in old[p]])
                label = d2.argmin(0)
                np.add.at(total[p, :, :dim], label, x)
                total[p, :, dim] += np.bincount(label, minlength=k)
                total[p, :, dim + 1] += np.bincount(label, d2.min(0), k)
        at = np.indices(total.shape)
        yield pd.DataFrame({"p": at[0].ravel(), "k": at[1].ravel(), "j": at[2].ravel(), "s": total.ravel()})

    total = np.zeros((runs, k, dim + 2))
    sums = points.select("features").mapInPandas(run, "p int, k int, j int, s double").groupBy("p", "k", "j").agg(F.sum("s"))
    for p, c, j, s in sums.collect():  # runs x clusters x (dim + 2) rows
        total[p, c, j] = s
    n = total[..., dim : dim + 1]
    return (total[..., :dim] / np.maximum(n, 1)).tolist(), total[..., dim + 1].sum(1).tolist()


def kmeans(points: DataFrame, centers: Centers, most: int = 100, eps: float = 1e-3) -> tuple[Centers, float, int]:
    """Lloyd's rounds until the centers move by at most eps (Frobenius norm): centers, residual, rounds."""
    rounds = 0
    for rounds in range(1, most + 1):
        (new,), _ = lloyd_round(points, [centers])
        moved = math.dist(sum(new, []), sum(centers, []))
        centers = new
        if moved <= eps:
            break
    return centers, math.sqrt(lloyd_round(points, [centers])[1][0]), rounds


def kmeans_restarts(points: DataFrame, k: int, passes: int, most: int = 20, eps: float = 1e-3) -> tuple[Centers, float]:
    """The best of several starts, all of them advanced by one job a round."""
    now = [first_centers(points, k, s) for s in range(passes)]
    for _ in range(most):
        new, _ = lloyd_round(points, now)
        moved = max(math.dist(sum(a, []), sum(b, [])) for a, b in zip(new, now, strict=True))
        now = new
        if moved <= eps:
            break
    cost = lloyd_round(points, now)[1]
    best = min(range(passes), key=cost.__getitem__)
    return now[best], math.sqrt(cost[best])


def drawn_centers(points: DataFrame, k: int, seed: int = 0) -> Centers:
    """Centers drawn one by one, the first evenly, each other with a chance in
    proportion to its squared distance to those before: the point of the least
    -ln(u) / d2, u being a number from the digest of its position. So one pass
    and no running sum finds each."""
    from ..functions.scalar import uniform

    key = F.col("pos").cast("string")
    first = points.agg(F.min_by("features", F.struct(uniform(key, seed), "pos")).alias("c")).first()
    out = [list(first["c"])]
    while len(out) < k:
        race = -F.log(1 - uniform(key, seed + len(out))) / F.col("d2")
        next_ = assigned(points, out).where("d2 > 0").agg(F.min_by("features", F.struct(race, F.col("pos"))).alias("c")).first()["c"]
        if next_ is None:
            raise ValueError("fewer different points than clusters")
        out.append(list(next_))
    return out


def initial_centers(points: DataFrame, k: int, method: str, seed: int = 0, given: Centers | None = None) -> Centers:
    """By random points, greedy farthest points, weighted draws, or as given."""
    if method == "given":
        if given is None or len(given) != k:
            raise ValueError(f"{k} centers must be given")
        return given
    makers = {"random": lambda: first_centers(points, k, seed), "farthest": lambda: farthest_centers(points, k), "drawn": lambda: drawn_centers(points, k, seed)}
    if method not in makers:
        raise NotImplementedError(f"centers by {method}")
    return makers[method]()


def cluster_variances(points: DataFrame, centers: Centers) -> tuple[list[int], list[float]]:
    """Sizes of the clusters and their mean squared distances."""
    found = {x["label"]: x for x in assigned(points, centers).groupBy("label").agg(F.count("*").alias("n"), F.avg("d2").alias("v")).collect()}
    return [found[k]["n"] if k in found else 0 for k in range(len(centers))], [found[k]["v"] if k in found else 0.0 for k in range(len(centers))]


def information_criteria(dim: int, sizes: list[int], variances: list[float]) -> tuple[float, float, float]:
    """AIC, corrected AIC and BIC of spherical Gaussians, one variance for each cluster."""
    n, k = sum(sizes), len(sizes)
    fit = sum(m * math.log(m) - m * math.log(n) - 0.5 * m * (math.log(2 * math.pi) + dim * math.log(max(v, 1e-300)) + 1) for m, v in zip(sizes, variances, strict=True) if m)
    q = k - 1 + dim * k + k
    aic = 2 * q - 2 * fit
    return aic, aic + 2 * q * (q + 1) / max(1, n - q - 1), q * math.log(n) - 2 * fit


def pmeans(points: DataFrame, dim: int, most: int = 10, significance: float = 0.1, rounds: int = 100) -> tuple[list[tuple[float, float, float]], dict[str, int]]:
    """Criteria for 1, 2, ... clusters, up to most or until one has at most one
    member; and the number of clusters that BIC chooses: the least value, and the
    fewest clusters whose likelihood relative to the least is above significance."""
    found: list[tuple[float, float, float]] = []
    for k in range(1, most + 1):
        centers, _, _ = kmeans(points, farthest_centers(points, k), rounds)
        sizes, variances = cluster_variances(points, centers)
        if k > 1 and min(sizes) <= 1:
            break
        found.append(information_criteria(dim, sizes, variances))
    bic = [c[2] for c in found]
    likely = [math.exp(max(-700.0, 0.5 * (min(bic) - b))) > significance for b in bic]
    return found, {"least": bic.index(min(bic)) + 1, "significant": likely.index(True) + 1}


def spatial_intensity(px: DataFrame, seeds: list[tuple[int, int]], rounds: int) -> DataFrame:
    """(image_id, k, cx, cy): clusters of each image's pixels by place and value.
    A pixel is as far from a center as their places are apart, times the
    difference of exp(v) of both; means of places are weighted by exp(v)."""
    from .storage import checkpointed

    px = px.select("image_id", "x", "y", "v")
    starts = px.sparkSession.createDataFrame([(k, x, y) for k, (x, y) in enumerate(seeds)], "k int, x int, y int")
    now = px.join(F.broadcast(starts), ["x", "y"]).select("image_id", "k", F.col("x").cast("double").alias("cx"), F.col("y").cast("double").alias("cy"), F.col("v").alias("cv"))
    for _ in range(rounds):
        near = px.join(F.broadcast(now), "image_id")  # a row for each image and cluster
        dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
        far = F.round(F.abs(F.exp("cv") - F.exp("v")) * F.sqrt(dx * dx + dy * dy), 9)
        own = near.groupBy("image_id", "x", "y", "v").agg(F.min(F.struct(far.alias("d"), "k")).alias("m"))
        w = F.exp("v")
        mean = own.groupBy("image_id", F.col("m.k").alias("k")).agg((F.sum(w * F.col("x")) / F.sum(w)).alias("cx"), (F.sum(w * F.col("y")) / F.sum(w)).alias("cy"))
        mean = mean.withColumn("x", F.floor(F.col("cx") + 0.5).cast("int")).withColumn("y", F.floor(F.col("cy") + 0.5).cast("int"))
        now = checkpointed(mean.join(px.withColumnRenamed("v", "cv"), ["image_id", "x", "y"]).select("image_id", "k", "cx", "cy", "cv"), now)
    return now


def moments(points: DataFrame, dim: int) -> DataFrame:
    """(i, j, s): sums of products of components over all rows, with a constant
    1 as component dim. Tasks multiply whole batches and send one matrix each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dim + 1, dim + 1))
        for b in batches:
            x = np.column_stack([np.array(b["features"].tolist(), float).reshape(len(b), dim), np.ones(len(b))])
            total += x.T @ x
        i, j = np.indices(total.shape)
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "s": total.ravel()})

    return points.select("features").mapInPandas(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))


def covariance(points: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean, scatter matrix (not divided by n) and n."""
    m = np.zeros((dim + 1, dim + 1))
    for i, j, s in moments(points, dim).collect():  # (dim + 1)^2 rows
        m[i, j] = s
    n = m[dim, dim]
    mean = m[dim, :dim] / max(n, 1)
    return mean, m[:dim, :dim] - n * np.outer(mean, mean), int(n)


def principal_components(points: DataFrame, dim: int, share: float = 0.95, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, eigenvalues (largest first) and eigenvectors that hold that share of the energy.

    A vector's sign makes its largest component positive."""
    mean, scatter, _ = covariance(points, dim)
    values, vectors = np.linalg.eigh(scatter)
    values, vectors = values[::-1], vectors[:, ::-1]
    keep = int(np.searchsorted(np.cumsum(values) / max(values.sum(), 1e-300), share) + 1)
    keep = min(keep, most or dim, dim)
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(dim)])
    return mean, values[:keep], vectors[:, :keep]


def projected(points: DataFrame, mean: np.ndarray, vectors: np.ndarray) -> DataFrame:
    """Coefficients of the centred features, as sums over literals."""
    centred = F.zip_with("features", literal(mean.tolist()), lambda a, b: a - b)
    dot = lambda v: F.aggregate(F.zip_with(F.col("c"), literal(v.tolist()), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return points.withColumn("c", centred).withColumn("features", F.array(*[dot(v) for v in vectors.T])).drop("c")


def gram(px: DataFrame) -> DataFrame:
    """(i, j, v): products of all images after their mean image is taken off; a pixel
    that an image lacks adds nothing. A task gets two blocks of images with a share
    of the pixels, as a join on the pixel would make a row for each pixel and pair of images."""
    size = px.agg(F.count_distinct("image_id"), F.count_distinct("x", "y")).first()
    blocks, shares = (max(1, -(-n // most)) for n, most in zip(size, (256, 4096), strict=True))
    mean = px.groupBy("x", "y").agg(F.avg("v").alias("__m"))
    z = px.join(mean, ["x", "y"]).select("image_id", "x", "y", (F.col("v") - F.col("__m")).alias("v"))
    code = (F.shiftleft(F.col("y").cast("long"), 32) + F.col("x")).alias("at")
    z = z.groupBy("image_id", F.pmod(F.xxhash64("x", "y"), F.lit(shares)).alias("share")).agg(F.collect_list(F.struct(code, "v")).alias("z"))
    own = F.pmod(F.xxhash64("image_id"), F.lit(blocks)).cast("int")
    z = z.select("image_id", "share", F.col("z.at").alias("at"), F.col("z.v").alias("v"), own.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    z = z.withColumn("a", F.least("own", "other")).withColumn("b", F.greatest("own", "other"))

    def products(rows: pd.DataFrame) -> pd.DataFrame:
        places = np.unique(np.concatenate(rows["at"].to_numpy()))
        x = np.zeros((len(rows), len(places)))
        for line, at, v in zip(x, rows["at"], rows["v"], strict=True):
            line[np.searchsorted(places, at)] = v
        ids, left = rows["image_id"].to_numpy(), (rows["own"] == rows["a"]).to_numpy()
        right = (rows["own"] == rows["b"]).to_numpy()
        v = x[left] @ x[right].T
        i, j = np.repeat(ids[left], right.sum()), np.tile(ids[right], left.sum())
        out = pd.DataFrame({"i": i, "j": j, "v": v.ravel()})
        if rows["a"].iloc[0] == rows["b"].iloc[0]:
            return out
        return pd.concat([out, out.rename(columns={"i": "j", "j": "i"})[["i", "j", "v"]]])

    kind = px.schema["image_id"].dataType.simpleString()
    parts = z.groupBy("a", "b", "share").applyInPandas(products, f"i {kind}, j {kind}, v double")
    return parts.groupBy("i", "j").agg(F.sum("v").alias("v"))


def square_matrix(entries: DataFrame) -> tuple[list[int], np.ndarray]:
    """Ids and matrix of a table (i, j, v), on the driver, as columns: rows of Python would take many times its room."""
    found = entries.select("i", "j", "v").toArrow()
    i, j, v = (found.column(c).to_numpy() for c in ("i", "j", "v"))
    ids = np.unique(i)
    a = np.zeros((len(ids), len(ids)))
    a[np.searchsorted(ids, i), np.searchsorted(ids, j)] = v
    return ids.tolist(), a


def energy(px: DataFrame) -> DataFrame:
    """energy, one row: of all images after their mean image is taken off. It is the sum of the variances of all modes."""
    mean = px.groupBy("x", "y").agg(F.avg("v").alias("__m"))
    return px.join(mean, ["x", "y"]).agg(F.sum((F.col("v") - F.col("__m")) * (F.col("v") - F.col("__m"))).alias("energy"))


def pixel_products(px: DataFrame) -> DataFrame:
    """(i, j, v): products of all pixels, summed over images, after the mean image is
    taken off; i <= j are places in scan order. A task sums a matrix of its images."""
    places = px.groupBy("x", "y").agg(F.avg("v").alias("__m")).orderBy("y", "x").toArrow().to_pandas()
    n = len(places)
    places["place"] = np.arange(n, dtype=np.int32)
    z = px.join(F.broadcast(px.sparkSession.createDataFrame(places)), ["x", "y"]).select("image_id", F.struct("place", (F.col("v") - F.col("__m")).alias("v")).alias("z"))
    images = z.groupBy("image_id").agg(F.collect_list("z").alias("z")).select(F.col("z.place").alias("place"), F.col("z.v").alias("v"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((n, n))
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.iloc[at : at + 256]
                x = np.zeros((len(part), n))
                for row, place, v in zip(x, part["place"], part["v"], strict=True):
                    row[place] = v
                total += x.T @ x
        for k in range(0, n, 64):  # bounded frames
            i, j = np.nonzero(np.arange(k, min(k + 64, n))[:, None] <= np.arange(n))
            yield pd.DataFrame({"i": (i + k).astype(np.int32), "j": j.astype(np.int32), "v": total[i + k, j]})

    return images.mapInPandas(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))


def mode_variances(px: DataFrame) -> np.ndarray:
    """Variances of the modes of all images, largest first, as many as images: from the
    products of images or, where there are more images than pixels, from those of
    pixels, which leave out zeros only. So the driver never holds more than the smaller matrix."""
    images = px.select("image_id").distinct().count()
    pixels = px.select("x", "y").distinct().count()
    if images <= pixels:
        _, a = square_matrix(gram(px))
    else:
        _, a = square_matrix(pixel_products(px))
        a = np.triu(a) + np.triu(a, 1).T
    values = np.maximum(np.linalg.eigvalsh(a)[::-1], 0.0)
    return np.concatenate([values, np.zeros(max(0, images - len(values)))])


def modes(products: DataFrame, steps: int = 500, eps: float = 1e-12) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Ids, variances and coefficients of the modes of the images behind a table
    of products: the largest eigenvalue by power steps, then taken off."""
    ids, a = square_matrix(products)
    values, vectors = [], []
    for k in range(len(ids)):
        v = np.cos(np.arange(1, len(ids) + 1) * (k + 1.0))
        value = 0.0
        for _ in range(steps):
            w = a @ v
            value = float(np.linalg.norm(w))
            if value < 1e-300:
                break
            w /= value
            done, v = np.abs(w - v).max() < eps, w
            if done:
                break
        values.append(float(v @ a @ v) / max(float(v @ v), 1e-300))
        vectors.append(v)
        a = a - values[-1] * np.outer(v, v) / max(float(v @ v), 1e-300)
    return ids, np.array(values), np.array(vectors).T


def orthonormalised(means: np.ndarray) -> np.ndarray:
    """Rows that span what the given ones span, of length 1 and at right angles."""
    q, r = np.linalg.qr(means.T)
    return (q * np.sign(np.where(np.diag(r) == 0, 1, np.diag(r)))).T


# ---- quality of a segmentation ----


def error_matrix(maps: DataFrame, gt: str = "gt", seg: str = "seg") -> DataFrame:
    return maps.groupBy(gt, seg).agg(F.count("*").alias("n"))


def assignment(cost: np.ndarray) -> list[int]:
    """For each row the column of a cheapest one-to-one assignment (shortest
    augmenting paths with potentials); -1 where there are fewer columns."""
    n, m = cost.shape
    if n > m:
        back = assignment(cost.T)
        out = [-1] * n
        for c, r in enumerate(back):
            if r >= 0:
                out[r] = c
        return out
    row_pot, col_pot, owner, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], j, least, used = i, 0, np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while owner[j]:
            used[j] = True
            reduced = cost[owner[j] - 1] - row_pot[owner[j]] - col_pot[1:]
            better = ~used[1:] & (reduced < least[1:])
            least[1:][better] = reduced[better]
            way[1:][better] = j
            free = np.where(used[1:], np.inf, least[1:])
            nxt = int(free.argmin()) + 1
            step = free[nxt - 1]
            row_pot[owner[used]] += step
            col_pot[used] -= step
            least[~used] -= step
            j = nxt
        while j:
            owner[j] = owner[way[j]]
            j = way[j]
    out = [-1] * n
    for j in range(1, m + 1):
        if owner[j]:
            out[owner[j] - 1] = j - 1
    return out


def first_assignment(cost: np.ndarray) -> list[int]:
    """As assignment; of several cheapest ones that which gives the first row the
    least column, then the second, and so on. (A row is left out at last.)"""
    n, m = cost.shape
    cost = cost.astype(float)
    if n > m:  # columns of no difference for the rows that are left out
        cost = np.concatenate([cost, np.full((n, n - m), cost.max(initial=0) + 1)], 1)
    worth = lambda c: sum(c[i, j] for i, j in enumerate(assignment(c)))
    best, wall = worth(cost), abs(cost).sum() + 1
    now = cost.copy()
    out = []
    for i in range(n):
        for j in range(now.shape[1]):
            if j in out:
                continue
            tried = now.copy()
            tried[i] = wall
            tried[i, j] = now[i, j]
            if abs(worth(tried) - best) <= 1e-9 * max(1.0, abs(best)):
                now = tried
                out.append(j)
                break
    return [j if j < m else -1 for j in out]


def quality(matrix: np.ndarray) -> dict[str, float]:
    """Six measures of a confusion matrix [seg, gt] under the best matching of
    segments to classes: correct share (overlaps of at least 75 % on both
    sides), omission and commission (medians over classes), and class-weighted
    accuracies. A class without a partner counts as wholly missed. Of several
    best matchings the first class has the least segment, then the second."""
    seg_n, gt_n, total = matrix.sum(1), matrix.sum(0), matrix.sum()
    of_gt = {g: s for g, s in enumerate(first_assignment((gt_n[None, :] + seg_n[:, None] - 2.0 * matrix).T)) if s >= 0}
    partner = [next((g for g, own in of_gt.items() if own == s), -1) for s in range(len(seg_n))]
    hit = np.array([matrix[of_gt[g], g] if g in of_gt else 0.0 for g in range(len(gt_n))])
    size = np.array([seg_n[of_gt[g]] if g in of_gt else 0.0 for g in range(len(gt_n))])
    share = lambda a, b: np.divide(a, b, out=np.zeros_like(a, float), where=b > 0)
    by_seg = np.array([matrix[s, g] if g >= 0 else 0.0 for s, g in enumerate(partner)])
    return {
        "CS": float(np.mean((hit >= 0.75 * gt_n) & (hit >= 0.75 * size) & (hit > 0))),
        "O": float(np.median(share(gt_n - hit, gt_n))),
        "C": float(np.median(share(seg_n - by_seg, seg_n))),
        "CA": float(np.sum(share(hit * gt_n, gt_n + size - hit)) / total),
        "CO": float(hit.sum() / total),
        "CC": float(np.sum(share(hit * gt_n, size)) / total),
    }


def on_simplex(features: Column) -> Column:
    """The nearest array with elements of at least 0 that sum to 1."""
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("k"), F.lit(-float("inf")).alias("t"))
    step = lambda a, x: F.struct((a["s"] + x).alias("s"), (a["k"] + 1).alias("k"), F.greatest(a["t"], (a["s"] + x - 1) / (a["k"] + 1)).alias("t"))
    excess = F.aggregate(F.sort_array(features, asc=False), start, step, lambda a: a["t"])
    return F.transform(features, lambda x: F.greatest(x - excess, F.lit(0.0)))


# ---- sparse matrices as (i, j, v) ----


def spmv(matrix: DataFrame, x: DataFrame) -> DataFrame:
    """Matrix times vector (i, v): join on the column, sum by row."""
    rows = matrix.withColumnRenamed("v", "a").join(x.select(F.col("i").alias("j"), F.col("v").alias("b")), "j")
    return rows.groupBy("i").agg(F.sum(F.col("a") * F.col("b")).alias("v"))


def jacobi_step(matrix: DataFrame, x: DataFrame, rhs: DataFrame) -> DataFrame:
    """x plus the residual over the diagonal."""
    diagonal = matrix.where("i = j").select("i", F.col("v").alias("d"))
    ax = spmv(matrix, x).withColumnRenamed("v", "ax")
    rows = x.join(rhs.withColumnRenamed("v", "b"), "i").join(ax, "i").join(diagonal, "i")
    return rows.select("i", (F.col("v") + (F.col("b") - F.col("ax")) / F.col("d")).alias("v"))
