"""Invariants and brute-force twins of the operators."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import color
from tessera.operators import grid as g
from tessera.operators import learning as m
from tessera.operators import ordering as o
from tessera.operators import variational as va
from tessera.operators import vector as v


def frame(spark, image, image_id=0):
    ny, nx = image.shape
    rows = [(image_id, x, y, float(image[y, x]), nx, ny) for y in range(ny) for x in range(nx)]
    return spark.createDataFrame(rows, "image_id int, x int, y int, v double, nx int, ny int")


def image(px, shape):
    out = np.full(shape, np.nan)
    for r in px.collect():
        out[r["y"], r["x"]] = r["v"]
    return out


@pytest.fixture(scope="module")
def small():
    return np.random.default_rng(0).integers(0, 9, (6, 7)).astype(float)


@pytest.mark.parametrize("rule, mode", [("reflect", "reflect"), ("clip", "edge"), ("periodic", "wrap"), ("zero", "constant")])
def test_correlation_against_numpy(spark, small, rule, mode):
    rng = np.random.default_rng(1)
    w = rng.normal(size=(3, 5))
    kernel = [(a - 2, b - 1, w[b, a]) for b in range(3) for a in range(5)]
    pad = np.pad(small, ((1, 1), (2, 2)), mode)
    want = sum(w[b, a] * pad[b : b + 6, a : a + 7] for b in range(3) for a in range(5))
    assert np.allclose(image(g.correlate(frame(spark, small), kernel, rule), small.shape), want)


def test_geometry_round_trips(spark, small):
    px = frame(spark, small)
    assert np.array_equal(image(g.flip(g.flip(px, "x"), "x"), small.shape), small)
    four = px
    for _ in range(4):
        four = g.rotate90(four)
    assert np.array_equal(image(four, small.shape), small)
    assert np.array_equal(image(g.shift_periodic(g.shift_periodic(px, 3, 2), -3, -2), small.shape), small)
    back = g.crop(g.pad(px, 11, 10, 0.0), 2, 2, 7, 6)
    assert np.array_equal(image(back, small.shape), small)


def test_divergence_is_minus_the_adjoint(spark):
    rng = np.random.default_rng(2)
    u, p = rng.normal(size=(5, 6)), rng.normal(size=(2, 5, 6))
    assert np.isclose((va.gradient(u) * p).sum(), -(u * va.divergence(p)).sum())
    grad = g.gradient_forward(frame(spark, u))
    got = np.zeros((2, 5, 6))
    for r in grad.collect():
        got[:, r["y"], r["x"]] = r["gx"], r["gy"]
    assert np.allclose(got, va.gradient(u))
    assert np.allclose(image(g.divergence_backward(grad), u.shape), va.divergence(va.gradient(u)))


def test_local_histogram_sums_to_one_and_survives_a_constant(spark, small):
    for im in (small, np.ones((4, 5))):
        total = g.local_histogram(frame(spark, im), 3, 4).groupBy("x", "y").agg(F.sum("share").alias("s")).collect()
        assert len(total) == im.size and all(abs(r["s"] - 1) < 1e-9 for r in total)


def test_components_against_flood_fill(spark):
    mask = np.random.default_rng(3).random((12, 13)) < 0.4
    px = frame(spark, mask).withColumn("m", F.col("v") > 0)
    got = {(r["y"], r["x"]): r["label"] for r in g.labelled(px).collect()}
    want, n = {}, 0
    for y, x in zip(*np.nonzero(mask), strict=True):
        if (y, x) in want:
            continue
        n += 1
        todo = [(y, x)]
        while todo:
            c = todo.pop()
            if c in want or not mask[c]:
                continue
            want[c] = n
            todo += [(a, b) for a in range(max(0, c[0] - 1), min(12, c[0] + 2)) for b in range(max(0, c[1] - 1), min(13, c[1] + 2))]
    assert got == {(int(a), int(b)): k for (a, b), k in want.items()}


def test_order_statistics(spark):
    rng = np.random.default_rng(4)
    x, w = rng.integers(0, 30, 501).astype(float), rng.integers(1, 5, 501).astype(float)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, w, strict=True))], "pos long, v double, w double")
    ranked = o.with_rank(df, "v").orderBy("rank").collect()
    assert [r["rank"] for r in ranked] == list(range(1, 502)) and [r["v"] for r in ranked] == sorted(x)
    assert o.median(df).first()[0] == np.median(x)
    order = np.argsort(x, kind="stable")
    cum = np.cumsum(w[order])
    assert o.weighted_median(df).first()[0] == pytest.approx(x[order][np.searchsorted(cum, w.sum() / 2)])


def test_variance_of_one_value_is_zero(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 1.0), (2, 3.0)], "k int, v double")
    got = {r["k"]: r["s"] for r in df.groupBy("k").agg(v.variance(F.col("v")).alias("s")).collect()}
    assert got == {1: 0.0, 2: 2.0}


def test_resampling_keeps_the_ends(spark):
    df = spark.createDataFrame([(i, float(i * i)) for i in range(7)], "pos long, v double")
    for n in (2, 5, 7, 23):
        got = {r["pos"]: r["v"] for r in v.resample_linear(df, 7, n).collect()}
        assert [round(got[i], 9) for i in range(n)] == [round(x, 9) for x in np.interp(np.linspace(0, 6, n), range(7), [i * i for i in range(7)])]


def test_assignment_against_all_permutations():
    rng = np.random.default_rng(5)
    for n, k in itertools.product(range(1, 6), range(1, 6)):
        cost = rng.integers(0, 20, (n, k)).astype(float)
        got = m.assignment(cost)
        used = [c for c in got if c >= 0]
        assert len(used) == len(set(used)) == min(n, k)
        total = sum(cost[i, c] for i, c in enumerate(got) if c >= 0)
        small, big = (cost, cost.T)[n > k], max(n, k)
        assert total == min(sum(small[i, p[i]] for i in range(min(n, k))) for p in itertools.permutations(range(big), min(n, k)))


def test_of_several_best_matchings_the_first_class_gets_the_least_segment():
    rng = np.random.default_rng(15)
    for n, k in itertools.product(range(1, 5), range(1, 5)):
        for _ in range(5):
            cost = rng.integers(0, 3, (n, k)).astype(float)
            worth = lambda p: sum(cost[i, j] for i, j in enumerate(p) if j < k)  # noqa: B023, E731
            tried = [p for p in itertools.permutations(range(max(n, k)), n) if sum(j < k for j in p) == min(n, k)]
            best = min(worth(p) for p in tried)
            assert m.first_assignment(cost) == [j if j < k else -1 for j in min(p for p in tried if worth(p) == best)]
    # two matchings overlap in as many rows, and differ in what they commit
    tied = np.array([[10, 30, 0], [30, 10, 0], [0, 5, 40.0]])
    tied[0, 0] = tied[1, 1] = 30
    assert m.first_assignment((tied.sum(0)[None] + tied.sum(1)[:, None] - 2 * tied).T) == [0, 1, 2]


def test_vectors_of_different_length_are_an_error(spark):
    a = spark.createDataFrame([(i, float(i)) for i in range(5)], "pos long, v double")
    b = spark.createDataFrame([(i, 2.0 * i) for i in range(5)], "pos long, u double")
    assert v.zipped(a, b).agg(F.sum(F.col("v") * F.col("u"))).first()[0] == 60
    for x, y in ((a.where("pos < 4"), b), (a, b.where("pos < 4"))):
        with pytest.raises(Exception, match="different length"):
            v.zipped(x, y).agg(F.sum(F.col("v") * F.col("u"))).collect()


def test_order_statistics_of_a_frequent_value(spark):
    rng = np.random.default_rng(16)
    for n in (1, 2, 7, 400):
        x = np.where(rng.random(n) < 0.6, 3.0, rng.integers(0, 9, n))
        w = rng.integers(1, 4, n).astype(float)
        df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, w, strict=True))], "pos long, v double, w double")
        assert o.median(df).first()[0] == np.median(x)
        order = np.lexsort((np.arange(n), x))
        cum, half = np.cumsum(w[order]), w.sum() / 2
        hit = [k for k in range(n) if cum[k] - w[order][k] <= half <= cum[k]]
        assert o.weighted_median(df).first()[0] == pytest.approx(np.average(x[order][hit], weights=w[order][hit]))
        low, high = o.saturated_extent(df, 10.0).first()
        assert (low, high) == (np.sort(x)[int(0.05 * (n - 1))], np.sort(x)[int(0.95 * (n - 1))])


def test_perfect_segmentation():
    q = m.quality(np.array([[0, 5.0], [7.0, 0]]))
    assert q == {"CS": 1.0, "O": 0.0, "C": 0.0, "CA": 1.0, "CO": 1.0, "CC": 1.0}


def test_kmeans_lowers_the_residual(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(c, 0.2, (40, 3)) for c in (0, 3, 6)])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "pos long, features array<double>")
    start = m.farthest_centers(df, 3)
    before = m.lloyd_round(df, [start])[1][0]
    centers, residual, _ = m.kmeans(df, start)
    assert residual**2 <= before and sorted(round(c[0]) for c in centers) == [0, 3, 6]
    for method in ("random", "farthest", "drawn"):
        assert len(m.initial_centers(df, 3, method)) == 3
    assert m.initial_centers(df, 1, "given", given=[[1.0, 2, 3]]) == [[1.0, 2, 3]]
    for method, error in (("given", ValueError), ("components", NotImplementedError)):
        with pytest.raises(error):
            m.initial_centers(df, 3, method)
    _, values, vectors = m.principal_components(df, 3, 1.0)
    c = x - x.mean(0)
    assert np.allclose(values, np.linalg.eigvalsh(c.T @ c)[::-1]) and np.allclose(vectors.T @ vectors, np.eye(3))


def test_simplex_and_denoising():
    u = np.random.default_rng(7).normal(size=(4, 3, 5))
    p = va.to_simplex(u)
    assert np.allclose(p.sum(0), 1) and (p >= 0).all() and np.allclose(va.to_simplex(p), p)
    step = np.zeros((16, 16))
    step[:, 8:] = 1
    noisy = step + np.random.default_rng(8).normal(0, 0.1, step.shape)
    assert np.abs(va.tv_denoise(noisy, 0.1) - step).mean() < np.abs(noisy - step).mean()
    energy = lambda u, w: ((u - noisy) ** 2).sum() / 2 + w * np.sqrt((va.gradient(u) ** 2).sum(0)).sum()
    for w in (0.05, 1.0, 2.0, 8.0):  # any weight: no constant and no other result has less energy
        u = va.tv_denoise(noisy, w, 3000, 0.0)
        assert energy(u, w) <= min(energy(np.full_like(noisy, noisy.mean()), w), energy(noisy, w)) * (1 + 1e-4)
        assert all(energy(u, w) <= energy(u + 0.01 * np.random.default_rng(k).normal(size=u.shape), w) for k in range(3))
    assert np.allclose(va.fixed_point_denoise(noisy, 0.3, 6000), va.tv_denoise(noisy, 0.3, 6000, 0.0), atol=2e-3)
    smooth, edge = va.smoothed_with_edges(noisy)
    assert va.edge_energy(smooth, edge, noisy, 4.0, 0.05, 1.0) < va.edge_energy(noisy, np.ones_like(noisy), noisy, 4.0, 0.05, 1.0)
    assert edge[:, 7].mean() < 0.6 * edge[:, 2].mean()
    walk = va.curve_order(np.array([[0, 0], [9, 0], [1, 0], [2, 0.0], [0, 0]]))
    assert walk.tolist() == [0, 4, 2, 3, 1]
    hard, means = va.two_phase_segment(noisy[None], np.array([[0.2], [0.8]]), 0.25)
    assert (hard == step).mean() > 0.99 and abs(means[1, 0] - 1) < 0.15
    labels, _ = va.piecewise_constant(noisy[None], np.array([[0.2], [0.8]]), 4.0)
    assert (labels == step).mean() > 0.99
    assert (va.piecewise_constant(np.ones((1, 4, 4)), np.array([[1.0], [2.0]]), 4.0)[0] == 0).all()


def test_spectra():
    row = np.random.default_rng(9).normal(size=16)
    assert np.allclose((np.abs(va.stockwell(row)) ** 2).sum() + 0, (row**2).sum(), rtol=0.2)
    a = np.random.default_rng(10).normal(size=(8, 8))
    peak = va.phase_correlation(np.roll(a, (2, 3), (0, 1)), a)
    assert np.unravel_index(peak.argmax(), peak.shape) == (2, 3)


def test_color_round_trip(spark):
    rows = [(a / 4, b / 4, c / 4) for a in range(5) for b in range(5) for c in range(5)]
    df = spark.createDataFrame(rows, "r double, g double, b double")
    back = color.hsv_to_rgb(*color.rgb_to_hsv(F.col("r"), F.col("g"), F.col("b")))
    for r in df.select("r", "g", "b", *[c.alias(n) for c, n in zip(back, "xyz", strict=True)]).collect():
        assert np.allclose(r[:3], r[3:])


def test_scalar_functions(spark):
    import math

    from tessera.functions import scalar

    xs = [-3.0, -0.5, 0.0, 0.3, 1.0, 2.5]
    df = spark.createDataFrame([(x, int(abs(x) * 4)) for x in xs], "x double, k int")
    x = F.col("x")
    rows = df.select("x", "k", scalar.erf(x).alias("erf"), scalar.normal_cdf(x, 0.5, 2.0).alias("cdf"), scalar.polynomial(x, (1, 2, 3)).alias("p"), scalar.poisson_pmf(F.col("k"), 3.0).alias("pmf"),
                     scalar.heaviside(x, 1.0, "polynomial2").alias("h"), scalar.smooth_max(x, F.lit(0.0), 0.0).alias("m"), scalar.signum(x, 1.0).alias("s")).collect()
    for r in rows:
        assert abs(r["erf"] - math.erf(r["x"])) < 1e-12
        assert abs(r["cdf"] - 0.5 * (1 + math.erf((r["x"] - 0.5) / (2 * math.sqrt(2))))) < 1e-6
        assert abs(r["p"] - (1 + 2 * r["x"] + 3 * r["x"] ** 2)) < 1e-12
        assert abs(r["pmf"] - math.exp(-3) * 3 ** r["k"] / math.factorial(r["k"])) < 1e-12
        assert r["m"] == max(r["x"], 0) and r["s"] == (1 if r["x"] >= 0 else -1)
        assert 0 <= r["h"] <= 1
