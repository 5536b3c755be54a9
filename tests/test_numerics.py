"""Solvers, searches and fits against known answers."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import scalar
from tessera.operators import learning as m
from tessera.operators import numerics as nu
from tessera.operators import spectral as sp
from tessera.operators import volume as vol


def test_dense_solvers_on_a_known_system():
    a = np.array([[float(i) ** j for j in range(6)] for i in range(6)])
    b = np.sin(np.arange(6.0))
    known = [0, 0.885486, 0.267195, -0.391936, 0.086137, -0.005411]
    assert np.allclose(nu.lu_solve(a, b), known, atol=1e-4) and np.allclose(nu.qr_least_squares(a, b), known, atol=1e-4)
    with pytest.raises(ValueError):
        nu.lu_solve(np.zeros((2, 2)), np.ones(2))
    rng = np.random.default_rng(0)
    a = np.eye(30) * 8 + rng.normal(size=(30, 30))
    b = rng.normal(size=30)
    x = np.linalg.solve(a, b)
    assert np.allclose(nu.gmres(a.__matmul__, b, 10), x) and np.allclose(nu.bicgstab(a.__matmul__, b), x) and np.allclose(nu.gauss_seidel(a, b, 200), x)


def test_complementarity_against_all_active_sets():
    rng = np.random.default_rng(1)
    for _ in range(10):
        q = rng.normal(size=(4, 4))
        a, b = q @ q.T + np.eye(4), rng.normal(size=4)
        x = nu.projected_gauss_seidel(a, b, 2000)
        for active in itertools.product([False, True], repeat=4):
            on = np.array(active)
            y = np.zeros(4)
            if on.any():
                y[on] = np.linalg.solve(a[np.ix_(on, on)], b[on])
            if (y >= -1e-12).all() and (a @ y - b >= -1e-9).all():
                assert np.allclose(x, y, atol=1e-6)
                break
        else:
            raise AssertionError


def test_searches_and_time_steps():
    assert nu.bisection(math.cos, 0, 3) == pytest.approx(math.pi / 2)
    with pytest.raises(ValueError):
        nu.bisection(lambda x: 1 + x * x, 0, 1)
    assert nu.golden_section(lambda x: abs(x - 0.3), -1, 2) == pytest.approx(0.3, abs=1e-6)
    assert nu.rkf45(lambda t, u: 100 / (1 + 1e4 * t * t), -1, math.atan(-100), 1) == pytest.approx(math.atan(100), abs=1e-6)
    assert nu.rkf45(lambda t, u: u, 0, 1, 2) == pytest.approx(math.exp(2), rel=1e-8)
    p = nu.polynomial_fit
    assert callable(p) and nu.interpolating_polynomial([0, 1, 2], [1, 2, 5]) == pytest.approx([1, 0, 1])


def test_a_power_law_by_damped_steps(spark):
    x = np.linspace(0.5, 4, 60)
    df = spark.createDataFrame([(float(a), float(2.5 * a**1.7)) for a in x], "x double, y double")
    model = lambda c: c[0] * F.pow("x", c[1])
    slopes = lambda c: [F.pow("x", c[1]), c[0] * F.pow("x", c[1]) * F.log("x")]
    assert np.allclose(nu.levenberg_marquardt(df, model, slopes, [1.0, 1.0]), [2.5, 1.7])
    assert np.allclose(nu.polynomial_fit(spark.createDataFrame([(float(a), float(1 - 2 * a + 3 * a**3)) for a in x], "x double, y double"), 3), [1, -2, 0, 3])


def test_conjugate_gradient_on_a_table(spark):
    rng = np.random.default_rng(2)
    q = rng.normal(size=(12, 12))
    a, b = q @ q.T + 12 * np.eye(12), rng.normal(size=12)
    matrix = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(12) for j in range(12)], "i long, j long, v double")
    rhs = spark.createDataFrame([(i, float(x)) for i, x in enumerate(b)], "i long, v double")
    for preconditioned in (False, True):
        x, residual, steps = nu.conjugate_gradient(matrix, rhs, preconditioned=preconditioned)
        assert np.allclose([r["v"] for r in x.orderBy("i").collect()], np.linalg.solve(a, b)) and residual < 1e-8 and steps <= 15


def test_inverse_distributions(spark):
    df = spark.createDataFrame([(k / 200,) for k in range(201)], "p double")
    rows = df.select("p", scalar.normal_inverse(F.col("p")).alias("z"), scalar.normal_cdf(scalar.normal_inverse(F.col("p"))).alias("back"), scalar.poisson_inverse(F.col("p"), 3.0).alias("k")).collect()
    sums = list(itertools.accumulate(math.exp(-3) * 3**k / math.factorial(k) for k in range(60)))
    for row in rows:
        if 0 < row["p"] < 1:
            assert abs(row["back"] - row["p"]) < 1e-8 and row["k"] == next(k for k, s in enumerate(sums) if s >= row["p"] - 1e-15)
    assert rows[0]["z"] is None and rows[-1]["z"] is None


def test_draws_are_in_proportion_to_squared_distance(spark):
    rows = [(0, [0.0])] + [(k, [1.0]) for k in range(1, 40)] + [(k, [3.0]) for k in range(40, 60)]
    df = spark.createDataFrame(rows, "pos long, features array<double>")
    far = sum(sorted(c[0] for c in m.drawn_centers(df, 2, seed))[1] == 3.0 for seed in range(0, 40, 2))
    assert far >= 13  # nearly all: 20 points at distance 9 (or 4) against 39 at 1
    with pytest.raises(ValueError):
        m.drawn_centers(df.where("pos < 2"), 3)


def test_pmeans_finds_the_number_of_clusters(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.3, (60, 2)) for c in ((0, 0), (6, 0), (0, 6))])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "pos long, features array<double>")
    found, choice = m.pmeans(df, 2, 5)
    assert choice == {"least": 3, "significant": 3} and len(found) == 5


def test_modes_against_eigenvalues(spark):
    rng = np.random.default_rng(4)
    u = rng.normal(size=(5, 6, 7))
    px = spark.createDataFrame([(k, x, y, float(u[k, y, x])) for k in range(5) for y in range(6) for x in range(7)], "image_id int, x int, y int, v double")
    z = (u - u.mean(0)).reshape(5, -1)
    _, values, _ = m.modes(m.gram(px))
    assert np.allclose(values, np.linalg.eigvalsh(z @ z.T)[::-1], atol=1e-4)


def test_transforms_keep_energy_and_come_back():
    u = np.random.default_rng(5).normal(size=(16, 8))
    for there, back in ((sp.dct, sp.inverse_dct), (lambda x: sp.haar(x, 3), lambda x: sp.inverse_haar(x, 3))):
        assert np.isclose((there(u) ** 2).sum(), (u**2).sum()) and np.allclose(back(there(u)), u)
    with pytest.raises(ValueError):
        sp.haar(u, 4)
    kernel = [(1, 0, 0.5), (0, -1, 0.25), (0, 0, 1.0)]
    want = u + 0.5 * np.roll(u, 1, 1) + 0.25 * np.roll(u, -1, 0)
    assert np.allclose(sp.circular_convolution(u, kernel), want)
    v = sp.heat_step(u, 2.0)
    lap = np.zeros_like(v)
    for axis in (0, 1):
        d = np.diff(v, axis=axis)
        pad = [(0, 0), (0, 0)]
        pad[axis] = (0, 1)
        lap += np.pad(d, pad)
        pad[axis] = (1, 0)
        lap -= np.pad(d, pad)
    assert np.allclose(v - 2.0 * lap, u)


def test_components_of_a_volume_against_flood_fill(spark):
    mask = np.random.default_rng(6).random((5, 6, 7)) < 0.25
    rows = [(0, x, y, z, bool(mask[z, y, x]), 7, 6, 5) for z in range(5) for y in range(6) for x in range(7)]
    df = spark.createDataFrame(rows, "image_id int, x int, y int, z int, m boolean, nx int, ny int, nz int")
    for neighbours in (6, 26):
        got = {(r["z"], r["y"], r["x"]): r["label"] for r in vol.labelled(df, neighbours).collect()}
        want, n = {}, 0
        for at in zip(*np.nonzero(mask), strict=True):
            if at in want:
                continue
            n += 1
            todo = [at]
            while todo:
                c = todo.pop()
                if c in want or min(c) < 0 or any(a >= b for a, b in zip(c, mask.shape, strict=True)) or not mask[c]:
                    continue
                want[c] = n
                todo += [tuple(a + b for a, b in zip(c, s, strict=True)) for s in itertools.product((-1, 0, 1), repeat=3) if neighbours == 26 or sum(map(abs, s)) == 1]
        assert got == {tuple(map(int, k)): v for k, v in want.items()}
