"""Matrix and projection queries against brute force over the whole tables."""

import os
import re

import duckdb
import numpy as np
import pytest

from tessera.operators import grid, learning
from tessera.plans import catalogue
from tessera.plans.bindings import SIDE, features, image_count, raster

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.fixture(scope="module")
def points(spark):
    return {r["pos"]: np.array(r["features"]) for r in features(spark, DATA).collect()}


def test_covariance_of_all_components(spark, points):
    x = np.array(list(points.values()))
    x = x - x.mean(0)
    got = {(r["i"], r["j"]): r["v"] for r in catalogue.QUERIES["covariance"](spark, DATA).collect()}
    assert len(got) == x.shape[1] ** 2
    assert all(abs(got[i, j] - v) < 2e-4 for (i, j), v in np.ndenumerate(x.T @ x))


def test_simplex_of_all_components(spark, points):
    got = {pos: np.zeros(len(x)) for pos, x in points.items()}
    rows = catalogue.QUERIES["simplex_project"](spark, DATA).collect()
    assert len(rows) == sum(map(len, points.values()))
    for r in rows:
        got[r["pos"]][r["j"]] = r["u"]
    for pos, x in points.items():
        low, high = x.min() - 1, x.max()
        for _ in range(60):  # the shift by which the positive parts sum to 1
            mid = (low + high) / 2
            low, high = (mid, high) if np.maximum(x - mid, 0).sum() > 1 else (low, mid)
        assert got[pos].shape == x.shape and np.abs(got[pos] - np.maximum(x - mid, 0)).max() < 2e-6


def test_matrix_queries_of_all_images(spark):
    u = np.zeros((image_count(spark, DATA), SIDE, SIDE))
    for r in raster(spark, DATA).collect():
        u[r["image_id"], r["y"], r["x"]] = r["v"]
    ax = 5 * u
    ax[:, 1:] -= u[:, :-1]
    ax[:, :-1] -= u[:, 1:]
    ax[:, :, 1:] -= u[:, :, :-1]
    ax[:, :, :-1] -= u[:, :, 1:]
    for name, want in (("spmv_coo", ax), ("jacobi_step", u + (1 - ax) / 5)):
        got = {r["i"]: r["v"] for r in catalogue.QUERIES[name](spark, DATA).collect()}
        assert len(got) == want.size and np.abs(np.array([got[i] for i in range(want.size)]) - want.ravel()).max() < 1e-4


def test_principal_components_of_all_features(spark, points):
    keys = sorted(points)
    x = np.array([points[k] for k in keys])
    z = x - x.mean(0)
    values, vectors = np.linalg.eigh(z.T @ z)
    values, vectors = values[::-1], vectors[:, ::-1]
    got = [r["energy"] for r in catalogue.QUERIES["pca_energy"](spark, DATA).orderBy("k").collect()]
    assert np.allclose(got, values[: len(got)], atol=1e-4)
    assert values[: len(got)].sum() >= 0.8 * values.sum() > values[: len(got) - 1].sum()
    rows = {r["pos"]: np.array(r["c"]) for r in catalogue.QUERIES["pca_project"](spark, DATA).collect()}
    got = np.array([rows[k] for k in keys])
    assert np.allclose(np.abs(got), np.abs(z @ vectors[:, :4]), atol=1e-4) and np.allclose(got.T @ got, np.diag(values[:4]), atol=1e-2)


def test_restarts_against_each_start_by_itself(spark, points):
    from tessera.operators import learning as m
    from tessera.plans.learning import K

    p = features(spark, DATA)
    keys = sorted(points)
    x, best = np.array([points[k] for k in keys]), np.inf
    for seed in range(10):
        c = np.array(m.first_centers(p, K, seed))
        for _ in range(20):
            label = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
            c = np.array([x[label == k].mean(0) if (label == k).any() else np.zeros(x.shape[1]) for k in range(K)])
        best = min(best, ((x[:, None] - c[None]) ** 2).sum(2).min(1).sum())
    rows = catalogue.QUERIES["kmeans_restarts"](spark, DATA).collect()
    assert sum(r["n"] for r in rows) == len(x) and all(abs(r["residual"] ** 2 - best) < 1e-3 * best for r in rows)


def test_modes_of_the_images(spark):
    n = image_count(spark, DATA)
    u = np.zeros((n, SIDE, SIDE))
    for r in raster(spark, DATA).collect():
        u[r["image_id"], r["y"], r["x"]] = r["v"]
    z = (u - u.mean(0)).reshape(n, -1)
    want = np.linalg.eigvalsh(z @ z.T)[::-1]
    got = [r["variance"] for r in catalogue.QUERIES["image_modes"](spark, DATA).orderBy("mode").collect()]
    assert np.allclose(got, want, atol=1e-6 * want[0])


@pytest.mark.parametrize("images", [3, 40])
def test_mode_variances_of_few_and_many_images(spark, images):
    u = np.random.default_rng(2).normal(size=(images, 3, 4))
    px = spark.createDataFrame([(i, x, y, float(u[i, y, x])) for i in range(images) for y in range(3) for x in range(4)], "image_id int, x int, y int, v double")
    z = (u - u.mean(0)).reshape(images, -1)
    want = np.linalg.eigvalsh(z @ z.T)[::-1]
    assert np.allclose(learning.mode_variances(px), want, atol=1e-9 * want[0])
    assert np.isclose(learning.energy(px).first()[0], want.sum())


def test_products_of_images_stay_off_the_driver(spark, monkeypatch):
    def collected(*_):
        raise AssertionError("the products are collected")

    monkeypatch.setattr(learning, "modes", collected)
    assert catalogue.QUERIES["image_gram"](spark, DATA).count() == image_count(spark, DATA) ** 2
    monkeypatch.setattr(learning, "gram", collected)
    px = raster(spark, DATA).where("x < 1 AND y < 2")  # more images than pixels: only the pixels' products are looked at
    assert len(learning.mode_variances(px)) == image_count(spark, DATA)


def test_gram_in_blocks_of_images_and_shares_of_pixels(spark):
    u = np.random.default_rng(4).normal(size=(300, 2, 3))  # two blocks
    px = spark.createDataFrame([(i, x, y, float(u[i, y, x])) for i in range(300) for y in range(2) for x in range(3)], "image_id int, x int, y int, v double")
    z = (u - u.mean(0)).reshape(300, -1)
    rows = learning.gram(px)
    _, got = learning.square_matrix(rows)
    assert rows.count() == 300 * 300 and np.allclose(got, z @ z.T)
    big = np.random.default_rng(5).normal(size=(2, 80, 80))  # two shares
    px = spark.createDataFrame([(i, x, y, float(big[i, y, x])) for i in range(2) for y in range(80) for x in range(80)], "image_id int, x int, y int, v double")
    z = (big - big.mean(0)).reshape(2, -1)
    assert np.allclose(learning.square_matrix(learning.gram(px))[1], z @ z.T)


def test_paths_of_large_keys_and_nulls(spark, tmp_path):
    at = str(tmp_path)
    spark.createDataFrame([(7, "F"), (999_999, "O"), (1_000_000, "O"), (8_999_998, "F"), (8_999_999, None), (10, None)], "o_orderkey long, o_orderstatus string").write.parquet(f"{at}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{at}/orders.parquet/*.parquet'")
    columns = "pos, path, is_png, base, dir"
    want = con.execute(f"SELECT {columns} FROM ({catalogue.ORACLE_SQL['string_helpers']}) ORDER BY pos").fetchall()
    assert [tuple(r) for r in catalogue.QUERIES["string_helpers"](spark, at).select(*columns.split(", ")).orderBy("pos").collect()] == want


def test_component_neighbours_sends_no_table_of_pixels_whole(spark, monkeypatch):
    """Written tables are small as files; what is made from them, with a row or more for each pixel or component, must not be broadcast."""
    plans, write = [], grid.checkpointed
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()

    def watched(df, previous=None):
        plans.append(plan(df))
        return write(df, previous)

    monkeypatch.setattr(grid, "checkpointed", watched)
    found = catalogue.QUERIES["component_neighbours"](spark, DATA)
    rows = {tuple(r) for r in found.collect()}
    assert rows and rows == {(image, near, label, d2) for image, label, near, d2 in rows}
    assert len(plans) > 1 and "BroadcastHashJoin" not in plan(found)
    assert not [p for p in plans[1:] if re.search(r"Broadcast\w*Join \[image_id#\d+, x#\d+, y#\d+\]", p)]  # the first reads the raster
