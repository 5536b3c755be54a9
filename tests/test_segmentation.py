"""Segmentation of images whose segments are known."""

import numpy as np

from tessera.operators import segmentation as sg


def stripes(n=48):
    """Vertical stripes on the left, horizontal ones on the right, with a little noise."""
    y, x = np.mgrid[:n, :n]
    u = np.where(x < n // 2, np.sin(2 * np.pi * x / 4), np.sin(2 * np.pi * y / 4))
    return u + np.random.default_rng(0).normal(0, 0.05, u.shape), (x >= n // 2).astype(int)


def agreement(labels, truth):
    return max((labels == truth).mean(), (labels == 1 - truth).mean())


def test_textures_by_histograms():
    u, truth = stripes()
    for more in ({}, {"force_multi_phase": True, "ghost_cells": 3}, {"seeds": [(8, 24), (40, 24)]}, {"force_multi_phase": True, "orthonormal": True}):
        labels = sg.segmented(u, sg.texture_options(2, (11, 7), restarts=5, gamma=0.001, **more))
        assert labels.shape == u.shape and agreement(labels, truth) > 0.9, more
    coarse = sg.segmented(np.repeat(np.repeat(u, 2, 0), 2, 1), sg.texture_options(2, (11, 7), restarts=5, gamma=0.001, resample=2))
    assert agreement(coarse, np.repeat(np.repeat(truth, 2, 0), 2, 1)) > 0.9


def test_periodic_patterns_and_the_number_of_segments():
    u, truth = stripes()
    labels = sg.segmented(u, sg.periodic_options(9, 2, restarts=5, gamma=0.001))
    assert agreement(labels, truth) > 0.9  # the margin too, from the nearest pixel that was segmented
    x = np.zeros((6, 200))
    x[0, :100], x[1, 100:] = 1, 1
    assert len(sg.reduced(x, 0, 0.05)) == 1 and len(sg.reduced(x, 3, 0.05)) == 3


def test_kernels_and_local_histograms():
    u = np.random.default_rng(1).normal(size=(9, 10))
    h = sg.local_histogram(u, sg.gaussian(3, 1.0), 5, 4)
    assert h.shape == (4, 9, 10) and np.allclose(h.sum(0), 1)
    assert np.allclose(sg.local_histogram(np.ones((5, 5)), np.ones((1, 1)), 3, 4)[0], 1)
    wide = np.pad(u, 2, "edge")
    assert np.allclose(sg.box_sums(u, 5), [[wide[y : y + 5, x : x + 5].sum() for x in range(10)] for y in range(9)])
    g = sg.gabor(7, 0.3)
    s, (y, x) = 1.5, (-2, 3)
    assert np.isclose(g[3 + y, 3 + x], np.exp(-(x * x + y * y) / (2 * s * s)) * np.cos(np.pi / s * (y * np.cos(0.3) + x * np.sin(0.3))) / (2 * np.pi * s * s))


def test_segment_over_a_table(spark):
    u, truth = stripes(32)
    rows = [(k, x, y, float(u[y, x] if k == 0 else u[x, y])) for k in (0, 1) for y in range(32) for x in range(32)]
    out = sg.segment(spark.createDataFrame(rows, "image_id int, x int, y int, v double"), sg.texture_options(2, (11, 7), restarts=5, gamma=0.001))
    got = np.zeros((2, 32, 32), int)
    for r in out.collect():
        got[r["image_id"], r["y"], r["x"]] = r["label"]
    assert agreement(got[0], truth) > 0.85 and agreement(got[1], truth.T) > 0.85
