"""Unsupervised segmentation of images by local features.

An image goes through filters, whose local histograms (or the moduli of its
local spectra) are the features of each pixel; principal components with the
energy asked for; clusters of the pixels that lie off edges, whose means start
a piecewise constant Mumford-Shah minimisation; and the label of the greatest
share. Images are independent, and each is one task."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import variational as va

Feature = Callable[[np.ndarray], np.ndarray]  # image -> [component, y, x]


# ---- kernels, [y, x] with their origin in the middle ----


def _grid(size: int) -> tuple[np.ndarray, np.ndarray]:
    o = size // 2
    return np.mgrid[-o : o + 1, -o : o + 1].astype(float)


def gaussian(size: int, sigma: float) -> np.ndarray:
    y, x = _grid(size)
    k = np.exp(-(x * x + y * y) / (2 * sigma * sigma))
    return k / k.sum()


def laplacian_of_gaussian(size: int, sigma: float) -> np.ndarray:
    y, x = _grid(size)
    return gaussian(size, sigma) * (1 - (x * x + y * y) / (2 * sigma * sigma)) * -1 / (np.pi * sigma**4)


def gabor(size: int, theta: float) -> np.ndarray:
    """Width and frequency follow from the size; the wave runs along theta, counted from the y axis."""
    y, x = _grid(size)
    s = size // 2 / 2
    along = y * np.cos(theta) + x * np.sin(theta)
    return np.exp(-(x * x + y * y) / (2 * s * s)) * np.cos(np.pi / s * along) / (2 * np.pi * s * s)


def correlated(image: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Weighted sums around every pixel, mirrored at the border (which isn't repeated)."""
    r = kernel.shape[0] // 2
    blocks = np.lib.stride_tricks.sliding_window_view(np.pad(image, r, "reflect"), kernel.shape)
    return np.einsum("yxij,ij->yx", blocks, kernel)


# ---- features ----


def box_sums(a: np.ndarray, scale: int) -> np.ndarray:
    """Sums over the square around every pixel, border pixels repeated."""
    r = (scale - 1) // 2
    for axis in (0, 1):
        wide = np.pad(a, [(r + 1, r) if k == axis else (0, 0) for k in range(2)], "edge").cumsum(axis)
        n = a.shape[axis]
        lead = [slice(None)] * 2
        back = [slice(None)] * 2
        lead[axis], back[axis] = slice(2 * r + 1, 2 * r + 1 + n), slice(0, n)
        a = wide[tuple(lead)] - wide[tuple(back)]
    return a


def local_histogram(image: np.ndarray, kernel: np.ndarray, scale: int, bins: int) -> np.ndarray:
    """Shares of the bins of a filter's response in the square around each pixel."""
    v = correlated(image, kernel)
    low, span = v.min(), v.max() - v.min()
    at = np.minimum(((v - low) * bins / span).astype(int), bins - 1) if span else np.zeros(v.shape, int)
    return np.stack([box_sums((at == b).astype(float), scale) for b in range(bins)]) / scale**2


def histogram_features(kernels: Sequence[np.ndarray], scale: int, bins: int = 11) -> Feature:
    return lambda image: np.concatenate([local_histogram(image, k, scale, bins) for k in kernels])


def spectrum_features(size: int) -> Feature:
    return lambda image: va.fft_modulus(image, size).transpose(2, 0, 1)


@dataclass
class Options:
    features: Sequence[Feature]
    weights: Sequence[float] = ()  # of the features; those that lack are 1; all are scaled to sum to 1
    dominant: int = 1  # features that the first clusters are found on
    segments: int = 0  # 0: as many as principal components
    components: int = 0  # 0: as many as segments; if that is 0 too, as many as leave less than omega a pixel
    omega: float = 0.05
    scale: int = 21  # of the edge indicator, and of the margin that is left out
    margin: bool = True  # whether pixels near the border are segmented, or get the label of the nearest that is
    edgeness: float = 0.5  # of its mean, below which a pixel's edge indicator must be
    seeds: Sequence[tuple[int, int]] = ()  # x, y of a pixel of each segment
    ghost_cells: int = 0
    gamma: float = 1e-4  # weight of boundaries, per pixel width
    outer: int = 3
    most: int = 10_000
    eps: float = 1e-3
    restarts: int = 1000
    force_multi_phase: bool = False
    resample: int = 1  # every so many pixels a side
    orthonormal: bool = False  # means are made orthonormal before labels are sought


# ---- stages ----


def assembled(image: np.ndarray, o: Options) -> tuple[np.ndarray, int]:
    """[component, y, x] of all features by weight, and how many are dominant."""
    w = np.array([*o.weights, *[1.0] * (len(o.features) - len(o.weights))])
    w = w / w.sum()
    parts = [f(image) * k for f, k in zip(o.features, w, strict=True)]
    return np.concatenate(parts), sum(len(p) for p in parts[: o.dominant])


def reduced(x: np.ndarray, components: int, omega: float) -> np.ndarray:
    """[component, pixel] of centred features on their first eigenvectors: as
    many as asked for, or the fewest that leave less than omega a pixel."""
    z = x - x.mean(1, keepdims=True)
    values, vectors = np.linalg.eigh(z @ z.T)
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
    if not components:
        left = values.sum() - np.cumsum(values)
        components = int(np.argmax(left < omega * x.shape[1])) + 1
    vectors = vectors[:, :components]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    return vectors.T @ z


def off_edges(x: np.ndarray, scale: int, threshold: float) -> np.ndarray:
    """Which pixels of [component, y, x] have an edge indicator above 0 and below threshold times its mean."""
    h = (scale - 1) // 2
    ny, nx = x.shape[1:]
    e = np.full((ny, nx), -1.0)
    if ny > 2 * h and nx > 2 * h:
        across = ((x[:, h : ny - h, 2 * h :] - x[:, h : ny - h, : nx - 2 * h]) ** 2).sum(0)
        down = ((x[:, 2 * h :, h : nx - h] - x[:, : ny - 2 * h, h : nx - h]) ** 2).sum(0)
        e[h : ny - h, h : nx - h] = across + down
    valid = e >= 0
    mean = e[valid].mean() if valid.any() else 0.0
    return (e > 0) & (e < threshold * mean)


def best_clusters(x: np.ndarray, k: int, restarts: int, seed: int = 0, rounds: int = 100) -> np.ndarray:
    """Labels of the rows of x by the best of many Lloyd runs from random rows."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    best, label = np.inf, np.zeros(len(x), int)
    for _ in range(restarts):
        c = x[rng.choice(len(x), k, replace=False)]
        for _ in range(rounds):
            d = ((x[:, None] - c[None]) ** 2).sum(2)
            own = d.argmin(1)
            new = np.stack([x[own == j].mean(0) if (own == j).any() else np.zeros(x.shape[1]) for j in range(k)])
            moved = np.sqrt(((new - c) ** 2).sum())
            c = new
            if moved <= 1e-3:
                break
        cost = ((x - c[own]) ** 2).sum()
        if cost < best - 1e-12:
            best, label = cost, own
    return label


def orthonormal_means(x: np.ndarray, means: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features and means in coordinates in which the means are the unit vectors (as far as there are components)."""
    inverse = np.linalg.pinv(means.T)
    return np.einsum("kc,cyx->kyx", inverse, x), np.eye(len(means))


def minimised(x: np.ndarray, means: np.ndarray, o: Options) -> np.ndarray:
    """Hard labels of [component, y, x] from starting means."""
    weight = 1 / (o.gamma * (max(x.shape[1:]) - 1))  # boundaries are measured in pixel widths
    if len(means) == 2 and not o.force_multi_phase:
        return va.two_phase_segment(x, means, 1 / weight, o.outer, o.most, o.eps)[0]
    g, u = o.ghost_cells, None
    for _ in range(o.outer):
        ind = va.indicators(x, means)
        if g:  # beyond the border every label is as good: the boundary may leave the image anywhere
            ind = np.pad(ind, ((0, 0), (g, g), (g, g)))
        start = None if u is None else np.pad(u, ((0, 0), (g, g), (g, g)))
        u = va.multiphase(ind, weight, o.most, o.eps, start)
        u = u[:, g : u.shape[1] - g, g : u.shape[2] - g]
        means = va.weighted_means(x, u, means)
    return va.hard_labels(u)


def segmented(image: np.ndarray, o: Options) -> np.ndarray:
    """A label from 0 for every pixel."""
    ny, nx = image.shape
    small = image[:: o.resample, :: o.resample]
    features, dominant = assembled(small, o)
    h = 0 if o.margin else (o.scale - 1) // 2
    features = features[:, h : features.shape[1] - h, h : features.shape[2] - h]
    shape = features.shape[1:]
    flat = features.reshape(len(features), -1)
    segments = o.segments
    if o.seeds:
        at = [(y // o.resample - h) * shape[1] + x // o.resample - h for x, y in o.seeds]
        segments, own = len(at), np.array(at)
    else:
        first = reduced(flat[:dominant], o.components or segments, o.omega)
        segments = segments or len(first)
        keep = off_edges(first.reshape(-1, *shape), o.scale, o.edgeness).ravel()
        if keep.sum() < segments:
            keep[:] = True
        label = np.full(flat.shape[1], -1)
        label[keep] = best_clusters(first[:, keep].T, segments, o.restarts)
    low = reduced(flat, o.components or segments, o.omega)
    means = low[:, own].T if o.seeds else np.stack([low[:, label == k].mean(1) if (label == k).any() else np.zeros(len(low)) for k in range(segments)])
    x = low.reshape(-1, *shape)
    if o.orthonormal:
        x, means = orthonormal_means(x, means)
    out = minimised(x, means, o)
    if h:
        out = np.pad(out, h, "edge")
    return out[np.arange(ny) * out.shape[0] // ny][:, np.arange(nx) * out.shape[1] // nx]


def segment(px: DataFrame, options: Options) -> DataFrame:
    """image_id, x, y, label of every image of px (image_id, x, y, v)."""

    def make(image: np.ndarray, image_id: int) -> pd.DataFrame:
        return va.table_of(image_id, label=segmented(image, options).astype(np.int32))

    return va.per_image(px, make, "label int")


def texture_options(segments: int, scales: Sequence[int] = (61, 31), weights: Sequence[float] = (0.2, 0.8), **more) -> Options:
    """Histograms of the responses to an image itself, Gabor filters and Laplacians, at two scales."""
    kernels = [np.ones((1, 1)), *[gabor(s, k * np.pi / 4) for s in (5, 9) for k in range(4)], laplacian_of_gaussian(5, 0.8), laplacian_of_gaussian(9, 1.4), gaussian(5, 1.0)]
    return Options([histogram_features(kernels, s) for s in scales], weights, segments=segments, scale=scales[0], **more)


def periodic_options(size: int, segments: int = 0, **more) -> Options:
    """Moduli of local spectra, for patterns that repeat; the margin of a block is left out and then filled."""
    return Options([spectrum_features(size)], segments=segments, scale=size, margin=False, **more)


__all__ = ["Options", "periodic_options", "segment", "segmented", "texture_options"]
