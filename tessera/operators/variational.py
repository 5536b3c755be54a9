"""Iterative variational operators on whole images, one image a task.

Total-variation and Mumford-Shah minimisation take thousands of sequential
steps, which can't be shuffles; images are independent, so each is one group of
``applyInPandas`` and the cluster works on many at a time. An image of side s
with k segments needs about 100 k s^2 bytes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def gradient(u: np.ndarray) -> np.ndarray:
    """Forward differences along the last two axes; 0 at the far border."""
    g = np.zeros((2, *u.shape))
    g[0, ..., :, :-1] = u[..., :, 1:] - u[..., :, :-1]
    g[1, ..., :-1, :] = u[..., 1:, :] - u[..., :-1, :]
    return g


def divergence(p: np.ndarray) -> np.ndarray:
    """The negative adjoint of gradient."""
    d = np.zeros(p.shape[1:])
    d[..., :, :-1] += p[0, ..., :, :-1]
    d[..., :, 1:] -= p[0, ..., :, :-1]
    d[..., :-1, :] += p[1, ..., :-1, :]
    d[..., 1:, :] -= p[1, ..., :-1, :]
    return d


def to_unit_balls(p: np.ndarray) -> np.ndarray:
    return p / np.maximum(1.0, np.sqrt((p**2).sum(0)))


def to_simplex(u: np.ndarray) -> np.ndarray:
    """The nearest point with components of at least 0 that sum to 1 along the first axis."""
    k = len(u)
    s = -np.sort(-u, axis=0)
    over = np.cumsum(s, 0) - 1
    n = np.arange(1, k + 1).reshape(-1, *[1] * (u.ndim - 1))
    rho = np.maximum(1, (s - over / n > 0).sum(0))
    theta = np.take_along_axis(over, rho[None] - 1, 0)[0] / rho
    return np.maximum(u - theta, 0)


def tv_denoise(image: np.ndarray, weight: float, most: int = 500, eps: float = 1e-4) -> np.ndarray:
    """Minimises |u - image|^2 / (2 weight) + TV(u) by an accelerated primal-dual
    scheme. The dual step is on TV itself, so its size fits every weight."""
    u = bar = image.copy()
    p, tau, sigma = np.zeros((2, *image.shape)), 0.25, 0.5
    for _ in range(most if weight > 0 else 0):
        p = to_unit_balls(p + sigma * gradient(bar))
        new = (u + tau * divergence(p) + tau / weight * image) / (1 + tau / weight)
        theta = 1 / np.sqrt(1 + 1.4 / weight * tau)
        tau, sigma = theta * tau, sigma / theta
        bar = new + theta * (new - u)
        done = np.abs(new - u).max() < eps
        u = new
        if done:
            break
    return u


def two_phase(first: np.ndarray, second: np.ndarray, gamma: float, most: int = 1000, eps: float = 1e-3, start: np.ndarray | None = None) -> np.ndarray:
    """Soft label of the second phase that minimises u^2 first + (1 - u)^2 second,
    summed, plus gamma TV(u), for the indicators of both phases: accelerated
    primal-dual steps, each primal step in closed form; the relaxed iterate is
    carried on."""
    u = np.full(first.shape, 0.5) if start is None else start.copy()
    p, tau, sigma = np.zeros((2, *first.shape)), 0.125, 0.125
    rate = 2 * 0.7 / gamma
    for _ in range(most):
        p = to_unit_balls(p + sigma * gradient(u))
        weight = 2 * tau / gamma
        new = (u + tau * divergence(p) + weight * second) / (1 + weight * (first + second))
        theta = 1 / np.sqrt(1 + rate * tau)
        tau, sigma = tau * theta, sigma / theta
        new = new + theta * (new - u)
        change = np.sqrt(((new - u) ** 2).sum())
        u = new
        if change < eps:
            break
    return u


def stretched_means(features: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Means of both phases: u is stretched about 1/2 to fill 0 to 1, then u^2 and
    (1 - u)^2 are weights; a phase without weight gets zeros."""
    u = u - 0.5
    u = 0.5 + u / max(2 * np.abs(u).max(), 1e-300)
    out = np.zeros((2, len(features)))
    for k, w in enumerate((u**2, (1 - u) ** 2)):
        if w.sum() > 0:
            out[k] = (features * w).sum((1, 2)) / w.sum()
    return out


def two_phase_segment(features: np.ndarray, means: np.ndarray, gamma: float, outer: int = 3, most: int = 500, eps: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Hard labels (1 for the phase of the second mean) and means, by turns. A
    half is added to each indicator, so that no pixel is without a pull."""
    u = None
    for _ in range(outer):
        own = indicators(features, means) + 0.5
        # u near 1 is the phase of means[1]: its indicator is paid where u is
        u = two_phase(own[1], own[0], gamma, most, eps, u)
        means = stretched_means(features, u)[::-1]
    return (u > 0.5).astype(int), means


def multiphase(indicators: np.ndarray, weight: float, most: int = 1000, eps: float = 1e-3, start: np.ndarray | None = None) -> np.ndarray:
    """Soft label maps [segment, y, x] that minimise sum(u f) weight + TV(u) on the simplex."""
    k = len(indicators)
    u = np.eye(k)[indicators.argmin(0)].transpose(2, 0, 1) if start is None else start
    bar, p, tau, sigma, theta = u.copy(), np.zeros((2, *u.shape)), 0.125, 0.125, 0.7
    for _ in range(most):
        p = to_unit_balls(p + sigma * gradient(bar))
        new = to_simplex(u + tau * (divergence(p) - weight * indicators))
        bar = new + theta * (new - u)
        change = np.sqrt(((new - u) ** 2).mean())
        u = new
        if change < eps / 100:
            break
    return u


def hard_labels(u: np.ndarray) -> np.ndarray:
    """The segment of the greatest share; the first on ties."""
    return u.argmax(0)


def indicators(features: np.ndarray, means: np.ndarray) -> np.ndarray:
    """Squared distances [segment, y, x] of features [component, y, x] to each mean."""
    return ((features[None] - means[:, :, None, None]) ** 2).sum(1)


def weighted_means(features: np.ndarray, u: np.ndarray, old: np.ndarray) -> np.ndarray:
    """Means of the features by soft labels; an empty segment keeps its own."""
    mass = u.sum((1, 2))
    sums = np.einsum("cyx,kyx->kc", features, u)
    return np.where(mass[:, None] > 1e-12, sums / np.maximum(mass, 1e-12)[:, None], old)


def piecewise_constant(features: np.ndarray, means: np.ndarray, weight: float, outer: int = 3, most: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """Alternates label maps and means; hard labels and the means."""
    u = None
    for _ in range(outer):
        u = multiphase(indicators(features, means), weight, most, start=u)
        means = weighted_means(features, u, means)
    return hard_labels(u), means


def reflected_blocks(image: np.ndarray, size: int) -> np.ndarray:
    """[y, x, size, size]: the block around each pixel, mirrored at the border."""
    r = size // 2
    return np.lib.stride_tricks.sliding_window_view(np.pad(image, ((r, size - 1 - r),) * 2, "reflect"), (size, size))


def fft_modulus(image: np.ndarray, size: int) -> np.ndarray:
    """[y, x, size^2]: moduli of the block's spectrum, zero frequency in the middle, over size^2."""
    spectrum = np.fft.fftshift(np.fft.fft2(reflected_blocks(image, size), axes=(-2, -1)), axes=(-2, -1))
    return np.abs(spectrum).reshape(*image.shape, -1) / size**2


def stockwell_bands(n: int) -> list[tuple[int, int]]:
    """Bands of frequencies that double in width from the middle outwards: (start, width) in a shifted spectrum."""
    half, out, width, at = n // 2, [(n // 2, 1)], 1, 1
    while at + width <= half:
        out += [(half + at, width), (half - at - width + 1, width)]
        at, width = at + width, width * 2
    return out


def stockwell(row: np.ndarray) -> np.ndarray:
    """Discrete orthonormal Stockwell transform of a row: each band of the unitary spectrum, transformed back."""
    n = len(row)
    spectrum = np.fft.fftshift(np.fft.fft(row) / np.sqrt(n))
    out = np.zeros(n, complex)
    for start, width in stockwell_bands(n):
        out[start : start + width] = np.fft.ifft(spectrum[start : start + width]) * np.sqrt(width)
    return out


def phase_correlation(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Peaks where b shifted matches a: the inverse transform of the normalised cross spectrum."""
    cross = np.fft.fft2(a) * np.conj(np.fft.fft2(b))
    return np.fft.ifft2(cross / np.maximum(np.abs(cross), 1e-12)).real


def image_of(pdf: pd.DataFrame, v: str = "v") -> np.ndarray:
    out = np.zeros((int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1))
    out[pdf["y"], pdf["x"]] = pdf[v]
    return out


def table_of(image_id: int, **columns: np.ndarray) -> pd.DataFrame:
    first = next(iter(columns.values()))
    y, x = np.indices(first.shape)
    return pd.DataFrame({"image_id": image_id, "x": x.ravel().astype(np.int32), "y": y.ravel().astype(np.int32), **{n: c.ravel() for n, c in columns.items()}}).astype({"image_id": np.int32})


def per_image(px: DataFrame, make, schema: str) -> DataFrame:
    """make(image, image_id) -> rows, for each image by itself."""
    return px.groupBy("image_id").applyInPandas(lambda pdf: make(image_of(pdf), int(pdf["image_id"].iloc[0])), "image_id int, x int, y int, " + schema)


def fixed_point_denoise(image: np.ndarray, weight: float, most: int = 500, tau: float = 0.125, eps: float = 0.0) -> np.ndarray:
    """The same minimiser as tv_denoise's by a fixed point of its dual: image less weight times a divergence."""
    p = np.zeros((2, *image.shape))
    for _ in range(most if weight > 0 else 0):
        g = gradient(divergence(p) - image / weight)
        new = (p + tau * g) / (1 + tau * np.sqrt((g**2).sum(0)))
        done = np.abs(new - p).max() < eps
        p = new
        if done:
            break
    return image - weight * divergence(p)


def _conjugate(apply, b: np.ndarray, x: np.ndarray, most: int = 200, eps: float = 1e-8) -> np.ndarray:
    r = b - apply(x)
    p, rr = r.copy(), (r * r).sum()
    stop = eps * eps * max((b * b).sum(), 1e-300)
    for _ in range(most):
        if rr <= stop:
            break
        ap = apply(p)
        alpha = rr / (p * ap).sum()
        x, r = x + alpha * p, r - alpha * ap
        rr, last = (r * r).sum(), rr
        p = r + rr / last * p
    return x


def edge_energy(u: np.ndarray, v: np.ndarray, image: np.ndarray, smooth: float, edges: float, width: float) -> float:
    """Distance to the image, slopes of u where v isn't 0, and the length of the edges where it is."""
    g, h = gradient(u), gradient(v)
    return float(((u - image) ** 2).sum() + smooth * ((v**2 + 1e-6) * (g**2).sum(0)).sum() + edges * (width * (h**2).sum() + ((1 - v) ** 2).sum() / (4 * width)))


def smoothed_with_edges(image: np.ndarray, smooth: float = 4.0, edges: float = 0.05, width: float = 1.0, rounds: int = 20, eps: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """u smooth but for edges, and v, which is near 0 on them and 1 elsewhere: each
    in turn solves the linear system that the other leaves, so the energy falls."""
    u, v = image.copy(), np.ones(image.shape)
    before = np.inf
    for _ in range(rounds):
        k = v**2 + 1e-6
        u = _conjugate(lambda x: x - smooth * divergence(k * gradient(x)), image, u)  # noqa: B023
        g = (gradient(u) ** 2).sum(0)
        v = _conjugate(lambda x: smooth * g * x + edges * (x / (4 * width) - width * divergence(gradient(x))), np.full(image.shape, edges / (4 * width)), v)  # noqa: B023
        now = edge_energy(u, v, image, smooth, edges, width)
        if before - now <= eps * abs(now):
            break
        before = now
    return u, v


def curve_order(points: np.ndarray) -> np.ndarray:
    """Rows in the order of a walk that starts at the first and always goes to the nearest one left (the first on ties)."""
    left = np.arange(len(points))
    out = []
    at = 0
    while len(left):
        out.append(left[at])
        here = points[left[at]]
        left = np.delete(left, at)
        if len(left):
            at = int(((points[left] - here) ** 2).sum(1).argmin())
    return np.array(out, int)
