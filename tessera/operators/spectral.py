"""Transforms of whole images: Fourier, cosine, wavelet, convolution, implicit diffusion.

They mix every pixel with every other, so an image is one task; a cluster works
on many images at a time."""

from __future__ import annotations

import numpy as np


def dft_modulus(u: np.ndarray) -> np.ndarray:
    """Moduli of the unitary spectrum, the zero frequency in the middle."""
    return np.abs(np.fft.fftshift(np.fft.fft2(u, norm="ortho")))


def cosine_matrix(n: int) -> np.ndarray:
    """Rows are the orthonormal cosines of the second kind."""
    k, x = np.arange(n)[:, None], np.arange(n)[None, :]
    out = np.cos(np.pi * k * (x + 0.5) / n) * np.sqrt(2 / n)
    out[0] /= np.sqrt(2)
    return out


def dct(u: np.ndarray) -> np.ndarray:
    return cosine_matrix(u.shape[0]) @ u @ cosine_matrix(u.shape[1]).T


def inverse_dct(c: np.ndarray) -> np.ndarray:
    return cosine_matrix(c.shape[0]).T @ c @ cosine_matrix(c.shape[1])


def haar(u: np.ndarray, levels: int) -> np.ndarray:
    """Orthonormal Haar coefficients: sums in the upper left quarter, which is split again at each level (sides must be even there)."""
    out = u.astype(float).copy()
    ny, nx = out.shape
    for _ in range(levels):
        if ny % 2 or nx % 2:
            raise ValueError("a side is odd")
        a = out[:ny, :nx]
        a = np.concatenate([a[:, ::2] + a[:, 1::2], a[:, ::2] - a[:, 1::2]], 1) / np.sqrt(2)
        a = np.concatenate([a[::2] + a[1::2], a[::2] - a[1::2]], 0) / np.sqrt(2)
        out[:ny, :nx] = a
        ny, nx = ny // 2, nx // 2
    return out


def inverse_haar(c: np.ndarray, levels: int) -> np.ndarray:
    out = c.astype(float).copy()
    for level in range(levels - 1, -1, -1):
        ny, nx = out.shape[0] >> level, out.shape[1] >> level
        a = out[:ny, :nx].copy()
        rows = np.empty_like(a)
        rows[::2], rows[1::2] = (a[: ny // 2] + a[ny // 2 :]) / np.sqrt(2), (a[: ny // 2] - a[ny // 2 :]) / np.sqrt(2)
        both = np.empty_like(a)
        both[:, ::2], both[:, 1::2] = (rows[:, : nx // 2] + rows[:, nx // 2 :]) / np.sqrt(2), (rows[:, : nx // 2] - rows[:, nx // 2 :]) / np.sqrt(2)
        out[:ny, :nx] = both
    return out


def kernel_image(kernel: list[tuple[int, int, float]], shape: tuple[int, int]) -> np.ndarray:
    """A kernel (dx, dy, weight) as an image whose origin is its first pixel."""
    out = np.zeros(shape)
    for dx, dy, w in kernel:
        out[dy % shape[0], dx % shape[1]] += w
    return out


def circular_convolution(u: np.ndarray, kernel: list[tuple[int, int, float]]) -> np.ndarray:
    """Sums of kernel(d) u(x - d), round the border."""
    return np.fft.ifft2(np.fft.fft2(u) * np.fft.fft2(kernel_image(kernel, u.shape))).real


def linear_convolution(u: np.ndarray, kernel: list[tuple[int, int, float]], rule: str = "zero") -> np.ndarray:
    """The same with zeros beyond the border, or mirrored there (the border isn't repeated)."""
    r = max(max(abs(a), abs(b)) for a, b, _ in kernel)
    wide = np.pad(u, r, "constant" if rule == "zero" else "reflect")
    return circular_convolution(wide, kernel)[r : r + u.shape[0], r : r + u.shape[1]]


def motion_blur(length: int, angle: float) -> list[tuple[int, int, float]]:
    """Equal weights along a line through the origin."""
    places = [(round(t * np.cos(angle)), round(t * np.sin(angle))) for t in np.arange(length) - (length - 1) / 2]
    return [(int(a), int(b), 1 / length) for a, b in places]


def heat_step(u: np.ndarray, tau: float) -> np.ndarray:
    """One implicit step of diffusion without flow through the border: (1 - tau Laplace) v = u, diagonal in cosines."""
    ny, nx = u.shape
    speed = lambda n: 2 - 2 * np.cos(np.pi * np.arange(n) / n)
    return inverse_dct(dct(u) / (1 + tau * (speed(ny)[:, None] + speed(nx)[None, :])))


def fourier_threshold(u: np.ndarray, share: float) -> np.ndarray:
    """Without the frequencies whose modulus is below that share of the greatest."""
    f = np.fft.fft2(u)
    m = np.abs(f)
    return np.fft.ifft2(np.where(m >= share * m.max(), f, 0)).real


def distance_transform(mask: np.ndarray, sweeps: int = 100, eps: float = 1e-12) -> np.ndarray:
    """First-order solution of |grad u| = 1 with u = 0 on the mask, by sweeps in four directions."""
    far = 1e6
    u = np.where(mask, 0.0, far)
    ny, nx = u.shape
    for _ in range(sweeps):
        before = u.copy()
        for ys in (range(ny), range(ny - 1, -1, -1)):
            for xs in (range(nx), range(nx - 1, -1, -1)):
                for y in ys:
                    for x in xs:
                        a = min(u[y, x - 1] if x else far, u[y, x + 1] if x + 1 < nx else far)
                        b = min(u[y - 1, x] if y else far, u[y + 1, x] if y + 1 < ny else far)
                        new = min(a, b) + 1 if abs(a - b) >= 1 else (a + b + np.sqrt(2 - (a - b) ** 2)) / 2
                        if new < u[y, x]:
                            u[y, x] = new
        if np.abs(u - before).max() <= eps:
            break
    return u
