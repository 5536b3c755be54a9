"""Scalar functions as column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def signum(v: Column, at_zero: float = 0.0) -> Column:
    return F.when(v > 0, F.lit(1.0)).when(v < 0, F.lit(-1.0)).otherwise(F.lit(at_zero))


def smooth_max(a: Column, b: Column, eps: float) -> Column:
    """A differentiable maximum: (a + b + sqrt((a - b)^2 + eps^2)) / 2."""
    return (a + b + F.sqrt((a - b) * (a - b) + eps * eps)) / 2


def smooth_min(a: Column, b: Column, eps: float) -> Column:
    return (a + b - F.sqrt((a - b) * (a - b) + eps * eps)) / 2


def is_finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))


def nearly(a: Column, b: Column, eps: float, relative: bool = False) -> Column:
    return F.abs(a - b) <= (eps * F.greatest(F.abs(a), F.abs(b)) if relative else F.lit(eps))


def erf(v: Column) -> Column:
    """The error function to about 1e-13: its power series below 2.5, and the
    continued fraction of its complement from there on."""
    x = F.abs(v)
    near = x * polynomial(x * x, [2 / math.sqrt(math.pi) * (-1) ** n / (math.factorial(n) * (2 * n + 1)) for n in range(41)])
    t = x
    for k in range(40, 0, -1):
        t = x + k / 2 / t
    far = 1 - F.exp(-x * x) / (math.sqrt(math.pi) * t)
    return signum(v) * F.when(x < 2.5, near).otherwise(far)


def polynomial(x: Column, coefficients: Sequence[float]) -> Column:
    """Horner's scheme; the constant comes first."""
    out = F.lit(0.0)
    for c in reversed(coefficients):
        out = out * x + F.lit(float(c))
    return out


def derivative(coefficients: Sequence[float]) -> list[float]:
    return [k * c for k, c in enumerate(coefficients)][1:]


def normal_pdf(x: Column, mean: float = 0.0, sigma: float = 1.0) -> Column:
    z = (x - mean) / sigma
    return F.exp(-z * z / 2) / (sigma * math.sqrt(2 * math.pi))


def normal_cdf(x: Column, mean: float = 0.0, sigma: float = 1.0) -> Column:
    return (1 + erf((x - mean) / (sigma * math.sqrt(2)))) / 2


#: Coefficients of a rational approximation to the inverse of the normal distribution (fixed values).
CENTRE = ((-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00), (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0))
TAIL = ((-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00), (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0))


def normal_inverse(p: Column, mean: float = 0.0, sigma: float = 1.0) -> Column:
    """The value below which a normal variable lies with probability p, to about 1e-9 sigma; null outside of (0, 1)."""
    up = lambda c: list(reversed(c))
    q = p - 0.5
    middle = q * polynomial(q * q, up(CENTRE[0])) / polynomial(q * q, up(CENTRE[1]))
    t = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    tail = polynomial(t, up(TAIL[0])) / polynomial(t, up(TAIL[1]))
    z = F.when(F.abs(q) <= 0.5 - 0.02425, middle).otherwise(F.when(q < 0, tail).otherwise(-tail))
    return F.when((p > 0) & (p < 1), mean + sigma * z)


def poisson_pmf(k: Column, rate: float) -> Column:
    """The probability of k, a whole number of at least 0, summed in logarithms."""
    return F.exp(k * math.log(rate) - rate - F.aggregate(F.sequence(F.lit(1), F.greatest(k.cast("int"), F.lit(1))), F.lit(0.0), lambda s, i: s + F.log(i.cast("double"))))


def poisson_sums(rate: float) -> list[float]:
    """P(X <= k) for k = 0, 1, ... up to where it is 1 in double precision."""
    term, total, out = math.exp(-rate), 0.0, []
    while not out or (total < 1 - 1e-15 and len(out) < rate + 40 * math.sqrt(rate) + 40):
        total += term
        out.append(total)
        term *= rate / len(out)
    return out


def poisson_cdf(k: Column, rate: float) -> Column:
    sums = poisson_sums(rate)
    at = F.least(k.cast("int"), F.lit(len(sums) - 1))
    return F.when(k < 0, F.lit(0.0)).otherwise(F.get(F.array(*map(F.lit, sums)), at))


def poisson_inverse(p: Column, rate: float) -> Column:
    """The least k with P(X <= k) of at least p."""
    return F.size(F.filter(F.array(*map(F.lit, poisson_sums(rate))), lambda s: s < p))


def heaviside(x: Column, eps: float, kind: str = "arctan") -> Column:
    """Steps from 0 to 1 of width eps: sharp, identity, clamped, arctan, or polynomials of one and two smooth derivatives."""
    z = F.least(F.greatest((x / eps + 1) / 2, F.lit(0.0)), F.lit(1.0))
    forms = {
        "sharp": F.when(x >= 0, F.lit(1.0)).otherwise(0.0),
        "identity": x,
        "clamped": z,
        "arctan": 0.5 + F.atan(x / eps) / math.pi,
        "polynomial": z * z * (3 - 2 * z),
        "polynomial2": z * z * z * (z * (6 * z - 15) + 10),
    }
    return forms[kind]


def uniform(key: Column, seed: int = 0) -> Column:
    """A number from 0 to 1 for each key and seed, the same in every run: 52 bits of a digest."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), key).cast("binary")), 1, 13), 16, 10).cast("long") / float(1 << 52)


def salt_and_pepper(v: Column, key: Column, share: float, low: float = 0.0, high: float = 1.0, seed: int = 0) -> Column:
    """v, or for that share of the keys either end."""
    u = uniform(key, seed)
    return F.when(u < share / 2, F.lit(low)).when(u < share, F.lit(high)).otherwise(v)


def gaussian_noise(key: Column, sigma: float, seed: int = 0) -> Column:
    """Normal noise of mean 0, from two uniform numbers."""
    return sigma * F.sqrt(-2 * F.log(1 - uniform(key, seed))) * F.cos(2 * math.pi * uniform(key, seed + 1))


def uniform_noise(key: Column, low: float, high: float, seed: int = 0) -> Column:
    return low + (high - low) * uniform(key, seed)


def poisson_noise(key: Column, rate: float, seed: int = 0) -> Column:
    return poisson_inverse(uniform(key, seed), rate)


# ---- powers, checks, text ----


def cube(v: Column) -> Column:
    return v * v * v


def fourth_power(v: Column) -> Column:
    return v * v * v * v


def smooth_max_slope(a: Column, b: Column, eps: float) -> Column:
    """Derivative of smooth_max by a."""
    return 0.5 * (1 + (a - b) / F.sqrt((a - b) * (a - b) + eps * eps))


def smooth_min_slope(a: Column, b: Column, eps: float) -> Column:
    return 0.5 * (1 - (a - b) / F.sqrt((a - b) * (a - b) + eps * eps))


def rint(v: Column) -> Column:
    """The nearest whole number, halves away from zero."""
    return signum(v) * F.floor(F.abs(v) + 0.5)


def at_least(a: Column, b: Column, eps: float, relative: bool = False) -> Column:
    """a >= b, or nearly so."""
    return (a >= b) | nearly(a, b, eps, relative)


def sum_fits(a: Column, b: Column) -> Column:
    """Whether the sum of two whole numbers has a place in their type."""
    return F.try_add(a, b).isNotNull()


def product_fits(a: Column, b: Column) -> Column:
    return F.try_multiply(a, b).isNotNull()


def base_name(path: Column) -> Column:
    """What follows the last slash, without its last suffix."""
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


def directory(path: Column) -> Column:
    """Up to the last slash, it included; empty without one."""
    return F.regexp_extract(path, r"^(.*/)", 1)


def heaviside_slope(x: Column, eps: float, kind: str = "arctan") -> Column:
    """Derivatives of the smooth forms of heaviside."""
    z = (x / eps + 1) / 2
    inside = (z > 0) & (z < 1)
    forms = {
        "identity": F.lit(1.0),
        "clamped": F.when(inside, F.lit(0.5 / eps)).otherwise(0.0),
        "arctan": 1 / (math.pi * (eps + x * x / eps)),
        "polynomial": F.when(inside, 3 * z * (1 - z) / eps).otherwise(0.0),
        "polynomial2": F.when(inside, 15 * z * z * (1 - z) * (1 - z) / eps).otherwise(0.0),
    }
    return forms[kind]


def out_of_unit_penalty(x: Column) -> Column:
    """How far x is outside of 0 to 1, squared."""
    return F.when(x < 0, x * x).when(x > 1, (x - 1) * (x - 1)).otherwise(0.0)


def real_zeros(c0: Column, c1: Column, c2: Column) -> tuple[Column, Column]:
    """Zeros of c0 + c1 x + c2 x^2, the smaller one first; null where there are none."""
    inner = c1 * c1 - 4 * c0 * c2
    root = F.sqrt(F.when((inner >= 0) & (c2 != 0), inner))
    a, b = (-c1 - root) / (2 * c2), (-c1 + root) / (2 * c2)
    return F.least(a, b), F.greatest(a, b)
