"""Fits, roots, solvers and time steps.

What grows with a table is summed up by Spark: moments of a fit, residuals and
slopes of a model, products of a sparse matrix with a vector. What is left is as
small as the model (parameters, a Hessian) and is solved on the driver."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .learning import spmv
from .storage import checkpointed

# ---- polynomials and distributions ----


def polynomial_fit(points: DataFrame, degree: int) -> np.ndarray:
    """Coefficients, constant first, of least squares over (x, y): 3 degree + 2 sums in one pass."""
    x, y = F.col("x"), F.col("y")
    power = lambda k: F.pow(x, F.lit(float(k)))
    sums = points.agg(*[F.sum(power(k)).alias(f"s{k}") for k in range(2 * degree + 1)], *[F.sum(power(k) * y).alias(f"t{k}") for k in range(degree + 1)]).first()
    normal = np.array([[sums[f"s{i + j}"] for j in range(degree + 1)] for i in range(degree + 1)])
    return np.linalg.solve(normal, np.array([sums[f"t{k}"] for k in range(degree + 1)]))


def interpolating_polynomial(x: Sequence[float], y: Sequence[float]) -> list[float]:
    """The coefficients, constant first, of the polynomial through all points."""
    return np.linalg.solve(np.vander(np.array(x, float), increasing=True), np.array(y, float)).tolist()


def kolmogorov_tail(scaled: float, terms: int = 100) -> float:
    """The probability that the scaled greatest distance of two samples of one distribution is larger."""
    if scaled < 0.2:  # where the series hasn't settled it is 1 to twelve digits
        return 1.0
    return min(1.0, 2 * sum((-1) ** (j - 1) * math.exp(-2 * j * j * scaled * scaled) for j in range(1, terms + 1)))


def quadrant_distances(cells: DataFrame, ni: int, nj: int) -> DataFrame:
    """quadrant, distance: the greatest difference of the shares of c0 and c1 that
    lie on one side of a cell (i, j), for the four ways to take sides. cells are
    counts on a grid of ni by nj, so what is summed up here is that grid."""
    spark = cells.sparkSession
    n = cells.agg(F.sum("c0").alias("n0"), F.sum("c1").alias("n1"))
    full = spark.range(ni * nj).select((F.col("id") % ni).cast("int").alias("i"), F.floor(F.col("id") / ni).cast("int").alias("j"))
    rows = full.join(cells, ["i", "j"], "left").crossJoin(F.broadcast(n))
    rows = rows.select("i", "j", (F.coalesce("c0", F.lit(0)) / F.col("n0") - F.coalesce("c1", F.lit(0)) / F.col("n1")).alias("delta"))
    out = None
    for k in range(4):
        along = Window.partitionBy("j").orderBy("i" if k % 2 == 0 else F.desc("i"))
        across = Window.partitionBy("i").orderBy("j" if k < 2 else F.desc("j"))
        part = rows.withColumn("delta", F.sum("delta").over(along)).withColumn("delta", F.sum("delta").over(across))
        part = part.agg(F.lit(k).alias("quadrant"), F.max(F.abs("delta")).alias("distance"))
        out = part if out is None else out.unionByName(part)
    return out


# ---- sparse systems as (i, j, v) and vectors (i, v): a join and a sum for each product ----


def _dot(a: DataFrame, b: DataFrame) -> float:
    return a.join(b.withColumnRenamed("v", "w"), "i").agg(F.sum(F.col("v") * F.col("w"))).first()[0] or 0.0


def conjugate_gradient(matrix: DataFrame, rhs: DataFrame, most: int = 200, eps: float = 1e-10, preconditioned: bool = False) -> tuple[DataFrame, float, int]:
    """x with matrix x = rhs for a symmetric positive matrix, the norm of the
    residual, and steps; preconditioned by the diagonal if asked. A step is one
    product, and two aggregates; its vectors are written out."""
    diagonal = matrix.where("i = j").select("i", F.col("v").alias("d"))
    rows = rhs.select("i", F.col("v").alias("r"), F.lit(0.0).alias("x"))
    rows = rows.join(diagonal, "i") if preconditioned else rows.withColumn("d", F.lit(1.0))
    now = checkpointed(rows.withColumn("p", F.col("r") / F.col("d")))
    first = now.agg(F.sum(F.col("r") * F.col("p")), F.sum(F.col("r") * F.col("r"))).first()
    rz, rr = first[0] or 0.0, first[1] or 0.0
    target, steps = eps * eps * max(rr, 1e-300), 0
    while rr > target and steps < most:
        steps += 1
        ap = spmv(matrix, now.select("i", F.col("p").alias("v"))).withColumnRenamed("v", "ap")
        step = checkpointed(now.join(ap, "i"), now)
        alpha, held = rz / step.agg(F.sum(F.col("p") * F.col("ap"))).first()[0], step
        step = step.withColumn("x", F.col("x") + alpha * F.col("p")).withColumn("r", F.col("r") - alpha * F.col("ap")).drop("ap")
        step = step.withColumn("z", F.col("r") / F.col("d"))
        sums = step.agg(F.sum(F.col("r") * F.col("z")), F.sum(F.col("r") * F.col("r"))).first()
        now = checkpointed(step.select("i", "x", "r", "d", (F.col("z") + F.lit(sums[0] / rz) * F.col("p")).alias("p")), held)
        rz, rr = sums
    return now.select("i", F.col("x").alias("v")), math.sqrt(rr), steps


def jacobi(matrix: DataFrame, rhs: DataFrame, rounds: int) -> DataFrame:
    """x after that many rounds from zero."""
    from .learning import jacobi_step

    x = rhs.select("i", F.lit(0.0).alias("v"))
    for _ in range(rounds):
        new = jacobi_step(matrix, x, rhs)
        x = checkpointed(new, x)
    return x


def matrix_product(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, j, v) of two matrices: a join on the inner index, a sum by place."""
    right = b.select(F.col("i").alias("k"), F.col("j").alias("jj"), F.col("v").alias("w"))
    rows = a.select("i", F.col("j").alias("k"), "v").join(right, "k")
    return rows.groupBy("i", F.col("jj").alias("j")).agg(F.sum(F.col("v") * F.col("w")).alias("v"))


# ---- dense systems on the driver ----


def lu_solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """By elimination with row exchanges."""
    a, b = a.astype(float).copy(), b.astype(float).copy()
    n = len(a)
    for k in range(n):
        p = k + int(np.abs(a[k:, k]).argmax())
        if a[p, k] == 0:
            raise ValueError("singular matrix")
        a[[k, p]], b[[k, p]] = a[[p, k]], b[[p, k]]
        for i in range(k + 1, n):
            m = a[i, k] / a[k, k]
            a[i, k:] -= m * a[k, k:]
            b[i] -= m * b[k]
    x = np.zeros(n)
    for k in range(n - 1, -1, -1):
        x[k] = (b[k] - a[k, k + 1 :] @ x[k + 1 :]) / a[k, k]
    return x


def qr_least_squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    q, r = np.linalg.qr(a)
    return np.linalg.solve(r, q.T @ b)


def gmres(apply: Callable[[np.ndarray], np.ndarray], b: np.ndarray, restart: int = 30, most: int = 300, eps: float = 1e-10) -> np.ndarray:
    """Restarted: the least residual over a growing space of products, made orthogonal."""
    x = np.zeros_like(b, float)
    for _ in range(max(1, most // restart)):
        r = b - apply(x)
        beta = np.linalg.norm(r)
        if beta <= eps * max(np.linalg.norm(b), 1e-300):
            break
        basis, h = [r / beta], np.zeros((restart + 1, restart))
        for k in range(restart):
            w = apply(basis[k])
            for j, q in enumerate(basis):
                h[j, k] = q @ w
                w = w - h[j, k] * q
            h[k + 1, k] = np.linalg.norm(w)
            if h[k + 1, k] < 1e-14 * beta:
                break
            basis.append(w / h[k + 1, k])
        n = k + 1
        y = qr_least_squares(h[: n + 1, :n], np.r_[beta, np.zeros(n)]) if h[n, n - 1] else np.linalg.solve(h[:n, :n], np.r_[beta, np.zeros(n - 1)])
        x = x + np.array(basis[:n]).T @ y
    return x


def bicgstab(apply: Callable[[np.ndarray], np.ndarray], b: np.ndarray, most: int = 500, eps: float = 1e-12) -> np.ndarray:
    """Stabilised biconjugate gradients, for matrices that aren't symmetric."""
    x = np.zeros_like(b, float)
    r = b - apply(x)
    shadow, rho, alpha, omega, v, p = r.copy(), 1.0, 1.0, 1.0, np.zeros_like(x), np.zeros_like(x)
    for _ in range(most):
        new = shadow @ r
        p = r + new / rho * alpha / omega * (p - omega * v)
        rho, v = new, apply(p)
        alpha = rho / (shadow @ v)
        s = r - alpha * v
        t = apply(s)
        omega = (t @ s) / (t @ t) if t.any() else 0.0
        x, r = x + alpha * p + omega * s, s - omega * t
        if np.linalg.norm(r) <= eps * np.linalg.norm(b) or not omega:
            break
    return x


def gauss_seidel(a: np.ndarray, b: np.ndarray, rounds: int) -> np.ndarray:
    x = np.zeros(len(b))
    for _ in range(rounds):
        for i in range(len(b)):
            x[i] += (b[i] - a[i] @ x) / a[i, i]
    return x


def projected_gauss_seidel(a: np.ndarray, b: np.ndarray, rounds: int = 500) -> np.ndarray:
    """x of at least 0 with a x - b of at least 0, one of the two being 0 in each place (a symmetric positive)."""
    x = np.zeros(len(b))
    for _ in range(rounds):
        for i in range(len(b)):
            x[i] = max(0.0, x[i] + (b[i] - a[i] @ x) / a[i, i])
    return x


# ---- searches ----


def bisection(f: Callable[[float], float], low: float, high: float, eps: float = 1e-12) -> float:
    """A root between two places where f has different signs."""
    a = f(low)
    if a * f(high) > 0:
        raise ValueError("no change of sign")
    while high - low > eps:
        mid = (low + high) / 2
        m = f(mid)
        if (m > 0) == (a > 0) and m != 0:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def golden_section(f: Callable[[float], float], low: float, high: float, eps: float = 1e-9) -> float:
    """Where f, with one valley between low and high, is least."""
    g = (math.sqrt(5) - 1) / 2
    a, b = high - g * (high - low), low + g * (high - low)
    fa, fb = f(a), f(b)
    while high - low > eps:
        if fa <= fb:
            high, b, fb = b, a, fa
            a = high - g * (high - low)
            fa = f(a)
        else:
            low, a, fa = a, b, fb
            b = low + g * (high - low)
            fb = f(b)
    return (low + high) / 2


def nelder_mead(f: Callable[[np.ndarray], float], start: Sequence[float], size: float = 1.0, most: int = 2000, eps: float = 1e-12) -> np.ndarray:
    """Simplex search: reflection 1, expansion 2, contraction 1/2, shrinking 1/2."""
    n = len(start)
    points = [np.array(start, float)] + [np.array(start, float) + size * e for e in np.eye(n)]
    values = [f(p) for p in points]
    for _ in range(most):
        order = np.argsort(values, kind="stable")
        points, values = [points[k] for k in order], [values[k] for k in order]
        if values[-1] - values[0] <= eps and max(np.abs(p - points[0]).max() for p in points) <= math.sqrt(eps):
            break
        middle = np.mean(points[:-1], axis=0)
        at = lambda t, middle=middle: middle + t * (middle - points[-1])
        new = at(1.0)
        value = f(new)
        if value < values[0]:
            far = at(2.0)
            if (v := f(far)) < value:
                new, value = far, v
        elif value >= values[-2]:
            near = at(0.5) if value < values[-1] else at(-0.5)
            if (v := f(near)) < min(value, values[-1]):
                new, value = near, v
            else:
                points = [points[0]] + [points[0] + 0.5 * (p - points[0]) for p in points[1:]]
                values = [values[0]] + [f(p) for p in points[1:]]
                continue
        points[-1], values[-1] = new, value
    return points[int(np.argmin(values))]


def gradient_descent(f: Callable[[np.ndarray], float], slope: Callable[[np.ndarray], np.ndarray], start: Sequence[float], most: int = 10_000, eps: float = 1e-10) -> np.ndarray:
    """Steps down the slope, halved until they gain a fixed share of what the slope promises."""
    x, tau = np.array(start, float), 1.0
    for _ in range(most):
        g = slope(x)
        if np.linalg.norm(g) <= eps:
            break
        here = f(x)
        while f(x - tau * g) > here - 0.25 * tau * (g @ g) and tau > 1e-18:
            tau /= 2
        x, tau = x - tau * g, tau * 2
    return x


def newton(slope: Callable[[np.ndarray], np.ndarray], curvature: Callable[[np.ndarray], np.ndarray], start: Sequence[float], most: int = 100, eps: float = 1e-12) -> np.ndarray:
    """Where the slope is zero; a step is halved until the slope gets less."""
    x = np.array(start, float)
    for _ in range(most):
        g = slope(x)
        if np.linalg.norm(g) <= eps:
            break
        step, t = np.linalg.solve(curvature(x), g), 1.0
        while np.linalg.norm(slope(x - t * step)) > (1 - t / 4) * np.linalg.norm(g) and t > 1e-6:
            t /= 2
        x = x - t * step
    return x


def levenberg_marquardt(points: DataFrame, model: Callable[[list[Column]], Column], slopes: Callable[[list[Column]], list[Column]], start: Sequence[float], target: str = "y", most: int = 60, eps: float = 1e-10, low: Sequence[float] | None = None) -> np.ndarray:
    """Parameters with the least squared residuals of a model over a table.

    Each round is one aggregate: the products of the slopes with each other and
    with the residuals, as many as parameters squared. low keeps parameters at
    or above bounds by projection."""
    c, damping, cost = np.array(start, float), 1e-3, None
    n = len(c)

    def sums(c: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        own = [F.lit(float(x)) for x in c]
        e, s = F.col(target) - model(own), slopes(own)
        row = points.agg(F.sum(e * e), *[F.sum(s[i] * e) for i in range(n)], *[F.sum(s[i] * s[j]) for i in range(n) for j in range(n)]).first()
        return row[0], np.array(row[1 : 1 + n]), np.array(row[1 + n :]).reshape(n, n)

    cost, g, h = sums(c)
    for _ in range(most):
        free = np.ones(n, bool) if low is None else (c > low) | (g > 0)  # at its bound a parameter moves only if it gains
        step, own = np.zeros(n), h[np.ix_(free, free)]
        step[free] = np.linalg.solve(own + damping * np.diag(np.maximum(np.diag(own), 1e-12)), g[free])
        new = c + step if low is None else np.maximum(c + step, low)
        new_cost, new_g, new_h = sums(new)
        if new_cost <= cost:
            done = np.abs(new - c).max() <= eps * (1 + np.abs(c).max())
            c, cost, g, h, damping = new, new_cost, new_g, new_h, max(damping / 10, 1e-12)
            if done:
                break
        else:
            damping *= 10
            if damping > 1e12:
                break
    return c


# ---- time steps ----

#: The embedded pair of orders 4 and 5 of Fehlberg (fixed values).
STAGES = ((), (1 / 4,), (3 / 32, 9 / 32), (1932 / 2197, -7200 / 2197, 7296 / 2197), (439 / 216, -8.0, 3680 / 513, -845 / 4104), (-8 / 27, 2.0, -3544 / 2565, 1859 / 4104, -11 / 40))
PLACES = (0.0, 1 / 4, 3 / 8, 12 / 13, 1.0, 1 / 2)
FIFTH = (16 / 135, 0.0, 6656 / 12825, 28561 / 56430, -9 / 50, 2 / 55)
FOURTH = (25 / 216, 0.0, 1408 / 2565, 2197 / 4104, -1 / 5, 0.0)


def rkf45(f: Callable[[float, float], float], t: float, u: float, end: float, eps: float = 1e-9, step: float = 0.25) -> float:
    """u(end) of u' = f(t, u) from u(t), with steps that keep the difference of both orders below eps."""
    while t < end:
        step = min(step, end - t)
        k: list[float] = []
        for own, place in zip(STAGES, PLACES, strict=True):
            k.append(f(t + place * step, u + step * sum(a * b for a, b in zip(own, k, strict=True))))
        five, four = (u + step * sum(a * b for a, b in zip(w, k, strict=True)) for w in (FIFTH, FOURTH))
        error = abs(five - four)
        if error <= eps * step or step < 1e-12:
            t, u = t + step, five
        step *= min(4.0, max(0.1, 0.9 * (eps * step / max(error, 1e-300)) ** 0.25))
    return u
