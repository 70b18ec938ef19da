"""Small dense numerics: tails of distributions, quadratic programs, bounded minimisation."""
from __future__ import annotations

import math

import numpy as np


def normal_two_sided(z: float | None) -> float | None:
    return None if z is None or not math.isfinite(z) else math.erfc(abs(z) / math.sqrt(2))


def _gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma: series below a + 1, else Lentz's continued fraction."""
    if x <= 0:
        return 1.0
    log = a * math.log(x) - x - math.lgamma(a)
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * math.exp(log))
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return math.exp(log) * h


def chi2_sf(x: float, dof: float) -> float | None:
    return None if dof <= 0 or not math.isfinite(x) else _gamma_q(dof / 2, x / 2)


def _beta_cf(a: float, b: float, x: float) -> float:
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 1000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def t_two_sided(t: float, dof: float) -> float:
    x = dof / (dof + t * t)
    a, b = dof / 2, 0.5
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_cf(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_cf(b, a, 1 - x) / b


def bounded_qp(h: np.ndarray, g: np.ndarray, lower: np.ndarray | float = 0.0, upper: np.ndarray | float = np.inf, total: float | None = None) -> np.ndarray:
    """min x'hx / 2 - g'x with lower <= x <= upper and, if given, sum(x) = total; active sets, h positive definite."""
    n = len(g)
    lo, up = np.broadcast_to(np.asarray(lower, float), n), np.broadcast_to(np.asarray(upper, float), n)
    x = np.clip(np.zeros(n) if total is None else np.full(n, total / n), lo, up)
    fixed = np.zeros(n, int)  # -1 at the lower bound, 1 at the upper
    for _ in range(50 * n + 50):
        free = fixed == 0
        k = int(free.sum())
        target = x.copy()
        mult = 0.0
        if k:
            a = h[np.ix_(free, free)]
            r = g[free] - h[np.ix_(free, ~free)] @ x[~free]
            if total is None:
                target[free] = np.linalg.solve(a, r)
            else:
                kkt = np.block([[a, np.ones((k, 1))], [np.ones((1, k)), np.zeros((1, 1))]])
                s = np.linalg.solve(kkt, np.r_[r, total - x[~free].sum()])
                target[free], mult = s[:-1], s[-1]
        step, hit = 1.0, None
        for i in np.flatnonzero(free):
            d = target[i] - x[i]
            for bound, side in ((lo[i], -1), (up[i], 1)):
                if d * side > 0 and (target[i] - bound) * side > 1e-14 and (s_ := (bound - x[i]) / d) < step:
                    step, hit = max(0.0, s_), (i, side)
        x = x + step * (target - x)
        if hit is not None:
            x[hit[0]] = lo[hit[0]] if hit[1] < 0 else up[hit[0]]
            fixed[hit[0]] = hit[1]
            continue
        grad = h @ x - g + mult
        wrong = np.where(fixed == -1, -grad, np.where(fixed == 1, grad, -np.inf))
        worst = int(np.argmax(wrong))
        if wrong[worst] <= 1e-12 * (1 + np.abs(g).max()):
            return x
        fixed[worst] = 0
    return x


def minimise(f, x0: np.ndarray, lower: np.ndarray, upper: np.ndarray, rounds: int = 200, tol: float = 1e-9) -> tuple[np.ndarray, float]:
    """Projected BFGS with numeric gradients inside bounds."""
    x = np.clip(np.asarray(x0, float), lower, upper)
    fx, n = f(x), len(x)
    inv = np.eye(n)

    def gradient(x: np.ndarray) -> np.ndarray:
        out = np.zeros(n)
        for i in range(n):
            e = 1e-6
            a, b = x.copy(), x.copy()
            a[i], b[i] = min(upper[i], x[i] + e), max(lower[i], x[i] - e)
            out[i] = (f(a) - f(b)) / (a[i] - b[i])
        return out

    g = gradient(x)
    for _ in range(rounds):
        held = ((x <= lower) & (g > 0)) | ((x >= upper) & (g < 0))
        p = -(inv @ np.where(held, 0, g))
        p[held] = 0
        if p @ g >= 0:
            inv, p = np.eye(n), -np.where(held, 0, g)
        t = 1.0
        while t > 1e-12:
            y = np.clip(x + t * p, lower, upper)
            fy = f(y)
            if fy <= fx + 1e-4 * g @ (y - x):
                break
            t /= 2
        else:
            break
        gy = gradient(y)
        s, d = y - x, gy - g
        if s @ d > 1e-14:
            r = 1 / (s @ d)
            m = np.eye(n) - r * np.outer(s, d)
            inv = m @ inv @ m.T + r * np.outer(s, s)
        done = abs(fx - fy) <= tol * (1 + abs(fx))
        x, fx, g = y, fy, gy
        if done:
            break
    return x, fx
