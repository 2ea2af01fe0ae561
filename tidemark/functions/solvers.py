"""Small numpy solvers: Nelder-Mead, quadratic programs over box, budget and group bounds, risk parity."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def nelder_mead(f: Callable[[np.ndarray], float], x0: np.ndarray, scale: float = 0.1, most: int = 2000, tol: float = 1e-10) -> tuple[np.ndarray, float, bool]:
    """Simplex search (Nelder and Mead 1965): least point, its value, whether it converged."""
    x0 = np.asarray(x0, dtype=float)
    n = len(x0)
    pts = [x0] + [x0 + np.eye(n)[i] * (scale * abs(x0[i]) if x0[i] else scale) for i in range(n)]
    val = [f(p) for p in pts]
    for _ in range(most):
        order = np.argsort(val)
        pts, val = [pts[i] for i in order], [val[i] for i in order]
        if abs(val[-1] - val[0]) <= tol * (1 + abs(val[0])) and np.max(np.abs(np.array(pts[1:]) - pts[0])) <= 1e-8 * (1 + np.max(np.abs(pts[0]))):
            return pts[0], val[0], True
        mid = np.mean(pts[:-1], axis=0)
        out = mid + (mid - pts[-1])
        fo = f(out)
        if fo < val[0]:
            far = mid + 2 * (mid - pts[-1])
            ff = f(far)
            pts[-1], val[-1] = (far, ff) if ff < fo else (out, fo)
        elif fo < val[-2]:
            pts[-1], val[-1] = out, fo
        else:
            near = mid + 0.5 * ((out if fo < val[-1] else pts[-1]) - mid)
            fn = f(near)
            if fn < min(fo, val[-1]):
                pts[-1], val[-1] = near, fn
            else:
                pts = [pts[0]] + [pts[0] + 0.5 * (p - pts[0]) for p in pts[1:]]
                val = [val[0]] + [f(p) for p in pts[1:]]
    best = int(np.argmin(val))
    return pts[best], val[best], False


def onto_budget(v: np.ndarray, lo: np.ndarray, hi: np.ndarray, total: float = 1.0) -> np.ndarray:
    """Nearest point with lo <= w <= hi and sum w = total: the shift is found on the piecewise linear sum."""
    if len(v) <= 64:
        at = np.sort(np.concatenate([v - hi, v - lo]))
        sums = np.clip(v[None, :] - at[:, None], lo, hi).sum(axis=1)  # falls along ``at``
        return np.clip(v - np.interp(-total, -sums, at), lo, hi)
    a, b = (v - hi).min() - 1.0, (v - lo).max() + 1.0
    for _ in range(60):
        m = (a + b) / 2
        if np.clip(v - m, lo, hi).sum() > total:
            a = m
        else:
            b = m
    return np.clip(v - (a + b) / 2, lo, hi)


def feasible(v: np.ndarray, lo: np.ndarray, hi: np.ndarray, groups: list[tuple[np.ndarray, float, float]]) -> np.ndarray:
    """Nearest point that also keeps each group's sum within bounds (Dykstra's alternating projections)."""
    if not groups:
        return onto_budget(v, lo, hi)
    w, rest = v.copy(), [np.zeros_like(v) for _ in range(len(groups) + 1)]
    for _ in range(100):
        before = w.copy()
        y = onto_budget(w + rest[0], lo, hi)
        rest[0] = w + rest[0] - y
        w = y
        for k, (at, low, high) in enumerate(groups, 1):
            y = w + rest[k]
            s = y[at].sum()
            z = y.copy()
            z[at] += (min(max(s, low), high) - s) / len(at)
            rest[k] = y - z
            w = z
        if np.abs(w - before).max() < 1e-10:
            break
    return w


def quadratic(cov: np.ndarray, gain: np.ndarray, lo: np.ndarray, hi: np.ndarray, groups: list | None = None, most: int = 1000) -> np.ndarray:
    """Weights that minimise w'Cw / 2 - gain'w within the bounds (accelerated projected gradient)."""
    n = len(gain)
    step = 1.0 / max(np.linalg.eigvalsh(cov)[-1], 1e-12)
    w = feasible(np.full(n, 1.0 / n), lo, hi, groups or [])
    y, t = w.copy(), 1.0
    for _ in range(most):
        new = feasible(y - step * (cov @ y - gain), lo, hi, groups or [])
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - w)
        if np.abs(new - w).max() < 1e-10:
            return new
        w, t = new, t2
    return w


def risk_budget(cov: np.ndarray, budget: np.ndarray, most: int = 1000) -> np.ndarray:
    """Weights whose shares of the variance equal ``budget``: cyclic coordinate descent on the convex log form."""
    n = len(budget)
    x = 1.0 / np.sqrt(np.maximum(np.diag(cov), 1e-300))
    for _ in range(most):
        before = x.copy()
        for i in range(n):
            rest = cov[i] @ x - cov[i, i] * x[i]
            x[i] = (-rest + np.sqrt(rest * rest + 4 * cov[i, i] * budget[i])) / (2 * cov[i, i])
        if np.abs(x - before).max() <= 1e-13 * np.abs(x).max():
            break
    return x / x.sum()
