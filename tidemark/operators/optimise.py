"""Portfolio optimisation: moments summed in Spark, small programs solved in numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.solvers import quadratic, risk_budget


class OptimizationError(RuntimeError):
    """No solution; carries what the solver said."""

    def __init__(self, message: str, status: int | None = None, solver_message: str | None = None) -> None:
        super().__init__(message)
        self.status, self.solver_message = status, solver_message


def moments(df: DataFrame, most_assets: int = 2000) -> tuple[list, np.ndarray, np.ndarray]:
    """Assets, mean returns and covariance over the days on which every asset has a return.

    Days are gathered as vectors and each task sums their outer products, so only an assets x assets matrix reaches the
    driver; ``most_assets`` bounds it."""
    assets = [r[0] for r in df.select("sid").distinct().orderBy("sid").limit(most_assets + 1).collect()]
    if len(assets) > most_assets:
        raise ValueError(f"more than {most_assets} assets")
    n = len(assets)
    if n == 0:
        raise ValueError("no assets")
    days = df.where("ret IS NOT NULL").groupBy("dt").agg(F.array_sort(F.collect_list(F.struct("sid", "ret"))).alias("v")).where(F.size("v") == n).select(F.transform("v", lambda x: x["ret"]).alias("x"))

    def sums(batches):  # noqa: ANN001, ANN202
        c, s, g = 0, np.zeros(n), np.zeros((n, n))
        for pdf in batches:
            x = np.array([np.asarray(v) for v in pdf["x"]])
            if len(x):
                c, s, g = c + len(x), s + x.sum(axis=0), g + x.T @ x
        yield pd.DataFrame({"c": [c], "s": [s], "g": [g.ravel()]})

    # one row a task, added up on executors in a tree of at most 64 branches
    parts = days.mapInPandas(sums, "c long, s array<double>, g array<double>")

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"c": [pdf["c"].sum()], "s": [np.sum(list(pdf["s"]), axis=0)], "g": [np.sum(list(pdf["g"]), axis=0)]})

    few = parts.withColumn("b", F.pmod(F.spark_partition_id(), F.lit(64))).groupBy("b").applyInPandas(total, "c long, s array<double>, g array<double>")
    # and those once more, so that one matrix comes to the driver
    rows = few.withColumn("b", F.lit(0)).groupBy("b").applyInPandas(total, "c long, s array<double>, g array<double>").collect()
    c = sum(r["c"] for r in rows)
    if c < 2:
        raise ValueError("fewer than two common days")
    s, g = np.sum([r["s"] for r in rows], axis=0), np.sum([r["g"] for r in rows], axis=0).reshape(n, n)
    mean = s / c
    return assets, mean, (g - c * np.outer(mean, mean)) / (c - 1)


def normalize_weights(w: np.ndarray, epsilon: float = 1e-12) -> np.ndarray:
    """Weights summing to 1, near-zero ones set to 0."""
    w = np.where(np.abs(w) < epsilon, 0.0, w)
    total = w.sum()
    if abs(total) < epsilon:
        raise OptimizationError("weights sum to zero")
    return w / total


class Programs:
    """Solutions for given annual moments and bounds."""

    def __init__(self, mean: np.ndarray, cov: np.ndarray, risk_free: float = 0.0, short: bool = False, max_weight: float = 1.0, min_weight: float | None = None, groups: list | None = None) -> None:
        n = len(mean)
        low = min_weight if min_weight is not None else (-max_weight if short else 0.0)
        if max_weight * n < 1 - 1e-12 or low * n > 1 + 1e-12:
            raise OptimizationError("the weight bounds leave no portfolio")
        self.mean, self.cov, self.rf = mean, cov + np.eye(n) * 1e-14, risk_free
        self.lo, self.hi, self.groups = np.full(n, low), np.full(n, max_weight), groups or []

    def at(self, taste: float) -> np.ndarray:
        """The portfolio that minimises variance / 2 - taste x return."""
        return quadratic(self.cov, taste * self.mean, self.lo, self.hi, self.groups)

    def figures(self, w: np.ndarray) -> tuple[float, float, float]:
        r, v = float(w @ self.mean), float(np.sqrt(max(w @ self.cov @ w, 0.0)))
        return r, v, (r - self.rf) / v if v > 0 else float("nan")

    def _search(self, reached) -> np.ndarray:  # noqa: ANN001
        """The least taste at which ``reached`` holds (it holds from some taste on)."""
        lo, hi = 0.0, 1e-3
        if reached(self.at(0.0)):
            return self.at(0.0)
        while not reached(self.at(hi)):
            lo, hi = hi, hi * 4
            if hi > 1e9:
                raise OptimizationError("the target cannot be met within the bounds")
        for _ in range(40):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if reached(self.at(mid)) else (mid, hi)
        return self.at(hi)

    def target_return(self, target: float) -> np.ndarray:
        return self._search(lambda w: w @ self.mean >= target - 1e-7 * max(abs(target), 1e-3))

    def target_risk(self, target: float) -> np.ndarray:
        if self.figures(self.at(0.0))[1] > target + 1e-12:
            raise OptimizationError("the target risk lies below the least risk")
        try:
            return self._search(lambda w: self.figures(w)[1] >= target - 1e-10)
        except OptimizationError:
            return self.at(1e9)

    def max_sharpe(self) -> np.ndarray:
        tastes = np.concatenate([[0.0], np.geomspace(1e-3, 1e3, 31)])
        best = max(tastes, key=lambda t: self.figures(self.at(t))[2])
        lo, hi = best / 1.6, best * 1.6
        for _ in range(20):
            a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
            lo, hi = (a, hi) if self.figures(self.at(a))[2] < self.figures(self.at(b))[2] else (lo, b)
        return max((self.at(t) for t in (best, (lo + hi) / 2)), key=lambda w: self.figures(w)[2])


def _answer(assets: list, w: np.ndarray, p: Programs) -> dict[str, object]:
    r, v, s = p.figures(w)
    return {"weights": dict(zip(assets, map(float, normalize_weights(w)), strict=True)), "expected_return": r, "volatility": v, "sharpe": s}


def optimize(df: DataFrame, objective: str = "max_sharpe", risk_free_rate: float = 0.0, target_return: float | None = None, target_volatility: float | None = None, short_allowed: bool = False, max_weight: float = 1.0, min_weight: float | None = None, sector_constraints: dict[str, tuple[float, float]] | None = None, sector_map: dict | None = None) -> dict[str, object]:
    """weights, expected_return, volatility, sharpe (annual) for max_sharpe, min_variance, target_return or target_risk."""
    assets, mean, cov = moments(df)
    groups = []
    for name, (low, high) in (sector_constraints or {}).items():
        at = np.array([i for i, a in enumerate(assets) if (sector_map or {}).get(a) == name])
        if len(at):
            groups.append((at, low, high))
    p = Programs(mean * 252, cov * 252, risk_free_rate, short_allowed, max_weight, min_weight, groups)
    if objective == "min_variance":
        w = p.at(0.0)
    elif objective == "max_sharpe":
        w = p.max_sharpe()
    elif objective == "target_return" and target_return is not None:
        w = p.target_return(target_return)
    elif objective == "target_risk" and target_volatility is not None:
        w = p.target_risk(target_volatility)
    else:
        raise ValueError("objective must be max_sharpe, min_variance, target_return or target_risk, with its target")
    return _answer(assets, w, p)


def efficient_frontier(df: DataFrame, n_points: int = 50, risk_free_rate: float = 0.0, short_allowed: bool = False, max_weight: float = 1.0) -> DataFrame:
    """kind (min_variance, max_sharpe, frontier), point, target, expected_return, volatility, sharpe, weights (map).

    Frontier points are solved on executors, one a row; a target that cannot be met has nulls."""
    spark = df.sparkSession
    assets, mean, cov = moments(df)
    p = Programs(mean * 252, cov * 252, risk_free_rate, short_allowed, max_weight)
    least, best = p.at(0.0), p.max_sharpe()
    low, high = float(least @ p.mean), float(p.at(1e9) @ p.mean)
    names = [str(a) for a in assets]

    def row(kind: str, k: int, target: float | None, w: np.ndarray | None) -> tuple:
        if w is None:
            return kind, k, target, None, None, None, None
        r, v, s = p.figures(w)
        return kind, k, target, r, v, s, dict(zip(names, map(float, w), strict=True))

    def solve(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            out = []
            for k in pdf["id"]:
                target = low + (high - low) * k / max(n_points - 1, 1)
                try:
                    w = p.target_return(target)
                except OptimizationError:
                    w = None
                out.append(row("frontier", int(k), target, w))
            yield pd.DataFrame(out, columns=["kind", "point", "target", "expected_return", "volatility", "sharpe", "weights"])

    schema = "kind string, point int, target double, expected_return double, volatility double, sharpe double, weights map<string,double>"
    first = spark.createDataFrame([row("min_variance", 0, None, least), row("max_sharpe", 0, None, best)], schema)
    return first.unionByName(spark.range(n_points).repartition(max(1, min(n_points, 64))).mapInPandas(solve, schema))


def risk_parity(df: DataFrame, budget: dict | None = None, max_iter: int = 1000) -> dict[str, object]:
    """weights and risk_shares (each asset's part of the variance), equal or as budgeted."""
    assets, _, cov = moments(df)
    b = np.array([float((budget or {}).get(a, 1.0)) for a in assets])
    if (b <= 0).any():
        raise OptimizationError("budgets must be positive")
    w = risk_budget(cov * 252 + np.eye(len(b)) * 1e-14, b / b.sum(), max_iter)
    part = w * (cov @ w)
    return {"weights": dict(zip(assets, map(float, w), strict=True)), "risk_shares": dict(zip(assets, map(float, part / part.sum()), strict=True)), "volatility": float(np.sqrt(w @ cov @ w * 252))}
