"""Posterior sampling of return models by random-walk Metropolis, chains spread over tasks."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LogDensity = Callable[[np.ndarray], float]


def _t_log(x: np.ndarray, nu: float, mu: np.ndarray | float, s: float) -> float:
    z = (x - mu) / s
    return len(x) * (math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(nu * math.pi) - math.log(s)) - (nu + 1) / 2 * float(np.log1p(z * z / nu).sum())


def sample(log_density: LogDensity, start: np.ndarray, scale: np.ndarray, draws: int, rng: np.random.Generator) -> np.ndarray:
    """Draws after as many warm-up steps, during which the step size is tuned to accept about a third."""
    x, at = start.copy(), log_density(start)
    out, step, hits = np.empty((draws, len(start))), 2.4 / math.sqrt(len(start)), 0
    for i in range(-draws, draws):
        y = x + step * scale * rng.standard_normal(len(x))
        v = log_density(y)
        if math.log(rng.uniform()) < v - at:
            x, at, hits = y, v, hits + 1
        if i < 0 and (i + draws + 1) % 50 == 0:
            step *= math.exp((hits / 50 - 0.33))
            hits = 0
        if i >= 0:
            out[i] = x
    return out


def _normal(x: np.ndarray, f: np.ndarray | None) -> tuple[LogDensity, np.ndarray, np.ndarray, list[str]]:
    m, s = x.mean(), x.std(ddof=1)
    log = lambda p: -len(x) * p[1] - 0.5 * float((((x - p[0]) / math.exp(p[1])) ** 2).sum()) - 0.5 * (p[0] / 0.01) ** 2
    return log, np.array([m, math.log(s)]), np.array([s / math.sqrt(len(x)), 1 / math.sqrt(2 * len(x))]), ["mean", "log_volatility"]


def _student(x: np.ndarray, f: np.ndarray | None) -> tuple[LogDensity, np.ndarray, np.ndarray, list[str]]:
    m, s = np.median(x), x.std(ddof=1)

    def log(p: np.ndarray) -> float:
        nu = 2 + math.exp(min(p[2], 6.0))
        return _t_log(x, nu, p[0], math.exp(p[1])) - math.exp(min(p[2], 6.0)) / 10 + p[2] - 0.5 * (p[0] / 0.01) ** 2

    return log, np.array([m, math.log(s) - 0.2, 1.5]), np.array([s / math.sqrt(len(x)), 1 / math.sqrt(len(x)), 0.3]), ["mean", "log_volatility", "log_nu_less_two"]


def _alpha_beta(x: np.ndarray, f: np.ndarray | None) -> tuple[LogDensity, np.ndarray, np.ndarray, list[str]]:
    if f is None:
        raise ValueError("alpha_beta needs a benchmark column f")
    b = np.cov(x, f)[0, 1] / f.var(ddof=1)
    a = x.mean() - b * f.mean()
    s = (x - a - b * f).std(ddof=2)

    def log(p: np.ndarray) -> float:
        nu = 2 + math.exp(min(p[3], 6.0))
        return _t_log(x, nu, p[0] + p[1] * f, math.exp(p[2])) - math.exp(min(p[3], 6.0)) / 10 + p[3] - 0.5 * (p[0] / 0.01) ** 2 - 0.5 * p[1] ** 2

    n = len(x)
    return log, np.array([a, b, math.log(s) - 0.2, 1.5]), np.array([s / math.sqrt(n), s / f.std() / math.sqrt(n), 1 / math.sqrt(n), 0.3]), ["alpha", "beta", "log_volatility", "log_nu_less_two"]


def _stochastic_volatility(x: np.ndarray, draws: int, rng: np.random.Generator) -> pd.DataFrame:
    """Log variance as a random walk, updated state by state; returns the mean volatility of each draw."""
    n = len(x)
    h = np.full(n, math.log(x.var() + 1e-12))
    q, x2 = 0.01, x * x
    out = np.empty((draws, 2))
    for i in range(-draws, draws):
        for start in (0, 1):  # neighbours of every other state are fixed: both halves move as vectors
            k = np.arange(start, n, 2)
            y = h[k] + math.sqrt(q) * 1.5 * rng.standard_normal(len(k))

            def log(v: np.ndarray, k: np.ndarray = k) -> np.ndarray:
                left = np.where(k > 0, v - h[np.maximum(k - 1, 0)], 0.0)
                right = np.where(k < n - 1, v - h[np.minimum(k + 1, n - 1)], 0.0)
                return -0.5 * v - 0.5 * x2[k] * np.exp(-v) - (left**2 + right**2) / (2 * q)

            take = np.log(rng.uniform(size=len(k))) < log(y) - log(h[k])
            h[k[take]] = y[take]
        d = np.diff(h)
        q = (0.01 + 0.5 * float((d * d).sum())) / rng.gamma(2 + 0.5 * len(d))
        if i >= 0:
            out[i] = float(np.exp(h / 2).mean()), math.sqrt(q)
    return pd.DataFrame(out, columns=["mean_volatility", "step"])


MODELS = {"normal": _normal, "t": _student, "alpha_beta": _alpha_beta}


def run_model(df: DataFrame, model: str, samples: int = 500, chains: int = 4, seed: int = 0) -> DataFrame:
    """sid, chain, draw, parameter, value: posterior draws of ``normal``, ``t``, ``alpha_beta`` or ``stoch_vol``.

    Each series and chain is a task of its own; it holds the series' values. Fewer than 10 values give no draws."""
    if model not in (*MODELS, "stoch_vol"):
        raise ValueError(f"model must be one of {sorted((*MODELS, 'stoch_vol'))}")
    has_f = model == "alpha_beta"
    if has_f and "f" not in df.columns:
        raise ValueError("alpha_beta needs a benchmark column f")
    ok = df.where("ret IS NOT NULL" + (" AND f IS NOT NULL" if has_f else ""))
    row = F.struct("dt", "ret", (F.col("f") if has_f else F.lit(0.0)).alias("f"))
    packed = ok.groupBy("sid").agg(F.array_sort(F.collect_list(row)).alias("v")).where(F.size("v") >= 10)
    tasks = packed.select("sid", F.transform("v", lambda v: v["ret"]).alias("x"), F.transform("v", lambda v: v["f"]).alias("f")).withColumn("chain", F.explode(F.sequence(F.lit(0), F.lit(chains - 1)))).repartition("sid", "chain")
    kind = df.schema["sid"].dataType.simpleString()

    def run(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            for sid, x, f, chain in zip(pdf["sid"], pdf["x"], pdf["f"], pdf["chain"], strict=True):
                x, f = np.asarray(x, dtype=float), np.asarray(f, dtype=float)
                rng = np.random.default_rng([seed, int(chain)])
                if model == "stoch_vol":
                    wide = _stochastic_volatility(x - x.mean(), samples, rng)
                else:
                    log, start, scale, names = MODELS[model](x, f if has_f else None)
                    wide = pd.DataFrame(sample(log, start, scale, samples, rng), columns=names)
                wide["draw"] = range(len(wide))
                long = wide.melt("draw", var_name="parameter", value_name="value")
                long.insert(0, "chain", int(chain))
                long.insert(0, "sid", sid)
                yield long

    return tasks.mapInPandas(run, f"sid {kind}, chain int, draw int, parameter string, value double")


def compare_groups(df: DataFrame, a: object, b: object, samples: int = 1000, seed: int = 0) -> DataFrame:
    """parameter, mean, p5, p95, above_zero: posterior of the differences a - b of the Student-t parameters."""
    draws = run_model(df.where(F.col("sid").isin(a, b)), "t", samples, seed=seed)
    wide = draws.groupBy("chain", "draw", "parameter").agg((F.max(F.when(F.col("sid") == F.lit(a), F.col("value"))) - F.max(F.when(F.col("sid") == F.lit(b), F.col("value")))).alias("d"))
    return wide.groupBy("parameter").agg(F.avg("d").alias("mean"), F.percentile("d", F.lit(0.05)).alias("p5"), F.percentile("d", F.lit(0.95)).alias("p95"), F.avg((F.col("d") > 0).cast("double")).alias("above_zero"))


def posterior_paths(draws: DataFrame, num_days: int, seed: int = 0) -> DataFrame:
    """sid, path, step, ret: one predictive path per posterior draw of the normal or Student-t model."""
    from .simulate import normal

    p = draws.groupBy("sid", "chain", "draw").pivot("parameter", ["mean", "log_volatility", "log_nu_less_two"]).agg(F.first("value"))
    steps = p.withColumn("path", F.concat_ws("-", "chain", "draw")).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(num_days))))
    z = normal(seed, "path", "step")
    # a Student-t draw as a normal one over the root of a scaled chi-square (Wilson-Hilferty)
    nu = 2 + F.exp("log_nu_less_two")
    chi = F.pow(F.greatest(1 - 2 / (9 * nu) + normal(seed + 1, "path", "step") * F.sqrt(2 / (9 * nu)), F.lit(0.05)), F.lit(3.0))
    return steps.select("sid", "path", "step", (F.col("mean") + F.exp("log_volatility") * F.when(F.col("log_nu_less_two").isNull(), z).otherwise(z / F.sqrt(chi))).alias("ret"))
