"""Extreme value and volatility models, fitted one series at a time in grouped pandas functions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.solvers import nelder_mead
from ..functions.special import normal_ppf

EULER = 0.5772156649015329


def hill_estimator(df: DataFrame, threshold: float | None = None, tail: str = "upper") -> DataFrame:
    """sid, xi, exceedances: mean log excess over the smallest log excess; null under 10 exceedances. The threshold is
    the tail's 90th percentile unless given."""
    if tail not in ("upper", "lower"):
        raise ValueError("tail must be upper or lower")
    x = df.select("sid", (F.col("ret") if tail == "upper" else -F.col("ret")).alias("x")).where("x > 0")
    u = x.groupBy("sid").agg((F.percentile("x", F.lit(0.9)) if threshold is None else F.lit(threshold)).alias("u"))
    e = x.join(u, "sid").where("x > u").withColumn("l", F.ln(F.col("x") - F.col("u"))).groupBy("sid").agg(F.count(F.lit(1)).alias("exceedances"), (F.avg("l") - F.min("l")).alias("xi"))
    return e.select("sid", F.when(F.col("exceedances") >= 10, F.col("xi")).alias("xi"), "exceedances")


def gpd_pwm(df: DataFrame, threshold: float | None = None) -> DataFrame:
    """sid, xi, beta, threshold, n_exceed: generalised Pareto fit to loss excesses by probability-weighted moments."""
    x = df.select("sid", (-F.col("ret")).alias("x")).where("x > 0")
    u = x.groupBy("sid").agg((F.percentile("x", F.lit(0.9)) if threshold is None else F.lit(threshold)).alias("u"))
    from pyspark.sql import Window

    e = x.join(u, "sid").where("x > u").withColumn("e", F.col("x") - F.col("u")).withColumn("i", F.row_number().over(Window.partitionBy("sid").orderBy("e")))
    m = e.groupBy("sid").agg(F.first("u").alias("threshold"), F.count(F.lit(1)).alias("n_exceed"), F.avg("e").alias("m1"), F.sum(F.col("i") * F.col("e")).alias("ie")).where("n_exceed >= 10")
    m2 = 2.0 * F.col("ie") / (F.col("n_exceed") * F.col("n_exceed"))
    under = F.col("m1") - 2 * m2
    return m.select("sid", ((F.try_divide("m1", under) - 2) / 3).alias("xi"), F.try_divide(2 * F.col("m1") * m2, under).alias("beta"), "threshold", "n_exceed")


def fit_gpd(x: np.ndarray, threshold: float | None = None) -> dict[str, float]:
    """Maximum likelihood with shape in [-0.5, 1]; ValueError under 10 exceedances."""
    loss = -x[x < 0]
    if not len(loss):
        raise ValueError("no losses")
    u = float(np.percentile(loss, 90)) if threshold is None else threshold
    e = loss[loss > u] - u
    if len(e) < 10:
        raise ValueError("fewer than 10 exceedances")

    def cost(p: np.ndarray) -> float:
        xi, beta = p[0], math.exp(p[1])
        if not -0.5 <= xi <= 1.0:
            return 1e10
        if abs(xi) < 1e-10:
            return len(e) * math.log(beta) + e.sum() / beta
        z = 1 + xi * e / beta
        return 1e10 if (z <= 0).any() else len(e) * math.log(beta) + (1 + 1 / xi) * float(np.log(z).sum())

    p, _, _ = nelder_mead(cost, np.array([0.1, math.log(max(float(e.std()), 1e-6))]))
    return {"xi": float(p[0]), "beta": math.exp(p[1]), "threshold": u, "n_exceed": len(e)}


def fit_gev(x: np.ndarray, block_size: int | None = None) -> dict[str, float]:
    """Generalised extreme value fit to negated block minima; the shape's sign has positive for a bounded tail."""
    size = block_size or max(1, int(math.sqrt(len(x))))
    n = len(x) // size
    if n < 3:
        raise ValueError("too few blocks")
    m = -x[: n * size].reshape(n, size).min(axis=1)
    s0 = max(math.sqrt(6) * float(m.std()) / math.pi, 1e-9)

    def cost(p: np.ndarray) -> float:
        c, mu, s = p[0], p[1], math.exp(p[2])
        y = (m - mu) / s
        if abs(c) < 1e-8:
            return n * math.log(s) + float((y + np.exp(-y)).sum())
        t = 1 - c * y
        if (t <= 0).any():
            return 1e10
        l = np.log(t) / c
        return n * math.log(s) + float((np.exp(l) - (1 - c) * l).sum()) + 0.0

    p, _, _ = nelder_mead(cost, np.array([0.1, float(m.mean()) - EULER * s0, math.log(s0)]))
    return {"xi": float(p[0]), "mu": -float(p[1]), "sigma": math.exp(p[2]), "n_blocks": n}


def tail_risk(x: np.ndarray, alpha: float = 0.05, model: str = "gpd", tail: str = "lower", threshold: float | None = None, block_size: int | None = None) -> dict[str, float]:
    """VaR and CVaR of one series; the upper tail is that of the negated series."""
    if tail == "upper":
        r = tail_risk(-x, alpha, model, "lower", threshold, block_size)
        return r | {"var": -r["var"], "cvar": -r["cvar"]}
    if model == "gpd":
        f = fit_gpd(x, threshold)
        xi, b, u = f["xi"], f["beta"], f["threshold"]
        ratio = alpha / (f["n_exceed"] / len(x))
        var = u - b * math.log(ratio) if abs(xi) < 1e-10 else u + b / xi * (ratio**-xi - 1)
        if xi >= 1:
            raise ValueError("the mean excess is infinite")
        return {"var": -var, "cvar": -(var + (b + xi * (var - u)) / (1 - xi)), "tail_index": xi, "threshold": u, "n_exceed": float(f["n_exceed"])}
    if model == "gev":
        f = fit_gev(x, block_size)
        xi, mu, s = f["xi"], f["mu"], f["sigma"]
        t = -math.log(alpha)
        var = mu - s * math.log(t) if abs(xi) < 1e-10 else mu + s / xi * (t**-xi - 1)
        if xi >= 1:
            raise ValueError("the mean excess is infinite")
        cvar = var - s * (1 + EULER) if abs(xi) < 1e-10 else var + s / xi * (1 - 1 / (1 - xi) + t**-xi / (1 - xi))
        return {"var": var, "cvar": cvar, "tail_index": xi, "threshold": mu, "n_exceed": float(f["n_blocks"])}
    raise ValueError("model must be gpd or gev")


def _grouped(df: DataFrame, columns: dict[str, str], fit) -> DataFrame:  # noqa: ANN001
    """Fit per series on its valid returns in date order; a series that cannot be fitted gets nulls."""
    kind = df.schema["sid"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("dt")["ret"].dropna().to_numpy(dtype=float)
        try:
            values = fit(x)
        except (ValueError, ZeroDivisionError, OverflowError, FloatingPointError, np.linalg.LinAlgError):
            values = {}
        return pd.DataFrame({"sid": [pdf["sid"].iloc[0]]} | {c: [values.get(c)] for c in columns})

    return df.select("sid", "dt", "ret").groupBy("sid").applyInPandas(run, f"sid {kind}, " + ", ".join(f"{c} {t}" for c, t in columns.items()))


def gpd_fit(df: DataFrame, threshold: float | None = None, method: str = "mle") -> DataFrame:
    if method == "pwm":
        return gpd_pwm(df, threshold)
    if method != "mle":
        raise ValueError("method must be mle or pwm")
    return _grouped(df, {"xi": "double", "beta": "double", "threshold": "double", "n_exceed": "int"}, lambda x: fit_gpd(x, threshold))


def gev_fit(df: DataFrame, block_size: int | None = None) -> DataFrame:
    return _grouped(df, {"xi": "double", "mu": "double", "sigma": "double", "n_blocks": "int"}, lambda x: fit_gev(x, block_size))


def extreme_risk(df: DataFrame, alpha: float = 0.05, model: str = "gpd", tail: str = "lower", threshold: float | None = None, block_size: int | None = None) -> DataFrame:
    """sid, var, cvar, tail_index, threshold, n_exceed."""
    return _grouped(df, dict.fromkeys(("var", "cvar", "tail_index", "threshold", "n_exceed"), "double"), lambda x: tail_risk(x, alpha, model, tail, threshold, block_size))


def gpd_risk(x: np.ndarray, var_p: float = 0.01) -> dict[str, float]:
    """Threshold (halved from 0.2 until a fit has positive shape and VaR), scale, shape, VaR and ES; zeros on failure."""
    loss = -x[x < 0]
    u = 0.2
    while len(x) >= 3 and u > 1e-9:
        e = loss[loss >= u]
        if len(e):

            def cost(p: np.ndarray, e: np.ndarray = e) -> float:
                scale, shape = p
                if shape == 0:
                    return len(e) * math.log(scale) + e.sum() / scale if scale > 0 else 1e300
                if scale <= 0 or shape / scale < 0:
                    return 1e300
                return len(e) * math.log(scale) + (1 / shape + 1) * float(np.log(shape / scale * e + 1).sum())

            p, _, good = nelder_mead(cost, np.array([1.0, 1.0]), scale=0.05)
            if good and p[1] > 0:
                var = u + p[0] / p[1] * ((len(loss) / len(e) * var_p) ** -p[1] - 1)
                if var > 0:
                    es = var / (1 - p[1]) + (p[0] - p[1] * u) / (1 - p[1]) if p[1] != 1 else 0.0
                    return {"threshold": u, "scale": float(p[0]), "shape": float(p[1]), "var": float(var), "es": float(es)}
        u /= 2
    return dict.fromkeys(("threshold", "scale", "shape", "var", "es"), 0.0)


def gpd_risk_estimates(df: DataFrame, var_p: float = 0.01) -> DataFrame:
    return _grouped(df, dict.fromkeys(("threshold", "scale", "shape", "var", "es"), "double"), lambda x: gpd_risk(x, var_p))


# ---- conditional volatility

KINDS = ("GARCH", "EGARCH", "GJRGARCH")


def _variance(x: np.ndarray, kind: str, p: np.ndarray) -> np.ndarray:
    s = np.empty(len(x))
    s[0] = x.var()
    if kind == "EGARCH":
        w, a, g, b = p
        mean_abs = math.sqrt(2 / math.pi)
        h = math.log(max(s[0], 1e-300))
        for t in range(1, len(x)):
            z = x[t - 1] / math.sqrt(s[t - 1])
            h = w + b * h + a * (abs(z) - mean_abs) + g * z
            s[t] = math.exp(min(max(h, -60.0), 20.0))
        return s
    w, a, g, b = (p[0], p[1], 0.0, p[2]) if kind == "GARCH" else p
    x2 = x * x
    lift = a + g * (x < 0)
    for t in range(1, len(x)):
        s[t] = w + lift[t - 1] * x2[t - 1] + b * s[t - 1]
    return s


def fit_garch(x: np.ndarray, kind: str = "GARCH") -> dict[str, object]:
    """Gaussian maximum likelihood of a (1, 1) model on the demeaned returns: parameters, last variance, log-likelihood."""
    if kind not in KINDS:
        raise ValueError(f"model must be one of {KINDS}")
    if len(x) < 10:
        raise ValueError("too few returns")
    x = x - x.mean()
    v = max(float(x.var()), 1e-18)

    def unpack(q: np.ndarray) -> np.ndarray:
        if kind == "EGARCH":
            return np.array([q[0], q[1], q[2], math.tanh(q[3])])
        e = np.exp(np.clip(q, -50, 50))
        room = 1 + e[1] + e[2] + (e[3] if kind == "GJRGARCH" else 0.0)
        if kind == "GARCH":
            return np.array([v * e[0], e[1] / room, e[2] / room])
        return np.array([v * e[0], e[1] / room, 2 * e[2] / room, e[3] / room])

    def cost(q: np.ndarray) -> float:
        s = _variance(x, kind, unpack(q))
        if not np.isfinite(s).all() or (s <= 0).any():
            return 1e12
        return 0.5 * float((np.log(2 * math.pi * s) + x * x / s).sum())

    start = {"GARCH": [math.log(0.05), math.log(1.0), math.log(17.0)], "GJRGARCH": [math.log(0.05), 0.0, -1.0, math.log(17.0)], "EGARCH": [0.1 * math.log(v), 0.1, 0.0, math.atanh(0.9)]}[kind]
    q, value, _ = nelder_mead(cost, np.array(start), most=600)
    p = unpack(q)
    s = _variance(x, kind, p)
    names = ("omega", "alpha", "beta") if kind == "GARCH" else ("omega", "alpha", "gamma", "beta")
    return dict(zip(names, map(float, p), strict=True)) | {"gamma": float(p[2]) if kind != "GARCH" else 0.0, "last_variance": float(s[-1]), "last_return": float(x[-1]), "log_likelihood": -value}


def forecast(fit: dict[str, object], kind: str, horizon: int) -> list[float]:
    """Variances of the next steps: the first from the last return, later ones from their expectation."""
    w, a, g, b, s, x = (fit[k] for k in ("omega", "alpha", "gamma", "beta", "last_variance", "last_return"))
    if kind == "EGARCH":
        z = x / math.sqrt(s)
        h = w + b * math.log(s) + a * (abs(z) - math.sqrt(2 / math.pi)) + g * z
        out = [h]
        for _ in range(horizon - 1):
            out.append(w + b * out[-1])
        return [math.exp(v) for v in out]
    out = [w + (a + (g if x < 0 else 0.0)) * x * x + b * s]
    for _ in range(horizon - 1):
        out.append(w + (a + g / 2 + b) * out[-1])
    return out


def garch_fit(df: DataFrame, model: str = "GARCH") -> DataFrame:
    """sid, omega, alpha, gamma, beta, last_variance, log_likelihood."""
    return _grouped(df, dict.fromkeys(("omega", "alpha", "gamma", "beta", "last_variance", "log_likelihood"), "double"), lambda x: fit_garch(x, model))


def forecast_volatility(df: DataFrame, model: str = "GARCH", horizon: int = 1) -> DataFrame:
    """sid, step, volatility."""
    out = _grouped(df, {"v": "array<double>"}, lambda x: {"v": [math.sqrt(s) for s in forecast(fit_garch(x, model), model, horizon)]})
    return out.select("sid", F.posexplode("v").alias("step", "volatility")).withColumn("step", F.col("step") + 1)


def conditional_var(df: DataFrame, model: str = "GARCH", alpha: float = 0.05) -> DataFrame:
    """sid, conditional_var: the normal quantile times the next step's volatility."""
    return forecast_volatility(df, model, 1).select("sid", (F.col("volatility") * normal_ppf(alpha)).alias("conditional_var"))
