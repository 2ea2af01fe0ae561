"""Attribution: factor exposures, Brinson effects, factor regressions, style tilts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions.special import t_sf
from . import series

# Factor sets.
FACTOR_SETS = {"3factor": ["MKT", "SMB", "HML"], "5factor": ["MKT", "SMB", "HML", "RMW", "CMA"], "4factor_mom": ["MKT", "SMB", "HML", "MOM"]}


def compute_exposures(positions: DataFrame, loadings: DataFrame) -> DataFrame:
    """dt, factor, exposure: sum of position weight x loading."""
    return positions.join(loadings, ["dt", "symbol"]).groupBy("dt", "factor").agg(F.sum(F.col("value") * F.col("loading")).alias("exposure"))


def missing_loadings(positions: DataFrame, loadings: DataFrame) -> DataFrame:
    return positions.where("symbol <> 'cash'").select("symbol").distinct().join(loadings.select("symbol").distinct(), "symbol", "left_anti")


def perf_attrib(returns: DataFrame, positions: DataFrame, factor_returns: DataFrame, loadings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(by factor: dt, factor, exposure, contribution, tilt; by day: dt, total, common, specific, tilt, timing).

    ``positions`` (dt, symbol, value) hold weights; days and symbols without loadings drop out. A factor's tilt is its
    mean exposure times the day's factor return; timing is what is common beyond tilt."""
    exposure = compute_exposures(positions, loadings).join(returns.select("dt"), "dt", "left_semi")
    mean = exposure.groupBy("factor").agg(F.avg("exposure").alias("mean_exposure"))
    by = exposure.join(factor_returns.withColumnRenamed("ret", "fr"), ["dt", "factor"]).join(mean, "factor")
    by = by.select("dt", "factor", "exposure", (F.col("exposure") * F.col("fr")).alias("contribution"), (F.col("mean_exposure") * F.col("fr")).alias("tilt"))
    daily = by.groupBy("dt").agg(F.sum("contribution").alias("common"), F.sum("tilt").alias("tilt"))
    j = returns.join(daily, "dt")
    total = F.col("ret")
    return by, j.select("dt", total.alias("total"), "common", (total - F.col("common")).alias("specific"), "tilt", (F.col("common") - F.col("tilt")).alias("timing"))


def perf_attrib_stats(by_factor: DataFrame, by_day: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row of annualised and cumulative returns; one row per factor)."""
    long = by_day.select("dt", F.explode(F.create_map(F.lit("total"), "total", F.lit("common"), "common", F.lit("specific"), "specific")).alias("sid", "ret"))
    one = M.compute(long, ["annual_return", "cum_returns_final", "sharpe_ratio"])
    per = by_factor.select(F.col("factor").alias("sid"), "dt", F.col("contribution").alias("ret"), "exposure")
    stats = M.compute(per, ["annual_return", "cum_returns_final"]).join(per.groupBy("sid").agg(F.avg("exposure").alias("average_exposure")), "sid")
    return one.withColumnRenamed("sid", "part"), stats.withColumnRenamed("sid", "factor")


def returns_less_costs(returns: DataFrame, costs: DataFrame) -> DataFrame:
    """Cumulative returns after costs (dt, cost)."""
    net = returns.join(costs, "dt", "left").withColumn("ret", F.col("ret") - F.coalesce("cost", F.lit(0.0)))
    return M.with_nav(net, ["sid"]).select("sid", "dt", (F.col("nav") - 1).alias("cum"))


def brinson(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per period: allocation, selection, interaction, total, portfolio_return, benchmark_return, active_return.

    ``df``: period..., group, rp, rb, wp, wb."""
    rp, rb, wp, wb = (F.col(c) for c in ("rp", "rb", "wp", "wb"))
    s = lambda c: F.sum(c)
    a, b, c = s((wp - wb) * rb), s(wb * (rp - rb)), s((wp - wb) * (rp - rb))
    return df.groupBy(*(keys or ["dt"])).agg(
        a.alias("allocation"), b.alias("selection"), c.alias("interaction"), (a + b + c).alias("total"), s(wp * rp).alias("portfolio_return"), s(wb * rb).alias("benchmark_return"), (s(wp * rp) - s(wb * rb)).alias("active_return")
    )


def brinson_cumulative(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Effects summed over periods, returns compounded."""
    per = brinson(df, keys)
    p, b = F.product(1 + F.col("portfolio_return")) - 1, F.product(1 + F.col("benchmark_return")) - 1
    return per.agg(*(F.sum(c).alias(c) for c in ("allocation", "selection", "interaction", "total")), p.alias("portfolio_cumulative"), b.alias("benchmark_cumulative"), (p - b).alias("active_cumulative"))


def sector_rollup(df: DataFrame, sectors: DataFrame, agg: str = "sum") -> DataFrame:
    """dt, group, value by sector, summed or averaged."""
    if agg not in ("sum", "mean"):
        raise ValueError("agg must be sum or mean")
    fn = F.sum if agg == "sum" else F.avg
    return df.join(sectors, "symbol").groupBy("dt", F.col("sector").alias("group")).agg(fn("value").alias("value"))


# ---- factor regression from distributed moments


def _moments(df: DataFrame, factors: list[str], keys: list[str]) -> DataFrame:
    """One row per key: n, sums and cross products of y and the factors over complete rows."""
    cols = ["ret", *factors]
    ok = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in cols))
    aggs = [F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(f"s_{c}") for c in cols)]
    aggs += [F.sum(F.col(a) * F.col(b)).alias(f"x_{a}_{b}") for i, a in enumerate(cols) for b in cols[i:]]
    return ok.groupBy(*keys).agg(*aggs)


def factor_regression(df: DataFrame, factors: list[str], keys: list[str] | None = None) -> DataFrame:
    """keys, n, alpha, betas (map), r_squared, std_errors, p_values (arrays, constant first): ordinary least squares.

    The cross products are summed in Spark; only the small normal equations are solved in Python. Rank-deficient data
    takes the least-norm solution; fewer rows than coefficients give null statistics."""
    keys = keys or ["sid"]
    k = len(factors) + 1
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys)
    schema = f"{kinds}, n long, alpha double, betas map<string,double>, r_squared double, std_errors array<double>, p_values array<double>"

    def solve(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                n = int(r["n"])
                x = np.empty((k, k))
                y = np.empty(k)
                x[0, 0], y[0] = n, r["s_ret"]
                for i, a in enumerate(factors, 1):
                    x[0, i] = x[i, 0] = r[f"s_{a}"]
                    y[i] = r[f"x_ret_{a}"]
                    for j, b in enumerate(factors[i - 1 :], i):
                        x[i, j] = x[j, i] = r[f"x_{a}_{b}"]
                inverse = np.linalg.pinv(x)
                b = inverse @ y
                total = r["x_ret_ret"] - r["s_ret"] ** 2 / n
                rest = max(r["x_ret_ret"] - b @ y, 0.0)
                fit = 1 - rest / total if total > 0 else 0.0
                errors = np.sqrt(np.maximum(np.diag(inverse) * rest / max(n - k, 1), 0))
                t = b / np.where(errors > 0, errors, 1e-10)
                p = [2 * t_sf(abs(float(v)), max(n - k, 1)) for v in t]
                rows.append((*(r[c] for c in keys), n, float(b[0]), dict(zip(factors, map(float, b[1:]), strict=True)), float(fit), list(map(float, errors)), p))
            yield pd.DataFrame(rows, columns=[*keys, "n", "alpha", "betas", "r_squared", "std_errors", "p_values"])

    return _moments(df, factors, keys).mapInPandas(solve, schema)


class FamaFrenchModel:
    """3-factor, 5-factor or 4-factor-momentum regression of ``ret`` on the factor columns of one frame."""

    def __init__(self, model_type: str = "5factor", risk_free_rate: float = 0.0, factors: list[str] | None = None) -> None:
        if factors is None and model_type not in FACTOR_SETS:
            raise ValueError(f"model_type must be one of {sorted(FACTOR_SETS)}")
        self.factors, self.risk_free_rate, self.fitted = factors or FACTOR_SETS[model_type], risk_free_rate, None

    def fit(self, df: DataFrame, keys: list[str] | None = None) -> DataFrame:
        self.keys, self.fitted = keys or ["sid"], factor_regression(df, self.factors, keys)
        return self.fitted

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds ``predicted``."""
        if self.fitted is None:
            raise ValueError("fit the model first")
        j = df.join(self.fitted.select(*self.keys, "alpha", "betas"), self.keys)
        value = F.col("alpha")
        for f in self.factors:
            value = value + F.col("betas")[f] * F.col(f)
        return j.withColumn("predicted", value).drop("alpha", "betas")

    def rolling_exposures(self, df: DataFrame, window: int) -> DataFrame:
        """sid, dt, alpha and betas over the complete rows among the last ``window`` (full windows only; null with fewer
        complete rows than coefficients). Moments come from two pieces of each window, see ``series.window_parts``."""
        cols = ["ret", *self.factors]
        data = df.select("sid", "dt", *(F.when(~F.isnan(c), F.col(c)).alias(c) for c in cols))
        ok = F.lit(True)
        for c in cols:
            ok = ok & F.col(c).isNotNull()
        own = {c: F.when(ok, F.col(c)) for c in cols}
        parts = {"pn": F.count(own["ret"]), **{f"p{i}": F.avg(own[c]) for i, c in enumerate(cols)}}
        parts |= {f"p{i}_{j}": F.covar_pop(own[cols[i]], own[cols[j]]) for i in range(len(cols)) for j in range(i, len(cols))}
        held = series.window_parts(series.window_shards(data, window), window, parts).where(F.col("rn") >= window)
        means = [series._mean("p", str(i)).alias(f"m{i}") for i in range(len(cols))]
        sums = [series._spread("p", f"{i}_{j}", str(i), str(j)).alias(f"c{i}_{j}") for i in range(len(cols)) for j in range(i, len(cols))]
        k, factors = len(self.factors), self.factors

        def solve(batches):  # noqa: ANN001, ANN202
            for pdf in batches:
                x, y = np.zeros((len(pdf), k, k)), np.zeros((len(pdf), k))
                for i in range(1, k + 1):
                    y[:, i - 1] = pdf[f"c0_{i}"]
                    for j in range(i, k + 1):
                        x[:, i - 1, j - 1] = x[:, j - 1, i - 1] = pdf[f"c{i}_{j}"]
                b = np.einsum("nij,nj->ni", np.linalg.pinv(x), y) if len(pdf) else np.empty((0, k))
                few = pdf["n"].to_numpy() < k + 1
                out = pdf[["sid", "dt"]].copy()
                out["alpha"] = pdf["m0"] - sum(b[:, i] * pdf[f"m{i + 1}"].to_numpy() for i in range(k))
                for i, name in enumerate(factors):
                    out[name] = b[:, i]
                out.loc[few, ["alpha", *factors]] = None
                yield out

        schema = f"sid {df.schema['sid'].dataType.simpleString()}, dt {df.schema['dt'].dataType.simpleString()}, alpha double, " + ", ".join(f"`{f}` double" for f in factors)
        return held.select("sid", "dt", series._number("p").alias("n"), *means, *sums).mapInPandas(solve, schema)

    def decomposition(self, df: DataFrame) -> DataFrame:
        """sid, alpha, contributions (map of beta x mean factor return), factor_return (their sum), unexplained."""
        fit = self.fit(df)
        means = df.groupBy("sid").agg(F.avg("ret").alias("mean_ret"), *(F.avg(f).alias(f"m_{f}") for f in self.factors))
        j = fit.join(means, "sid")
        parts = {f: F.col("betas")[f] * F.col(f"m_{f}") for f in self.factors}
        total = sum(parts.values(), F.lit(0.0))
        contributions = F.create_map(*[x for f, c in parts.items() for x in (F.lit(f), c)])
        return j.select("sid", "alpha", contributions.alias("contributions"), total.alias("factor_return"), (F.col("mean_ret") - self.risk_free_rate - F.col("alpha") - total).alias("unexplained"))


def idiosyncratic_risk(df: DataFrame, market: str = "MKT") -> DataFrame:
    """Root of the variance that beta times the market's variance leaves, at least 0."""
    b = M.slope(F.col("ret"), F.col(market))
    rest = F.var_pop("ret") - b * b * F.var_pop(market)
    return df.groupBy("sid").agg(F.sqrt(F.greatest(rest, F.lit(0.0))).alias("idiosyncratic_risk"))


# ---- styles


def style_exposures(returns: DataFrame, traits: DataFrame | None = None, momentum_window: int = 252) -> DataFrame:
    """sid, style, weight: equal shares of the assets on each side of the median of market cap (large, small) and of
    book-to-price (value, growth) from ``traits`` (sid, cap, btp), of the compounded recent return (momentum, reversal)
    and of volatility (high_vol, low_vol)."""
    w = Window.partitionBy("sid").orderBy(F.desc("dt"))
    recent = returns.withColumn("k", F.row_number().over(w)).where(F.col("k") <= momentum_window)
    base = returns.groupBy("sid").agg(F.stddev_samp("ret").alias("vol")).join(recent.groupBy("sid").agg((M.growth() - 1).alias("mom")), "sid")
    sides = [("mom", "momentum", "reversal"), ("vol", "high_vol", "low_vol")]
    if traits is not None:
        base = base.join(traits, "sid", "left")
        sides = [("cap", "large", "small"), ("btp", "value", "growth"), *sides]
    medians = base.agg(*(F.median(c).alias(f"m_{c}") for c, _, _ in sides))
    j = base.join(F.broadcast(medians))  # one row
    styles = F.array(*(F.when(F.col(c) >= F.col(f"m_{c}"), F.lit(hi)).when(F.col(c) < F.col(f"m_{c}"), F.lit(lo)) for c, hi, lo in sides))
    long = j.select("sid", F.explode(styles).alias("style")).where("style IS NOT NULL")
    return long.withColumn("weight", 1.0 / F.count(F.lit(1)).over(Window.partitionBy("style")))


def style_returns(returns: DataFrame, exposures: DataFrame) -> DataFrame:
    """dt, style, ret: weighted return of each style's assets."""
    return returns.join(exposures, "sid").groupBy("dt", "style").agg(F.sum(F.col("ret") * F.col("weight")).alias("ret"))


def style_summary(returns: DataFrame, exposures: DataFrame) -> DataFrame:
    return style_returns(returns, exposures).groupBy("style").agg(F.avg("ret").alias("ret"))


def style_tilts(returns: DataFrame, window: int = 252) -> DataFrame:
    """sid, dt, momentum_rank and volatility_rank: percentile rank (ties averaged) of the trailing return and volatility
    among the day's assets."""
    w = Window.partitionBy("sid").orderBy("dt").rowsBetween(-(window - 1), 0)
    # rounded, so that equal values tie whatever the order of summation
    even = lambda c: F.round(c + 3.7e-11, 9)
    day = returns.withColumn("mom", even(F.product(1 + F.coalesce("ret", F.lit(0.0))).over(w) - 1)).withColumn("vol", even(F.stddev_samp("ret").over(w))).withColumn("n", F.count(F.lit(1)).over(w)).where(F.col("n") == window)

    def average_rank(c: str):  # noqa: ANN202
        d = Window.partitionBy("dt").orderBy(c)
        return (F.rank().over(d) + (F.count(F.lit(1)).over(Window.partitionBy("dt", c)) - 1) / 2) / F.count(F.lit(1)).over(Window.partitionBy("dt"))

    return day.select("sid", "dt", average_rank("mom").alias("momentum_rank"), average_rank("vol").alias("volatility_rank"))


def regression_attribution(portfolio: DataFrame, styles: DataFrame) -> DataFrame:
    """style, attribution: correlation with the portfolio (dt, ret) times the style's mean return; the rest is 'residual'."""
    j = styles.withColumnRenamed("ret", "f").join(portfolio.select("dt", "ret"), "dt")
    per = j.groupBy("style").agg((M.correlation(F.col("f"), F.col("ret")) * F.avg("f")).alias("attribution"))
    total = portfolio.agg(F.avg("ret").alias("mean"))
    rest = per.agg(F.sum("attribution").alias("s")).join(F.broadcast(total)).select(F.lit("residual").alias("style"), (F.col("mean") - F.coalesce("s", F.lit(0.0))).alias("attribution"))
    return per.unionByName(rest)
