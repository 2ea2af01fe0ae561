"""One query for each aggregate metric, by supplier, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics as M
from .views import RUNS_SQL, returns

_CAGR = "CASE WHEN product(1 + ret) <= 0 THEN -1 ELSE pow(product(1 + ret), 252.0 / count(*)) - 1 END"
_CAGR_F = _CAGR.replace("ret", "f")
_SD = "stddev_samp(ret)"
_SIDE = lambda w, n: _CAGR.replace("ret", n).replace(")", f") FILTER (WHERE f {w} 0)", 1).replace("pow(product(1 + " + n + ")", "pow(product(1 + " + n + f") FILTER (WHERE f {w} 0)").replace("count(*)", f"count(*) FILTER (WHERE f {w} 0)")
_DOWN = "sqrt(avg(pow(least(ret, 0), 2))) * sqrt(252)"
_BETA = "regr_slope(ret, f)"
_ALPHA = f"pow(1 + avg(ret) - {_BETA} * avg(f), 252) - 1"
_UP, _DN = "FILTER (WHERE f > 0)", "FILTER (WHERE f <= 0)"
_SKEW = "(avg(ret*ret*ret) - 3*avg(ret)*avg(ret*ret) + 2*pow(avg(ret),3)) / pow(var_pop(ret), 1.5)"
_KURT = "(avg(pow(ret,4)) - 4*avg(ret)*avg(pow(ret,3)) + 6*pow(avg(ret),2)*avg(ret*ret) - 3*pow(avg(ret),4)) / pow(var_pop(ret), 2) - 3"
_Q = lambda p: f"quantile_cont(ret, CAST({p} AS DOUBLE))"


def _two(x1: str, x2: str, of: int) -> str:
    s = {"s11": f"var_pop({x1})", "s22": f"var_pop({x2})", "s12": f"covar_pop({x1}, {x2})", "s1y": f"covar_pop({x1}, ret)", "s2y": f"covar_pop({x2}, ret)"}
    top = "{s11} * {s2y} - {s12} * {s1y}" if of == 2 else "{s22} * {s1y} - {s12} * {s2y}"
    return ("(" + top + ") / ({s11} * {s22} - {s12} * {s12})").format(**s)


_FF, _DUMMY, _POS, _NEG = "f*f", "CASE WHEN f < 0 THEN 1.0 ELSE 0.0 END", "greatest(f, 0.0)", "least(f, 0.0)"

SQL_EXPR: dict[str, str] = {
    "cum_returns_final": "product(1 + ret) - 1",
    "annual_return": _CAGR,
    "cagr": _CAGR,
    "annual_volatility": f"{_SD} * sqrt(252)",
    "downside_risk": _DOWN,
    "value_at_risk": _Q(0.05),
    "conditional_value_at_risk": "avg(ret) FILTER (WHERE ret <= cut)",
    "tail_ratio": f"abs({_Q(0.95)}) / nullif(abs({_Q(0.05)}), 0)",
    "trading_value_at_risk": f"avg(ret) - 2 * {_SD}",
    "var_excess_return": f"({_CAGR}) / nullif(abs({_Q(0.05)}), 0)",
    "tracking_error": "stddev_samp(ret - f) * sqrt(252)",
    "annual_active_risk": "stddev_samp(ret - f) * sqrt(252)",
    "residual_risk": f"sqrt(var_samp(ret) - {_BETA} * {_BETA} * var_samp(f)) * sqrt(252)",
    "sharpe_ratio": f"avg(ret) / {_SD} * sqrt(252)",
    "sortino_ratio": f"avg(ret) * 252 / ({_DOWN})",
    "excess_sharpe": "avg(ret - f) / stddev_samp(ret - f)",
    "adjusted_sharpe_ratio": f"avg(ret) / {_SD} * sqrt(252) * CASE WHEN count(*) < 20 THEN greatest(0.9, least(1.1, 1 + ({_SKEW}) / 6 * (avg(ret) / {_SD} * sqrt(252)) * least(1.0, count(*) / 50.0) - ({_KURT}) / 24 * pow(avg(ret) / {_SD} * sqrt(252), 2) * least(1.0, count(*) / 50.0))) ELSE greatest(0.8, least(1.3, 1 + ({_SKEW}) / 6 * (avg(ret) / {_SD} * sqrt(252)) * least(1.0, count(*) / 50.0) - ({_KURT}) / 24 * pow(avg(ret) / {_SD} * sqrt(252), 2) * least(1.0, count(*) / 50.0))) END",
    "conditional_sharpe_ratio": "CASE WHEN stddev_samp(ret) FILTER (WHERE ret <= cut) > 0 THEN avg(ret) FILTER (WHERE ret <= cut) / stddev_samp(ret) FILTER (WHERE ret <= cut) * sqrt(252) END",
    "calmar_ratio": f"CASE WHEN min(dd) < 0 THEN ({_CAGR}) / abs(min(dd)) END",
    "mar_ratio": "CASE WHEN min(dd) < 0 THEN avg(ret) * 252 / abs(min(dd)) END",
    "omega_ratio": "sum(greatest(ret, 0)) / nullif(sum(greatest(-ret, 0)), 0)",
    "information_ratio": "avg(ret - f) * 252 / (stddev_samp(ret - f) * sqrt(252))",
    "treynor_ratio": f"CASE WHEN {_BETA} > 0 THEN ({_CAGR}) / {_BETA} END",
    "cal_treynor_ratio": f"CASE WHEN {_BETA} > 0 THEN ({_CAGR}) / {_BETA} END",
    "m_squared": f"({_CAGR}) * stddev_samp(f) / {_SD}",
    "sterling_ratio": f"({_CAGR}) / abs(max(dd_mean))",
    "burke_ratio": f"({_CAGR}) / sqrt(max(dd_sumsq))",
    "kappa_three_ratio": "avg(ret) / cbrt(avg(pow(greatest(-ret, 0), 3)))",
    "common_sense_ratio": f"abs({_Q(0.95)}) / nullif(abs({_Q(0.05)}), 0) * avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) / (1 - avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END))",
    "stability_of_timeseries": "regr_r2(log_nav, rn)",
    "capture": f"({_CAGR}) / nullif({_CAGR_F}, 0)",
    "up_capture": f"({_SIDE('>', 'ret')}) / nullif({_SIDE('>', 'f')}, 0)",
    "down_capture": f"({_SIDE('<', 'ret')}) / nullif({_SIDE('<', 'f')}, 0)",
    "up_down_capture": f"(({_SIDE('>', 'ret')}) / nullif({_SIDE('>', 'f')}, 0)) / nullif(({_SIDE('<', 'ret')}) / nullif({_SIDE('<', 'f')}, 0), 0)",
    "up_capture_return": _SIDE(">", "ret"),
    "down_capture_return": _SIDE("<", "ret"),
    "beta": _BETA,
    "alpha": _ALPHA,
    "up_alpha": f"pow(1 + avg(ret) {_UP} - covar_samp(ret, f) {_UP} / var_samp(f) {_UP} * avg(f) {_UP}, 252) - 1",
    "up_beta": f"covar_samp(ret, f) {_UP} / var_samp(f) {_UP}",
    "down_alpha": f"pow(1 + avg(ret) {_DN} - covar_samp(ret, f) {_DN} / var_samp(f) {_DN} * avg(f) {_DN}, 252) - 1",
    "down_beta": f"covar_samp(ret, f) {_DN} / var_samp(f) {_DN}",
    "regression_annual_return": f"({_ALPHA}) + {_BETA} * ({_CAGR_F})",
    "treynor_mazuy_timing": _two("f", _FF, 2),
    "henriksson_merton_timing": _two("f", _DUMMY, 2),
    "market_timing_return": f"({_two('f', _FF, 2)}) * avg(f*f)",
    "cornell_timing": f"({_two(_POS, _NEG, 1)}) - ({_two(_POS, _NEG, 2)})",
    "skewness": _SKEW,
    "kurtosis": _KURT,
    "serial_correlation": "corr(ret, lagged)",
    "market_correlation": "corr(ret, f)",
    "stock_market_correlation": "corr(ret, f)",
    "bond_market_correlation": "corr(ret, f)",
    "futures_market_correlation": "corr(ret, f)",
    "win_rate": "avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END)",
    "loss_rate": "avg(CASE WHEN ret < 0 THEN 1.0 ELSE 0.0 END)",
    "relative_win_rate": "avg(CASE WHEN ret > f THEN 1.0 ELSE 0.0 END)",
    "r_cubed": "pow(corr(ret, f), 3)",
    "capm_r_squared": "pow(corr(ret, f), 2)",
    "tracking_difference": "product(1 + ret) - product(1 + f)",
    "max_drawdown": "min(dd)",
    "max_single_day_gain": "max(ret)",
    "max_single_day_loss": "min(ret)",
}
DATES = {"max_single_day_gain_date": ("DESC",), "max_single_day_loss_date": ("ASC",)}
NO_SQL = ("deflated_sharpe_ratio",)


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return M.compute(returns(spark, sf), [name]).select("sid", F.round(F.col(name).cast("double"), 7).alias(name))

    return run


def _date_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: M.compute(returns(spark, sf), [name]).select("sid", F.col(name).cast("string").alias(name))


QUERIES = {n: _query(n) for n in (*SQL_EXPR, *NO_SQL)} | {n: _date_query(n) for n in DATES}
SQL = {n: f"WITH {RUNS_SQL} SELECT sid, round(CAST({e} AS DOUBLE), 7) AS {n} FROM NV GROUP BY sid" for n, e in SQL_EXPR.items()} | {
    n: f"WITH {RUNS_SQL} SELECT sid, CAST(dt AS VARCHAR) AS {n} FROM (SELECT sid, dt, row_number() OVER (PARTITION BY sid ORDER BY ret {o}, dt) AS k FROM R) WHERE k = 1" for n, (o,) in DATES.items()
}
# The normal distribution function by its series: 1/2 + density x sum of z^(2k+1) / (2k+1)!!
SQL["deflated_sharpe_ratio"] = f"""WITH {RUNS_SQL}, S AS (SELECT sid, count(ret) AS n, CASE WHEN stddev_samp(ret) > 1e-15 THEN avg(ret) / stddev_samp(ret) ELSE 0 END AS sr,
        CASE WHEN stddev_pop(ret) = 0 THEN 0 ELSE ({_SKEW}) * sqrt(count(ret) * (count(ret) - 1.0)) / (count(ret) - 2.0) END AS g3,
        CASE WHEN count(ret) < 4 OR stddev_pop(ret) = 0 THEN 0 ELSE ((count(ret) + 1.0) * ({_KURT}) + 6) * (count(ret) - 1.0) / ((count(ret) - 2.0) * (count(ret) - 3.0)) END AS g4 FROM NV GROUP BY sid),
      Z AS (SELECT sid, CASE WHEN n < 3 THEN NULL WHEN 1 - g3 * sr + (g4 - 1) / 4 * sr * sr <= 0 THEN CASE WHEN sr > 0 THEN 40 ELSE -40 END ELSE sr * sqrt(n - 1.0) / sqrt(1 - g3 * sr + (g4 - 1) / 4 * sr * sr) END AS z FROM S),
      K AS (SELECT unnest(generate_series(0, 120)) AS k)
      SELECT sid, round(CASE WHEN z > 7 THEN 1 WHEN z < -7 THEN 0 ELSE 0.5 + sign(z) * exp(-z * z / 2) / sqrt(2 * pi()) * coalesce(sum(CASE WHEN z <> 0 THEN exp((2 * k + 1) * ln(abs(z)) - (lgamma(2 * k + 2) - k * ln(2) - lgamma(k + 1))) END), 0) END, 7) AS deflated_sharpe_ratio FROM Z, K GROUP BY sid, z"""
