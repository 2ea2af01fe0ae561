"""Aggregate columns over long-form returns ``(keys..., dt, ret[, f])``; ``f`` is the aligned benchmark.

Each builder returns one Column for ``groupBy(keys).agg``. Missing returns are null (ingest turns NaN to null). Undefined
results are null; infinite ones are infinite where the definition says so. Some builders read columns that
``prepare`` adds: ``nav`` (compounded growth), ``dd`` (drawdown with the start as a peak), ``log_nav``, ``rn``, ``cut``
(the cutoff percentile), and the per-key statistics ``dd_mean``, ``dd_sumsq``, ``dd_runs`` over drawdown runs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .periods import annualization_factor
from .special import normal_cdf_array


def R() -> Column:
    return F.col("ret")


def B() -> Column:
    return F.col("f")


def INF() -> Column:
    return F.lit(float("inf"))


def div(a: Column, b: Column) -> Column:
    """Null on a zero divisor."""
    return F.try_divide(a, b)


def rows() -> Column:
    return F.count(F.lit(1))


def valid() -> Column:
    return F.count(R())


def both() -> Column:
    return R().isNotNull() & B().isNotNull()


def growth(r: Column | None = None) -> Column:
    """Compounded growth of what is not null; 1 for nothing."""
    return F.coalesce(F.product(1 + (R() if r is None else r)), F.lit(1.0))


def cagr(r: Column, n: Column, ann: float) -> Column:
    end = growth(r)
    return F.when(n < 1, None).when(end <= 0, F.lit(-1.0)).otherwise(F.pow(end, ann / n) - 1)


@dataclass(frozen=True)
class Metric:
    """``build(**params)`` gives the aggregate column; ``needs`` names what ``prepare`` must add."""

    build: Callable[..., Column]
    needs: frozenset[str] = field(default_factory=frozenset)
    doc: str = ""


REGISTRY: dict[str, Metric] = {}


def metric(*needs: str, name: str | None = None) -> Callable:
    def add(fn: Callable[..., Column]) -> Callable[..., Column]:
        REGISTRY[name or fn.__name__] = Metric(fn, frozenset(needs), (fn.__doc__ or "").strip())
        return fn

    return add


# ---- returns and risk


@metric()
def cum_returns_final(starting_value: float = 0.0, **_: object) -> Column:
    """Compounded total, missing returns skipped."""
    total = F.when(valid() > 0, growth())
    return total - 1 if starting_value == 0 else total * starting_value


@metric()
def annual_return(period: str = "daily", annualization: float | None = None, **_: object) -> Column:
    """Compound annual growth; missing rows count as periods; -1 once everything is lost."""
    return cagr(R(), rows(), annualization_factor(period, annualization))


REGISTRY["cagr"] = REGISTRY["annual_return"]


@metric()
def annual_volatility(period: str = "daily", annualization: float | None = None, volatility_power: float = 2.0, **_: object) -> Column:
    return F.stddev_samp(R()) * math.pow(annualization_factor(period, annualization), 1.0 / volatility_power)


@metric()
def downside_risk(required_return: float = 0.0, period: str = "daily", annualization: float | None = None, **_: object) -> Column:
    if not math.isfinite(required_return):
        return F.lit(None).cast("double") + F.sum(R()) * 0
    low = F.when(R().isNotNull(), F.least(R() - required_return, F.lit(0.0)))
    return F.sqrt(F.avg(low * low)) * math.sqrt(annualization_factor(period, annualization))


@metric()
def value_at_risk(cutoff: float = 0.05, **_: object) -> Column:
    """Linearly interpolated percentile; null if any return is missing."""
    if not 0 <= cutoff <= 1:
        return F.max(F.lit(None).cast("double"))
    return F.when(valid() == rows(), F.percentile(R(), F.lit(float(cutoff))))


@metric("cut")
def conditional_value_at_risk(**_: object) -> Column:
    """Mean of the returns at or below the value at risk."""
    return F.when(valid() == rows(), F.avg(F.when(F.col("cut") >= R(), R())))


@metric()
def tail_ratio(**_: object) -> Column:
    return div(F.abs(F.percentile(R(), F.lit(0.95))), F.abs(F.percentile(R(), F.lit(0.05))))


@metric()
def trading_value_at_risk(sigma: float = 2.0, **_: object) -> Column:
    return F.avg(R()) - sigma * F.stddev_samp(R())


@metric()
def var_excess_return(cutoff: float = 0.05, risk_free: float = 0.0, period: str = "daily", annualization: float | None = None, **_: object) -> Column:
    return div(annual_return(period, annualization) - risk_free, F.abs(value_at_risk(cutoff)))


@metric("f")
def tracking_error(period: str = "daily", annualization: float | None = None, **_: object) -> Column:
    return F.stddev_samp(R() - B()) * math.sqrt(annualization_factor(period, annualization))


REGISTRY["annual_active_risk"] = REGISTRY["tracking_error"]


@metric("f")
def residual_risk(risk_free: float = 0.0, period: str = "daily", annualization: float | None = None, **_: object) -> Column:
    """Volatility of what beta leaves unexplained: from the moments of the pairs."""
    r, f = F.when(both(), R()), F.when(both(), B())
    b = slope(R(), B())
    var = F.var_samp(r) - 2 * b * F.covar_samp(r, f) + b * b * F.var_samp(f)
    del risk_free  # a constant shift leaves it alone
    return F.sqrt(F.greatest(var, F.lit(0.0))) * math.sqrt(annualization_factor(period, annualization))


# ---- ratios


def _sharpe(x: Column, ann: float) -> Column:
    mean, sd = F.avg(x), F.stddev_samp(x)
    by = F.when(sd == 0, F.when(mean > 0, INF()).when(mean < 0, -INF())).otherwise(div(mean, sd))
    return F.when(F.count(x) >= 2, by * math.sqrt(ann))


@metric()
def sharpe_ratio(risk_free: float = 0.0, period: str = "daily", annualization: float | None = None, **_: object) -> Column:
    return _sharpe(R() - risk_free, annualization_factor(period, annualization))


@metric()
def sortino_ratio(required_return: float = 0.0, period: str = "daily", annualization: float | None = None, **_: object) -> Column:
    ann = annualization_factor(period, annualization)
    mean, risk = F.avg(R() - required_return) * ann, downside_risk(required_return, period, annualization)
    return F.when(rows() >= 2, F.when(risk == 0, F.when(mean > 0, INF()).when(mean < 0, -INF())).otherwise(div(mean, risk)))


@metric("f")
def excess_sharpe(**_: object) -> Column:
    sd = F.stddev_samp(R() - B())
    return F.when(sd >= 1e-15, div(F.avg(R() - B()), sd))


@metric()
def adjusted_sharpe_ratio(risk_free: float = 0.0, **_: object) -> Column:
    """Sharpe ratio corrected for skew and kurtosis, the correction damped for few rows and bounded."""
    n = rows()
    s = sharpe_ratio(risk_free)
    damp = F.least(F.lit(1.0), n / 50.0)
    raw = 1 + F.coalesce(skewness(), F.lit(0.0)) / 6 * s * damp - F.coalesce(kurtosis(), F.lit(0.0)) / 24 * s * s * damp
    few = F.greatest(F.lit(0.9), F.least(F.lit(1.1), raw))
    many = F.greatest(F.lit(0.8), F.least(F.lit(1.3), raw))
    return F.when(n >= 4, s * F.when(n < 20, few).otherwise(many))


@metric("cut")
def conditional_sharpe_ratio(risk_free: float = 0.0, period: str = "daily", annualization: float | None = None, **_: object) -> Column:
    tail = F.when(F.col("cut") >= R(), R())
    sd = F.stddev_samp(tail)
    return F.when((F.count(tail) >= 2) & (sd > 0), div(F.avg(tail) - risk_free, sd) * math.sqrt(annualization_factor(period, annualization)))


@metric("nav")
def calmar_ratio(risk_free: float = 0.0, period: str = "daily", annualization: float | None = None, **_: object) -> Column:
    return F.when(F.min("dd") < 0, div(annual_return(period, annualization) - risk_free, F.abs(F.min("dd"))))


@metric("nav")
def mar_ratio(period: str = "daily", annualization: float | None = None, **_: object) -> Column:
    return F.when(F.min("dd") < 0, div(F.avg(R()) * annualization_factor(period, annualization), F.abs(F.min("dd"))))


@metric()
def omega_ratio(risk_free: float = 0.0, required_return: float = 0.0, annualization: float = 252, **_: object) -> Column:
    if annualization == 1:
        floor = required_return
    elif required_return <= -1:
        return F.max(F.lit(None).cast("double"))
    else:
        floor = (1 + required_return) ** (1.0 / annualization) - 1
    x = R() - (risk_free + floor)
    gain, loss = F.coalesce(F.sum(F.when(x > 0, x)), F.lit(0.0)), F.sum(F.when(x < 0, -x))
    return F.when((rows() >= 2) & (loss > 0), div(gain, loss))


@metric("f")
def information_ratio(period: str = "daily", annualization: float | None = None, **_: object) -> Column:
    ann = annualization_factor(period, annualization)
    return div(F.avg(R() - B()) * ann, F.stddev_samp(R() - B()) * math.sqrt(ann))


@metric("f")
def treynor_ratio(risk_free: float = 0.0, period: str = "daily", annualization: float | None = None, **_: object) -> Column:
    b = beta(risk_free)
    return F.when(b > 0, div(annual_return(period, annualization) - risk_free, b))


REGISTRY["cal_treynor_ratio"] = REGISTRY["treynor_ratio"]


@metric("f")
def m_squared(risk_free: float = 0.0, period: str = "daily", annualization: float | None = None, **_: object) -> Column:
    own, other = F.stddev_samp(R()), F.stddev_samp(B())
    return F.when(own > 0, (annual_return(period, annualization) - risk_free) * div(other, own) + risk_free)


def _by_drawdown(risk: Column, other: Column, **p: object) -> Column:
    excess = annual_return(p.get("period", "daily"), p.get("annualization")) - p.get("risk_free", 0.0)
    by = F.when(F.max("dd_runs") > 0, risk).otherwise(other)
    return F.when(rows() >= 2, F.when(by < 1e-10, F.when(excess > 0, INF())).otherwise(div(excess, by)))


@metric("islands")
def sterling_ratio(**p: object) -> Column:
    """Excess growth over the mean drawdown run."""
    losses = F.avg(F.when(R() < 0, R()))
    return _by_drawdown(F.abs(F.max("dd_mean")), F.coalesce(F.abs(losses), F.greatest(F.stddev_pop(R()), F.lit(1e-10))), **p)


@metric("islands")
def burke_ratio(**p: object) -> Column:
    """Excess growth over the root of the summed squared drawdown runs."""
    losses = F.stddev_pop(F.when(R() < 0, R()))
    return _by_drawdown(F.sqrt(F.max("dd_sumsq")), F.coalesce(losses, F.greatest(F.stddev_pop(R()), F.lit(1e-10))), **p)


@metric()
def kappa_three_ratio(mar: float = 0.0, **_: object) -> Column:
    low = F.when(R().isNotNull(), F.greatest(F.lit(mar) - R(), F.lit(0.0)))
    lpm = F.avg(low * low * low)
    mean = F.avg(R())
    return F.when(valid() >= 2, F.when(lpm < 1e-30, F.when(mean > mar, INF())).otherwise(div(mean - mar, F.cbrt(lpm))))


def normal_probability(z: Column) -> Column:
    """Standard normal distribution function."""
    
    @F.pandas_udf("double")
    def cdf(x: pd.Series) -> pd.Series:
        return pd.Series(normal_cdf_array(x.to_numpy(dtype=float)))

    return F.when(z.isNotNull(), cdf(z))


@metric()
def deflated_sharpe_ratio(risk_free: float = 0.0, num_trials: int = 1, **_: object) -> Column:
    """The argument of the normal distribution function; ``finish`` turns it into the probability."""
    n = valid().cast("double")
    x = R() - risk_free
    sd = F.stddev_samp(x)
    sr = F.when(sd > 1e-15, div(F.avg(x), sd)).otherwise(0.0)
    best = 0.0
    if num_trials > 1 and math.log(num_trials) >= 1e-10:
        k = math.log(num_trials)
        best = math.sqrt(2 * k) - (math.log(math.pi) + math.log(k)) / (2 * math.sqrt(2 * k))
    g3 = F.when(F.stddev_pop(R()) == 0, 0.0).otherwise(skewness() * div(F.sqrt(n * (n - 1)), n - 2))
    g4 = F.when((n < 4) | (F.stddev_pop(R()) == 0), 0.0).otherwise(div(((n + 1) * kurtosis() + 6) * (n - 1), (n - 2) * (n - 3)))
    under = 1 - g3 * sr + (g4 - 1) / 4 * sr * sr
    z = (sr - best) * div(F.sqrt(n - 1), F.sqrt(F.greatest(under, F.lit(1e-300))))
    return F.when(n >= 3, F.when(under <= 0, F.when(sr > best, 40.0).otherwise(-40.0)).otherwise(z))


@metric()
def common_sense_ratio(**_: object) -> Column:
    w = win_rate()
    return F.when((rows() >= 2) & (w > 0), F.when(w == 1, INF()).otherwise(div(tail_ratio() * w, 1 - w)))


@metric("nav")
def stability_of_timeseries(**_: object) -> Column:
    """R squared of a line through the cumulative log returns."""
    return F.when(valid() >= 2, F.regr_r2(F.when(R().isNotNull(), F.col("log_nav")), F.col("vn").cast("double")))


def _capture(where: Column | None, ann: float) -> Column:
    r, f = (R(), B()) if where is None else (F.when(where, R()), F.when(where, B()))
    n = rows() if where is None else F.count(F.when(where, 1))
    return div(cagr(r, n, ann), cagr(f, n, ann))


@metric("f")
def capture(period: str = "daily", **_: object) -> Column:
    return _capture(None, annualization_factor(period))


@metric("f")
def up_capture(period: str = "daily", **_: object) -> Column:
    return _capture(B() > 0, annualization_factor(period))


@metric("f")
def down_capture(period: str = "daily", **_: object) -> Column:
    return _capture(B() < 0, annualization_factor(period))


@metric("f")
def up_down_capture(period: str = "daily", **_: object) -> Column:
    ann = annualization_factor(period)
    return div(_capture(B() > 0, ann), _capture(B() < 0, ann))


@metric("f")
def up_capture_return(period: str = "daily", annualization: float | None = None, **_: object) -> Column:
    return cagr(F.when(B() > 0, R()), F.count(F.when(B() > 0, 1)), annualization_factor(period, annualization))


@metric("f")
def down_capture_return(period: str = "daily", annualization: float | None = None, **_: object) -> Column:
    return cagr(F.when(B() < 0, R()), F.count(F.when(B() < 0, 1)), annualization_factor(period, annualization))


# ---- regression against the benchmark


def slope(y: Column, x: Column) -> Column:
    """Least-squares slope over complete pairs; null below two pairs or for a constant x."""
    pair = y.isNotNull() & x.isNotNull()
    xs = F.when(pair, x)
    return F.when((F.count(xs) >= 2) & (F.var_pop(xs) >= 1e-30), F.regr_slope(y, x))


@metric("f")
def beta(risk_free: float = 0.0, **_: object) -> Column:
    del risk_free  # a constant shift of both leaves the slope alone
    return slope(R(), B())


def _alpha(b: Column, r: Column, f: Column, risk_free: float, ann: float) -> Column:
    return F.pow(1 + F.avg(r - risk_free) - b * F.avg(f - risk_free), F.lit(ann)) - 1


@metric("f")
def alpha(risk_free: float = 0.0, period: str = "daily", annualization: float | None = None, **_: object) -> Column:
    """Annualised mean of what beta leaves over complete pairs."""
    return _alpha(slope(R(), B()), F.when(both(), R()), F.when(both(), B()), risk_free, annualization_factor(period, annualization))


@metric("f")
def alpha_beta(risk_free: float = 0.0, period: str = "daily", annualization: float | None = None, **_: object) -> Column:
    return F.struct(alpha(risk_free, period, annualization).alias("alpha"), beta(risk_free).alias("beta"))


def _side(where: Column, risk_free: float, ann: float) -> tuple[Column, Column]:
    ok = where & both()
    r, f = F.when(ok, R()), F.when(ok, B())
    b = F.when((F.count(f) >= 2) & (F.var_samp(f) > 0), div(F.covar_samp(r, f), F.var_samp(f)))
    return _alpha(b, r, f, risk_free, ann), b


@metric("f")
def up_alpha(risk_free: float = 0.0, period: str = "daily", annualization: float | None = None, **_: object) -> Column:
    return _side(B() > 0, risk_free, annualization_factor(period, annualization))[0]


@metric("f")
def up_beta(risk_free: float = 0.0, **_: object) -> Column:
    return _side(B() > 0, risk_free, 252.0)[1]


@metric("f")
def down_alpha(risk_free: float = 0.0, period: str = "daily", annualization: float | None = None, **_: object) -> Column:
    """Rows with a benchmark return of zero count as down."""
    return _side(B() <= 0, risk_free, annualization_factor(period, annualization))[0]


@metric("f")
def down_beta(risk_free: float = 0.0, **_: object) -> Column:
    return _side(B() <= 0, risk_free, 252.0)[1]


@metric("f")
def regression_annual_return(risk_free: float = 0.0, period: str = "daily", annualization: float | None = None, **_: object) -> Column:
    """alpha + beta x the benchmark's annual return."""
    bench = cagr(B(), rows(), annualization_factor(period, annualization))
    return alpha(risk_free, period, annualization) + beta(risk_free) * bench


def _two(x1: Column, x2: Column, risk_free: float, of: int) -> Column:
    """Coefficient of x1 (1) or x2 (2) in a regression of the excess return on both and a constant, from covariances."""
    ok = both()
    y, a, b = (F.when(ok, c) for c in (R() - risk_free, x1, x2))
    s11, s22, s12 = F.var_pop(a), F.var_pop(b), F.covar_pop(a, b)
    s1y, s2y = F.covar_pop(a, y), F.covar_pop(b, y)
    top = s11 * s2y - s12 * s1y if of == 2 else s22 * s1y - s12 * s2y
    return F.when(F.count(a) >= 10, div(top, s11 * s22 - s12 * s12))


@metric("f")
def treynor_mazuy_timing(risk_free: float = 0.0, **_: object) -> Column:
    x = B() - risk_free
    return _two(x, x * x, risk_free, 2)


@metric("f")
def henriksson_merton_timing(risk_free: float = 0.0, **_: object) -> Column:
    """Coefficient of the down-market indicator."""
    x = B() - risk_free
    return _two(x, (x < 0).cast("double"), risk_free, 2)


@metric("f")
def market_timing_return(risk_free: float = 0.0, **_: object) -> Column:
    x = F.when(both(), B() - risk_free)
    return treynor_mazuy_timing(risk_free) * F.avg(x * x)


@metric("f")
def cornell_timing(risk_free: float = 0.0, **_: object) -> Column:
    """Slope in rising markets less that in falling ones."""
    x = B() - risk_free
    up, down = F.greatest(x, F.lit(0.0)), F.least(x, F.lit(0.0))
    return _two(up, down, risk_free, 1) - _two(up, down, risk_free, 2)


# ---- distribution


@metric()
def skewness(**_: object) -> Column:
    return F.when(rows() >= 3, F.skewness(R()))


@metric()
def kurtosis(**_: object) -> Column:
    return F.when(rows() >= 4, F.kurtosis(R()))


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation of complete pairs; null for fewer than two or a constant side."""
    ok = x.isNotNull() & y.isNotNull()
    a, b = F.when(ok, x), F.when(ok, y)
    sa, sb = F.stddev_pop(a), F.stddev_pop(b)
    return F.when((F.count(a) >= 2) & (sa >= 1e-15) & (sb >= 1e-15), div(F.covar_pop(a, b), sa * sb))


@metric("lag")
def serial_correlation(**_: object) -> Column:
    """Autocorrelation of the valid returns."""
    return correlation(R(), F.col("lagged"))


@metric("f")
def market_correlation(**_: object) -> Column:
    return correlation(R(), B())


for _name in ("stock_market_correlation", "bond_market_correlation", "futures_market_correlation"):
    REGISTRY[_name] = REGISTRY["market_correlation"]


@metric()
def win_rate(**_: object) -> Column:
    return div(F.count(F.when(R() > 0, 1)), valid())


@metric()
def loss_rate(**_: object) -> Column:
    return div(F.count(F.when(R() < 0, 1)), valid())


@metric("f")
def relative_win_rate(**_: object) -> Column:
    return div(F.count(F.when(R() > B(), 1)), F.count(F.when(both(), 1)))


@metric("f")
def r_cubed(**_: object) -> Column:
    return F.pow(correlation(R(), B()), F.lit(3.0))


@metric("f")
def capm_r_squared(**_: object) -> Column:
    r, f = F.when(both(), R()), F.when(both(), B())
    ok = (F.count(r) >= 2) & (F.stddev_samp(r) >= 1e-15) & (F.var_samp(f) >= 1e-30)
    return F.when(ok, F.least(F.greatest(F.pow(div(F.covar_samp(r, f), F.stddev_samp(r) * F.stddev_samp(f)), F.lit(2.0)), F.lit(0.0)), F.lit(1.0)))


@metric("f")
def tracking_difference(**_: object) -> Column:
    return growth(R()) - growth(B())


@metric("nav")
def max_drawdown(**_: object) -> Column:
    return F.min("dd")


@metric()
def max_single_day_gain(**_: object) -> Column:
    return F.max(R())


@metric()
def max_single_day_loss(**_: object) -> Column:
    return F.min(R())


@metric()
def max_single_day_gain_date(**_: object) -> Column:
    return F.max_by("dt", F.when(R().isNotNull(), F.struct(R(), -F.unix_date("dt"))))


@metric()
def max_single_day_loss_date(**_: object) -> Column:
    return F.min_by("dt", F.when(R().isNotNull(), F.struct(R(), F.col("dt"))))


# ---- preparation and evaluation


def numbered(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Adds ``rn``, the row's number within its series by date. Rows are counted by calendar year and the counts of earlier
    years added, so a long series is numbered by many tasks."""
    keys = keys or ["sid"]
    part = [*keys, "__shard"]
    inside = df.withColumn("__shard", F.year("dt")).withColumn("rn", F.row_number().over(Window.partitionBy(*part).orderBy("dt")))
    counts = df.groupBy(*keys, F.year("dt").alias("__shard")).agg(F.count(F.lit(1)).alias("__c"))
    before = Window.partitionBy(*keys).orderBy("__shard").rowsBetween(Window.unboundedPreceding, -1)
    carry = counts.select(*part, F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__n0"))
    return inside.join(carry, part).withColumn("rn", F.col("rn") + F.col("__n0")).drop("__shard", "__n0")


def stretches(df: DataFrame, keys: list[str], hit: Column) -> DataFrame:
    """The rows where ``hit`` is true, with ``anchor``, the date of the last row before them where it is not (null for none),
    and ``next_dt``, the date of the series' next row. Rows of one unbroken stretch share their anchor.

    Calendar years are scanned apart and joined through one row per year, so a long series is spread over many tasks."""
    part = [*keys, "__shard"]
    order = Window.partitionBy(*part).orderBy("dt")
    hit = F.coalesce(hit, F.lit(False))
    inside = df.withColumn("__shard", F.year("dt")).withColumn("__hit", hit)
    outside = F.max(F.when(~F.col("__hit"), F.col("dt")))
    inside = inside.withColumn("__a", outside.over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("__next", F.lead("dt").over(order))
    years = inside.groupBy(*part).agg(outside.alias("a"), F.min("dt").alias("f"))
    ahead = Window.partitionBy(*keys).orderBy("__shard")
    carry = years.select(*part, F.max("a").over(ahead.rowsBetween(Window.unboundedPreceding, -1)).alias("a0"), F.lead("f").over(ahead).alias("f1"))
    joined = inside.where("__hit").join(carry, part)
    return joined.withColumn("anchor", F.coalesce("__a", "a0")).withColumn("next_dt", F.coalesce("__next", "f1")).drop("__shard", "__hit", "__a", "__next", "a0", "f1")


def _dd_runs(nav: DataFrame, keys: list[str]) -> DataFrame:
    """One row per run below the running peak. ``peak_dt`` is the row before it (null for none), ``next_dt`` the row after it."""
    low = F.struct(F.round("dd1", 12), "rn")
    runs = stretches(nav.select(*keys, "dt", "rn", "dd1"), keys, F.col("dd1") < -1e-12).groupBy(*keys, F.col("anchor").alias("peak_dt"))
    return runs.agg(
        F.min("dd1").alias("depth"), F.min("rn").alias("from_rn"), F.max("rn").alias("to_rn"), F.min_by("rn", low).alias("trough_rn"),
        F.min("dt").alias("from_dt"), F.max("dt").alias("to_dt"), F.min_by("dt", low).alias("trough_dt"), F.max_by("next_dt", "rn").alias("next_dt"),
    )


def with_nav(df: DataFrame, keys: list[str], shard: Column | None = None) -> DataFrame:
    """Adds rn, vn (count of valid returns), nav, log_nav, peak, dd (start counts as a peak) and dd1 (it does not).

    Series are scanned in shards (by default calendar years): each shard is compounded on its own, a scan over the
    shards' totals gives what they start from, so a long series is spread over many tasks.
    """
    shard = F.year("dt") if shard is None else shard
    part = [*keys, "__shard"]
    flow = Window.partitionBy(*part).orderBy("dt").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    r0 = F.coalesce(R(), F.lit(0.0))
    inside = (
        df.withColumn("__shard", shard)
        .withColumn("__c", F.product(1 + r0).over(flow))
        .withColumn("__n", F.row_number().over(Window.partitionBy(*part).orderBy("dt")))
        .withColumn("__v", F.count(R()).over(flow))
        .withColumn("__l", F.coalesce(F.sum(F.when(R() > -1, F.log1p(R()))).over(flow), F.lit(0.0)))
        .withColumn("__m", F.max("__c").over(flow))
    )
    totals = inside.groupBy(*part).agg(F.max_by("__c", "__n").alias("c"), F.max("__n").alias("n"), F.max("__v").alias("v"), F.max_by("__l", "__n").alias("l"), F.max("__c").alias("m"))
    before = Window.partitionBy(*keys).orderBy("__shard").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        totals.withColumn("c0", F.coalesce(F.product("c").over(before), F.lit(1.0)))
        .withColumn("n0", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .withColumn("v0", F.coalesce(F.sum("v").over(before), F.lit(0)))
        .withColumn("l0", F.coalesce(F.sum("l").over(before), F.lit(0.0)))
        .withColumn("m0", F.max(F.col("m") * F.col("c0")).over(before))
        .select(*part, "c0", "n0", "v0", "l0", "m0")
    )
    nav = F.col("__c") * F.col("c0")
    peak = F.greatest(F.col("m0"), F.col("__m") * F.col("c0"))
    joined = inside.join(carry, part).withColumn("rn", F.col("__n") + F.col("n0")).withColumn("vn", F.col("__v") + F.col("v0")).withColumn("nav", nav).withColumn("log_nav", F.col("__l") + F.col("l0"))
    out = joined.withColumn("peak", peak).withColumn("dd", F.col("nav") / F.greatest(F.lit(1.0), peak) - 1).withColumn("dd1", F.try_divide(F.col("nav"), peak) - 1)
    return out.drop("__shard", "__c", "__n", "__v", "__l", "__m", "c0", "n0", "v0", "l0", "m0")


def drawdown_runs(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per run below the running peak: depth, its first, lowest and last row and date."""
    return _dd_runs(with_nav(df, keys), keys)


def prepare(df: DataFrame, keys: list[str], needs: Iterable[str], cutoff: float = 0.05, lag: int = 1) -> DataFrame:
    needs = set(needs)
    out = df
    if needs & {"nav", "islands"}:
        out = with_nav(out, keys)
    if "islands" in needs:
        stats = _dd_runs(out, keys).groupBy(*keys).agg(F.avg("depth").alias("dd_mean"), F.sum(F.col("depth") * F.col("depth")).alias("dd_sumsq"), F.count(F.lit(1)).alias("dd_runs"))
        out = out.join(stats, keys, "left")
    if "cut" in needs:
        out = out.join(df.groupBy(*keys).agg(F.percentile(R(), F.lit(float(cutoff))).alias("cut")), keys)
    if "lag" in needs:
        # over valid returns only
        known = Window.partitionBy(*keys, R().isNotNull()).orderBy("dt")
        out = out.withColumn("lagged", F.when(R().isNotNull(), F.lag(R(), lag).over(known)))
    return out


def compute(df: DataFrame, names: Iterable[str], keys: list[str] | None = None, **params: object) -> DataFrame:
    """One row per key with a column for each named metric, in one aggregation over one preparation.

    An empty table gives no rows; unknown names raise KeyError. ``cutoff`` and ``lag`` also steer the preparation.
    """
    keys = keys or ["sid"]
    names = list(names)
    needs = set().union(*(REGISTRY[n].needs for n in names))
    ready = prepare(df, keys, needs, float(params.get("cutoff", 0.05)), int(params.get("lag", 1)))
    out = ready.groupBy(*keys).agg(*(REGISTRY[n].build(**params).alias(n) for n in names))
    if "deflated_sharpe_ratio" in names:
        out = out.withColumn("deflated_sharpe_ratio", normal_probability(F.col("deflated_sharpe_ratio")))
    return out
