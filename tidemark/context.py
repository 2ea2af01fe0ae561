"""Entry points: a lazy analysis of one set of returns, and a facade that has every metric as a method."""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import viz  # registers its backends  # noqa: F401
from .functions import metrics as M
from .functions.periods import annualization_factor
from .operators import report, series
from .registry import execute_hooks, get_viz_backend


class AnalysisContext:
    """Returns (sid, dt, ret) with an optional benchmark (dt, ret) or (sid, dt, ret), positions and transactions.

    Nothing runs until it is asked for; ``metric`` gives a DataFrame, ``to_dict`` one series' numbers. The aligned
    frame is kept; ``invalidate`` forgets what was collected."""

    def __init__(self, returns: DataFrame, *, factor_returns: DataFrame | None = None, positions: DataFrame | None = None, transactions: DataFrame | None = None, period: str = "daily") -> None:
        annualization_factor(period)
        self.returns = returns if "sid" in returns.columns else returns.withColumn("sid", F.lit(0))
        if factor_returns is not None:
            on = [c for c in ("sid", "dt") if c in factor_returns.columns]
            self.returns = self.returns.join(factor_returns.select(*on, F.col("ret").alias("f")), on, "left" if len(on) == 1 else "full_outer")
        self.positions, self.transactions, self.period = positions, transactions, period
        self._held: dict[Any, dict] = {}

    def metric(self, *names: str, **params: object) -> DataFrame:
        return M.compute(self.returns, names, **({"period": self.period} | params))

    def perf_stats(self) -> DataFrame:
        execute_hooks("pre_compute", self.returns)
        return report.perf_stats(self.returns, self.positions, self.transactions, period=self.period)

    def cumulative_returns(self, starting_value: float = 0.0) -> DataFrame:
        return series.cum_returns(self.returns, starting_value)

    def rolling(self, names: list[str] | str = "all", window: int = 252) -> DataFrame:
        return series.rolling(self.returns, names, window, period=self.period)

    def to_dict(self, sid: object = 0) -> dict[str, float | None]:
        """Headline statistics of one series; what is undefined or infinite is None."""
        if sid not in self._held:
            rows = self.perf_stats().where(F.col("sid") == F.lit(sid)).collect()
            self._held[sid] = {r["stat"]: r["value"] if r["value"] is not None and math.isfinite(r["value"]) else None for r in rows}
        return dict(self._held[sid])

    def to_json(self, sid: object = 0, **kwargs: Any) -> str:
        return json.dumps(self.to_dict(sid), **kwargs)

    def to_html(self, path: str, sid: object = 0, **kwargs: Any) -> str:
        if path.endswith(".pdf"):
            raise ValueError("a PDF comes from report.strategy_report")
        return report.strategy_report(self.returns, sid, path, positions=self.positions, transactions=self.transactions, **kwargs)

    def plot(self, sid: object = 0, backend: str = "table") -> Any:
        one = self.returns.where(F.col("sid") == F.lit(sid))
        return get_viz_backend(backend).plot_returns(series.cum_returns(one, 1.0).select("dt", "cum"))

    def invalidate(self) -> None:
        self._held.clear()

    def __getattr__(self, name: str) -> Callable[..., DataFrame]:
        if name in M.REGISTRY:
            return lambda **params: self.metric(name, **params)
        raise AttributeError(name)

    def __repr__(self) -> str:
        return f"AnalysisContext(period={self.period!r}, benchmark={'f' in self.returns.columns})"


def analyze(returns: DataFrame, **kwargs: Any) -> AnalysisContext:
    return AnalysisContext(returns, **kwargs)


#: Operators that give more than one aggregate per series, by name.
SERIES_OPERATORS: dict[str, Callable] = {
    "cum_returns": series.cum_returns,
    "aggregate_returns": series.aggregate_returns,
    "normalize": series.normalize,
    "by_year": series.by_year,
    "annual_active_return": series.annual_active_return,
    "alpha_percentile_rank": series.alpha_percentile_rank,
    "get_all_drawdowns": series.drawdown_runs,
    "get_max_drawdown": series.max_drawdown_dates,
    "get_top_drawdowns": series.top_drawdowns,
    "gen_drawdown_table": series.top_drawdowns,
    "nth_drawdown": series.nth_drawdown,
    "consecutive_stats": series.consecutive_stats,
    "longest_run": series.longest_run,
    "rolling": series.rolling,
    "roll": series.roll,
    "beta_fragility_heuristic": series.beta_fragility,
    "r_cubed_turtle": series.r_cubed_turtle,
    "hurst_exponent": series.hurst_exponent,
    "stutzer_index": series.stutzer_index,
    "perf_stats": report.perf_stats,
    "period_returns": report.period_returns,
}
for _name, _metric in (("annual_return_by_year", "annual_return"), ("sharpe_ratio_by_year", "sharpe_ratio"), ("annual_volatility_by_year", "annual_volatility"), ("max_drawdown_by_year", "max_drawdown"), ("information_ratio_by_year", "information_ratio"), ("annual_alpha", "alpha"), ("annual_beta", "beta")):
    SERIES_OPERATORS[_name] = lambda df, m=_metric, **p: series.by_year(df, m, **p)
for _name, _metric in (("roll_sharpe_ratio", "sharpe"), ("roll_beta", "beta"), ("roll_alpha", "alpha"), ("roll_max_drawdown", "max_drawdown"), ("roll_up_capture", "up_capture"), ("roll_down_capture", "down_capture"), ("roll_up_down_capture", "up_down_capture"), ("rolling_volatility", "volatility"), ("rolling_beta", "beta")):
    SERIES_OPERATORS[_name] = lambda df, window=252, m=_metric, **p: series.rolling(df, m, window, **p)
for _side in ("up", "down"):
    for _level in ("day", "week", "month"):
        SERIES_OPERATORS[f"max_consecutive_{_side}_{_level}s"] = lambda df, u=_side == "up", level=_level: series.longest_run(df, u, level)


class _Dual:
    """On the class: a function of a frame. On an instance: the same on the stored returns."""

    def __init__(self, name: str) -> None:
        self.name = name

    def __get__(self, obj: Analytics | None, owner: type) -> Callable:
        fn = SERIES_OPERATORS.get(self.name) or (lambda df, **p: M.compute(df, [self.name], **p))
        return fn if obj is None else lambda *a, **p: fn(obj.returns, *a, **p)


class Analytics:
    """Every metric and series operator as ``Analytics.name(df)`` or ``Analytics(returns).name()``."""

    def __init__(self, returns: DataFrame, factor_returns: DataFrame | None = None, **kwargs: Any) -> None:
        self.context = AnalysisContext(returns, factor_returns=factor_returns, **kwargs)
        self.returns = self.context.returns

    @classmethod
    def names(cls) -> list[str]:
        return sorted({*M.REGISTRY, *SERIES_OPERATORS})


for _name in (*M.REGISTRY, *SERIES_OPERATORS):
    setattr(Analytics, _name, _Dual(_name))
