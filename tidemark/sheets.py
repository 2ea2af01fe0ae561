"""Tear sheets: named charts and tables over one strategy's returns, book and trades.

Every chart's table is a lazy frame; ``Sheet`` draws them on a page or hands them out. Returns are long (sid, dt, ret
[, f]); one series is shown, named by ``sid``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions import metrics as M
from .functions.constants import STRESS_PERIODS
from .functions.special import beta_ppf
from .operators import attribution, bayes, book, common, report, round_trips, series, simulate
from .viz import Chart, HtmlReportBuilder

# Slippage levels in basis points, capital levels of the sweep (dollars), and windows in rows.
SLIPPAGE_LEVELS = (3, 8, 10, 12, 15, 20, 50)
CAPITAL_FROM, CAPITAL_TO, CAPITAL_STEP = 100_000, 300_000_000, 1_000_000
HALF_YEAR, YEAR = 126, 252
_CHARTS: dict[str, Callable[..., Chart]] = {}


def chart(fn: Callable[..., Chart]) -> Callable[..., Chart]:
    _CHARTS[fn.__name__] = fn
    return fn


class Sheet:
    """Charts by name, in order."""

    def __init__(self, title: str, charts: dict[str, Chart]) -> None:
        self.title, self.charts = title, charts

    def frames(self) -> dict[str, DataFrame]:
        return {name: c.data for name, c in self.charts.items()}

    def to_html(self, path: str | None = None) -> str:
        page = HtmlReportBuilder().add_title(self.title)
        for c in self.charts.values():
            page.draw(c)
        return page.save(path) if path else page.build()

    def __getitem__(self, name: str) -> Chart:
        return self.charts[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self.charts)

    def __add__(self, other: Sheet) -> Sheet:
        return Sheet(self.title, self.charts | other.charts)


class TearSheets:
    """Charts (``plot_...``, ``show_...``) and sheets (``create_..._tear_sheet``) of one strategy.

    ``benchmark``: dt, ret. ``positions``: dt, symbol, value with a symbol ``cash``. ``transactions``: ts, symbol,
    amount, price. ``market``: dt, symbol, price, volume. ``sectors``: symbol, sector. ``caps``: symbol, cap.
    ``factor_returns``: dt, factor, ret. ``loadings``: dt, symbol, factor, loading. ``shares``: dt, symbol, shares.
    What a chart needs and was not given raises ValueError.
    """

    def __init__(
        self,
        returns: DataFrame,
        sid: object = 0,
        *,
        benchmark: DataFrame | None = None,
        live_start: Any = None,
        slippage_bps: float | None = None,
        estimate_intraday: bool | str = "infer",
        turnover_denominator: str = "AGB",
        cap_buckets: list[tuple[str, float, float]] | None = None,
        **tables: DataFrame | None,
    ) -> None:
        known = ("positions", "transactions", "market", "sectors", "caps", "factor_returns", "loadings", "shares")
        if unknown := tables.keys() - set(known):
            raise TypeError(f"unknown tables {sorted(unknown)}; there are {known}")
        self.tables = {k: tables.get(k) for k in known}
        self.sid, self.live_start, self.turnover_denominator = sid, live_start, turnover_denominator
        self.cap_buckets = cap_buckets or [("small", 0.0, 2e9), ("mid", 2e9, 1e10), ("large", 1e10, float("inf"))]
        one = (returns if "sid" in returns.columns else returns.withColumn("sid", F.lit(sid))).where(F.col("sid") == F.lit(sid))
        if benchmark is not None:
            one = one.drop("f").join(benchmark.select("dt", F.col("ret").alias("f")), "dt", "left")
        self.unadjusted = self.returns = one.select("sid", "dt", "ret", *(["f"] if "f" in one.columns else []))
        self.tables["positions"] = common.check_intraday(estimate_intraday, self.tables["positions"], self.tables["transactions"])
        if slippage_bps is not None and self.tables["transactions"] is not None:
            self.returns = book.slippage_adjusted_returns(self.returns, self.need("positions"), self.need("transactions"), slippage_bps).join(self.returns.drop("ret"), "dt").select(*self.returns.columns)

    def need(self, name: str) -> DataFrame:
        if self.tables[name] is None:
            raise ValueError(f"this chart needs {name}")
        return self.tables[name]

    @property
    def benchmark(self) -> DataFrame:
        if "f" not in self.returns.columns:
            raise ValueError("this chart needs a benchmark")
        return self.returns.select("sid", "dt", F.col("f").alias("ret"))

    def part(self) -> Any:
        """``in`` or ``out of`` the sample, by the live start."""
        return F.lit("in sample") if self.live_start is None else F.when(F.col("dt") < F.lit(self.live_start), "in sample").otherwise("out of sample")

    def trips(self) -> DataFrame:
        closed = round_trips.closing_transactions(self.need("positions"), self.need("transactions"))
        value = self.need("positions").groupBy("dt").agg(F.sum("value").alias("value"))
        return round_trips.round_trips(closed, value)

    def attributed(self) -> tuple[DataFrame, DataFrame]:
        weights = book.normalized_positions(self.need("positions"))
        return attribution.perf_attrib(self.returns.select("sid", "dt", "ret"), weights, self.need("factor_returns"), self.need("loadings"))

    # ---- sheets

    def sheet(self, title: str, *names: str) -> Sheet:
        return Sheet(title, {n: getattr(self, n)() for n in names})

    def create_returns_tear_sheet(self) -> Sheet:
        names = ["show_perf_stats", "show_worst_drawdown_periods", "plot_rolling_returns", "plot_returns", "plot_rolling_volatility", "plot_rolling_sharpe", "plot_drawdown_periods", "plot_drawdown_underwater", "plot_monthly_returns_heatmap", "plot_annual_returns", "plot_monthly_returns_dist", "plot_return_quantiles"]
        if "f" in self.returns.columns:
            names[4:4] = ["plot_volatility_matched_returns", "plot_rolling_beta"]
        return self.sheet("Returns", *names)

    def create_simple_tear_sheet(self) -> Sheet:
        names = ["show_perf_stats", "plot_rolling_returns", "plot_rolling_sharpe", "plot_drawdown_underwater"]
        names += ["plot_rolling_beta"] if "f" in self.returns.columns else []
        names += ["plot_exposures", "show_and_plot_top_positions", "plot_holdings"] if self.tables["positions"] is not None else []
        names += ["plot_turnover", "plot_txn_time_hist"] if self.tables["positions"] is not None and self.tables["transactions"] is not None else []
        return self.sheet("Overview", *names)

    def create_position_tear_sheet(self) -> Sheet:
        names = ["plot_exposures", "show_and_plot_top_positions", "plot_max_median_position_concentration", "plot_holdings", "plot_long_short_holdings", "plot_gross_leverage"]
        return self.sheet("Positions", *names, *(["plot_sector_allocations"] if self.tables["sectors"] is not None else []))

    def create_txn_tear_sheet(self) -> Sheet:
        return self.sheet("Transactions", "plot_turnover", "plot_daily_volume", "plot_daily_turnover_hist", "plot_txn_time_hist", "plot_slippage_sweep", "plot_slippage_sensitivity")

    def create_round_trip_tear_sheet(self) -> Sheet:
        names = ["print_round_trip_stats", "show_profit_attribution", "plot_round_trip_lifetimes", "plot_prob_profit_trade", "plot_trade_pnl", "plot_trade_returns"]
        return self.sheet("Round trips", *names, *(["show_sector_profit_attribution"] if self.tables["sectors"] is not None else []))

    def create_interesting_times_tear_sheet(self) -> Sheet:
        return self.sheet("Stress periods", "show_interesting_times", "plot_interesting_times")

    def create_capacity_tear_sheet(self) -> Sheet:
        return self.sheet("Capacity", "show_days_to_liquidate", "show_low_liquidity_transactions", "plot_capacity_sweep")

    def create_bayesian_tear_sheet(self, stoch_vol: bool = False) -> Sheet:
        names = ["plot_bayes_cone", "plot_best", *(["plot_alpha_beta_posterior"] if "f" in self.returns.columns else []), *(["plot_stoch_vol"] if stoch_vol else [])]
        return self.sheet("Bayesian", *names)

    def create_risk_tear_sheet(self) -> Sheet:
        names = []
        if self.tables["loadings"] is not None:
            names += ["plot_style_factor_exposures"]
        for table, kind in (("sectors", "sector"), ("caps", "cap")):
            if self.tables[table] is not None:
                names += [f"plot_{kind}_exposures_longshort", f"plot_{kind}_exposures_gross", f"plot_{kind}_exposures_net"]
        if self.tables["shares"] is not None and self.tables["market"] is not None:
            names += ["plot_volume_exposures_longshort", "plot_volume_exposures_gross"]
        return self.sheet("Risk", *names)

    def create_perf_attrib_tear_sheet(self) -> Sheet:
        return self.sheet("Attribution", "show_perf_attrib_stats", "show_perf_attrib_factors", "plot_perf_attrib_returns", "plot_alpha_returns", "plot_factor_contribution_to_perf", "plot_risk_exposures")

    def create_full_tear_sheet(self, bayesian: bool = False, with_round_trips: bool = False) -> Sheet:
        has = lambda *names: all(self.tables[n] is not None for n in names)
        out = self.create_returns_tear_sheet() + self.create_interesting_times_tear_sheet()
        out.title = "Full report"
        if has("positions"):
            out += self.create_position_tear_sheet()
            if has("transactions"):
                out += self.create_txn_tear_sheet()
                if with_round_trips:
                    out += self.create_round_trip_tear_sheet()
                if has("market"):
                    out += self.create_capacity_tear_sheet()
            if has("sectors") or has("caps") or has("loadings"):
                out += self.create_risk_tear_sheet()
            if has("factor_returns", "loadings"):
                out += self.create_perf_attrib_tear_sheet()
        return out + self.create_bayesian_tear_sheet() if bayesian else out


# ---- returns


@chart
def show_perf_stats(t: TearSheets) -> Chart:
    """Headline statistics of everything and, with a live start, of both parts."""
    parts = [report.perf_stats(t.returns, t.tables["positions"], t.tables["transactions"]).select(F.lit("all").alias("part"), "stat", "value")]
    if t.live_start is not None:
        parts += [report.perf_stats(t.returns.withColumn("part", t.part()).where(F.col("part") == p).drop("part")).select(F.lit(p).alias("part"), "stat", "value") for p in ("in sample", "out of sample")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return Chart("Statistics", out, "table")


@chart
def plot_perf_stats(t: TearSheets) -> Chart:
    return Chart("Bootstrapped statistics", simulate.bootstrap_summary(t.returns), "table")


@chart
def show_worst_drawdown_periods(t: TearSheets, top: int = 5) -> Chart:
    return Chart("Worst drawdowns", series.top_drawdowns(t.returns, top).drop("sid"), "table")


@chart
def plot_returns(t: TearSheets) -> Chart:
    return Chart("Returns", t.returns.select("dt", t.part().alias("part"), "ret"), y=("ret",), group="part")


def _growth(t: TearSheets, r: DataFrame, name: str) -> DataFrame:
    return series.cum_returns(r, 1.0).select("dt", F.lit(name).alias("line"), "cum")


@chart
def plot_rolling_returns(t: TearSheets) -> Chart:
    both = _growth(t, t.returns, "strategy")
    if "f" in t.returns.columns:
        both = both.unionByName(_growth(t, t.benchmark, "benchmark"))
    return Chart("Cumulative returns", both, y=("cum",), group="line")


@chart
def plot_volatility_matched_returns(t: TearSheets) -> Chart:
    """The strategy scaled to the benchmark's volatility."""
    ratio = t.returns.agg(F.try_divide(F.stddev_samp("f"), F.stddev_samp("ret")).alias("k"))  # one row
    scaled = t.returns.join(F.broadcast(ratio)).withColumn("ret", F.col("ret") * F.col("k"))
    return Chart("Cumulative returns, volatility matched", _growth(t, scaled.drop("k"), "strategy").unionByName(_growth(t, t.benchmark, "benchmark")), y=("cum",), group="line")


@chart
def plot_cones(t: TearSheets, num_samples: int = 1000, most_strikes: int = 3) -> Chart:
    """Out-of-sample growth against the cone of resampled in-sample returns; ``strike`` marks the first days below it."""
    if t.live_start is None:
        raise ValueError("this chart needs a live start")
    live = M.numbered(t.returns.where(F.col("dt") >= F.lit(t.live_start)))
    path = series.cum_returns(live.drop("rn"), 1.0).join(live.select("sid", "dt", F.col("rn").alias("step")), ["sid", "dt"]).select("step", "dt", F.col("cum").alias("value"))
    days = live.agg(F.max("rn")).first()[0] or 1
    cone = simulate.forecast_cone(t.returns.where(F.col("dt") < F.lit(t.live_start)), int(days), num_samples=num_samples).drop("sid")
    struck = common.strikes(path.select("step", "value"), cone.select("step", F.col("down_2_0").alias("low")), most_strikes).select("step", F.lit(True).alias("strike"))
    return Chart("Forecast cone", path.join(cone, "step").join(struck, "step", "left"), x="step")


@chart
def plot_rolling_beta(t: TearSheets) -> Chart:
    parts = [series.rolling(t.returns, "beta", w).select("dt", F.lit(f"{w // 21} months").alias("line"), "beta") for w in (HALF_YEAR, YEAR)]
    return Chart("Rolling beta", parts[0].unionByName(parts[1]), y=("beta",), group="line")


@chart
def plot_rolling_volatility(t: TearSheets, window: int = HALF_YEAR) -> Chart:
    return Chart("Rolling volatility", series.rolling(t.returns, "volatility", window).drop("sid"), y=("volatility",))


@chart
def plot_rolling_sharpe(t: TearSheets, window: int = HALF_YEAR) -> Chart:
    return Chart("Rolling Sharpe ratio", series.rolling(t.returns, "sharpe", window).drop("sid"), y=("sharpe",))


@chart
def plot_drawdown_periods(t: TearSheets, top: int = 10) -> Chart:
    """Growth, each day with the rank of the drawdown that it lies in (null for none)."""
    spans = series.top_drawdowns(t.returns, top).select("rank", "peak", "recovery")
    days = series.cum_returns(t.returns, 1.0).select("dt", "cum")
    # at most ``top`` spans, which do not overlap
    return Chart("Drawdown periods", days.join(F.broadcast(spans), (F.col("dt") >= F.col("peak")) & (F.col("dt") <= F.coalesce("recovery", F.lit("9999-12-31").cast("date"))), "left").groupBy("dt", "cum").agg(F.min("rank").alias("rank")), y=("cum",))


@chart
def plot_drawdown_underwater(t: TearSheets) -> Chart:
    return Chart("Drawdown", series.cum_returns(t.returns).select("dt", "dd"), "area", y=("dd",))


@chart
def plot_monthly_returns_heatmap(t: TearSheets) -> Chart:
    return Chart("Monthly returns", report.monthly_table(t.returns).drop("sid"), "heat", x="year")


@chart
def plot_annual_returns(t: TearSheets) -> Chart:
    return Chart("Annual returns", series.aggregate_returns(t.returns, "yearly").drop("sid"), "bar", x="year", y=("ret",))


@chart
def plot_monthly_returns_dist(t: TearSheets) -> Chart:
    return Chart("Distribution of monthly returns", report.histogram(series.aggregate_returns(t.returns, "monthly")).drop("sid"), "bar", x="low", y=("n",))


@chart
def plot_monthly_returns_timeseries(t: TearSheets) -> Chart:
    monthly = series.aggregate_returns(t.returns, "monthly").select(F.make_date("year", "part", F.lit(1)).alias("dt"), "ret")
    return Chart("Monthly returns over time", monthly, "bar", y=("ret",))


@chart
def plot_return_quantiles(t: TearSheets) -> Chart:
    return Chart("Return quantiles", report.return_quantiles(t.returns).drop("sid"), "table")


@chart
def show_interesting_times(t: TearSheets) -> Chart:
    held = series.interesting_periods(t.returns, STRESS_PERIODS)
    return Chart("Stress periods", held.groupBy("name").agg(F.avg("ret").alias("mean"), F.min("ret").alias("least"), F.max("ret").alias("greatest"), F.count("ret").alias("days")), "table")


@chart
def plot_interesting_times(t: TearSheets) -> Chart:
    held = series.interesting_periods(t.returns, STRESS_PERIODS).select(F.col("name").alias("sid"), "dt", "ret")
    return Chart("Growth in stress periods", series.cum_returns(held).select("dt", F.col("sid").alias("line"), "cum"), y=("cum",), group="line")


# ---- positions


@chart
def plot_exposures(t: TearSheets) -> Chart:
    return Chart("Exposures", book.exposures(t.need("positions")))


@chart
def plot_gross_leverage(t: TearSheets) -> Chart:
    return Chart("Gross leverage", book.exposures(t.need("positions")).select("dt", "gross_leverage"), y=("gross_leverage",))


@chart
def plot_holdings(t: TearSheets) -> Chart:
    return Chart("Holdings", book.stocks(t.need("positions")).groupBy("dt").agg(F.count_if(F.col("value") != 0).alias("holdings")), y=("holdings",))


@chart
def plot_long_short_holdings(t: TearSheets) -> Chart:
    return Chart("Long and short holdings", book.stocks(t.need("positions")).groupBy("dt").agg(F.count_if(F.col("value") > 0).alias("long"), F.count_if(F.col("value") < 0).alias("short")))


@chart
def plot_max_median_position_concentration(t: TearSheets) -> Chart:
    return Chart("Concentration", book.concentration(t.need("positions")))


@chart
def show_and_plot_top_positions(t: TearSheets, top: int = 10) -> Chart:
    return Chart("Top positions", book.top_positions(t.need("positions"), top), "table")


@chart
def plot_sector_allocations(t: TearSheets) -> Chart:
    alloc = book.percent_alloc(t.need("positions")).join(t.need("sectors"), "symbol").groupBy("dt", "sector").agg(F.sum("alloc").alias("alloc"))
    return Chart("Sector allocations", alloc, y=("alloc",), group="sector")


# ---- transactions


def _turnover(t: TearSheets) -> DataFrame:
    return book.turnover(t.need("positions"), t.need("transactions"), t.turnover_denominator).select("dt", "turnover")


@chart
def plot_turnover(t: TearSheets) -> Chart:
    daily = _turnover(t)
    monthly = daily.groupBy(F.trunc("dt", "month").alias("dt")).agg(F.avg("turnover").alias("turnover"))
    return Chart("Turnover", daily.select("dt", F.lit("daily").alias("line"), "turnover").unionByName(monthly.select("dt", F.lit("monthly").alias("line"), "turnover")), y=("turnover",), group="line")


@chart
def plot_daily_volume(t: TearSheets) -> Chart:
    return Chart("Daily volume", book.txn_volume(t.need("transactions")))


@chart
def plot_daily_turnover_hist(t: TearSheets) -> Chart:
    return Chart("Distribution of daily turnover", report.histogram(_turnover(t).select(F.lit(t.sid).alias("sid"), "turnover"), "turnover").drop("sid"), "bar", x="low", y=("n",))


@chart
def plot_txn_time_hist(t: TearSheets, bin_minutes: int = 5, tz: str | None = None) -> Chart:
    fills = t.need("transactions")
    if tz:
        fills = fills.withColumn("ts", F.from_utc_timestamp("ts", tz))
    return Chart("Transactions by time of day", book.transaction_hours(fills, bin_minutes), "bar", x="bin", y=("share",))


def slippage_levels(t: TearSheets, levels: tuple[float, ...]) -> DataFrame:
    """sid (the level in basis points), dt, ret: all levels in one pass over the days, which are few per level."""
    value = t.need("positions").groupBy("dt").agg(F.sum("value").alias("pv"))
    traded = book.txn_volume(t.need("transactions")).select("dt", "txn_volume")
    days = t.unadjusted.join(value, "dt", "left").join(traded, "dt", "left").withColumn("bps", F.explode(F.array(*(F.lit(float(b)) for b in levels))))
    cost = F.coalesce(F.try_divide(F.col("txn_volume") * F.col("bps") * 1e-4, F.abs("pv")), F.lit(0.0))
    return days.select(F.col("bps").alias("sid"), "dt", (F.col("ret") - cost).alias("ret"))


@chart
def plot_slippage_sweep(t: TearSheets, levels: tuple[float, ...] = SLIPPAGE_LEVELS) -> Chart:
    return Chart("Growth by slippage", series.cum_returns(slippage_levels(t, levels), 1.0).select("dt", F.col("sid").alias("bps"), "cum"), y=("cum",), group="bps")


@chart
def plot_slippage_sensitivity(t: TearSheets) -> Chart:
    return Chart("Annual return by slippage", M.compute(slippage_levels(t, tuple(range(1, 100))), ["annual_return"]).withColumnRenamed("sid", "bps"), x="bps", y=("annual_return",))


# ---- round trips


@chart
def print_round_trip_stats(t: TearSheets) -> Chart:
    return Chart("Round trip statistics", round_trips.round_trip_stats(t.trips()), "table")


@chart
def show_profit_attribution(t: TearSheets) -> Chart:
    return Chart("Share of profit by symbol", round_trips.profit_attribution(t.trips()), "table")


@chart
def show_sector_profit_attribution(t: TearSheets) -> Chart:
    return Chart("Share of profit by sector", round_trips.profit_attribution(round_trips.with_sector(t.trips(), t.need("sectors")), "sector"), "table")


@chart
def plot_round_trip_lifetimes(t: TearSheets, symbols: int = 16) -> Chart:
    """Round trips of ``symbols`` symbols drawn by hash."""
    trips = t.trips()
    drawn = trips.select("symbol").distinct().orderBy(F.xxhash64("symbol"), "symbol").limit(symbols)
    return Chart("Round trip lifetimes", trips.join(drawn, "symbol", "left_semi").select("symbol", "open_dt", "close_dt", "long", "pnl"), "table")


def profit_posterior(trips: DataFrame, grid: int = 200) -> DataFrame:
    """p, density, low, high: Beta posterior of the share of profitable round trips on an even grid, with its 2.5 and 97.5
    per cent points; uniform prior. No trips leave the prior."""
    row = trips.agg(F.count_if(F.col("pnl") > 0).alias("won"), F.count_if(F.col("pnl") <= 0).alias("lost")).first()
    a, b = row["won"] + 1, row["lost"] + 1
    low, high = beta_ppf(0.025, a, b), beta_ppf(0.975, a, b)
    from math import exp, lgamma, log

    norm = lgamma(a + b) - lgamma(a) - lgamma(b)
    at = [(i + 0.5) / grid for i in range(grid)]
    rows = [(p, exp(norm + (a - 1) * log(p) + (b - 1) * log(1 - p)), low, high) for p in at]
    return trips.sparkSession.createDataFrame(rows, "p double, density double, low double, high double")


@chart
def plot_prob_profit_trade(t: TearSheets) -> Chart:
    return Chart("Probability of a profitable trade", profit_posterior(t.trips()), x="p", y=("density",))


@chart
def plot_trade_pnl(t: TearSheets) -> Chart:
    return Chart("Profit of round trips", report.histogram(t.trips().select(F.lit(t.sid).alias("sid"), "pnl"), "pnl").drop("sid"), "bar", x="low", y=("n",))


@chart
def plot_trade_returns(t: TearSheets) -> Chart:
    return Chart("Returns of round trips", report.histogram(t.trips().select(F.lit(t.sid).alias("sid"), F.col("rt_returns").alias("ret"))).drop("sid"), "bar", x="low", y=("n",))


# ---- capacity


@chart
def show_days_to_liquidate(t: TearSheets) -> Chart:
    return Chart("Longest times to liquidate", book.max_days_to_liquidate(t.need("positions"), t.need("market")), "table")


@chart
def show_low_liquidity_transactions(t: TearSheets) -> Chart:
    return Chart("Transactions of low liquidity", book.low_liquidity_transactions(t.need("transactions"), t.need("market")), "table")


def capacity_sweep(t: TearSheets, backtest_capital: float, levels: tuple[float, ...], impact: float = 0.1) -> DataFrame:
    """capital, sharpe_ratio: the ratio after the price impact of trading with more capital, for each level in one pass; from
    the first level below -1 on nothing follows."""
    bars = book.daily_bars(t.need("transactions"), t.need("market"))
    parts = None
    for level in levels:
        p = book.slippage_penalty(t.returns, bars, level, backtest_capital, impact).select(F.lit(float(level)).alias("sid"), "dt", "ret")
        parts = p if parts is None else parts.unionByName(p)
    ratios = M.compute(parts, ["sharpe_ratio"]).withColumnRenamed("sid", "capital")
    stop = F.max(F.when(F.col("sharpe_ratio") < -1, 1).otherwise(0)).over(Window.partitionBy(F.lit(1)).orderBy("capital").rowsBetween(Window.unboundedPreceding, -1))
    return ratios.withColumn("over", stop).where("coalesce(over, 0) = 0").drop("over")


@chart
def plot_capacity_sweep(t: TearSheets, backtest_capital: float = 1e6, levels: tuple[float, ...] | None = None) -> Chart:
    levels = levels or (CAPITAL_FROM, *(CAPITAL_STEP * k for k in (1, 3, 10, 30, 100, 300)))
    return Chart("Sharpe ratio by capital", capacity_sweep(t, backtest_capital, tuple(v for v in levels if v <= CAPITAL_TO)), x="capital", y=("sharpe_ratio",))


# ---- Bayesian models


@chart
def plot_bayes_cone(t: TearSheets, num_days: int = 63, samples: int = 300) -> Chart:
    draws = bayes.run_model(t.returns, "t", samples)
    return Chart("Posterior cone", simulate.bayes_cone(simulate.compound_paths(bayes.posterior_paths(draws, num_days))), x="step")


@chart
def plot_best(t: TearSheets, samples: int = 1000) -> Chart:
    """Posterior means and deviations of the Student t model, by sample part."""
    parts = t.returns.withColumn("sid", t.part())
    draws = bayes.run_model(parts.select("sid", "dt", "ret"), "t", samples)
    return Chart("Posterior of the returns model", draws.groupBy("sid", "parameter").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd")), "table")


@chart
def plot_alpha_beta_posterior(t: TearSheets, samples: int = 300) -> Chart:
    draws = bayes.run_model(t.returns, "alpha_beta", samples)
    return Chart("Posterior of alpha and beta", draws.groupBy("parameter").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd")), "table")


@chart
def plot_stoch_vol(t: TearSheets, samples: int = 200) -> Chart:
    draws = bayes.run_model(t.returns, "stoch_vol", samples, 2)
    return Chart("Posterior of the stochastic volatility", draws.groupBy("parameter").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd")), "table")


# ---- risk


@chart
def plot_style_factor_exposures(t: TearSheets) -> Chart:
    return Chart("Style exposures", attribution.compute_exposures(book.normalized_positions(t.need("positions")), t.need("loadings")), y=("exposure",), group="factor")


def _grouped(t: TearSheets, kind: str) -> DataFrame:
    """dt, name, long, short, gross, net of each group's book; cash is left out."""

    def side(cond: str, name: str) -> DataFrame:
        held = book.stocks(t.need("positions")).where(cond)
        by = book.group_exposures(held, t.need("sectors")) if kind == "sector" else book.cap_exposures(held, t.need("caps"), t.cap_buckets)
        return by.select("dt", F.col("sector" if kind == "sector" else "cap_bucket").alias("name"), F.col("value").alias(name))

    both = side("value > 0", "long").join(side("value < 0", "short"), ["dt", "name"], "full_outer").na.fill(0.0, ["long", "short"])
    return both.select("dt", "name", "long", "short", (F.col("long") - F.col("short")).alias("gross"), (F.col("long") + F.col("short")).alias("net"))


def _sides(kind: str, name: str, columns: tuple[str, ...]) -> None:
    def build(t: TearSheets) -> Chart:
        return Chart(f"{kind.capitalize()} exposures, {name}", _grouped(t, kind).select("dt", "name", *columns), y=columns, group="name")

    build.__name__ = f"plot_{kind}_exposures_{name}"
    chart(build)


for _kind in ("sector", "cap"):
    for _name, _columns in (("longshort", ("long", "short")), ("gross", ("gross",)), ("net", ("net",))):
        _sides(_kind, _name, _columns)


@chart
def plot_volume_exposures_longshort(t: TearSheets, percentile: float = 0.1) -> Chart:
    """Daily numbers of names of which more than ``percentile`` of the volume is held long, and short."""
    volumes = t.need("market").select("dt", "symbol", "volume")
    parts = [book.volume_exposure(t.need("shares").where(cond), volumes, percentile).withColumnRenamed("names", name) for cond, name in (("shares > 0", "long"), ("shares < 0", "short"))]
    return Chart("Names beyond their share of volume, long and short", parts[0].join(parts[1], "dt", "full_outer").na.fill(0))


@chart
def plot_volume_exposures_gross(t: TearSheets, percentile: float = 0.1) -> Chart:
    return Chart("Names beyond their share of volume", book.volume_exposure(t.need("shares"), t.need("market").select("dt", "symbol", "volume"), percentile))


# ---- attribution


@chart
def show_perf_attrib_stats(t: TearSheets) -> Chart:
    return Chart("Attribution", attribution.perf_attrib_stats(*t.attributed())[0], "table")


@chart
def show_perf_attrib_factors(t: TearSheets) -> Chart:
    return Chart("Attribution by factor", attribution.perf_attrib_stats(*t.attributed())[1], "table")


@chart
def plot_perf_attrib_returns(t: TearSheets) -> Chart:
    day = t.attributed()[1]
    long = day.select("dt", F.explode(F.create_map(*(x for c in ("total", "common", "specific") for x in (F.lit(c), F.col(c))))).alias("sid", "ret"))
    return Chart("Cumulative returns by origin", series.cum_returns(long).select("dt", F.col("sid").alias("line"), "cum"), y=("cum",), group="line")


@chart
def plot_alpha_returns(t: TearSheets) -> Chart:
    return Chart("Distribution of specific returns", report.histogram(t.attributed()[1].select(F.lit(t.sid).alias("sid"), F.col("specific").alias("ret"))).drop("sid"), "bar", x="low", y=("n",))


@chart
def plot_factor_contribution_to_perf(t: TearSheets) -> Chart:
    by = t.attributed()[0].select(F.col("factor").alias("sid"), "dt", F.col("contribution").alias("ret"))
    return Chart("Cumulative contribution by factor", series.cum_returns(by).select("dt", F.col("sid").alias("factor"), "cum"), y=("cum",), group="factor")


@chart
def plot_risk_exposures(t: TearSheets) -> Chart:
    return Chart("Exposures by factor", t.attributed()[0].select("dt", "factor", "exposure"), y=("exposure",), group="factor")


for _name, _fn in _CHARTS.items():
    setattr(TearSheets, _name, _fn)
