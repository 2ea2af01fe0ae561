"""Bootstrap, Monte Carlo and stress scenarios. Draws depend on seed, path and step only, never on partitioning."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import metrics as M

QUANTILES = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]


def uniform(seed: int, *parts: str | Column) -> Column:
    """A number in (0, 1) fixed by the seed and the given columns."""
    h = F.xxhash64(F.lit(seed), *parts)
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(1 << 53)


def normal(seed: int, *parts: str | Column) -> Column:
    """A standard normal number fixed by the seed and the given columns (Box-Muller)."""
    return F.sqrt(-2 * F.ln(uniform(seed, F.lit(1), *parts))) * F.cos(2 * math.pi * uniform(seed, F.lit(2), *parts))


# ---- bootstrap

STATISTICS: dict[str, Callable[[np.ndarray], float]] = {
    "mean": np.mean,
    "std": lambda x: np.std(x, ddof=1),
    "median": np.median,
    "min": np.min,
    "max": np.max,
    "sharpe": lambda x: float(np.mean(x) / s * math.sqrt(252)) if (s := np.std(x, ddof=1)) > 0 else math.copysign(math.inf, np.mean(x)) if np.mean(x) else math.nan,
    "sortino": lambda x: float(np.mean(x) / s * math.sqrt(252)) if (s := np.std(np.minimum(x, 0), ddof=1)) > 0 else math.inf,
}


def statistic_of(name: str | Callable[[np.ndarray], float]) -> Callable[[np.ndarray], float]:
    if callable(name):
        return name
    if name not in STATISTICS:
        raise ValueError(f"statistic must be one of {sorted(STATISTICS)} or a function")
    return STATISTICS[name]


def bootstrap(df: DataFrame, statistic: str | Callable[[np.ndarray], float] = "mean", n_samples: int = 1000, seed: int = 0, chunk: int = 100) -> DataFrame:
    """sid, sample, value: a statistic of ``n_samples`` resamples of each series' valid returns.

    Samples of a series are drawn in chunks on different tasks; a task holds one series (8 bytes a row)."""
    fn = statistic_of(statistic)
    kind = df.schema["sid"].dataType.simpleString()
    packed = df.where("ret IS NOT NULL").groupBy("sid").agg(F.transform(F.array_sort(F.collect_list(F.struct("dt", "ret"))), lambda r: r["ret"]).alias("x"))
    tasks = packed.withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(n_samples - 1), F.lit(chunk)))).repartition("sid", "first")

    def run(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            rows = []
            for sid, x, first in zip(pdf["sid"], pdf["x"], pdf["first"], strict=True):
                x = np.asarray(x, dtype=float)
                rng = np.random.default_rng([seed, int(first), abs(hash(str(sid))) % (1 << 31) if not isinstance(sid, str) else int.from_bytes(sid.encode()[:8], "little")])
                for k in range(first, min(first + chunk, n_samples)):
                    rows.append((sid, k, float(fn(x[rng.integers(0, len(x), len(x))]))))
            yield pd.DataFrame(rows, columns=["sid", "sample", "value"])

    return tasks.mapInPandas(run, f"sid {kind}, sample int, value double")


def distribution(samples: DataFrame, value: str = "value", keys: list[str] | None = None) -> DataFrame:
    """Mean, median, standard deviation, quantiles and interquartile range of a numeric column."""
    q = lambda p: F.percentile(value, F.lit(p))
    return samples.groupBy(*(keys or ["sid"])).agg(
        F.avg(value).alias("mean"), F.median(value).alias("median"), F.stddev_samp(value).alias("std"), q(0.05).alias("p5"), q(0.25).alias("p25"), q(0.75).alias("p75"), q(0.95).alias("p95"), (q(0.75) - q(0.25)).alias("iqr")
    )


def bootstrap_ci(df: DataFrame, statistic: str = "mean", n_samples: int = 1000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """sid, low, high: the percentile interval of a statistic."""
    s = bootstrap(df, statistic, n_samples, seed)
    return s.groupBy("sid").agg(F.percentile("value", F.lit(alpha / 2)).alias("low"), F.percentile("value", F.lit(1 - alpha / 2)).alias("high"))


def bootstrap_summary(df: DataFrame, n_samples: int = 1000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """sid, statistic, mean, std_error, low, high for mean, std, median and sharpe."""
    out = None
    for name in ("mean", "std", "median", "sharpe"):
        s = bootstrap(df, name, n_samples, seed).groupBy("sid").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std_error"), F.percentile("value", F.lit(alpha / 2)).alias("low"), F.percentile("value", F.lit(1 - alpha / 2)).alias("high"))
        part = s.select("sid", F.lit(name).alias("statistic"), "mean", "std_error", "low", "high")
        out = part if out is None else out.unionByName(part)
    return out


def resampled_paths(df: DataFrame, num_days: int, num_samples: int = 1000, seed: int = 0) -> DataFrame:
    """sid, path, step, ret: returns drawn with replacement."""
    ranked = df.where("ret IS NOT NULL").withColumn("k", F.row_number().over(Window.partitionBy("sid").orderBy("dt")) - 1)
    sizes = ranked.groupBy("sid").agg(F.count(F.lit(1)).alias("n"))
    draws = sizes.withColumn("path", F.explode(F.sequence(F.lit(0), F.lit(num_samples - 1)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(num_days))))
    picked = draws.withColumn("k", F.floor(uniform(seed, F.col("sid").cast("string"), "path", "step") * F.col("n")).cast("int"))
    return picked.join(ranked.select("sid", "k", "ret"), ["sid", "k"]).select("sid", "path", "step", "ret")


def compound_paths(paths: DataFrame, starting_value: float = 1.0) -> DataFrame:
    """sid, path, step, value: compounded along each path."""
    w = Window.partitionBy("sid", "path").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return paths.select("sid", "path", "step", (F.product(1 + F.col("ret")).over(w) * starting_value).alias("value"))


def forecast_cone(df: DataFrame, num_days: int, cone_std: tuple[float, ...] = (1.0, 1.5, 2.0), starting_value: float = 1.0, num_samples: int = 1000, seed: int = 0) -> DataFrame:
    """sid, step, mean and mean +/- k population deviations of the compounded resampled paths."""
    v = compound_paths(resampled_paths(df, num_days, num_samples, seed), starting_value).groupBy("sid", "step").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("s"))
    bands = [(F.col("mean") + k * F.col("s")).alias(f"{'up' if k > 0 else 'down'}_{str(abs(k)).replace('.', '_')}") for c in cone_std for k in (c, -c)]
    return v.select("sid", "step", "mean", *bands)


def consistency_score(actual: DataFrame, paths: DataFrame) -> DataFrame:
    """sid, step, score: share of paths below what was reached; ``actual`` has sid, step, value."""
    j = paths.join(actual.withColumnRenamed("value", "reached"), ["sid", "step"])
    return j.groupBy("sid", "step").agg(F.avg((F.col("value") < F.col("reached")).cast("double")).alias("score"))


def bayes_cone(paths: DataFrame) -> DataFrame:
    """sid, step, percentiles 5, 25, 50, 75 and 95 of predictive paths."""
    return paths.groupBy("sid", "step").agg(*(F.percentile("value", F.lit(p / 100)).alias(f"p{p}") for p in (5, 25, 50, 75, 95)))


# ---- Monte Carlo


def gbm(spark: SparkSession, mu: float, sigma: float, s0: float = 1.0, n_paths: int = 1000, horizon: int = 252, frequency: int = 252, seed: int = 0, antithetic: bool = False) -> DataFrame:
    """path, step (0..horizon), value: geometric Brownian motion with annual drift and volatility.

    With ``antithetic`` the second half of the paths has the first half's draws with the sign turned."""
    dt = 1.0 / frequency
    base = F.col("path") % (n_paths // 2) if antithetic and n_paths > 1 else F.col("path")
    sign = F.when(F.col("path") >= n_paths // 2, -1.0).otherwise(1.0) if antithetic and n_paths > 1 else F.lit(1.0)
    steps = spark.range(n_paths).withColumnRenamed("id", "path").withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    z = sign * normal(seed, base, "step")
    inc = (mu - 0.5 * sigma * sigma) * dt + sigma * math.sqrt(dt) * z
    w = Window.partitionBy("path").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    moved = steps.withColumn("inc", inc).select("path", "step", (s0 * F.exp(F.sum("inc").over(w))).alias("value"))
    return moved.unionByName(spark.range(n_paths).select(F.col("id").alias("path"), F.lit(0).alias("step"), F.lit(float(s0)).alias("value")))


def estimate_parameters(df: DataFrame, frequency: int = 252) -> DataFrame:
    """sid, mu, sigma, annualised."""
    return df.groupBy("sid").agg((F.avg("ret") * frequency).alias("mu"), (F.stddev_samp("ret") * math.sqrt(frequency)).alias("sigma"))


def annualize(value: float, period: str = "daily") -> float:
    from ..functions.periods import annualization_factor

    return value * math.sqrt(annualization_factor(period))


def antithetic_reflection(paths: DataFrame) -> DataFrame:
    """The paths and their reflections about the start value."""
    start = Window.partitionBy("path").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n = paths.select(F.max("path") + 1).first()[0] or 0
    mirror = paths.withColumn("value", 2 * F.first("value").over(start) - F.col("value")).withColumn("path", F.col("path") + F.lit(n))
    return paths.unionByName(mirror)


def latin_hypercube(spark: SparkSession, n_samples: int, n_dimensions: int, seed: int = 0) -> DataFrame:
    """sample, dim, u: one point in each of ``n_samples`` strata of every dimension."""
    grid = spark.range(n_samples).withColumnRenamed("id", "sample").withColumn("dim", F.explode(F.sequence(F.lit(0), F.lit(n_dimensions - 1))))
    order = F.row_number().over(Window.partitionBy("dim").orderBy(uniform(seed, F.lit("order"), "dim", "sample"), "sample"))
    return grid.select("sample", "dim", ((order - 1 + uniform(seed, F.lit("inside"), "dim", "sample")) / n_samples).alias("u"))


class SimResult:
    """Simulated paths (path, step, value) and what can be asked of them."""

    def __init__(self, paths: DataFrame) -> None:
        self.paths = paths

    def __repr__(self) -> str:
        return f"SimResult({', '.join(self.paths.columns)})"

    @property
    def terminal(self) -> DataFrame:
        return self.paths.groupBy("path").agg(F.max_by("value", "step").alias("value"))

    def shape(self) -> DataFrame:
        """One row: n_paths, horizon."""
        return self.paths.agg(F.count_distinct("path").alias("n_paths"), F.max("step").alias("horizon"))

    def statistics(self) -> DataFrame:
        qs = [F.percentile("value", F.lit(q)).alias(f"p{int(q * 100)}") for q in QUANTILES]
        return self.terminal.agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), *qs)

    def var(self, alpha: float = 0.05) -> DataFrame:
        return self.terminal.agg(F.percentile("value", F.lit(alpha)).alias("var"))

    def cvar(self, alpha: float = 0.05) -> DataFrame:
        # one row
        return self.terminal.join(F.broadcast(self.var(alpha))).where("value <= var").agg(F.avg("value").alias("cvar"))

    def to_dataframe(self) -> DataFrame:
        return self.paths


class MonteCarlo:
    """Simulation from the estimated drift and volatility of one series (dt, ret)."""

    def __init__(self, df: DataFrame) -> None:
        self.df = df.where("ret IS NOT NULL")

    def _parameters(self) -> tuple[float, float]:
        r = estimate_parameters(self.df.withColumn("sid", F.lit(0))).first()
        if r is None or r["mu"] is None:
            raise ValueError("returns are empty")
        return float(r["mu"]), float(r["sigma"] or 0.0)

    def simulate(self, n_paths: int = 1000, horizon: int = 252, *, drift: float | None = None, volatility: float | None = None, antithetic: bool = False, seed: int = 0, s0: float = 1.0) -> SimResult:
        mu, sigma = self._parameters()
        return SimResult(gbm(self.df.sparkSession, mu if drift is None else drift, sigma if volatility is None else volatility, s0, n_paths, horizon, seed=seed, antithetic=antithetic))

    price_paths = simulate

    def var(self, alpha: float = 0.05, n_paths: int = 10_000, horizon: int = 252, seed: int = 0) -> DataFrame:
        return self.simulate(n_paths, horizon, seed=seed).var(alpha)

    def cvar(self, alpha: float = 0.05, n_paths: int = 10_000, horizon: int = 252, seed: int = 0) -> DataFrame:
        return self.simulate(n_paths, horizon, seed=seed).cvar(alpha)

    def stress(self, scenarios: list[str] | None = None, custom: dict[str, dict[str, float]] | None = None) -> DataFrame:
        return stress_test(self.df.withColumn("sid", F.lit(0)), scenarios, custom)

    @staticmethod
    def from_parameters(spark: SparkSession, mu: float, sigma: float, s0: float = 1.0, n_paths: int = 1000, horizon: int = 252, seed: int = 0) -> SimResult:
        return SimResult(gbm(spark, mu, sigma, s0, n_paths, horizon, seed=seed))


# ---- stress

# The named scenarios; a crash sets the middle return to -20 %, a spike to +10 %, the others scale all returns.
SCENARIOS = ("crash", "spike", "vol_crush", "vol_spike")


def stress_test(df: DataFrame, scenarios: list[str] | None = None, custom: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """sid, scenario, cumulative_return, max_drawdown (from the running peak, start not counted), volatility, final_value.

    crash and spike set the middle return to -20 % and +10 %, vol_crush halves and vol_spike doubles all, custom ones
    shift, then multiply."""
    if scenarios is None and custom is None:
        scenarios = list(SCENARIOS)
    known = df.where("ret IS NOT NULL")
    ranked = M.numbered(known).withColumnRenamed("rn", "k").join(known.groupBy("sid").agg(F.count(F.lit(1)).alias("n")), "sid")
    mid, r = F.col("k") == F.floor(F.col("n") / 2) + 1, F.col("ret")
    made = {"crash": F.when(mid, -0.2).otherwise(r), "spike": F.when(mid, 0.1).otherwise(r), "vol_crush": r * 0.5, "vol_spike": r * 2.0}
    shocks = {s: made[s] for s in scenarios or [] if s in made}
    for name, p in (custom or {}).items():
        shocks[name] = (r + p.get("return_shift", 0.0)) * p.get("return_mult", 1.0)
    pairs = F.create_map(*[x for s, c in shocks.items() for x in (F.lit(s), c)])
    long = ranked.select("sid", "dt", F.explode(pairs).alias("scenario", "ret"))
    nav = M.with_nav(long, ["sid", "scenario"])
    return nav.groupBy("sid", "scenario").agg(
        (F.max_by("nav", "rn") - 1).alias("cumulative_return"), F.min("dd1").alias("max_drawdown"), (F.stddev_samp("ret") * math.sqrt(252)).alias("volatility"), F.max_by("nav", "rn").alias("final_value")
    )


def scenario_table(results: DataFrame) -> DataFrame:
    """Formatted percentages."""
    pct = lambda c: F.concat(F.format_number(F.col(c) * 100, 2), F.lit("%")).alias(c)
    return results.select("sid", "scenario", pct("cumulative_return"), pct("max_drawdown"), pct("volatility"))


def correlation_breakdown(n_assets: int, target_correlation: float = 1.0) -> np.ndarray:
    out = np.full((n_assets, n_assets), float(target_correlation))
    np.fill_diagonal(out, 1.0)
    return out
