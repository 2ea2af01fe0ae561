"""Queries over simulation, tail models, volatility models and optimisation; SQL where nothing is random or iterative."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bayes as Y
from ..operators import book as K
from ..operators import optimise as O
from ..operators import simulate as S
from ..operators import tails as T
from ..sources.tables import table
from .series_queries import _rounded
from .views import P_SQL, R_SQL, T_SQL, positions, returns, trades

Query = Callable[[SparkSession, str], DataFrame]
N = "+ 3.7e-11"


def _few(spark: SparkSession, sf: str) -> DataFrame:
    """Daily returns by ship mode flag: three long series."""
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("sid"), F.to_date("l_shipdate").alias("dt"))
    return rows.agg(F.round(F.avg("l_discount") - 0.05, 6).alias("ret"))


def _market(spark: SparkSession, sf: str) -> DataFrame:
    """Daily returns of everything together."""
    return table(spark, sf, "lineitem").groupBy(F.to_date("l_shipdate").alias("dt")).agg(F.round(F.avg("l_discount") - 0.05, 6).alias("ret"))


def _weights(result: dict[str, object], spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(str(k), float(v)) for k, v in result["weights"].items()], "sid string, weight double")


QUERIES: dict[str, Query] = {
    "bootstrap_ci": lambda s, d: _rounded(S.bootstrap_ci(_few(s, d), "sharpe", 500, seed=1)),
    "bootstrap_summary": lambda s, d: _rounded(S.bootstrap_summary(_few(s, d), 200, seed=1)),
    "forecast_cone": lambda s, d: _rounded(S.forecast_cone(_few(s, d), 20, num_samples=200, seed=1)),
    "consistency_score": lambda s, d: _rounded(S.consistency_score(S.compound_paths(S.resampled_paths(_few(s, d), 20, 1, 9)).select("sid", "step", "value"), S.compound_paths(S.resampled_paths(_few(s, d), 20, 200, 1)))),
    "bayes_cone": lambda s, d: _rounded(S.bayes_cone(S.compound_paths(S.resampled_paths(_few(s, d), 20, 200, 1)))),
    "gbm_paths": lambda s, d: _rounded(S.gbm(s, 0.08, 0.2, 100.0, 500, 60, seed=1)),
    "monte_carlo_var": lambda s, d: _rounded(S.MonteCarlo(_market(s, d)).var(0.05, 500, 60, seed=1)),
    "monte_carlo_cvar": lambda s, d: _rounded(S.MonteCarlo(_market(s, d)).cvar(0.05, 500, 60, seed=1)),
    "monte_carlo_statistics": lambda s, d: _rounded(S.MonteCarlo(_market(s, d)).simulate(500, 60, antithetic=True, seed=1).statistics()),
    "latin_hypercube": lambda s, d: _rounded(S.latin_hypercube(s, 200, 3, 1)),
    "estimate_parameters": lambda s, d: _rounded(S.estimate_parameters(returns(s, d))),
    "return_distribution": lambda s, d: _rounded(S.distribution(returns(s, d), "ret")),
    "stress_test": lambda s, d: _rounded(S.stress_test(returns(s, d), list(S.SCENARIOS), {"shift": {"return_shift": -0.001, "return_mult": 1.5}})),
    "scenario_table": lambda s, d: S.scenario_table(S.stress_test(_few(s, d))),
    "hill_estimator": lambda s, d: _rounded(T.hill_estimator(_few(s, d)), 5),
    "gpd_pwm": lambda s, d: _rounded(T.gpd_pwm(_few(s, d)), 5),
    "gpd_fit": lambda s, d: _rounded(T.gpd_fit(_few(s, d)), 4),
    "gev_fit": lambda s, d: _rounded(T.gev_fit(_few(s, d)), 4),
    "evt_var_cvar_gpd": lambda s, d: _rounded(T.extreme_risk(_few(s, d)), 4),
    "evt_var_cvar_gev": lambda s, d: _rounded(T.extreme_risk(_few(s, d), model="gev"), 4),
    "gpd_risk_estimates": lambda s, d: _rounded(T.gpd_risk_estimates(_few(s, d)), 4),
    "garch": lambda s, d: _rounded(T.garch_fit(_few(s, d)), 4),
    "egarch": lambda s, d: _rounded(T.garch_fit(_few(s, d), "EGARCH"), 4),
    "gjr_garch": lambda s, d: _rounded(T.garch_fit(_few(s, d), "GJRGARCH"), 4),
    "forecast_volatility": lambda s, d: _rounded(T.forecast_volatility(_few(s, d), horizon=5), 5),
    "conditional_var": lambda s, d: _rounded(T.conditional_var(_few(s, d)), 5),
    "optimize_max_sharpe": lambda s, d: _rounded(_weights(O.optimize(_few(s, d), "max_sharpe"), s), 3),
    "optimize_min_variance": lambda s, d: _rounded(_weights(O.optimize(_few(s, d), "min_variance"), s), 5),
    "efficient_frontier": lambda s, d: _rounded(O.efficient_frontier(_few(s, d), 10).drop("weights"), 4),
    "risk_parity": lambda s, d: _rounded(_weights(O.risk_parity(_few(s, d)), s), 6),
}


def _summary(draws: DataFrame) -> DataFrame:
    return draws.groupBy("sid", "parameter").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))


def _slippage_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Cumulative return after each slippage level: all levels in one pass over the daily profits."""
    value = positions(spark, sf).groupBy("dt").agg(F.sum("value").alias("pv"))
    traded = K.txn_volume(trades(spark, sf).withColumn("ts", F.trunc("ts", "month")))
    r = returns(spark, sf).groupBy(F.trunc("dt", "month").alias("dt")).agg(F.round(F.avg("ret") + 3.7e-10, 6).alias("ret"))
    j = r.join(value, "dt").join(traded, "dt").withColumn("bps", F.explode(F.array(*(F.lit(float(b)) for b in (0, 1, 3, 5, 10)))))
    cost = F.try_divide(F.col("txn_volume") * F.col("bps") * 1e-7, F.abs("pv"))
    return j.withColumn("ret", F.col("ret") - F.coalesce(cost, F.lit(0.0))).groupBy("bps").agg((F.product(1 + F.col("ret")) - 1).alias("cum"))


QUERIES |= {
    "bayes_normal": lambda s, d: _rounded(_summary(Y.run_model(_few(s, d), "normal", 300)), 5),
    "bayes_student_t": lambda s, d: _rounded(_summary(Y.run_model(_few(s, d), "t", 300)), 5),
    "bayes_alpha_beta": lambda s, d: _rounded(_summary(Y.run_model(returns(s, d), "alpha_beta", 300)), 5),
    "bayes_stoch_vol": lambda s, d: _rounded(_summary(Y.run_model(_few(s, d), "stoch_vol", 100, 2)), 5),
    "bayes_compare": lambda s, d: _rounded(Y.compare_groups(_few(s, d), "A", "R", 300), 5),
    "bayes_predictive_cone": lambda s, d: _rounded(S.bayes_cone(S.compound_paths(Y.posterior_paths(Y.run_model(_few(s, d), "t", 100), 20))), 5),
    "slippage_sweep": lambda s, d: _rounded(_slippage_sweep(s, d)),
}

_FEW = "RF AS (SELECT l_returnflag AS sid, CAST(l_shipdate AS DATE) AS dt, round(avg(l_discount) - 0.05, 6) AS ret FROM lineitem GROUP BY 1, 2)"
_Q = lambda p: f"quantile_cont(ret, CAST({p} AS DOUBLE))"

SQL: dict[str, str] = {
    "slippage_sweep": f"""WITH {R_SQL}, {T_SQL}, {P_SQL}, RM AS (SELECT CAST(date_trunc('month', dt) AS DATE) AS dt, round(avg(ret) + 3.7e-10, 6) AS ret FROM R GROUP BY 1), D AS (SELECT dt, sum(value) AS pv FROM P GROUP BY dt), V AS (SELECT CAST(date_trunc('month', ts) AS DATE) AS dt, sum(abs(amount) * price) AS v FROM T GROUP BY 1)
      SELECT bps, round(product(1 + ret - v * bps * 1e-7 / abs(pv)) - 1 {N}, 7) AS cum FROM RM JOIN D USING (dt) JOIN V USING (dt), (SELECT CAST(unnest([0, 1, 3, 5, 10]) AS DOUBLE) AS bps) b GROUP BY bps""",
    "estimate_parameters": f"WITH {R_SQL} SELECT sid, round(avg(ret) * 252 {N}, 7) AS mu, round(stddev_samp(ret) * sqrt(252) {N}, 7) AS sigma FROM R GROUP BY sid",
    "return_distribution": f"WITH {R_SQL} SELECT sid, round(avg(ret) {N}, 7) AS mean, round(median(ret) {N}, 7) AS median, round(stddev_samp(ret) {N}, 7) AS std, round({_Q(0.05)} {N}, 7) AS p5, round({_Q(0.25)} {N}, 7) AS p25, round({_Q(0.75)} {N}, 7) AS p75, round({_Q(0.95)} {N}, 7) AS p95, round({_Q(0.75)} - {_Q(0.25)} {N}, 7) AS iqr FROM R GROUP BY sid",
    "stress_test": f"""WITH {R_SQL}, K AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY dt) AS k, count(*) OVER (PARTITION BY sid) AS n FROM R),
      X AS (SELECT sid, dt, 'crash' AS scenario, CASE WHEN k = n // 2 + 1 THEN -0.2 ELSE ret END AS ret FROM K UNION ALL SELECT sid, dt, 'spike', CASE WHEN k = n // 2 + 1 THEN 0.1 ELSE ret END FROM K UNION ALL SELECT sid, dt, 'vol_crush', ret * 0.5 FROM K UNION ALL SELECT sid, dt, 'vol_spike', ret * 2 FROM K UNION ALL SELECT sid, dt, 'shift', (ret - 0.001) * 1.5 FROM K),
      C AS (SELECT *, product(1 + ret) OVER (PARTITION BY sid, scenario ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM X),
      D AS (SELECT *, c / max(c) OVER (PARTITION BY sid, scenario ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS d FROM C)
      SELECT sid, scenario, round(product(1 + ret) - 1 {N}, 7) AS cumulative_return, round(min(d) {N}, 7) AS max_drawdown, round(stddev_samp(ret) * sqrt(252) {N}, 7) AS volatility, round(product(1 + ret) {N}, 7) AS final_value FROM D GROUP BY 1, 2""",
    "scenario_table": f"""WITH {_FEW}, K AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY dt) AS k, count(*) OVER (PARTITION BY sid) AS n FROM RF),
      X AS (SELECT sid, dt, 'crash' AS scenario, CASE WHEN k = n // 2 + 1 THEN -0.2 ELSE ret END AS ret FROM K UNION ALL SELECT sid, dt, 'spike', CASE WHEN k = n // 2 + 1 THEN 0.1 ELSE ret END FROM K UNION ALL SELECT sid, dt, 'vol_crush', ret * 0.5 FROM K UNION ALL SELECT sid, dt, 'vol_spike', ret * 2 FROM K),
      C AS (SELECT *, product(1 + ret) OVER (PARTITION BY sid, scenario ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM X),
      D AS (SELECT *, c / max(c) OVER (PARTITION BY sid, scenario ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS d FROM C),
      Y AS (SELECT sid, scenario, product(1 + ret) - 1 AS a, min(d) AS b, stddev_samp(ret) * sqrt(252) AS v FROM D GROUP BY 1, 2)
      SELECT sid, scenario, format('{{:,.2f}}%', a * 100) AS cumulative_return, format('{{:,.2f}}%', b * 100) AS max_drawdown, format('{{:,.2f}}%', v * 100) AS volatility FROM Y""",
    "hill_estimator": f"WITH {_FEW}, U AS (SELECT sid, quantile_cont(ret, CAST(0.9 AS DOUBLE)) AS u FROM RF WHERE ret > 0 GROUP BY sid) SELECT sid, round(CASE WHEN count(*) >= 10 THEN avg(ln(ret - u)) - min(ln(ret - u)) END {N}, 5) AS xi, count(*) AS exceedances FROM RF JOIN U USING (sid) WHERE ret > u GROUP BY sid",
    "gpd_pwm": f"""WITH {_FEW}, U AS (SELECT sid, quantile_cont(-ret, CAST(0.9 AS DOUBLE)) AS u FROM RF WHERE ret < 0 GROUP BY sid), E AS (SELECT sid, u, -ret - u AS e, row_number() OVER (PARTITION BY sid ORDER BY -ret) AS i FROM RF JOIN U USING (sid) WHERE -ret > u),
      M AS (SELECT sid, max(u) AS u, count(*) AS n, avg(e) AS m1, 2.0 * sum(i * e) / (count(*) * count(*)) AS m2 FROM E GROUP BY sid HAVING count(*) >= 10)
      SELECT sid, round((m1 / (m1 - 2 * m2) - 2) / 3 {N}, 5) AS xi, round(2 * m1 * m2 / (m1 - 2 * m2) {N}, 5) AS beta, round(u {N}, 5) AS threshold, n AS n_exceed FROM M""",
}
