"""Queries over stat packs and report tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import STRESS_PERIODS
from ..operators import report as P
from ..operators import series as S
from ..sources.tables import table
from .metric_queries import SQL_EXPR
from .series_queries import _rounded
from .views import R_SQL, RUNS_SQL, returns

Query = Callable[[SparkSession, str], DataFrame]
N = "+ 3.7e-11"


def _trades(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as closed trades."""
    return table(spark, sf, "lineitem").select((F.col("l_extendedprice") * (F.col("l_discount") - F.col("l_tax") - 0.01)).alias("pnlcomm"), (F.col("l_extendedprice") * 0.001).alias("commission"), (F.col("l_linestatus") == "O").alias("long"), F.col("l_linenumber").alias("barlen"))


QUERIES: dict[str, Query] = {
    "perf_stats": lambda s, d: _rounded(P.perf_stats(returns(s, d)), 6),
    "extended_stats": lambda s, d: _rounded(P.extended_stats(returns(s, d)), 6),
    "period_returns": lambda s, d: _rounded(P.period_returns(returns(s, d))),
    "monthly_table": lambda s, d: _rounded(P.monthly_table(returns(s, d))),
    "return_quantiles": lambda s, d: _rounded(P.return_quantiles(returns(s, d))),
    "return_histogram": lambda s, d: P.histogram(returns(s, d).withColumn("ret", F.col("ret") + 1e-7), "ret", 7).select("sid", "bin", "n"),
    "trade_stats": lambda s, d: _rounded(P.trade_stats(_trades(s, d)), 4),
    "interesting_periods": lambda s, d: S.interesting_periods(returns(s, d), STRESS_PERIODS).groupBy("sid", "name").agg(F.count(F.lit(1)).alias("days")),
}

_STATS = ["annual_return", "cum_returns_final", "annual_volatility", "sharpe_ratio", "calmar_ratio", "stability_of_timeseries", "max_drawdown", "omega_ratio", "sortino_ratio", "skewness", "kurtosis", "tail_ratio", "value_at_risk", "alpha", "beta"]
_MORE = [s for s in P.EXTENDED]


def _stack(names: list[str]) -> str:
    cols = ", ".join(f"CAST({SQL_EXPR[n]} AS DOUBLE) AS {n}" for n in names)
    return f"WITH {RUNS_SQL}, W AS (SELECT sid, {cols} FROM NV GROUP BY sid) " + " UNION ALL ".join(f"SELECT sid, '{n}' AS stat, round({n} {N}, 6) AS value FROM W" for n in names)


_WK = "WK AS (SELECT sid, year(dt) AS y, week(dt) AS p, product(1 + ret) - 1 AS ret FROM R GROUP BY 1, 2, 3), MO AS (SELECT sid, year(dt) AS y, month(dt) AS p, product(1 + ret) - 1 AS ret FROM R GROUP BY 1, 2, 3)"
_P = "CASE {} END".format(" ".join(f"WHEN p = '{p}' THEN {r}" for p, r in P.PERIOD_ROWS.items()))

SQL: dict[str, str] = {
    "perf_stats": _stack(_STATS),
    "extended_stats": _stack(_MORE),
    "period_returns": f"""WITH {R_SQL}, K AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY dt DESC) AS k, count(*) OVER (PARTITION BY sid) AS n, max(dt) OVER (PARTITION BY sid) AS last FROM R),
      PS AS (SELECT unnest([{', '.join(f"'{p}'" for p in (*P.PERIOD_ROWS, 'YTD', 'inception'))}]) AS p),
      J AS (SELECT K.*, p FROM K, PS WHERE p = 'inception' OR (p = 'YTD' AND year(dt) = year(last)) OR (k <= {_P} AND n >= {_P}))
      SELECT sid, p AS period, round(product(1 + ret) - 1 {N}, 7) AS ret, round(avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) {N}, 7) AS win_rate FROM J GROUP BY 1, 2""",
    "monthly_table": f"WITH {R_SQL}, {_WK} SELECT sid, y AS year, " + ", ".join(f'round(max(ret) FILTER (WHERE p = {i}) {N}, 7) AS "{i}"' for i in range(1, 13)) + " FROM MO GROUP BY 1, 2",
    "return_quantiles": f"""WITH {R_SQL}, {_WK}, A AS (SELECT sid, 'daily' AS level, ret FROM R UNION ALL SELECT sid, 'weekly', ret FROM WK UNION ALL SELECT sid, 'monthly', ret FROM MO)
      SELECT sid, level, round(min(ret) {N}, 7) AS min, round(quantile_cont(ret, CAST(0.25 AS DOUBLE)) {N}, 7) AS p25, round(median(ret) {N}, 7) AS median, round(quantile_cont(ret, CAST(0.75 AS DOUBLE)) {N}, 7) AS p75, round(max(ret) {N}, 7) AS max FROM A GROUP BY 1, 2""",
    "return_histogram": f"WITH {R_SQL}, S AS (SELECT sid, min(ret) + 1e-7 AS a, max(ret) + 1e-7 AS b FROM R GROUP BY sid) SELECT R.sid, CAST(least(floor((ret + 1e-7 - a) / ((b - a) / 7)), 6) AS INTEGER) AS bin, count(*) AS n FROM R JOIN S USING (sid) GROUP BY 1, 2",
    "trade_stats": f"""WITH X AS (SELECT l_extendedprice * (l_discount - l_tax - 0.01) AS p, l_extendedprice * 0.001 AS c, l_linestatus = 'O' AS lg, l_linenumber AS b FROM lineitem)
      SELECT count(p) AS trades, count(*) FILTER (WHERE p > 0) AS won, count(*) FILTER (WHERE p < 0) AS lost, round(count(*) FILTER (WHERE p > 0) / count(p) {N}, 4) AS win_rate, round(sum(p) {N}, 4) AS total, round(avg(p) {N}, 4) AS average,
      round(avg(p) FILTER (WHERE p > 0) {N}, 4) AS average_win, round(avg(p) FILTER (WHERE p < 0) {N}, 4) AS average_loss, round(max(p) {N}, 4) AS best, round(min(p) {N}, 4) AS worst, round(sum(p) FILTER (WHERE p > 0) / -sum(p) FILTER (WHERE p < 0) {N}, 4) AS profit_factor,
      round(avg(p) FILTER (WHERE p > 0) / -avg(p) FILTER (WHERE p < 0) {N}, 4) AS payoff, round(sum(c) {N}, 4) AS commission, count(*) FILTER (WHERE lg) AS long_trades, round(count(*) FILTER (WHERE lg AND p > 0) / count(*) FILTER (WHERE lg) {N}, 4) AS long_win_rate, round(sum(p) FILTER (WHERE lg) {N}, 4) AS long_total,
      count(*) FILTER (WHERE NOT lg) AS short_trades, round(count(*) FILTER (WHERE NOT lg AND p > 0) / count(*) FILTER (WHERE NOT lg) {N}, 4) AS short_win_rate, round(sum(p) FILTER (WHERE NOT lg) {N}, 4) AS short_total, round(avg(b) {N}, 4) AS average_bars, max(b) AS longest_bars FROM X""",
    "interesting_periods": f"WITH {R_SQL}, D(name, a, b) AS (VALUES " + ", ".join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in STRESS_PERIODS) + ") SELECT sid, name, count(*) AS days FROM R JOIN D ON dt BETWEEN a AND b GROUP BY 1, 2",
}
