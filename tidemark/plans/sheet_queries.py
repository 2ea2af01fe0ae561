"""Queries over tear sheet tables and helpers that no other module covers, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sheets as H
from ..functions.constants import STRESS_PERIODS
from ..operators import common as C
from ..viz import correlations
from .book_queries import _BT_SQL, _TRIPS_SQL, _brand_trades, _caps, _loadings, _sectors
from .series_queries import _rounded
from .views import P_SQL, R_SQL, market, positions, returns, trades

Query = Callable[[SparkSession, str], DataFrame]
N = "+ 3.7e-11"
LEVELS = (3.0, 8.0, 20.0)


def _sheets(spark: SparkSession, sf: str) -> H.TearSheets:
    """One portfolio: monthly mean return and benchmark, brands as positions."""
    m = returns(spark, sf).groupBy(F.trunc("dt", "month").alias("dt")).agg(F.round(F.avg("ret") + 3.7e-10, 6).alias("ret"), F.round(F.avg("f") + 3.7e-10, 6).alias("f"))
    return H.TearSheets(
        m.select(F.lit(0).alias("sid"), "dt", "ret", "f"), estimate_intraday=False, positions=positions(spark, sf), transactions=_brand_trades(spark, sf), market=market(spark, sf), sectors=_sectors(spark, sf), caps=_caps(spark, sf), loadings=_loadings(spark, sf),
        cap_buckets=[("small", 0.0, 1000.0), ("mid", 1000.0, 1500.0), ("large", 1500.0, 1e12)],
    )


def _chart(name: str, digits: int = 7, **options: object) -> Query:
    return lambda s, d: _rounded(getattr(_sheets(s, d), name)(**options).data, digits)


def _posterior(spark: SparkSession, sf: str) -> DataFrame:
    """Share of winners of all round trips, and whether its posterior interval holds it."""
    from ..operators import round_trips as T

    trips = T.round_trips(trades(spark, sf), order="seq")
    share = trips.agg(F.count(F.lit(1)).alias("trips"), F.avg((F.col("pnl") > 0).cast("double")).alias("share"))
    post = H.profit_posterior(trips).agg(F.min("low").alias("low"), F.max("high").alias("high"), (F.sum("density") / F.count(F.lit(1))).alias("mass"))
    j = share.join(F.broadcast(post))  # single rows
    return j.select("trips", F.round("share", 6).alias("share"), F.col("share").between(F.col("low"), F.col("high")).alias("holds"), (F.abs(F.col("mass") - 1) < 0.01).alias("mass_is_one"))


QUERIES: dict[str, Query] = {
    "sheet_holdings": _chart("plot_holdings"),
    "sheet_long_short_holdings": _chart("plot_long_short_holdings"),
    "sheet_sector_allocations": _chart("plot_sector_allocations"),
    "sheet_sector_exposures": lambda s, d: _rounded(H._grouped(_sheets(s, d), "sector"), 2, 3.7e-7),
    "sheet_cap_exposures": lambda s, d: _rounded(H._grouped(_sheets(s, d), "cap"), 2, 3.7e-7),
    "sheet_monthly_returns": _chart("plot_monthly_returns_timeseries"),
    "sheet_stress_periods": _chart("show_interesting_times"),
    "sheet_growth": _chart("plot_rolling_returns"),
    "sheet_volatility_matched": _chart("plot_volatility_matched_returns"),
    "sheet_turnover": _chart("plot_turnover"),
    "sheet_slippage_levels": lambda s, d: _rounded(H.slippage_levels(_sheets(s, d), LEVELS)),
    "sheet_profit_posterior": _posterior,
    "standardized_returns": lambda s, d: _rounded(C.standardize_data(returns(s, d)).select("sid", "dt", "standardized"), 6),
    "clipped_to_benchmark": lambda s, d: _rounded(C.clip_returns_to_benchmark(returns(s, d).select("sid", "dt", "ret"), returns(s, d).where("sid = 1").select("dt", "ret"))),
    "correlation_matrix": lambda s, d: _rounded(correlations(returns(s, d).groupBy((F.col("sid") % 7).alias("sid"), "dt").agg(F.avg("ret").alias("ret")))),
    "previous_business_days": lambda s, d: returns(s, d).select("dt").distinct().select(F.col("dt").cast("string").alias("dt"), C.previous_business_day(F.col("dt")).cast("string").alias("previous")),
    "table_differences": lambda s, d: C.table_differences(positions(s, d), positions(s, d).withColumn("value", F.when(F.col("symbol") == "cash", F.col("value") + 1).otherwise(F.col("value"))), ["dt", "symbol"])["rows"].select(F.col("dt").cast("string").alias("dt"), "symbol", "column", "left", "right"),
}

_TS = "CAST(dt AS VARCHAR) AS dt"
_MONTH = f"{R_SQL}, RM AS (SELECT CAST(date_trunc('month', dt) AS DATE) AS dt, round(avg(ret) + 3.7e-10, 6) AS ret, round(avg(f) + 3.7e-10, 6) AS f FROM R GROUP BY 1)"
_SEC = "SEC AS (SELECT DISTINCT p_brand AS symbol, right(p_brand, 1) AS name FROM part)"
_CAP = "SEC AS (SELECT p_brand AS symbol, CASE WHEN max(p_retailprice) < 1000 THEN 'small' WHEN max(p_retailprice) < 1500 THEN 'mid' ELSE 'large' END AS name FROM part GROUP BY 1)"
_SIDES = "SELECT CAST(dt AS VARCHAR) AS dt, name, round(coalesce(l, 0) + 3.7e-7, 2) AS long, round(coalesce(s, 0) + 3.7e-7, 2) AS short, round(coalesce(l, 0) - coalesce(s, 0) + 3.7e-7, 2) AS gross, round(coalesce(l, 0) + coalesce(s, 0) + 3.7e-7, 2) AS net FROM (SELECT dt, name, sum(value) FILTER (WHERE value > 0) AS l, sum(value) FILTER (WHERE value < 0) AS s, count(*) FILTER (WHERE value <> 0) AS c FROM P JOIN SEC USING (symbol) GROUP BY 1, 2) x WHERE c > 0"
_PERIODS = ", ".join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in STRESS_PERIODS)
_GROW = "product(1 + {c}) OVER (ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_TURN = f"""{_BT_SQL}, {P_SQL}, G AS (SELECT dt, sum(abs(value)) AS g FROM P WHERE symbol <> 'cash' GROUP BY dt), D AS (SELECT dt, CASE WHEN row_number() OVER (ORDER BY dt) = 1 THEN g / 2 ELSE avg(g) OVER (ORDER BY dt ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) END AS b FROM G),
  V AS (SELECT CAST(ts AS DATE) AS dt, sum(abs(amount) * price) AS v FROM BT GROUP BY 1), X AS (SELECT coalesce(D.dt, V.dt) AS dt, coalesce(v / nullif(b, 0), 0) AS t FROM D FULL JOIN V ON V.dt = D.dt)"""

SQL: dict[str, str] = {
    "sheet_holdings": f"WITH {P_SQL} SELECT {_TS}, count(*) FILTER (WHERE value <> 0) AS holdings FROM P WHERE symbol <> 'cash' GROUP BY P.dt",
    "sheet_long_short_holdings": f"WITH {P_SQL} SELECT {_TS}, count(*) FILTER (WHERE value > 0) AS long, count(*) FILTER (WHERE value < 0) AS short FROM P WHERE symbol <> 'cash' GROUP BY P.dt",
    "sheet_sector_allocations": f"WITH {P_SQL}, {_SEC}, A AS (SELECT dt, symbol, value / nullif(sum(value) OVER (PARTITION BY dt), 0) AS alloc FROM P) SELECT {_TS}, name AS sector, round(sum(alloc) {N}, 7) AS alloc FROM A JOIN SEC USING (symbol) GROUP BY A.dt, name",
    "sheet_sector_exposures": f"WITH {P_SQL}, {_SEC} {_SIDES}",
    "sheet_cap_exposures": f"WITH {P_SQL}, {_CAP} {_SIDES}",
    "sheet_monthly_returns": f"WITH {_MONTH} SELECT {_TS}, round(ret {N}, 7) AS ret FROM RM",
    "sheet_stress_periods": f"WITH {_MONTH}, S AS (SELECT * FROM (VALUES {_PERIODS}) v(name, a, b)) SELECT name, round(avg(ret) {N}, 7) AS mean, round(min(ret) {N}, 7) AS least, round(max(ret) {N}, 7) AS greatest, count(ret) AS days FROM RM JOIN S ON dt BETWEEN a AND b GROUP BY name",
    "sheet_growth": f"WITH {_MONTH} SELECT {_TS}, 'strategy' AS line, round({_GROW.format(c='ret')} {N}, 7) AS cum FROM RM UNION ALL SELECT {_TS}, 'benchmark', round({_GROW.format(c='f')} {N}, 7) FROM RM",
    "sheet_volatility_matched": f"WITH {_MONTH}, K AS (SELECT stddev_samp(f) / stddev_samp(ret) AS k FROM RM), Z AS (SELECT dt, ret * k AS z, f FROM RM, K) SELECT {_TS}, 'strategy' AS line, round({_GROW.format(c='z')} {N}, 7) AS cum FROM Z UNION ALL SELECT {_TS}, 'benchmark', round({_GROW.format(c='f')} {N}, 7) FROM Z",
    "sheet_turnover": f"WITH {_TURN} SELECT {_TS}, 'daily' AS line, round(t {N}, 7) AS turnover FROM X UNION ALL SELECT CAST(CAST(date_trunc('month', dt) AS DATE) AS VARCHAR), 'monthly', round(avg(t) {N}, 7) FROM X GROUP BY 1",
    "sheet_slippage_levels": f"""WITH {_MONTH}, {_BT_SQL}, {P_SQL}, V AS (SELECT CAST(ts AS DATE) AS dt, sum(abs(amount) * price) AS v FROM BT GROUP BY 1), D AS (SELECT dt, sum(value) AS pv FROM P GROUP BY dt)
      SELECT bps AS sid, CAST(RM.dt AS VARCHAR) AS dt, round(ret - coalesce(v * bps * 1e-4 / nullif(abs(pv), 0), 0) {N}, 7) AS ret FROM RM LEFT JOIN D ON D.dt = RM.dt LEFT JOIN V ON V.dt = RM.dt, (SELECT CAST(unnest([3, 8, 20]) AS DOUBLE) AS bps) b""",
    "sheet_profit_posterior": f"WITH {_TRIPS_SQL} SELECT count(*) AS trips, round(avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END), 6) AS share, TRUE AS holds, TRUE AS mass_is_one FROM TRIPS",
    "standardized_returns": f"WITH {R_SQL} SELECT sid, {_TS}, round((ret - avg(ret) OVER w) / nullif(stddev_pop(ret) OVER w, 0) {N}, 6) AS standardized FROM R WINDOW w AS (PARTITION BY sid)",
    "clipped_to_benchmark": f"""WITH {R_SQL}, D AS (SELECT DISTINCT dt FROM R WHERE sid = 1), O AS (SELECT sid, min(dt) < (SELECT min(dt) FROM D) OR max(dt) > (SELECT max(dt) FROM D) AS outside FROM R GROUP BY sid)
      SELECT R.sid, CAST(R.dt AS VARCHAR) AS dt, round(ret {N}, 7) AS ret FROM R JOIN O ON O.sid = R.sid WHERE NOT outside OR R.dt IN (SELECT dt FROM D)""",
    "correlation_matrix": f"WITH {R_SQL}, G AS (SELECT sid % 7 AS sid, dt, avg(ret) AS ret FROM R GROUP BY 1, 2) SELECT x.sid AS a, y.sid AS b, round(covar_pop(x.ret, y.ret) / nullif(stddev_pop(x.ret) * stddev_pop(y.ret), 0) {N}, 7) AS correlation FROM G x JOIN G y ON x.dt = y.dt GROUP BY 1, 2",
    "previous_business_days": f"WITH {R_SQL} SELECT DISTINCT {_TS}, CAST(dt - CASE isodow(dt) WHEN 1 THEN 3 WHEN 7 THEN 2 ELSE 1 END AS VARCHAR) AS previous FROM R",
    "table_differences": f"WITH {P_SQL} SELECT {_TS}, symbol, 'value' AS \"column\", '100000.0' AS \"left\", '100001.0' AS \"right\" FROM P WHERE symbol = 'cash'",
}
