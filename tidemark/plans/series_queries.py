"""Queries over row-level operators on returns, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import series as S
from .metric_queries import SQL_EXPR
from .views import NAV_SQL, R_SQL, RUNS_SQL, T_SQL, returns, trades

Query = Callable[[SparkSession, str], DataFrame]
W = 60


NUDGE = 3.7e-11  # keeps values that lie between two roundings on one side in both engines


def _rounded(df: DataFrame, digits: int = 7, nudge: float = NUDGE) -> DataFrame:
    return df.select(*(F.round(F.col(c) + nudge, digits).alias(c) if t == "double" else F.col(c).cast("string").alias(c) if t in ("date", "timestamp") else F.col(c) for c, t in df.dtypes))


def _prices(spark: SparkSession, sf: str) -> DataFrame:
    return trades(spark, sf).groupBy(F.col("symbol").alias("sid"), F.to_date("ts").alias("dt")).agg(F.round(F.avg("price") + 3.7e-9, 4).alias("price"))


def _on(fn: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: _rounded(fn(returns(spark, sf)))


QUERIES: dict[str, Query] = {
    "simple_returns": lambda spark, sf: _rounded(S.simple_returns(_prices(spark, sf))),
    "cum_returns": _on(lambda r: S.cum_returns(r).select("sid", "dt", "cum")),
    "cum_returns_from_100": _on(lambda r: S.cum_returns(r, 100.0).select("sid", "dt", "cum")),
    "normalize": lambda spark, sf: _rounded(S.normalize(_prices(spark, sf), 100.0, "price").select("sid", "dt", "normalized")),
    "drawdown_series": _on(lambda r: S.cum_returns(r).select("sid", "dt", "dd")),
    "drawdown_runs": _on(S.drawdown_runs),
    "second_max_drawdown": _on(lambda r: S.nth_drawdown(r, 2).select("sid", "depth", "fall_rows", "recovery_rows")),
    "third_max_drawdown": _on(lambda r: S.nth_drawdown(r, 3).select("sid", "depth", "fall_rows", "recovery_rows")),
    "max_drawdown_dates": _on(S.max_drawdown_dates),
    "top_drawdowns": _on(lambda r: S.top_drawdowns(r, 5)),
    "annual_active_return": _on(S.annual_active_return),
    "annual_active_return_by_year": _on(lambda r: S.annual_active_return(r.withColumn("year", F.year("dt")), ["sid", "year"])),
    "beta_fragility_heuristic": _on(S.beta_fragility),
    "r_cubed_turtle": _on(S.r_cubed_turtle),
    "alpha_percentile_rank": _on(lambda r: S.alpha_percentile_rank(r, 1)),
    "hurst_exponent": _on(S.hurst_exponent),
    "stutzer_index": _on(S.stutzer_index),
    "consecutive_stats": _on(S.consecutive_stats),
    "roll_sharpe": _on(lambda r: S.rolling(r, "sharpe", W)),
    "roll_volatility": _on(lambda r: S.rolling(r, "volatility", W)),
    "roll_sortino": _on(lambda r: S.rolling(r, "sortino", W)),
    "roll_mean_return": _on(lambda r: S.rolling(r, "mean_return", W)),
    "roll_beta": _on(lambda r: S.rolling(r, "beta", W)),
    "roll_alpha_beta": _on(lambda r: S.rolling(r, ["alpha", "beta"], W)),
    "roll_captures": _on(lambda r: S.rolling(r, ["up_capture", "down_capture"], W)),
    # a ratio of captures near zero runs into the thousands, so fewer decimals are significant
    "roll_up_down_capture": lambda spark, sf: _rounded(S.rolling(returns(spark, sf), "up_down_capture", W), 3),
    "rolling_regression": _on(lambda r: S.rolling(r, ["mean_alpha", "beta"], W)),
    "rolling_volatility": _on(lambda r: S.rolling(r, "volatility", W, full=False)),
    "roll_max_drawdown": _on(lambda r: S.rolling(r, "max_drawdown", 20)),
    "roll_function": _on(lambda r: S.roll(r, lambda x: float(x.max() - x.min()), 20)),
    "up_down_rows": lambda spark, sf: S.up(returns(spark, sf)).groupBy("sid").agg(F.count(F.lit(1)).alias("up_rows")).join(S.down(returns(spark, sf)).groupBy("sid").agg(F.count(F.lit(1)).alias("down_rows")), "sid"),
}
for _level in ("weekly", "monthly", "quarterly", "yearly"):
    QUERIES[f"aggregate_returns_{_level}"] = _on(lambda r, level=_level: S.aggregate_returns(r, level))
for _name, _metric in (
    ("annual_return_by_year", "annual_return"),
    ("sharpe_ratio_by_year", "sharpe_ratio"),
    ("annual_volatility_by_year", "annual_volatility"),
    ("max_drawdown_by_year", "max_drawdown"),
    ("information_ratio_by_year", "information_ratio"),
    ("annual_alpha", "alpha"),
    ("annual_beta", "beta"),
):
    QUERIES[_name] = _on(lambda r, m=_metric: S.by_year(r, m))
for _side in ("up", "down"):
    for _level in ("day", "week", "month"):
        QUERIES[f"max_consecutive_{_side}_{_level}s"] = _on(lambda r, u=_side == "up", level=_level: S.longest_run(r, u, level).select("sid", "length", "first", "last"))
QUERIES["max_consecutive_gain"] = _on(lambda r: S.longest_run(r, True).select("sid", "best_total"))
QUERIES["max_consecutive_loss"] = _on(lambda r: S.longest_run(r, False).select("sid", "best_total"))

_PRICE_SQL = f"{T_SQL}, PX AS (SELECT symbol AS sid, CAST(ts AS DATE) AS dt, round(avg(price) + 3.7e-9, 4) AS price FROM T GROUP BY 1, 2)"
_WIN = f"WINDOW w AS (PARTITION BY sid ORDER BY dt ROWS BETWEEN {W - 1} PRECEDING AND CURRENT ROW)"


def _roll_sql(digits: int = 7, **cols: str) -> str:
    inner = ", ".join(f"{e} AS {c}" for c, e in cols.items())
    return f"WITH {R_SQL} SELECT sid, CAST(dt AS VARCHAR) AS dt, {', '.join(f'round({c} + 3.7e-11, {digits}) AS {c}' for c in cols)} FROM (SELECT sid, dt, count(*) OVER w AS n, {inner} FROM R {_WIN}) x WHERE n = {W}"


_B = "CASE WHEN var_pop(f) OVER w >= 1e-30 THEN covar_pop(ret, f) OVER w / var_pop(f) OVER w END"


def _cap(c: str, op: str) -> str:
    n = f"count(*) FILTER (WHERE f {op} 0) OVER w"
    end = f"product(1 + {c}) FILTER (WHERE f {op} 0) OVER w"
    return f"(CASE WHEN {n} < 1 THEN NULL WHEN {end} <= 0 THEN -1 ELSE pow({end}, 252.0 / {n}) - 1 END)"


_UC, _DC = (f"{_cap('ret', o)} / nullif({_cap('f', o)}, 0)" for o in (">", "<"))

SQL: dict[str, str] = {
    "simple_returns": f"WITH {_PRICE_SQL} SELECT sid, CAST(dt AS VARCHAR) AS dt, round(price / q - 1 + 3.7e-11, 7) AS ret FROM (SELECT *, lag(price) OVER (PARTITION BY sid ORDER BY dt) AS q FROM PX) x WHERE q IS NOT NULL",
    "normalize": f"WITH {_PRICE_SQL} SELECT sid, CAST(dt AS VARCHAR) AS dt, round(price / first_value(price) OVER (PARTITION BY sid ORDER BY dt) * 100 + 3.7e-11, 7) AS normalized FROM PX",
    "cum_returns": f"WITH {NAV_SQL} SELECT sid, CAST(dt AS VARCHAR) AS dt, round(nav - 1 + 3.7e-11, 7) AS cum FROM N2",
    "cum_returns_from_100": f"WITH {NAV_SQL} SELECT sid, CAST(dt AS VARCHAR) AS dt, round(nav * 100 + 3.7e-11, 7) AS cum FROM N2",
    "drawdown_series": f"WITH {NAV_SQL} SELECT sid, CAST(dt AS VARCHAR) AS dt, round(dd + 3.7e-11, 7) AS dd FROM N2",
    "drawdown_runs": f"""WITH {RUNS_SQL}, L AS (SELECT sid, count(*) AS rows FROM R GROUP BY sid)
      SELECT r.sid, CAST(from_dt AS VARCHAR) AS from_dt, CAST(trough_dt AS VARCHAR) AS trough_dt, CAST(to_dt AS VARCHAR) AS to_dt, round(depth + 3.7e-11, 7) AS depth, trough_rn - from_rn AS fall_rows,
      CASE WHEN to_rn < rows THEN to_rn + 1 - trough_rn END AS recovery_rows FROM RUNS r JOIN L ON L.sid = r.sid""",
    "max_drawdown_dates": f"""WITH {NAV_SQL}, V AS (SELECT sid, dt AS valley, dd1 AS depth FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY dd1, dt) AS k FROM N2) x WHERE k = 1 AND dd1 < 0),
      E AS (SELECT V.sid, valley, depth, max(dt) FILTER (WHERE dd1 = 0 AND dt <= valley) AS peak, min(dt) FILTER (WHERE dd1 = 0 AND dt >= valley) AS recovery FROM N2 JOIN V USING (sid) GROUP BY 1, 2, 3)
      SELECT sid, CAST(peak AS VARCHAR) AS peak, CAST(valley AS VARCHAR) AS valley, CAST(recovery AS VARCHAR) AS recovery, round(depth + 3.7e-11, 7) AS depth, CAST(valley - peak AS INTEGER) AS days,
      round((valley - peak) / 7.0 + 3.7e-11, 7) AS weeks, round((valley - peak) / 30.0 + 3.7e-11, 7) AS months, CAST(recovery - valley AS INTEGER) AS recovery_days, round((recovery - valley) / 7.0 + 3.7e-11, 7) AS recovery_weeks, round((recovery - valley) / 30.0 + 3.7e-11, 7) AS recovery_months FROM E""",
    "annual_active_return": f"WITH {R_SQL} SELECT sid, round(pow(product(1 + ret), 252.0 / count(*)) - pow(product(1 + f), 252.0 / count(*)) + 3.7e-11, 7) AS annual_active_return FROM R GROUP BY sid",
    "annual_active_return_by_year": f"WITH {R_SQL} SELECT sid, year(dt) AS year, round(pow(product(1 + ret), 252.0 / count(*)) - pow(product(1 + f), 252.0 / count(*)) + 3.7e-11, 7) AS annual_active_return FROM R GROUP BY 1, 2",
    "alpha_percentile_rank": f"WITH {R_SQL}, A AS (SELECT sid, {SQL_EXPR['alpha']} AS a FROM R GROUP BY sid HAVING count(*) >= 3) SELECT round(avg(CASE WHEN a < (SELECT a FROM A WHERE sid = 1) THEN 1.0 ELSE 0.0 END) + 3.7e-11, 7) AS alpha_percentile_rank FROM A WHERE sid <> 1",
    "beta_fragility_heuristic": f"""WITH {R_SQL}, K AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY f, dt) AS k, count(*) OVER (PARTITION BY sid) AS n FROM R),
      G AS (SELECT sid, n, max(ret) FILTER (WHERE k = 1) AS r0, max(ret) FILTER (WHERE k = m) AS r1, max(ret) FILTER (WHERE k = n) AS r2, max(f) FILTER (WHERE k = 1) AS f0, max(f) FILTER (WHERE k = m) AS f1, max(f) FILTER (WHERE k = n) AS f2
        FROM (SELECT *, (CASE WHEN n % 2 = 0 THEN n // 2 WHEN (n // 2) % 2 = 0 THEN n // 2 ELSE n // 2 + 1 END) + 1 AS m FROM K) x GROUP BY 1, 2)
      SELECT sid, round((f1 - f0) / (f2 - f0) * r0 + (f2 - f1) / (f2 - f0) * r2 - r1 + 3.7e-11, 7) AS beta_fragility_heuristic FROM G""",
    "r_cubed_turtle": f"""WITH {NAV_SQL}, Y AS (SELECT sid, yr, dt, product(1 + ret) OVER (PARTITION BY sid, yr ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM N2),
      YD AS (SELECT sid, yr, c / greatest(1, max(c) OVER (PARTITION BY sid, yr ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) - 1 AS d FROM Y),
      M AS (SELECT sid, avg(m) AS m FROM (SELECT sid, yr, abs(min(d)) AS m FROM YD GROUP BY 1, 2) z GROUP BY sid), SL AS (SELECT sid, regr_slope(nav, rn) * 252 AS s FROM N2 GROUP BY sid)
      SELECT sid, round(s / m + 3.7e-11, 7) AS r_cubed_turtle FROM SL JOIN M USING (sid)""",
    "max_drawdown_by_year": f"""WITH {NAV_SQL}, Y AS (SELECT sid, yr, dt, product(1 + ret) OVER (PARTITION BY sid, yr ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM N2),
      YD AS (SELECT sid, yr, c / greatest(1, max(c) OVER (PARTITION BY sid, yr ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) - 1 AS d FROM Y)
      SELECT sid, yr AS year, round(min(d) + 3.7e-11, 7) AS max_drawdown FROM YD GROUP BY 1, 2""",
    "roll_sharpe": _roll_sql(sharpe="avg(ret) OVER w / stddev_samp(ret) OVER w * sqrt(252)"),
    "roll_volatility": _roll_sql(volatility="stddev_samp(ret) OVER w * sqrt(252)"),
    "rolling_volatility": f"WITH {R_SQL} SELECT sid, CAST(dt AS VARCHAR) AS dt, round(CASE WHEN count(*) OVER w = {W} THEN stddev_samp(ret) OVER w * sqrt(252) END + 3.7e-11, 7) AS volatility FROM R {_WIN}",
    "roll_sortino": _roll_sql(sortino="avg(ret) OVER w * sqrt(252) / stddev_samp(least(ret, 0)) OVER w"),
    "roll_mean_return": _roll_sql(mean_return="avg(ret) OVER w * 252"),
    "roll_beta": _roll_sql(beta=_B),
    "roll_alpha_beta": _roll_sql(alpha=f"pow(1 + avg(ret) OVER w - ({_B}) * avg(f) OVER w, 252) - 1", beta=_B),
    "rolling_regression": _roll_sql(mean_alpha=f"avg(ret) OVER w - ({_B}) * avg(f) OVER w", beta=_B),
    "roll_captures": _roll_sql(up_capture=_UC, down_capture=_DC),
    "roll_up_down_capture": _roll_sql(3, up_down_capture=f"({_UC}) / nullif({_DC}, 0)"),
    "roll_max_drawdown": f"""WITH {R_SQL}, K AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY dt) AS k FROM R),
      J AS (SELECT a.sid, a.k, a.dt, b.k AS j, product(1 + b.ret) OVER (PARTITION BY a.sid, a.k ORDER BY b.k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM K a JOIN K b ON b.sid = a.sid AND b.k BETWEEN a.k - 19 AND a.k WHERE a.k >= 20),
      D AS (SELECT sid, k, dt, c / greatest(1, max(c) OVER (PARTITION BY sid, k ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) - 1 AS d FROM J)
      SELECT sid, CAST(dt AS VARCHAR) AS dt, round(min(d) + 3.7e-11, 7) AS max_drawdown FROM D GROUP BY sid, k, dt""",
    "roll_function": f"WITH {R_SQL} SELECT sid, CAST(dt AS VARCHAR) AS dt, round(v + 3.7e-11, 7) AS value FROM (SELECT sid, dt, max(ret) OVER w - min(ret) OVER w AS v, count(*) OVER w AS n FROM R WINDOW w AS (PARTITION BY sid ORDER BY dt ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) x WHERE n = 20",
    "up_down_rows": f"WITH {R_SQL} SELECT sid, count(*) FILTER (WHERE f > 0) AS up_rows, count(*) FILTER (WHERE f < 0) AS down_rows FROM R GROUP BY sid",
}
for _n, _k in (("second", 2), ("third", 3)):
    SQL[f"{_n}_max_drawdown"] = f"""WITH {RUNS_SQL}, L AS (SELECT sid, count(*) AS rows FROM R GROUP BY sid), Q AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY depth, from_dt) AS k FROM RUNS)
      SELECT Q.sid, round(depth + 3.7e-11, 7) AS depth, trough_rn - from_rn AS fall_rows, CASE WHEN to_rn < rows THEN to_rn + 1 - trough_rn END AS recovery_rows FROM Q JOIN L ON L.sid = Q.sid WHERE k = {_k}"""
SQL["top_drawdowns"] = f"""WITH {RUNS_SQL}, Q AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY depth, from_dt) AS k FROM RUNS)
      SELECT Q.sid, k AS rank, round(-depth * 100 + 3.7e-11, 7) AS depth_pct, CAST(p.dt AS VARCHAR) AS peak, CAST(t.dt AS VARCHAR) AS valley, CAST(r.dt AS VARCHAR) AS recovery,
      CASE WHEN r.dt IS NOT NULL THEN CAST((SELECT count(*) FROM generate_series(0, 4000) g(i) WHERE i <= r.dt - p.dt AND isodow(p.dt + CAST(i AS INTEGER)) <= 5) AS INTEGER) END AS duration
      FROM Q LEFT JOIN N2 p ON p.sid = Q.sid AND p.rn = from_rn - 1 JOIN N2 t ON t.sid = Q.sid AND t.rn = trough_rn LEFT JOIN N2 r ON r.sid = Q.sid AND r.rn = to_rn + 1 WHERE k <= 5"""
for _level, _part in (("weekly", "week(dt)"), ("monthly", "month(dt)"), ("quarterly", "quarter(dt)"), ("yearly", "")):
    SQL[f"aggregate_returns_{_level}"] = f"WITH {R_SQL} SELECT sid, year(dt) AS year{f', {_part} AS part' if _part else ''}, round(product(1 + ret) - 1 + 3.7e-11, 7) AS ret FROM R GROUP BY 1, 2{', 3' if _part else ''}"
for _name, _metric in (("annual_return_by_year", "annual_return"), ("sharpe_ratio_by_year", "sharpe_ratio"), ("annual_volatility_by_year", "annual_volatility"), ("information_ratio_by_year", "information_ratio"), ("annual_alpha", "alpha"), ("annual_beta", "beta")):
    SQL[_name] = f"WITH {R_SQL} SELECT sid, year(dt) AS year, round(CASE WHEN count(*) >= 2 THEN {SQL_EXPR[_metric]} END + 3.7e-11, 7) AS {_metric} FROM R GROUP BY 1, 2"
_DATA = {
    "day": "D AS (SELECT sid, dt, ret FROM R)",
    "week": "H AS (SELECT sid, CAST(date_trunc('week', dt) AS DATE) + 6 AS dt, product(1 + ret) - 1 AS ret FROM R GROUP BY 1, 2), S AS (SELECT sid, unnest(generate_series(CAST(min(dt) AS TIMESTAMP), CAST(max(dt) AS TIMESTAMP), INTERVAL 7 DAY)) AS d FROM H GROUP BY sid), D AS (SELECT S.sid, CAST(S.d AS DATE) AS dt, H.ret FROM S LEFT JOIN H ON H.sid = S.sid AND H.dt = CAST(S.d AS DATE))",
    "month": "H AS (SELECT sid, last_day(dt) AS dt, product(1 + ret) - 1 AS ret FROM R GROUP BY 1, 2), S AS (SELECT sid, unnest(generate_series(CAST(date_trunc('month', min(dt)) AS TIMESTAMP), CAST(max(dt) AS TIMESTAMP), INTERVAL 1 MONTH)) AS d FROM H GROUP BY sid), D AS (SELECT S.sid, last_day(CAST(S.d AS DATE)) AS dt, H.ret FROM S LEFT JOIN H ON H.sid = S.sid AND H.dt = last_day(CAST(S.d AS DATE)))",
}


def _run_sql(up: bool, level: str, cols: str) -> str:
    op = ">" if up else "<"
    return f"""WITH {R_SQL}, {_DATA[level]}, K AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY dt) AS n FROM D),
      G AS (SELECT *, n - row_number() OVER (PARTITION BY sid ORDER BY dt) AS g FROM K WHERE ret {op} 0),
      U AS (SELECT sid, g, count(*) AS length, sum(ret) AS total, min(dt) AS first, max(dt) AS last FROM G GROUP BY 1, 2),
      X AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY length DESC, first) AS k, {'max' if up else 'min'}(total) OVER (PARTITION BY sid) AS best FROM U),
      A AS (SELECT DISTINCT sid FROM D)
      SELECT A.sid, {cols} FROM A LEFT JOIN X ON X.sid = A.sid AND k = 1"""


for _side in ("up", "down"):
    for _level in ("day", "week", "month"):
        SQL[f"max_consecutive_{_side}_{_level}s"] = _run_sql(_side == "up", _level, "coalesce(length, 0) AS length, CAST(first AS VARCHAR) AS first, CAST(last AS VARCHAR) AS last")
SQL["max_consecutive_gain"] = _run_sql(True, "day", "round(best + 3.7e-11, 7) AS best_total")
SQL["max_consecutive_loss"] = _run_sql(False, "day", "round(best + 3.7e-11, 7) AS best_total")
_ALL_RUNS = [(f"max_consecutive_{side}_{level}s", _run_sql(side == "up", level, f"CAST(coalesce(length, 0) AS BIGINT) AS max_consecutive_{side}_{level}s")) for level in ("day", "week", "month") for side in ("up", "down")]
SQL["consecutive_stats"] = f"SELECT sid, {', '.join(n for n, _ in _ALL_RUNS)} FROM ({_ALL_RUNS[0][1]}) {_ALL_RUNS[0][0]}_ " + " ".join(f"JOIN ({q}) {n}_ USING (sid)" for n, q in _ALL_RUNS[1:])
# R/S by length: the definition over explicit blocks
SQL["hurst_exponent"] = f"""WITH {R_SQL}, V AS (SELECT sid, ret, row_number() OVER (PARTITION BY sid ORDER BY dt) - 1 AS k, count(*) OVER (PARTITION BY sid) AS n FROM R WHERE ret IS NOT NULL),
      T AS (SELECT DISTINCT sid, n, greatest(n // 3, 3) AS top FROM V WHERE n >= 8),
      G AS (SELECT DISTINCT sid, n, CASE WHEN top <= 31 THEN least(i + 2, top) WHEN i = 29 THEN top ELSE CAST(floor(2 * pow(top / 2.0, i / 29.0) + 1e-9) AS BIGINT) END AS len FROM T, (SELECT unnest(generate_series(0, 29)) AS i) s UNION SELECT sid, n, n FROM T),
      P AS (SELECT V.sid, V.n, len, k // len AS b, k, ret - avg(ret) OVER (PARTITION BY V.sid, len, k // len) AS off, ret FROM V JOIN G ON G.sid = V.sid WHERE (k // len + 1) * len <= V.n),
      W AS (SELECT *, sum(off) OVER (PARTITION BY sid, len, b ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS walk FROM P),
      B AS (SELECT sid, n, len, b, max(walk) - min(walk) AS r, CASE WHEN max(ret) > min(ret) THEN stddev_samp(ret) ELSE 0 END AS s FROM W GROUP BY 1, 2, 3, 4),
      RS AS (SELECT sid, n, len, avg(r / s) AS rs FROM B WHERE r > 0 AND s > 0 GROUP BY 1, 2, 3),
      F AS (SELECT sid, n, count(*) FILTER (WHERE len < n) AS c, regr_slope(ln(rs), ln(len)) FILTER (WHERE len < n) AS h, max(rs) FILTER (WHERE len = n) AS whole FROM RS GROUP BY 1, 2)
      SELECT A.sid, round(least(greatest(CASE WHEN c >= 2 THEN h ELSE 0.5 + ln(whole) / ln(2.0 * n) END, 0), 1) + 3.7e-11, 7) AS hurst_exponent FROM (SELECT DISTINCT sid FROM R) A LEFT JOIN F ON F.sid = A.sid AND whole IS NOT NULL"""
