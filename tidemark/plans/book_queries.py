"""Queries over positions, transactions, round trips and attribution, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import attribution as A
from ..operators import book as B
from ..operators import round_trips as T
from ..sources.tables import table
from .series_queries import _rounded
from .views import M_SQL, P_SQL, R_SQL, T_SQL, market, positions, returns, trades

MONEY = 3.7e-7  # profits of some 10^5 are summed to about 10^-9
Query = Callable[[SparkSession, str], DataFrame]
BUCKETS = [("small", 0.0, 1000.0), ("mid", 1000.0, 1500.0), ("large", 1500.0, 1e12)]


def _sectors(spark: SparkSession, sf: str) -> DataFrame:
    """Brand to sector: the brand's last character."""
    return table(spark, sf, "part").select(F.col("p_brand").alias("symbol"), F.substring("p_brand", -1, 1).alias("sector")).distinct()


def _caps(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").groupBy(F.col("p_brand").alias("symbol")).agg(F.max("p_retailprice").alias("cap"))


def _loadings(spark: SparkSession, sf: str) -> DataFrame:
    """dt, symbol, factor, loading from the market: price and volume, scaled."""
    m = market(spark, sf)
    return m.select("dt", "symbol", F.lit("price").alias("factor"), (F.col("price") / 1000).alias("loading")).unionByName(m.select("dt", "symbol", F.lit("volume").alias("factor"), (F.col("volume") / 1000).alias("loading")))


_L_SQL = f"{M_SQL}, L AS (SELECT dt, symbol, 'price' AS factor, price / 1000 AS loading FROM M UNION ALL SELECT dt, symbol, 'volume', volume / 1000 FROM M)"


def _monthly(spark: SparkSession, sf: str) -> DataFrame:
    """sid, dt, ret: one portfolio's monthly mean return."""
    return returns(spark, sf).groupBy(F.trunc("dt", "month").alias("dt")).agg(F.round(F.avg("ret") + 3.7e-10, 6).alias("ret")).select(F.lit(0).alias("sid"), "dt", "ret")


def _factor_returns(spark: SparkSession, sf: str) -> DataFrame:
    m = returns(spark, sf).groupBy(F.trunc("dt", "month").alias("dt")).agg(F.round(F.avg("f") + 3.7e-10, 6).alias("a"), F.round(F.max("f") + 3.7e-10, 6).alias("b"))
    return m.select("dt", F.lit("price").alias("factor"), F.col("a").alias("ret")).unionByName(m.select("dt", F.lit("volume").alias("factor"), F.col("b").alias("ret")))


_MONTH_SQL = f"""{R_SQL}, RM AS (SELECT CAST(date_trunc('month', dt) AS DATE) AS dt, round(avg(ret) + 3.7e-10, 6) AS ret, round(avg(f) + 3.7e-10, 6) AS a, round(max(f) + 3.7e-10, 6) AS b FROM R GROUP BY 1),
  FR AS (SELECT dt, 'price' AS factor, a AS fr FROM RM UNION ALL SELECT dt, 'volume', b FROM RM)"""
_WEIGHT_SQL = "PW AS (SELECT dt, symbol, value / nullif(sum(abs(value)) OVER (PARTITION BY dt), 0) AS value FROM P WHERE symbol <> 'cash')"


def _attrib(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return A.perf_attrib(_monthly(spark, sf), B.normalized_positions(positions(spark, sf)), _factor_returns(spark, sf), _loadings(spark, sf))


def _brinson(spark: SparkSession, sf: str) -> DataFrame:
    """Quarterly groups by return flag: weights from quantity, returns from discount and tax."""
    li = table(spark, sf, "lineitem").groupBy(F.trunc("l_shipdate", "quarter").alias("dt"), F.col("l_returnflag").alias("g"))
    s = li.agg(F.sum("l_quantity").alias("q"), F.count(F.lit(1)).alias("c"), F.avg("l_discount").alias("rp"), F.avg("l_tax").alias("rb"))
    from pyspark.sql import Window

    w = Window.partitionBy("dt")
    return s.select("dt", "g", "rp", "rb", (F.col("q") / F.sum("q").over(w)).alias("wp"), (F.col("c") / F.sum("c").over(w)).alias("wb"))


_BRINSON_SQL = """S AS (SELECT CAST(date_trunc('quarter', l_shipdate) AS DATE) AS dt, l_returnflag AS g, sum(l_quantity) AS q, count(*) AS c, avg(l_discount) AS rp, avg(l_tax) AS rb FROM lineitem GROUP BY 1, 2),
  BW AS (SELECT dt, g, rp, rb, q / sum(q) OVER (PARTITION BY dt) AS wp, c / sum(c) OVER (PARTITION BY dt) AS wb FROM S),
  BR AS (SELECT dt, sum((wp - wb) * rb) AS allocation, sum(wb * (rp - rb)) AS selection, sum((wp - wb) * (rp - rb)) AS interaction, sum(wp * rp) AS p, sum(wb * rb) AS b FROM BW GROUP BY dt)"""


def _two_factor(spark: SparkSession, sf: str) -> DataFrame:
    return returns(spark, sf).withColumn("MKT", F.col("f")).withColumn("SMB", F.col("f") * F.col("f"))


def _trips(spark: SparkSession, sf: str) -> DataFrame:
    return T.round_trips(trades(spark, sf), order="seq")


QUERIES: dict[str, Query] = {
    "percent_alloc": lambda s, d: _rounded(B.percent_alloc(positions(s, d)).select("dt", "symbol", "alloc")),
    "gross_leverage": lambda s, d: _rounded(B.exposures(positions(s, d))),
    "top_positions": lambda s, d: _rounded(B.top_positions(positions(s, d), 5)),
    "position_concentration": lambda s, d: _rounded(B.concentration(positions(s, d))),
    "normalized_positions": lambda s, d: _rounded(B.normalized_positions(positions(s, d))),
    "stack_positions": lambda s, d: _rounded(B.stack_positions(B.wide_positions(positions(s, d)))),
    "extract_positions": lambda s, d: _rounded(B.extract_positions(trades(s, d).select(F.trunc("ts", "month").alias("dt"), F.col("symbol").alias("sid"), "amount", F.col("price").alias("last_sale_price")), positions(s, d).where("symbol = 'cash'").select("dt", F.col("value").alias("cash"))), 4),
    "sector_exposures": lambda s, d: _rounded(B.group_exposures(positions(s, d), _sectors(s, d)), 2),
    "cap_exposures": lambda s, d: _rounded(B.cap_exposures(positions(s, d), _caps(s, d), BUCKETS), 2),
    "style_exposure": lambda s, d: _rounded(B.style_exposure(positions(s, d), _loadings(s, d).where("factor = 'price'").select("dt", "symbol", "loading")), 3),
    "volume_exposure": lambda s, d: B.volume_exposure(positions(s, d).where("symbol <> 'cash'").select("dt", "symbol", (F.col("value") / 1000).alias("shares")), market(s, d).select("dt", "symbol", "volume"), 0.2).select(F.col("dt").cast("string").alias("dt"), "names"),
    "txn_volume": lambda s, d: _rounded(B.txn_volume(trades(s, d)), 2),
    "turnover_agb": lambda s, d: _rounded(B.turnover(positions(s, d), trades(s, d).withColumn("ts", F.trunc("ts", "month")))),
    "turnover_portfolio_value": lambda s, d: _rounded(B.turnover(positions(s, d), trades(s, d).withColumn("ts", F.trunc("ts", "month")), "portfolio_value"), 6),
    "slippage_adjusted_returns": lambda s, d: _rounded(B.slippage_adjusted_returns(_monthly(s, d).select("dt", "ret"), positions(s, d), trades(s, d).withColumn("ts", F.trunc("ts", "month")), 10)),
    "daily_txns_with_bar_data": lambda s, d: _rounded(B.daily_bars(_brand_trades(s, d), market(s, d)), 4),
    "days_to_liquidate": lambda s, d: _rounded(B.days_to_liquidate(positions(s, d), market(s, d))),
    "max_days_to_liquidate": lambda s, d: _rounded(B.max_days_to_liquidate(positions(s, d), market(s, d))),
    "low_liquidity_transactions": lambda s, d: _rounded(B.low_liquidity_transactions(_brand_trades(s, d), market(s, d)).select("symbol", "max_pct_bar_consumed"), 5),
    "slippage_penalty": lambda s, d: _rounded(B.slippage_penalty(_monthly(s, d), B.daily_bars(_brand_trades(s, d), market(s, d)), 1e8, 1e6), 4),
    "detect_intraday": lambda s, d: _rounded(B.detect_intraday(positions(s, d), trades(s, d))),
    "txn_time_hist": lambda s, d: _rounded(B.transaction_hours(_event_trades(s, d), 60)),
    "estimate_intraday": lambda s, d: _rounded(B.estimate_intraday(_event_positions(s, d), _event_trades(s, d)), 4),
    "fill_blocks": lambda s, d: _rounded(T.fill_blocks(trades(s, d), order="seq").drop("block"), 5),
    "round_trips": lambda s, d: _rounded(_trips(s, d), 4, MONEY),
    "round_trip_stats": lambda s, d: _rounded(T.round_trip_stats(_trips(s, d)), 4, MONEY),
    "round_trip_stats_by_symbol": lambda s, d: _rounded(T.round_trip_stats_by_symbol(_trips(s, d)), 4, MONEY),
    "profit_attribution": lambda s, d: _rounded(T.profit_attribution(_trips(s, d)), 6),
    "closing_transactions": lambda s, d: _rounded(T.closing_transactions(positions(s, d), _brand_trades(s, d)), 4),
    "factor_exposures": lambda s, d: _rounded(A.compute_exposures(B.normalized_positions(positions(s, d)), _loadings(s, d))),
    "perf_attrib_by_factor": lambda s, d: _rounded(_attrib(s, d)[0]),
    "perf_attrib_daily": lambda s, d: _rounded(_attrib(s, d)[1]),
    "perf_attrib_summary": lambda s, d: _rounded(A.perf_attrib_stats(*_attrib(s, d))[0], 6),
    "perf_attrib_factor_stats": lambda s, d: _rounded(A.perf_attrib_stats(*_attrib(s, d))[1], 6),
    "returns_less_costs": lambda s, d: _rounded(A.returns_less_costs(returns(s, d), returns(s, d).groupBy("dt").agg(F.lit(0.0001).alias("cost")))),
    "brinson": lambda s, d: _rounded(A.brinson(_brinson(s, d))),
    "brinson_cumulative": lambda s, d: _rounded(A.brinson_cumulative(_brinson(s, d))),
    "factor_regression": lambda s, d: _rounded(A.factor_regression(_two_factor(s, d), ["MKT", "SMB"]).select("sid", "n", "alpha", F.col("betas")["MKT"].alias("mkt"), F.col("betas")["SMB"].alias("smb"), "r_squared"), 5),
    "factor_regression_rolling": lambda s, d: _rounded(A.FamaFrenchModel(factors=["MKT"]).rolling_exposures(_two_factor(s, d), 60), 6),
    "factor_decomposition": lambda s, d: _rounded(A.FamaFrenchModel(factors=["MKT", "SMB"]).decomposition(_two_factor(s, d)).select("sid", "factor_return", "unexplained"), 6),
    "idiosyncratic_risk": lambda s, d: _rounded(A.idiosyncratic_risk(_two_factor(s, d))),
    "style_exposures": lambda s, d: _rounded(A.style_exposures(returns(s, d))),
    "style_summary": lambda s, d: _rounded(A.style_summary(returns(s, d), A.style_exposures(returns(s, d)))),
    "style_tilts": lambda s, d: _rounded(A.style_tilts(returns(s, d), 60)),
    "regression_attribution": lambda s, d: _rounded(A.regression_attribution(_daily_portfolio(s, d), A.style_returns(returns(s, d), A.style_exposures(returns(s, d))))),
}


def _brand_trades(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly fills by brand."""
    t = trades(spark, sf).join(table(spark, sf, "part"), F.col("part") == F.col("p_partkey"))
    return t.select(F.trunc("ts", "month").cast("timestamp").alias("ts"), F.col("p_brand").alias("symbol"), "amount", "price")


_BT_SQL = "BT AS (SELECT date_trunc('month', l_shipdate) AS ts, p_brand AS symbol, l_quantity * CASE WHEN l_returnflag = 'R' THEN -1.0 ELSE 1.0 END AS amount, l_extendedprice / l_quantity AS price FROM lineitem JOIN part ON l_partkey = p_partkey)"
_BARS_SQL = f"{_BT_SQL}, {M_SQL}, BARS AS (SELECT d.dt, d.symbol, d.amount, M.price, M.volume FROM (SELECT CAST(ts AS DATE) AS dt, symbol, sum(abs(amount)) AS amount FROM BT GROUP BY 1, 2) d LEFT JOIN M ON M.dt = d.dt AND M.symbol = d.symbol)"


def _event_trades(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("symbol"), (F.when(F.col("user_id") % 2 == 0, 1.0).otherwise(-1.0)).alias("amount"), F.col("value").alias("price"))


def _event_positions(spark: SparkSession, sf: str) -> DataFrame:
    e = _event_trades(spark, sf)
    return e.groupBy(F.to_date("ts").alias("dt"), "symbol").agg(F.round(F.sum(F.col("amount") * F.col("price")), 4).alias("value"))


def _daily_portfolio(spark: SparkSession, sf: str) -> DataFrame:
    return returns(spark, sf).groupBy("dt").agg(F.avg("ret").alias("ret"))


_DTL = f"""{P_SQL}, {M_SQL}, PA AS (SELECT dt, symbol, value / nullif(sum(value) OVER (PARTITION BY dt), 0) AS alloc FROM P),
  MB AS (SELECT *, CASE WHEN count(*) OVER w = 5 THEN avg(price * volume) OVER w END AS adv, row_number() OVER (PARTITION BY symbol ORDER BY dt) AS k FROM M WINDOW w AS (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
  DL AS (SELECT PA.dt, PA.symbol, alloc * 1000000.0 / nullif(adv * 0.2, 0) AS days, alloc FROM PA JOIN MB ON MB.dt = PA.dt AND MB.symbol = PA.symbol WHERE PA.symbol <> 'cash' AND k > 5)"""
_TS = "CAST(dt AS VARCHAR) AS dt"
_ATT = f"""{P_SQL}, {_L_SQL}, {_MONTH_SQL}, {_WEIGHT_SQL}, EX AS (SELECT PW.dt, factor, sum(value * loading) AS exposure FROM PW JOIN L ON L.dt = PW.dt AND L.symbol = PW.symbol WHERE PW.dt IN (SELECT dt FROM RM) GROUP BY 1, 2),
  ME AS (SELECT factor, avg(exposure) AS me FROM EX GROUP BY 1), BF AS (SELECT EX.dt, EX.factor, exposure, exposure * fr AS contribution, me * fr AS tilt FROM EX JOIN FR ON FR.dt = EX.dt AND FR.factor = EX.factor JOIN ME ON ME.factor = EX.factor),
  BD AS (SELECT RM.dt, ret AS total, c AS common, ret - c AS specific, t AS tilt, c - t AS timing FROM RM JOIN (SELECT dt, sum(contribution) AS c, sum(tilt) AS t FROM BF GROUP BY dt) x ON x.dt = RM.dt)"""

N = "+ 3.7e-11"
_STYLE_SQL = f"""{R_SQL}, Q AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY dt DESC) AS k FROM R), S AS (SELECT sid, stddev_samp(ret) AS vol, product(1 + ret) FILTER (WHERE k <= 252) - 1 AS mom FROM Q GROUP BY sid), D AS (SELECT median(vol) AS mv, median(mom) AS mm FROM S),
      U AS (SELECT sid, CASE WHEN mom >= mm THEN 'momentum' ELSE 'reversal' END AS style FROM S, D UNION ALL SELECT sid, CASE WHEN vol >= mv THEN 'high_vol' ELSE 'low_vol' END FROM S, D),
      SW AS (SELECT sid, style, 1.0 / count(*) OVER (PARTITION BY style) AS weight FROM U), SR AS (SELECT dt, style, sum(ret * weight) AS ret FROM R JOIN SW ON SW.sid = R.sid GROUP BY dt, style)"""
# First in, first out: overlaps of the opened and the closed quantities on one line per symbol.
_TRIPS_SQL = f"""{T_SQL}, A AS (SELECT *, lag(amount > 0) OVER w AS was, lag(ts) OVER w AS prev FROM T WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq)),
      CB AS (SELECT *, sum(CASE WHEN was IS NULL OR was <> (amount > 0) OR ts - prev > INTERVAL 8 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS block FROM A),
      BL AS (SELECT symbol, block, min(ts) AS dt, sum(amount) AS amount, sum(amount * price) / nullif(sum(amount), 0) AS price FROM CB GROUP BY 1, 2),
      PO AS (SELECT *, coalesce(sum(amount) OVER (PARTITION BY symbol ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held FROM BL WHERE price >= 0 AND amount <> 0),
      SP AS (SELECT *, CASE WHEN sign(held) * sign(amount) < 0 THEN least(abs(amount), abs(held)) ELSE 0 END AS c FROM PO),
      LN AS (SELECT *, sum(c) OVER w AS c1, sum(abs(amount) - c) OVER w AS o1 FROM SP WINDOW w AS (PARTITION BY symbol ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
      OP AS (SELECT symbol, dt, price, sign(amount) AS side, o1 - (abs(amount) - c) AS o0, o1 FROM LN WHERE abs(amount) > c), CL AS (SELECT symbol, block, dt, price, c1 - c AS c0, c1 FROM LN WHERE c > 0),
      MT AS (SELECT CL.symbol, CL.block, CL.dt AS close_dt, OP.dt AS open_dt, side, CL.price - OP.price AS gain, OP.price AS cost, least(o1, c1) - greatest(o0, c0) AS used FROM CL JOIN OP ON OP.symbol = CL.symbol AND o0 < c1 AND c0 < o1),
      TRIPS AS (SELECT symbol, min(open_dt) AS open_dt, min(close_dt) AS close_dt, min(side) > 0 AS long, sum(side * gain * used) AS pnl, coalesce(sum(side * gain * used) / nullif(sum(cost * used), 0), 0) AS rt_returns, CAST(epoch(min(close_dt)) - epoch(min(open_dt)) AS BIGINT) AS duration_s FROM MT GROUP BY symbol, block)"""
_R4 = lambda e, n: f"round({e} + 3.7e-7, 4) AS {n}"
_WON, _LOST = "FILTER (WHERE pnl > 0)", "FILTER (WHERE pnl < 0)"
_TRIP_STATS = ", ".join([
    "count(*) AS round_trips", _R4("sum(pnl)", "total_profit"), _R4(f"coalesce(sum(pnl) {_WON}, 0)", "gross_profit"), _R4(f"coalesce(sum(pnl) {_LOST}, 0)", "gross_loss"), _R4(f"sum(pnl) {_WON} / nullif(-sum(pnl) {_LOST}, 0)", "profit_factor"),
    _R4("avg(pnl)", "avg_trade"), _R4(f"avg(pnl) {_WON}", "avg_winning"), _R4(f"avg(pnl) {_LOST}", "avg_losing"), _R4(f"avg(pnl) {_WON} / nullif(-avg(pnl) {_LOST}, 0)", "win_loss_ratio"), _R4("max(pnl)", "largest_win"), _R4("min(pnl)", "largest_loss"),
    _R4(f"(count(*) {_WON}) / count(*)", "percent_profitable"), f"count(*) {_WON} AS winning", f"count(*) {_LOST} AS losing", "count(*) FILTER (WHERE pnl = 0) AS even", _R4("avg(duration_s)", "avg_duration_s"), _R4("median(duration_s)", "median_duration_s"), "max(duration_s) AS longest_s", "min(duration_s) AS shortest_s",
    _R4("avg(rt_returns)", "avg_return"), _R4("median(rt_returns)", "median_return"), _R4("max(rt_returns)", "best_return"), _R4("min(rt_returns)", "worst_return"), _R4("stddev_samp(rt_returns)", "std_return"),
])
SQL: dict[str, str] = {
    "percent_alloc": f"WITH {P_SQL} SELECT {_TS}, symbol, round(value / nullif(sum(value) OVER (PARTITION BY dt), 0) {N}, 7) AS alloc FROM P",
    "gross_leverage": f"""WITH {P_SQL}, E AS (SELECT dt, coalesce(sum(value) FILTER (WHERE symbol <> 'cash' AND value > 0), 0) AS l, coalesce(sum(-value) FILTER (WHERE symbol <> 'cash' AND value < 0), 0) AS s, sum(value) AS t FROM P GROUP BY dt)
      SELECT {_TS}, round(l {N}, 7) AS long, round(s {N}, 7) AS short, round(l + s {N}, 7) AS gross, round(l - s {N}, 7) AS net, round((l + s) / nullif(t, 0) {N}, 7) AS gross_leverage FROM E""",
    "top_positions": f"""WITH {P_SQL}, PA AS (SELECT dt, symbol, value / nullif(sum(value) OVER (PARTITION BY dt), 0) AS a FROM P), S AS (SELECT symbol, max(a) AS l, min(a) AS s, max(abs(a)) AS b FROM PA WHERE symbol <> 'cash' GROUP BY 1)
      SELECT * FROM (SELECT 'long' AS kind, symbol, round(l {N}, 7) AS alloc FROM S WHERE l > 0 ORDER BY l DESC, symbol LIMIT 5) UNION ALL SELECT * FROM (SELECT 'short', symbol, round(s {N}, 7) FROM S WHERE s < 0 ORDER BY s, symbol LIMIT 5) UNION ALL SELECT * FROM (SELECT 'abs', symbol, round(b {N}, 7) FROM S ORDER BY b DESC, symbol LIMIT 5)""",
    "position_concentration": f"""WITH {P_SQL}, PA AS (SELECT dt, symbol, value / nullif(sum(value) OVER (PARTITION BY dt), 0) AS a FROM P)
      SELECT {_TS}, round(max(a) FILTER (WHERE a > 0) {N}, 7) AS max_long, round(median(a) FILTER (WHERE a > 0) {N}, 7) AS median_long, round(median(a) FILTER (WHERE a < 0) {N}, 7) AS median_short, round(min(a) FILTER (WHERE a < 0) {N}, 7) AS max_short FROM PA WHERE symbol <> 'cash' GROUP BY dt""",
    "normalized_positions": f"WITH {P_SQL}, {_WEIGHT_SQL} SELECT {_TS}, symbol, round(value {N}, 7) AS value FROM PW WHERE value IS NOT NULL",
    "stack_positions": f"WITH {P_SQL} SELECT {_TS}, symbol, round(value {N}, 7) AS value FROM P WHERE symbol <> 'cash'",
    "extract_positions": f"""WITH {T_SQL}, {P_SQL}, H AS (SELECT CAST(date_trunc('month', ts) AS DATE) AS dt, CAST(symbol AS VARCHAR) AS symbol, avg(amount * price) AS value FROM T GROUP BY 1, 2)
      SELECT CAST(d.dt AS VARCHAR) AS dt, s.symbol, round(coalesce(H.value, 0) {N}, 4) AS value FROM (SELECT DISTINCT dt FROM H) d CROSS JOIN (SELECT DISTINCT symbol FROM H) s LEFT JOIN H ON H.dt = d.dt AND H.symbol = s.symbol
      UNION ALL SELECT CAST(d.dt AS VARCHAR), 'cash', coalesce(P.value, 0) FROM (SELECT DISTINCT dt FROM H) d LEFT JOIN P ON P.dt = d.dt AND P.symbol = 'cash'""",
    "sector_exposures": f"""WITH {P_SQL}, S AS (SELECT DISTINCT p_brand AS symbol, right(p_brand, 1) AS sector FROM part) SELECT {_TS}, sector, round(sum(value) {N}, 2) AS value FROM P JOIN S USING (symbol) GROUP BY P.dt, sector
      UNION ALL SELECT {_TS}, 'cash', sum(value) FROM P WHERE symbol = 'cash' GROUP BY dt""",
    "cap_exposures": f"""WITH {P_SQL}, S AS (SELECT p_brand AS symbol, CASE WHEN max(p_retailprice) < 1000 THEN 'small' WHEN max(p_retailprice) < 1500 THEN 'mid' ELSE 'large' END AS cap_bucket FROM part GROUP BY 1) SELECT {_TS}, cap_bucket, round(sum(value) {N}, 2) AS value FROM P JOIN S USING (symbol) GROUP BY P.dt, cap_bucket
      UNION ALL SELECT {_TS}, 'cash', sum(value) FROM P WHERE symbol = 'cash' GROUP BY dt""",
    "style_exposure": f"WITH {P_SQL}, {_L_SQL} SELECT CAST(P.dt AS VARCHAR) AS dt, round(sum(value * loading) {N}, 3) AS exposure FROM P JOIN L ON L.dt = P.dt AND L.symbol = P.symbol AND factor = 'price' GROUP BY P.dt",
    "volume_exposure": f"WITH {P_SQL}, {M_SQL} SELECT CAST(P.dt AS VARCHAR) AS dt, sum(CASE WHEN abs(value / 1000) / volume > 0.2 THEN 1 ELSE 0 END) AS names FROM P LEFT JOIN M ON M.dt = P.dt AND M.symbol = P.symbol WHERE P.symbol <> 'cash' GROUP BY P.dt",
    "txn_volume": f"WITH {T_SQL} SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS dt, round(sum(abs(amount) * price) {N}, 2) AS txn_volume, round(sum(abs(amount)) {N}, 2) AS txn_shares FROM T GROUP BY 1",
    "turnover_agb": f"""WITH {T_SQL}, {P_SQL}, G AS (SELECT dt, sum(abs(value)) AS g FROM P WHERE symbol <> 'cash' GROUP BY dt), D AS (SELECT dt, CASE WHEN row_number() OVER (ORDER BY dt) = 1 THEN g / 2 ELSE avg(g) OVER (ORDER BY dt ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) END AS b FROM G),
      V AS (SELECT CAST(date_trunc('month', ts) AS DATE) AS dt, sum(abs(amount) * price) AS v FROM T GROUP BY 1) SELECT CAST(coalesce(D.dt, V.dt) AS VARCHAR) AS dt, round(coalesce(v / nullif(b, 0), 0) {N}, 7) AS turnover FROM D FULL OUTER JOIN V ON V.dt = D.dt""",
    "turnover_portfolio_value": f"""WITH {T_SQL}, {P_SQL}, D AS (SELECT dt, sum(value) AS b FROM P GROUP BY dt),
      V AS (SELECT CAST(date_trunc('month', ts) AS DATE) AS dt, sum(abs(amount) * price) AS v FROM T GROUP BY 1) SELECT CAST(coalesce(D.dt, V.dt) AS VARCHAR) AS dt, round(coalesce(v / nullif(b, 0), 0) {N}, 6) AS turnover FROM D FULL OUTER JOIN V ON V.dt = D.dt""",
    "slippage_adjusted_returns": f"""WITH {T_SQL}, {P_SQL}, {_MONTH_SQL}, D AS (SELECT dt, sum(value) AS pv FROM P GROUP BY dt), V AS (SELECT CAST(date_trunc('month', ts) AS DATE) AS dt, sum(abs(amount) * price) AS v FROM T GROUP BY 1)
      SELECT CAST(RM.dt AS VARCHAR) AS dt, round(coalesce(ret * (pv * ret - coalesce(v, 0) * 0.001) / nullif(pv * ret, 0), 0) {N}, 7) AS ret FROM RM LEFT JOIN D ON D.dt = RM.dt LEFT JOIN V ON V.dt = RM.dt""",
    "daily_txns_with_bar_data": f"WITH {_BARS_SQL} SELECT {_TS}, symbol, round(amount {N}, 4) AS amount, round(price {N}, 4) AS price, round(volume {N}, 4) AS volume FROM BARS",
    "days_to_liquidate": f"WITH {_DTL} SELECT {_TS}, symbol, round(days {N}, 7) AS days, round(alloc {N}, 7) AS alloc FROM DL",
    "max_days_to_liquidate": f"WITH {_DTL} SELECT symbol, {_TS}, round(days {N}, 7) AS days_to_liquidate, round(alloc * 100 {N}, 7) AS pos_alloc_pct FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY days DESC, dt) AS k FROM DL WHERE days IS NOT NULL) x WHERE k = 1",
    "low_liquidity_transactions": f"WITH {_BARS_SQL} SELECT symbol, round(max(amount * 100 / volume) {N}, 5) AS max_pct_bar_consumed FROM BARS GROUP BY symbol",
    "slippage_penalty": f"""WITH {_BARS_SQL}, {_MONTH_SQL}, PEN AS (SELECT dt, sum(pow(100 * amount / volume, 2) * 0.1 * price * 100 * amount) AS pen FROM BARS GROUP BY dt), NV AS (SELECT dt, ret, product(1 + ret) OVER (ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) * 1e8 AS nav FROM RM)
      SELECT 0 AS sid, CAST(NV.dt AS VARCHAR) AS dt, round(ret - coalesce(pen, 0) / nav {N}, 4) AS ret FROM NV LEFT JOIN PEN ON PEN.dt = NV.dt""",
    "detect_intraday": f"WITH {T_SQL}, {P_SQL}, H AS (SELECT count(*) AS h FROM P WHERE symbol <> 'cash' AND value <> 0), X AS (SELECT count(*) AS t FROM (SELECT DISTINCT CAST(ts AS DATE), symbol FROM T) y) SELECT round(h / t {N}, 7) AS ratio, h / t < 0.25 AS intraday FROM H, X",
    "txn_time_hist": f"WITH E AS (SELECT hour(ts) * 60 AS bin, sum(abs(value)) AS v FROM events GROUP BY 1) SELECT CAST(bin AS INTEGER) AS bin, round(v / sum(v) OVER () {N}, 7) AS share FROM E",
    "fill_blocks": f"""WITH {T_SQL}, A AS (SELECT *, lag(amount > 0) OVER w AS was, lag(ts) OVER w AS prev FROM T WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq)),
      C AS (SELECT *, sum(CASE WHEN was IS NULL OR was <> (amount > 0) OR ts - prev > INTERVAL 8 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS block FROM A)
      SELECT symbol, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS dt, round(sum(amount) {N}, 5) AS amount, round(sum(amount * price) / nullif(sum(amount), 0) {N}, 5) AS price FROM C GROUP BY symbol, block""",
    "factor_exposures": f"WITH {P_SQL}, {_L_SQL}, {_WEIGHT_SQL} SELECT CAST(PW.dt AS VARCHAR) AS dt, factor, round(sum(value * loading) {N}, 7) AS exposure FROM PW JOIN L ON L.dt = PW.dt AND L.symbol = PW.symbol GROUP BY PW.dt, factor",
    "perf_attrib_by_factor": f"WITH {_ATT} SELECT {_TS}, factor, round(exposure {N}, 7) AS exposure, round(contribution {N}, 7) AS contribution, round(tilt {N}, 7) AS tilt FROM BF",
    "perf_attrib_daily": f"WITH {_ATT} SELECT {_TS}, round(total {N}, 7) AS total, round(common {N}, 7) AS common, round(specific {N}, 7) AS specific, round(tilt {N}, 7) AS tilt, round(timing {N}, 7) AS timing FROM BD",
    "perf_attrib_summary": f"""WITH {_ATT}, U AS (SELECT 'total' AS part, total AS ret FROM BD UNION ALL SELECT 'common', common FROM BD UNION ALL SELECT 'specific', specific FROM BD)
      SELECT part, round(CASE WHEN product(1 + ret) <= 0 THEN -1 ELSE pow(product(1 + ret), 252.0 / count(*)) - 1 END {N}, 6) AS annual_return, round(product(1 + ret) - 1 {N}, 6) AS cum_returns_final, round(avg(ret) / stddev_samp(ret) * sqrt(252) {N}, 6) AS sharpe_ratio FROM U GROUP BY part""",
    "perf_attrib_factor_stats": f"WITH {_ATT} SELECT factor, round(CASE WHEN product(1 + contribution) <= 0 THEN -1 ELSE pow(product(1 + contribution), 252.0 / count(*)) - 1 END {N}, 6) AS annual_return, round(product(1 + contribution) - 1 {N}, 6) AS cum_returns_final, round(avg(exposure) {N}, 6) AS average_exposure FROM BF GROUP BY factor",
    "returns_less_costs": f"WITH {R_SQL} SELECT sid, {_TS}, round(product(1 + ret - 0.0001) OVER (PARTITION BY sid ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 {N}, 7) AS cum FROM R",
    "brinson": f"WITH {_BRINSON_SQL} SELECT {_TS}, round(allocation {N}, 7) AS allocation, round(selection {N}, 7) AS selection, round(interaction {N}, 7) AS interaction, round(allocation + selection + interaction {N}, 7) AS total, round(p {N}, 7) AS portfolio_return, round(b {N}, 7) AS benchmark_return, round(p - b {N}, 7) AS active_return FROM BR",
    "brinson_cumulative": f"WITH {_BRINSON_SQL} SELECT round(sum(allocation) {N}, 7) AS allocation, round(sum(selection) {N}, 7) AS selection, round(sum(interaction) {N}, 7) AS interaction, round(sum(allocation + selection + interaction) {N}, 7) AS total, round(product(1 + p) - 1 {N}, 7) AS portfolio_cumulative, round(product(1 + b) - 1 {N}, 7) AS benchmark_cumulative, round(product(1 + p) - product(1 + b) {N}, 7) AS active_cumulative FROM BR",
    "factor_regression": f"""WITH {R_SQL}, C AS (SELECT sid, count(*) AS n, avg(ret) AS y, avg(f) AS a, avg(f*f) AS b, var_pop(f) AS s11, var_pop(f*f) AS s22, covar_pop(f, f*f) AS s12, covar_pop(f, ret) AS s1y, covar_pop(f*f, ret) AS s2y, var_pop(ret) AS vy FROM R GROUP BY sid),
      Q AS (SELECT *, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1, (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2 FROM C)
      SELECT sid, n, round(y - b1 * a - b2 * b {N}, 5) AS alpha, round(b1 {N}, 5) AS mkt, round(b2 {N}, 5) AS smb, round((b1 * s1y + b2 * s2y) / vy {N}, 5) AS r_squared FROM Q""",
    "factor_regression_rolling": f"""WITH {R_SQL} SELECT sid, {_TS}, round(y - b * x {N}, 6) AS alpha, round(b {N}, 6) AS "MKT" FROM (SELECT sid, dt, count(*) OVER w AS n, avg(ret) OVER w AS y, avg(f) OVER w AS x, covar_pop(ret, f) OVER w / nullif(var_pop(f) OVER w, 0) AS b FROM R WINDOW w AS (PARTITION BY sid ORDER BY dt ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)) z WHERE n = 60""",
    "factor_decomposition": f"""WITH {R_SQL}, C AS (SELECT sid, avg(f) AS a, avg(f*f) AS b, var_pop(f) AS s11, var_pop(f*f) AS s22, covar_pop(f, f*f) AS s12, covar_pop(f, ret) AS s1y, covar_pop(f*f, ret) AS s2y FROM R GROUP BY sid)
      SELECT sid, round((s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) * a + (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) * b {N}, 6) AS factor_return, CAST(0.0 AS DOUBLE) AS unexplained FROM C""",
    "idiosyncratic_risk": f"WITH {R_SQL} SELECT sid, round(sqrt(greatest(var_pop(ret) - pow(regr_slope(ret, f), 2) * var_pop(f), 0)) {N}, 7) AS idiosyncratic_risk FROM R GROUP BY sid",
    "style_exposures": f"""WITH {R_SQL}, Q AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY dt DESC) AS k FROM R), S AS (SELECT sid, stddev_samp(ret) AS vol, product(1 + ret) FILTER (WHERE k <= 252) - 1 AS mom FROM Q GROUP BY sid), D AS (SELECT median(vol) AS mv, median(mom) AS mm FROM S),
      U AS (SELECT sid, CASE WHEN mom >= mm THEN 'momentum' ELSE 'reversal' END AS style FROM S, D UNION ALL SELECT sid, CASE WHEN vol >= mv THEN 'high_vol' ELSE 'low_vol' END FROM S, D) SELECT sid, style, round(1.0 / count(*) OVER (PARTITION BY style) {N}, 7) AS weight FROM U""",
    "style_summary": f"WITH {_STYLE_SQL} SELECT style, round(avg(ret) {N}, 7) AS ret FROM SR GROUP BY style",
    "regression_attribution": f"""WITH {_STYLE_SQL}, DP AS (SELECT dt, avg(ret) AS p FROM R GROUP BY dt), RA AS (SELECT style, covar_pop(SR.ret, p) / nullif(stddev_pop(SR.ret) * stddev_pop(p), 0) * avg(SR.ret) AS a FROM SR JOIN DP ON DP.dt = SR.dt GROUP BY style)
      SELECT style, round(a {N}, 7) AS attribution FROM RA UNION ALL SELECT 'residual', round((SELECT avg(p) FROM DP) - (SELECT coalesce(sum(a), 0) FROM RA) {N}, 7)""",
    "closing_transactions": f"""WITH {_BT_SQL}, {P_SQL}, LD AS (SELECT max(dt) AS dt FROM P), NET AS (SELECT symbol, sum(amount) AS net FROM BT GROUP BY symbol HAVING abs(sum(amount)) >= 1e-6),
      C AS (SELECT ts, symbol, amount, price FROM BT UNION ALL SELECT CAST(P.dt AS TIMESTAMP) + INTERVAL 1 SECOND, P.symbol, -net, value / net FROM P JOIN LD ON LD.dt = P.dt JOIN NET ON NET.symbol = P.symbol WHERE P.symbol <> 'cash' AND value <> 0)
      SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, symbol, round(amount {N}, 4) AS amount, round(price {N}, 4) AS price FROM C WHERE amount <> 0""",
    "estimate_intraday": f"""WITH E AS (SELECT CAST(ts AS TIMESTAMP) AS ts, event_type AS symbol, CASE WHEN user_id % 2 = 0 THEN 1.0 ELSE -1.0 END * value AS v FROM events),
      EP AS (SELECT CAST(ts AS DATE) AS dt, symbol, round(sum(v), 4) AS value FROM E GROUP BY 1, 2), V AS (SELECT CAST(ts AS DATE) AS dt, ts, symbol, sum(v) AS v FROM E GROUP BY 1, 2, 3),
      RC AS (SELECT *, sum(v) OVER (PARTITION BY dt, symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM V), ST AS (SELECT *, abs(cum) - abs(coalesce(lag(cum) OVER (PARTITION BY dt, symbol ORDER BY ts), 0)) AS step FROM RC),
      EX AS (SELECT dt, ts, sum(sum(step)) OVER (PARTITION BY dt ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e FROM ST GROUP BY dt, ts), PK AS (SELECT dt, ts AS peak FROM (SELECT *, row_number() OVER (PARTITION BY dt ORDER BY e DESC, ts) AS k FROM EX) x WHERE k = 1),
      IA AS (SELECT RC.dt, symbol, arg_max(cum, ts) AS intraday FROM RC JOIN PK ON PK.dt = RC.dt AND ts <= peak GROUP BY 1, 2), FO AS (SELECT dt, lead(dt) OVER (ORDER BY dt) AS next FROM (SELECT DISTINCT dt FROM EP) d),
      PR AS (SELECT next AS dt, symbol, value FROM EP JOIN FO ON FO.dt = EP.dt WHERE next IS NOT NULL AND symbol <> 'cash')
      SELECT CAST(coalesce(PR.dt, IA.dt) AS VARCHAR) AS dt, coalesce(PR.symbol, IA.symbol) AS symbol, round(coalesce(value, 0) + coalesce(intraday, 0) {N}, 4) AS value FROM PR FULL JOIN IA ON IA.dt = PR.dt AND IA.symbol = PR.symbol""",
    "round_trips": f"WITH {_TRIPS_SQL} SELECT symbol, strftime(open_dt, '%Y-%m-%d %H:%M:%S') AS open_dt, strftime(close_dt, '%Y-%m-%d %H:%M:%S') AS close_dt, long, round(pnl + 3.7e-7, 4) AS pnl, round(rt_returns + 3.7e-7, 4) AS rt_returns, duration_s FROM TRIPS",
    "round_trip_stats": f"WITH {_TRIPS_SQL}, K AS (SELECT 'all' AS kind, * FROM TRIPS UNION ALL SELECT CASE WHEN long THEN 'long' ELSE 'short' END, * FROM TRIPS) SELECT kind, {_TRIP_STATS} FROM K GROUP BY kind",
    "round_trip_stats_by_symbol": f"""WITH {_TRIPS_SQL} SELECT symbol, count(*) AS round_trips, round(sum(pnl) + 3.7e-7, 4) AS pnl, round(avg(rt_returns) + 3.7e-7, 4) AS avg_return, round(median(rt_returns) + 3.7e-7, 4) AS median_return, round(max(rt_returns) + 3.7e-7, 4) AS best_return, round(min(rt_returns) + 3.7e-7, 4) AS worst_return FROM TRIPS GROUP BY symbol""",
    "profit_attribution": f"WITH {_TRIPS_SQL} SELECT symbol, round(sum(pnl) / nullif(sum(sum(pnl)) OVER (), 0) {N}, 6) AS share FROM TRIPS GROUP BY symbol",
    "style_tilts": f"""WITH {R_SQL}, Q AS (SELECT sid, dt, round(product(1 + ret) OVER w - 1 + 3.7e-11, 9) AS mom, round(stddev_samp(ret) OVER w + 3.7e-11, 9) AS vol, count(*) OVER w AS n FROM R WINDOW w AS (PARTITION BY sid ORDER BY dt ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)), K AS (SELECT * FROM Q WHERE n = 60)
      SELECT sid, {_TS}, round((rank() OVER (PARTITION BY dt ORDER BY mom) + (count(*) OVER (PARTITION BY dt, mom) - 1) / 2.0) / count(*) OVER (PARTITION BY dt) {N}, 7) AS momentum_rank, round((rank() OVER (PARTITION BY dt ORDER BY vol) + (count(*) OVER (PARTITION BY dt, vol) - 1) / 2.0) / count(*) OVER (PARTITION BY dt) {N}, 7) AS volatility_rank FROM K""",
}
