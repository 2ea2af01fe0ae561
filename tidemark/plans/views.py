"""Returns, positions, transactions and market data derived from the driver's sales tables, in Spark and as SQL CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table


def returns(spark: SparkSession, sf: str) -> DataFrame:
    """sid, dt, ret, f: a supplier's mean discount of a day against its mean tax."""
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("sid"), F.to_date("l_shipdate").alias("dt"))
    return rows.agg(F.round(F.avg("l_discount") - 0.05, 6).alias("ret"), F.round(F.avg("l_tax") - 0.04, 6).alias("f"))


R_SQL = """R AS (SELECT l_suppkey AS sid, CAST(l_shipdate AS DATE) AS dt, round(avg(l_discount) - 0.05, 6) AS ret, round(avg(l_tax) - 0.04, 6) AS f
  FROM lineitem GROUP BY 1, 2)"""

NAV_SQL = (
    R_SQL
    + """,
N0 AS (SELECT *, year(dt) AS yr, row_number() OVER w AS rn, product(1 + ret) OVER w AS nav, sum(ln(1 + ret)) OVER w AS log_nav,
  lag(ret) OVER (PARTITION BY sid ORDER BY dt) AS lagged
  FROM R WINDOW w AS (PARTITION BY sid ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
N1 AS (SELECT *, max(nav) OVER (PARTITION BY sid ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak FROM N0),
N2 AS (SELECT *, nav / greatest(1, peak) - 1 AS dd, nav / peak - 1 AS dd1 FROM N1),
CUT AS (SELECT sid, quantile_cont(ret, CAST(0.05 AS DOUBLE)) AS cut FROM R GROUP BY sid)"""
)

RUNS_SQL = (
    NAV_SQL
    + """,
U0 AS (SELECT *, dd1 < -1e-12 AS under, coalesce(lag(dd1 < -1e-12) OVER (PARTITION BY sid ORDER BY dt), FALSE) AS was FROM N2),
U1 AS (SELECT *, sum(CASE WHEN under AND NOT was THEN 1 ELSE 0 END) OVER (PARTITION BY sid ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM U0),
RUNS AS (SELECT sid, island, min(dd1) AS depth, min(rn) AS from_rn, max(rn) AS to_rn, min(dt) AS from_dt, max(dt) AS to_dt, max(rn) FILTER (WHERE tk = 1) AS trough_rn, max(dt) FILTER (WHERE tk = 1) AS trough_dt FROM (SELECT *, row_number() OVER (PARTITION BY sid, island, under ORDER BY round(dd1, 12), rn) AS tk FROM U1) u WHERE under GROUP BY 1, 2),
NV AS (SELECT N2.*, CUT.cut, DS.dd_mean, DS.dd_sumsq FROM N2 JOIN CUT USING (sid)
  LEFT JOIN (SELECT sid, avg(depth) AS dd_mean, sum(depth * depth) AS dd_sumsq FROM RUNS GROUP BY sid) DS USING (sid))"""
)


def trades(spark: SparkSession, sf: str) -> DataFrame:
    """ts, symbol, amount, price, seq (a total order within symbol and time): returned items are sold."""
    amount = F.col("l_quantity") * F.when(F.col("l_returnflag") == "R", -1.0).otherwise(1.0)
    return table(spark, sf, "lineitem").select(
        F.to_timestamp("l_shipdate").alias("ts"),
        F.col("l_suppkey").alias("symbol"),
        amount.alias("amount"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq"),
        F.col("l_partkey").alias("part"),
    )


T_SQL = """T AS (SELECT l_shipdate AS ts, l_suppkey AS symbol, l_quantity * CASE WHEN l_returnflag = 'R' THEN -1.0 ELSE 1.0 END AS amount,
  l_extendedprice / l_quantity AS price, l_orderkey * 100 + l_linenumber AS seq FROM lineitem)"""


def positions(spark: SparkSession, sf: str) -> DataFrame:
    """dt, symbol, value: a brand's open less filled sales of a month; the row ``cash`` is constant."""
    parts = table(spark, sf, "part").select("p_partkey", "p_brand")
    sign = F.when(F.col("l_linestatus") == "O", 1.0).otherwise(-1.0)
    held = (
        table(spark, sf, "lineitem")
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.trunc("l_shipdate", "month").alias("dt"), F.col("p_brand").alias("symbol"))
        .agg(F.round(F.sum(F.col("l_extendedprice") * sign), 2).alias("value"))
    )
    cash = held.select("dt").distinct().select("dt", F.lit("cash").alias("symbol"), F.lit(100000.0).alias("value"))
    return held.unionByName(cash)


P_SQL = """P0 AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS dt, p_brand AS symbol,
  round(sum(l_extendedprice * CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE -1.0 END), 2) AS value
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
P AS (SELECT * FROM P0 UNION ALL SELECT DISTINCT dt, 'cash', 100000.0 FROM P0)"""


def market(spark: SparkSession, sf: str) -> DataFrame:
    """dt, symbol, price, volume: monthly volume-weighted price and quantity of a brand."""
    parts = table(spark, sf, "part").select("p_partkey", "p_brand")
    rows = table(spark, sf, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.trunc("l_shipdate", "month").alias("dt"), F.col("p_brand").alias("symbol"))
    return rows.agg(F.round(F.sum("l_extendedprice") / F.sum("l_quantity"), 6).alias("price"), F.sum("l_quantity").alias("volume"))


M_SQL = """M AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS dt, p_brand AS symbol, round(sum(l_extendedprice) / sum(l_quantity), 6) AS price, sum(l_quantity) AS volume
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""
