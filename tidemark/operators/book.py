"""Positions (dt, symbol, value; the row ``cash`` is ordinary) and transactions (ts, symbol, amount, price)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics as M

CASH = "cash"


def percent_alloc(positions: DataFrame) -> DataFrame:
    """Adds ``alloc``: the value over the day's total, null where that is 0."""
    return positions.withColumn("alloc", F.try_divide("value", F.sum("value").over(Window.partitionBy("dt"))))


def stocks(positions: DataFrame) -> DataFrame:
    return positions.where(F.col("symbol") != CASH)


def extract_positions(raw: DataFrame, cash: DataFrame) -> DataFrame:
    """Long positions from (ts or dt, sid, amount, last_sale_price) and cash (dt, cash): the mean value of a day and sid,
    0 for sids not held that day among all that were ever held, and the day's cash."""
    held = raw.groupBy("dt", F.col("sid").cast("string").alias("symbol")).agg(F.avg(F.col("amount") * F.col("last_sale_price")).alias("value"))
    days = held.select("dt").distinct()
    # the calendar is one array (as long as there are days), exploded for every sid: the dense table is the result itself
    calendar = days.agg(F.collect_set("dt").alias("all_days"))
    grid = held.select("symbol").distinct().join(F.broadcast(calendar)).select("symbol", F.explode("all_days").alias("dt"))
    dense = grid.join(held, ["dt", "symbol"], "left").select("dt", "symbol", F.coalesce("value", F.lit(0.0)).alias("value"))
    money = days.join(cash, "dt", "left").select("dt", F.lit(CASH).alias("symbol"), F.coalesce("cash", F.lit(0.0)).alias("value"))
    return dense.unionByName(money)


def stack_positions(wide: DataFrame, dt: str = "dt") -> DataFrame:
    """Wide positions to long, cash and missing cells left out."""
    names = [c for c in wide.columns if c not in (dt, CASH)]
    return wide.unpivot([dt], names, "symbol", "value").where("value IS NOT NULL")


def wide_positions(positions: DataFrame, symbols: list[str] | None = None) -> DataFrame:
    """Long positions to one column per symbol."""
    return positions.groupBy("dt").pivot("symbol", symbols).agg(F.first("value"))


def normalized_positions(positions: DataFrame, pos_in_dollars: bool = True) -> DataFrame:
    """dt, symbol, value without cash; in dollars the values are first divided by the day's gross book."""
    held = stocks(positions)
    if pos_in_dollars:
        held = held.withColumn("value", F.try_divide("value", F.sum(F.abs("value")).over(Window.partitionBy("dt"))))
    return held.where("value IS NOT NULL")


def top_positions(positions: DataFrame, top: int = 10) -> DataFrame:
    """kind (long, short, abs), symbol, alloc: the ``top`` greatest, least and absolutely greatest allocations ever held."""
    by = stocks(percent_alloc(positions)).groupBy("symbol").agg(F.max("alloc").alias("long"), F.min("alloc").alias("short"), F.max(F.abs("alloc")).alias("abs"))
    parts = []
    for kind, order, keep in (("long", F.desc("long"), "long > 0"), ("short", F.asc("short"), "short < 0"), ("abs", F.desc("abs"), "abs IS NOT NULL")):
        parts.append(by.where(keep).orderBy(order, "symbol").limit(top).select(F.lit(kind).alias("kind"), "symbol", F.col(kind).alias("alloc")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def concentration(positions: DataFrame) -> DataFrame:
    """Daily greatest and median long, median and greatest short allocation."""
    a = F.col("alloc")
    long, short = F.when(a > 0, a), F.when(a < 0, a)
    return stocks(percent_alloc(positions)).groupBy("dt").agg(F.max(long).alias("max_long"), F.median(long).alias("median_long"), F.median(short).alias("median_short"), F.min(short).alias("max_short"))


def exposures(positions: DataFrame) -> DataFrame:
    """Daily long, short (as a positive number), gross, net, and gross over the whole portfolio (null where that is 0)."""
    v, stock = F.col("value"), F.col("symbol") != CASH
    long = F.coalesce(F.sum(F.when(stock & (v > 0), v)), F.lit(0.0))
    short = F.coalesce(F.sum(F.when(stock & (v < 0), -v)), F.lit(0.0))
    return positions.groupBy("dt").agg(long.alias("long"), short.alias("short"), (long + short).alias("gross"), (long - short).alias("net"), F.try_divide(long + short, F.sum(v)).alias("gross_leverage"))


def group_exposures(positions: DataFrame, groups: DataFrame, group: str = "sector") -> DataFrame:
    """Daily sum of value by ``group`` from ``groups`` (symbol, group); symbols without group drop out; cash stays as a group."""
    stock = stocks(positions).join(groups.select("symbol", group), "symbol").groupBy("dt", group).agg(F.sum("value").alias("value"))
    return stock.unionByName(positions.where(F.col("symbol") == CASH).groupBy("dt").agg(F.sum("value").alias("value")).select("dt", F.lit(CASH).alias(group), "value"))


def unmapped_symbols(positions: DataFrame, groups: DataFrame) -> DataFrame:
    return stocks(positions).select("symbol").distinct().join(groups, "symbol", "left_anti")


def cap_exposures(positions: DataFrame, caps: DataFrame, buckets: list[tuple[str, float, float]]) -> DataFrame:
    """Daily sum of value by market-cap bucket (name, low, high); ``caps`` has symbol, cap."""
    case = F.lit(None).cast("string")
    for name, low, high in reversed(buckets):
        case = F.when((F.col("cap") >= low) & (F.col("cap") < high), name).otherwise(case)
    return group_exposures(positions, caps.select("symbol", case.alias("cap_bucket")).where("cap_bucket IS NOT NULL"), "cap_bucket")


def style_exposure(positions: DataFrame, loadings: DataFrame) -> DataFrame:
    """Daily sum of value x loading over shared dates."""
    return positions.join(loadings, ["dt", "symbol"]).groupBy("dt").agg(F.sum(F.col("value") * F.col("loading")).alias("exposure"))


def volume_exposure(shares: DataFrame, volumes: DataFrame, percentile: float) -> DataFrame:
    """Daily count of names whose shares held exceed ``percentile`` of their volume."""
    over = F.coalesce(F.try_divide(F.abs("shares"), F.col("volume")) > percentile, F.lit(False))
    return shares.join(volumes, ["dt", "symbol"], "left").groupBy("dt").agg(F.sum(over.cast("int")).alias("names"))


# ---- transactions


def map_transactions(df: DataFrame) -> DataFrame:
    """ts, symbol, sid, amount, price with the defaults 0, 0 and '' for missing columns or values."""
    has = lambda c, default, kind: (F.coalesce(F.col(c), default) if default is not None else F.col(c)).cast(kind) if c in df.columns else F.lit(default if default is None else None).cast(kind) if default is None else default.cast(kind)
    return df.select(has("ts", None, "timestamp").alias("ts"), has("symbol", F.lit(""), "string").alias("symbol"), has("sid", None, "long").alias("sid"), has("amount", F.lit(0.0), "double").alias("amount"), has("price", F.lit(0.0), "double").alias("price"))


def txn_volume(transactions: DataFrame) -> DataFrame:
    """Daily traded value and shares."""
    size = F.abs("amount")
    return transactions.groupBy(F.to_date("ts").alias("dt")).agg(F.sum(size * F.col("price")).alias("txn_volume"), F.sum(size).alias("txn_shares"))


def turnover(positions: DataFrame, transactions: DataFrame, denominator: str = "AGB") -> DataFrame:
    """dt, turnover: traded value over the mean gross book of two days (half the first day's), or over the portfolio value."""
    if denominator == "AGB":
        gross = exposures(positions).select("dt", F.col("gross").alias("g"))
        w = Window.orderBy("dt")  # one row per day
        base = gross.select("dt", F.when(F.row_number().over(w) == 1, F.col("g") / 2).otherwise(F.avg("g").over(w.rowsBetween(-1, 0))).alias("base"))
    elif denominator == "portfolio_value":
        base = positions.groupBy("dt").agg(F.sum("value").alias("base"))
    else:
        raise ValueError("denominator must be AGB or portfolio_value")
    joined = base.join(txn_volume(transactions), "dt", "full_outer")
    return joined.select("dt", F.coalesce(F.try_divide("txn_volume", "base"), F.lit(0.0)).alias("turnover"))


def slippage_adjusted_returns(returns: DataFrame, positions: DataFrame, transactions: DataFrame, slippage_bps: float) -> DataFrame:
    """dt, ret: profit less ``slippage_bps`` of the traded value, rescaled to a return; 0 where undefined."""
    value = positions.groupBy("dt").agg(F.sum("value").alias("pv"))
    j = returns.join(value, "dt", "left").join(txn_volume(transactions), "dt", "left")
    pnl = F.col("pv") * F.col("ret")
    adjusted = F.col("ret") * F.try_divide(pnl - F.coalesce("txn_volume", F.lit(0.0)) * (slippage_bps * 0.0001), pnl)
    return j.select("dt", F.coalesce(adjusted, F.lit(0.0)).alias("ret"))


def daily_bars(transactions: DataFrame, market: DataFrame) -> DataFrame:
    """dt, symbol, amount (absolute, summed), price, volume."""
    daily = transactions.groupBy(F.to_date("ts").alias("dt"), "symbol").agg(F.sum(F.abs("amount")).alias("amount"))
    return daily.join(market.select("dt", "symbol", "price", "volume"), ["dt", "symbol"], "left")


def days_to_liquidate(positions: DataFrame, market: DataFrame, max_bar_consumption: float = 0.2, capital_base: float = 1e6, mean_volume_window: int = 5) -> DataFrame:
    """dt, symbol, days, alloc: allocation of the capital over the part of the mean dollar volume of the preceding bars
    that may be consumed; a symbol's first ``mean_volume_window`` bars are left out."""
    w = Window.partitionBy("symbol").orderBy("dt")
    bars = market.withColumn("dv", F.col("price") * F.col("volume")).withColumn("k", F.row_number().over(w))
    mean = F.when(F.count("dv").over(w.rowsBetween(-mean_volume_window, -1)) == mean_volume_window, F.avg("dv").over(w.rowsBetween(-mean_volume_window, -1)))
    bars = bars.withColumn("adv", mean).where(F.col("k") > mean_volume_window)
    days = F.try_divide(F.col("alloc") * capital_base, F.col("adv") * max_bar_consumption)
    return stocks(percent_alloc(positions)).join(bars.select("dt", "symbol", "adv"), ["dt", "symbol"]).select("dt", "symbol", days.alias("days"), "alloc")


def max_days_to_liquidate(positions: DataFrame, market: DataFrame, last_n_days: int | None = None, **params: float) -> DataFrame:
    """Each symbol's worst day: symbol, dt, days_to_liquidate, pos_alloc_pct."""
    d = days_to_liquidate(positions, market, **params)
    if last_n_days is not None:
        d = d.join(F.broadcast(d.agg(F.date_sub(F.max("dt"), last_n_days).alias("since")))).where(F.col("dt") >= F.col("since"))
    top = d.where("days IS NOT NULL").groupBy("symbol").agg(F.max(F.struct("days", (-F.unix_date("dt")).alias("k"), "dt", "alloc")).alias("t"))
    return top.select("symbol", F.col("t.dt").alias("dt"), F.col("t.days").alias("days_to_liquidate"), (F.col("t.alloc") * 100).alias("pos_alloc_pct"))


def low_liquidity_transactions(transactions: DataFrame, market: DataFrame, last_n_days: int | None = None) -> DataFrame:
    """Each symbol's day of greatest bar consumption: symbol, dt, max_pct_bar_consumed."""
    bars = daily_bars(transactions, market)
    if last_n_days is not None:
        bars = bars.join(F.broadcast(bars.agg(F.date_sub(F.max("dt"), last_n_days).alias("since")))).where(F.col("dt") > F.col("since"))
    pct = bars.withColumn("pct", F.try_divide(F.col("amount") * 100, F.col("volume"))).where("pct IS NOT NULL")
    top = pct.groupBy("symbol").agg(F.max(F.struct("pct", (-F.unix_date("dt")).alias("k"), "dt")).alias("t"))
    return top.select("symbol", F.col("t.dt").alias("dt"), F.col("t.pct").alias("max_pct_bar_consumed"))


def slippage_penalty(returns: DataFrame, bars: DataFrame, simulate_capital: float, backtest_capital: float, impact: float = 0.1) -> DataFrame:
    """sid, dt, ret less the penalty of trading a quadratic share of volume at ``simulate_capital``."""
    mult = simulate_capital / backtest_capital
    shares = F.abs(F.col("amount") * mult)
    used = F.try_divide(shares, F.col("volume"))
    daily = bars.groupBy("dt").agg(F.coalesce(F.sum(used * used * impact * F.col("price") * shares), F.lit(0.0)).alias("penalty"))
    nav = M.with_nav(returns, ["sid"]).join(daily, "dt", "left")
    value = F.col("nav") * backtest_capital * mult
    return nav.select("sid", "dt", F.coalesce(F.col("ret") - F.try_divide(F.coalesce("penalty", F.lit(0.0)), value), F.col("ret")).alias("ret"))


def detect_intraday(positions: DataFrame, transactions: DataFrame, threshold: float = 0.25) -> DataFrame:
    """One row: non-zero daily positions over symbols traded by day, and whether that is below ``threshold``."""
    held = stocks(positions).where("value <> 0").agg(F.count(F.lit(1)).alias("held"))
    traded = transactions.select(F.to_date("ts").alias("dt"), "symbol").distinct().agg(F.count(F.lit(1)).alias("traded"))
    ratio = F.try_divide(F.col("held").cast("double"), F.col("traded"))
    # both sides are single rows
    return held.join(F.broadcast(traded)).select(ratio.alias("ratio"), F.coalesce(ratio < threshold, F.lit(False)).alias("intraday"))


def estimate_intraday(positions: DataFrame, transactions: DataFrame) -> DataFrame:
    """dt, symbol, value: the book at each day's instant of greatest exposure, added to the previous day's closing positions."""
    per = transactions.withColumn("dt", F.to_date("ts")).groupBy("dt", "ts", "symbol").agg(F.sum(F.col("amount") * F.col("price")).alias("v"))
    w = Window.partitionBy("dt", "symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = per.withColumn("cum", F.sum("v").over(w))
    # exposure changes only through the traded symbol: the running sum of the changes of |cum| is the day's exposure
    before = F.coalesce(F.lag("cum").over(Window.partitionBy("dt", "symbol").orderBy("ts")), F.lit(0.0))
    steps = run.withColumn("step", F.abs("cum") - F.abs(before)).groupBy("dt", "ts").agg(F.sum("step").alias("step"))
    exposure = steps.withColumn("e", F.sum("step").over(Window.partitionBy("dt").orderBy("ts").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    peak = exposure.groupBy("dt").agg(F.max_by("ts", F.struct("e", (-F.unix_micros("ts")).alias("k"))).alias("peak"))
    at = run.join(peak, "dt").where("ts <= peak").groupBy("dt", "symbol").agg(F.max_by("cum", "ts").alias("intraday"))
    days = positions.select("dt").distinct()
    follow = days.select("dt", F.lead("dt").over(Window.orderBy("dt")).alias("next"))  # one row per day
    previous = stocks(positions).join(follow, "dt").where("next IS NOT NULL").select(F.col("next").alias("dt"), "symbol", "value")
    both = previous.join(at, ["dt", "symbol"], "full_outer")
    return both.select("dt", "symbol", (F.coalesce("value", F.lit(0.0)) + F.coalesce("intraday", F.lit(0.0))).alias("value"))


def transaction_hours(transactions: DataFrame, bin_minutes: int = 5) -> DataFrame:
    """bin (minutes since midnight), value: share of the traded value by time of day."""
    minute: Column = F.hour("ts") * 60 + F.minute("ts")
    by = transactions.groupBy((F.floor(minute / bin_minutes) * bin_minutes).cast("int").alias("bin")).agg(F.sum(F.abs(F.col("amount") * F.col("price"))).alias("v"))
    return by.select("bin", F.try_divide("v", F.sum("v").over(Window.partitionBy(F.lit(1)))).alias("share"))
