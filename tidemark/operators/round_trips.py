"""Fill blocks and first-in-first-out round trips."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize
from .book import stocks

def _order(order: str | None) -> list[str]:
    return ["ts", *([order] if order else [])]


def fill_blocks(transactions: DataFrame, max_delta_seconds: int = 8 * 3600, order: str | None = None) -> DataFrame:
    """symbol, block, dt, amount, price: successive fills of one direction no further apart than ``max_delta_seconds`` become
    one fill at their volume-weighted price (null for a sum of zero shares), dated by the first. ``order`` breaks ties of
    ts; ``block`` (the first fill's ts and order) puts a symbol's blocks in order.

    A symbol's fills are scanned month by month, and the months joined through one row each, so a busy symbol is spread
    over many tasks. Fills without symbol or ts are left out."""
    keys = _order(order)
    part = ["symbol", "__month"]
    place = F.struct(*keys)
    rows = transactions.withColumn("ts", F.col("ts").cast("timestamp")).where("symbol IS NOT NULL AND ts IS NOT NULL")
    rows = rows.withColumn("__month", F.trunc("ts", "month")).withColumn("__side", F.col("amount") > 0).withColumn("__place", place)
    w = Window.partitionBy(*part).orderBy(*keys)
    inside = rows.withColumn("__ts0", F.lag("ts").over(w)).withColumn("__side0", F.lag("__side").over(w)).withColumn("__first", F.row_number().over(w) == 1)
    months = inside.groupBy(*part).agg(F.max(F.struct("__place", "ts", "__side")).alias("end"))
    by_month = Window.partitionBy("symbol").orderBy("__month")
    entry = months.select(*part, F.lag("end").over(by_month).alias("__before"))
    both = inside.join(entry, part)
    at = lambda c: F.when(F.col("__first"), F.col(f"__before.{c}")).otherwise(F.col(f"{'__ts0' if c == 'ts' else '__side0'}"))
    gap = F.unix_micros("ts") - F.unix_micros(at("ts")) > max_delta_seconds * 1_000_000
    fresh = both.withColumn("__fresh", F.coalesce((at("__side") != F.col("__side")) | gap, F.lit(True)))
    begun = F.max(F.when(F.col("__fresh"), F.col("__place")))
    started = fresh.withColumn("__own", begun.over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ends = started.groupBy(*part).agg(F.max("__own").alias("end"))
    carried = ends.select(*part, F.max("end").over(by_month.rowsBetween(Window.unboundedPreceding, -1)).alias("__carried"))
    blocks = started.join(carried, part).groupBy("symbol", F.coalesce("__own", "__carried").alias("block"))
    total = F.sum("amount")
    return blocks.agg(F.min("ts").alias("dt"), total.alias("amount"), F.try_divide(F.sum(F.col("amount") * F.col("price")), total).alias("price"))


def running_sums(df: DataFrame, keys: list[str], shard: Column, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Adds the sums so far (the row included) of each series in ``order``. ``shard`` must not fall along the order: shards
    are summed apart, and the totals of earlier ones added."""
    part = [*keys, "__shard"]
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*keys).orderBy("__shard").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, shard.alias("__shard")).agg(*(F.sum(v).alias(f"__t_{k}") for k, v in sums.items()))
    carry = totals.select(*part, *(F.coalesce(F.sum(f"__t_{k}").over(before), F.lit(0)).alias(f"__c_{k}") for k in sums))
    inside = df.withColumn("__shard", shard).select("*", *(F.sum(v).over(w).alias(k) for k, v in sums.items()))
    return inside.join(carry, part).select(*df.columns, *((F.col(k) + F.col(f"__c_{k}")).alias(k) for k in sums))


def match_lots(symbol: object, dts: list, amounts: list, prices: list, lots: deque | None = None) -> tuple[list[tuple], deque]:
    """First-in-first-out matching of one symbol's fills, one after the other, as a stream needs it: closes the oldest lots of the other side, what is left opens a lot.

    Whether a fill opens is decided by the youngest lot's side. Fills of negative price are skipped."""
    lots = deque() if lots is None else lots
    trips = []
    for dt, amount, price in zip(dts, amounts, prices, strict=True):
        if price is None or price != price or price < 0 or not amount:
            continue
        side = 1 if amount > 0 else -1
        left = abs(amount)
        if lots and lots[-1][0] != side:
            pnl = invested = 0.0
            opened = None
            while left > 0 and lots and lots[0][0] != side:
                own, cost, held, at = lots[0]
                opened = at if opened is None else opened
                used = min(left, held)
                pnl += own * (price - cost) * used
                invested += cost * used
                left -= used
                if used == held:
                    lots.popleft()
                else:
                    lots[0] = (own, cost, held - used, at)
            if opened is not None:
                trips.append((symbol, opened, dt, side < 0, pnl, pnl / invested if invested else 0.0))
        if left > 0:
            lots.append((side, price, left, dt))
    return trips, lots


def matches(blocks: DataFrame, per_bucket: int = 8, places: int = 6) -> DataFrame:
    """symbol, closed (block), opened (block), close_dt, open_dt, side, used, price, cost: which quantity of which opening fill
    each closing fill takes, first in, first out.

    Open lots always have one side, so a fill closes what of it fits into the position against it and opens the rest. In
    order of time the opened and the closed quantities of a symbol are two runs of intervals on one line, and matching is
    their overlap. Quantities are counted exactly, in whole numbers of 10^-``places`` shares; a symbol whose sums leave
    the 64 bits raises an error. Intervals are cut into buckets of about ``per_bucket`` fills and joined by symbol and
    bucket, so a busy symbol is spread over many tasks."""
    unit = 10.0**places
    rows = blocks.where("price >= 0 AND NOT isnan(price) AND amount IS NOT NULL AND amount <> 0 AND NOT isnan(amount)")
    rows = rows.withColumn("amount", F.round(F.col("amount").cast("double") * unit).cast("long")).where("amount <> 0")
    month, order = F.trunc("dt", "month"), ["dt", "block"]
    held = running_sums(rows, ["symbol"], month, order, {"position": F.col("amount")})
    before = F.col("position") - F.col("amount")
    against = ((before > 0) & (F.col("amount") < 0)) | ((before < 0) & (F.col("amount") > 0))
    closing = F.when(against, F.least(F.abs("amount"), F.abs(before))).otherwise(F.lit(0))
    split = held.withColumn("closing", closing).withColumn("opening", F.abs("amount") - F.col("closing"))
    lines = running_sums(split, ["symbol"], month, order, {"o": F.col("opening"), "c": F.col("closing")})
    width = split.where("opening > 0").groupBy("symbol").agg(F.ceil(F.avg("opening") * per_bucket).alias("width"))
    # read by both sides of the join
    base = materialize(lines.join(width, "symbol").select("symbol", "block", "dt", "amount", "price", "opening", "closing", "o", "c", "width"), "lots")
    side = F.signum("amount").cast("int")

    def intervals(size: str, end: str, names: dict[str, Column]) -> DataFrame:
        lo = F.col(end) - F.col(size)
        first, last = (F.call_function("div", v, F.col("width")) for v in (lo, F.col(end)))
        cut = base.where(F.col(size) > 0).select("symbol", "width", *(v.alias(n) for n, v in names.items()), lo.alias(f"{end}_lo"), F.col(end).alias(f"{end}_hi"), first.alias("__a"), last.alias("__b"))
        return cut.withColumn("bucket", F.explode(F.sequence("__a", "__b"))).drop("__a", "__b")

    opened = intervals("opening", "o", {"opened": F.col("block"), "open_dt": F.col("dt"), "cost": F.col("price"), "side": side}).drop("width")
    closed = intervals("closing", "c", {"closed": F.col("block"), "close_dt": F.col("dt"), "price": F.col("price")})
    j = closed.join(opened, ["symbol", "bucket"]).where("o_lo < c_hi AND c_lo < o_hi")
    lo, hi = F.greatest("o_lo", "c_lo"), F.least("o_hi", "c_hi")
    # a pair that meets in several buckets counts in the first
    once = F.col("bucket") == F.call_function("div", lo, F.col("width"))
    return j.where(once).select("symbol", "closed", "opened", "close_dt", "open_dt", "side", ((hi - lo) / unit).alias("used"), "price", "cost")


def round_trips(transactions: DataFrame, portfolio_value: DataFrame | None = None, order: str | None = None) -> DataFrame:
    """symbol, open_dt, close_dt, long, pnl, rt_returns, duration_s[, returns]: one row per closing fill.

    Fills are merged into blocks first; blocks of negative, null or NaN price or without amount are left out.
    With ``portfolio_value`` (dt, value) ``returns`` is the profit over the closing day's value."""
    # scanned several times over for the running sums
    m = matches(materialize(fill_blocks(transactions, order=order), "blocks"))
    pnl = F.sum(F.col("side") * (F.col("price") - F.col("cost")) * F.col("used"))
    out = m.groupBy("symbol", "closed").agg(F.min("open_dt").alias("open_dt"), F.min("close_dt").alias("close_dt"), (F.min("side") > 0).alias("long"), pnl.alias("pnl"), F.coalesce(F.try_divide(pnl, F.sum(F.col("cost") * F.col("used"))), F.lit(0.0)).alias("rt_returns")).drop("closed")
    out = out.withColumn("duration_s", ((F.unix_micros("close_dt") - F.unix_micros("open_dt")) / 1_000_000).cast("long"))
    if portfolio_value is not None:
        value = portfolio_value.select(F.col("dt").cast("date").alias("__d"), F.col("value").alias("__v"))
        out = out.withColumn("__d", F.to_date("close_dt")).join(value, "__d", "left").withColumn("returns", F.try_divide("pnl", "__v")).drop("__d", "__v")
    return out


def closing_transactions(positions: DataFrame, transactions: DataFrame) -> DataFrame:
    """The fills (ts, symbol, amount, price) and one closing fill per symbol still open, a second after the last position date."""
    last = positions.agg(F.max("dt").alias("dt"))
    held = stocks(positions).join(F.broadcast(last), "dt").where("value <> 0")
    net = transactions.groupBy("symbol").agg(F.sum("amount").alias("net")).where(F.abs("net") >= 1e-6)
    close = held.join(net, "symbol").select((F.col("dt").cast("timestamp") + F.expr("interval 1 second")).alias("ts"), "symbol", (-F.col("net")).alias("amount"), F.try_divide("value", "net").alias("price"))
    return transactions.select("ts", "symbol", "amount", "price").unionByName(close).where("amount <> 0")


def with_sector(trips: DataFrame, sectors: DataFrame) -> DataFrame:
    return trips.join(sectors.select("symbol", "sector"), "symbol", "left")


def round_trip_stats(trips: DataFrame, column: str = "rt_returns") -> DataFrame:
    """kind (all, long, short) with counts, profits, shares of winners, durations and returns, by grouping sets."""
    p, d, r = F.col("pnl"), F.col("duration_s"), F.col(column)
    win, lose = F.when(p > 0, p), F.when(p < 0, p)
    aggs = [
        F.count(F.lit(1)).alias("round_trips"), F.sum(p).alias("total_profit"), F.coalesce(F.sum(win), F.lit(0.0)).alias("gross_profit"), F.coalesce(F.sum(lose), F.lit(0.0)).alias("gross_loss"),
        F.try_divide(F.sum(win), -F.sum(lose)).alias("profit_factor"), F.avg(p).alias("avg_trade"), F.avg(win).alias("avg_winning"), F.avg(lose).alias("avg_losing"),
        F.try_divide(F.avg(win), -F.avg(lose)).alias("win_loss_ratio"), F.max(p).alias("largest_win"), F.min(p).alias("largest_loss"),
        F.try_divide(F.count(win), F.count(F.lit(1))).alias("percent_profitable"), F.count(win).alias("winning"), F.count(lose).alias("losing"), F.count(F.when(p == 0, 1)).alias("even"),
        F.avg(d).alias("avg_duration_s"), F.median(d).alias("median_duration_s"), F.max(d).alias("longest_s"), F.min(d).alias("shortest_s"),
        F.avg(r).alias("avg_return"), F.median(r).alias("median_return"), F.max(r).alias("best_return"), F.min(r).alias("worst_return"), F.stddev_samp(r).alias("std_return"),
    ]
    both = trips.groupBy(F.when(F.col("long"), "long").otherwise("short").alias("kind")).agg(*aggs)
    return trips.agg(*aggs).select(F.lit("all").alias("kind"), "*").unionByName(both)


def round_trip_stats_by_symbol(trips: DataFrame, column: str = "rt_returns") -> DataFrame:
    r = F.col(column)
    return trips.groupBy("symbol").agg(F.count(F.lit(1)).alias("round_trips"), F.sum("pnl").alias("pnl"), F.avg(r).alias("avg_return"), F.median(r).alias("median_return"), F.max(r).alias("best_return"), F.min(r).alias("worst_return"))


def profit_attribution(trips: DataFrame, by: str = "symbol") -> DataFrame:
    """Each symbol's (or sector's) share of the total profit."""
    g = trips.groupBy(by).agg(F.sum("pnl").alias("pnl"))
    return g.select(by, F.try_divide("pnl", F.sum("pnl").over(Window.partitionBy(F.lit(1)))).alias("share"))
