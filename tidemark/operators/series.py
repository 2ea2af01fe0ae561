"""Row-level operators over long returns (sid, dt, ret[, f]): transforms, resampling, drawdowns, runs and rolling windows."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions.periods import annualization_factor, bucket, business_days, week_end


def clean(df: DataFrame, sid: str | None, dt: str, ret: str) -> DataFrame:
    """Long form (sid, dt, ret): NaN to null, dates as DATE; one series without ``sid`` gets the key 0."""
    r = F.col(ret).cast("double")
    key = F.col(sid) if sid else F.lit(0)
    return df.select(key.alias("sid"), F.col(dt).cast("date").alias("dt"), F.when(~F.isnan(r), r).alias("ret"))


def align(a: DataFrame, b: DataFrame, how: str = "full_outer", on: Iterable[str] = ("sid", "dt")) -> DataFrame:
    """Returns with the benchmark as ``f``. Two series align by full outer join, frames by inner join."""
    return a.join(b.withColumnRenamed("ret", "f"), list(on), how)


def adjust(df: DataFrame, amount: float | str) -> DataFrame:
    """Subtracts a number or another column of the same rows."""
    if amount == 0:
        return df
    return df.withColumn("ret", F.col("ret") - (F.col(amount) if isinstance(amount, str) else F.lit(amount)))


def simple_returns(prices: DataFrame, sid: str = "sid", dt: str = "dt", price: str = "price") -> DataFrame:
    """Change against the previous price; each series' first row is dropped; a zero base gives infinity with the
    change's sign, and null for no change. Years are scanned apart, and joined through one price each."""
    part = ["sid", "__year"]
    w = Window.partitionBy(*part).orderBy("dt")
    rows = prices.select(F.col(sid).alias("sid"), F.col(dt).alias("dt"), F.col(price).cast("double").alias("p")).withColumn("__year", F.year("dt"))
    # struct: a null price before is not the same as no row before
    inside = rows.withColumn("before", F.lag(F.struct("p")).over(w))
    last = inside.groupBy(*part).agg(F.max_by(F.struct("p"), "dt").alias("last"))
    entry = last.select(*part, F.lag("last").over(Window.partitionBy("sid").orderBy("__year")).alias("entry"))
    joined = inside.join(entry, part).withColumn("before", F.coalesce("before", "entry")).where("before IS NOT NULL")
    q = F.col("before.p")
    change = F.when(q == 0, F.when(F.col("p") > 0, M.INF()).when(F.col("p") < 0, -M.INF())).otherwise(F.try_divide("p", q) - 1)
    return joined.select("sid", "dt", change.alias("ret"))


def cum_returns(df: DataFrame, starting_value: float = 0.0, keys: list[str] | None = None) -> DataFrame:
    """Adds ``cum``: compounded so far, missing returns as 0; from 0 the growth less one, else times the start."""
    nav = M.with_nav(df, keys or ["sid"])
    return nav.withColumn("cum", F.col("nav") - 1 if starting_value == 0 else F.col("nav") * starting_value)


def aggregate_returns(df: DataFrame, convert_to: str = "monthly", keys: list[str] | None = None) -> DataFrame:
    """Compounded per calendar week (calendar year and ISO week), month, quarter or year."""
    return df.groupBy(*(keys or ["sid"]), *bucket(convert_to)).agg((M.growth() - 1).alias("ret"))


def normalize(df: DataFrame, starting_value: float = 1.0, value: str = "ret") -> DataFrame:
    """Rescaled so that each series' first value becomes ``starting_value``; all null where it is 0."""
    w = Window.partitionBy("sid").orderBy("dt").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumn("normalized", F.try_divide(F.col(value), F.first(value).over(w)) * starting_value)


def by_year(df: DataFrame, name: str, **params: object) -> DataFrame:
    """Any aggregate metric per calendar year."""
    return M.compute(df.withColumn("year", F.year("dt")), [name], ["sid", "year"], **params)


def annual_active_return(df: DataFrame, keys: list[str] | None = None, period: str = "daily", annualization: float | None = None) -> DataFrame:
    ann = annualization_factor(period, annualization)
    return df.groupBy(*(keys or ["sid"])).agg((M.cagr(M.R(), M.rows(), ann) - M.cagr(M.B(), M.rows(), ann)).alias("annual_active_return"))


def alpha_percentile_rank(df: DataFrame, target: object, **params: object) -> DataFrame:
    """Share of the other series' alphas that lie strictly below that of ``target``; series of under 3 rows do not count."""
    alphas = M.compute(df, ["alpha"], **params).join(df.groupBy("sid").agg(F.count(F.lit(1)).alias("n")), "sid").where("n >= 3 AND alpha IS NOT NULL")
    own = alphas.where(F.col("sid") == F.lit(target)).select(F.col("alpha").alias("own")).limit(1)
    # one row, by definition of sid
    return alphas.where(F.col("sid") != F.lit(target)).join(F.broadcast(own)).agg(F.avg((F.col("alpha") < F.col("own")).cast("double")).alias("alpha_percentile_rank"))


# ---- drawdowns


def drawdown_runs(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Every run below the running peak: depth, rows from its start to its trough, and from there to recovery (null
    while it is open)."""
    keys = keys or ["sid"]
    last = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    runs = M.drawdown_runs(df, keys).join(last, keys)
    return runs.select(
        *keys,
        "from_dt",
        "trough_dt",
        "to_dt",
        "depth",
        (F.col("trough_rn") - F.col("from_rn")).alias("fall_rows"),
        F.when(F.col("to_rn") < F.col("rows"), F.col("to_rn") + 1 - F.col("trough_rn")).alias("recovery_rows"),
    )


def nth_drawdown(df: DataFrame, n: int) -> DataFrame:
    """The n-th deepest run of each series."""
    rank = F.row_number().over(Window.partitionBy("sid").orderBy("depth", "from_dt"))
    return drawdown_runs(df).withColumn("k", rank).where(F.col("k") == n).drop("k")


def max_drawdown_dates(df: DataFrame) -> DataFrame:
    """sid, peak, valley, recovery of the deepest drawdown (recovery null while open), with calendar-day lengths."""
    nav = M.with_nav(df, ["sid"])
    low = nav.groupBy("sid").agg(F.min_by("dt", F.struct("dd1", "dt")).alias("valley"), F.min("dd1").alias("depth")).where("depth < 0")
    at = nav.join(low, "sid")
    out = at.groupBy("sid", "valley", "depth").agg(
        F.max(F.when((F.col("dd1") == 0) & (F.col("dt") <= F.col("valley")), F.col("dt"))).alias("peak"),
        F.min(F.when((F.col("dd1") == 0) & (F.col("dt") >= F.col("valley")), F.col("dt"))).alias("recovery"),
    )
    days, back = F.datediff("valley", "peak"), F.datediff("recovery", "valley")
    return out.select(
        "sid", "peak", "valley", "recovery", "depth", days.alias("days"), (days / 7).alias("weeks"), (days / 30).alias("months"),
        back.alias("recovery_days"), (back / 7).alias("recovery_weeks"), (back / 30).alias("recovery_months"),
    )


def top_drawdowns(df: DataFrame, top: int = 10) -> DataFrame:
    """sid, rank, depth_pct, peak, valley, recovery, duration (business days): the deepest drawdowns, one after the other.

    A recovered one is cut out of the series; an open one takes everything after its peak with it. That leaves the
    runs below the running peak that lie before the deepest open one, so runs are enough: no series is gathered.
    """
    runs = M._dd_runs(M.with_nav(df, ["sid"]), ["sid"]).withColumnRenamed("peak_dt", "peak").withColumnRenamed("next_dt", "recovery")
    rank = F.row_number().over(Window.partitionBy("sid").orderBy("depth", "from_dt"))
    return runs.withColumn("rank", rank).where(F.col("rank") <= top).select(
        "sid", "rank", (-F.col("depth") * 100).alias("depth_pct"), "peak", F.col("trough_dt").alias("valley"), "recovery",
        F.when(F.col("recovery").isNotNull(), business_days(F.col("peak"), F.col("recovery"))).alias("duration"),
    )


# ---- runs of gains and losses


def resample(df: DataFrame, level: str) -> DataFrame:
    """sid, dt (week-ending Sunday or month's last day), ret compounded; empty buckets come out with null returns."""
    if level == "day":
        return df.select("sid", "dt", "ret")
    if level not in ("week", "month"):
        raise ValueError("level must be day, week or month")
    end = week_end() if level == "week" else F.last_day("dt")
    held = df.groupBy("sid", end.alias("dt")).agg(F.when(M.valid() > 0, M.growth() - 1).alias("ret"))
    step = F.expr("interval 7 days") if level == "week" else F.expr("interval 1 month")
    span = held.groupBy("sid").agg(F.min("dt").alias("a"), F.max("dt").alias("b"))
    start = F.col("a") if level == "week" else F.trunc("a", "month")
    grid = span.select("sid", F.explode(F.sequence(start, F.col("b"), step)).alias("dt"))
    if level == "month":
        grid = grid.select("sid", F.last_day("dt").alias("dt"))
    return grid.join(held, ["sid", "dt"], "left")


def runs(df: DataFrame, up: bool = True) -> DataFrame:
    """Maximal runs of positive (or negative) returns: sid, length, total, first, last."""
    found = M.stretches(df, ["sid"], F.col("ret") > 0 if up else F.col("ret") < 0)
    return found.groupBy("sid", "anchor").agg(F.count(F.lit(1)).alias("length"), F.sum("ret").alias("total"), F.min("dt").alias("first"), F.max("dt").alias("last")).drop("anchor")


def longest_run(df: DataFrame, up: bool = True, level: str = "day") -> DataFrame:
    """sid, length, first, last, best_total: the longest run (the earliest of equals) and the run of greatest gain or loss."""
    data = resample(df, level)
    r = runs(data, up)
    best = F.max("total") if up else F.min("total")
    top = r.groupBy("sid").agg(F.max(F.struct("length", (-F.unix_date("first")).alias("k"), "first", "last")).alias("t"), best.alias("best_total"))
    return data.select("sid").distinct().join(top, "sid", "left").select("sid", F.coalesce("t.length", F.lit(0)).alias("length"), F.col("t.first").alias("first"), F.col("t.last").alias("last"), "best_total")


def consecutive_stats(df: DataFrame) -> DataFrame:
    """The six longest runs: up and down, by day, week and month."""
    out = None
    for level in ("day", "week", "month"):
        for up in (True, False):
            name = f"max_consecutive_{'up' if up else 'down'}_{level}s"
            part = longest_run(df, up, level).select("sid", F.col("length").alias(name))
            out = part if out is None else out.join(part, "sid")
    return out


# ---- rolling windows

ROLLING = ("sharpe", "volatility", "sortino", "mean_return", "max_drawdown")
ROLLING_WITH_F = ("beta", "alpha", "mean_alpha", "up_capture", "down_capture", "up_down_capture")
SHARD_ROWS = 50_000


def window_shards(df: DataFrame, window: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``df`` with rn, shard, block and own. Series are cut into shards of about ``shard_rows`` rows, each led by the last
    ``window`` rows of the one before (own is false there), so every window lies within one shard and a long series is
    spread over tasks. Blocks hold ``window`` rows: a window is the end of one block and the beginning of the next."""
    size = window * max(1, -(-shard_rows // window))
    k = F.col("rn") - 1
    own = F.floor(k / size)
    held = M.numbered(df)
    cut = held.withColumn("shard", F.explode(F.when(F.pmod(k, F.lit(size)) >= size - window, F.array(own, own + 1)).otherwise(F.array(own))))
    return cut.withColumn("block", F.floor(k / window)).withColumn("own", F.col("shard") == own)


def window_parts(cut: DataFrame, window: int, parts: dict[str, Column]) -> DataFrame:
    """``cut`` (of ``window_shards``) with each aggregate of ``parts`` over both pieces of every row's window: ``a_...`` over its
    block so far and ``b_...`` over the end of the block before. Nothing is ever subtracted, so nothing cancels."""
    group = ["sid", "shard"]
    start = (Window.unboundedPreceding, Window.currentRow)
    forth, back = (Window.partitionBy(*group, "block").orderBy(o).rowsBetween(*start) for o in ("rn", F.desc("rn")))
    through = Window.partitionBy(*group).orderBy("block", "rn")
    tails = cut.select("*", *(v.over(back).alias(f"t_{k}") for k, v in parts.items()))
    split = F.pmod(F.col("rn") - 1, F.lit(window)) < window - 1
    both = tails.select(*cut.columns, *(v.over(forth).alias(f"a_{k}") for k, v in parts.items()), *(F.lag(f"t_{k}", window - 1).over(through).alias(f"b_{k}") for k in parts))
    return both.select(*cut.columns, *(f"a_{k}" for k in parts), *(F.when(split, F.col(f"b_{k}")).alias(f"b_{k}") for k in parts)).where("own")


def moments(key: str, x: Column) -> dict[str, Column]:
    """Aggregates of one column for ``window_parts``: number, mean, variance, extremes."""
    return {f"{key}n": F.count(x), f"{key}m": F.avg(x), f"{key}q": F.var_pop(x), f"{key}hi": F.max(x), f"{key}lo": F.min(x)}


def _whole(k: str) -> tuple[Column, Column]:
    return F.coalesce(f"a_{k}", F.lit(0.0)), F.coalesce(f"b_{k}", F.lit(0.0))


def _number(key: str) -> Column:
    a, b = _whole(f"{key}n")
    return a + b


def _mean(key: str, of: str = "m") -> Column:
    (na, nb), (ma, mb) = _whole(f"{key}n"), _whole(f"{key}{of}")
    return F.try_divide(na * ma + nb * mb, na + nb)


def _spread(key: str, sums: str = "q", x: str = "m", y: str = "m") -> Column:
    """Sum of squared deviations (or products) of both pieces together."""
    (na, nb), (qa, qb), (xa, xb), (ya, yb) = (_whole(f"{key}{c}") for c in ("n", sums, x, y))
    return na * qa + nb * qb + (xa - xb) * (ya - yb) * F.coalesce(F.try_divide(na * nb, na + nb), F.lit(0.0))


def _constant(key: str, hi: str = "hi", lo: str = "lo") -> Column:
    return F.greatest(f"a_{key}{hi}", f"b_{key}{hi}") == F.least(f"a_{key}{lo}", f"b_{key}{lo}")


def _deviation(key: str) -> Column:
    n = _number(key)
    return F.when(n >= 2, F.when(_constant(key), F.lit(0.0)).otherwise(F.sqrt(_spread(key) / (n - 1))))


def rolling(df: DataFrame, names: Iterable[str] | str = "all", window: int = 252, risk_free: float = 0.0, period: str = "daily", annualization: float | None = None, full: bool = True) -> DataFrame:
    """sid, dt and one column per metric over the last ``window`` rows; all metrics share one pass.

    With ``full`` only rows with a complete window come out; without, earlier rows have nulls. Unknown names raise
    ValueError. NaN counts as null; nulls take a place in the window and no part in the sums. A row costs the same
    whatever the window: each window is put together from the moments of two pieces (see ``window_parts``), and a far
    reading leaves no trace once it has left the window.
    """
    ann = annualization_factor(period, annualization)
    with_f = "f" in df.columns
    known = ROLLING + (ROLLING_WITH_F if with_f else ())
    chosen = list(known) if names == "all" else [names] if isinstance(names, str) else list(names)
    if unknown := [n for n in chosen if n not in known]:
        raise ValueError(f"unknown rolling metrics {unknown}; there are {sorted(known)}")
    data = df.select("sid", "dt", *(F.when(~F.isnan(c), F.col(c)).alias(c) for c in (("ret", "f") if with_f else ("ret",))))
    cut = window_shards(data, window)
    r = F.col("ret")
    parts: dict[str, Column] = {}
    if {"sharpe", "volatility", "sortino", "mean_return"} & set(chosen):
        parts |= moments("r", r)
    if "sortino" in chosen:
        parts |= moments("l", F.when(r.isNotNull(), F.least(r, F.lit(0.0))))
    if {"beta", "alpha", "mean_alpha"} & set(chosen):
        pair = r.isNotNull() & F.col("f").isNotNull()
        y, x = F.when(pair, r), F.when(pair, F.col("f"))
        parts |= {"pn": F.count(y), "py": F.avg(y), "px": F.avg(x), "pyx": F.covar_pop(y, x), "pxx": F.var_pop(x), "phi": F.max(x), "plo": F.min(x)}
    sides = [("u", F.col("f") > 0)] if {"up_capture", "up_down_capture"} & set(chosen) else []
    sides += [("d", F.col("f") < 0)] if {"down_capture", "up_down_capture"} & set(chosen) else []
    for key, where in sides:
        parts |= {f"{key}n": F.count(F.when(where, 1)), **{f"{key}{c}": F.product(F.when(where, 1 + F.col(c))) for c in ("ret", "f")}}

    def capture(key: str) -> Column:
        n = _number(key)

        def cagr(c: str) -> Column:
            end = F.coalesce(f"a_{key}{c}", F.lit(1.0)) * F.coalesce(f"b_{key}{c}", F.lit(1.0))
            return F.when(n < 1, None).when(end <= 0, -1.0).otherwise(F.pow(end, F.try_divide(F.lit(ann), n)) - 1)

        return F.try_divide(cagr("ret"), cagr("f"))

    def slope() -> Column:
        n, xx = _number("p"), _spread("p", "xx", "x", "x")
        return F.when((n >= 2) & ~_constant("p") & (xx / n >= 1e-30), F.try_divide(_spread("p", "yx", "y", "x"), xx))

    def sharpe() -> Column:
        sd, excess = _deviation("r"), _mean("r") - risk_free
        return F.when(sd == 0, F.when(excess > 0, M.INF()).when(excess < 0, -M.INF())).otherwise(F.try_divide(excess, sd)) * math.sqrt(ann)

    built = {
        "sharpe": sharpe,
        "volatility": lambda: _deviation("r") * math.sqrt(ann),
        "sortino": lambda: F.try_divide(_mean("r") * math.sqrt(ann), _deviation("l")),
        "mean_return": lambda: _mean("r") * ann,
        "up_capture": lambda: capture("u"),
        "down_capture": lambda: capture("d"),
        "up_down_capture": lambda: F.try_divide(capture("u"), capture("d")),
        "beta": slope,
        "mean_alpha": lambda: _mean("p", "y") - slope() * _mean("p", "x"),
        "alpha": lambda: F.pow(1 + _mean("p", "y") - risk_free - slope() * (_mean("p", "x") - risk_free), F.lit(ann)) - 1,
    }
    ready = (window_parts(cut, window, parts) if parts else cut.where("own")).select("sid", "dt", "rn", *(built[m]().alias(m) for m in chosen if m != "max_drawdown"))
    if "max_drawdown" in chosen:
        falls = _rolling_drawdown(cut, window)
        ready = falls if full and chosen == ["max_drawdown"] else ready.join(falls.drop("dt"), ["sid", "rn"], "left")
    if full:
        return ready.where(F.col("rn") >= window).select("sid", "dt", *chosen)
    return ready.select("sid", "dt", *(F.when(F.col("rn") >= window, F.col(m)).alias(m) for m in chosen))


def window_drawdowns(x: np.ndarray, window: int) -> np.ndarray:
    """Deepest drawdown of every full window, the window's start counting as a peak.

    Stretches of doubled length are joined (greatest, least and deepest fall of each), then the window is put together
    from the stretches of its binary digits: log2(window) steps over the whole array."""
    nav = np.concatenate([[1.0], np.cumprod(1 + np.nan_to_num(x))])
    if np.any(nav <= 0) or not np.all(np.isfinite(nav)):  # everything lost within: compound each window by itself
        cut = np.lib.stride_tricks.sliding_window_view(np.nan_to_num(x), window)
        out = np.empty(len(cut))
        for k in range(0, len(cut), 4096):
            c = np.cumprod(1 + cut[k : k + 4096], axis=1)
            p = np.maximum(np.maximum.accumulate(c, axis=1), 1.0)
            out[k : k + 4096] = np.minimum((c / p - 1).min(axis=1), 0.0)
        return out
    length = window + 1
    hi, lo, fall = nav, nav, np.zeros(len(nav))
    size, done = 1, 0
    acc: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
    n = len(nav) - length + 1
    while True:
        if length & size:
            part = tuple(v[done : done + n] for v in (hi, lo, fall))
            acc = part if acc is None else (np.maximum(acc[0], part[0]), np.minimum(acc[1], part[1]), np.minimum(np.minimum(acc[2], part[2]), part[1] / acc[0] - 1))
            done += size
        if done == length:
            return acc[2]
        hi, lo, fall = np.maximum(hi[:-size], hi[size:]), np.minimum(lo[:-size], lo[size:]), np.minimum(np.minimum(fall[:-size], fall[size:]), lo[size:] / hi[:-size] - 1)
        size *= 2


def _rolling_drawdown(cut: DataFrame, window: int) -> DataFrame:
    """sid, rn, dt, max_drawdown of full windows, shard by shard."""
    kind, day = cut.schema["sid"].dataType.simpleString(), cut.schema["dt"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn")
        tail = pdf.iloc[window - 1 :] if len(pdf) >= window else pdf.iloc[:0]
        fall = window_drawdowns(pdf["ret"].to_numpy(dtype=float), window) if len(tail) else np.zeros(0)
        return tail[["sid", "rn", "dt"]].assign(max_drawdown=fall)[tail["own"].to_numpy()]

    return cut.select("sid", "shard", "rn", "dt", "ret", "own").groupBy("sid", "shard").applyInPandas(run, f"sid {kind}, rn long, dt {day}, max_drawdown double")


def roll(df: DataFrame, function: Callable[..., float], window: int, columns: tuple[str, ...] = ("ret",)) -> DataFrame:
    """sid, dt, value: any Python function of the last ``window`` values of one or two columns, full windows only.

    The function sees views of one shard's values; no window is copied. Nulls arrive as NaN."""
    cut = window_shards(df.select("sid", "dt", *dict.fromkeys(columns)), window)
    kind, day = df.schema["sid"].dataType.simpleString(), df.schema["dt"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn")
        tail = pdf.iloc[window - 1 :] if len(pdf) >= window else pdf.iloc[:0]
        own = tail["own"].to_numpy(dtype=bool)
        views = [np.lib.stride_tricks.sliding_window_view(pdf[c].to_numpy(dtype=float), window)[own] for c in columns] if len(tail) else [[] for _ in columns]
        return tail[["sid", "dt"]][own].assign(value=[float(function(*w)) for w in zip(*views, strict=True)])

    return cut.groupBy("sid", "shard").applyInPandas(run, f"sid {kind}, dt {day}, value double")


def up(df: DataFrame) -> DataFrame:
    """Rows with a rising benchmark."""
    return df.where("f > 0")


def down(df: DataFrame) -> DataFrame:
    """Rows with a falling benchmark."""
    return df.where("f < 0")


def beta_fragility(df: DataFrame) -> DataFrame:
    """sid, beta_fragility_heuristic: weighted curvature of the returns at the benchmark's lowest, middle and highest value."""
    ok = df.where("ret IS NOT NULL AND f IS NOT NULL")
    w = Window.partitionBy("sid").orderBy("f", "dt")
    n = F.count(F.lit(1)).over(Window.partitionBy("sid"))
    ranked = ok.withColumn("k", F.row_number().over(w)).withColumn("n", n)
    pick = lambda c, k: F.max(F.when(F.col("k") == k, F.col(c)))
    mid = F.bround(F.col("n") / 2).cast("int") + 1
    g = ranked.groupBy("sid", "n").agg(pick("ret", F.lit(1)).alias("r0"), pick("ret", mid).alias("r1"), pick("ret", F.col("n")).alias("r2"), pick("f", F.lit(1)).alias("f0"), pick("f", mid).alias("f1"), pick("f", F.col("n")).alias("f2"))
    span = F.col("f2") - F.col("f0")
    a = F.when(span == 0, 0.5).otherwise(F.try_divide(F.col("f1") - F.col("f0"), span))
    b = F.when(span == 0, 0.5).otherwise(F.try_divide(F.col("f2") - F.col("f1"), span))
    return g.select("sid", F.when(F.col("n") >= 3, a * F.col("r0") + b * F.col("r2") - F.col("r1")).alias("beta_fragility_heuristic"))


def r_cubed_turtle(df: DataFrame, period: str = "daily", annualization: float | None = None) -> DataFrame:
    """Annualised slope of the growth line over the mean of the yearly maximum drawdowns."""
    ann = annualization_factor(period, annualization)
    slope = M.with_nav(df, ["sid"]).groupBy("sid").agg((F.regr_slope("nav", F.col("rn").cast("double")) * ann).alias("rar"))
    dds = by_year(df, "max_drawdown").groupBy("sid").agg(F.avg(F.abs("max_drawdown")).alias("mdd"))
    ratio = F.when(F.col("mdd") < 1e-15, F.when(F.col("rar") > 0, M.INF())).otherwise(F.try_divide("rar", "mdd"))
    return slope.join(dds, "sid").select("sid", ratio.alias("r_cubed_turtle"))


def interesting_periods(df: DataFrame, periods: list[tuple[str, str, str]]) -> DataFrame:
    """Rows of each named period (name, first day, last day) that the data overlaps; the list is a driver-side constant."""
    spark = df.sparkSession
    dim = spark.createDataFrame(periods, "name string, a string, b string").select("name", F.to_date("a").alias("a"), F.to_date("b").alias("b"))
    return df.join(F.broadcast(dim), F.col("dt").between(F.col("a"), F.col("b"))).drop("a", "b")


# ---- statistics that need a whole series at once


def minimum(f: Callable[[float], float], a: float, b: float, tol: float = 1e-10) -> float:
    """Golden-section search for the least value of a unimodal function."""
    g = (math.sqrt(5) - 1) / 2
    c, d = b - g * (b - a), a + g * (b - a)
    fc, fd = f(c), f(d)
    while abs(b - a) > tol:
        if fc < fd:
            b, d, fd = d, c, fc
            c = b - g * (b - a)
            fc = f(c)
        else:
            a, c, fc = c, d, fd
            d = a + g * (b - a)
            fd = f(d)
    return (a + b) / 2


def _stutzer(x: np.ndarray) -> float | None:
    if len(x) < 2:
        return None
    mean = x.mean()
    if abs(mean) < 1e-15:
        return 0.0

    def log_mean(t: float) -> float:
        e = t * x
        top = e.max()
        return top + math.log(np.exp(e - top).mean())

    t = minimum(log_mean, -50.0, -1e-10) if mean > 0 else minimum(log_mean, 1e-10, 50.0)
    return math.copysign(math.sqrt(2 * max(-log_mean(t), 0.0)), mean)


def whole_series(df: DataFrame, function: Callable[[np.ndarray], float | None], name: str) -> DataFrame:
    """One value per series by a numpy function of its valid returns in date order; for statistics without a
    distributed form. A task holds one series' values (8 bytes a row)."""
    kind = df.schema["sid"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("dt")["ret"].dropna().to_numpy(dtype=float)
        return pd.DataFrame({"sid": [pdf["sid"].iloc[0]], name: [function(x)]})

    return df.select("sid", "dt", "ret").groupBy("sid").applyInPandas(run, f"sid {kind}, {name} double")


def hurst_exponent(df: DataFrame) -> DataFrame:
    """sid, hurst_exponent: slope of log(R/S) over log(length) in blocks of growing length, between 0 and 1.

    A block's R is the range of its cumulated deviations from its mean, S its sample deviation; the R/S of a length is
    the mean over the blocks where both are positive. Lengths run from 2 to a third of the series (at least 3): all of
    them up to 31, else 30 in geometric steps. With fewer than two usable lengths the whole series gives
    0.5 + log(R/S) / log(2 n); null for fewer than 8 valid returns or without any spread. Every block is a group of its
    own, so no task holds a series; each row takes part once per length."""
    valid = M.numbered(df.where("ret IS NOT NULL").select("sid", "dt", "ret"))
    counts = valid.groupBy("sid").agg(F.count(F.lit(1)).alias("n")).where("n >= 8")
    top = F.greatest(F.floor(F.col("n") / 3), F.lit(3))
    # 30 geometric steps; up to 31 all lengths.
    step = lambda i: F.when(i == 29, top).otherwise(F.floor(2 * F.pow(top / 2, i / 29) + 1e-9))
    lengths = F.when(top <= 31, F.sequence(F.lit(2).cast("bigint"), top)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(29)), step)))
    # a block as long as the series serves the fallback
    plan = counts.withColumn("lag", F.explode(F.array_append(lengths, F.col("n"))))
    k = F.col("rn") - 1
    placed = valid.join(plan, "sid").withColumn("block", F.floor(k / F.col("lag"))).where((F.col("block") + 1) * F.col("lag") <= F.col("n"))
    group = Window.partitionBy("sid", "lag", "block")
    held = placed.withColumn("off", F.col("ret") - F.avg("ret").over(group))
    walk = held.withColumn("walk", F.sum("off").over(group.orderBy("rn").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    blocks = walk.groupBy("sid", "n", "lag", "block").agg((F.max("walk") - F.min("walk")).alias("r"), F.when(F.max("ret") > F.min("ret"), F.stddev_samp("ret")).otherwise(0.0).alias("s"))
    scale = blocks.where("r > 0 AND s > 0").groupBy("sid", "n", "lag").agg(F.avg(F.col("r") / F.col("s")).alias("rs"))
    inner = F.col("lag") < F.col("n")
    x, y = F.when(inner, F.ln("lag")), F.when(inner, F.ln("rs"))
    fit = scale.groupBy("sid", "n").agg(F.count(x).alias("lags"), F.regr_slope(y, x).alias("slope"), F.max(F.when(~inner, F.col("rs"))).alias("whole"))
    h = F.when(F.col("lags") >= 2, F.col("slope")).otherwise(0.5 + F.ln("whole") / F.ln(2.0 * F.col("n")))
    found = fit.where("whole IS NOT NULL").select("sid", F.least(F.greatest(h, F.lit(0.0)), F.lit(1.0)).alias("hurst_exponent"))
    return df.select("sid").distinct().join(found, "sid", "left")


def stutzer_index(df: DataFrame, target_return: float = 0.0) -> DataFrame:
    return whole_series(df, lambda x: _stutzer(x - target_return), "stutzer_index")
