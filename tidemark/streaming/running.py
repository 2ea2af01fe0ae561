"""Structured Streaming: profit by event-time window, and running growth, drawdown and open lots per key."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.round_trips import match_lots


def windowed_profit(fills: DataFrame, length: str = "1 hour", slide: str | None = None, lateness: str = "10 minutes") -> DataFrame:
    """symbol, start, end, value, fills: traded value per event-time window; rows later than ``lateness`` are dropped."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    by = fills.withWatermark("ts", lateness).groupBy("symbol", w.alias("w"))
    return by.agg(F.sum(F.col("amount") * F.col("price")).alias("value"), F.count(F.lit(1)).alias("fills")).select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "value", "fills")


def sessions(fills: DataFrame, gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """symbol, start, end, value: activity sessions parted by ``gap``."""
    by = fills.withWatermark("ts", lateness).groupBy("symbol", F.session_window("ts", gap).alias("w"))
    return by.agg(F.sum(F.col("amount") * F.col("price")).alias("value")).select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "value")


def _update_growth(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    nav, peak, low, n = state.get if state.exists else (1.0, 1.0, 0.0, 0)
    last = None
    for pdf in frames:
        for dt, r in pdf.sort_values("dt")[["dt", "ret"]].itertuples(index=False):
            nav *= 1 + (0.0 if r is None or r != r else r)
            peak = max(peak, nav)
            low = min(low, nav / peak - 1)
            n += 1
            last = dt
    state.update((nav, peak, low, n))
    yield pd.DataFrame({"sid": [str(key[0])], "dt": [last], "nav": [nav], "drawdown": [nav / peak - 1], "max_drawdown": [low], "rows": [n]})


def running_growth(returns: DataFrame) -> DataFrame:
    """sid, dt, nav, drawdown, max_drawdown, rows: one update per key and micro-batch.

    Returns must arrive in date order from batch to batch (within a batch they are sorted); a late row is compounded
    when it comes."""
    return returns.groupBy("sid").applyInPandasWithState(_update_growth, "sid string, dt date, nav double, drawdown double, max_drawdown double, rows long", "nav double, peak double, low double, n long", "update", GroupStateTimeout.NoTimeout)


def _update_lots(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    lots: deque = deque(zip(*state.get, strict=True)) if state.exists else deque()
    rows = pd.concat(list(frames)).sort_values("ts")
    trips, lots = match_lots(str(key[0]), [t.value // 1000 for t in rows["ts"]], list(rows["amount"]), list(rows["price"]), lots)
    state.update(tuple(list(map(list, zip(*lots, strict=True))) if lots else [[], [], [], []]))
    out = pd.DataFrame(trips, columns=["symbol", "open_dt", "close_dt", "long", "pnl", "rt_returns"])
    for c in ("open_dt", "close_dt"):
        out[c] = pd.to_datetime(out[c], unit="us")
    yield out


def running_round_trips(fills: DataFrame) -> DataFrame:
    """Round trips as they close; open lots are the state. Fills must arrive in time order from batch to batch."""
    return fills.groupBy("symbol").applyInPandasWithState(
        _update_lots, "symbol string, open_dt timestamp, close_dt timestamp, long boolean, pnl double, rt_returns double", "side array<int>, price array<double>, held array<double>, at array<long>", "append", GroupStateTimeout.NoTimeout
    )
