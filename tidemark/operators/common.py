"""Small steps around the operators: intraday positions, clipping to a benchmark, comparing tables, display."""

from __future__ import annotations

import html
import time
import warnings
from collections.abc import Callable, Iterable
from datetime import UTC, date, datetime, timedelta
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import book


def check_intraday(estimate: bool | str, positions: DataFrame | None, transactions: DataFrame | None) -> DataFrame | None:
    """The positions to go on with: estimated from the fills if ``estimate`` is true, or is "infer" and the strategy looks
    intraday; otherwise as they are. True without positions and fills raises ValueError."""
    if positions is None or transactions is None:
        if estimate is True:
            raise ValueError("estimating intraday positions takes positions and transactions")
        return positions
    if estimate == "infer":
        if not book.detect_intraday(positions, transactions).first()["intraday"]:
            return positions
        warnings.warn("the strategy looks intraday: positions are estimated from transactions", stacklevel=2)
    elif not estimate:
        return positions
    return book.estimate_intraday(positions, transactions)


def clip_returns_to_benchmark(returns: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Each series cut to the benchmark's days, if it begins before the benchmark or ends after it; else as it is."""
    span = benchmark.agg(F.min("dt").alias("__a"), F.max("dt").alias("__b"))
    own = returns.groupBy("sid").agg(F.min("dt").alias("__first"), F.max("dt").alias("__last"))
    # one row of two dates
    outside = own.join(F.broadcast(span)).select("sid", ((F.col("__first") < F.col("__a")) | (F.col("__last") > F.col("__b"))).alias("__outside"))
    days = benchmark.select("dt").distinct().withColumn("__held", F.lit(True))
    joined = returns.join(outside, "sid").join(days, "dt", "left")
    return joined.where("NOT __outside OR __held").select(*returns.columns)


def standardize_data(df: DataFrame, column: str = "ret", keys: list[str] | None = None, out: str = "standardized") -> DataFrame:
    """Adds ``out``: distance from the series' mean in population standard deviations; null for a constant series."""
    keys = keys or ["sid"]
    moments = df.groupBy(*keys).agg(F.avg(column).alias("__m"), F.stddev_pop(column).alias("__s"))
    return df.join(moments, keys).withColumn(out, F.try_divide(F.col(column) - F.col("__m"), F.col("__s"))).drop("__m", "__s")


def previous_business_day(day: Column) -> Column:
    """The weekday before ``day`` (holidays count as weekdays)."""
    return F.date_sub(day, F.when(F.weekday(day) == 0, 3).when(F.weekday(day) == 6, 2).otherwise(1))


def one_business_day_ago(today: date | None = None) -> date:
    d = (today or datetime.now(UTC).date()) - timedelta(days=1)
    return d - timedelta(days=max(d.weekday() - 4, 0))


def table_differences(a: DataFrame, b: DataFrame, keys: Iterable[str]) -> dict[str, Any]:
    """How two tables differ: columns only in one, types, and ``rows``, a frame (keys, column, left, right) of the cells that
    differ and of rows missing on one side; values are compared as text, nulls equal nulls."""
    keys = list(keys)
    left, right = dict(a.dtypes), dict(b.dtypes)
    shared = [c for c in left if c in right and c not in keys]
    pick = lambda df, name: df.select(*keys, F.struct(*(F.col(c).cast("string").alias(c) for c in shared)).alias(name))
    j = pick(a, "l").join(pick(b, "r"), keys, "full_outer")
    cell = lambda c: F.struct(F.lit(c).alias("column"), F.col(f"l.`{c}`").alias("left"), F.col(f"r.`{c}`").alias("right"), (~F.col(f"l.`{c}`").eqNullSafe(F.col(f"r.`{c}`"))).alias("differs"))
    whole = F.struct(F.lit(None).cast("string").alias("column"), F.col("l").cast("string").alias("left"), F.col("r").cast("string").alias("right"), (F.col("l").isNull() | F.col("r").isNull()).alias("differs"))
    both = F.col("l").isNotNull() & F.col("r").isNotNull()
    cells = F.when(both, F.array(*map(cell, shared))).otherwise(F.array(whole)) if shared else F.array(whole)
    rows = j.select(*keys, F.explode(cells).alias("c")).where("c.differs").select(*keys, "c.column", "c.left", "c.right")
    return {
        "only_left": sorted(left.keys() - right.keys()),
        "only_right": sorted(right.keys() - left.keys()),
        "types": {c: (left[c], right[c]) for c in left if c in right and left[c] != right[c]},
        "rows": rows,
    }


def first_column(df: DataFrame) -> DataFrame:
    return df.select(df.columns[0])


def from_backtest(backtest: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(returns, positions, transactions) of a backtest's daily table: dt, returns, ending_cash, positions (array of structs
    with sid, amount, last_sale_price) and transactions (array of structs with sid, amount, price, dt)."""
    day = F.col("dt").cast("date").alias("dt")
    returns = backtest.select(F.lit(0).alias("sid"), day, F.col("returns").alias("ret"))
    held = backtest.select(day, F.explode("positions").alias("p")).select("dt", "p.sid", "p.amount", "p.last_sale_price")
    fills = backtest.select(F.explode("transactions").alias("t")).select(F.col("t.dt").alias("ts"), F.col("t.sid").alias("symbol"), "t.amount", "t.price")
    return returns, book.extract_positions(held, backtest.select(day, F.col("ending_cash").alias("cash"))), fills


def style_label(x: float, digits: int = 1, percent: bool = False) -> str:
    """Axis label: a number with ``digits`` decimals, or a whole per cent."""
    return f"{x:.0f}%" if percent else f"{x:.{digits}f}"


def one_dec_places(x: float, _pos: object = None) -> str:
    return style_label(x, 1)


def two_dec_places(x: float, _pos: object = None) -> str:
    return style_label(x, 2)


def percentage(x: float, _pos: object = None) -> str:
    return style_label(x, percent=True)


def format_asset(asset: Any) -> Any:
    """An asset object's ticker, anything else as it is."""
    return getattr(asset, "symbol", asset)


def sample_colormap(low: tuple[float, float, float], high: tuple[float, float, float], n: int) -> list[tuple[float, ...]]:
    """``n`` colours in even steps between two RGB colours."""
    return [tuple(a + (b - a) * (i / max(n - 1, 1)) for a, b in zip(low, high, strict=True)) for i in range(n)]


def table_text(df: DataFrame, name: str = "", header: dict[str, Any] | None = None, fmt: Callable[[Any], str] = str, as_html: bool = False, most_rows: int = 1000) -> str:
    """A small table as aligned text or HTML with optional lines above it; a longer one says how many rows it shows."""
    rows = [[fmt(v) for v in r] for r in df.limit(most_rows + 1).collect()]
    more = len(rows) > most_rows
    rows, head = rows[:most_rows], df.columns
    extra = list((header or {}).items()) + ([("rows shown", f"the first {most_rows}")] if more else [])
    if as_html:
        top = "".join(f"<tr><th>{html.escape(str(k))}</th><td colspan={len(head)}>{html.escape(str(v))}</td></tr>" for k, v in extra)
        line = lambda tag, cells: "<tr>" + "".join(f"<{tag}>{html.escape(c)}</{tag}>" for c in cells) + "</tr>"
        return f"<table><caption>{html.escape(name)}</caption><thead>{top}{line('th', head)}</thead><tbody>{''.join(line('td', r) for r in rows)}</tbody></table>"
    width = [max(map(len, col)) for col in zip(head, *rows, strict=True)]
    body = ["  ".join(c.rjust(w) for c, w in zip(r, width, strict=True)) for r in (head, *rows)]
    return "\n".join([*([name] if name else []), *(f"{k}: {v}" for k, v in extra), *body])


def print_table(df: DataFrame, name: str = "", **options: Any) -> None:
    print(table_text(df, name, **options))


def timer(what: str, since: float) -> float:
    """Prints the seconds since ``since`` and returns the time now."""
    now = time.time()
    print(f"{what}: {now - since:.2f} s")
    return now


def trading_span_days(trips: DataFrame) -> DataFrame:
    """Calendar days from the first opening to the last closing of all round trips."""
    return trips.agg(((F.unix_micros(F.max("close_dt")) - F.unix_micros(F.min("open_dt"))) / 86_400_000_000).alias("days"))


def strikes(path: DataFrame, lower: DataFrame, most: int = 3) -> DataFrame:
    """step, value, low: rows of ``path`` (step, value) that lie below ``lower`` (step, low); the first ``most`` are where a
    forecast cone is started anew."""
    below = path.join(lower, "step").where("value < low").select("step", "value", "low")
    return below.withColumn("k", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("step"))).where(F.col("k") <= most).drop("k")
