"""Stat packs, period tables and the HTML report."""

from __future__ import annotations

import html
import json
import math
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics as M
from . import book, series

HEADLINE = ["annual_return", "cum_returns_final", "annual_volatility", "sharpe_ratio", "calmar_ratio", "stability_of_timeseries", "max_drawdown", "omega_ratio", "sortino_ratio", "skewness", "kurtosis", "tail_ratio", "value_at_risk"]
AGAINST = ["alpha", "beta", "information_ratio", "tracking_error", "up_capture", "down_capture", "capm_r_squared", "m_squared"]
EXTENDED = ["win_rate", "loss_rate", "max_single_day_gain", "max_single_day_loss", "downside_risk", "conditional_value_at_risk", "adjusted_sharpe_ratio", "conditional_sharpe_ratio", "sterling_ratio", "burke_ratio", "kappa_three_ratio", "common_sense_ratio", "mar_ratio", "serial_correlation", "trading_value_at_risk", "var_excess_return"]
# Trailing periods in rows.
PERIOD_ROWS = {"1W": 5, "1M": 21, "3M": 63, "6M": 126, "1Y": 252, "3Y": 756, "5Y": 1260}
# Labels by Sharpe ratio (above the limit) and by the size of the drawdown (below the limit).
SHARPE_LABELS = ((1.5, "excellent"), (1.0, "good"), (0.5, "fair"))
DRAWDOWN_LABELS = ((0.1, "excellent"), (0.2, "good"), (0.3, "fair"))


def perf_stats(df: DataFrame, positions: DataFrame | None = None, transactions: DataFrame | None = None, **params: object) -> DataFrame:
    """sid, stat, value: the headline statistics, alpha and beta with a benchmark, leverage and turnover with a book."""
    names = HEADLINE + (["alpha", "beta"] if "f" in df.columns else [])
    wide = M.compute(df, names, **params)
    if positions is not None:
        # one row
        lev = book.exposures(positions).agg(F.avg("gross_leverage").alias("gross_leverage"))
        wide, names = wide.join(F.broadcast(lev)), [*names, "gross_leverage"]
        if transactions is not None:
            turn = book.turnover(positions, transactions).agg(F.avg("turnover").alias("daily_turnover"))
            wide, names = wide.join(F.broadcast(turn)), [*names, "daily_turnover"]
    return wide.select("sid", *(F.col(n).cast("double").alias(n) for n in names)).unpivot("sid", names, "stat", "value")


def extended_stats(df: DataFrame) -> DataFrame:
    """sid, stat, value: sixteen further statistics."""
    return M.compute(df, EXTENDED).select("sid", *(F.col(n).cast("double").alias(n) for n in EXTENDED)).unpivot("sid", EXTENDED, "stat", "value")


def period_returns(df: DataFrame) -> DataFrame:
    """sid, period, ret, win_rate: trailing row counts (only complete ones), the last calendar year to date, and inception."""
    back = F.row_number().over(Window.partitionBy("sid").orderBy(F.desc("dt")))
    last = F.max("dt").over(Window.partitionBy("sid"))
    rows = df.withColumn("k", back).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("sid"))).withColumn("last", last)
    hit = [F.when((F.col("k") <= r) & (F.col("n") >= r), F.lit(p)) for p, r in PERIOD_ROWS.items()]
    hit += [F.when(F.year("dt") == F.year("last"), F.lit("YTD")), F.lit("inception")]
    long = rows.select("sid", "ret", F.explode(F.array(*hit)).alias("period")).where("period IS NOT NULL")
    return long.groupBy("sid", "period").agg((M.growth() - 1).alias("ret"), M.win_rate().alias("win_rate"))


def monthly_table(df: DataFrame) -> DataFrame:
    """sid, year and one column per month."""
    m = series.aggregate_returns(df, "monthly")
    return m.groupBy("sid", "year").pivot("part", list(range(1, 13))).agg(F.first("ret"))


def return_quantiles(df: DataFrame) -> DataFrame:
    """sid, level (daily, weekly, monthly), min, p25, median, p75, max."""
    parts = [df.select("sid", F.lit("daily").alias("level"), "ret")]
    parts += [series.aggregate_returns(df, level).select("sid", F.lit(level).alias("level"), "ret") for level in ("weekly", "monthly")]
    long = parts[0].unionByName(parts[1]).unionByName(parts[2])
    q = lambda p: F.percentile("ret", F.lit(p))
    return long.groupBy("sid", "level").agg(F.min("ret").alias("min"), q(0.25).alias("p25"), q(0.5).alias("median"), q(0.75).alias("p75"), F.max("ret").alias("max"))


def histogram(df: DataFrame, column: str = "ret", bins: int = 30) -> DataFrame:
    """sid, bin, low, n: equal-width bins between each series' extremes."""
    span = df.groupBy("sid").agg(F.min(column).alias("a"), F.max(column).alias("b"))
    width = (F.col("b") - F.col("a")) / bins
    k = F.least(F.coalesce(F.floor(F.try_divide(F.col(column) - F.col("a"), width)), F.lit(0)), F.lit(bins - 1)).cast("int")
    return df.where(F.col(column).isNotNull()).join(span, "sid").groupBy("sid", k.alias("bin")).agg(F.min(F.col("a") + k * width).alias("low"), F.count(F.lit(1)).alias("n"))


def trade_stats(trades: DataFrame) -> DataFrame:
    """One row over closed trades (pnlcomm, optional commission, long, barlen)."""
    p = F.col("pnlcomm")
    win, lose = F.when(p > 0, p), F.when(p < 0, p)
    has = lambda c: c in trades.columns
    aggs = [
        F.count(p).alias("trades"), F.count(win).alias("won"), F.count(lose).alias("lost"), F.try_divide(F.count(win), F.count(p)).alias("win_rate"), F.sum(p).alias("total"), F.avg(p).alias("average"),
        F.avg(win).alias("average_win"), F.avg(lose).alias("average_loss"), F.max(p).alias("best"), F.min(p).alias("worst"), F.try_divide(F.sum(win), -F.sum(lose)).alias("profit_factor"),
        F.try_divide(F.avg(win), -F.avg(lose)).alias("payoff"),
    ]
    if has("commission"):
        aggs.append(F.sum("commission").alias("commission"))
    if has("long"):
        for name, cond in (("long", F.col("long")), ("short", ~F.col("long"))):
            aggs += [F.count(F.when(cond, p)).alias(f"{name}_trades"), F.try_divide(F.count(F.when(cond, win)), F.count(F.when(cond, p))).alias(f"{name}_win_rate"), F.sum(F.when(cond, p)).alias(f"{name}_total")]
    if has("barlen"):
        aggs += [F.avg("barlen").alias("average_bars"), F.max("barlen").alias("longest_bars")]
    return trades.agg(*aggs)


def performance_label(sharpe: float | None) -> str:
    return "N/A" if sharpe is None or sharpe != sharpe else next((name for limit, name in SHARPE_LABELS if sharpe > limit), "poor")


def risk_label(drawdown: float | None) -> str:
    return "N/A" if drawdown is None or drawdown != drawdown else next((name for limit, name in DRAWDOWN_LABELS if abs(drawdown) < limit), "poor")


def fmt(value: object, pct: bool = False) -> str:
    if value is None or (isinstance(value, float) and not math.isfinite(value)):
        return "N/A"
    if isinstance(value, float):
        return f"{value:.2%}" if pct else f"{value:.4f}"
    return str(value)


def sign_class(value: object) -> str:
    """Style class of a cell: ``neg`` below zero, ``pos`` above, none otherwise."""
    if not isinstance(value, int | float) or isinstance(value, bool) or not math.isfinite(value) or value == 0:
        return ""
    return " class='neg'" if value < 0 else " class='pos'"


def plain_values(values: list, decimals: int = 6, percent: bool = False) -> list:
    """Values as JSON has them: numbers rounded (times 100 as per cent), what is not finite null, dates as ISO text."""
    out = []
    for v in values:
        if isinstance(v, float):
            out.append(round(v * (100 if percent else 1), decimals) if math.isfinite(v) else None)
        else:
            out.append(v.isoformat() if hasattr(v, "isoformat") else v)
    return out


def html_table(rows: list[dict], caption: str) -> str:
    if not rows:
        return ""
    head = "".join(f"<th>{html.escape(str(c))}</th>" for c in rows[0])
    body = "".join("<tr>" + "".join(f"<td{sign_class(v)}>{html.escape(fmt(v))}</td>" for v in r.values()) + "</tr>" for r in rows)
    return f"<section><h2>{html.escape(caption)}</h2><table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table></section>"


def sections(df: DataFrame, sid: object, positions: DataFrame | None = None, transactions: DataFrame | None = None, trades: DataFrame | None = None, rolling_window: int = 63) -> dict[str, DataFrame]:
    """The report's tables for one series, as frames."""
    one = df.where(F.col("sid") == F.lit(sid))
    out = {
        "Performance": perf_stats(one, positions, transactions),
        "Further statistics": extended_stats(one),
        "Periods": period_returns(one),
        "Years": series.aggregate_returns(one, "yearly"),
        "Months": monthly_table(one),
        "Quantiles": return_quantiles(one),
        "Drawdowns": series.top_drawdowns(one, 5),
        "Growth": series.cum_returns(one, 1.0).select("dt", "cum", "dd"),
        "Rolling": series.rolling(one, ["sharpe", "volatility"], rolling_window),
    }
    if "f" in df.columns:
        out["Benchmark"] = M.compute(one, AGAINST)
        out["Rolling beta"] = series.rolling(one, "beta", rolling_window)
    if positions is not None:
        out["Exposures"] = book.exposures(positions)
        out["Concentration"] = book.concentration(positions)
    if transactions is not None:
        out["Transactions"] = book.txn_volume(transactions)
        out["Hours"] = book.transaction_hours(transactions)
    if trades is not None:
        out["Trades"] = trade_stats(trades)
    return out


def in_order(frame: DataFrame) -> DataFrame:
    """``frame`` by date, where it has one, then by its other columns; the other tables have a few rows."""
    if "dt" not in frame.columns:
        return frame
    return frame.orderBy("dt", *(c for c, t in frame.dtypes if c != "dt" and "map<" not in t))


def write_json(found: dict[str, DataFrame], title: str, output: str) -> None:
    """Every row of every table, written as it arrives."""
    with Path(output).open("w") as f:
        f.write(f'{{"title": {json.dumps(title)}, "sections": {{')
        for k, (name, frame) in enumerate(found.items()):
            f.write(f"{', ' if k else ''}{json.dumps(name)}: [")
            for i, r in enumerate(in_order(frame).toLocalIterator()):
                f.write((", " if i else "") + json.dumps(r.asDict(), default=str))
            f.write("]")
        f.write("}}")


def first_rows(frame: DataFrame, most_rows: int, whole: Path) -> tuple[list[dict], int]:
    """The first rows in order and how many there are; more than ``most_rows`` are all written to ``whole``, one JSON object a line."""
    rows, n, f = [], 0, None
    try:
        for r in in_order(frame).toLocalIterator():
            n += 1
            if n <= most_rows:
                rows.append(r.asDict())
                continue
            if f is None:
                f = whole.open("w")
                f.writelines(json.dumps(x, default=str) + "\n" for x in rows)
            f.write(json.dumps(r.asDict(), default=str) + "\n")
    finally:
        if f is not None:
            f.close()
    return rows, n


def strategy_report(df: DataFrame, sid: object, output: str, title: str = "Strategy report", most_rows: int = 5000, **parts: object) -> str:
    """Writes a self-contained HTML page (or JSON or PDF, by the path's ending) for one series and returns the path. JSON has
    every row; a PDF is the page printed by a headless browser. Tables by date are drawn as well. The page shows a table's first ``most_rows`` rows by date; of a longer one it gives the number of rows and the
    file beside the page that has them all."""
    found = sections(df, sid, **parts)
    if output.endswith(".json"):
        write_json(found, title, output)
        return output
    if not output.endswith((".html", ".pdf")):
        raise ValueError("output must end with .html, .json or .pdf")
    from ..viz import Chart, print_pdf, svg  # charts draw on this module's tables

    shown, body = {}, ""
    for name, frame in found.items():
        if "dt" in frame.columns and (numbers := [c for c, t in frame.dtypes if t == "double"]):
            body += svg(Chart(name, frame, y=tuple(numbers)))
        whole = Path(output).with_suffix(f".{name.lower().replace(' ', '_')}.jsonl")
        shown[name], n = first_rows(frame, most_rows, whole)
        body += html_table(shown[name], name + (f" (first {most_rows} of {n} rows; all in {whole.name})" if n > most_rows else ""))
    stats = {r["stat"]: r["value"] for r in shown["Performance"]}
    summary = f"Risk-adjusted performance is {performance_label(stats.get('sharpe_ratio'))}; risk control is {risk_label(stats.get('max_drawdown'))}."
    page = (f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title><style>body{{font:14px sans-serif}}td,th{{padding:2px 8px;text-align:right}}.neg{{color:#b00}}</style></head><body><h1>{html.escape(title)}</h1><p>{html.escape(summary)}</p>{body}</body></html>")
    if output.endswith(".pdf"):
        print_pdf(page, output)
    else:
        Path(output).write_text(page)
    return output
