"""Charts as data with a way to draw them: SVG by itself; Matplotlib, Plotly and Bokeh where they are installed."""

from __future__ import annotations

import html
import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .errors import check_dependencies
from .operators import report
from .registry import register_viz_backend

KINDS = ("line", "area", "bar", "heat", "points", "table")
# One colour for each line of a chart, repeated.
COLORS = ("#1f5aa6", "#c8553d", "#3a7d44", "#8a5fa8", "#b8860b", "#4c6b73")


@dataclass
class Chart:
    """``data`` with what to draw: ``y`` over ``x``, a line for each value of ``group`` if there is one. ``notes`` are marks
    (label, value) drawn as level lines. A table or heat map shows all its columns."""

    title: str
    data: DataFrame
    kind: str = "line"
    x: str = "dt"
    y: tuple[str, ...] = ()
    group: str | None = None
    notes: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"kind must be one of {KINDS}")
        self.y = tuple(self.y) or tuple(c for c, t in self.data.dtypes if c not in (self.x, self.group) and t in ("double", "float", "int", "bigint"))

    def points(self, most: int = 1500) -> pd.DataFrame:
        """What is drawn. Of a line longer than ``most`` points neighbouring ones are averaged, in Spark; ``data`` keeps every
        row. Tables show their first ``most`` rows."""
        if self.kind in ("table", "heat", "bar"):
            keys = [c for c, t in self.data.dtypes if t in ("date", "int", "bigint", "string", "timestamp")]
            return self.data.orderBy(*keys).limit(most).toPandas() if keys else self.data.limit(most).toPandas()
        keys = [self.group] if self.group else []
        rows = self.data.select(*keys, self.x, *self.y)
        n = rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
        if n > most:
            kind = rows.schema[self.x].dataType.typeName()
            place = F.unix_date(self.x) if kind == "date" else F.unix_micros(F.col(self.x).cast("timestamp")) if kind.startswith("timestamp") else F.col(self.x).cast("double")
            span = rows.agg(F.min(place).alias("__a"), F.max(place).alias("__b"))  # one row
            bucket = F.floor((place - F.col("__a")) * most / (F.col("__b") - F.col("__a") + 1e-9))
            rows = rows.join(F.broadcast(span)).groupBy(*keys, bucket.alias("__k")).agg(F.min(self.x).alias(self.x), *(F.avg(c).alias(c) for c in self.y)).drop("__k")
        return rows.orderBy(*keys, self.x).toPandas()

    def lines(self, pdf: pd.DataFrame) -> Iterator[tuple[str, pd.Series, pd.Series]]:
        """(name, x, y) of every line."""
        parts = pdf.groupby(self.group, sort=True) if self.group else [(None, pdf)]
        for name, part in parts:
            for c in self.y:
                label = c if name is None else str(name) if len(self.y) == 1 else f"{name} {c}"
                yield label, part[self.x], part[c]


def _number(v: Any) -> float:
    if v is None or v is pd.NaT:
        return math.nan
    return float(pd.Timestamp(v).value) if not isinstance(v, int | float) else float(v)


def svg(chart: Chart, width: int = 760, height: int = 260) -> str:
    """The chart as an SVG element; a table or heat map as an HTML table."""
    pdf = chart.points()
    title = html.escape(chart.title)
    if chart.kind in ("table", "heat") or pdf.empty or not chart.y:
        return report.html_table(pdf.to_dict("records"), chart.title) or f"<section><h2>{title}</h2><p>no rows</p></section>"
    named = [(name, [_number(v) if chart.kind != "bar" else float(i) for i, v in enumerate(x)], [_number(v) for v in y]) for name, x, y in chart.lines(pdf)]
    xs = [v for _, x, _ in named for v in x if math.isfinite(v)] or [0.0]
    ys = [v for _, _, y in named for v in y if math.isfinite(v)] + [*chart.notes.values()] + ([0.0] if chart.kind in ("bar", "area") else []) or [0.0]
    (x0, x1), (y0, y1) = (min(xs), max(xs)), (min(ys), max(ys))
    left, top, w, h = 70, 10, width - 90, height - 50
    px = lambda v: left + w * (v - x0) / ((x1 - x0) or 1.0)
    py = lambda v: top + h * (1 - (v - y0) / ((y1 - y0) or 1.0))
    parts = []
    for k, (name, x, y) in enumerate(named):
        color = COLORS[k % len(COLORS)]
        kept = [(px(a), py(b)) for a, b in zip(x, y, strict=True) if math.isfinite(a) and math.isfinite(b)]
        path = " ".join(f"{a:.1f},{b:.1f}" for a, b in kept)
        if chart.kind == "bar":
            wide = max(w / max(len(x), 1) / len(named) * 0.8, 1.0)
            parts += [f'<rect x="{a - wide / 2 + k * wide:.1f}" y="{min(b, py(0.0)):.1f}" width="{wide:.1f}" height="{abs(b - py(0.0)):.1f}" fill="{color}"/>' for a, b in kept]
        elif chart.kind == "points":
            parts += [f'<circle cx="{a:.1f}" cy="{b:.1f}" r="2.5" fill="{color}"/>' for a, b in kept]
        elif chart.kind == "area" and kept:
            parts.append(f'<polygon points="{kept[0][0]:.1f},{py(0.0):.1f} {path} {kept[-1][0]:.1f},{py(0.0):.1f}" fill="{color}" fill-opacity="0.4"/>')
        else:
            parts.append(f'<polyline points="{path}" fill="none" stroke="{color}" stroke-width="1.5"/>')
        parts.append(f'<text x="{left + 8 + 150 * k}" y="{height - 6}" fill="{color}" font-size="12">{html.escape(name)}</text>')
    for name, v in chart.notes.items():
        parts.append(f'<line x1="{left}" x2="{left + w}" y1="{py(v):.1f}" y2="{py(v):.1f}" stroke="#888" stroke-dasharray="4"/><text x="{left + w - 90}" y="{py(v) - 3:.1f}" font-size="11">{html.escape(name)}</text>')
    parts += [f'<text x="4" y="{py(v) + 4:.1f}" font-size="11">{v:.4g}</text>' for v in (y0, y1)]
    ends = (pdf[chart.x].iloc[0], pdf[chart.x].iloc[-1]) if chart.group is None else (pdf[chart.x].min(), pdf[chart.x].max())
    parts += [f'<text x="{at}" y="{height - 24}" font-size="11" text-anchor="{anchor}">{html.escape(str(v))}</text>' for at, anchor, v in ((left, "start", ends[0]), (left + w, "end", ends[1]))]
    frame = f'<rect x="{left}" y="{top}" width="{w}" height="{h}" fill="none" stroke="#ccc"/>'
    return f'<section><h2>{title}</h2><svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}">{frame}{"".join(parts)}</svg></section>'


class Backend:
    """The common charts; a backend says how one is drawn. ``returns`` are long returns of one series (dt, ret[, f])."""

    packages: tuple[str, ...] = ()

    def __init__(self, theme: str = "light", height: int = 500, width: int = 800, **options: Any) -> None:
        check_dependencies(*self.packages)
        self.theme, self.height, self.width, self.options = theme, height, width, options
        self.figure: Any = None

    def draw(self, chart: Chart) -> Any:
        raise NotImplementedError

    def plot_returns(self, cum_returns: DataFrame, benchmark: DataFrame | None = None, title: str = "Cumulative returns") -> Any:
        """``cum_returns``: dt, cum; ``benchmark`` likewise."""
        both = cum_returns.select("dt", F.lit("strategy").alias("line"), "cum")
        if benchmark is not None:
            both = both.unionByName(benchmark.select("dt", F.lit("benchmark").alias("line"), "cum"))
        return self.draw(Chart(title, both, y=("cum",), group="line"))

    def plot_drawdown(self, drawdown: DataFrame, title: str = "Drawdown") -> Any:
        return self.draw(Chart(title, drawdown.select("dt", "dd"), "area", y=("dd",)))

    def plot_rolling_sharpe(self, sharpe: DataFrame, benchmark_sharpe: DataFrame | None = None, window: int = 252, title: str | None = None) -> Any:
        both = sharpe.select("dt", F.lit("strategy").alias("line"), "sharpe")
        if benchmark_sharpe is not None:
            both = both.unionByName(benchmark_sharpe.select("dt", F.lit("benchmark").alias("line"), "sharpe"))
        return self.draw(Chart(title or f"Rolling Sharpe ratio ({window} rows)", both, y=("sharpe",), group="line"))

    def plot_monthly_heatmap(self, returns: DataFrame, title: str = "Monthly returns") -> Any:
        return self.draw(Chart(title, report.monthly_table(returns).drop("sid"), "heat", x="year"))

    def plot_efficient_frontier(self, frontier: DataFrame, title: str = "Efficient frontier") -> Any:
        """``frontier``: volatility and ret of portfolios."""
        return self.draw(Chart(title, frontier, "points", x="volatility", y=("ret",)))

    def plot_correlation_matrix(self, returns: DataFrame, title: str = "Correlations") -> Any:
        """Correlations of all series (sid, dt, ret) with each other."""
        return self.draw(Chart(title, correlations(returns), "heat", x="a"))


def correlations(returns: DataFrame) -> DataFrame:
    """a, b, correlation of every pair of series over the days both have; a pair without spread has null. One row per pair
    is the result itself; the join is by day."""
    held = returns.where("ret IS NOT NULL AND NOT isnan(ret)")
    both = held.select("dt", F.col("sid").alias("a"), F.col("ret").alias("x")).join(held.select("dt", F.col("sid").alias("b"), F.col("ret").alias("y")), "dt")
    return both.groupBy("a", "b").agg(F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y")).alias("correlation"))


@register_viz_backend("table", built_in=True)
class TableBackend(Backend):
    """What would be drawn, as pandas tables."""

    def draw(self, chart: Chart) -> pd.DataFrame:
        self.figure = chart.points()
        return self.figure


@register_viz_backend("svg", built_in=True)
class SvgBackend(Backend):
    """Drawings as SVG text, without any package."""

    def draw(self, chart: Chart) -> str:
        self.figure = svg(chart, self.width, max(self.height // 2, 160))
        return self.figure

    def save_html(self, path: str) -> None:
        Path(path).write_text(f"<!doctype html><meta charset='utf-8'>{self.figure}")


class HtmlReportBuilder(SvgBackend):
    """A page put together section by section; every method but ``build`` and ``save`` returns the builder."""

    def __init__(self, **options: Any) -> None:
        super().__init__(**options)
        self.sections: list[str] = []
        self.title = "Performance report"

    def add_title(self, title: str = "Performance report") -> HtmlReportBuilder:
        self.title = title
        return self.add_heading(title, 1)

    def add_heading(self, text: str, level: int = 2) -> HtmlReportBuilder:
        level = min(max(level, 1), 6)
        return self.add_html(f"<h{level}>{html.escape(text)}</h{level}>")

    def add_stats_table(self, stats: DataFrame | dict[str, Any]) -> HtmlReportBuilder:
        """``stats``: stat, value."""
        rows = [{"stat": k, "value": v} for k, v in stats.items()] if isinstance(stats, dict) else [r.asDict() for r in stats.select("stat", "value").collect()]
        return self.add_html(report.html_table(rows, "Statistics"))

    def add_metric_cards(self, stats: dict[str, Any], keys: list[str] | None = None) -> HtmlReportBuilder:
        cards = "".join(f"<div class='card'><b>{html.escape(report.fmt(stats[k]))}</b><br>{html.escape(k)}</div>" for k in keys or stats if k in stats)
        return self.add_html(f"<div class='cards'>{cards}</div>")

    def add_html(self, raw: str) -> HtmlReportBuilder:
        self.sections.append(raw)
        return self

    def draw(self, chart: Chart) -> HtmlReportBuilder:
        return self.add_html(super().draw(chart))

    def build(self) -> str:
        style = "body{font:14px sans-serif}td,th{padding:2px 8px;text-align:right}.cards{display:flex;gap:12px}.card{border:1px solid #ccc;padding:8px}"
        menu = "".join(f"<li>{html.escape(s[s.index('<h2>') + 4 : s.index('</h2>')])}</li>" if "<h2>" in s else "" for s in self.sections)
        return f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(self.title)}</title><style>{style}</style></head><body><nav><ul>{menu}</ul></nav>{''.join(self.sections)}</body></html>"

    def save(self, path: str) -> str:
        Path(path).write_text(self.build())
        return path

    save_html = save


register_viz_backend("html", built_in=True)(HtmlReportBuilder)


@register_viz_backend("plotly", built_in=True)
class PlotlyBackend(Backend):
    """Figures in Plotly's JSON form; without the package they can still be made and stored, only not shown or printed."""

    def draw(self, chart: Chart) -> dict:
        pdf = chart.points()
        kind = {"line": "scatter", "area": "scatter", "points": "scatter", "bar": "bar"}.get(chart.kind)
        if kind is None:
            columns = [c for c in pdf.columns if c != chart.x]
            data = [{"type": "heatmap", "x": columns, "y": [str(v) for v in pdf[chart.x]], "z": pdf[columns].to_numpy().tolist()}] if chart.kind == "heat" and columns else [{"type": "table", "header": {"values": list(pdf.columns)}, "cells": {"values": [pdf[c].astype(str).tolist() for c in pdf.columns]}}]
        else:
            mode = {"points": "markers"}.get(chart.kind, "lines")
            data = [{"type": kind, "name": n, "x": [str(v) for v in x] if chart.kind != "points" else x.tolist(), "y": y.tolist()} | ({"mode": mode} if kind == "scatter" else {}) | ({"fill": "tozeroy"} if chart.kind == "area" else {}) for n, x, y in chart.lines(pdf)]
        dark = self.theme == "dark"
        template = self.options.get("template") or ("plotly_dark" if dark else "plotly_white")
        self.figure = {"data": data, "layout": {"title": {"text": chart.title}, "height": self.height, "width": self.width, "template": template, "showlegend": self.options.get("show_legend", True)}}
        return self.figure

    def _built(self) -> Any:
        check_dependencies("plotly")
        import plotly.graph_objects as go

        return go.Figure(self.figure)

    def show(self) -> None:
        self._built().show()

    def save_html(self, path: str) -> None:
        self._built().write_html(path)

    def save_image(self, path: str, **options: Any) -> None:
        self._built().write_image(path, **options)


@register_viz_backend("matplotlib", built_in=True)
class MatplotlibBackend(Backend):
    packages = ("matplotlib",)

    def draw(self, chart: Chart, ax: Any = None) -> Any:
        import matplotlib.pyplot as plt

        ax = ax or plt.subplots(figsize=(self.width / 100, self.height / 100))[1]
        pdf = chart.points()
        if chart.kind == "heat":
            ax.imshow(pdf.drop(columns=[chart.x]).select_dtypes("number").to_numpy(dtype=float), aspect="auto")
        for name, x, y in chart.lines(pdf) if chart.kind not in ("heat", "table") else ():
            {"bar": ax.bar, "points": ax.scatter, "area": ax.fill_between}.get(chart.kind, ax.plot)(x, y, label=name)
        for name, v in chart.notes.items():
            ax.axhline(v, linestyle="--", label=name)
        ax.set_title(chart.title)
        self.figure = ax
        return ax


@register_viz_backend("bokeh", built_in=True)
class BokehBackend(Backend):
    packages = ("bokeh",)

    def draw(self, chart: Chart) -> Any:
        from bokeh.plotting import figure

        fig = figure(title=chart.title, width=self.width, height=self.height, sizing_mode=self.options.get("sizing_mode", "fixed"))
        for k, (name, x, y) in enumerate(chart.lines(chart.points())):
            {"bar": lambda a, b, **p: fig.vbar(x=a, top=b, width=0.8, **p), "points": fig.scatter, "area": lambda a, b, **p: fig.varea(x=a, y1=0, y2=b, **p)}.get(chart.kind, fig.line)(x, y, legend_label=name, color=COLORS[k % len(COLORS)])
        self.figure = fig
        return fig

    def show(self) -> None:
        from bokeh.io import show

        show(self.figure)

    def save_html(self, path: str) -> None:
        from bokeh.io import output_file, save

        output_file(path)
        save(self.figure)


def print_pdf(page: str, path: str) -> None:
    """Prints an HTML page as a PDF through a headless browser, where one is installed."""
    check_dependencies("playwright")
    from playwright.sync_api import sync_playwright

    with sync_playwright() as p:
        browser = p.chromium.launch()
        tab = browser.new_page()
        tab.set_content(page)
        tab.pdf(path=path, format="A4", print_background=True, outline=True, tagged=True)
        browser.close()
