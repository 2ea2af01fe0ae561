"""Error types, helpers, charts, backends and tear sheets."""

import json
import math
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import errors as E
from tidemark import registry, viz
from tidemark.context import AnalysisContext
from tidemark.operators import common, report
from tidemark.sheets import _CHARTS, Sheet, TearSheets, profit_posterior
from tidemark.validation import validate_input, validate_numeric_array, validate_period


@pytest.mark.parametrize(
    ("kind", "values"),
    [(E.ValidationError, ("window", 3)), (E.InsufficientDataError, (10, 2)), (E.DataAlignmentError, (5, 6)), (E.NumericalError, ("sqrt",)), (E.MissingDataError, ("returns",)), (E.UnsupportedFormatError, ("frame", "list")), (E.DependencyError, ("pkg",))],
)
def test_errors_go_through_dictionaries(kind, values):
    error = kind("what is wrong", *values)
    data = json.loads(json.dumps(error.to_dict()))
    again = kind.from_dict(data)
    assert again.to_dict() == error.to_dict() and data["error_type"] == kind.__name__
    assert "what is wrong" in str(error) and all(str(v) in str(error) for v in values)
    with pytest.raises(ValueError):
        kind.from_dict(data | {"error_type": "Other"})
    with pytest.raises(TypeError):
        kind("x", *values, "one more", "and more")


def test_guards():
    period = E.InvalidPeriodError("hourly")
    assert E.InvalidPeriodError.from_dict(period.to_dict()).period == "hourly"
    with pytest.raises(E.InvalidPeriodError):
        validate_period("hourly")
    with pytest.raises(E.NumericalError) as held:
        E.handle_numerical_error(lambda: 1 / 0)()
    assert held.value.operation == "ZeroDivisionError"
    E.check_dependencies("json")
    with pytest.raises(E.DependencyError):
        E.check_dependencies("json", "no_such_package_here")
    assert E.ensure_not_nan(math.nan, "x", 0.0) == 0.0 and E.ensure_not_nan(1.0, "x") == 1.0
    with pytest.raises(E.ValidationError):
        E.ensure_not_nan(math.nan, "x")
    assert E.safe_divide(1, 0, -1) == -1 and E.safe_divide(np.array([1.0, 2.0]), np.array([0.0, 4.0]), 0).tolist() == [0.0, 0.5]
    assert E.safe_sqrt(4) == 2 and math.isnan(E.safe_sqrt(-1))
    with pytest.warns(DeprecationWarning):
        E.deprecated("old")(lambda: 1)()


def test_numeric_arrays_and_handing_on():
    assert validate_numeric_array([1, 2]).tolist() == [1, 2]
    for bad, kind in ((None, E.MissingDataError), ("x", E.UnsupportedFormatError), (["a"], E.UnsupportedFormatError), ([], E.InsufficientDataError)):
        with pytest.raises(kind):
            validate_numeric_array(bad)
    with pytest.raises(E.NumericalError):
        validate_numeric_array([math.nan], allow_nan=False)
    twice = validate_input(lambda v: v * 2)(lambda a, b=0: (a, b))
    assert twice(3, 4) == (6, 4)
    strict = validate_input(validate_numeric_array)(lambda values: values)
    with pytest.raises(E.ValidationError) as held:
        strict("text")
    assert held.value.param_name == "values"
    assert validate_input(validate_numeric_array, raise_on_error=False)(lambda values: values)("text") == "text"


def test_labels():
    assert [report.performance_label(v) for v in (1.7, 1.5, 0.7, 0.2, None, math.nan)] == ["excellent", "good", "fair", "poor", "N/A", "N/A"]
    assert [report.risk_label(v) for v in (-0.05, -0.1, -0.25, -0.4, None)] == ["excellent", "good", "fair", "poor", "N/A"]


def book_of(spark):
    rng = np.random.default_rng(0)
    days = [date(2008, 9, 1) + timedelta(d) for d in range(420) if (date(2008, 9, 1) + timedelta(d)).weekday() < 5]
    f = rng.normal(0, 0.01, len(days))
    returns = spark.createDataFrame([(0, d, float(v)) for d, v in zip(days, 0.5 * f + rng.normal(0, 0.01, len(days)))], "sid int, dt date, ret double")
    bench = spark.createDataFrame([(d, float(v)) for d, v in zip(days, f)], "dt date, ret double")
    names = ["A", "B", "C"]
    pos = [(d, s, float(v)) for d in days for s, v in zip([*names, "cash"], (1000 + rng.normal(0, 50), -400.0 + rng.normal(0, 20), 300.0, 5000.0))]
    fills = [(datetime(d.year, d.month, d.day, 10 + k % 5, 7 * k % 60), names[k % 3], float((-1) ** (i // 7) * (5 + k)), 20.0 + k + i % 9) for i, d in enumerate(days) for k in range(2 + i % 2)]
    market = [(d, s, 20.0 + k, 10_000.0 + 10 * k) for d in days for k, s in enumerate(names)]
    tables = {
        "positions": spark.createDataFrame(pos, "dt date, symbol string, value double"),
        "transactions": spark.createDataFrame(fills, "ts timestamp, symbol string, amount double, price double"),
        "market": spark.createDataFrame(market, "dt date, symbol string, price double, volume double"),
        "sectors": spark.createDataFrame([("A", "x"), ("B", "y"), ("C", "x")], "symbol string, sector string"),
        "caps": spark.createDataFrame([("A", 1e9), ("B", 5e9), ("C", 2e10)], "symbol string, cap double"),
        "factor_returns": spark.createDataFrame([(d, "mom", float(v)) for d, v in zip(days, f)], "dt date, factor string, ret double"),
        "loadings": spark.createDataFrame([(d, s, "mom", 0.5 + k) for d in days for k, s in enumerate(names)], "dt date, symbol string, factor string, loading double"),
        "shares": spark.createDataFrame([(d, s, v) for d in days[:20] for s, v in (("A", 5000.0), ("B", -5000.0), ("C", 1.0))], "dt date, symbol string, shares double"),
    }
    return returns, bench, days, tables


def test_every_sheet(spark, tmp_path):
    returns, bench, days, tables = book_of(spark)
    t = TearSheets(returns, benchmark=bench, live_start=days[200], estimate_intraday=False, **tables)
    full = t.create_full_tear_sheet(with_round_trips=True)
    assert len(full.frames()) > 45 and set(full.charts) | set(t.create_simple_tear_sheet().charts) <= set(_CHARTS)
    for name in ("plot_holdings", "plot_sector_exposures_longshort", "plot_cap_exposures_net", "plot_volume_exposures_longshort", "show_interesting_times", "plot_slippage_sensitivity", "plot_drawdown_periods"):
        assert full[name].data.count() > 0, name
    sides = full["plot_sector_exposures_longshort"].data.where("name = 'y'").first()
    assert sides["long"] == 0 and sides["short"] < 0
    assert {r["long"] for r in full["plot_volume_exposures_longshort"].data.collect()} == {1}
    few = Sheet("Few", {n: full[n] for n in ("show_perf_stats", "plot_rolling_returns", "plot_annual_returns", "plot_drawdown_underwater", "plot_monthly_returns_heatmap")})
    page = open(few.to_html(str(tmp_path / "page.html"))).read()
    assert page.count("<svg") == 3 and "Cumulative returns" in page and "out of sample" in page
    with pytest.raises(ValueError):
        TearSheets(returns).plot_turnover()
    with pytest.raises(TypeError):
        TearSheets(returns, prices=returns)
    cone = t.plot_cones(num_samples=50).data
    assert {"step", "value", "mean", "down_2_0", "strike"} <= set(cone.columns) and cone.count() == len(days) - 200


def test_backends(spark):
    returns, bench, _, _ = book_of(spark)
    assert {"svg", "html", "table", "plotly", "matplotlib", "bokeh"} <= set(registry.list_viz_backends())
    registry.clear_registry("backends")
    context = AnalysisContext(returns, factor_returns=bench)
    assert "<svg" in context.plot(backend="svg") and len(context.plot(backend="table")) > 250
    figure = context.plot(backend="plotly")
    assert figure["data"][0]["type"] == "scatter" and len(figure["data"][0]["y"]) > 250
    held = viz.HtmlReportBuilder().add_title("T").add_stats_table({"a": 1.0}).add_metric_cards({"a": 1.0, "b": None}, ["a"]).add_heading("x", 9)
    held.plot_monthly_heatmap(returns).plot_correlation_matrix(returns.union(bench.select(F.lit(1), "dt", "ret")))
    assert "<h6>x</h6>" in held.build() and "<h1>T</h1>" in held.build()
    with pytest.raises(E.DependencyError):
        registry.get_viz_backend("bokeh")
    long = spark.range(5000).select(F.col("id").alias("x"), F.col("id").cast("double").alias("y"))
    thinned = viz.Chart("long", long, x="x").points(100)
    assert len(thinned) <= 100 and thinned["y"].mean() == pytest.approx(2499.5, abs=30)
    assert "no rows" in viz.svg(viz.Chart("none", long.limit(0), x="x"))


def test_helpers(spark):
    returns, bench, days, tables = book_of(spark)
    early = returns.union(spark.createDataFrame([(1, days[5], 0.1)], "sid int, dt date, ret double")).union(spark.createDataFrame([(0, date(2000, 1, 3), 0.2)], "sid int, dt date, ret double"))
    clipped = common.clip_returns_to_benchmark(early, bench)
    assert clipped.columns == ["sid", "dt", "ret"] and clipped.count() == len(days) + 1
    z = common.standardize_data(returns).agg(F.avg("standardized"), F.stddev_pop("standardized")).first()
    assert z[0] == pytest.approx(0, abs=1e-12) and z[1] == pytest.approx(1)
    assert common.standardize_data(returns.withColumn("ret", F.lit(2.0))).where("standardized IS NOT NULL").count() == 0
    assert common.one_business_day_ago(date(2024, 1, 8)) == date(2024, 1, 5) and common.one_business_day_ago(date(2024, 1, 7)) == date(2024, 1, 5)
    got = spark.createDataFrame([(date(2024, 1, 8),), (date(2024, 1, 7),), (date(2024, 1, 10),)], "d date").select(common.previous_business_day(F.col("d"))).collect()
    assert [r[0] for r in got] == [date(2024, 1, 5), date(2024, 1, 5), date(2024, 1, 9)]
    a = spark.createDataFrame([(1, "x", 2.0), (2, "y", None), (3, "z", 1.0)], "k int, s string, v double")
    b = spark.createDataFrame([(1, "x", 2.0), (2, "q", None), (4, "z", 1.0)], "k int, s string, v float")
    d = common.table_differences(a, b, ["k"])
    assert d["types"] == {"v": ("double", "float")} and sorted((r["k"], r["column"]) for r in d["rows"].collect() if r["column"]) == [(2, "s")] and d["rows"].count() == 3
    assert "first 2" in common.table_text(a, "T", most_rows=2) and "<caption>T</caption>" in common.table_text(a, "T", as_html=True)
    p, x = tables["positions"], tables["transactions"]
    assert common.check_intraday(False, p, x) is p and common.check_intraday("infer", p, None) is p
    with pytest.raises(ValueError):
        common.check_intraday(True, p, None)
    assert common.check_intraday(True, p, x).columns == ["dt", "symbol", "value"]
    with pytest.warns(UserWarning):
        common.check_intraday("infer", p.withColumn("value", F.lit(0.0)), x)
    posterior = profit_posterior(spark.createDataFrame([(1.0,)] * 30 + [(-1.0,)] * 10, "pnl double")).first()
    # the Beta(31, 11) distribution function is a binomial tail
    below = lambda x: sum(math.comb(41, k) * x**k * (1 - x) ** (41 - k) for k in range(31, 42))
    assert below(posterior["low"]) == pytest.approx(0.025, abs=1e-6) and below(posterior["high"]) == pytest.approx(0.975, abs=1e-6)
    flow = spark.createDataFrame([(days[0], 0.1, 50.0, [(1, 2.0, 3.0)], [(1, 2.0, 3.0, datetime(2008, 9, 1, 10))])], "dt date, returns double, ending_cash double, positions array<struct<sid:int,amount:double,last_sale_price:double>>, transactions array<struct<sid:int,amount:double,price:double,dt:timestamp>>")
    r, pos, txn = common.from_backtest(flow)
    assert r.first()["ret"] == 0.1 and {row["value"] for row in pos.collect()} == {6.0, 50.0} and txn.first()["price"] == 3.0


def test_symbol_files_and_providers(spark, tmp_path):
    from tidemark.sources.providers import BatchFetchError, FileProvider, fetch_price_data, read_symbol_files

    (tmp_path / "AB C.csv").write_text("Date,Open,High,Low,Close,Adj Close,Volume\n2024-01-02 00:00:00,1,2,0.5,1.5,1.4,100\n2024-01-03,,2,x,1.6,,\n")
    got = read_symbol_files(spark, str(tmp_path)).orderBy("dt").collect()
    assert [(r["symbol"], r["dt"], r["open"], r["low"], r["adj_close"]) for r in got] == [("AB C", date(2024, 1, 2), 1.0, 0.5, 1.4), ("AB C", date(2024, 1, 3), None, None, None)]
    read_symbol_files(spark, str(tmp_path)).write.parquet(str(tmp_path / "bars"))
    files = FileProvider(spark, str(tmp_path / "bars"))
    with pytest.warns(UserWarning):
        assert files.fetch_multiple(["AB C", "ZZ"], "2024-01-01", "2024-01-31").count() == 2
    assert files.failed == {"ZZ": "no rows"} and files.get_info("AB C")["days"] == 2
    with pytest.raises(BatchFetchError):
        files.fetch("ZZ", "2024-01-01", "2024-01-31")
    assert fetch_price_data("AB C", "file", start="2024-01-01", end="2024-01-31", spark=spark, path=str(tmp_path / "bars")).count() == 2


def test_scope_removes_what_it_wrote(spark):
    from tidemark import storage

    with storage.scope():
        kept = storage.materialize(spark.range(3), "t")
        path = storage._written[-1][1].removeprefix("file://")
        import os

        assert kept.count() == 3 and os.path.isdir(path)
    assert not os.path.isdir(path)
