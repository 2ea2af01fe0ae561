import json
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark import registry as G
from tidemark.context import Analytics, analyze
from tidemark.functions import metrics as M
from tidemark.operators.round_trips import round_trips
from tidemark.sources.providers import BatchFetchError, FileProvider, SymbolFolder, get_provider
from tidemark.streaming.running import running_growth, running_round_trips, sessions, windowed_profit
from tidemark.validation import ValidationError, validate_input, validate_percentage, validate_returns

VALUES = [1, 10, -4, 2, 3, 2, 1, -10]


def test_context(series, tmp_path):
    df = series(VALUES, [0, 1, 0, 1, 0, 1, 0, 1])
    ctx = analyze(df)
    d = ctx.to_dict()
    assert d["sharpe_ratio"] == pytest.approx(M.compute(df, ["sharpe_ratio"]).first()[1])
    assert json.loads(ctx.to_json())["max_drawdown"] == pytest.approx(-0.1)
    assert ctx.beta().first()["beta"] == pytest.approx(Analytics.beta(df).first()["beta"])
    assert Analytics(df).cum_returns().count() == 8
    assert {"sharpe_ratio", "hurst_exponent", "roll_beta", "max_consecutive_up_weeks"} <= set(Analytics.names())
    page = open(ctx.to_html(str(tmp_path / "r.html"), rolling_window=4)).read()
    assert "Performance" in page and "sharpe_ratio" in page
    with pytest.raises(AttributeError):
        ctx.nothing
    with pytest.raises(ValueError):
        ctx.to_html(str(tmp_path / "r.pdf"))


def test_registry(series):
    G.clear_registry("hooks")
    calls = []
    G.register_hook("pre_compute", 50)(lambda *_: calls.append("second"))
    G.register_hook("pre_compute", 10)(lambda *_: calls.append("first"))
    G.register_event_hook("pre_analysis", lambda df: df.where("ret > 0"))
    with pytest.raises(ValueError):
        G.register_event_hook("never", print)

    @G.register_metric("spread")
    def spread(**_):
        return F.max("ret") - F.min("ret")

    @G.register_series_metric("last")
    def last(x):
        return float(x[-1])

    df = series(VALUES)
    assert M.compute(df, ["spread"]).first()["spread"] == pytest.approx(0.2)
    assert last.run(df).first()["last"] == pytest.approx(-0.1)
    analyze(df).perf_stats()
    assert calls == ["first", "second"]
    with G.create_analysis_scope(df) as kept:
        assert kept.count() == 6
    assert set(G.list_metrics()) == {"spread", "last"} and "table" in G.list_viz_backends()
    G.clear_registry("metrics")
    G.clear_registry("hooks")
    assert "spread" not in M.REGISTRY


def test_validation(series):
    assert validate_returns(series(VALUES)).count() == 8
    for bad in (lambda: validate_returns(series([])), lambda: validate_returns(series([1]), min_length=2), lambda: validate_returns(series([None, 1]), allow_missing=False), lambda: validate_returns(series([1]).drop("ret")), lambda: validate_percentage(2)):
        with pytest.raises(ValidationError):
            bad()

    @validate_input(validate_percentage)
    def half(x):
        return x / 2

    assert half(0.5) == 0.25
    with pytest.raises(ValidationError):
        half(7)


def test_sources(spark, tmp_path):
    rows = [("A", date(2021, 1, 1 + i), 1.0, 1.0, 1.0, 10.0 + i, None, 5.0) for i in range(5)]
    from tidemark.sources.providers import PRICES

    spark.createDataFrame(rows, PRICES).write.parquet(str(tmp_path / "p"))
    p = FileProvider(spark, str(tmp_path / "p"))
    assert p.fetch("A", "2021-01-02", "2021-01-03").count() == 2
    assert p.to_returns(p.fetch("A", "2021-01-01", "2021-01-05")).count() == 4
    with pytest.raises(BatchFetchError):
        p.fetch_multiple(["A", "B"], "2021-01-01", "2021-01-05", strict=True)
    with pytest.raises(ValueError):
        p.fetch("A", "2021-02-01", "2021-01-05")
    with pytest.raises(ImportError):
        get_provider("tushare", spark)
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "XYZ.csv").write_text("Date,Open,High,Low,Close,Adj Close,Volume\n2021-01-01,1,2,0.5,1.5,1.4,100\n2021-01-02,1,2,0.5,,1.4,100\n")
    spark.dataSource.register(SymbolFolder)
    got = spark.read.format("symbol_folder").load(str(tmp_path / "f")).orderBy("dt").collect()
    assert [(r["symbol"], r["close"], r["adj_close"]) for r in got] == [("XYZ", 1.5, 1.4), ("XYZ", None, 1.4)]


def _run(spark, df, tmp_path, mode):
    name = f"out_{abs(hash(str(tmp_path)))}"
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_running_growth(spark, series, tmp_path):
    df = series(VALUES).select(F.col("sid").cast("string").alias("sid"), "dt", "ret")
    for i in range(4):
        df.where(F.datediff("dt", F.lit("2000-01-30")).between(2 * i, 2 * i + 1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 100).parquet(str(tmp_path / "in"))
    last = _run(spark, running_growth(stream), tmp_path, "update").orderBy(F.desc("rows")).first()
    assert last["rows"] == 8 and last["max_drawdown"] == pytest.approx(-0.1)
    assert last["nav"] == pytest.approx(1 + M.compute(df, ["cum_returns_final"]).first()[1])


def test_running_round_trips_and_windows(spark, tmp_path):
    start = datetime(2021, 1, 1)
    rows = [("A", start + timedelta(days=i), float(a), float(p)) for i, (a, p) in enumerate([(2, 10), (-4, 15), (3, 20), (-1, 10)])]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, amount double, price double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = _run(spark, running_round_trips(read()), tmp_path / "a", "append").orderBy("close_dt").collect()
    batch = round_trips(df).orderBy("close_dt").collect()
    assert [(r["pnl"], r["long"], r["open_dt"], r["close_dt"]) for r in got] == [(r["pnl"], r["long"], r["open_dt"], r["close_dt"]) for r in batch]
    win = _run(spark, windowed_profit(read(), "2 days"), tmp_path / "b", "append")
    assert win.count() >= 1
    ses = _run(spark, sessions(read(), "1 hour"), tmp_path / "c", "append")
    assert ses.count() >= 2
