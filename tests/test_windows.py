"""Rolling windows, stretches and block statistics over long series: nothing cancels, and shards change nothing."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import metrics as M
from tidemark.operators import series as S
from tidemark.operators.attribution import FamaFrenchModel


def frame(spark, values, f=None, sid=1):
    rows = [(sid, date(2000, 1, 1) + timedelta(i), v, None if f is None else f[i]) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "sid int, dt date, ret double, f double")


def test_a_far_reading_leaves_with_its_window(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 0.02, 120)
    x[3] = 1e6
    got = {r["dt"]: r for r in S.rolling(frame(spark, x.tolist()), ["volatility", "sharpe", "mean_return"], 10).collect()}
    for k in range(13, 120):
        w = x[k - 9 : k + 1]
        r = got[date(2000, 1, 1) + timedelta(k)]
        assert r["volatility"] == pytest.approx(w.std(ddof=1) * np.sqrt(252), rel=1e-12)
        assert r["mean_return"] == pytest.approx(w.mean() * 252, rel=1e-9)


def test_nan_counts_as_null(spark):
    x = [0.01, float("nan"), 0.03, -0.01, 0.02, 0.0, 0.01, -0.02]
    got = S.rolling(frame(spark, x), ["volatility", "sortino"], 3).orderBy("dt").collect()
    assert got[0]["volatility"] == pytest.approx(np.std([0.01, 0.03], ddof=1) * np.sqrt(252))
    assert all(r["volatility"] is not None for r in got)
    assert got[-1]["volatility"] == pytest.approx(np.std([0.0, 0.01, -0.02], ddof=1) * np.sqrt(252))


def test_constant_windows_have_no_deviation(spark):
    got = S.rolling(frame(spark, [0.1] * 9, [0.3] * 9), ["volatility", "sharpe", "beta"], 4).collect()
    assert {r["volatility"] for r in got} == {0.0} and {r["sharpe"] for r in got} == {float("inf")} and {r["beta"] for r in got} == {None}


@pytest.mark.parametrize("shard_rows", [1, 20, 1000])
def test_shards_change_nothing(spark, monkeypatch, shard_rows):
    rng = np.random.default_rng(2)
    x, f = rng.normal(0, 0.02, 900), rng.normal(0, 0.02, 900)
    plain = lambda w, g: [g(x[k - w + 1 : k + 1], f[k - w + 1 : k + 1]) for k in range(w - 1, len(x))]
    whole = S.window_shards
    monkeypatch.setattr(S, "window_shards", lambda df, window: whole(df, window, shard_rows))
    got = S.rolling(frame(spark, x.tolist(), f.tolist()), ["beta", "max_drawdown"], 7).orderBy("dt").toPandas()
    assert np.allclose(got["beta"], plain(7, lambda a, b: np.cov(a, b)[0, 1] / b.var(ddof=1)))

    def fall(a, _):
        nav = np.concatenate([[1.0], np.cumprod(1 + a)])
        return (nav / np.maximum.accumulate(nav) - 1).min()

    assert np.allclose(got["max_drawdown"], plain(7, fall))
    rolled = S.roll(frame(spark, x.tolist(), f.tolist()), lambda a, b: float(a @ b), 7, ("ret", "f")).orderBy("dt").toPandas()
    assert np.allclose(rolled["value"], plain(7, lambda a, b: a @ b))


def test_numbers_and_stretches_over_years(spark):
    rng = np.random.default_rng(4)
    x = rng.choice([0.01, -0.01, 0.0], 1500, p=[0.5, 0.45, 0.05])
    df = frame(spark, x.tolist())
    numbers = {r["dt"]: r["rn"] for r in M.numbered(df).collect()}
    assert numbers == {date(2000, 1, 1) + timedelta(i): i + 1 for i in range(1500)}
    # a stretch of two years and a half is one run
    long = np.where((np.arange(1500) > 200) & (np.arange(1500) < 1100), 0.01, x)
    longest = S.longest_run(frame(spark, long.tolist()), True).first()
    assert longest["length"] >= 899 and longest["first"] <= date(2000, 1, 1) + timedelta(201)
    flat = frame(spark, [-0.5] + [0.0001] * 1200 + [5.0, -0.1, 0.2])
    runs = S.top_drawdowns(flat, 3).orderBy("rank").collect()
    assert [(r["peak"], r["valley"], r["recovery"]) for r in runs] == [(date(2000, 1, 1) + timedelta(1201), date(2000, 1, 1) + timedelta(1202), date(2000, 1, 1) + timedelta(1203))]
    under = frame(spark, [0.1, -0.5] + [0.0001] * 1200)
    assert S.top_drawdowns(under, 3).first()["recovery"] is None


def test_rolling_exposures_skip_incomplete_rows(spark):
    rng = np.random.default_rng(5)
    f = rng.normal(0, 0.02, 40)
    y = (0.001 + 2 * f).tolist()
    y[12] = None
    rows = [(1, date(2000, 1, 1) + timedelta(i), v, float(f[i])) for i, v in enumerate(y)]
    df = spark.createDataFrame(rows, "sid int, dt date, ret double, MKT double")
    got = FamaFrenchModel(factors=["MKT"]).rolling_exposures(df, 10).collect()
    assert len(got) == 31
    assert all(r["MKT"] == pytest.approx(2.0, abs=1e-9) and r["alpha"] == pytest.approx(0.001, abs=1e-9) for r in got)
    none = FamaFrenchModel(factors=["MKT"]).rolling_exposures(df.withColumn("ret", F.lit(None).cast("double")), 10).collect()
    assert len(none) == 31 and all(r["MKT"] is None for r in none)


def test_hurst_against_definition(spark):
    rng = np.random.default_rng(6)
    walk, noise = np.cumsum(rng.normal(size=300)), rng.normal(size=300)
    df = frame(spark, walk.tolist(), sid=1).union(frame(spark, noise.tolist(), sid=2)).union(frame(spark, [0.1] * 20, sid=3)).union(frame(spark, [0.1, 0.2], sid=4)).union(frame(spark, noise[:30].tolist(), sid=5))
    got = {r["sid"]: r["hurst_exponent"] for r in S.hurst_exponent(df).collect()}
    assert got[3] is None and got[4] is None
    x = noise[:30]
    points = []
    for lag in range(2, 11):
        ratios = []
        for b in range(len(x) // lag):
            part = x[b * lag : (b + 1) * lag]
            dev = np.cumsum(part - part.mean())
            if np.ptp(dev) > 0 and part.std(ddof=1) > 0:
                ratios.append(np.ptp(dev) / part.std(ddof=1))
        points.append((np.log(lag), np.log(np.mean(ratios))))
    assert got[5] == pytest.approx(min(1.0, max(0.0, np.polyfit(*zip(*points, strict=True), 1)[0])), abs=1e-9)
    assert got[1] > 0.85 and 0.4 < got[2] < 0.75
