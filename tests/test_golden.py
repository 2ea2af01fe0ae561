"""Published expected values of the small series."""

import math
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions import metrics as M
from tidemark.operators import attribution as A
from tidemark.operators import book as B
from tidemark.operators import round_trips as T
from tidemark.operators import series as S

BENCH = [0, 1, 0, 1, 0, 1, 0, 1, 0]
POSITIVE = [1, 2, 1, 1, 1, 1, 1, 1, 1]
NEGATIVE = [0, -6, -7, -1, -9, -2, -6, -8, -5]
ALL_NEGATIVE = [-2, -6, -7, -1, -9, -2, -6, -8, -5]
MIXED = [None, 1, 10, -4, 2, 3, 2, 1, -10]
WEEKLY = [0, 1, 10, -4, 2, 3, 2, 1, -10]


def one(df, name, **p):
    return M.compute(df, [name], **p).first()[name]


@pytest.mark.parametrize(
    ("name", "values", "f", "params", "expected"),
    [
        ("sharpe_ratio", MIXED, None, {}, 1.7238613961706866),
        ("sharpe_ratio", POSITIVE, None, {}, 52.915026221291804),
        ("sharpe_ratio", NEGATIVE, None, {}, -24.406808633910085),
        ("sharpe_ratio", [1] * 9, None, {}, math.inf),
        ("sharpe_ratio", [1], None, {}, None),
        ("sortino_ratio", MIXED, None, {}, 2.605531251673693),
        ("sortino_ratio", NEGATIVE, None, {}, -13.532743075043401),
        ("sortino_ratio", WEEKLY, None, {"period": "weekly"}, 1.1158901056866439),
        ("sortino_ratio", WEEKLY, None, {"period": "monthly"}, 0.53605626741889756),
        ("downside_risk", MIXED, None, {}, 0.60448325038829653),
        ("downside_risk", MIXED, None, {"required_return": 0.1}, 1.7161730681956295),
        ("calmar_ratio", MIXED, None, {}, 19.135925373194233),
        ("calmar_ratio", WEEKLY, None, {"period": "weekly"}, 2.4690830513998208),
        ("calmar_ratio", WEEKLY, None, {"period": "monthly"}, 0.52242061386048144),
        ("omega_ratio", MIXED, None, {"required_return": 10.0}, 0.83354263497557934),
        ("max_drawdown", MIXED, None, {}, -0.1),
        ("max_drawdown", POSITIVE, None, {}, 0.0),
        ("max_drawdown", [10, -10, 10], None, {}, -0.1),
        ("cum_returns_final", MIXED, None, {}, 0.03893),
        ("cum_returns_final", MIXED, None, {"starting_value": 100.0}, 103.8931),
        ("cum_returns_final", NEGATIVE, None, {}, -0.3659),
        ("capture", ALL_NEGATIVE, MIXED, {}, -0.52257643222960259),
        ("up_capture", POSITIVE, MIXED, {}, 0.0076167762),
        ("down_capture", POSITIVE, MIXED, {}, -11.27400221),
        ("value_at_risk", [100, 200], None, {"cutoff": 0.0}, 1.0),
        ("value_at_risk", [100, 200], None, {"cutoff": 0.3}, 1.3),
        ("value_at_risk", [100, 8100, 8200, 8300, 8400, 8500], None, {"cutoff": 0.1}, 41.0),
        ("value_at_risk", [100, 8100, 8200, 8300, 8400, 8500], None, {"cutoff": 0.3}, 81.5),
        ("value_at_risk", MIXED, None, {}, None),
    ],
)
def test_metric(series, name, values, f, params, expected):
    got = one(series(values, f), name, **params)
    if expected is None or math.isinf(expected):
        assert got == expected
    else:
        assert got == pytest.approx(expected, rel=1e-4 if name == "cum_returns_final" else 1e-8, abs=1e-12)


def test_alpha_beta(series):
    df = series(MIXED[1:], NEGATIVE[1:])
    row = M.compute(df, ["alpha_beta"]).first()["alpha_beta"]
    assert (row["alpha"], row["beta"]) == pytest.approx((-0.9997853834885004, -0.71296296296296313), rel=1e-8)


def test_cum_returns(series):
    got = [r["cum"] for r in S.cum_returns(series(MIXED)).orderBy("dt").collect()]
    assert got == pytest.approx([0, 0.01, 0.111, 0.066559, 0.08789, 0.12052, 0.14293, 0.15436, 0.03893], abs=1e-4)


def test_cum_returns_over_years(series):
    """A series that runs over year ends is scanned in shards; the result is that of one scan."""
    values = [((i * 37) % 11) - 5 for i in range(800)]
    got = S.cum_returns(series(values)).orderBy("dt").collect()
    nav = peak = 1.0
    for n, (v, r) in enumerate(zip(values, got, strict=True), 1):
        nav *= 1 + v / 100
        peak = max(peak, nav)
        assert r["cum"] == pytest.approx(nav - 1, rel=1e-9, abs=1e-12)
        assert r["dd"] == pytest.approx(nav / peak - 1, rel=1e-9, abs=1e-12)
        assert r["rn"] == n


def test_aggregate(series):
    got = [r["ret"] for r in S.aggregate_returns(series(BENCH), "weekly").orderBy("year", "part").collect()]
    assert got == pytest.approx([0, 0.04060401, 0], abs=1e-8)
    months = [date(2000, 1 + i, 28) for i in range(9)]
    got = [r["ret"] for r in S.aggregate_returns(series(WEEKLY, days=months), "quarterly").orderBy("year", "part").collect()]
    assert got == pytest.approx([0.111, 0.008576, -0.07282], abs=1e-6)


def test_rolling(series):
    got = [r["max_drawdown"] for r in S.rolling(series(NEGATIVE), "max_drawdown", 6).orderBy("dt").collect()]
    assert got == pytest.approx([-0.2282, -0.2745, -0.2899, -0.2747], abs=1e-4)
    got = [r["sharpe"] for r in S.rolling(series(MIXED), "sharpe", 6).orderBy("dt").collect()]
    assert got == pytest.approx([7.57445259, 8.22784105, 8.22784105, -3.1374751], rel=1e-7)
    got = [(r["alpha"], r["beta"]) for r in S.rolling(series(MIXED, NEGATIVE), ["alpha", "beta"], 6).orderBy("dt").collect()]
    for a, b in zip(got, [(-0.97854954, -0.7826087), (-0.9828927, -0.76156584), (-0.93166924, -0.61682243), (-0.99967288, -0.41311475)], strict=True):
        assert a == pytest.approx(b, rel=1e-6)
    with pytest.raises(ValueError):
        S.rolling(series(MIXED), "nothing", 3)


def _fills(spark, rows):
    start = datetime(2015, 1, 1)
    return spark.createDataFrame([("A", start + timedelta(hours=h), float(a), float(p)) for h, a, p in rows], "symbol string, ts timestamp, amount double, price double")


def test_fill_blocks(spark):
    got = T.fill_blocks(_fills(spark, [(0, 2, 10), (1, 2, 20), (2, -2, 20), (3, -2, 10)])).orderBy("dt").collect()
    assert [(r["amount"], r["price"]) for r in got] == [(4.0, 15.0), (-4.0, 15.0)]


@pytest.mark.parametrize(
    ("fills", "expected"),
    [
        ([(0, 2, 10), (24, -2, 15)], [(10.0, 0.5, True)]),
        ([(0, 2, 10), (24, 2, 15), (48, -9, 10)], [(-10.0, -0.2, True)]),
        ([(0, 2, 10), (24, -4, 15), (48, 3, 20)], [(10.0, 0.5, True), (-10.0, -1 / 3, False)]),
    ],
)
def test_round_trips(spark, fills, expected):
    got = T.round_trips(_fills(spark, fills)).orderBy("close_dt").collect()
    for r, (pnl, ret, long) in zip(got, expected, strict=True):
        assert (r["pnl"], r["rt_returns"], r["long"]) == pytest.approx((pnl, ret, long))
    assert got[0]["duration_s"] == pytest.approx(86_400 * (1 if len(fills) < 3 or expected[0][0] > 0 else 2))


def test_top_drawdowns(series):
    prices = [100, 110, 55, 60, 90, 120, 130, 120, 110, 130, 140, 84, 90]
    rets = [None] + [(b / a - 1) * 100 for a, b in zip(prices, prices[1:])]
    got = S.top_drawdowns(series(rets, start=date(2000, 1, 3)), 3).orderBy("rank").collect()
    assert [round(r["depth_pct"], 6) for r in got] == [50.0, 40.0, round(2000 / 130, 6)]
    assert (got[0]["peak"], got[0]["valley"], got[0]["recovery"], got[0]["duration"]) == (date(2000, 1, 4), date(2000, 1, 5), date(2000, 1, 8), 4)
    assert got[1]["recovery"] is None


def test_days_to_liquidate(spark):
    days = [date(2017, 1, 1) + timedelta(i) for i in range(3)]
    pos = spark.createDataFrame([(d, s, v) for d in days for s, v in (("A", 1.0), ("B", 1.0), ("cash", 0.0))], "dt date, symbol string, value double")
    mkt = spark.createDataFrame([(d, s, 10.0, 100.0) for d in days for s in "AB"], "dt date, symbol string, price double, volume double")
    got = B.days_to_liquidate(pos, mkt, max_bar_consumption=1.0, capital_base=1e6, mean_volume_window=1).collect()
    assert len(got) == 4 and all(r["days"] == pytest.approx(0.5e6 / 1000) for r in got)


def test_turnover(spark):
    days = [date(2015, 1, 1) + timedelta(i) for i in range(4)]
    pos = spark.createDataFrame([(d, s, v) for i, d in enumerate(days) for s, v in (("A", 10.0 if i % 2 else 40.0), ("cash", 10.0))], "dt date, symbol string, value double")
    fills = spark.createDataFrame([(datetime(d.year, d.month, d.day), "A", 2.0, 10.0) for d in days], "ts timestamp, symbol string, amount double, price double")
    got = [r["turnover"] for r in B.turnover(pos, fills).orderBy("dt").collect()]
    assert got == pytest.approx([1.0, 0.8, 0.8, 0.8])
    got = [r["turnover"] for r in B.turnover(pos, fills, "portfolio_value").orderBy("dt").collect()]
    assert got == pytest.approx([0.4, 1.0, 0.4, 1.0])


def test_slippage_penalty(series, spark):
    days = [date(2000, 1, 30) + timedelta(i) for i in range(3)]
    bars = spark.createDataFrame([(d, "A", 1000.0, 1.0, 1000000.0) for d in days], "dt date, symbol string, amount double, price double, volume double")
    got = [r["ret"] for r in B.slippage_penalty(series([100, 100, 100]).drop("f"), bars, 1e6, 1e6, 1.0).orderBy("dt").collect()]
    assert all(a < 1.0 for a in got) and got == sorted(got)


def test_brinson(spark):
    rows = [(1, g, rp, rb, wp, wb) for g, rp, rb, wp, wb in (("a", 0.05, 0.04, 0.5, 0.4), ("b", 0.02, 0.03, 0.3, 0.4), ("c", -0.01, 0.0, 0.2, 0.2))]
    r = A.brinson(spark.createDataFrame(rows, "dt int, g string, rp double, rb double, wp double, wb double")).first()
    assert r["total"] == pytest.approx(r["active_return"]) == pytest.approx(r["allocation"] + r["selection"] + r["interaction"])


def test_missing_returns_stay_missing(series):
    """Clipping must not turn a missing return into a zero."""
    df = series([None, -2, None, 4])
    assert one(df, "downside_risk") == pytest.approx(math.sqrt(0.0004 / 2) * math.sqrt(252))
    assert one(df, "win_rate") == 0.5
    assert one(df, "annual_return") == pytest.approx((0.98 * 1.04) ** (252 / 4) - 1)


def test_empty(series, spark):
    empty = series([])
    assert M.compute(empty, ["sharpe_ratio", "max_drawdown", "beta"]).count() == 0
    assert S.rolling(empty, "all", 5).count() == 0
    assert S.top_drawdowns(empty).count() == 0


def test_extra_columns(series):
    df = series(MIXED, BENCH).withColumn("nav", F.lit("x")).withColumn("value", F.lit(1))
    assert M.compute(df.drop("nav"), ["max_drawdown"]).first()["max_drawdown"] == pytest.approx(-0.1)


def test_rolling_against_each_window(series):
    """Running sums give what each window gives by itself, nulls, constant stretches and total losses included."""
    import numpy as np

    rng = np.random.default_rng(3)
    values = [None if rng.random() < 0.1 else float(np.round(rng.normal(), 2)) for _ in range(60)] + [1.0] * 12 + [-100.0, 2.0, -3.0] + [float(v) for v in rng.normal(size=20)]
    f = [None if rng.random() < 0.1 else float(np.round(rng.normal(), 2)) for _ in values]
    df = series(values, f)
    w = 8
    got = S.rolling(df, "all", w).orderBy("dt").collect()
    rows = df.orderBy("dt").collect()
    assert len(got) == len(values) - w + 1
    names = {"sharpe": "sharpe_ratio", "volatility": "annual_volatility", "beta": "beta", "alpha": "alpha", "up_capture": "up_capture", "down_capture": "down_capture"}
    for k in range(0, len(got), 8):
        one_window = df.where((F.col("dt") >= F.lit(rows[k]["dt"])) & (F.col("dt") <= F.lit(rows[k + w - 1]["dt"])))
        want = M.compute(one_window, [*names.values(), "max_drawdown"]).first()
        for mine, its in names.items():
            a, b = got[k][mine], want[its]
            assert (a is None) == (b is None) and (a is None or a == b or a == pytest.approx(b, rel=1e-7, abs=1e-9)), (k, mine, a, b)
        assert got[k]["max_drawdown"] == pytest.approx(min(want["max_drawdown"], 0.0), abs=1e-9)
