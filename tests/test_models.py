import math

import numpy as np
import pytest

from tidemark.functions.solvers import nelder_mead, quadratic, risk_budget
from tidemark.functions.special import beta_cdf, normal_ppf, t_sf
from tidemark.operators import simulate as S
from tidemark.operators import tails as T
from tidemark.operators.optimise import OptimizationError, Programs, efficient_frontier, optimize, risk_parity


def test_nelder_mead():
    x, v, good = nelder_mead(lambda p: (1 - p[0]) ** 2 + 100 * (p[1] - p[0] ** 2) ** 2, np.array([-1.2, 1.0]))
    assert good and x == pytest.approx([1, 1], abs=1e-4) and v < 1e-8


def test_programs():
    cov = np.array([[0.04, 0.01], [0.01, 0.09]])
    w = quadratic(cov, np.zeros(2), np.zeros(2), np.ones(2))
    assert w == pytest.approx([8 / 11, 3 / 11], abs=1e-6)
    w = risk_budget(cov, np.array([0.5, 0.5]))
    part = w * (cov @ w)
    assert part[0] == pytest.approx(part[1])
    p = Programs(np.array([0.05, 0.10]), cov)
    assert p.target_return(0.08) @ p.mean == pytest.approx(0.08, abs=1e-6)
    best = p.figures(p.max_sharpe())[2]
    assert best >= max(p.figures(np.array([a, 1 - a]))[2] for a in np.linspace(0, 1, 201)) - 1e-6
    with pytest.raises(OptimizationError):
        p.target_return(0.2)
    with pytest.raises(OptimizationError):
        Programs(np.zeros(2), cov, max_weight=0.3)


def test_optimise_frames(spark):
    rng = np.random.default_rng(0)
    x = rng.normal([0.001, 0.0005, 0.0002], [0.02, 0.01, 0.005], (400, 3))
    from datetime import date, timedelta

    rows = [(s, date(2020, 1, 1) + timedelta(i), float(x[i, j])) for i in range(400) for j, s in enumerate("abc")]
    df = spark.createDataFrame(rows, "sid string, dt date, ret double")
    low = optimize(df, "min_variance")
    inverse = np.linalg.inv(np.cov(x.T)) @ np.ones(3)
    assert [low["weights"][s] for s in "abc"] == pytest.approx(list(inverse / inverse.sum()), abs=1e-3)
    bound = optimize(df, "max_sharpe", sector_constraints={"x": (0.0, 0.2)}, sector_map={"c": "x"})
    assert bound["weights"]["c"] <= 0.2 + 1e-6
    parity = risk_parity(df)
    assert list(parity["risk_shares"].values()) == pytest.approx([1 / 3] * 3, abs=1e-6)
    points = efficient_frontier(df, 5).where("kind = 'frontier'").orderBy("point").collect()
    assert [p["volatility"] for p in points] == sorted(p["volatility"] for p in points)
    with pytest.raises(ValueError):
        optimize(df, "best")


def test_tail_fits():
    rng = np.random.default_rng(1)
    u = rng.uniform(size=20_000)
    loss = 0.01 / 0.2 * (u**-0.2 - 1)
    fit = T.fit_gpd(-loss, threshold=0.0)
    assert fit["xi"] == pytest.approx(0.2, abs=0.03) and fit["beta"] == pytest.approx(0.01, rel=0.05)
    risk = T.tail_risk(-loss, 0.05)
    assert risk["var"] == pytest.approx(-np.quantile(loss, 0.95), rel=0.05) and risk["cvar"] < risk["var"]
    with pytest.raises(ValueError):
        T.fit_gpd(np.ones(50))


def test_garch_recovers():
    rng = np.random.default_rng(2)
    w, a, b = 1e-6, 0.1, 0.85
    s, x = w / (1 - a - b), []
    for _ in range(4000):
        x.append(rng.normal() * math.sqrt(s))
        s = w + a * x[-1] ** 2 + b * s
    fit = T.fit_garch(np.array(x))
    assert fit["alpha"] == pytest.approx(a, abs=0.04) and fit["beta"] == pytest.approx(b, abs=0.06)
    assert len(T.forecast(fit, "GARCH", 5)) == 5


def test_simulation(spark):
    p = S.gbm(spark, 0.1, 0.2, 100.0, 2000, 12, 12, seed=3)
    a = p.where("step = 12").selectExpr("avg(ln(value / 100)) AS m", "stddev(ln(value / 100)) AS s").first()
    assert a["m"] == pytest.approx(0.08, abs=0.02) and a["s"] == pytest.approx(0.2, abs=0.01)
    # the draws do not depend on how the data lie
    q = S.gbm(spark, 0.1, 0.2, 100.0, 2000, 12, 12, seed=3).repartition(7)
    assert p.selectExpr("round(sum(value), 4)").first() == q.selectExpr("round(sum(value), 4)").first()
    lhs = S.latin_hypercube(spark, 10, 2, 1).selectExpr("dim", "floor(u * 10) AS b").distinct().count()
    assert lhs == 20
    mirrored = S.antithetic_reflection(p)
    assert mirrored.count() == 2 * p.count()


def test_special():
    assert normal_ppf(0.975) == pytest.approx(1.959963985)
    assert beta_cdf(0.3, 2, 3) == pytest.approx(0.3483)
    assert t_sf(1.812461123, 10) == pytest.approx(0.05)
