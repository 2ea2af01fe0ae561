import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions.special import esd_limit, t_cdf, t_isf
from tidemark.operators.spikes import constant_runs, esd, flag_spikes

SCHEMA = "src string, id long, x double, source string, ord string"


def flags(df, **p):
    out = flag_spikes(df, source="src", order=F.col("id"), row_id="id", value="x", **p)
    return {r["row_id"]: r for r in out.collect()}


def test_finds_planted(spark):
    rng = random.Random(3)
    rows, bad = [], {}
    k = 0
    for s in range(4):
        level = 10.0 ** (s + 1)
        for i in range(600):
            x = level * (1 + rng.gauss(0, 0.01) + 0.01 * i / 600)
            if i % 97 == 50:
                x = level * rng.choice([10, 0.1, 1.5])
                bad[k] = "far"
            elif i % 199 == 7:
                x = -level
                bad[k] = "impossible"
            elif 300 <= i < 305 and s == 1:
                x = level
                bad[k] = "in_run"
            rows.append((f"s{s}", k, x, "clash", "clash"))
            k += 1
    rows += rows[:50]  # copies
    rows += [("s0", 10_000, None, "", ""), (None, 10_001, 5.0, "", ""), ("s0", None, 5.0, "", ""), ("s0", 10_002, float("nan"), "", "")]
    got = flags(spark.createDataFrame(rows, SCHEMA), floor=0.0)
    found = {i for i, r in got.items() if r["impossible"] or r["far"] or r["in_run"]}
    assert found == set(bad)
    assert all(got[i][kind] for i, kind in bad.items())
    assert all(got[i]["outlying"] for i, kind in bad.items() if kind == "far")


def test_runs_across_shards(spark):
    """Runs that reach over several shards, nulls between them skipped, are found like unsharded ones."""
    rng = random.Random(1)
    rows, k = [], 0
    for s in ("a", "b"):
        x = 0
        for _ in range(300):
            x = x if rng.random() < 0.6 else rng.randrange(3)
            rows.append((s, k, None if rng.random() < 0.1 else float(x), "", ""))
            k += 1
    expected = set()
    for s in ("a", "b"):
        held = [(i, x) for src, i, x, _, _ in rows if src == s and x is not None]
        i = 0
        while i < len(held):
            j = i
            while j < len(held) and held[j][1] == held[i][1]:
                j += 1
            if j - i >= 5:
                expected |= {h[0] for h in held[i:j]}
            i = j
    df = spark.createDataFrame(rows, SCHEMA).where("x IS NOT NULL").select(F.col("src").alias("source"), F.col("id").alias("ord"), F.col("id").alias("row_id"), "x")
    for width in (2, 3, 7, 50, 10_000):
        got = {r[0] for r in constant_runs(df, F.floor(F.col("ord") / width), 5).collect()}
        assert got == expected, width


def test_small_inputs(spark):
    assert flags(spark.createDataFrame([], SCHEMA)) == {}
    one = flags(spark.createDataFrame([("a", 1, -1.0, "", "")], SCHEMA), floor=0.0)
    assert one[1]["impossible"] and not one[1]["far"]
    assert flags(spark.createDataFrame([("a", 1, 5.0, "", "")], SCHEMA), floor=0.0) == {}
    same = flags(spark.createDataFrame([("a", i, 5.0, "", "") for i in range(4)], SCHEMA))
    assert same == {}
    long = flags(spark.createDataFrame([("a", i, 5.0, "", "") for i in range(5)], SCHEMA))
    assert len(long) == 5 and all(r["in_run"] for r in long.values())


def test_lone_reading_has_no_season_of_its_own(spark):
    """Faulty readings alone, or two, in their weekday are removed, so they do not widen the spread for the others."""
    rng = random.Random(5)
    rows = []
    for s, strays in (("one", [5]), ("two", [5, 12]), ("none", [])):
        for i in range(400):
            if i % 7 < 5 or i in strays:
                x = -900.0 - i if i in strays else 0.3 if i == 100 else rng.gauss(0, 0.01)
                rows.append((s, len(rows), x, str(i), str(i % 7)))
    rows += [("short", len(rows) + i, x, str(i), str(i % 7)) for i, x in enumerate([0.01, -0.01, 0.02, 0.0, -0.02, 500.0, 0.01, 5.0, -0.01, 0.03, -0.03, 0.02])]
    df = spark.createDataFrame(rows, "src string, id long, x double, source string, ord string")
    out = flag_spikes(df, source="src", order=F.col("source"), row_id="id", value="x", phase=F.col("ord"), phases=7)
    got = {r["row_id"]: r for r in out.collect()}
    assert {i for i, r in got.items() if r["far"]} == {i for _, i, x, _, _ in rows if abs(x) > 0.2}


def test_readings_without_order(spark):
    """They are in no run, but the range and spread checks hold for them."""
    rng = random.Random(6)
    rows = [("a", k, rng.gauss(0, 0.01), k) for k in range(300)]
    rows += [("a", 300, -2.0, None), ("a", 301, 0.9, None), ("a", 302, 0.011, None)] + [("a", k, 0.012, None) for k in range(310, 316)]
    rows += [("no order", k, 5.0 if k == 405 else rng.gauss(0, 0.01), None) for k in range(400, 430)] + [("all bad", 500, -3.0, None)]
    df = spark.createDataFrame(rows, "src string, id long, x double, day long")
    out = flag_spikes(df, source="src", order=F.col("day"), row_id="id", value="x", floor=-1.0, phase=(F.col("day") % 7).cast("int"), phases=7)
    got = {r["row_id"]: r for r in out.collect()}
    assert {i for i, r in got.items() if r["impossible"]} == {300, 500}
    assert {i for i, r in got.items() if r["far"]} >= {301, 405}
    assert {i for i, r in got.items() if r["impossible"] or r["far"] or r["in_run"]} == {300, 301, 405, 500}


def test_esd_masks_nothing():
    """Two far clusters that hide each other from a one-pass test are both removed."""
    far = np.array([0.0, 50.0, 60.0])
    n = np.array([1000.0, 30.0, 20.0])
    out = esd(n, n * far, np.array([1000.0, 30 * 2500.0, 20 * 3600.0]), far, 0.05)
    assert out.tolist() == [False, True, True]


def test_t_quantiles():
    assert abs(t_isf(0.025, 10.0) - 2.228138852) < 1e-6
    assert abs(t_isf(0.025, 100.0) - 1.983971519) < 1e-6
    assert abs(t_cdf(2.228138852, 10) - 0.975) < 1e-9
    # published critical value for n = 54, alpha = 0.05
    assert abs(esd_limit(54, 0.05) - 3.158) < 1e-3
