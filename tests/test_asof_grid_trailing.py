import random
from collections import defaultdict
from datetime import date, datetime, timedelta, timezone

import pytest

from tidemark.operators.asof import attach_as_known
from tidemark.operators.grid import regular_series
from tidemark.operators.trailing import trailing_totals

EV = "pos_id long, sid long, ts timestamp, dt string"
CH = "loading_id long, ticker string, dt date, known_at timestamp, financials double"
T0 = datetime(2021, 1, 1, tzinfo=timezone.utc)


def known(spark, events, changes, **p):
    out = attach_as_known(
        spark.createDataFrame(events, EV), spark.createDataFrame(changes, CH), event_id="pos_id", event_entity="sid", event_time="ts", change_id="loading_id", change_entity="ticker", in_force="dt", known_at="known_at", value="financials", **p
    )
    return {r["event_id"]: r["change_id"] for r in out.collect()}


@pytest.mark.parametrize("shard_days", [1, 7, 400])
def test_as_known_against_brute_force(spark, shard_days):
    rng = random.Random(5)
    events = [(i, 1 if rng.random() < 0.5 else rng.choice([2, 3, None]), T0 + timedelta(minutes=rng.randrange(60 * 24 * 40)), "clash") for i in range(300)]
    changes = []
    for i in range(120):
        d = date(2020, 12, 20) + timedelta(rng.randrange(50))
        k = datetime(d.year, d.month, d.day, tzinfo=timezone.utc) + timedelta(hours=rng.randrange(-200, 300))
        changes.append((i, str(rng.choice([1, 1, 2, 4])), d, k, None if rng.random() < 0.1 else rng.random()))
    changes += [c for c in changes[:10]]
    events += events[:10]
    expected = {}
    for pid, sid, ts, _ in events:
        fit = [(c[2], c[3], c[0]) for c in changes if c[1] == str(sid) and c[4] is not None and c[2] <= ts.date() and c[3] <= ts]
        if fit:
            expected[pid] = max(fit)[2]
    assert known(spark, events, changes, shard_days=shard_days) == expected


def test_as_known_edges(spark):
    e = (1, 7, T0, "")
    assert known(spark, [e], []) == {} and known(spark, [], [(1, "7", date(2021, 1, 1), T0, 1.0)]) == {}
    # known and in force at the very time of the event
    assert known(spark, [e], [(1, "7", date(2021, 1, 1), T0, 1.0)]) == {1: 1}
    # known too late, or not yet in force
    assert known(spark, [e], [(1, "7", date(2021, 1, 1), T0 + timedelta(microseconds=1), 1.0), (2, "7", date(2021, 1, 2), T0, 1.0)]) == {}
    # nulls anywhere
    assert known(spark, [e, (None, 7, T0, ""), (2, 7, None, "")], [(None, "7", date(2021, 1, 1), T0, 1.0), (3, None, date(2021, 1, 1), T0, 1.0), (4, "7", None, T0, 1.0), (5, "7", date(2021, 1, 1), None, 1.0), (6, "7", date(2021, 1, 1), T0, float("nan"))]) == {}


READ = "tab string, source_key string, date date, value double, seen_at timestamp"
INFO = "tab string, source_key string, cadence string, start_dt date, end_dt date"


@pytest.mark.parametrize("weeks", [1, 2, 13])
def test_grid_against_brute_force(spark, weeks):
    rng = random.Random(2)
    start = date(2021, 3, 3)
    info = [("t", "d", "daily", start, start + timedelta(90)), ("t", "w", "weekly", start, start + timedelta(90)), ("t", "none", "daily", start, start + timedelta(9)), ("t", "bad", "hourly", start, start), ("t", "open", "daily", None, start)]
    rows = []
    for key in ("d", "w", "stray"):
        for i in range(-10, 105):
            if rng.random() < 0.55:
                rows.append(("t", key, start + timedelta(i), None if rng.random() < 0.1 else float(i), T0))
    rows += rows[:20]
    got = {(r["source_key"], r["slot"]): r for r in regular_series(spark.createDataFrame(rows, READ), spark.createDataFrame(info, INFO), shard_weeks=weeks).collect()}
    expected = {}
    for _, key, cadence, a, b in info[:3]:
        last = None
        for n in range((b - a).days + 1):
            d = a + timedelta(n)
            if d.weekday() > 4 or (cadence == "weekly" and d.weekday() != 4):
                continue
            days = [d + timedelta(j) for j in range(-4, 3)] if cadence == "weekly" else [d]
            held = [(r[2], r[3]) for r in rows if r[1] == key and r[2] in days and r[3] is not None]
            v = max(held)[1] if held else None
            last = v if v is not None else last
            expected[key, d] = (v, last, v is None)
    assert {k: (r["value"], r["filled"], r["missing"]) for k, r in got.items()} == expected


def test_grid_edges(spark):
    info = spark.createDataFrame([("t", "d", "daily", date(2021, 3, 1), date(2021, 3, 7))], INFO)
    got = regular_series(spark.createDataFrame([], READ), info).collect()
    assert len(got) == 5 and all(r["missing"] and r["filled"] is None for r in got)
    assert regular_series(spark.createDataFrame([("t", "d", date(2021, 3, 1), 1.0, None)], READ), info.limit(0)).count() == 0


def test_trailing_against_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for key in ("a", "b", None):
        for _ in range(200):
            rows.append(("t", key, date(2021, 1, 1) + timedelta(rng.randrange(300)), None if rng.random() < 0.1 else rng.randrange(-100, 100)))
    rows.append(("t", "a", None, 5))
    df = spark.createDataFrame(rows, "tab string, source_key string, day date, units long")
    got = {(r["source_key"], r["day"]): (r["total_7"], r["total_30"]) for r in trailing_totals(df).collect()}
    expected = {}
    for key in ("a", "b"):
        daily = defaultdict(int)
        days = [r[2] for r in rows if r[1] == key and r[2]]
        for r in rows:
            if r[1] == key and r[2]:
                daily[r[2]] += r[3] or 0
        d = min(days)
        while d <= max(days):
            expected[key, d] = tuple(sum(daily[d - timedelta(j)] for j in range(p)) for p in (7, 30))
            d += timedelta(1)
    assert got == expected
    assert trailing_totals(df.limit(0)).count() == 0
    r = trailing_totals(df.where("source_key = 'a'").limit(1)).first()
    assert r["average_7"] == pytest.approx(r["total_7"] / 7)
