"""Round trips by interval overlap against lots matched one after the other."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest

from tidemark.operators import round_trips as T


def one_by_one(rows, gap=8 * 3600):
    """Blocks and trips by loops."""
    trips = []
    for symbol in {r[1] for r in rows if r[1] is not None}:
        blocks, last = [], None
        for ts, _, amount, price, seq in sorted((r for r in rows if r[1] == symbol), key=lambda r: (r[0], r[4])):
            side = amount > 0
            if last is None or side != last[1] or (ts - last[0]).total_seconds() > gap:
                blocks.append([ts, 0.0, 0.0])
            blocks[-1][1] += amount
            blocks[-1][2] += amount * price
            last = (ts, side)
        dts, amounts, prices = [b[0] for b in blocks], [round(b[1], 9) for b in blocks], [b[2] / b[1] if b[1] else None for b in blocks]
        for _, opened, closed, long, pnl, ret in T.match_lots(symbol, dts, amounts, prices)[0]:
            trips.append((symbol, closed, opened, long, round(pnl, 5), round(ret, 8)))
    return sorted(trips)


@pytest.mark.parametrize(("seed", "whole"), [(0, True), (1, True), (2, False)])
def test_round_trips_against_lots(spark, seed, whole):
    """Busy and quiet symbols, flips, blocks over month ends, ties of ts, prices that do not count."""
    rng = random.Random(seed)
    rows, at = [], defaultdict(lambda: datetime(2021, 1, 25))
    for k in range(600):
        s = "hot" if rng.random() < 0.5 else rng.choice("abcd")
        at[s] += timedelta(hours=rng.choice([0, 0, 1, 6, 9, 30]))
        size = rng.randrange(1, 40) if whole else rng.randrange(1, 2000) / 64
        price = -1.0 if rng.random() < 0.02 else rng.randrange(10, 40) * 1.0
        rows.append((at[s], s, float(rng.choice([-1, 1]) * size), price, k))
    df = spark.createDataFrame([*rows, (datetime(2021, 1, 1), None, 1.0, 1.0, 9999)], "ts timestamp, symbol string, amount double, price double, seq long")
    got = sorted((r["symbol"], r["close_dt"], r["open_dt"], r["long"], round(r["pnl"], 5), round(r["rt_returns"], 8)) for r in T.round_trips(df, order="seq").collect())
    want = one_by_one(rows)
    assert len(want) > 50 and [w[:4] for w in want] == [g[:4] for g in got]
    assert [g[4:] for g in got] == [pytest.approx(w[4:], abs=2e-5) for w in want]


def test_round_trips_edges(spark):
    schema = "ts timestamp, symbol string, amount double, price double"
    assert T.round_trips(spark.createDataFrame([], schema)).count() == 0
    t = datetime(2021, 1, 1)
    open_only = spark.createDataFrame([(t, "a", 5.0, 1.0), (t + timedelta(days=1), "a", 5.0, 2.0), (t, "b", 0.0, 1.0), (t, "c", None, 1.0), (t, "d", 1.0, None)], schema)
    assert T.round_trips(open_only).count() == 0
    flip = spark.createDataFrame([(t, "a", 5.0, 10.0), (t + timedelta(days=1), "a", -8.0, 12.0), (t + timedelta(days=2), "a", 3.0, 11.0)], schema)
    got = sorted((r["long"], r["pnl"], r["open_dt"]) for r in T.round_trips(flip).collect())
    assert got == [(False, 3.0, t + timedelta(days=1)), (True, 10.0, t)]
    # one great lot against many small fills
    many = [(t, "a", 1000.0, 1.0)] + [(t + timedelta(days=k), "a", -1.0, 2.0) for k in range(1, 400)]
    trips = T.round_trips(spark.createDataFrame(many, schema))
    assert trips.count() == 399 and {r["open_dt"] for r in trips.collect()} == {t}
