from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.operators.timestamps import instants, mask, masks, normalise_times, parser_for, tidy, zone_tables

ZONES = ["America/New_York", "Europe/London", "Asia/Kolkata", "Australia/Sydney", "America/St_Johns", "UTC"]
TABLES = zone_tables(ZONES)


def at(text, zone="Europe/London", day_first=True):
    v = instants(pd.Series([text]), pd.Series([zone]), pd.Series([day_first]), TABLES)[0]
    return None if pd.isna(v) else int(v)


def us(*args):
    return int(datetime(*args, tzinfo=timezone.utc).timestamp()) * 1_000_000


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("2021-01-04T11:30:07.690+05:30", us(2021, 1, 4, 6, 0, 7) + 690_000),
        ("2021-01-04t11:30:07.690+0530", us(2021, 1, 4, 6, 0, 7) + 690_000),
        ("20210104T101234-0500", us(2021, 1, 4, 15, 12, 34)),
        ("2021-01-04 10:12:34Z", us(2021, 1, 4, 10, 12, 34)),
        ("1609742875", 1609742875 * 10**6),
        ("1609712843648", 1609712843648 * 10**3),
        ("1609712843648143", 1609712843648143),
        ("04/01/2021 01:13:56 PM", us(2021, 1, 4, 13, 13, 56)),
        ("04/01/2021 12:13:56 AM", us(2021, 1, 4, 0, 13, 56)),
        ("04/01/2021 13:13:56 PM", None),
        ("  2021-07-01 12：00：00\t", us(2021, 7, 1, 11)),
        ("2021年7月1日 12:00:00", us(2021, 7, 1, 11)),
        ("1 Jul 2021 12:00:00 +0200", us(2021, 7, 1, 10)),
        ("1 July 2021 12:00:00 +0200", us(2021, 7, 1, 10)),
        ("01.07.2021 12:00", us(2021, 7, 1, 11)),
        ("2021.07.01 12:00", us(2021, 7, 1, 11)),
        ("20210701120000", us(2021, 7, 1, 11)),
        ("2021-07-01 12:00:00,250", us(2021, 7, 1, 11) + 250_000),
        ("2021-07-01 12:00:00 Europe/London", us(2021, 7, 1, 11)),
        ("2021-07-01 12:00:00 BST", us(2021, 7, 1, 11)),
        ("2021-10-31 01:30:00", us(2021, 10, 31, 0, 30)),
        ("2021-10-31 01:30:00 BST", us(2021, 10, 31, 0, 30)),
        ("2021-10-31 01:30:00 GMT", us(2021, 10, 31, 1, 30)),
        ("2021-03-28 01:30:00", None),
        ("2021-02-29 01:30:00", None),
        ("2021-13-01 01:30:00", None),
        ("2021-01-01 24:00:00", None),
        ("2021-01-01 10:62:00", None),
        ("0000-00-00 00:48:00", None),
        ("2021-01-01", None),
        ("00:23:03", None),
        ("2021-01-17T23:", None),
        ("", None),
        (" ", None),
        ("0", None),
        ("N/A", None),
        ("未知", None),
        (None, None),
    ],
)
def test_notations(text, expected):
    assert at(text) == expected


def test_day_order():
    assert at("04/01/2021 10:00:00", "UTC", True) == us(2021, 1, 4, 10)
    assert at("04/01/2021 10:00:00", "UTC", False) == us(2021, 4, 1, 10)
    assert at("04/01/2021 10:00:00", "UTC", None) is None


@given(st.integers(-500_000_000, 2_000_000_000), st.sampled_from(ZONES))
@settings(max_examples=300, deadline=None)
def test_wall_clock_agrees_with_the_zone_rules(seconds, zone):
    wall = datetime(1970, 1, 1) + timedelta(seconds=seconds)
    first = wall.replace(tzinfo=ZoneInfo(zone), fold=0).astimezone(timezone.utc)
    there = first.astimezone(ZoneInfo(zone)).replace(tzinfo=None) == wall
    expected = int(first.timestamp()) * 1_000_000 if there else None
    assert at(wall.strftime("%Y-%m-%d %H:%M:%S"), zone) == expected


def test_parser_is_built_once_per_mask():
    parser_for.cache_clear()
    texts = [f"2021-01-{d:02d} 10:00:{s:02d}" for d in range(1, 29) for s in range(60)]
    instants(pd.Series(texts), pd.Series(["UTC"] * len(texts)), pd.Series([True] * len(texts)), TABLES)
    assert parser_for.cache_info().misses == 1
    assert mask(tidy("　2021-01-04 10：00 ")) == "9999-99-99 99:99"


def test_frame(spark):
    rows = [(1, "2021-07-01 12:00", "a", "clash"), (2, "2021-07-01 12:00", "nowhere", ""), (3, None, "a", ""), (4, "1609742875", None, ""), (5, "x" * 200_000, "a", "")]
    df = spark.createDataFrame(rows, "id long, text string, feed string, tz string")
    feeds = spark.createDataFrame([("a", "America/New_York", False), ("b", "Not/AZone", True)], "feed string, tz string, day_first boolean")
    got = {r["id"]: r["utc_us"] for r in normalise_times(df, "text", "feed", feeds).collect()}
    assert got == {1: us(2021, 7, 1, 16), 2: None, 3: None, 4: 1609742875 * 10**6, 5: None}
    out = normalise_times(df.limit(0), "text", "feed", feeds)
    assert out.count() == 0 and out.columns == ["id", "text", "feed", "tz", "utc_us"]


TEXTS = ["2021-01-04 10:12:34", " 2021-01-04 10:12:34\t", "２０２１-01-04 10：12：34", "a\U0001f600b", "　x ", "", "  ", None, "1609742875", "年" * 3, "Z" * 70, "4 Jan 2021 10:12:34 +0000"]


def test_masks_of_a_batch_are_those_of_each_text():
    """The vectorised masks are ``mask(tidy(text))``, each row once, blanks and nulls under none."""
    got = {}
    for rows, chars, shape in masks(np.array(TEXTS * 3, dtype=object)):
        for r, c in zip(rows, chars, strict=True):
            assert r not in got
            got[int(r)] = ("".join(map(chr, c)), shape)
    assert got == {i: (tidy(t), mask(tidy(t))) for i, t in enumerate(TEXTS * 3) if t and tidy(t)}
    assert list(masks(np.array([], dtype=object))) == []


@pytest.mark.parametrize("name", ["Europe/Berlin", "America/New_York", "Australia/Sydney", "America/St_Johns"])
def test_rules_go_on_for_ever(name):
    """Far years follow the zone's rules; so do the years before its first transition."""
    tables = zone_tables([name])
    for year in (1850, 1890, 2099, 2100, 2101, 2150, 2400, 2501, 2502, 2999, 9998):
        for month in (1, 4, 7, 10, 12):
            wall = datetime(year, month, 1, 12)
            v = instants(pd.Series([wall.strftime("%Y-%m-%d %H:%M:%S").rjust(19, "0")]), pd.Series([name]), pd.Series([True]), tables)[0]
            assert v == int(wall.replace(tzinfo=ZoneInfo(name)).timestamp()) * 1_000_000, (year, month)
