"""Mixed time notations to UTC instants.

A batch of texts becomes one array of characters, in which blanks and full-width forms are dealt with and every
character is reduced to its class (digits to 9, letters to a). Texts of one length are a matrix; equal rows of classes
are one mask. Each distinct mask is mapped to a parser once per worker, and all texts of one mask are converted
together. Wall-clock times go
through transition tables of their zone, built on the driver from one version of the zone database and shipped with
the function, so that all executors convert alike.
"""

from __future__ import annotations

import re
import zoneinfo
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Full-width forms U+FF01..U+FF5E stand 0xFEE0 above their ASCII characters.
_NARROW = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)} | {0x3000: 0x20, 0xA0: 0x20}
_CLASSES = {ord(c): "9" for c in "0123456789"} | {ord(c): "a" for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"}

_DATE = (
    r"(?:(?P<y1>9999)(?P<sep>[-./])(?P<m1>99?)(?P=sep)(?P<d1>99?)"
    r"|(?P<y2>9999)年(?P<m2>99?)月(?P<d2>99?)日"
    r"|(?P<p>99?)(?P<sep2>[-./])(?P<q>99?)(?P=sep2)(?P<y3>9999)"
    r"|(?P<d4>99?)[ -](?P<mon4>aaa+)\.?,?[ -](?P<y4>9999)"
    r"|(?P<mon5>aaa+)\.? (?P<d5>99?),? (?P<y5>9999)"
    r"|(?P<y6>9999)(?P<m6>99)(?P<d6>99))"
)
_TIME = r"(?:(?P<h1>99?):(?P<n1>99)(?::(?P<s1>99)(?:[.,](?P<f1>9+))?)?|(?P<h2>99)(?P<n2>99)(?:(?P<s2>99)(?:[.,](?P<f2>9+))?)?)"
_ZONE = r"(?: ?(?P<half>aa)(?![a_/]))?(?: ?(?P<z>a)| ?(?P<sign>[-+])(?P<oh>99):?(?P<om>99)?| \(?(?P<name>[a_]+(?:/[a_]+)+)\)?| \(?(?P<abbr>aaa+)\)?)?"
_SHAPE = re.compile(f"{_DATE}(?:,? +|a|(?<=日)|(?<=99999999)){_TIME}{_ZONE}")
# A count since 1970 has 10 digits in seconds, 13 in milliseconds, 16 in microseconds.
_EPOCHS = {"9" * 10: 1_000_000, "9" * 13: 1_000, "9" * 16: 1}


def tidy(text: str) -> str:
    """Without blanks around it, and with full-width punctuation and digits as ASCII."""
    return (text if text.isascii() else text.translate(_NARROW)).strip()


def mask(text: str) -> str:
    """The character-class mask of a tidied text."""
    return text.translate(_CLASSES)


@dataclass(frozen=True)
class Zone:
    """Transitions of one zone in seconds: ``offsets[i]`` and ``names[i]`` hold from ``starts[i - 1]`` to ``starts[i]``."""

    starts: np.ndarray
    offsets: np.ndarray
    names: np.ndarray


def zone_version() -> str:
    """The release of the zone database in use."""
    for root in map(Path, zoneinfo.TZPATH):
        if (at := root / "tzdata.zi").exists():
            return at.open().readline().split()[-1]
    try:
        import tzdata

        return str(tzdata.IANA_VERSION)
    except ImportError:
        return "unknown"


# The Gregorian calendar repeats after 400 years (a whole number of weeks), and so do the rules of every zone.
_CYCLE = 146_097 * 86_400
_FIRST, _AHEAD, _LAST = (int(datetime(y, 1, 1, tzinfo=UTC).timestamp()) for y in (1800, 2101, 2502))


@lru_cache(maxsize=1024)
def zone_table(name: str, version: str) -> Zone | None:
    """The table of a zone from 1800, before its first transition, to 2501; later times repeat the last 400 years of it
    (``to_instant``). None for an unknown name."""
    try:
        zone = zoneinfo.ZoneInfo(name)
    except (ValueError, OSError, zoneinfo.ZoneInfoNotFoundError):
        return None
    epoch = datetime(1970, 1, 1, tzinfo=UTC)

    def at(s: int) -> tuple[int, str]:
        t = (epoch + timedelta(seconds=s)).astimezone(zone)
        return int(t.utcoffset().total_seconds()), t.tzname()

    step, s = 7 * 86_400, _FIRST
    now = at(s)
    starts, kinds = [], [now]
    while s < _LAST:
        if (then := at(s + step)) != now:
            lo, hi = s, s + step
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if at(mid) == now else (lo, mid)
            starts.append(hi)
            now = at(hi)
            kinds.append(now)
            s = hi if now != then else s + step
        else:
            s += step
    return Zone(np.array(starts, dtype=np.int64), np.array([k[0] for k in kinds], dtype=np.int64), np.array([k[1].upper() for k in kinds], dtype=object))


def zone_tables(names: list[str]) -> dict[str, Zone]:
    version = zone_version()
    return {n: z for n in names if (z := zone_table(n, version))}


def to_instant(wall: np.ndarray, zone: Zone, abbr: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """UTC seconds of wall-clock seconds, and which of them exist.

    Twice-occurring times give the earlier instant unless ``abbr`` is the abbreviation of the later one only. Times from
    2501 on are looked up whole cycles of 400 years earlier.
    """
    cycles = np.maximum((wall - _AHEAD) // _CYCLE, 0)
    wall = wall - cycles * _CYCLE
    before = np.searchsorted(zone.starts, wall - 16 * 3600, side="right")
    after = np.searchsorted(zone.starts, wall + 16 * 3600, side="right")
    first = np.full(len(wall), np.iinfo(np.int64).max)
    last = np.full(len(wall), np.iinfo(np.int64).min)
    # segments that may hold the time: those between the two, seldom more than two
    for k in range(int((after - before).max()) + 1 if len(wall) else 0):
        seg = np.minimum(before + k, after)
        utc = wall - zone.offsets[seg]
        ok = np.searchsorted(zone.starts, utc, side="right") == seg
        first = np.where(ok, np.minimum(first, utc), first)
        last = np.where(ok, np.maximum(last, utc), last)
    exists = first <= last
    out = first.copy()
    if abbr is not None and (twice := exists & (first < last)).any():
        i = np.flatnonzero(twice)
        names = lambda u: zone.names[np.searchsorted(zone.starts, u[i], side="right")]
        out[i] = np.where((abbr[i] == names(last)) & (abbr[i] != names(first)), last[i], first[i])
    return np.where(exists, out + cycles * _CYCLE, out), exists


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Days since 1970 in the Gregorian calendar, and which dates are possible."""
    ok = (y >= 1) & (m >= 1) & (m <= 12) & (d >= 1)
    m_, y_ = np.where(ok, m, 1), np.where(ok, y, 1970)
    first = (y_ - 1970).astype("datetime64[Y]").astype("datetime64[M]") + (m_ - 1).astype("timedelta64[M]")
    start = first.astype("datetime64[D]").astype(np.int64)
    length = (first + np.timedelta64(1, "M")).astype("datetime64[D]").astype(np.int64) - start
    return start + d - 1, ok & (d <= length)


Parser = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None]]


@lru_cache(maxsize=100_000)
def parser_for(shape: str) -> Parser | None:
    """The parser of a mask, or None if the mask gives no instant.

    A parser takes the characters (rows x length) and day_first (0, 1 or -1 for unknown); it returns microseconds,
    which rows are possible, offset seconds (None: wall clock) and the abbreviation (None: none).
    """
    if shape in _EPOCHS:
        unit = _EPOCHS[shape]

        def epoch(c: np.ndarray, _: np.ndarray):
            us = _number(c, (0, c.shape[1])) * unit
            return us, np.ones(len(c), dtype=bool), np.zeros(len(c), dtype=np.int64), None

        return epoch
    m = _SHAPE.fullmatch(shape)
    if not m:
        return None
    at = {k: m.span(k) for k, v in m.groupdict().items() if v is not None}
    pick = lambda *names: next((at[n] for n in names if n in at), None)

    def parse(c: np.ndarray, day_first: np.ndarray):
        year = _number(c, pick("y1", "y2", "y3", "y4", "y5", "y6"))
        ok = np.ones(len(c), dtype=bool)
        if "p" in at:
            p, q = _number(c, at["p"]), _number(c, at["q"])
            month, day = np.where(day_first == 1, q, p), np.where(day_first == 1, p, q)
            ok &= day_first >= 0
        else:
            day = _number(c, pick("d1", "d2", "d4", "d5", "d6"))
            if word := pick("mon4", "mon5"):
                texts = np.char.lower(_text(c, word))
                month = np.zeros(len(c), dtype=np.int64)
                for text in np.unique(texts):
                    full = next((i for i, name in enumerate(_MONTH_NAMES, 1) if text == name or (text[:3] == name[:3] and text in (name[:3], name[:4]))), 0)
                    month[texts == text] = full
            else:
                month = _number(c, pick("m1", "m2", "m6"))
        days, fine = _days(year, month, day)
        ok &= fine
        hour, minute = _number(c, pick("h1", "h2")), _number(c, pick("n1", "n2"))
        second = _number(c, s) if (s := pick("s1", "s2")) else np.zeros(len(c), dtype=np.int64)
        if "half" in at:
            half = np.char.lower(_text(c, at["half"]))
            ok &= np.isin(half, ("am", "pm")) & (hour >= 1) & (hour <= 12)
            hour = hour % 12 + 12 * (half == "pm")
        ok &= (hour <= 23) & (minute <= 59) & (second <= 59)
        us = ((days * 24 + hour) * 60 + minute) * 60 + second
        us = us * 1_000_000
        if f := pick("f1", "f2"):
            digits = min(f[1] - f[0], 6)
            us = us + _number(c, (f[0], f[0] + digits)) * 10 ** (6 - digits)
        offset = abbr = None
        if "z" in at:
            ok &= np.char.lower(_text(c, at["z"])) == "z"
            offset = np.zeros(len(c), dtype=np.int64)
        elif "sign" in at:
            oh, om = _number(c, at["oh"]), _number(c, at["om"]) if "om" in at else 0
            ok &= (oh <= 23) & (om <= 59)
            offset = (oh * 3600 + om * 60) * np.where(c[:, at["sign"][0]] == ord("-"), -1, 1)
        elif "abbr" in at:
            abbr = np.char.upper(_text(c, at["abbr"])).astype(object)
        return us, ok, offset, abbr

    return parse


# English month names, lower case.
_MONTH_NAMES = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def _number(c: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    out = np.zeros(len(c), dtype=np.int64)
    for i in range(*span):
        out = out * 10 + (c[:, i].astype(np.int64) - 48)
    return out


def _text(c: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    part = np.ascontiguousarray(c[:, span[0] : span[1]])
    return part.view(f"U{span[1] - span[0]}").ravel()


@lru_cache(maxsize=1)
def _character_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For code points below 0x10000: itself without full width, whether it is blank, and its class."""
    narrow = np.arange(0x10000, dtype=np.uint32)
    for c, to in _NARROW.items():
        narrow[c] = to
    blank = np.array([chr(c).isspace() for c in range(0x10000)])[narrow]
    kind = narrow.copy()
    for c, to in _CLASSES.items():
        kind[c] = ord(to)
    return narrow, blank, kind


def masks(texts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, str]]:
    """(row numbers, their characters as a matrix, mask) for each distinct mask; null and blank texts come under none.

    Same as ``tidy`` and ``mask`` of each text, for all texts at once."""
    narrow, blank, kind = _character_tables()
    rows = np.flatnonzero(~pd.isna(texts))
    held = texts[rows].tolist()
    ends = np.cumsum(np.fromiter(map(len, held), dtype=np.int64, count=len(held)))
    cp = np.frombuffer("".join(held).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    small = np.minimum(cp, 0xFFFF)
    solid = np.flatnonzero(~blank[small])
    cp = np.where(cp < 0x10000, narrow[small], cp)
    starts = np.append(0, ends[:-1]) if len(ends) else ends
    lo, hi = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    some = np.flatnonzero(hi > lo)
    start, length = solid[lo[some]], solid[hi[some] - 1] + 1 - solid[lo[some]]
    with np.errstate(over="ignore"):
        for size in np.unique(length):
            own = np.flatnonzero(length == size)
            c = cp[start[own][:, None] + np.arange(size)]
            classes = np.where(c < 0x10000, kind[np.minimum(c, 0xFFFF)], c)
            odd = (np.arange(size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            h = ((classes.astype(np.uint64) + np.uint64(1)) * (odd ^ (odd >> np.uint64(29)))).sum(axis=1, dtype=np.uint64)
            left = np.arange(len(own))
            while len(left):  # once, unless two masks share a hash
                _, at, code = np.unique(h[left], return_index=True, return_inverse=True)
                same = (classes[left] == classes[left[at]][code]).all(axis=1)
                order = np.argsort(code[same], kind="stable")
                bounds = np.searchsorted(code[same][order], np.arange(len(at) + 1))
                for k, one in enumerate(at):
                    pick = left[same][order[bounds[k] : bounds[k + 1]]]
                    yield rows[some[own[pick]]], c[pick], "".join(map(chr, classes[left[one]]))
                left = left[~same]


def instants(texts: pd.Series, zones: pd.Series, day_first: pd.Series, tables: dict[str, Zone]) -> pd.Series:
    """UTC microseconds of each text, null where it gives no instant."""
    out = np.zeros(len(texts), dtype=np.int64)
    good = np.zeros(len(texts), dtype=bool)
    first = day_first.map({True: 1, False: 0}).fillna(-1).to_numpy().astype(np.int64)
    zone_of, zone_names = pd.factorize(zones)
    for i, c, shape in masks(texts.to_numpy(dtype=object)):
        if (parse := parser_for(shape)) is None:
            continue
        us, ok, offset, abbr = parse(c, first[i])
        if offset is not None:
            us = us - offset * 1_000_000
        else:
            done = np.zeros(len(i), dtype=bool)
            for z, name in enumerate(zone_names):
                if name in tables and (at := np.flatnonzero((zone_of[i] == z) & ok)).size:
                    utc, exists = to_instant(us[at] // 1_000_000, tables[name], None if abbr is None else abbr[at])
                    us[at] = np.where(exists, utc * 1_000_000 + us[at] % 1_000_000, 0)
                    done[at] = exists
            ok = ok & done
        out[i], good[i] = us, ok
    return pd.Series(pd.arrays.IntegerArray(out, ~good))


def utc_micros(tables: dict[str, Zone]) -> Callable[[Column, Column, Column], Column]:
    """Column function (text, zone name, day_first) -> BIGINT microseconds since 1970 UTC."""

    @F.pandas_udf("long")
    def convert(text: pd.Series, zone: pd.Series, day_first: pd.Series) -> pd.Series:
        return instants(text, zone, day_first, tables)

    return convert


def normalise_times(df: DataFrame, text: str, feed: str, feeds: DataFrame, out: str = "utc_us", most_zones: int = 2000) -> DataFrame:
    """``df`` with ``out``, the UTC microseconds of column ``text``; null where the text gives no instant.

    ``feeds`` (feed, tz, day_first) names each feed's home zone and date order. Texts with an offset, Z, or that count
    from 1970 need no feed; wall-clock texts of an unknown feed or zone, impossible dates, gaps, texts without date or
    time, empty and null texts give null. The zones named by ``feeds`` (at most the few hundred of the zone database;
    ``most_zones`` guards that) get their tables on the driver. An empty table stays empty; other columns pass through.
    """
    names = [r[0] for r in feeds.select("tz").where("tz IS NOT NULL").distinct().limit(most_zones + 1).collect()]
    if len(names) > most_zones:
        raise ValueError(f"more than {most_zones} distinct zone names")
    convert = utc_micros(zone_tables(sorted(names)))
    home = feeds.where("feed IS NOT NULL").groupBy(F.col("feed").alias("__feed")).agg(F.min("tz").alias("__tz"), F.min("day_first").alias("__day_first"))
    joined = df.join(home, df[feed] == F.col("__feed"), "left")
    return joined.withColumn(out, convert(df[text], F.col("__tz"), F.col("__day_first"))).drop("__feed", "__tz", "__day_first")
