"""Annualisation factors and calendar buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Periods per year.
FACTORS = {"daily": 252, "weekly": 52, "monthly": 12, "quarterly": 4, "yearly": 1}
# Frequency aliases.
ALIASES = {"D": "daily", "W": "weekly", "M": "monthly", "ME": "monthly", "Q": "quarterly", "QE": "quarterly", "A": "yearly", "Y": "yearly", "YE": "yearly"}


def annualization_factor(period: str = "daily", annualization: float | None = None) -> float:
    """Periods per year; ``annualization`` overrides. ValueError for an unknown period."""
    if annualization is not None:
        return float(annualization)
    name = ALIASES.get(period, period)
    if name not in FACTORS:
        raise ValueError(f"Period cannot be '{period}'; it can be {', '.join(FACTORS)}")
    return float(FACTORS[name])


def bucket(period: str, dt: Column | str = "dt") -> list[Column]:
    """Grouping columns of a calendar period; weeks are calendar year x ISO week."""
    d = F.col(dt) if isinstance(dt, str) else dt
    year = F.year(d).alias("year")
    if period == "yearly":
        return [year]
    part = {"weekly": F.weekofyear(d), "monthly": F.month(d), "quarterly": F.quarter(d)}.get(period)
    if part is None:
        raise ValueError("convert_to must be weekly, monthly, quarterly or yearly")
    return [year, part.alias("part")]


def week_end(dt: Column | str = "dt") -> Column:
    """The Sunday that ends a date's week."""
    return F.next_day(F.date_sub(F.col(dt) if isinstance(dt, str) else dt, 1), "SUN")


def business_days(start: Column, end: Column) -> Column:
    """Mondays to Fridays from ``start`` to ``end``, both included."""

    def upto(d: Column) -> Column:
        # 1969-12-29 was a Monday: whole weeks hold five, the rest at most five
        n = F.datediff(d, F.lit("1969-12-29").cast("date")) + 1
        return F.floor(n / 7) * 5 + F.least(F.pmod(n, F.lit(7)), F.lit(5))

    return (upto(end) - upto(F.date_sub(start, 1))).cast("int")
