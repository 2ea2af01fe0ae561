"""Rolling totals over trailing periods, days without activity included."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize


def trailing_totals(rows: DataFrame, *, periods: tuple[int, ...] = (7, 30), block_days: int = 64) -> DataFrame:
    """One row per source and calendar day from the source's first to its last row's day: tab, source_key, day (DATE),
    total_P and average_P (total / P days) for each period P.

    ``rows``: tab, source_key, day DATE, units BIGINT; a null ``units`` adds zero but counts as a row. Rows without
    source or day are left out; an empty table gives no rows.

    Rows are first summed by source and day, so a hot source costs no more than its calendar; the daily totals are written
    once, so that ``rows`` are read once for totals and calendar alike. The daily totals of one
    source and block of days are then brought together, exploded onto every day they influence, and pre-summed there,
    which leaves about one row per output day to shuffle; calendar rows with zero units join the same sum.
    """
    most = max(periods)
    held = rows.where("tab IS NOT NULL AND source_key IS NOT NULL AND day IS NOT NULL")
    daily = materialize(held.groupBy("tab", "source_key", "day").agg(F.coalesce(F.sum("units"), F.lit(0)).alias("units")), "daily")
    block = F.floor(F.unix_date("day") / block_days)
    near = daily.withColumn("block", block).repartition("tab", "source_key", "block")
    reach = F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("ahead")
    influence = near.select("tab", "source_key", "day", "units", reach).select(
        "tab",
        "source_key",
        F.date_add("day", F.col("ahead")).alias("day"),
        *(F.when(F.col("ahead") < p, F.col("units")).otherwise(F.lit(0)).alias(f"total_{p}") for p in periods),
    )
    spans = daily.groupBy("tab", "source_key").agg(F.min("day").alias("first"), F.max("day").alias("last"))
    calendar = spans.select("tab", "source_key", F.explode(F.sequence("first", "last")).alias("day"))
    sums = influence.groupBy("tab", "source_key", "day").agg(*(F.sum(f"total_{p}").alias(f"total_{p}") for p in periods))
    joined = calendar.join(sums, ["tab", "source_key", "day"], "left")
    totals = [F.coalesce(F.col(f"total_{p}"), F.lit(0)).alias(f"total_{p}") for p in periods]
    averages = [(F.coalesce(F.col(f"total_{p}"), F.lit(0)) / F.lit(p)).alias(f"average_{p}") for p in periods]
    return joined.select("tab", "source_key", "day", *totals, *averages)
