"""Irregular readings onto a regular grid.

Each series' calendar is cut into time shards of whole weeks. Readings are first reduced to one value per slot, each
shard is summed up by its first and last reading, a scan over these summaries carries the last reading into later
shards, and all shards are then filled independently of each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def regular_series(readings: DataFrame, info: DataFrame, *, shard_weeks: int = 13) -> DataFrame:
    """One row per expected slot: tab, source_key, slot (DATE), value, filled, filled_from, missing.

    ``readings``: tab, source_key, date, value, seen_at (any order, copies welcome). ``info``: tab, source_key,
    cadence (daily or weekly), start_dt, end_dt. Daily slots are Mondays to Fridays, weekly slots the Fridays within the
    span. A weekly reading of any day of a Monday-to-Sunday week belongs to that week's Friday; weekend readings
    belong to no daily slot. Of several readings of a slot the one with the latest date, then the latest arrival, then
    the greatest value is taken. ``filled`` is the value or else the last earlier one of the series' span (null before
    the first), ``filled_from`` the slot that it comes from; a slot that is not filled from itself is ``missing``. Null or NaN values are no readings. Series with a null bound or another cadence have no slots;
    readings of series without info are left out; an empty table of readings leaves every slot missing.
    """
    value = F.col("value").cast("double")
    friday = lambda d: F.date_add(F.date_trunc("week", d).cast("date"), 4)
    days = (
        readings.where(value.isNotNull() & ~F.isnan(value) & F.col("date").isNotNull())
        .groupBy("tab", "source_key", F.col("date").cast("date").alias("date"))
        .agg(F.max(F.struct(F.coalesce("seen_at", F.lit(0).cast("timestamp")).alias("seen_at"), value.alias("value"))).alias("top"))
    )
    plan = info.where("cadence IN ('daily', 'weekly') AND start_dt IS NOT NULL AND end_dt IS NOT NULL AND start_dt <= end_dt").select("tab", "source_key", "cadence", "start_dt", "end_dt").distinct()
    monday = F.date_trunc("week", F.col("start_dt")).cast("date")
    # weeks since 1970 started on Mondays, 1969-12-29 being one
    shard_of = lambda d: F.floor(F.datediff(d, F.lit("1969-12-29").cast("date")) / (7 * shard_weeks)).cast("int")
    slots = (
        days.join(plan, ["tab", "source_key"])
        .withColumn("slot", F.when(F.col("cadence") == "weekly", friday(F.col("date"))).when(F.weekday("date") < 5, F.col("date")))
        .where("slot BETWEEN start_dt AND end_dt")
        .groupBy("tab", "source_key", "slot")
        .agg(F.max(F.struct("date", "top")).alias("best"))
        .select("tab", "source_key", shard_of(F.col("slot")).alias("shard"), "slot", F.col("best.top.value").alias("value"))
    )
    grid = (
        plan.withColumn("day", F.explode(F.sequence(monday, F.col("end_dt"))))
        .where("day >= start_dt")
        .where(F.when(F.col("cadence") == "weekly", F.weekday("day") == 4).otherwise(F.weekday("day") < 5))
        .select("tab", "source_key", F.col("day").alias("slot"), shard_of(F.col("day")).alias("shard"))
    )
    # first and last reading of each shard; the scan over a series' shards gives each its carry-in
    reading = F.struct("slot", "value")
    summary = slots.groupBy("tab", "source_key", "shard").agg(F.min(reading).alias("first"), F.max(reading).alias("last"))
    shards = grid.select("tab", "source_key", "shard").distinct()
    earlier = Window.partitionBy("tab", "source_key").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        shards.join(summary, ["tab", "source_key", "shard"], "left")
        .withColumn("carry", F.last("last", ignorenulls=True).over(earlier))
        .select("tab", "source_key", "shard", "carry", F.col("first.slot").alias("first_slot"))
    )
    here = Window.partitionBy("tab", "source_key", "shard").orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = (
        grid.join(slots, ["tab", "source_key", "shard", "slot"], "left")
        .join(carry, ["tab", "source_key", "shard"], "left")
        .withColumn("inside", F.last(F.when(F.col("value").isNotNull(), reading), ignorenulls=True).over(here))
        .withColumn("by", F.when(F.col("first_slot").isNull() | (F.col("slot") < F.col("first_slot")), F.col("carry")).otherwise(F.col("inside")))
    )
    return filled.select("tab", "source_key", "slot", "value", F.col("by.value").alias("filled"), F.col("by.slot").alias("filled_from"), (~F.col("by.slot").eqNullSafe(F.col("slot"))).alias("missing"))
