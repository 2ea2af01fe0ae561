"""Attributes as known at event time.

Events and attribute changes are united, ordered by entity and availability time (changes before events of the same
time), and the best change so far is carried forward. A change is available once it is both known and in force.
Time is cut into shards; each shard starts from the carried state of all earlier ones, so an entity that holds a third
of all rows is spread over as many tasks as it has shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def attach_as_known(
    events: DataFrame,
    changes: DataFrame,
    *,
    event_id: str,
    event_entity: str,
    event_time: str,
    change_id: str,
    change_entity: str,
    in_force: str,
    known_at: str,
    value: str,
    shard_days: int = 7,
) -> DataFrame:
    """(event_id, change_id, value): for each event the change of its entity with a non-null ``value``, ``in_force``
    date not after the event's UTC date and ``known_at`` not after its time, that has the latest ``in_force``, among
    those the latest ``known_at``, and among ties the highest ``change_id``. Events without such a change give no row.

    Copies of an event count once. Rows with null entity, time or id are left out, as are changes whose ``value`` is
    null or NaN. Either table may be empty. Column names of the two tables may clash.
    """
    ev = events.select(
        F.col(event_entity).cast("string").alias("entity"),
        F.unix_micros(F.col(event_time)).alias("at"),
        F.lit(2).alias("rank"),
        F.col(event_id).cast("long").alias("event_id"),
        F.lit(None).cast("struct<dt:int,known:bigint,id:bigint,value:double>").alias("state"),
    ).where("entity IS NOT NULL AND at IS NOT NULL AND event_id IS NOT NULL")
    day_us = 86_400_000_000
    amount = F.col(value).cast("double")
    dt, known = F.unix_date(F.col(in_force).cast("date")), F.unix_micros(F.col(known_at))
    ch = (
        changes.where(amount.isNotNull() & ~F.isnan(amount))
        .select(F.col(change_entity).cast("string").alias("entity"), dt.alias("dt"), known.alias("known"), F.col(change_id).cast("long").alias("id"), amount.alias("value"))
        .where("entity IS NOT NULL AND dt IS NOT NULL AND known IS NOT NULL AND id IS NOT NULL")
        .select(
            "entity",
            F.greatest(F.col("dt").cast("long") * day_us, F.col("known")).alias("at"),
            F.lit(1).alias("rank"),
            F.lit(None).cast("long").alias("event_id"),
            F.struct("dt", "known", "id", "value").alias("state"),
        )
    )
    shard = F.floor(F.col("at") / F.lit(day_us * shard_days)).alias("shard")
    rows = ev.unionByName(ch).withColumn("shard", shard)
    # one row per entity and shard: its best change; a scan over these few rows gives each shard's starting state
    summary = rows.groupBy("entity", "shard").agg(F.max("state").alias("best"), F.max("event_id").alias("any_event"))
    earlier = Window.partitionBy("entity").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        summary.withColumn("state", F.max("best").over(earlier))
        .where("state IS NOT NULL AND any_event IS NOT NULL")
        .select("entity", F.lit(-(1 << 62)).cast("long").alias("at"), F.lit(0).alias("rank"), F.lit(None).cast("long").alias("event_id"), "state", "shard")
    )
    flow = Window.partitionBy("entity", "shard").orderBy("at", "rank", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = rows.unionByName(carried).withColumn("held", F.max("state").over(flow)).where("event_id IS NOT NULL AND held IS NOT NULL")
    return joined.groupBy("event_id").agg(F.max("held").alias("held")).select("event_id", F.col("held.id").alias("change_id"), F.col("held.value").alias("value"))
