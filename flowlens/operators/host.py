"""Rates and alarms over counter samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK_US = 3_600_000_000


def counter_rates(
    samples: DataFrame, key: str, counters: Sequence[str], order: str = "sample_id", chunk_us: int = CHUNK_US
) -> DataFrame:
    """Per-second rate of each counter against the previous sample of the key.

    Neighbours are found inside hourly slices; the last sample of the slice before is carried
    on one row per slice. A time step of 0 or less counts as 0.1 s.
    """
    sliced = samples.withColumn("__c", F.expr(f"(ts_us - pmod(ts_us, {chunk_us})) DIV {chunk_us}"))
    state = F.struct("ts_us", order, *counters)
    inside = Window.partitionBy(key, "__c").orderBy("ts_us", order)
    local = sliced.withColumn("__prev", F.lag(state).over(inside))
    slices = sliced.groupBy(key, "__c").agg(F.max(state).alias("__last"))
    across = Window.partitionBy(key).orderBy("__c")
    carried = slices.select(key, "__c", F.lag("__last").over(across).alias("__before"))
    prev = F.coalesce("__prev", "__before")
    joined = local.join(carried, [key, "__c"]).withColumn("__p", prev)
    seconds = (F.col("ts_us") - F.col("__p.ts_us")) / 1e6
    step = F.when(seconds > 0, seconds).otherwise(0.1)
    rates = {
        f"{c}_rate": F.when(F.col("__p").isNotNull(), (F.col(c) - F.col("__p")[c]) / step) for c in counters
    }
    return joined.withColumns(rates).drop("__c", "__prev", "__before", "__p")


# Percentages above which a sample raises an alarm.
ALARM_LIMITS = {"cpu": 80.0, "memory": 85.0}


def alarms(samples: DataFrame, limits: Mapping[str, float] = ALARM_LIMITS) -> DataFrame:
    over = F.array_compact(F.array(*[F.when(F.col(c) > v, F.lit(c)) for c, v in limits.items()]))
    return samples.withColumn("alarm", F.explode(over))
