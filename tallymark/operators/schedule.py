"""What runs when: late data under a fixed time, adapters that are due, one run of each at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import time_bucket


def as_of_activity(events: DataFrame, as_of_ms: int, bucket_ms: int) -> DataFrame:
    """stream_id, start_ms, n, late: events up to ``as_of_ms`` by time bucket, whenever they came in; late says how
    many came after that time. No event is dropped for being late: the fixed time pins the result."""
    x = events.where(F.col("ts_ms") <= as_of_ms)
    start = (time_bucket(F.col("ts_ms"), bucket_ms) * bucket_ms).alias("start_ms")
    return x.groupBy("stream_id", start).agg(F.count("*").alias("n"), F.count_if(F.col("ingested_ms") > as_of_ms).alias("late"))


def due(adapters: DataFrame, runs: DataFrame, now_ms: int, up_ms: int) -> DataFrame:
    """adapter, last_ms, next_ms, running, due. An adapter that never ran is due after its first delay from
    ``up_ms`` on; others an interval after their last start; none while a run of it goes on. adapters: adapter,
    interval_hours, delay_s; runs: adapter, started_ms, completed_ms (null while running)."""
    last = runs.where(F.col("started_ms") <= now_ms).groupBy("adapter").agg(F.max("started_ms").alias("last_ms"), F.bool_or(F.col("completed_ms").isNull()).alias("running"))
    x = adapters.join(last, "adapter", "left").withColumn("running", F.coalesce("running", F.lit(False)))
    x = x.withColumn("next_ms", F.coalesce(F.col("last_ms") + F.col("interval_hours") * 3_600_000, F.lit(up_ms) + F.col("delay_s") * 1000).cast("long"))
    return x.select("adapter", "last_ms", "next_ms", "running", (~F.col("running") & (F.col("next_ms") <= now_ms)).alias("due"))


def claimed(wanted: DataFrame, running: DataFrame) -> DataFrame:
    """wanted adapters that may start: one run each, none that runs already."""
    return wanted.dropDuplicates(["adapter"]).join(running.select("adapter").distinct(), "adapter", "left_anti")
