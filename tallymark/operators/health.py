"""Health of streams and sources. ``now`` is always a parameter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import bounded_rate, clamp

HOUR_MS = 3_600_000


def stream_health(obs: DataFrame, as_of_ms: int, streams: DataFrame | None = None) -> DataFrame:
    """A row for each stream. streams: stream_id; those without observations are stale."""
    x = obs.groupBy("stream_id").agg(
        F.count("*").alias("events"), F.min("confidence").alias("lowest"), F.max("confidence").alias("highest"), F.avg("confidence").alias("average"),
        F.count_if(F.col("confidence") < 0.5).alias("low"), F.count_if(F.col("confidence") >= 0.85).alias("high"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"))
    if streams is not None:
        x = streams.select("stream_id").join(x, "stream_id", "left").na.fill(0, ["events", "low", "high"])
    hours = F.greatest(F.lit(1.0), (F.col("last_ms") - F.col("first_ms")) / 1000.0) / 3600
    stale = (F.col("events") == 0) | (as_of_ms - F.col("last_ms") > 24 * HOUR_MS)
    x = x.withColumn("per_hour", F.when(F.col("events") >= 2, F.col("events") / hours).otherwise(F.col("events").cast("double"))).withColumn("stale", stale)
    severity = F.when(F.col("stale") | F.col("average").isNull() | (F.col("average") < 0.35), "high").when(F.col("low") / F.col("events") > 0.4, "medium").otherwise("info")
    x = x.withColumn("severity", severity)
    x = x.withColumn("alert", (F.col("severity") != "info") | F.col("stale") | (F.col("low") > 0))
    return x.withColumn("alert_confidence", F.when(F.col("average").isNull(), F.lit(0.5)).otherwise(clamp(1 - F.col("low") / F.col("events"), 0.1, 1)))


def job_health(jobs: DataFrame) -> DataFrame:
    """What an ingest job says of its source. jobs: job_id, connector_id, status, started_ms,
    completed_ms, fetched, failed, deduplicated. Nothing fetched leaves rates unknown."""
    state = F.when(F.col("status") == "completed", F.when(F.col("failed") > 0, "degraded").otherwise("healthy")).when(F.col("status") == "partial", "degraded").when(F.col("status") == "failed", "failing").otherwise("unknown")
    return jobs.select(
        "job_id", "connector_id", F.coalesce("completed_ms", "started_ms").alias("observed_ms"), state.alias("health"),
        F.when(F.col("completed_ms") >= F.col("started_ms"), F.col("completed_ms") - F.col("started_ms")).alias("latency_ms"),
        F.round(bounded_rate(F.col("failed"), F.col("fetched")), 6).alias("error_rate"), F.round(bounded_rate(F.col("deduplicated"), F.col("fetched")), 6).alias("duplicate_rate"),
        F.lit("unknown").alias("freshness"), F.lit("unknown").alias("schema_state"))


def latest(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key by order."""
    w = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_i", F.row_number().over(w)).where("_i = 1").drop("_i")


def readiness(connectors: DataFrame, health: DataFrame, schemas: DataFrame) -> DataFrame:
    """connector_id, readiness: the first that holds of not_active, unknown, blocked, ready, degraded.
    connectors: connector_id, active; health: connector_id, health, freshness, schema_state (latest);
    schemas: connector_id, schema_active."""
    x = connectors.join(schemas, "connector_id", "left").join(health, "connector_id", "left")
    ladder = (
        F.when(~F.col("active") | ~F.coalesce("schema_active", F.lit(False)), "not_active")
        .when(F.col("health").isNull(), "unknown")
        .when(F.col("health").isin("failing", "paused", "retired") | (F.col("schema_state") == "breaking_change"), "blocked")
        .when((F.col("health") == "healthy") & (F.col("freshness") == "fresh") & (F.col("schema_state") == "stable"), "ready")
        .otherwise("degraded")
    )
    return x.withColumn("readiness", ladder)


def run_outcome(before, after, ok):
    """Of an adapter run, by how many events its stream gained."""
    gained = after - before
    return F.when(~ok, "failed").when(gained > 0, "productive").when(after > 0, "no_change").otherwise("zero")
