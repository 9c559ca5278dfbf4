"""Structured Streaming over the observation log: replay-safe ingest, tumbling activity, running profiles.

Batch results are authoritative; each streaming query equals its batch twin once the input is exhausted,
as long as no event is later than the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_log(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 100) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def first_deliveries(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Each content once, with state bounded by the watermark. events: stream_id, identity_hash, ts
    (timestamp)."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["stream_id", "identity_hash"])


def tumbling_activity(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Count and mean confidence of each stream and category in windows aligned to the epoch."""
    return (
        events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "stream_id", "category")
        .agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"))
        .select(F.unix_millis("w.start").alias("start_ms"), "stream_id", "category", "n", F.round("mean_confidence", 9).alias("mean_confidence"))
    )


def sliding_activity(events: DataFrame, width: str = "7 days", slide: str = "1 day", late: str = "2 days") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, slide).alias("w"), "stream_id").agg(F.count("*").alias("n")).select(F.unix_millis("w.start").alias("start_ms"), "stream_id", "n")


def profiles(events: DataFrame) -> DataFrame:
    """Running count and newest time of each entity, for update mode."""
    return events.groupBy("entity").agg(F.count("*").alias("n"), F.max("ts").alias("newest"))


def append_ledger(path: str):
    """For foreachBatch: appends to the ledger at path the contents it does not hold. A batch that is
    delivered again adds nothing, so the ledger is exact over restarts."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.groupBy("stream_id", "identity_hash").agg(F.min("offset").alias("offset"))
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            new = new.join(spark.read.parquet(path).select("stream_id", "identity_hash"), ["stream_id", "identity_hash"], "left_anti")
        new.write.mode("append").parquet(path)

    return write


def drain(frame: DataFrame, table: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over what is there now, into an in-memory table."""
    frame.writeStream.format("memory").queryName(table).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
