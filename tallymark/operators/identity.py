"""Identity of observations: ledgers of content hashes, replay suppression, offsets.

Batch appends are joins and counts. Offsets of new rows are dense per stream without one task seeing a
whole stream: rows are ranked within hashed blocks, and blocks are offset by running block counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ledger(obs: DataFrame) -> DataFrame:
    """A row for each (stream, hash): canonical (first) offset, last offset, replays, first and last seen."""
    return obs.where("identity_hash is not null").groupBy("stream_id", "identity_hash").agg(
        F.min("offset").alias("canonical_offset"), F.max("offset").alias("last_offset"), (F.count("*") - 1).alias("replay_count"),
        F.min("ingested_ms").alias("first_seen_ms"), F.max("ingested_ms").alias("last_seen_ms"))


def ranked(obs: DataFrame) -> DataFrame:
    """Rows with their place among rows of their content, and how many there are."""
    w = W.partitionBy("stream_id", "identity_hash")
    return obs.select("stream_id", "offset", "identity_hash", F.row_number().over(w.orderBy("offset")).cast("long").alias("place"), F.count("*").over(w).alias("copies"), F.max("offset").over(w).alias("last_offset"))


def canonical(obs: DataFrame) -> DataFrame:
    """The first delivery of each content."""
    first = obs.groupBy("stream_id", "identity_hash").agg(F.min("offset").alias("offset"))
    return obs.join(first, ["stream_id", "identity_hash", "offset"], "left_semi")


def dense_offsets(rows: DataFrame, order: list[str], start: DataFrame | None = None, key: str = "stream_id", block: int = 100_000) -> DataFrame:
    """rows with ``new_offset``: dense per key in the order of the long column order[0] and the rest.
    start: key and next_offset where a key already has rows. Blocks are ranges of order[0]."""
    at = F.floor(F.col(order[0]) / block)
    counts = rows.groupBy(key, at.alias("_b")).agg(F.count("*").alias("_n"))
    before = counts.select(key, "_b", F.coalesce(F.sum("_n").over(W.partitionBy(key).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    x = rows.withColumn("_b", at).join(before, [key, "_b"])
    place = F.row_number().over(W.partitionBy(key, "_b").orderBy(*order)) - 1 + F.col("_before")
    if start is not None:
        x = x.join(start, key, "left")
        place = place + F.coalesce("next_offset", F.lit(0))
    return x.withColumn("new_offset", place).drop("_b", "_before", "next_offset")


def append_batch(batch: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a replay-safe append of batch does to a ledger: (rows to insert with their new offsets, the
    replays to count). known: stream_id, identity_hash, canonical_offset. Invalid rows (no stream, time or
    hash) are in neither."""
    good = batch.where("stream_id is not null and ts_ms is not null and identity_hash is not null")
    counts = good.groupBy("stream_id", "identity_hash").agg(F.count("*").alias("times"), F.min("offset").alias("offset"))
    seen = known.select("stream_id", "identity_hash", F.lit(True).alias("_seen"))
    marked = counts.join(seen, ["stream_id", "identity_hash"], "left")
    replays = marked.select("stream_id", "identity_hash", (F.col("times") - F.when(F.col("_seen"), 0).otherwise(1)).alias("replays")).where("replays > 0")
    new = good.join(marked.where("_seen is null").select("stream_id", "identity_hash", "offset"), ["stream_id", "identity_hash", "offset"], "left_semi")
    start = known.groupBy("stream_id").agg((F.max("canonical_offset") + 1).alias("next_offset"))
    return dense_offsets(new, ["offset", "identity_hash"], start), replays


def receipts(batch: DataFrame, inserted: DataFrame, replays: DataFrame) -> DataFrame:
    """stream_id, received, inserted, replayed, failed, status of an append."""
    got = batch.groupBy("stream_id").agg(F.count("*").alias("received"))
    a = inserted.groupBy("stream_id").agg(F.count("*").alias("inserted"))
    b = replays.groupBy("stream_id").agg(F.sum("replays").alias("replayed"))
    x = got.join(a, "stream_id", "left").join(b, "stream_id", "left").na.fill(0, ["inserted", "replayed"])
    x = x.withColumn("failed", F.col("received") - F.col("inserted") - F.col("replayed"))
    return x.withColumn("status", F.when(F.col("failed") == 0, "completed").when(F.col("failed") < F.col("received"), "partial").otherwise("failed"))
