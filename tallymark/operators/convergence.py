"""Convergence of signals by geography: deduplication, activity, and how unlikely the count is under an
area-weighted Poisson model. Every geography of the registry gets a row; what cannot be computed is
null and says why.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import half_up, recency, time_bucket
from ..tables import joined_hash


def fingerprinted(signals: DataFrame, bucket_ms: int, extra: tuple[str, ...] = ()) -> DataFrame:
    return signals.withColumn("fingerprint", joined_hash(F.col("signal_type"), F.col("geography"), time_bucket(F.col("ts_ms"), bucket_ms), *map(F.col, extra)))


def deduplicated(signals: DataFrame) -> DataFrame:
    """The strongest signal of each fingerprint: highest confidence, null as -1, then smallest id."""
    best = signals.groupBy("fingerprint").agg(F.min(F.struct((-F.coalesce("confidence", F.lit(-1.0))).alias("c"), "id")).alias("_b"))
    return signals.join(best.select("fingerprint", F.col("_b.id").alias("id")), ["fingerprint", "id"], "left_semi").dropDuplicates(["fingerprint"])


def window_errors(signals: DataFrame, as_of_ms: int, window_ms: int) -> DataFrame:
    """signals with ``error``: what lies outside the closed window is an error of the caller, not a row
    to leave out silently."""
    why = F.when(F.col("ts_ms").isNull(), "missing_timestamp").when(F.col("ts_ms") > as_of_ms, "after_as_of").when(F.col("ts_ms") < as_of_ms - window_ms, "before_window")
    return signals.withColumn("error", why)


def convergence(signals: DataFrame, registry: DataFrame, as_of_ms: int, window_ms: int, least: int = 2, threshold: float = 0.0) -> DataFrame:
    """A row for each geography of registry (geography, area; one level alone). signals: id, geography,
    signal_type, ts_ms, confidence, fingerprint."""
    by_type = signals.groupBy("geography", "signal_type").agg(F.count("*").alias("n"))
    raw = by_type.groupBy("geography").agg(
        F.sum("n").alias("raw_count"), F.count("*").alias("distinct_types"), F.min(F.struct((-F.col("n")).alias("n"), "signal_type"))["signal_type"].alias("dominant_type"))
    unique = deduplicated(signals)
    dedup = unique.groupBy("geography").agg(F.count("*").alias("signal_count"), F.avg("confidence").alias("mean_confidence"), F.max("ts_ms").alias("newest_ms"))
    everywhere = registry.agg(F.sum("area").alias("total_area"))
    total = dedup.agg(F.sum("signal_count").alias("total_count"))
    x = registry.join(raw, "geography", "left").join(dedup, "geography", "left").crossJoin(F.broadcast(everywhere)).crossJoin(F.broadcast(total))
    x = x.na.fill(0, ["raw_count", "distinct_types", "signal_count"])
    r = recency(as_of_ms, F.col("newest_ms"), window_ms)
    score = F.col("distinct_types") * F.col("mean_confidence") * F.log(F.col("signal_count") + F.lit(1.0)) * (0.5 + 0.5 * r)
    expected = F.coalesce("total_count", F.lit(0)) / F.col("total_area") * F.col("area")
    few = F.col("signal_count") < least
    known = F.col("total_count") > 0
    z = F.when(~few & known & (expected > 0), (F.col("signal_count") - expected) / F.sqrt(expected))
    status = F.when(few, "below_threshold").when(known, "resolved").otherwise("unresolved")
    x = x.select(
        "geography", status.alias("status"), "raw_count", "signal_count", "distinct_types", "dominant_type", half_up(F.col("mean_confidence"), 12).alias("mean_confidence"),
        half_up(r, 12).alias("recency"), half_up(score, 12).alias("score"), half_up(expected, 12).alias("expected"), half_up(z, 12).alias("z_score"))
    return x.withColumn("detected", F.coalesce((F.col("status") == "resolved") & (F.col("z_score") >= threshold), F.lit(False)))


def receipts(results: DataFrame, run_key: str, population_hash: str) -> DataFrame:
    """A receipt for each geography; the population is hashed once, not once a geography."""
    body = joined_hash(*(F.col(c) for c in ("geography", "status", "signal_count", "z_score", "score")))
    return results.select("geography", "status", F.lit(run_key).alias("run_key"), F.lit(population_hash).alias("population_hash"), body.alias("output_hash")).withColumn(
        "receipt_id", joined_hash(F.col("run_key"), F.col("population_hash"), F.col("output_hash")))


def population_hash(rows: DataFrame, key: list[str], hash_col: str) -> str:
    """An order-free digest of a population: counts and sums of its hashes' leading and trailing parts."""
    part = lambda at: F.sum(F.conv(F.substring(hash_col, at, 8), 16, 10).cast("decimal(38,0)"))
    got = rows.select(*key, hash_col).distinct().agg(F.count("*"), part(1), part(17), part(33), part(49)).first()
    import hashlib

    return hashlib.sha256("\x1f".join(str(v) for v in got).encode()).hexdigest()


def resolve_geography(values: DataFrame, registry: DataFrame) -> DataFrame:
    """value -> geography by id, name, code or state alias; the first record of the registry wins.
    registry: place (order), geography, name, fips."""
    from ..functions.columns import geography_key, state_alias

    keys = [geography_key(F.col("geography")), geography_key(F.col("name")), geography_key(F.col("fips")), state_alias(F.col("geography"))]
    lookup = registry.select("place", "geography", F.explode(F.array_distinct(F.array_compact(F.array(*keys)))).alias("key")).groupBy("key").agg(F.min(F.struct("place", "geography"))["geography"].alias("geography"))
    return values.withColumn("key", geography_key(F.col("value"))).join(lookup, "key", "left").drop("key")


