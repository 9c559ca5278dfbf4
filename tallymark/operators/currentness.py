"""Keeping candidates current over repeated runs: one current row for each semantic key, and retirement
of what a complete replay no longer finds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..tables import joined_hash


def semantic_key():
    """By rule, signal type, stream (none for rules across categories), jurisdiction and title."""
    stream = F.when(F.col("rule_id") == "cross_category_entity", F.lit("")).otherwise(F.col("stream_id"))
    return joined_hash(F.col("rule_id"), F.col("signal_type"), stream, F.col("jurisdiction_id"), F.col("title"))


def current(candidates: DataFrame) -> DataFrame:
    """candidates (semantic_key, candidate_hash, candidate_id, seen_ms, run_id) with is_current,
    supersedes (the candidate before, if its hash differs) and retired_ms (when the next came)."""
    w = W.partitionBy("semantic_key").orderBy("seen_ms", "candidate_id")
    x = candidates.withColumn("_before", F.lag("candidate_id").over(w)).withColumn("_hash", F.lag("candidate_hash").over(w)).withColumn("retired_ms", F.lead("seen_ms").over(w))
    return x.withColumn("is_current", F.col("retired_ms").isNull()).withColumn("supersedes", F.when(F.col("_hash") != F.col("candidate_hash"), F.col("_before"))).drop("_before", "_hash")


def merged(existing: DataFrame, run: DataFrame, run_id: str, at_ms: int) -> DataFrame:
    """existing after a run that found ``run``: both semantic_key, candidate_hash; existing also
    first_ms, seen_ms, is_current, last_run. A hash seen again keeps its first time; another current row
    of its key steps down; new hashes become current."""
    found = run.select("semantic_key", "candidate_hash").distinct()
    keys = found.groupBy("semantic_key").agg(F.max("candidate_hash").alias("_new"))
    x = existing.join(found.withColumn("_again", F.lit(True)), ["semantic_key", "candidate_hash"], "left").join(keys, "semantic_key", "left")
    old = x.select(
        "semantic_key", "candidate_hash", "first_ms", F.when(F.col("_again"), F.lit(at_ms)).otherwise(F.col("seen_ms")).alias("seen_ms"),
        F.when(F.col("_new").isNull(), F.col("is_current")).otherwise(F.col("candidate_hash") == F.col("_new")).alias("is_current"),
        F.when(F.col("_again"), F.lit(run_id)).otherwise(F.col("last_run")).alias("last_run"))
    new = found.join(existing, ["semantic_key", "candidate_hash"], "left_anti").join(keys, "semantic_key").select(
        "semantic_key", "candidate_hash", F.lit(at_ms).alias("first_ms"), F.lit(at_ms).alias("seen_ms"), (F.col("candidate_hash") == F.col("_new")).alias("is_current"), F.lit(run_id).alias("last_run"))
    return old.unionByName(new)


def retirements(existing: DataFrame, run: DataFrame, complete: bool, newer_runs: bool = False) -> DataFrame:
    """Current rows of the run's rules that it did not find; none where the run was truncated or a newer
    one exists. existing: rule_id, candidate_hash, is_current; run: rule_id, candidate_hash."""
    x = existing.where("is_current").join(run.select("candidate_hash").distinct(), "candidate_hash", "left_anti").join(run.select("rule_id").distinct(), "rule_id", "left_semi")
    if not complete or newer_runs:
        x = x.limit(0)
    return x.withColumn("reason", F.lit("not_observed_in_complete_replay")).withColumn("retirement_hash", joined_hash(F.col("candidate_hash"), F.col("reason")))


def replay_count(existing: DataFrame, run: DataFrame) -> DataFrame:
    """How many of a run's candidates were known."""
    known = run.join(existing.select("candidate_hash").distinct(), "candidate_hash", "left_semi").agg(F.count("*").alias("replayed"))
    return run.agg(F.count("*").alias("found")).crossJoin(known).withColumn("inserted", F.col("found") - F.col("replayed"))


def versions(records: DataFrame, keys: list[str], hash_col: str, order: list[str]) -> DataFrame:
    """Slowly changing versions: a record whose hash equals the one before it is skipped; the others carry
    a version number and the time until which they held."""
    w = W.partitionBy(*keys).orderBy(*order)
    x = records.withColumn("_p", F.lag(hash_col).over(w)).where(F.col("_p").isNull() | (F.col("_p") != F.col(hash_col))).drop("_p")
    return x.withColumn("version", F.row_number().over(w)).withColumn("valid_until", F.lead(order[0]).over(w)).withColumn("is_current", F.col("valid_until").isNull())
