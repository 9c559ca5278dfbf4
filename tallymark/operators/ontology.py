"""Summaries of how signals were derived: types, rules, runs, and one row over all of them. Receipts and
candidates are counted before they meet what they are about."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def signal_types(signals: DataFrame, types: DataFrame, extractions: DataFrame) -> DataFrame:
    """By type and source: signals (signal_id, type_id, source_domain, fingerprint, is_suppressed, confidence,
    detected_ms) of known types, with how many extraction receipts (signal_id) they have."""
    receipts = extractions.groupBy("signal_id").agg(F.count("*").alias("_n"))
    x = signals.join(receipts, "signal_id", "left").groupBy("type_id", "source_domain").agg(
        F.count("*").alias("signals"), F.count("fingerprint").alias("fingerprinted"), F.count_if("is_suppressed").alias("suppressed"), F.count_if(F.col("_n") > 0).alias("receipted"), F.coalesce(F.sum("_n"), F.lit(0)).alias("extraction_receipts"),
        F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.min("detected_ms").alias("first_ms"), F.max("detected_ms").alias("last_ms"))
    return x.join(types, "type_id").drop("type_id")


def candidate_rules(rules: DataFrame, candidates: DataFrame) -> DataFrame:
    """rules (rule_id, rule_version, ...) with counts of their candidates by state; rules without any stay."""
    state = lambda c, v: F.count_if(F.col(c) == v).alias(v)
    got = candidates.groupBy("rule_id", "rule_version").agg(F.count("candidate_id").alias("candidates"), state("verification_state", "verified"), *(state("status", s) for s in ("bridged", "pending", "failed")), F.min("detected_ms").alias("first_ms"), F.max("detected_ms").alias("last_ms"))
    return rules.join(got, ["rule_id", "rule_version"], "left").na.fill(0, ["candidates", "verified", "bridged", "pending", "failed"])


def run_summary(runs: DataFrame, receipts: DataFrame) -> DataFrame:
    """runs with counts of their receipts (run_key, detected, status); 0 where there are none."""
    got = receipts.groupBy("run_key").agg(F.count_if("detected").alias("detected"), F.count_if(F.col("status") == "resolved").alias("resolved"), F.count_if(F.col("status") != "resolved").alias("unresolved"))
    return runs.join(got, "run_key", "left").na.fill(0, ["detected", "resolved", "unresolved"])


def derivation(signals: DataFrame, types: DataFrame, extractions: DataFrame, rules: DataFrame, candidates: DataFrame, runs: DataFrame, receipts: DataFrame) -> DataFrame:
    """One row: what there is of each, and the latest run (the smallest key among the newest)."""
    received = signals.join(extractions.select("signal_id").distinct().withColumn("_r", F.lit(True)), "signal_id", "left")
    one = [
        received.agg(F.count("*").alias("canonical_signals"), F.count_distinct("type_id").alias("canonical_signal_types"), F.count("_r").alias("receipted_signals"), (F.count("*") - F.count("_r")).alias("unreceipted_signals"), F.max("detected_ms").alias("latest_signal_ms")),
        extractions.agg(F.count("*").alias("extraction_receipts")),
        candidates.agg(F.count("*").alias("candidates"), F.count_if(F.col("verification_state") == "verified").alias("verified_candidates"), *(F.count_if(F.col("status") == s).alias(f"{s}_candidates") for s in ("bridged", "pending")), F.max("detected_ms").alias("latest_candidate_ms")),
        rules.agg(F.count("*").alias("rule_versions"), F.count_if("is_active").alias("active_rules")),
        receipts.agg(F.count("*").alias("convergence_receipts")),
    ]
    newest = F.min_by(F.struct("run_key", "total_source_rows", "detected", "persisted_ms"), F.struct(-F.col("persisted_ms"), F.col("run_key")))
    last = run_summary(runs, receipts).agg(F.count("*").alias("convergence_runs"), newest.alias("_l"))
    one.append(last.select("convergence_runs", F.col("_l.run_key").alias("latest_run"), F.col("_l.total_source_rows").alias("latest_source_rows"), F.col("_l.detected").alias("latest_detected"), F.col("_l.persisted_ms").alias("latest_ms")))
    out = one[0]
    for x in one[1:]:
        out = out.crossJoin(x)  # of one row each
    return out
