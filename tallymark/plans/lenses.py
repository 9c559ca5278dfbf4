"""Structural lenses: weighted views whose scores blend only when every one of them is resolved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .canonical import digest

#: fixed values
LENSES = ("recurrence", "contradiction", "suppression", "amplification", "dependency", "authority_concentration", "burden_shift", "temporal_acceleration", "geographic_diffusion", "cross_jurisdiction_recurrence", "weak_joint", "orphaned_pathway", "disconfirmation")


def stack(weights: dict[str, float], require_disconfirmation: bool = False) -> dict[str, float]:
    """Validated weights in order of lens."""
    if not weights or set(weights) - set(LENSES):
        raise ValueError(f"unknown lenses {sorted(set(weights) - set(LENSES))}" if weights else "a stack needs lenses")
    if any(not 0 < w <= 1 for w in weights.values()) or abs(sum(weights.values()) - 1) > 1e-12:
        raise ValueError("weights are in (0, 1] and sum to 1")
    if require_disconfirmation and "disconfirmation" not in weights:
        raise ValueError("the stack must hold disconfirmation")
    return dict(sorted(weights.items()))


def blend(activations: DataFrame, weights: dict[str, float], key: str = "subject") -> DataFrame:
    """key, resolved, unresolved, score: the weighted sum, null while a lens is unresolved. activations:
    key, lens, status (observed, not_observed, unresolved), score, evidence (count). A score without
    evidence counts as unresolved; lenses outside the stack are an error flag."""
    spark = activations.sparkSession
    lenses = spark.createDataFrame(list(stack(weights).items()), "lens string, weight double")
    want = activations.select(key).distinct().crossJoin(F.broadcast(lenses))
    x = want.join(activations, [key, "lens"], "left")
    good = F.when((F.col("status") == "observed") & F.col("score").between(0, 1) & (F.col("evidence") > 0), F.col("score")).when(F.col("status") == "not_observed", F.lit(0.0))
    x = x.withColumn("_s", good)
    return x.groupBy(key).agg(
        F.count("_s").alias("resolved"), F.count_if(F.col("_s").isNull()).alias("unresolved"),
        F.when(F.count_if(F.col("_s").isNull()) == 0, F.round(F.sum(F.col("weight") * F.col("_s")), 12)).alias("score"))


def receipt(weights: dict[str, float], score: float | None) -> str:
    return digest({"stack": stack(weights), "score": score})
