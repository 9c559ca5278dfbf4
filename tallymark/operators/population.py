"""Detectors over the whole population of observations: what is concentrated, repeated or changing.

Every detector is a count per group and, where it compares groups, statistics over the groups of a
partition; rows are reduced to counts before any window sees them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import clamp, half_up, severity_by_z
from ..tables import joined_hash

#: rule: (least count, least z, confidence base, confidence by z, highest confidence)
CONCENTRATION = {
    "frequency_spike": (10, 1.5, 0.55, 0.1, 0.95),
    "geographic_cluster": (10, 1.5, 0.5, 0.1, 0.93),
    "repeat_entity": (10, 2.0, 0.5, 0.08, 0.92),
}


def group_scores(obs: DataFrame, partition: list[str], group: str) -> DataFrame:
    """partition, group, n, total (rows of the partition), mean, deviation (of the population), z.
    Rows without a group count towards total alone; z is null where groups do not differ."""
    counts = obs.groupBy(*partition, group).agg(F.count("*").alias("n"))
    own = W.partitionBy(*partition)
    real = F.when(F.col(group).isNotNull(), F.col("n"))
    scored = counts.select(
        *partition, group, "n", F.sum("n").over(own).alias("total"), F.avg(real).over(own).alias("mean"), F.stddev_pop(real).over(own).alias("deviation"), F.count(real).over(own).alias("groups")
    )
    z = F.when((F.col("groups") >= 2) & (F.col("deviation") > 0), (F.col("n") - F.col("mean")) / F.col("deviation"))
    return scored.where(F.col(group).isNotNull()).withColumn("z", z)


def concentration(obs: DataFrame, rule: str, group: str) -> DataFrame:
    """Groups of a (stream, jurisdiction) that stand out by ``rule``."""
    least, z, base, slope, most = CONCENTRATION[rule]
    got = group_scores(obs, ["stream_id", "jurisdiction_id"], group).where((F.col("n") >= least) & (F.col("z") >= z))
    return got.select(
        F.lit(rule).alias("rule_id"), "stream_id", "jurisdiction_id", F.col(group).alias("subject"), "n", "total",
        F.round("mean", 4).alias("mean"), F.round("deviation", 4).alias("deviation"), F.round("z", 4).alias("z_score"),
        F.round(100 * F.col("n") / F.col("total"), 4).alias("percent"),
        F.round(clamp(F.least(F.lit(most), base + slope * F.col("z")), 0, 1), 6).alias("confidence"), severity_by_z(F.col("z")).alias("severity"),
        joined_hash(F.lit(rule), F.col("stream_id"), F.col("jurisdiction_id"), F.col(group), F.col("n"), F.col("total")).alias("candidate_hash"),
    )


def trends(counts: DataFrame, keys: list[str], year: str, n: str, least: int = 10, percent: float = 50.0) -> DataFrame:
    """Changes between consecutive years. counts: keys, year, n."""
    w = W.partitionBy(*keys).orderBy(year)
    x = counts.withColumn("prior_year", F.lag(year).over(w)).withColumn("prior_count", F.lag(n).over(w))
    x = x.where((F.col(year) - F.col("prior_year") == 1) & (F.col("prior_count") >= least))
    change = 100.0 * (F.col(n) - F.col("prior_count")) / F.col("prior_count")
    x = x.withColumn("change", change).where(F.abs("change") >= percent)
    return x.select(
        *keys, F.col(year).alias("year"), "prior_count", F.col(n).alias("current_count"), F.round("change", 4).alias("percent_change"),
        F.round(F.least(F.lit(0.95), 0.55 + F.abs("change") / 500), 6).alias("confidence"),
        F.when(F.abs("change") >= 200, "critical").when(F.abs("change") >= 100, "high").otherwise("medium").alias("severity"),
    )


def cross_category(obs: DataFrame, least: int = 10, categories: int = 3) -> DataFrame:
    """Entities of a jurisdiction that many categories share."""
    x = obs.groupBy("jurisdiction_id", "entity").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("category")).alias("names"))
    x = x.withColumn("categories", F.size("names")).where((F.col("n") >= least) & (F.col("categories") >= categories))
    return x.select(
        "jurisdiction_id", "entity", "n", "categories", F.array_join("names", ",").alias("names"),
        F.round(F.least(F.lit(0.93), 0.5 + 0.06 * F.col("categories")), 6).alias("confidence"),
        F.when(F.col("categories") >= 7, "critical").when(F.col("categories") >= 5, "high").otherwise("medium").alias("severity"),
    )


def cross_jurisdiction(obs: DataFrame, least: int = 10, jurisdictions: int = 2, unknown: str = "unknown") -> DataFrame:
    """Entities that recur in several known jurisdictions."""
    known = F.when(F.col("jurisdiction_id") != unknown, F.col("jurisdiction_id"))
    x = obs.groupBy("entity").agg(F.count("*").alias("n"), F.sort_array(F.collect_set(known)).alias("names"))
    x = x.withColumn("j", F.size("names")).where((F.col("n") >= least) & (F.col("j") >= jurisdictions))
    return x.select(
        "entity", "n", F.col("j").alias("jurisdictions"), F.array_join("names", ",").alias("names"),
        F.round(F.least(F.lit(0.95), 0.5 + 0.05 * F.col("j") + F.least("n", F.lit(100)) / 1000), 6).alias("confidence"),
        F.when(F.col("j") >= 8, "critical").when(F.col("j") >= 4, "high").otherwise("medium").alias("severity"),
    )


def evidence(obs: DataFrame, keys: list[str], most: int = 25) -> DataFrame:
    """keys, n, refs: the first ``most`` distinct references (stream, offset, hash) of each group, in
    order. Ranks come before collecting, so no group is ever collected whole."""
    refs = obs.where("identity_hash is not null").select(*keys, "stream_id", "offset", "identity_hash").distinct()
    w = W.partitionBy(*keys).orderBy("stream_id", "offset", "identity_hash")
    top = refs.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= most)
    got = top.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("stream_id", "offset", "identity_hash"))).alias("refs"))
    return got


def limited(candidates: DataFrame, rule: str, order: str, most: int) -> DataFrame:
    """At most ``most`` candidates of each rule by ``order``, with whether the rule had more."""
    w = W.partitionBy(rule)
    ranked = candidates.withColumn("_i", F.row_number().over(w.orderBy(order)))
    counts = candidates.groupBy(rule).agg((F.count("*") > most).alias("truncated"))
    return ranked.where(F.col("_i") <= most).drop("_i").join(counts, rule)


def rate_of_unresolved(records: DataFrame) -> DataFrame:
    """Entities by the share of their distinct records that stay unresolved. records: entity, record,
    unresolved, ts_ms."""
    unique = records.groupBy("entity", "record").agg(F.bool_or("unresolved").alias("unresolved"), F.max("ts_ms").alias("ts_ms"))
    x = unique.groupBy("entity").agg(F.count("*").alias("n"), F.count_if("unresolved").alias("unresolved"), F.max("ts_ms").alias("newest_ms"))
    rate: Column = half_up(F.col("unresolved") / F.col("n"), 6)
    x = x.withColumn("rate", rate)
    severity = F.when((F.col("rate") >= 0.95) & (F.col("n") >= 100), "critical").when((F.col("rate") >= 0.8) & (F.col("n") >= 10), "high").otherwise("medium")
    return x.withColumn("severity", severity)
