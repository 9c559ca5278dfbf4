"""Detectors over exact relations: shared identifiers, pass-through transfers, contradictions, ranges.

Pairs come from equality joins on exploded keys with residual predicates; a band in time is turned into
an equality on time tiles, so that one busy party's transfers meet only those of near tiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import comparable, let
from ..tables import DAY_MS

ENDED = ("dead", "dissolved", "revoked", "suspended", "debarred", "terminated", "inactive")
REUSE_KINDS = ("address", "phone", "license", "agent", "operator", "facility", "activity")


def weighted_confidence(factors: list[tuple[float, Column]]) -> Column:
    """Sum of the weights of satisfied factors over the sum of weights, six places."""
    got = sum((F.when(ok, F.lit(w)).otherwise(F.lit(0.0)) for w, ok in factors), F.lit(0.0))
    return F.round(got / sum(w for w, _ in factors), 6)


def combinations(xs: Column, k: int) -> Column:
    """All choices of k elements of an array, each in the array's order."""
    if k == 1:
        return F.transform(xs, lambda x: F.array(x))
    return F.flatten(F.transform(xs, lambda x, i: F.transform(combinations(F.slice(xs, i + 2, F.size(xs)), k - 1), lambda c: F.concat(F.array(x), c))))


def phoenix(entities: DataFrame, identifiers: DataFrame, days: int = 730, shared: int = 2, many: int = 256) -> DataFrame:
    """Ended entities that go on as another: at least ``shared`` equal identifiers, formed within
    ``days`` of the end. entities: entity_id (unique), status, formed_ms, ended_ms; identifiers: entity_id,
    kind, value.

    Two entities meet by an identifier of at most ``many`` entities or, where they have only wider ones in
    common, by ``shared`` of these at once: one wide identifier alone brings no pair together. A pair counts
    where the keys it meets by are the first that it has in common, so each comes once and none is counted up."""
    ids = identifiers.where("kind is not null and value is not null").select("entity_id", "kind", "value").distinct()
    wide = ids.groupBy("kind", "value").agg(F.count("*").alias("n")).where(F.col("n") > many).select("kind", "value", F.lit(True).alias("wide"))
    item = F.struct(F.coalesce("wide", F.lit(False)).alias("wide"), "kind", "value")
    held = ids.join(wide, ["kind", "value"], "left").groupBy("entity_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    old = entities.where(F.lower("status").isin(*ENDED) & F.col("ended_ms").isNotNull()).select(F.col("entity_id").alias("predecessor"), "ended_ms")
    new = entities.where("formed_ms is not null").select(F.col("entity_id").alias("successor"), "formed_ms")
    narrow = F.transform(F.filter("items", lambda x: ~x["wide"]), lambda x: F.array(x))
    keys = F.explode(F.concat(narrow, combinations(F.filter("items", lambda x: x["wide"]), shared))).alias("key")
    held = held.where(F.size("items") >= shared)
    left = held.withColumnRenamed("entity_id", "predecessor").join(old, "predecessor").select("predecessor", "ended_ms", F.col("items").alias("own"), keys)
    right = held.withColumnRenamed("entity_id", "successor").join(new, "successor").select("successor", "formed_ms", "items", keys)
    gap = F.floor((F.col("formed_ms") - F.col("ended_ms")) / DAY_MS)
    near = (F.col("predecessor") != F.col("successor")) & (F.col("formed_ms") >= F.col("ended_ms")) & (gap <= days)
    common = F.array_intersect("own", "items")
    first = let(common, lambda c: (F.size(c) >= shared) & (F.col("key") == F.slice(c, 1, F.when(c[0]["wide"], shared).otherwise(1))))
    x = left.join(right, "key").where(near & first).select("predecessor", "successor", gap.cast("long").alias("gap_days"), F.size(common).cast("long").alias("shared"))
    return x.withColumn("confidence", weighted_confidence([(0.65, F.lit(True)), (0.2, F.lit(True)), (0.15, F.col("gap_days") <= 365)])).withColumn("severity", F.lit("high"))


def identifier_reuse(identifiers: DataFrame, kinds: tuple[str, ...] = REUSE_KINDS) -> DataFrame:
    """Identifiers that several entities carry."""
    x = identifiers.where(F.col("kind").isin(*kinds) & F.col("value").isNotNull()).select("kind", "value", "entity_id").distinct()
    return x.groupBy("kind", "value").agg(F.count("*").alias("entities"), F.min("entity_id").alias("first_entity")).where("entities >= 2").withColumn("severity", F.lit("medium"))


def conduits(transfers: DataFrame, days: int = 30, low: float = 0.8, high: float = 1.05) -> DataFrame:
    """Money that a party passes on: in.to = out.from within ``days``, in a ratio from low to high.
    transfers: transfer_id, from_id, to_id, amount, ts_ms."""
    tile = days * DAY_MS
    good = transfers.where("from_id is not null and to_id is not null and amount > 0 and ts_ms is not null")
    into = good.select(F.col("transfer_id").alias("in_id"), F.col("from_id").alias("origin"), F.col("to_id").alias("party"), F.col("amount").alias("in_amount"), F.col("ts_ms").alias("in_ms"))
    t = F.floor(F.col("in_ms") / tile)
    into = into.withColumn("tile", F.explode(F.array(t, t + 1)))
    out = good.select(F.col("transfer_id").alias("out_id"), F.col("from_id").alias("party"), F.col("to_id").alias("target"), F.col("amount").alias("out_amount"), F.col("ts_ms").alias("out_ms"), F.floor(F.col("ts_ms") / tile).alias("tile"))
    gap = F.floor((F.col("out_ms") - F.col("in_ms")) / DAY_MS)
    ratio = F.col("out_amount") / F.col("in_amount")
    x = into.join(out, ["party", "tile"]).where((F.col("in_id") != F.col("out_id")) & (F.col("origin") != F.col("target")) & (F.col("out_ms") >= F.col("in_ms")) & (gap <= days) & (ratio >= low) & (ratio <= high))
    return x.select("party", "in_id", "out_id", "origin", "target", gap.cast("long").alias("gap_days"), F.round(ratio, 6).alias("ratio"), F.lit("high").alias("severity"))


def legislative_overlap(transfers: DataFrame, actions: DataFrame, days: int = 365) -> DataFrame:
    """Transfers to an actor near in time to the actor's actions on policies that share a tag.
    transfers: transfer_id, to_id, ts_ms, tags; actions: action_id, actor_id, ts_ms, tags."""
    tile = days * DAY_MS
    t = F.floor(F.col("ts_ms") / tile)
    left = transfers.where("to_id is not null and ts_ms is not null").select("transfer_id", F.col("to_id").alias("actor_id"), F.col("ts_ms").alias("t_ms"), F.col("tags").alias("t_tags"), F.explode(F.array(t - 1, t, t + 1)).alias("tile"))
    right = actions.where("actor_id is not null and ts_ms is not null").select("action_id", "actor_id", F.col("ts_ms").alias("a_ms"), F.col("tags").alias("a_tags"), t.alias("tile"))
    both = F.array_sort(F.array_intersect("t_tags", "a_tags"))
    x = left.join(right, ["actor_id", "tile"]).where((F.abs(F.col("t_ms") - F.col("a_ms")) <= tile) & F.arrays_overlap("t_tags", "a_tags"))
    return x.select("actor_id", "transfer_id", "action_id", F.floor(F.abs(F.col("t_ms") - F.col("a_ms")) / DAY_MS).cast("long").alias("gap_days"), F.array_join(both, ",").alias("tags"), F.lit("high").alias("severity"))


def contradictions(assertions: DataFrame) -> DataFrame:
    """Claims on which sources differ. assertions: subject, predicate, value, source."""
    x = assertions.select("subject", "predicate", comparable(F.col("value").cast("string")).alias("value"), "source").where("subject is not null and predicate is not null and value is not null")
    x = x.groupBy("subject", "predicate").agg(F.count("*").alias("n"), F.count_distinct("value").alias("n_values"), F.count_distinct("source").alias("n_sources"))
    return x.where("n_values >= 2 and n_sources >= 2").withColumn("severity", F.lit("medium"))


def out_of_range(numbers: DataFrame) -> DataFrame:
    """Numbers below or above a bound; either bound may be missing. numbers: actual, least, most, ..."""
    low, high = F.col("actual") < F.col("least"), F.col("actual") > F.col("most")
    return numbers.where(low | high).withColumn("side", F.when(low, "below").otherwise("above"))


def readiness(events: DataFrame) -> DataFrame:
    """Counts of what the integrity detectors can use, and which detectors have nothing to read.
    events: kind."""
    kinds = ("entity_registration", "financial_transfer", "legislative_action", "source_assertion", "numeric_observation")
    x = events.agg(F.count("*").alias("events"), *(F.count_if(F.col("kind") == k).alias(k) for k in kinds))
    gaps = F.array_compact(F.array(*(F.when(F.col(k) == 0, F.lit(f"no_{k}")) for k in kinds)))
    return x.withColumn("gaps", F.array_join(gaps, ","))


def combined(*candidates: DataFrame) -> DataFrame:
    """All detectors' candidates, one a hash."""
    out = candidates[0]
    for c in candidates[1:]:
        out = out.unionByName(c, allowMissingColumns=True)
    return out.dropDuplicates(["candidate_hash"])
