"""Exact resolution of observations to canonical entities, by identifier first and name second.

Candidates meet three exploded indexes (identifiers, names, aliases) in equality joins; what a candidate
matches is aggregated to counts and smallest ids, from which a ladder of conditions decides. Ambiguity is
reported, never broken by taking a first match.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import entity_key, identifier_key, squeezed

ORGANIZATIONS = ("organization", "company", "nonprofit", "government_agency")


def identifier_index(entities: DataFrame) -> DataFrame:
    """kind, key, entity_id of active entities. entities: entity_id, entity_type, name, variants, ids (map
    kind -> value), active."""
    return entities.where("active").select("entity_id", F.explode("ids").alias("kind", "value")).select("entity_id", "kind", identifier_key(F.col("kind"), F.col("value")).alias("key")).where("key is not null").distinct()


def name_index(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """key, entity_id, tier: 1 primary names, 2 variants, 3 aliases that are certain and not fuzzy.
    aliases: entity_id, alias, alias_type, confidence."""
    live = entities.where("active")
    primary = live.select("entity_id", entity_key(F.col("name")).alias("key"), F.lit(1).alias("tier"))
    variants = live.select("entity_id", F.explode("variants").alias("v")).select("entity_id", entity_key(F.col("v")).alias("key"), F.lit(2).alias("tier"))
    sure = aliases.where("confidence = 1 and alias_type <> 'fuzzy_match'").join(live.select("entity_id"), "entity_id", "left_semi").select("entity_id", entity_key(F.col("alias")).alias("key"), F.lit(3).alias("tier"))
    return primary.union(variants).union(sure).where("key is not null").groupBy("key", "entity_id").agg(F.min("tier").alias("tier"))


def resolve(candidates: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """candidates (candidate_id, expected_type, name, id_kind, id_value) with status, method, entity_id,
    matches. The indexes are brought to one row a key first, so that each candidate meets one row of either
    and nothing is aggregated by candidate."""
    types = entities.groupBy("entity_id").agg(F.min("entity_type").alias("entity_type"))
    own = entities.where("active").select("entity_id", F.lit("canonical").alias("kind"), F.col("entity_id").alias("key"))
    ids = identifier_index(entities).where("kind <> 'canonical'").unionByName(own).distinct().join(types, "entity_id")
    ids = ids.groupBy(F.col("kind").alias("id_kind"), F.col("key").alias("_key")).agg(F.count("*").alias("n_id"), F.min(F.struct("entity_id", "entity_type")).alias("_i"))
    names = name_index(entities, aliases).join(types, "entity_id")
    names = names.groupBy(F.col("key").alias("_name")).agg(F.count("*").alias("n_name"), F.min(F.struct("entity_id", "entity_type")).alias("_n"), F.max("entity_id").alias("name_last"), F.min("tier").alias("tier"))
    c = candidates.withColumn("_id", identifier_key(F.col("id_kind"), F.col("id_value"))).withColumn("_name", entity_key(squeezed(F.col("name"))))
    c = c.withColumn("_key", F.when(F.col("id_kind") == "canonical", F.col("id_value")).otherwise(F.col("_id")))
    x = c.join(ids, ["id_kind", "_key"], "left").join(names, "_name", "left").na.fill(0, ["n_id", "n_name"])
    x = x.withColumn("id_entity", F.col("_i.entity_id")).withColumn("name_entity", F.col("_n.entity_id"))
    other = (F.col("n_name") > 0) & ((F.col("name_entity") != F.col("id_entity")) | (F.col("name_last") != F.col("id_entity")))
    method = (
        F.when((F.col("n_id") == 1) & other, "identifier_name_conflict")
        .when(F.col("n_id") == 1, F.when(F.col("id_kind") == "canonical", "exact_canonical_entity_id").otherwise("exact_external_identifier"))
        .when(F.col("n_id") > 1, "duplicate_external_identifier")
        .when(F.col("n_name") == 1, F.element_at(F.array(*map(F.lit, ("exact_primary_name", "exact_name_variant", "exact_alias"))), F.col("tier")))
        .when(F.col("n_name") > 1, "duplicate_exact_name")
        .when(F.col("_id").isNull() & F.col("_name").isNull() & (F.col("id_kind").isNull() | (F.col("id_kind") != "canonical")), "no_usable_identity_value")
        .otherwise("no_exact_match")
    )
    x = x.withColumn("method", method)
    found = F.when(F.col("method").startswith("exact_"), F.when(F.col("n_id") == 1, F.col("id_entity")).otherwise(F.col("name_entity")))
    kind = F.when(F.col("n_id") == 1, F.col("_i.entity_type")).otherwise(F.col("_n.entity_type"))
    x = x.withColumn("entity_id", found).withColumn("entity_type", kind)
    fits = (F.col("expected_type") == "any") | (F.col("entity_type") == F.col("expected_type")) | ((F.col("expected_type") == "organization") & F.col("entity_type").isin(*ORGANIZATIONS))
    wrong = F.col("entity_id").isNotNull() & ~F.coalesce(fits, F.lit(False))
    x = x.withColumn("method", F.when(wrong, "exact_match_entity_type_mismatch").otherwise(F.col("method"))).withColumn("entity_id", F.when(~wrong, F.col("entity_id")))
    status = F.when(F.col("entity_id").isNotNull(), "resolved").when(F.col("method").isin("identifier_name_conflict", "duplicate_external_identifier", "duplicate_exact_name"), "ambiguous").otherwise("unresolved")
    return x.select(*candidates.columns, status.alias("status"), "method", "entity_id", F.greatest("n_id", "n_name").alias("matches"))


def cross_stream(resolved: DataFrame, least: int = 2) -> DataFrame:
    """Entities by the streams they occur in. resolved: entity_id, stream_id, offset."""
    x = resolved.where("entity_id is not null").groupBy("entity_id").agg(
        F.count_distinct("stream_id", "offset").alias("events"), F.array_sort(F.collect_set("stream_id")).alias("names"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"))
    return x.withColumn("streams", F.size("names")).where(F.col("streams") >= least).withColumn("names", F.array_join("names", ","))


def timeline(resolved: DataFrame, entity_id: str, before_ms: int, most: int = 100) -> DataFrame:
    return resolved.where((F.col("entity_id") == entity_id) & (F.col("ts_ms") < before_ms)).orderBy(F.desc("ts_ms"), "stream_id", F.desc("offset")).limit(max(1, min(most, 5000)))


def coverage(resolutions: DataFrame) -> DataFrame:
    return resolutions.groupBy("stream_id", "status", "method").agg(F.count("*").alias("n"))
